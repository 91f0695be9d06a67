"""Folds whose next step depends on the previous *decision*.

"Fire again only after a cooldown since the last fire" and "emit only when
the value moved >= x since the last emitted value" cannot be expressed with
window functions over rows: the reference point is a previous output.

``alert_cooldown`` has few keys (rules) with many rows each, so it is a
parallel prefix composition: rows are range-partitioned and cut into blocks,
each block becomes a small step function (time last fired before it -> time
last fired after it), functions are composed over groups of blocks, level by
level, and the times go back down to the blocks, which then mark their rows.
No task sees more than a block of rows or a group of functions.

``emit_on_change`` has many keys with few rows each: rows are hash-partitioned
by key and sorted by (key, time) inside each partition; ``mapInPandas`` walks
the sorted batches carrying O(1) state per key.  Both have streaming versions
with state in the state store (``streaming.stateful``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskloom.operators.alerts import micros
from riskloom.session import cut_lineage, scratch_table_path

NEVER = -(1 << 62)      # nothing fired yet
BLOCK_ROWS = 1 << 16
FAN = 256               # functions composed in one task


# ------------------------------------------------------------ alert cooldown
class Block:
    """Rows of one key in order, as the fold sees them: a row fires if the last
    fire is before ``edge`` = time - cooldown.  After a fire at t the next row
    to fire is the first whose running maximum of edges is beyond t (edges of
    earlier rows are at most t)."""

    def __init__(self, t: np.ndarray, cooldown: np.ndarray):
        self.t = t
        wait = np.where(np.isnan(cooldown), 0.0, np.maximum(np.round(cooldown * 1e6), 0.0)).astype(np.int64)
        self.edge = np.where(np.isnan(cooldown), NEVER + 1, t - wait)
        self.reach = np.maximum.accumulate(self.edge)
        self.after = np.searchsorted(self.reach, t, side="right")

    def function(self) -> tuple[np.ndarray, np.ndarray]:
        """Step function (breaks, outs): a last fire below ``breaks[i]`` (and
        not below the break before) leads to ``outs[i]``; one at or beyond all
        breaks stays.  Last fires later than the first row do not occur."""
        final = self.t.copy()
        for i in range(len(final) - 2, -1, -1):
            if self.after[i] < len(final):
                final[i] = final[self.after[i]]
        first = np.flatnonzero(np.concatenate([[True], self.reach[1:] > self.reach[:-1]]))
        upto = np.searchsorted(self.reach[first], self.t[0], side="right") + 1
        return merged(self.reach[first[:upto]], final[first[:upto]])

    def fired(self, last: int) -> np.ndarray:
        out = np.zeros(len(self.t), dtype=bool)
        i = int(np.searchsorted(self.reach, last, side="right"))
        while i < len(out):
            out[i] = True
            i = int(self.after[i])
        return out


def merged(breaks: np.ndarray, outs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring steps of equal outcome as one."""
    keep = np.concatenate([outs[1:] != outs[:-1], [True]]) if len(outs) else np.zeros(0, bool)
    return breaks[keep], outs[keep]


def applied(fn: tuple[np.ndarray, np.ndarray], last: np.ndarray) -> np.ndarray:
    breaks, outs = fn
    i = np.searchsorted(breaks, last, side="right")
    return np.where(i < len(breaks), np.append(outs, 0)[i], last)


def composed(first: tuple[np.ndarray, np.ndarray], then: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``then`` after ``first``; where ``first`` changes nothing, ``then`` alone."""
    rest = then[0] > (first[0][-1] if len(first[0]) else NEVER)
    return merged(np.concatenate([first[0], then[0][rest]]), np.concatenate([applied(then, first[1]), then[1][rest]]))


_FN = "k long, number long, breaks array<long>, outs array<long>"
_FN_TYPES = pa.schema([("k", pa.int64()), ("number", pa.int64()), ("breaks", pa.list_(pa.int64())), ("outs", pa.list_(pa.int64()))])


def _functions(t: pa.Table) -> list[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    rows = sorted(t.to_pylist(), key=lambda r: r["number"])
    return [(r["number"], (np.array(r["breaks"], np.int64), np.array(r["outs"], np.int64))) for r in rows]


def _up(fns: DataFrame) -> DataFrame:
    """One function per ``FAN`` consecutive ones of a key."""
    def compose(group: pa.Table) -> pa.Table:
        parts = _functions(group)
        fn = parts[0][1]
        for _, nxt in parts[1:]:
            fn = composed(fn, nxt)
        return pa.Table.from_pylist([{"k": group.column("k")[0].as_py(), "number": parts[0][0] // FAN,
                                      "breaks": fn[0], "outs": fn[1]}], schema=_FN_TYPES)
    return cut_lineage(fns.groupBy("k", F.floor(F.col("number") / FAN).alias("up")).applyInArrow(compose, _FN))


def _down(fns: DataFrame, last: DataFrame) -> DataFrame:
    """(k, number, last): what was last fired before each function, from the
    same of the groups above."""
    types = pa.schema([("k", pa.int64()), ("number", pa.int64()), ("last", pa.int64())])

    def walk(group: pa.Table, above: pa.Table) -> pa.Table:
        at, out = np.array(above.column("last")[0].as_py()), []
        for number, fn in _functions(group):
            out.append({"k": group.column("k")[0].as_py(), "number": number, "last": int(at)})
            at = applied(fn, at)
        return pa.Table.from_pylist(out, schema=types)
    up = fns.withColumn("up", F.floor(F.col("number") / FAN))
    return cut_lineage(up.groupBy("k", "up").cogroup(last.withColumnRenamed("number", "up").groupBy("k", "up"))
                       .applyInArrow(walk, "k long, number long, last long"))


def alert_cooldown(df: DataFrame, key: str, ts: str, tiebreak: str, cooldown_col: str,
                   block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``fired`` (bool): the candidate alert is sent, given per-key
    cooldowns measured from the last *fired* alert (``cooldown_col`` in
    seconds, per row, e.g. 1800 for critical and 3600 otherwise; below 0 as 0;
    a row with a null cooldown fires only if nothing has fired before)."""
    spark = df.sparkSession
    rows = (df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
            .select("row", F.col(f"row.`{key}`").alias("key"), F.xxhash64(f"row.`{key}`").alias("k"),
                    micros(f"row.`{ts}`").alias("us"), F.col(f"row.`{tiebreak}`").alias("tie"),
                    F.col(f"row.`{cooldown_col}`").cast("double").alias("cooldown")))
    ordered = rows.repartitionByRange("key", "us", "tie").sortWithinPartitions("key", "us", "tie")
    schema = ordered.select("row", "k", "us", "cooldown").schema.add("block", "long").add("place", "integer")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, place, last = (TaskContext.get().partitionId() << 32) - 1, 0, None
        for b in batches:
            k = b.column(1).to_pylist()
            blocks, places = [], []
            for v in k:
                if v != last or place >= block_rows:
                    block, place, last = block + 1, 0, v
                blocks.append(block)
                places.append(place)
                place += 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(blocks, pa.int64()), pa.array(places, pa.int32())],
                                             names=[*b.schema.names, "block", "place"])
    path = scratch_table_path(spark, "cooldown_blocks")
    ordered.select("row", "k", "us", "cooldown").mapInArrow(number, schema).write.parquet(path)
    numbered = spark.read.parquet(path)

    def _block(t: pa.Table) -> Block:
        return Block(t.column("us").to_numpy(), t.column("cooldown").to_pandas().to_numpy(dtype=np.float64))

    def function(t: pa.Table) -> pa.Table:
        t = t.sort_by("place")
        breaks, outs = _block(t).function()
        return pa.Table.from_pylist([{"k": t.column("k")[0].as_py(), "number": t.column("block")[0].as_py(),
                                      "breaks": breaks, "outs": outs}], schema=_FN_TYPES)
    by_block = cut_lineage(numbered.select("k", "us", "cooldown", "block", "place").groupBy("block").applyInArrow(function, _FN))
    # blocks of a key in order: one slim row per block
    order = by_block.select("k", F.col("number").alias("block")).withColumn(
        "number", (F.row_number().over(Window.partitionBy("k").orderBy("block")) - 1).cast("long"))
    order = cut_lineage(order)
    fns = [by_block.withColumnRenamed("number", "block").join(order, ["k", "block"]).select("k", "number", "breaks", "outs")]
    while (fns[-1].agg(F.max("number")).first()[0] or 0) > 0:
        fns.append(_up(fns[-1]))
    last = fns[-1].select("k", "number", F.lit(NEVER).alias("last"))
    for level in reversed(fns[:-1]):
        last = _down(level, last)
    before = last.join(order, ["k", "number"]).select(F.col("block").alias("of"), "last")
    out_schema = numbered.select("row").schema.add("fired", "boolean")

    def mark(t: pa.Table, at: pa.Table) -> pa.Table:
        t = t.sort_by("place")
        return pa.table([t.column("row"), pa.array(_block(t).fired(at.column("last")[0].as_py()))], names=["row", "fired"])
    marked = numbered.groupBy("block").cogroup(before.groupBy("of")).applyInArrow(mark, out_schema)
    return marked.select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns], "fired")


# ------------------------------------------------------------ emit on change
def _sorted_by_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, key).sortWithinPartitions(key, *order)


def emit_step(last, at, value, us, min_change: float, ttl_us: int | None):
    """Whether a value is emitted, and its change: nothing emitted before, the
    last emitted value has expired, or the value moved far enough from it."""
    if last is None or (ttl_us is not None and us - at >= ttl_us):
        return True, 0.0
    return (True, value - last) if abs(value - last) >= min_change else (False, None)


def emit_on_change(df: DataFrame, key: str, order: list[str], value: str, min_change: float = 1.0,
                   ttl_s: float | None = None) -> DataFrame:
    """Adds ``emitted`` and ``change``: emit when nothing was emitted before for
    the key, |value - last emitted value| >= ``min_change``, or the last emitted
    value is ``ttl_s`` seconds old (``order[0]`` is the time; None: it stays)."""
    out_schema = StructType(list(df.schema.fields)).add("emitted", "boolean").add("change", "double")
    ttl_us = None if ttl_s is None else int(round(ttl_s * 1e6))
    us = F.lit(0).cast("long") if ttl_us is None else micros(f"`{order[0]}`")
    s = _sorted_by_key(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), us.alias("us"),
                                 *[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate([key, *order])]),
                       "o0", [f"o{i}" for i in range(1, len(order) + 1)]).select("row.*", F.col("us").alias("us of the row"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cur_key, last, at = object(), None, None
        for pdf in it:
            keys, times = pdf[key].to_numpy(), pdf["us of the row"].to_numpy()
            v = pdf[value].to_numpy(dtype=np.float64)
            emitted = np.zeros(len(pdf), dtype=bool)
            change = np.full(len(pdf), np.nan)
            for i in range(len(pdf)):
                if keys[i] != cur_key:
                    cur_key, last, at = keys[i], None, None
                if np.isnan(v[i]):
                    continue
                emitted[i], moved = emit_step(last, at, v[i], times[i], min_change, ttl_us)
                if emitted[i]:
                    change[i], last, at = moved, v[i], times[i]
            yield pdf.drop(columns=["us of the row"]).assign(
                emitted=emitted, change=pd.Series(change, dtype="Float64", index=pdf.index).mask(~emitted))

    return s.mapInPandas(run, out_schema)
