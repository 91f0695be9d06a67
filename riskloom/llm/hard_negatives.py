"""Hard negatives by best-first search over an STR-packed R-tree.

For every anchor: its ``k_positive`` nearest rows of the same label by inner
product, and for each of these the ``k_negative`` nearest rows of other labels
whose score lies in a window below the positive's score.  Vectors are integers,
scores are exact.

1. Packing.  Rows are tiled by sort-tile-recursive packing: slabs of equal
   count on the coordinate of the largest variance, inside each slab slabs on
   the next, then order on a third, all by label first.  Runs of about 65,000
   rows become blocks; inside a block the same packing over its own coordinates
   gives pages of 128 rows and nodes of 16 pages.  Every box holds the least
   and the largest value per coordinate and its range of labels.
2. Bounds.  For an anchor q and a box, every coordinate's product lies in an
   interval; the sums of the interval ends bound the inner products inside.
3. Search.  Anchors are packed in parts the same way.  Blocks whose box cannot
   meet the window of any anchor of a part, or lies strictly below its kth
   score, are left out (boxes travel in chunks of 4,096); the others are joined
   by block number.  Inside a block a queue holds nodes and pages by upper
   bound and ends at the first box strictly below the kth score or the window.
   The kth score starts at what the anchor's own part shows.
4. At most k rows an anchor and block are merged by rank.

Every anchor is searched against all rows; nothing is sampled.  In 64
dimensions boxes of unclustered vectors are wide, so work there is close to
all rows per anchor, in blocks.

Results for special cases: rows without id, label or vector, or with a null or
out of range component (2^25 or more), take no part; vectors of different
lengths are not compared; repeated rows (id, label and vector equal) count as
one, rows that share an id are not each other's neighbours; ties go to the
smaller id; a negative positive_score has an empty window; an anchor without
rows of its label gives no rows; extra columns, whatever their names, are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import register, table, written

BLOCK_ROWS = 1 << 16
PART_ANCHORS = 1 << 11
PAGE_ROWS = 128
NODE_PAGES = 16
BOX_CHUNK = 4096
LIMIT = 1 << 25          # components stay below, so that sums fit a long
MAX_SLABS = 128          # slabs per coordinate: their bounds are 128 x 128 numbers at most
LOW = -(1 << 62)

RUN_SCHEMA = ("run long, dim int, label_lo long, label_hi long, n int, ids binary, labels binary, body binary, "
              "lo array<int>, hi array<int>, kth binary")
RESULT_SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


# ---------------------------------------------------------------- geometry
def exact(m: np.ndarray, other_max: int) -> np.ndarray:
    """``m`` in the cheapest type in which products with components up to
    ``other_max`` add up exactly."""
    top = max(m.shape[1], 1) * int(np.abs(m).max(initial=0)) * max(other_max, 1)
    return m.astype(np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else np.int64)


def bounds(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each row of ``q`` with each box."""
    top = max(int(np.abs(lo).max(initial=0)), int(np.abs(hi).max(initial=0)))
    x = exact(q, top)
    lo, hi = lo.astype(x.dtype), hi.astype(x.dtype)
    up, down = np.maximum(x, 0), np.minimum(x, 0)
    return ((up @ lo.T + down @ hi.T).astype(np.int64), (up @ hi.T + down @ lo.T).astype(np.int64))


def tile(m: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Order of rows after sort-tile-recursive packing into pages: by label,
    then slabs on coordinates of falling variance."""
    axes = np.argsort(-m.var(axis=0), kind="stable") if m.shape[1] else np.zeros(0, np.int64)

    def pack(rows: np.ndarray, k: int) -> list[np.ndarray]:
        pages = math.ceil(len(rows) / PAGE_ROWS)
        if pages <= 1 or k >= len(axes):
            return [rows]
        rows = rows[np.argsort(m[rows, axes[k]], kind="stable")]
        slabs = max(2, math.ceil(pages ** (1 / min(len(axes) - k, 3))))
        size = math.ceil(pages / slabs) * PAGE_ROWS
        return [x for s in range(0, len(rows), size) for x in pack(rows[s:s + size], k + 1)]
    parts = [x for v in np.unique(labels) for x in pack(np.flatnonzero(labels == v), 0)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


class Run:
    """A packed run of rows (a block of rows or a part of anchors), opened in a
    task."""

    def __init__(self, row: dict):
        self.dim, self.n = row["dim"], row["n"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.labels = np.frombuffer(row["labels"], np.int64)
        self.m = np.frombuffer(row["body"], np.int32).reshape(self.n, self.dim)
        self.kth = np.frombuffer(row["kth"], np.int64) if row.get("kth") else None

    def boxes(self):
        """Pages and the nodes above them."""
        at = np.arange(0, self.n, PAGE_ROWS)
        up = np.arange(0, len(at), NODE_PAGES)

        def over(f, values, cut):
            return f.reduceat(values, cut, axis=0)
        page = [over(np.minimum, self.m, at), over(np.maximum, self.m, at),
                over(np.minimum, self.labels, at), over(np.maximum, self.labels, at)]
        node = [over(np.minimum, page[0], up), over(np.maximum, page[1], up),
                over(np.minimum, page[2], up), over(np.maximum, page[3], up)]
        return at, page, node


def own_kth(m: np.ndarray, ids: np.ndarray, labels: np.ndarray, k: int) -> np.ndarray:
    """A lower bound on every anchor's kth positive score: the kth among the
    other anchors of its part with its label."""
    out = np.full(len(ids), LOW, dtype=np.int64)
    x = exact(m, int(np.abs(m).max(initial=0)))
    for v in np.unique(labels):
        own = np.flatnonzero(labels == v)
        if len(own) <= k:
            continue
        s = (x[own] @ x[own].T).astype(np.int64)
        s[ids[own][:, None] == ids[own][None, :]] = LOW
        out[own] = np.partition(s, -k, axis=1)[:, -k]
    return out


# ---------------------------------------------------------------- packing
def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and offsets of a list column without nulls."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]], offsets - offsets[0]


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, dim, q) of the rows that take part."""
    whole = F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < LIMIT))
    return (vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("vec").cast("array<long>"))
            .where("vec_id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL").where(whole)
            .select("vec_id", "label", F.size("vec").alias("dim"), F.col("vec").cast("array<int>").alias("q")))


def main_axes(rows: DataFrame, k: int = 3) -> list[int]:
    """The coordinates of the largest variance."""
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, 0))
        for b in batches:
            values, offsets = _lists(b.column(0))
            if not len(values):
                continue
            place = np.arange(len(values)) - np.repeat(offsets[:-1], np.diff(offsets))
            v = values.astype(np.float64)
            part = np.stack([np.bincount(place), np.bincount(place, v), np.bincount(place, v * v)])
            wide = np.zeros((3, max(total.shape[1], part.shape[1])))
            wide[:, :total.shape[1]] += total
            wide[:, :part.shape[1]] += part
            total = wide
        yield pa.RecordBatch.from_pydict({"axis": np.arange(total.shape[1]), "n": total[0], "s": total[1], "ss": total[2]})
    spread = F.sum("ss") / F.sum("n") - F.pow(F.sum("s") / F.sum("n"), 2)
    got = (rows.select("q").mapInArrow(moments, "axis long, n double, s double, ss double").groupBy("axis")
           .agg(spread.alias("v")).orderBy(F.desc("v"), "axis").limit(k).collect())
    return [r["axis"] for r in got]


def slab_bounds(coords: DataFrame, n: int) -> tuple[list, dict]:
    """Bounds of slabs of about equal count on the first coordinate, and inside
    each on the second.  Packing only: results do not depend on them."""
    slabs = max(1, min(MAX_SLABS, math.ceil((n / BLOCK_ROWS) ** (1 / 3))))
    if slabs == 1:
        return [], {}
    cuts = [i / slabs for i in range(1, slabs)]
    first = coords.agg(F.percentile_approx("c1", cuts, 1000)).first()[0]
    by_slab = coords.withColumn("s1", _slab_of(first)("c1")).groupBy("s1").agg(F.percentile_approx("c2", cuts, 1000).alias("b"))
    return first, {r["s1"]: r["b"] for r in by_slab.collect()}


def _slab_of(first: list):
    @F.pandas_udf("int")
    def slab(c1: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(first, c1, side="right").astype(np.int32))
    return slab


def _inner_slab_of(second: dict):
    @F.pandas_udf("int")
    def slab(s1: pd.Series, c2: pd.Series) -> pd.Series:
        out = np.zeros(len(s1), dtype=np.int32)
        for v in s1.unique():
            own = (s1 == v).to_numpy()
            out[own] = np.searchsorted(second.get(v, []), c2[own], side="right")
        return pd.Series(out)
    return slab


def packed(tiled: DataFrame, size: int, name: str, k_positive: int = 0) -> DataFrame:
    """Runs of up to ``size`` rows of (dim, label, s1, s2, c3, vec_id, q) in
    tiled order, equal rows once; one row per run, written.  ``k_positive``:
    also each row's ``own_kth``."""
    order = ["dim", "label", "s1", "s2", "c3", "vec_id", "q"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        state = {"dim": None, "n": 0, "last": None}

        def full():
            nonlocal number
            ids, labels = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            m = np.concatenate([h[2] for h in held])
            rows = tile(m, labels)
            ids, labels, m = ids[rows], labels[rows], np.ascontiguousarray(m[rows], dtype=np.int32)
            kth = own_kth(m, ids, labels, k_positive).tobytes() if k_positive else None
            row = {"run": number, "dim": m.shape[1], "label_lo": int(labels.min()), "label_hi": int(labels.max()), "n": len(ids),
                   "ids": ids.tobytes(), "labels": labels.tobytes(), "body": m.tobytes(),
                   "lo": m.min(axis=0).tolist(), "hi": m.max(axis=0).tolist(), "kth": kth}
            number += 1
            held.clear()
            state["n"] = 0
            return pa.RecordBatch.from_pylist([row], schema=_RUN_TYPES)
        for b in batches:
            dims, labels, ids = (b.column(i).to_numpy() for i in range(3))
            values, offsets = _lists(b.column(3))
            steps = np.flatnonzero(np.diff(dims)) + 1
            for s, e in zip([0, *steps.tolist()], [*steps.tolist(), len(dims)], strict=True):
                if s == e:
                    continue
                m = values[offsets[s]:offsets[e]].reshape(e - s, dims[s])
                if state["dim"] != dims[s] and held:
                    yield full()
                fresh = np.ones(e - s, dtype=bool)      # equal rows stand side by side
                fresh[1:] = (ids[s + 1:e] != ids[s:e - 1]) | (labels[s + 1:e] != labels[s:e - 1]) | (m[1:] != m[:-1]).any(axis=1)
                if state["last"] is not None and state["dim"] == dims[s]:
                    i, v, x = state["last"]
                    fresh[0] = not (ids[s] == i and labels[s] == v and (m[0] == x).all())
                state["dim"], state["last"] = dims[s], (ids[e - 1], labels[e - 1], m[-1].copy())
                ids_s, labels_s, m = ids[s:e][fresh], labels[s:e][fresh], m[fresh]
                while len(ids_s):
                    room = size - state["n"]
                    held.append((ids_s[:room], labels_s[:room], m[:room]))
                    state["n"] += min(room, len(ids_s))
                    ids_s, labels_s, m = ids_s[room:], labels_s[room:], m[room:]
                    if state["n"] >= size:
                        yield full()
        if held:
            yield full()
    sorted_rows = tiled.repartitionByRange(*order[:-1]).sortWithinPartitions(*order)
    return written(sorted_rows.select("dim", "label", "vec_id", "q").mapInArrow(pack, RUN_SCHEMA), name)


_RUN_TYPES = pa.schema([("run", pa.int64()), ("dim", pa.int32()), ("label_lo", pa.int64()), ("label_hi", pa.int64()),
                        ("n", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("body", pa.binary()),
                        ("lo", pa.list_(pa.int32())), ("hi", pa.list_(pa.int32())), ("kth", pa.binary())])


# ---------------------------------------------------------------- search
class Wanted:
    """What a part's anchors look for: one list of windows (lowest, highest,
    kth so far) per anchor, of the same label or of others."""

    def __init__(self, part: Run, targets: dict | None, same: bool):
        self.same = same
        if same:
            self.windows = [[(LOW, -LOW, int(t))] for t in part.kth]
        else:
            self.windows = [[] for _ in range(part.n)]
            for a, rank, score in zip(targets["place"], targets["positive_rank"], targets["positive_score"], strict=True):
                self.windows[a].append((rank, *window(score)))

    def low(self) -> np.ndarray:
        """The least score that is of use to each anchor."""
        return np.array([min((max(w[-2] if not self.same else LOW, w[-1] if self.same else LOW) for w in ws), default=-LOW)
                         for ws in self.windows], dtype=np.int64)

    def high(self) -> np.ndarray:
        return np.array([max((-LOW if self.same else w[-1] for w in ws), default=LOW) for ws in self.windows], dtype=np.int64)


LOW_SHARE, HIGH_SHARE = 80, 100


def window(score: int) -> tuple[int, int]:
    """Scores s with 80 * score <= 100 * s <= 100 * score."""
    return -(-LOW_SHARE * score // HIGH_SHARE), score


def search_block(part: Run, block: Run, wanted: Wanted, k: int) -> list[tuple]:
    """(place, window, id, score): up to ``k`` best rows of the block for each
    anchor and window."""
    at, page, node = block.boxes()
    page_up, node_up = bounds(part.m, page[0], page[1])[1], bounds(part.m, node[0], node[1])[1]
    m, q = exact(block.m, int(np.abs(part.m).max(initial=0))), None
    q = part.m.astype(m.dtype)
    low, high = wanted.low(), wanted.high()
    out = []

    def possible(lo_label, hi_label, own):
        return (lo_label <= own <= hi_label) if wanted.same else not (lo_label == own == hi_label)
    for a in range(part.n):
        windows = wanted.windows[a]
        if not windows or low[a] > high[a]:
            continue
        own, own_id, cut, top = part.labels[a], part.ids[a], low[a], high[a]
        found: list[list[tuple]] = [[] for _ in windows]
        floors = [w[-1] if wanted.same else w[-2] for w in windows]
        queue = [(-int(node_up[a, i]), 0, i) for i in range(node_up.shape[1])
                 if node_up[a, i] >= cut and possible(node[2][i], node[3][i], own)]
        heapq.heapify(queue)
        while queue:
            up, kind, i = heapq.heappop(queue)
            if -up < cut:
                break                                   # every other box is strictly below the kth score
            if kind == 0:
                for p in range(i * NODE_PAGES, min((i + 1) * NODE_PAGES, len(at))):
                    if page_up[a, p] >= cut and possible(page[2][p], page[3][p], own):
                        heapq.heappush(queue, (-int(page_up[a, p]), 1, p))
                continue
            rows = slice(at[i], min(at[i] + PAGE_ROWS, block.n))
            s = (m[rows] @ q[a]).astype(np.int64)
            labels = block.labels[rows]
            use = np.flatnonzero((s >= cut) & (s <= top) & ((labels == own) if wanted.same else (labels != own)))
            if not len(use):
                continue
            ids, s = block.ids[rows][use], s[use]
            for w, (win, floor) in enumerate(zip(windows, floors, strict=True)):
                fit = s >= floor
                if not wanted.same:
                    fit &= s <= win[-1]
                else:
                    fit &= ids != own_id
                if fit.any():
                    best = heapq.nsmallest(k, [*found[w], *zip((-s[fit]).tolist(), ids[fit].tolist(), strict=True)])
                    found[w] = best
                    if len(best) == k:
                        floors[w] = max(floor, -best[-1][0])
            cut = min(floors)
        out += [(a, 0 if wanted.same else win[0], i, -s) for win, best in zip(windows, found, strict=True) for s, i in best]
    return out


PART_COLS = ["run", "dim", "n", "ids", "labels", "body", "kth"]
FOUND_SCHEMA = "part long, place int, positive_rank int, found_id long, score long"


def _wanted(row: dict, part: Run) -> Wanted:
    return Wanted(part, row["targets"], row["targets"] is None)


def _parts_with(parts: DataFrame, targets: DataFrame | None) -> DataFrame:
    """Parts, with their anchors' positives as three lists where there are any."""
    kind = "struct<place:array<int>,positive_rank:array<int>,positive_score:array<long>>"
    if targets is None:
        return parts.select(*PART_COLS, F.lit(None).cast(kind).alias("targets"))
    names = ["place", "positive_rank", "positive_score"]
    grouped = targets.groupBy("part").agg(F.collect_list(F.struct(*names)).alias("t")).select(
        F.col("part").alias("of"), F.struct(*[F.col(f"t.{c}").alias(c) for c in names]).cast(kind).alias("targets"))
    return parts.select(*PART_COLS).join(grouped, F.col("run") == F.col("of")).drop("of")


def routed(parts: DataFrame, blocks: DataFrame) -> DataFrame:
    """(part, block): blocks whose box an anchor of the part must look into.
    Boxes are dealt in chunks; a part meets each chunk once."""
    n_runs = blocks.count()
    chunks = max(1, math.ceil(n_runs / BOX_CHUNK))
    boxes = (blocks.select((F.abs(F.xxhash64("run")) % chunks).alias("chunk"),
                           F.struct("run", "dim", "label_lo", "label_hi", "lo", "hi").alias("box"))
             .groupBy("chunk").agg(F.collect_list("box").alias("boxes")))
    met = (parts.withColumn("in_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
           .join(boxes, F.col("in_chunk") == F.col("chunk")))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                part = Run(row)
                wanted = _wanted(row, part)
                low, high = wanted.low(), wanted.high()
                boxes = [x for x in row["boxes"] if x["dim"] == part.dim]
                if not boxes:
                    continue
                lo, hi = (np.array([x[c] for x in boxes], dtype=np.int32).reshape(len(boxes), part.dim) for c in ("lo", "hi"))
                least, most = bounds(part.m, lo, hi)
                first, last = (np.array([x[c] for x in boxes], dtype=np.int64) for c in ("label_lo", "label_hi"))
                own = part.labels[:, None]
                fits = (first <= own) & (own <= last) if wanted.same else ~((first == own) & (own == last))
                meets = fits & (most >= low[:, None]) & (least <= high[:, None]) & (low <= high)[:, None]
                keep = [x["run"] for x, y in zip(boxes, meets.any(axis=0), strict=True) if y]
                yield pa.RecordBatch.from_pydict({"part": pa.array([row["run"]] * len(keep), pa.int64()),
                                                  "block": pa.array(keep, pa.int64())})
    return met.select(*PART_COLS, "targets", "boxes").mapInArrow(route, "part long, block long")


def searched(parts: DataFrame, blocks: DataFrame, k: int, targets: DataFrame | None = None) -> DataFrame:
    """(part, place, positive_rank, found_id, score, rank): the first ``k`` rows
    for each anchor and window over all blocks."""
    full = written(_parts_with(parts, targets), "anchor_parts")
    pairs = written(routed(full, blocks), "anchor_routes")
    tasks = (pairs.join(full, F.col("part") == F.col("run")).drop("run")
             .join(blocks.select(F.col("run").alias("b_run"), F.col("dim").alias("b_dim"), F.col("n").alias("b_n"),
                                 F.col("ids").alias("b_ids"), F.col("labels").alias("b_labels"), F.col("body").alias("b_body")),
                   F.col("block") == F.col("b_run")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                part = Run(row)
                block = Run({c: row[f"b_{c}"] for c in ("dim", "n", "ids", "labels", "body")})
                out = search_block(part, block, _wanted(row, part), k)
                place, rank, ids, score = (np.array(x, dtype=np.int64) for x in zip(*out, strict=True)) if out else ([],) * 4
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([row["part"]] * len(out), pa.int64()), "place": pa.array(place, pa.int32()),
                    "positive_rank": pa.array(rank, pa.int32()), "found_id": pa.array(ids, pa.int64()), "score": pa.array(score, pa.int64())})
    found = tasks.mapInArrow(run, FOUND_SCHEMA)
    order = Window.partitionBy("part", "place", "positive_rank").orderBy(F.desc("score"), "found_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchors: str, k_positive: int = 5, k_negative: int = 5) -> DataFrame:
    """Hard negatives of the rows of (vec_id, label, vec array of integers) for
    which the SQL condition ``anchors`` holds."""
    rows = usable(vectors)
    axes = [*main_axes(rows), 0, 0, 0][:3]
    coord = [F.coalesce(F.get("q", F.lit(a)), F.lit(0)).alias(f"c{i}") for i, a in enumerate(axes, 1)]
    rows = written(rows.select("*", *coord), "vectors")
    first, second = slab_bounds(rows.select("c1", "c2"), rows.count())
    tiled = rows.withColumn("s1", _slab_of(first)("c1")).withColumn("s2", _inner_slab_of(second)("s1", "c2"))
    blocks = packed(tiled, BLOCK_ROWS, "blocks")
    parts = packed(tiled.where(anchors), PART_ANCHORS, "parts", k_positive)
    positives = written(searched(parts, blocks, k_positive).select(
        "part", "place", F.col("rank").alias("positive_rank"), F.col("found_id").alias("positive_id"),
        F.col("score").alias("positive_score")), "positives")
    negatives = searched(parts, blocks, k_negative, positives)
    own = parts.select(F.col("run").alias("part"), F.posexplode(_ids_of()("ids")).alias("place", "anchor_id"))
    key = ["part", "place", "positive_rank"]
    return (positives.join(negatives, key).join(own, key[:2]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score")))


def _ids_of():
    @F.pandas_udf("array<long>")
    def ids(packed_ids: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(x, np.int64) for x in packed_ids], dtype=object)
    return ids


def quantised(embeddings: DataFrame, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, label, vec) with components floor(256 * x); null where a
    component is null, not finite or too large."""
    x = F.transform(F.col(f"`{vec_col}`").cast("array<double>"), lambda v: F.when(
        ~F.isnan(v) & (F.abs(v) < LIMIT / 256), F.floor(v * 256)).cast("long"))
    return embeddings.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), x.alias("vec"))


SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS k
  FROM s WHERE same) x WHERE k <= 5),
n AS (SELECT p.anchor_id, p.other_id AS positive_id, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id) AS k
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE k <= 5"""


@register("op11_hard_negatives", SQL)
def q_hard_negatives(spark, sf_dir):
    rows = quantised(table(spark, sf_dir, "embeddings"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), "vec_id % 100 = 0")
