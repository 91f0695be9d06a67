"""Cleaning that rewrites the table: decide once, then read less.

Phase 1 profiles a table in one job and records a decision per column: drop it
(with the rule that asked for it) or keep it in the narrowest type that holds
its values.  The record has one row per column, so its size is that of the
schema; it can be saved and used on later tables of the same layout.

Phase 2 applies the record as one projection, so dropped columns never reach
the scan's ``ReadSchema``.  A later table may hold values that the recorded
type cannot: such a cast either fails the job with the column's name or gives
NULL, and ``overflow_counts`` counts them; no value is ever wrapped around.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators import profiling as PR

# Rule → (flag of ``profiling.decisions``, value of the flag that drops).
RULES = {
    "single_value": ("single_value", True),
    "non_var": ("non_var", True),
    "sparse": ("keep_sparse_rule", False),
    "missing": ("drop_missing_rule", True),
}
FLOATS = ("float", "double")


@dataclass(frozen=True)
class Decision:
    """What becomes of one column: dropped by ``rule``, or kept as ``to``."""
    column: str
    dtype: str
    rule: str | None
    to: str


def decide(df: DataFrame, rules: Sequence[str] = ("single_value", "sparse"), downcast: bool = True,
           protect: Sequence[str] = ()) -> list[Decision]:
    """Phase 1.  Columns in ``protect`` are never dropped; of several rules that
    ask for a column the first named is recorded.  A table without rows keeps
    every column as it is: nothing is known about it."""
    unknown = [r for r in rules if r not in RULES]
    if unknown:
        raise ValueError(f"unknown rules {unknown}; there are {sorted(RULES)}")
    prof = PR.profile(df, distinct="single_value" in rules)
    target = PR.downcast_plan(prof).select("column_name", "target_dtype")
    found = {r["column_name"]: r for r in prof.join(PR.decisions(prof), "column_name").join(target, "column_name").select(
        "column_name", "dtype", "n_rows", "non_null", "target_dtype", *{flag for flag, _ in RULES.values()}).collect()}
    out = []
    for c in df.columns:
        r = found[c]
        rule = None
        if r["n_rows"] and c not in protect:
            rule = next((x for x in rules if r[RULES[x][0]] is RULES[x][1]), None)
        # nothing is known about the range of an all-null column
        to = r["target_dtype"] if downcast and r["non_null"] and r["target_dtype"] else r["dtype"]
        out.append(Decision(c, r["dtype"], rule, to))
    return out


def _lost(c: Column, d: Decision) -> Column:
    """Whether the recorded type cannot hold a value."""
    if d.to == d.dtype:
        return F.lit(False)
    if d.to in FLOATS:
        return F.coalesce((F.abs(c) < F.lit(float("inf"))) & (F.abs(c.cast(d.to)) == F.lit(float("inf"))), F.lit(False))
    return c.isNotNull() & c.try_cast(d.to).isNull()


def kept(decisions: Sequence[Decision]) -> list[Decision]:
    return [d for d in decisions if d.rule is None]


def clean(df: DataFrame, decisions: Sequence[Decision], overflow: str = "error") -> DataFrame:
    """Phase 2: the kept columns in their recorded types.  Columns of ``df``
    without a decision stay as they are; a missing one is an error."""
    if overflow not in ("error", "null"):
        raise ValueError("overflow is 'error' or 'null'")
    known = {d.column: d for d in decisions}
    absent = [d.column for d in kept(decisions) if d.column not in df.columns]
    if absent:
        raise ValueError(f"columns {absent} have a decision but are not in the table")
    out = []
    for name in df.columns:
        c, d = F.col(f"`{name}`"), known.get(name)
        if d is None:
            out.append(c)
        elif d.rule is None and d.to == d.dtype:
            out.append(c.cast(d.to).alias(name))
        elif d.rule is None:
            value = c.cast(d.to) if d.to in FLOATS else c.try_cast(d.to)
            bad = F.raise_error(F.lit(f"{name} holds a value beyond {d.to}")) if overflow == "error" else F.lit(None)
            out.append(F.when(_lost(c, d), bad.cast(d.to)).otherwise(value).alias(name))
    return df.select(*out)


def overflow_counts(df: DataFrame, decisions: Sequence[Decision]) -> DataFrame:
    """(column_name, target_dtype, n_lost) of the columns that are narrowed."""
    narrowed = [d for d in kept(decisions) if d.to != d.dtype]
    if not narrowed:
        return df.sparkSession.createDataFrame([], "column_name string, target_dtype string, n_lost bigint")
    row = df.agg(*[F.count_if(_lost(F.col(f"`{d.column}`"), d)).alias(f"n{i}") for i, d in enumerate(narrowed)])
    return row.select(F.explode(F.array(*[F.struct(
        F.lit(d.column).alias("column_name"), F.lit(d.to).alias("target_dtype"), F.col(f"n{i}").alias("n_lost"))
        for i, d in enumerate(narrowed)])).alias("s")).select("s.*")


def to_text(decisions: Sequence[Decision]) -> str:
    """The record as JSON, to be kept beside the table."""
    return json.dumps([asdict(d) for d in decisions])


def from_text(text: str) -> list[Decision]:
    return [Decision(**d) for d in json.loads(text)]


def as_table(spark, decisions: Sequence[Decision]) -> DataFrame:
    """The record as rows, one per column."""
    return spark.createDataFrame([(d.column, d.dtype, d.rule, d.to) for d in decisions],
                                 "column_name string, dtype string, rule string, target_dtype string")
