"""Schema and record validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def validate_required(frames: Mapping[str, DataFrame], required: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row per (source, required column): ``present``, and of how many rows
    it is filled in.  Missing columns are reported, not raised; each source is
    read once."""
    out = None
    for src, cols in required.items():
        df = frames[src]
        have = set(df.columns)
        row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"f_{c}") for c in cols if c in have])
        part = row.select("n", F.explode(F.array(*[F.struct(
            F.lit(src).alias("source"), F.lit(c).alias("column_name"), F.lit(c in have).alias("present"),
            (F.col(f"f_{c}") if c in have else F.lit(0).cast("bigint")).alias("n_filled")) for c in cols])).alias("s"))
        part = part.select("s.source", "s.column_name", "s.present", F.col("n").alias("n_rows"), "s.n_filled")
        out = part if out is None else out.unionByName(part)
    return out


def validate_financials(c=F.col) -> Column:
    """All rules must hold; a rule whose inputs are missing counts as true.

    revenue >= 0; total_assets > 0; current_assets <= 1.1 x total_assets (only
    when both are non-zero); total_assets - equity >= 0 when assets, equity
    and current liabilities are present; at least one key metric present.
    """
    ta, ca, eq = c("total_assets"), c("current_assets"), c("shareholders_equity")
    rules = [
        F.coalesce(c("revenue") >= 0, F.lit(True)),
        F.coalesce(ta > 0, F.lit(True)),
        F.when((F.coalesce(ca, F.lit(0.0)) != 0) & (F.coalesce(ta, F.lit(0.0)) != 0), ca <= ta * 1.1).otherwise(F.lit(True)),
        F.when(ta.isNotNull() & eq.isNotNull() & c("current_liabilities").isNotNull(), (ta - eq) >= 0).otherwise(F.lit(True)),
        c("revenue").isNotNull() | ta.isNotNull() | eq.isNotNull() | c("net_income").isNotNull(),
    ]
    out = rules[0]
    for r in rules[1:]:
        out = out & r
    return out
