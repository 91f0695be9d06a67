"""Exact global ranks without a global window.

A window without ``partitionBy`` moves every row to one task.  Exact
quantiles, ECDF values, AUC and KS need global ranks, so they are computed
in two phases:

1. aggregate to one row per distinct value (map-side partial aggregation),
2. ``repartitionByRange`` on the value, write the result to the shared
   checkpoint folder (partition ids become stable and survive executor
   loss), running sums within each partition, plus the offset of each
   partition taken from a table with one row per (partition, group); AQE
   broadcasts that table at run time when it is small and shuffles it
   otherwise.

Every phase is a distributed DataFrame job; nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import cut_lineage


def value_counts_ranked(df: DataFrame, value: str, counts: dict[str, Column] | None = None,
                        partitions: int | None = None, group: str | None = None) -> DataFrame:
    """One row per distinct non-NULL ``value`` (per ``group``) with cumulative counts.

    ``counts`` maps output names to per-row 0/1 (or weight) expressions summed
    per value (default: ``n`` = rows).  For each count ``c`` the result has
    ``c`` (at this value), ``c_before`` (strictly smaller values of the same
    group) and ``c_upto`` (<= value).
    """
    counts = counts or {"n": F.lit(1)}
    names = list(counts)
    keys = ([group] if group else []) + [value]
    agg = (df.where(F.col(value).isNotNull())
             .groupBy(*keys).agg(*[F.sum(e).cast("bigint").alias(k) for k, e in counts.items()]))
    n_parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (agg.repartitionByRange(n_parts, *keys)
                 .withColumn("__pid", F.spark_partition_id()))
    ranged = cut_lineage(ranged)
    gk = [group] if group else []
    wpart = Window.partitionBy("__pid", *gk).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    within = ranged.select(*keys, "__pid", *names,
                           *[F.sum(k).over(wpart).alias(f"__in_{k}") for k in names])
    # one row per (range partition, group): bounded by partitions x groups
    parts = ranged.groupBy("__pid", *gk).agg(F.min(value).alias("__pmin"),
                                            *[F.sum(k).alias(f"__tot_{k}") for k in names])
    wp = Window.partitionBy(*gk).orderBy("__pmin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("__pid", *gk, *[F.coalesce(F.sum(f"__tot_{k}").over(wp), F.lit(0)).alias(f"__off_{k}")
                                           for k in names])
    # partitions x groups rows: AQE broadcasts it when small, else shuffles
    j = within.join(offsets, ["__pid", *gk])
    out = [F.col(k) for k in keys]
    for k in names:
        upto = F.col(f"__in_{k}") + F.col(f"__off_{k}")
        out += [F.col(k), (upto - F.col(k)).alias(f"{k}_before"), upto.alias(f"{k}_upto")]
    return j.select(*out)


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], prefix: str = "q",
                    group: str | None = None) -> DataFrame:
    """Linear-interpolated quantiles (pandas / DuckDB ``quantile_cont``).

    One row (per ``group``).  Position p·(n-1); result lo + (hi - lo)·frac,
    lo/hi the values at the floor/ceil positions (0-based ranks).  Output
    columns ``{prefix}{i}``, or ``prefix`` itself for a single probability.
    """
    r = value_counts_ranked(df, value, group=group)
    gk = [group] if group else []
    total = r.groupBy(*gk).agg(F.sum("n").alias("__N"))
    # per group: sized by AQE at run time; overall: one row
    j = r.join(total, gk) if gk else r.crossJoin(F.broadcast(total))
    cols = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("__N") - 1)
        lo_k, hi_k = F.floor(pos), F.ceil(pos)
        hit_lo = (F.col("n_before") <= lo_k) & (lo_k < F.col("n_upto"))
        hit_hi = (F.col("n_before") <= hi_k) & (hi_k < F.col("n_upto"))
        cols += [F.max(F.when(hit_lo, F.col(value))).alias(f"__lo{i}"),
                 F.max(F.when(hit_hi, F.col(value))).alias(f"__hi{i}"),
                 F.max(pos - lo_k).alias(f"__fr{i}")]
    a = j.groupBy(*gk).agg(*cols)
    name = (lambda i: prefix) if len(probs) == 1 else (lambda i: f"{prefix}{i}")
    return a.select(*gk, *[(F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * F.col(f"__fr{i}"))
                           .alias(name(i)) for i in range(len(probs))])


def exact_median(df: DataFrame, value: str, name: str = "median", group: str | None = None) -> DataFrame:
    return exact_quantiles(df, value, [0.5], prefix=name, group=group)
