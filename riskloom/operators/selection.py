"""Feature selection bookkeeping over per-feature score tables.

Score tables have one row per (selector or fold, feature): bounded by the
feature count, so ranking them without a data-sized partition is safe.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stack_scores(scores: Mapping[str, DataFrame], model_col: str = "model") -> DataFrame:
    out = None
    for name, df in scores.items():
        s = df.select(F.lit(name).alias(model_col), "feature", F.col("score").cast("double").alias("score"))
        out = s if out is None else out.unionByName(s)
    return out


def with_model_rank(long: DataFrame, model_col: str = "model") -> DataFrame:
    w = Window.partitionBy(model_col).orderBy(F.col("score").desc_nulls_last(), F.col("feature"))
    return long.withColumn("rank", F.row_number().over(w))


def vote_table(scores: Mapping[str, DataFrame], k: int) -> DataFrame:
    """One boolean column per selector (feature in its top-k) and the Total."""
    r = with_model_rank(stack_scores(scores))
    names = list(scores)
    p = r.groupBy("feature").pivot("model", names).agg(F.max((F.col("rank") <= k).cast("int")))
    total = F.lit(0)
    for n in names:
        total = total + F.coalesce(F.col(n), F.lit(0))
    return p.select("feature", *[F.coalesce(F.col(n), F.lit(0)).cast("boolean").alias(n) for n in names],
                    total.alias("total"))


def mean_rank_by_feature(scores: Mapping[str, DataFrame]) -> DataFrame:
    r = with_model_rank(stack_scores(scores))
    return r.groupBy("feature").agg(F.avg("score").alias("mean_importance"), F.avg("rank").alias("mean_rank"))


def rank_features(mean_table: DataFrame) -> DataFrame:
    """0-based position by mean importance, descending (ties by name)."""
    w = Window.orderBy(F.col("mean_importance").desc(), F.col("feature"))
    return mean_table.withColumn("position", F.row_number().over(w) - 1)


def top_features(mean_table: DataFrame, k: int) -> DataFrame:
    return mean_table.orderBy(F.col("mean_importance").desc(), F.col("feature")).limit(k)
