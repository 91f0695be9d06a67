"""Per-feature trend statistics over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLOPE_BAND = 0.01


def feature_trend_stats(df: DataFrame, key: str, order: str, features: Sequence[str]) -> DataFrame:
    """Per (key, feature): OLS slope against the position in time, sample std,
    last - first, last, mean, direction (±0.01); at least two values."""
    long = df.select(key, order, F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("s")
    ).select(key, order, "s.*").where(F.col("v").isNotNull())
    w = Window.partitionBy(key, "feature").orderBy(order)
    r = long.withColumn("idx", (F.row_number().over(w) - 1).cast("double"))
    g = (r.groupBy(key, "feature")
          .agg(F.regr_slope("v", "idx").alias("slope"), F.stddev_samp("v").alias("volatility"),
               (F.max_by("v", "idx") - F.min_by("v", "idx")).alias("recent_change"),
               F.max_by("v", "idx").alias("current_value"), F.avg("v").alias("average_value"),
               F.count(F.lit(1)).alias("n"))
          .where(F.col("n") >= 2))
    return g.withColumn("direction", F.when(F.col("slope") > SLOPE_BAND, "increasing")
                        .when(F.col("slope") < -SLOPE_BAND, "decreasing").otherwise("stable"))
