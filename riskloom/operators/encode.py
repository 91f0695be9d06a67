"""Categorical encodings: factorize; one-hot lives in aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def factorize(df: DataFrame, col: str, order_key: str, out: str = "code") -> DataFrame:
    """Codes by order of first appearance (smallest ``order_key``), NULL → -1.

    One row per distinct value carries its first ``order_key``; its code is
    the number of values that appear earlier -- an exact distributed rank
    (``value_counts_ranked``), so no window collects the value table into
    one task however many distinct values there are.  The code table joins
    back on the value; AQE broadcasts it when it is small.
    """
    from riskloom.operators.ranks import value_counts_ranked
    first = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.min(order_key).alias("__first"))
    ranked = value_counts_ranked(first, "__first")
    codes = (first.join(ranked.select("__first", F.col("n_before").cast("int").alias(out)), "__first")
                  .drop("__first"))
    return df.join(codes, col, "left").withColumn(out, F.coalesce(F.col(out), F.lit(-1)))
