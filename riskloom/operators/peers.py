"""Peer groups: selection, group statistics, ranks.

Ranks inside a peer group come from the distributed prefix counts of
``operators.ranks`` (per group), so a group holding a third of all rows is
not sorted inside one task.  Peer selection never forms all pairs of a
group: each group contributes its first ``k + 1`` members and every company
is matched against that bounded list only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.aggregates import mean_of, var_of
from riskloom.operators.ranks import value_counts_ranked


def peer_group_stats(df: DataFrame, group: str, score: str) -> DataFrame:
    """mean, upper median (element n//2 of the ascending list), population std, count."""
    r = value_counts_ranked(df, score, group=group)
    tot = r.groupBy(group).agg(F.sum("n").alias("__N"))
    j = r.join(tot, group)
    k = F.floor(F.col("__N") / 2)
    med = j.where((F.col("n_before") <= k) & (k < F.col("n_upto"))).select(group, F.col(score).alias("upper_median"))
    base = df.groupBy(group).agg(mean_of(F.col(score)).alias("mean"),
                                 F.sqrt(var_of(F.col(score), ddof=0)).alias("std_pop"),
                                 F.count(F.col(score)).alias("peer_count"))
    return base.join(med, group, "left")


def peer_rank(df: DataFrame, key: str, group: str, score: str) -> DataFrame:
    """percentile = (lowest 1-based ascending position of the score) / n x 100;
    rank = 1 + number of peers with a strictly higher score (ties rank first)."""
    r = value_counts_ranked(df, score, group=group)
    tot = r.groupBy(group).agg(F.sum("n").alias("total"))
    pos = r.join(tot, group).select(group, score, "total",
                                    ((F.col("n_before") + 1) / F.col("total") * 100.0).alias("percentile_rank"),
                                    (F.col("total") - F.col("n_upto") + 1).alias("rank"))
    return df.select(key, group, score).join(pos, [group, score], "inner")


def select_peers(df: DataFrame, key: str, group_cols: list[str], k: int = 10) -> DataFrame:
    """Up to ``k`` peers per company: the first k+1 members of its group by
    key, excluding itself, first k of those."""
    w = Window.partitionBy(*group_cols).orderBy(key)
    head = (df.select(*group_cols, F.col(key).alias("peer"), F.row_number().over(w).alias("__pos"))
              .where(F.col("__pos") <= k + 1))
    cand = df.select(key, *group_cols).join(head, group_cols).where(F.col("peer") != F.col(key))
    w2 = Window.partitionBy(key).orderBy("__pos")
    return (cand.withColumn("peer_rank", F.row_number().over(w2)).where(F.col("peer_rank") <= k)
                .select(key, *group_cols, "peer", "peer_rank"))


def relative_strength_text(score, sector_avg, percentile):
    d = F.col(score) - F.col(sector_avg)
    p = F.col(percentile)
    f1 = F.format_string("%.1f", F.round(d * 10) / 10)
    fa = F.format_string("%.1f", F.round(F.abs(d) * 10) / 10)
    return (F.when(p >= 75, F.concat(F.lit("Strong performer - significantly above sector average by "), f1, F.lit(" points")))
             .when(p >= 50, F.concat(F.lit("Above average performer - "), f1, F.lit(" points above sector average")))
             .when(p >= 25, F.concat(F.lit("Below average performer - "), fa, F.lit(" points below sector average")))
             .otherwise(F.concat(F.lit("Weak performer - significantly below sector average by "), fa, F.lit(" points"))))


def peer_risk_text(percentile, sector_std):
    s = F.col(sector_std)
    vol = F.when(s > 10, "high").when(s > 5, "moderate").otherwise("low")
    p = F.col(percentile)
    return (F.when(p < 25, F.concat(F.lit("Higher risk relative to peers in "), vol, F.lit(" volatility sector")))
             .when(p > 75, F.concat(F.lit("Lower risk relative to peers in "), vol, F.lit(" volatility sector")))
             .otherwise(F.concat(F.lit("Average risk profile relative to peers in "), vol, F.lit(" volatility sector"))))
