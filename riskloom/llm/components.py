"""Connected components of a link table, as alternating stars.

Each round moves links towards the smallest id: first every node hands its
larger neighbours to its smallest one, then every node links its neighbours
and itself to the smallest.  Rounds are logarithmic in a component's width; a
round costs grouped minima and joins on node ids (Spark splits a skewed hub),
and is written to the checkpoint folder, so nothing grows with the number of
rounds and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import checkpointed


PART_ROWS = 100_000    # links of a partition between steps, about


def _few(df: DataFrame, parts: int) -> DataFrame:
    """Link tables shrink fast, and a step is many shuffles: as few partitions
    as their rows need, so that a small table does not leave thousands of
    nearly empty shuffle files behind."""
    return df.coalesce(parts)


def _lower(links: DataFrame, parts: int) -> DataFrame:
    """Every node's links to smaller nodes, all moved to the smallest."""
    least = _few(links.groupBy("a").agg(F.min("b").alias("low")), parts)
    moved = links.join(least, "a").where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return _few(_few(moved, parts).union(least.select("a", F.col("low").alias("b"))).distinct(), parts)


def _upper(links: DataFrame, parts: int) -> DataFrame:
    """Every node's larger neighbours linked to its smallest neighbour (or to
    itself where it has none)."""
    both = links.union(links.select("b", "a"))
    least = _few(both.groupBy("a").agg(F.min("b").alias("low")), parts)
    moved = links.select(F.col("b").alias("a"), F.col("a").alias("b")).join(least, "a").select(
        F.col("b").alias("a"), F.least("a", "low").alias("b"))
    return _few(moved, parts)


def _settled(links: DataFrame, parts: int) -> bool:
    """Whether all links are stars: no node links twice, or links and is linked
    to."""
    roles = links.select(F.col("a").alias("id"), F.lit(1).alias("out")).union(links.select("b", F.lit(0)))
    node = _few(roles.groupBy("id").agg(F.sum("out").alias("n_out"), F.min("out").alias("least")), parts)
    return node.where((F.col("n_out") > 1) | ((F.col("n_out") > 0) & (F.col("least") == 0))).isEmpty()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links`` (a, b: long, null-free) as (id, component): every linked node
    and the smallest node that links reach."""
    now = checkpointed(links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        parts = max(1, -(-now.count() // PART_ROWS))
        now = _few(now, parts)
        if _settled(now, parts):
            break
        now = checkpointed(_lower(_upper(now, parts), parts))
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        now.select("b", "b").distinct())
