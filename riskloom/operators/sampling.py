"""Deterministic sampling, splits and folds.

A seeded hash of the row key replaces the reference's random draws, so every
split is reproducible and needs no global shuffle: ``md5(key || seed)`` gives
a uniform order; its first four hex digits give a bucket 0..65535.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.ranks import value_counts_ranked

HEX = "0123456789abcdef"


def seeded_hash(key, seed: int) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(k.cast("string"), F.lit(f"|{seed}")))


def hash_bucket(key, seed: int) -> Column:
    """0..65535 from the first four hex digits of the seeded md5."""
    h = seeded_hash(key, seed)
    v = F.lit(0)
    for i in range(4):
        v = v * 16 + (F.instr(F.lit(HEX), F.substring(h, i + 1, 1)) - 1)
    return v


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in seeded-hash order (distributed top-k, TakeOrderedAndProject)."""
    return df.withColumn("__h", seeded_hash(key, seed)).orderBy("__h").limit(n).drop("__h")


def train_test_split(df: DataFrame, key: str, train_pct: int = 75, seed: int = 42) -> DataFrame:
    return df.withColumn("is_train", (F.pmod(hash_bucket(key, seed), F.lit(100)) < train_pct))


def kfold(df: DataFrame, key: str, k: int, seed: int = 1001) -> DataFrame:
    return df.withColumn("fold", F.pmod(hash_bucket(key, seed), F.lit(k)).cast("int"))


def stratified_kfold(df: DataFrame, key: str, label: str, k: int, seed: int = 1001) -> DataFrame:
    """``fold`` 0..k-1 so that every class is spread evenly: a row's rank in the
    seeded-hash order of its class, modulo ``k``.  Ranks come from distributed
    prefix counts, so no class is sorted inside one task; rows that share a key
    share their fold."""
    h = df.withColumn("__h", seeded_hash(key, seed))
    r = value_counts_ranked(h, "__h", group=label).select(
        F.col(label).alias("__label"), F.col("__h").alias("__rank_h"), F.pmod(F.col("n_before"), F.lit(k)).cast("int").alias("fold"))
    return h.join(r, (F.col("__h") == F.col("__rank_h")) & F.col(label).eqNullSafe(F.col("__label"))).drop("__h", "__rank_h", "__label")


def undersample_majority(df: DataFrame, key: str, label: str, seed: int = 42) -> DataFrame:
    """Every class cut to the minority count: the rows with the smallest seeded
    hashes per class.  Per-class ranks come from distributed prefix counts, so
    the majority class is never sorted inside one task."""
    h = df.withColumn("__h", seeded_hash(key, seed))
    r = value_counts_ranked(h, "__h", group=label)
    counts = r.groupBy(label).agg(F.sum("n").alias("__cnt"))
    n_min = counts.agg(F.min("__cnt").alias("__nmin"))
    keep = r.crossJoin(F.broadcast(n_min)).where(F.col("n_upto") <= F.col("__nmin")).select(label, "__h")
    return h.join(keep, [label, "__h"], "left_semi").drop("__h")


def time_series_tiles(df: DataFrame, date_col: str, n_splits: int = 5) -> DataFrame:
    """Tile 0..n_splits of each row by exact date quantiles (k/(n+1)); split k
    trains on tiles < k and tests on tile k."""
    from riskloom.operators.ranks import exact_quantiles
    day = F.datediff(F.to_date(date_col), F.lit("1970-01-01").cast("date")).cast("double")
    d = df.withColumn("__day", day)
    probs = [k / (n_splits + 1) for k in range(1, n_splits + 1)]
    cuts = exact_quantiles(d, "__day", probs, prefix="__cut")
    j = d.crossJoin(F.broadcast(cuts))  # one row
    tile = F.lit(0)
    for i in range(n_splits):
        tile = tile + (F.col("__day") >= F.col(f"__cut{i}")).cast("int")
    return j.withColumn("tile", tile).drop("__day", *[f"__cut{i}" for i in range(n_splits)])
