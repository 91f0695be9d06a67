"""History tables laid out by (key, date) (SURVEY §6: date partitions and
(ticker, date) indexes).

A history is partitioned by week, month or year of its date and bucketed by
its key.  Filters on the date prune folders, also those that only a join
decides at run time; windows, aggregates and joins by the key read the buckets
as they lie, without a shuffle.

Joins on (key, date) of two histories need no shuffle either, as both are
spread by the key alone.  Spark allows that where
``spark.sql.requireAllClusterKeysForCoPartition`` is off, so histories are read
in a session of their own (``history_session``) that shares tables and the
context with the caller's.

A key's rows lie in one bucket.  While writing, a hot key is spread over one
task per period.  While reading, the rows of the largest key are counted
(a grouped count of the key column, without a shuffle): beyond a block the
tables are read file by file, not bucket by bucket, so that the operators'
own shuffles cut the key into blocks.

Rows with a null key or date are kept: null keys are in one bucket, null dates
in Spark's default folder.  An empty table has no folders and reads as empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import joins as J
from riskloom.operators import windows as W
from riskloom.session import BASE_CONF, scratch_table_path

PERIODS = ("week", "month", "year")
PERIOD_COL = "period"


def history_session(spark: SparkSession, bucketed: bool = True) -> SparkSession:
    """A session that co-partitions by a part of the join keys; or one that
    reads bucketed tables as plain files."""
    own = spark.newSession()
    for k in (*BASE_CONF, "spark.sql.shuffle.partitions", "spark.sql.ansi.enabled"):
        value = spark.conf.get(k, None)
        if value is not None and own.conf.isModifiable(k):
            own.conf.set(k, value)
    if bucketed:
        own.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    else:
        own.conf.set("spark.sql.sources.bucketing.enabled", "false")
    return own


def period_of(date, period: str):
    if period not in PERIODS:
        raise ValueError(f"period is one of {PERIODS}")
    return F.to_date(F.date_trunc(period, date))


def write_history(df: DataFrame, name: str, key: str = "ticker", date: str = "date", period: str = "month",
                  buckets: int | None = None, path: str | None = None) -> str:
    """Writes ``df`` and returns the name of its table; histories that are to be
    joined take the same number of buckets."""
    if PERIOD_COL in df.columns:
        raise ValueError(f"the rows have a column {PERIOD_COL}")
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = path or scratch_table_path(spark, name)
    full = f"{name}_{path.rsplit('-', 1)[-1].rsplit('/', 1)[-1]}"
    laid = df.withColumn(PERIOD_COL, period_of(F.col(date), period))
    # one file per period and bucket; a hot key has a task per period
    laid = laid.repartition(buckets, PERIOD_COL, F.pmod(F.hash(key), F.lit(buckets)))
    (laid.write.format("parquet").partitionBy(PERIOD_COL).bucketBy(buckets, key).sortBy(key, date)
         .option("path", path).saveAsTable(full))
    return full


def _rows(spark: SparkSession, table: str, since: str | None, until: str | None, date: str, period: str) -> DataFrame:
    df = spark.table(table)
    for day, low in ((since, True), (until, False)):
        if day is not None:
            d, folder = F.lit(day).cast("date"), period_of(F.lit(day).cast("date"), period)
            df = df.where((F.col(date) >= d) & (F.col(PERIOD_COL) >= folder) if low
                          else (F.col(date) <= d) & (F.col(PERIOD_COL) <= folder))
    return df


def largest_key(df: DataFrame, key: str) -> int:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def read_histories(spark: SparkSession, tables: Sequence[str], since: str | None = None, until: str | None = None,
                   key: str = "ticker", date: str = "date", period: str = "month",
                   block_rows: int = W.BLOCK_ROWS) -> list[DataFrame]:
    """Rows of each table from ``since`` to ``until`` (days, both included);
    only the folders of their periods are read.  All come from one session and
    can be joined: by buckets where every key fits a block, else by files."""
    own = history_session(spark)
    found = [_rows(own, t, since, until, date, period) for t in tables]
    if max((largest_key(df, key) for df in found), default=0) > block_rows:
        own = history_session(spark, bucketed=False)
        found = [_rows(own, t, since, until, date, period) for t in tables]
    return found


def asof_nearest(left: DataFrame, right: DataFrame, key: str, on: str, tolerance_days: int, right_cols: Sequence[str],
                 block_rows: int = W.BLOCK_ROWS) -> DataFrame:
    """``joins.asof_nearest_join`` between two histories, without a shuffle:
    right rows are gathered per (key, stretch of ``tolerance_days``), at most
    that many days each, and a left row picks from its own stretch and the two
    beside it.  Where a key is larger than a block (``read_histories`` then reads
    by files), the shuffled form spreads it over its stretches instead."""
    if max(largest_key(left, key), largest_key(right, key)) > block_rows:
        return J.asof_nearest_join(left, right, key, on, tolerance_days, right_cols)
    day, cols = F.datediff(F.col(on), F.lit("1970-01-01").cast("date")), list(right_cols)
    near = right.where(F.col(on).isNotNull()).select(
        F.col(key).alias("r_key"), F.floor(day / tolerance_days).alias("at"),
        F.struct(day.alias("r_day"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(cols)]).alias("r"))
    near = near.select("r_key", F.explode(F.array(F.col("at") - 1, F.col("at"), F.col("at") + 1)).alias("r_at"), "r")
    near = near.groupBy("r_key", "r_at").agg(F.collect_list("r").alias("near"))
    own = left.select(F.struct(*[F.col(c) for c in left.columns]).alias("l"), F.col(key).alias("l_key"), day.alias("l_day"),
                      F.floor(day / tolerance_days).alias("l_at"))
    both = own.hint("merge").join(near.hint("merge"), (F.col("l_key") == F.col("r_key")) & (F.col("l_at") == F.col("r_at")), "left")
    # nearest first; of two as near, the earlier
    pick = F.array_min(F.transform(F.filter("near", lambda r: F.abs(r["r_day"] - F.col("l_day")) <= tolerance_days), lambda r: F.struct(
        F.abs(r["r_day"] - F.col("l_day")).alias("far"), r.alias("r"))))["r"]
    both = both.withColumn("pick", pick)
    return both.select(*[F.col(f"l.{c}").alias(c) for c in left.columns], *[F.col(f"pick.c{i}").alias(c) for i, c in enumerate(cols)])
