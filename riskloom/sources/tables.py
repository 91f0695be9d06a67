"""Readers for the driver tables and the role views the operators consume.

Each view is a projection (plus, where a foreign key must be resolved, an
equi-join) over the raw parquet tables, so column pruning and filter
pushdown reach the scan.  The role mapping follows FIXTURES.md §4.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Reference date for "DAYS_*" style relative days, and the
# instalment due offset (order date + 30 days).
REF_DATE = "2001-12-31"
DUE_OFFSET_DAYS = 30

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def days_from_ref(c: Column) -> Column:
    return F.datediff(F.to_date(c), F.lit(REF_DATE).cast("date")).cast("int")


# ---------------------------------------------------------------- part A roles
def application(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select(
        F.col("c_custkey").alias("SK_ID_CURR"),
        (F.col("c_acctbal") < 0).cast("int").alias("TARGET"),
        F.col("c_mktsegment").alias("NAME_CONTRACT_TYPE"),
        F.col("c_nationkey").alias("NATION_KEY"),
        F.col("c_acctbal").alias("AMT_BALANCE"),
    )


def bureau(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_custkey").alias("SK_ID_CURR"),
        F.col("o_orderkey").alias("SK_ID_BUREAU"),
        F.col("o_orderstatus").alias("CREDIT_ACTIVE"),
        F.col("o_orderpriority").alias("CREDIT_PRIORITY"),
        F.col("o_totalprice").alias("AMT_CREDIT_SUM"),
        days_from_ref(F.col("o_orderdate")).alias("DAYS_CREDIT"),
    )


def bureau_balance(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("SK_ID_BUREAU"),
        (-F.col("l_linenumber")).alias("MONTHS_BALANCE"),
        F.col("l_returnflag").alias("STATUS"),
        F.col("l_linestatus").alias("LINE_STATUS"),
    )


def _lines_with_client(spark: SparkSession, d: str, cols: list[Column]) -> DataFrame:
    """lineitem joined to its order's client key (FK resolution, equi-join)."""
    li = table(spark, d, "lineitem")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    return j.select(F.col("o_custkey").alias("SK_ID_CURR"), *cols)


def previous_application(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    li = table(spark, d, "lineitem")
    # pre-aggregate lines per order before joining (one row per order)
    net = (li.groupBy("l_orderkey")
             .agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("AMT_CREDIT")))
    return (o.join(net, o.o_orderkey == net.l_orderkey, "left")
             .select(F.col("o_custkey").alias("SK_ID_CURR"),
                     F.col("o_orderkey").alias("SK_ID_PREV"),
                     F.col("o_orderstatus").alias("NAME_CONTRACT_STATUS"),
                     F.col("o_orderpriority").alias("NAME_PRODUCT_TYPE"),
                     F.col("o_totalprice").alias("AMT_APPLICATION"),
                     F.col("AMT_CREDIT"),
                     days_from_ref(F.col("o_orderdate")).alias("DAYS_DECISION")))


def _instalment_cols() -> list[Column]:
    return [
        F.col("l_linenumber").cast("double").alias("NUM_INSTALMENT_VERSION"),
        F.col("l_extendedprice").alias("AMT_INSTALMENT"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("AMT_PAYMENT"),
        days_from_ref(F.date_add(F.to_date("o_orderdate"), DUE_OFFSET_DAYS)).cast("double").alias("DAYS_INSTALMENT"),
        days_from_ref(F.col("l_shipdate")).cast("double").alias("DAYS_ENTRY_PAYMENT"),
        F.col("l_returnflag").alias("PAYMENT_FLAG"),
    ]


def _pos_cols() -> list[Column]:
    return [
        (-F.col("l_linenumber")).alias("MONTHS_BALANCE"),
        F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")).cast("int").alias("SK_DPD"),
        F.col("l_quantity").cast("int").alias("SK_DPD_DEF"),
        F.col("l_linestatus").alias("NAME_CONTRACT_STATUS"),
    ]


def _card_cols() -> list[Column]:
    return [
        F.col("l_quantity").alias("AMT_QUANTITY"),
        F.col("l_extendedprice").alias("AMT_BALANCE"),
        (F.col("l_discount") + F.lit(0.0)).alias("RATE_DISCOUNT"),
        (F.col("l_tax") + F.lit(0.0)).alias("RATE_TAX"),
    ]


def instalments(spark: SparkSession, d: str) -> DataFrame:
    return _lines_with_client(spark, d, _instalment_cols())


def pos_cash(spark: SparkSession, d: str) -> DataFrame:
    return _lines_with_client(spark, d, _pos_cols())


def credit_card(spark: SparkSession, d: str) -> DataFrame:
    return _lines_with_client(spark, d, [F.col("l_orderkey").alias("SK_ID_PREV"), *_card_cols()])


def line_roles(spark: SparkSession, d: str) -> DataFrame:
    """The columns of the POS, instalment and card roles in one row per line:
    they are views of the same join."""
    return _lines_with_client(spark, d, [*_pos_cols(), *_instalment_cols(), *_card_cols()])


def order_lines(spark: SparkSession, d: str) -> DataFrame:
    """bureau_balance with the net amount of each line."""
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("SK_ID_BUREAU"), (-F.col("l_linenumber")).alias("MONTHS_BALANCE"),
        F.col("l_returnflag").alias("STATUS"), F.col("l_linestatus").alias("LINE_STATUS"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("NET"))


# ---------------------------------------------------------------- part B roles
def price_ticks(spark: SparkSession, d: str) -> DataFrame:
    """Event-level price rows: ticker = user, close = value, volume = props.k."""
    e = table(spark, d, "events")
    return e.select(
        F.col("user_id").alias("ticker"),
        F.col("event_id"),
        F.col("ts"),
        F.to_date("ts").alias("date"),
        F.col("value").alias("close"),
        F.get_json_object("props", "$.k").cast("double").alias("volume"),
    )


def prices_daily(spark: SparkSession, d: str) -> DataFrame:
    """One row per (ticker, date): daily means (several events per day)."""
    t = price_ticks(spark, d)
    return (t.groupBy("ticker", "date")
             .agg(F.avg("close").alias("close"), F.avg("volume").alias("volume"),
                  F.count(F.lit(1)).alias("n_events")))


def spread(df: DataFrame) -> DataFrame:
    """Spread an input over all cores before per-row CPU-heavy work (keyword
    scans over whole texts).  Only an input with fewer splits than the
    cluster has cores (a small single-row-group file) is repartitioned; a
    large input already has at least that many splits and passes unshuffled."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
