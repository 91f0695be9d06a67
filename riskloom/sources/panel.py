"""Company-panel role views derived from the driver's ``events`` table.

FIXTURES.md §4: ticker = user_id, close = value, volume = props.k, date =
to_date(ts).  Quarterly filings are stood in for by a PERIOD_DAYS grid of
per-ticker sums; news rows are the incident-type events ('error', 'signup').
Sums and means are exact decimal accumulations (see operators.aggregates),
so the views are bit-identical whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.aggregates import mean_of, sum_of
from riskloom.sources.tables import table

# Fixed values of the stand-in mapping.
PERIOD_DAYS = 2
NEWS_TYPES = ("error", "signup")
ASSET_TYPES = ("view", "click")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("double")


def _sent() -> Column:
    return (_k() - F.lit(50.0)) / F.lit(50.0)


def ticks(spark: SparkSession, d: str) -> DataFrame:
    """Event-level rows: the 30/90/200-row windows run at this grain."""
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("ticker"), "ts", "event_id",
                    F.to_date("ts").alias("date"), F.col("value").alias("close"),
                    _k().alias("volume"), _sent().alias("sentiment_score"))


def prices_daily(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return (e.groupBy(F.col("user_id").alias("ticker"), F.to_date("ts").alias("date"))
             .agg(mean_of(F.col("value")).alias("close"), mean_of(_k()).alias("volume")))


def news_daily(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where(F.col("event_type").isin(*NEWS_TYPES))
    t = F.col("event_type")
    return (e.groupBy(F.col("user_id").alias("ticker"), F.to_date("ts").alias("date"))
             .agg(mean_of(_sent()).alias("sentiment_score"),
                  F.count(F.lit(1)).cast("int").alias("news_volume"),
                  mean_of(F.when(t == "error", _k() / F.lit(100.0))).alias("regulatory_risk_score"),
                  mean_of(F.when(t == "signup", _sent())).alias("management_sentiment")))


def fundamentals(spark: SparkSession, d: str, period_days: int = PERIOD_DAYS) -> DataFrame:
    e = table(spark, d, "events")
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date"))
    end = F.date_add(F.lit("1970-01-01").cast("date"),
                     (F.floor(day / F.lit(period_days)) * period_days + (period_days - 1)).cast("int"))
    t = F.col("event_type")
    v = F.col("value")

    def s(cond):
        return F.coalesce(sum_of(F.when(cond, v)), F.lit(0.0))

    g = (e.groupBy(F.col("user_id").alias("ticker"), end.alias("date"))
          .agg(s(t == "purchase").alias("revenue"), s(t == "error").alias("total_debt"),
               sum_of(v).alias("total_assets"), s(t.isin(*ASSET_TYPES)).alias("current_assets"),
               s(t == "signup").alias("current_liabilities")))
    return g.select("ticker", "date", "revenue", "total_debt",
                    (F.col("total_assets") - F.lit(2.0) * F.col("total_debt")).alias("shareholders_equity"),
                    "total_assets", "current_assets", "current_liabilities",
                    (F.col("revenue") - F.col("total_debt")).alias("net_income"),
                    (F.col("revenue") - F.col("current_liabilities")).alias("cash_flow_operations"))


def target_daily(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where(F.col("event_type") == "purchase")
    return (e.groupBy(F.col("user_id").alias("ticker"), F.to_date("ts").alias("date"))
             .agg(mean_of(F.col("value")).alias("target")))


def sectors(spark: SparkSession, d: str) -> DataFrame:
    """ticker → sector (region name) through customer → nation → region."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    r = table(spark, d, "region").select("r_regionkey", "r_name")
    # nation / region are fixed-size dimensions (25 / 5 rows): broadcast.
    return (c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
             .join(F.broadcast(r), F.col("n_regionkey") == r.r_regionkey)
             .select(F.col("c_custkey").alias("ticker"), F.col("r_name").alias("sector")))


# ------------------------------------------------------------------ DuckDB twins
_K = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"
_SENT = f"(({_K} - 50.0) / 50.0)"


def _xsum(x: str) -> str:
    from riskloom.plans.sqlgen import sum_of
    return sum_of(x)


def _xmean(x: str) -> str:
    return f"({_xsum(x)} / nullif(count({x}), 0))"


SQL = {
    "ticks": f"""SELECT user_id AS ticker, ts, event_id, CAST(ts AS DATE) AS date, value AS close,
                 {_K} AS volume, {_SENT} AS sentiment_score FROM events""",
    "prices_daily": f"""SELECT user_id AS ticker, CAST(ts AS DATE) AS date, {_xmean('value')} AS close,
                 {_xmean(_K)} AS volume FROM events GROUP BY 1, 2""",
    "news_daily": f"""SELECT user_id AS ticker, CAST(ts AS DATE) AS date, {_xmean(_SENT)} AS sentiment_score,
                 CAST(count(*) AS INTEGER) AS news_volume,
                 {_xmean(f"CASE WHEN event_type = 'error' THEN {_K} / 100.0 END")} AS regulatory_risk_score,
                 {_xmean(f"CASE WHEN event_type = 'signup' THEN {_SENT} END")} AS management_sentiment
                 FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1, 2""",
    "fundamentals": f"""SELECT ticker, date, revenue, total_debt, total_assets - 2.0 * total_debt AS shareholders_equity,
                 total_assets, current_assets, current_liabilities, revenue - total_debt AS net_income,
                 revenue - current_liabilities AS cash_flow_operations FROM (
                 SELECT user_id AS ticker,
                   DATE '1970-01-01' + CAST(floor(datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) / {PERIOD_DAYS}) * {PERIOD_DAYS} + {PERIOD_DAYS - 1} AS INTEGER) AS date,
                   coalesce({_xsum("CASE WHEN event_type = 'purchase' THEN value END")}, 0.0) AS revenue,
                   coalesce({_xsum("CASE WHEN event_type = 'error' THEN value END")}, 0.0) AS total_debt,
                   {_xsum('value')} AS total_assets,
                   coalesce({_xsum("CASE WHEN event_type IN ('view', 'click') THEN value END")}, 0.0) AS current_assets,
                   coalesce({_xsum("CASE WHEN event_type = 'signup' THEN value END")}, 0.0) AS current_liabilities
                 FROM events GROUP BY 1, 2) g""",
    "target_daily": f"""SELECT user_id AS ticker, CAST(ts AS DATE) AS date, {_xmean('value')} AS target
                 FROM events WHERE event_type = 'purchase' GROUP BY 1, 2""",
    "sectors": """SELECT c_custkey AS ticker, r_name AS sector FROM customer
                 JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
}


def with_panel_views(body: str, *names: str) -> str:
    from riskloom.plans.common import with_cte
    ctes = ",\n".join(f"{n} AS ({SQL[n]})" for n in names)
    return with_cte(ctes, body)
