"""Portfolio, KPI, buckets and scalar scores over an uploaded table (§2.8, §2.4).

The driver's ``customer`` table stands in for the uploaded CSV.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.scalar import sdiv
from riskloom.operators import portfolio as PF
from riskloom.operators.aggregates import mean_of
from riskloom.operators.scores import statement_ratio
from riskloom.plans import sqlgen
from riskloom.plans.common import register, round_doubles, sql_round, with_views
from riskloom.sources import panel as P
from riskloom.sources.tables import table

DIGITS = 6
KEEP = ["c_name", "c_mktsegment"]


def portfolio(spark: SparkSession, d: str) -> DataFrame:
    return PF.build_portfolio(table(spark, d, "customer"))


# ------------------------------------------------------------------ SQL twin
def _clip(x: str, lo, hi) -> str:
    return f"(CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x}, {lo!r}), {hi!r}) END)"


_ROWSUM = "coalesce(CAST(c_custkey AS DOUBLE), 0.0) + coalesce(CAST(c_nationkey AS DOUBLE), 0.0) + coalesce(CAST(c_acctbal AS DOUBLE), 0.0)"
PORTFOLIO_SQL = f"""
WITH base AS (SELECT *, {_ROWSUM} AS __rowsum FROM customer),
st AS (SELECT {sqlgen.mean_of('__rowsum')} AS __mu, sqrt({sqlgen.var_of('__rowsum')}) AS __sd FROM base),
z AS (SELECT base.*, CASE WHEN __sd IS NULL OR __sd = 0 THEN coalesce(__rowsum, 0.0)
                          ELSE (__rowsum - __mu) / (__sd + 1e-9) END AS __z FROM base, st),
p AS (SELECT * EXCLUDE (__rowsum, __z), {_clip('1.0 / (1.0 + exp(-__z))', 0.0, 1.0)} AS y_pred_proba FROM z),
s AS (SELECT *, {_clip('(1.0 - y_pred_proba) * 550 + 300', 300.0, 850.0)} AS credit_score FROM p),
i AS (SELECT *, abs((coalesce(CAST(c_custkey AS DOUBLE), 0.0) + coalesce(CAST(c_nationkey AS DOUBLE), 0.0)
                     + coalesce(CAST(c_acctbal AS DOUBLE), 0.0) + coalesce(y_pred_proba, 0.0)
                     + coalesce(credit_score, 0.0)) * 10) AS income FROM s)
SELECT *, {_clip('1.0 - (credit_score - 300) / 550', 0.0, 1.0)} AS credit_utilization,
  CASE WHEN y_pred_proba IS NULL THEN 'Unknown' WHEN y_pred_proba >= 0.66 THEN 'High Risk'
       WHEN y_pred_proba >= 0.33 THEN 'Medium Risk' ELSE 'Low Risk' END AS risk_category
FROM i"""


def psql(body: str, keep=KEEP) -> str:
    from riskloom.plans.common import with_cte
    return sql_round(with_cte(f"portfolio AS ({PORTFOLIO_SQL})", body), keep=keep, digits=DIGITS)


# ------------------------------------------------------------------ registry
@register("portfolio_from_upload", psql("SELECT * FROM portfolio"))
def q_portfolio(spark, d):
    return round_doubles(portfolio(spark, d), DIGITS)


@register("zscore_or_raw", sql_round(f"""
WITH base AS (SELECT c_custkey, {_ROWSUM} AS __rowsum FROM customer),
st AS (SELECT {sqlgen.mean_of('__rowsum')} AS __mu, sqrt({sqlgen.var_of('__rowsum')}) AS __sd FROM base)
SELECT c_custkey, CASE WHEN __sd IS NULL OR __sd = 0 THEN coalesce(__rowsum, 0.0)
                       ELSE (__rowsum - __mu) / (__sd + 1e-9) END AS z FROM base, st""", digits=DIGITS))
def q_zscore(spark, d):
    c = table(spark, d, "customer")
    b = c.select("c_custkey", PF.row_sum(["c_custkey", "c_nationkey", "c_acctbal"]).alias("__rowsum"))
    return round_doubles(PF.zscore_or_raw(b, "__rowsum", "z").select("c_custkey", "z"), DIGITS)


@register("logistic_squash", psql("SELECT c_custkey, y_pred_proba FROM portfolio"))
def q_logistic(spark, d):
    return round_doubles(portfolio(spark, d).select("c_custkey", "y_pred_proba"), DIGITS)


@register("risk_bucket", psql("SELECT c_custkey, risk_category FROM portfolio"))
def q_risk_bucket(spark, d):
    return portfolio(spark, d).select("c_custkey", "risk_category")


@register("threshold_predict", psql(
    "SELECT c_custkey, y_pred_proba, CAST(y_pred_proba > 0.542 AS INTEGER) AS y_pred FROM portfolio"))
def q_threshold(spark, d):
    p = portfolio(spark, d)
    return round_doubles(p.select("c_custkey", "y_pred_proba",
                                  (F.col("y_pred_proba") > F.lit(PF.PRED_THRESHOLD)).cast("int").alias("y_pred")), DIGITS)


_SCORE_SRC_SQL = f"""SELECT c_custkey, o.score FROM customer LEFT JOIN (
   SELECT o_custkey, {sqlgen.mean_of('o_totalprice')} / 1000.0 AS score FROM orders GROUP BY o_custkey) o ON c_custkey = o.o_custkey"""


@register("score_from_probability", sql_round(f"""
WITH src AS ({_SCORE_SRC_SQL}), med AS (SELECT quantile_cont(score, 0.5) AS m FROM src)
SELECT c_custkey, {_clip('coalesce(score, m)', 300.0, 850.0)} AS credit_score FROM src, med""", digits=DIGITS))
def q_score_from_prob(spark, d):
    """Upload that carries a 'score' column with gaps: gaps → median, clip 300..850."""
    c = table(spark, d, "customer").select("c_custkey")
    o = table(spark, d, "orders").groupBy("o_custkey").agg((mean_of(F.col("o_totalprice")) / 1000.0).alias("score"))
    src = c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", "score")
    p = PF.build_portfolio(src)
    return round_doubles(p.select("c_custkey", "credit_score"), DIGITS)


@register("kpi_row", psql(f"""SELECT {sqlgen.mean_of('credit_score')} AS avg_credit_score,
  avg(CAST(risk_category = 'High Risk' AS DOUBLE)) * 100 AS high_risk_pct,
  {sqlgen.mean_of('income')} AS avg_income, {sqlgen.mean_of('credit_utilization')} AS avg_utilization
  FROM portfolio"""))
def q_kpi(spark, d):
    return round_doubles(PF.kpi_row(portfolio(spark, d)), DIGITS)


@register("value_counts", psql("""SELECT risk_category, count(*) AS n,
  count(*) * 100.0 / sum(count(*)) OVER () AS pct FROM portfolio GROUP BY risk_category"""))
def q_value_counts(spark, d):
    from pyspark.sql import Window
    vc = portfolio(spark, d).groupBy("risk_category").agg(F.count(F.lit(1)).alias("n"))
    # window over the per-category table (bounded by the number of categories)
    return round_doubles(vc.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy())), DIGITS)


SPINE = ["Low Risk", "Medium Risk", "High Risk", "Unknown"]


@register("category_spine_join", psql(f"""SELECT s.risk_category, coalesce(c.n, 0) AS n FROM
  (SELECT * FROM (VALUES {', '.join(f"('{v}')" for v in SPINE)}) t(risk_category)) s
  LEFT JOIN (SELECT risk_category, count(*) AS n FROM portfolio GROUP BY risk_category) c USING (risk_category)"""))
def q_spine(spark, d):
    spine = spark.createDataFrame([(v,) for v in SPINE], "risk_category string")
    counts = portfolio(spark, d).groupBy("risk_category").agg(F.count(F.lit(1)).alias("n"))
    return (F.broadcast(spine).join(counts, "risk_category", "left")
            .select("risk_category", F.coalesce("n", F.lit(0)).alias("n")))


@register("histogram", psql("""
WITH r AS (SELECT min(credit_score) AS lo, max(credit_score) AS hi FROM portfolio),
b AS (SELECT risk_category, CAST(CASE WHEN hi = lo THEN 1 ELSE least(floor((credit_score - lo) / (hi - lo) * 30) + 1, 30) END AS INTEGER) AS bucket, lo, hi
      FROM portfolio, r WHERE credit_score IS NOT NULL)
SELECT risk_category, bucket, count(*) AS n, first(lo + (bucket - 1) * ((hi - lo) / 30.0)) AS bin_lo,
       first(lo + bucket * ((hi - lo) / 30.0)) AS bin_hi FROM b GROUP BY risk_category, bucket"""))
def q_histogram(spark, d):
    return round_doubles(PF.histogram(portfolio(spark, d), "credit_score", 30, "risk_category"), DIGITS)


CORR_COLS = ["c_custkey", "c_nationkey", "c_acctbal", "credit_score", "income", "credit_utilization"]


def _corr_pairs():
    return [(a, b) for a in CORR_COLS for b in CORR_COLS]


@register("correlation_matrix", psql(" UNION ALL ".join(
    f"""SELECT '{a}' AS feature, '{b}' AS feature_b,
        {_clip(f"CASE WHEN stddev_samp(CASE WHEN {b} IS NOT NULL THEN {a} END) * stddev_samp(CASE WHEN {a} IS NOT NULL THEN {b} END) <> 0 THEN covar_samp({a}, {b}) / (stddev_samp(CASE WHEN {b} IS NOT NULL THEN {a} END) * stddev_samp(CASE WHEN {a} IS NOT NULL THEN {b} END)) END", -1.0, 1.0)} AS corr
        FROM portfolio""" for a, b in _corr_pairs()), keep=KEEP + ["feature_b"]))
def q_corr_matrix(spark, d):
    from riskloom.operators.stats import correlation_matrix
    return round_doubles(correlation_matrix(portfolio(spark, d), CORR_COLS), DIGITS)


# ----------------------------------------------------------- bucket rules
@register("risk_level_score", psql("""SELECT c_custkey, (credit_score - 300) / 5.5 AS rt_score,
  CASE WHEN (credit_score - 300) / 5.5 >= 80 THEN 'low' WHEN (credit_score - 300) / 5.5 >= 60 THEN 'medium'
       WHEN (credit_score - 300) / 5.5 >= 40 THEN 'high' ELSE 'very_high' END AS level FROM portfolio"""))
def q_risk_level(spark, d):
    from riskloom.operators.rules import risk_level
    p = portfolio(spark, d).select("c_custkey", ((F.col("credit_score") - 300) / 5.5).alias("rt_score"))
    return round_doubles(p.withColumn("level", risk_level("rt_score")), DIGITS)


@register("cut_bins", psql("""SELECT c_custkey, CASE WHEN credit_score > 0 AND credit_score <= 550 THEN 'High'
  WHEN credit_score > 550 AND credit_score <= 700 THEN 'Medium' WHEN credit_score > 700 AND credit_score <= 850 THEN 'Low'
  END AS category FROM portfolio"""))
def q_cut_bins(spark, d):
    from riskloom.operators.rules import cut_bins
    return portfolio(spark, d).select("c_custkey", cut_bins("credit_score").alias("category"))


@register("risk_band_config", psql("""SELECT c_custkey, CASE WHEN y_pred_proba > 0.8 THEN 'high' WHEN y_pred_proba < 0.2 THEN 'low'
  ELSE 'medium' END AS level, CAST(y_pred_proba > 0.5 AS INTEGER) AS y_pred FROM portfolio"""))
def q_risk_band(spark, d):
    from riskloom.operators.rules import risk_band
    p = portfolio(spark, d)
    return p.select("c_custkey", risk_band("y_pred_proba").alias("level"),
                    (F.col("y_pred_proba") > 0.5).cast("int").alias("y_pred"))


@register("market_cap_bucket", psql("""SELECT c_custkey, c_acctbal * 1e8 AS market_cap,
  CASE WHEN c_acctbal * 1e8 > 200000000000 THEN 'mega_cap' WHEN c_acctbal * 1e8 > 10000000000 THEN 'large_cap'
       WHEN c_acctbal * 1e8 > 2000000000 THEN 'mid_cap' ELSE 'small_cap' END AS category FROM portfolio"""))
def q_mcap(spark, d):
    from riskloom.operators.rules import market_cap_bucket
    p = portfolio(spark, d).select("c_custkey", (F.col("c_acctbal") * 1e8).alias("market_cap"))
    return round_doubles(p.withColumn("category", market_cap_bucket("market_cap")), DIGITS)


ENSEMBLE = [("y_pred_proba", 0.4), ("credit_utilization", 0.3), ("__inv", 0.3)]


def _ens_sql():
    from riskloom.operators.rules import ensemble_blend_sql
    return psql(f"SELECT c_custkey, {ensemble_blend_sql(ENSEMBLE)} AS blended FROM "
                f"(SELECT *, 1.0 - credit_utilization AS __inv FROM portfolio) e")


@register("ensemble_blend", _ens_sql())
def q_ensemble(spark, d):
    from riskloom.operators.rules import ensemble_blend
    p = portfolio(spark, d).withColumn("__inv", F.lit(1.0) - F.col("credit_utilization"))
    return round_doubles(p.select("c_custkey", ensemble_blend(ENSEMBLE).alias("blended")), DIGITS)


@register("age_years", with_views(sql_round(
    "SELECT SK_ID_BUREAU, -DAYS_CREDIT / 365.0 AS age_years FROM bureau", digits=DIGITS), "bureau"))
def q_age(spark, d):
    from riskloom.sources.tables import bureau
    return round_doubles(bureau(spark, d).select("SK_ID_BUREAU", (-F.col("DAYS_CREDIT") / F.lit(365.0)).alias("age_years")), DIGITS)


@register("safe_divide", with_views(sql_round("""SELECT SK_ID_CURR,
  CASE WHEN NATION_KEY <> 0 THEN AMT_BALANCE / NATION_KEY END AS balance_per_nation_key FROM application""",
    digits=DIGITS), "application"))
def q_safe_divide(spark, d):
    from riskloom.sources.tables import application
    return round_doubles(application(spark, d).select("SK_ID_CURR", sdiv("AMT_BALANCE", "NATION_KEY")
                                                      .alias("balance_per_nation_key")), DIGITS)


def _st(n, dd):
    return f"CASE WHEN {n} <> 0 AND {dd} <> 0 THEN {n} / {dd} END"


@register("statement_ratios", P.with_panel_views(sql_round(f"""SELECT ticker, date,
  {_st('total_debt', 'shareholders_equity')} AS debt_to_equity, {_st('current_assets', 'current_liabilities')} AS current_ratio,
  {_st('net_income', 'total_assets')} AS roa, {_st('net_income', 'shareholders_equity')} AS roe,
  {_st('total_debt', 'total_assets')} AS debt_ratio, {_st('revenue', 'total_assets')} AS asset_turnover
  FROM fundamentals""", digits=DIGITS), "fundamentals"))
def q_statement_ratios(spark, d):
    f = P.fundamentals(spark, d)
    return round_doubles(f.select(
        "ticker", "date", statement_ratio("total_debt", "shareholders_equity").alias("debt_to_equity"),
        statement_ratio("current_assets", "current_liabilities").alias("current_ratio"),
        statement_ratio("net_income", "total_assets").alias("roa"),
        statement_ratio("net_income", "shareholders_equity").alias("roe"),
        statement_ratio("total_debt", "total_assets").alias("debt_ratio"),
        statement_ratio("revenue", "total_assets").alias("asset_turnover")), DIGITS)
