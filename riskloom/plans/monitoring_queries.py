"""Data-quality, model and system monitoring computed from tables (§2.13, §2.10, §2.11).

Sources = event types of the driver's events table, ``now`` = the newest
event time (a parameter in production); predictions = the portfolio scores
against the application TARGET.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.operators import monitoring as MO
from riskloom.operators.aggregates import sum_of
from riskloom.operators.stats import ks_two_sample
from riskloom.plans import sqlgen
from riskloom.plans.common import register, round_doubles, sql_round, with_cte
from riskloom.plans.portfolio import PORTFOLIO_SQL, portfolio
from riskloom.sources.tables import table

DIGITS = 6
MICROS_NTZ = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"


def freshness(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", F.expr(MICROS_NTZ).alias("us"))
    return MO.data_freshness(e, "event_type", "us")


FRESH_SQL = """SELECT event_type AS source, (max(n.now_us) - max(epoch_us(ts))) / 1000000.0 AS age_seconds
  FROM events, (SELECT max(epoch_us(ts)) AS now_us FROM events) n GROUP BY event_type"""


@register("data_freshness", sql_round(FRESH_SQL, digits=DIGITS))
def q_freshness(spark, d):
    return round_doubles(freshness(spark, d), DIGITS)


def _missing_total(spark, d):
    from riskloom.operators import profiling as PR
    from riskloom.plans.profiling_queries import pf
    p = PR.profile(pf(spark, d))
    return p.agg((F.sum(F.col("n_rows") - F.col("non_null")) / F.sum("n_rows")).alias("missing_share"))


def _missing_sql() -> str:
    from riskloom.plans.profiling_queries import PROFILE_SQL
    return f"SELECT sum(n_rows - non_null) * 1.0 / sum(n_rows) AS missing_share FROM ({PROFILE_SQL}) p"


def _dq_sql() -> str:
    from riskloom.plans.common import SQL_VIEWS
    from riskloom.plans.profiling_queries import PF_SQL
    body = f"""WITH pf AS ({PF_SQL}), fr AS ({FRESH_SQL}), ms AS ({_missing_sql()}),
      s AS (SELECT sum(CASE WHEN age_seconds > 3600 THEN 1 ELSE 0 END) AS n_stale,
                   sum(CASE WHEN age_seconds > 86400 THEN 1 ELSE 0 END) AS n_failed FROM fr)
      SELECT n_stale, n_failed, missing_share,
        100 - 15 * n_stale - 25 * n_failed - CASE WHEN missing_share > 0.1 THEN 20 ELSE 0 END AS quality_score,
        CASE WHEN 100 - 15 * n_stale - 25 * n_failed - CASE WHEN missing_share > 0.1 THEN 20 ELSE 0 END >= 80 THEN 'healthy'
             WHEN 100 - 15 * n_stale - 25 * n_failed - CASE WHEN missing_share > 0.1 THEN 20 ELSE 0 END >= 60 THEN 'warning'
             ELSE 'critical' END AS status FROM s, ms"""
    views = ", ".join(f"{n} AS ({SQL_VIEWS[n]})" for n in ("application", "pos_cash"))
    return sql_round(with_cte(views, body), digits=DIGITS)


@register("data_quality_score", _dq_sql())
def q_dq(spark, d):
    return round_doubles(MO.data_quality_score(freshness(spark, d), _missing_total(spark, d)), DIGITS)


# ------------------------------------------------------------- predictions
def predictions(spark, d) -> DataFrame:
    p = portfolio(spark, d)
    return p.select("c_custkey", "c_nationkey", "c_mktsegment", "y_pred_proba",
                    (F.col("y_pred_proba") > 0.542).cast("int").alias("y_pred"),
                    (F.col("c_acctbal") < 0).cast("int").alias("y_true"))


PRED_SQL = f"""WITH portfolio AS ({PORTFOLIO_SQL})
  SELECT c_custkey, c_nationkey, c_mktsegment, y_pred_proba, CAST(y_pred_proba > 0.542 AS INTEGER) AS y_pred,
         CAST(c_acctbal < 0 AS INTEGER) AS y_true FROM portfolio"""


def psql(body: str, keep=()) -> str:
    return sql_round(with_cte(f"pred AS ({PRED_SQL})", body), keep=list(keep), digits=DIGITS)


@register("classification_metrics", psql("""SELECT count(*) AS n, avg(CAST(y_pred = y_true AS DOUBLE)) AS accuracy,
  CASE WHEN sum(y_pred) > 0 THEN sum(y_pred * y_true) * 1.0 / sum(y_pred) END AS precision,
  CASE WHEN sum(y_true) > 0 THEN sum(y_pred * y_true) * 1.0 / sum(y_true) END AS recall,
  CASE WHEN 2 * sum(y_pred * y_true) + sum(y_pred * (1 - y_true)) + sum((1 - y_pred) * y_true) > 0
       THEN 2.0 * sum(y_pred * y_true) / (2 * sum(y_pred * y_true) + sum(y_pred * (1 - y_true)) + sum((1 - y_pred) * y_true)) END AS f1,
  -avg(y_true * ln(least(greatest(y_pred_proba, 1e-15), 1 - 1e-15))
       + (1 - y_true) * ln(1 - least(greatest(y_pred_proba, 1e-15), 1 - 1e-15))) AS log_loss FROM pred"""))
def q_cls(spark, d):
    return round_doubles(MO.classification_metrics(predictions(spark, d), "y_true", "y_pred", "y_pred_proba"), DIGITS)


@register("ensemble_uncertainty", psql("""SELECT c_custkey, m AS mean_probability, m - 1.96 * sd AS lower, m + 1.96 * sd AS upper,
  greatest(0.0, 1.0 - 2 * 1.96 * sd) AS confidence FROM (
  SELECT c_custkey, m, sqrt(((p1 - m) * (p1 - m) + (p2 - m) * (p2 - m) + (p3 - m) * (p3 - m)) / 3.0) AS sd FROM (
    SELECT c_custkey, p1, p2, p3, (p1 + p2 + p3) / 3.0 AS m FROM (
      SELECT c_custkey, y_pred_proba AS p1, least(y_pred_proba * 1.2, 1.0) AS p2, y_pred_proba * 0.8 AS p3 FROM pred) a) b) c"""))
def q_ens_unc(spark, d):
    p = predictions(spark, d)
    members = [F.col("y_pred_proba"), F.least(F.col("y_pred_proba") * 1.2, F.lit(1.0)), F.col("y_pred_proba") * 0.8]
    return round_doubles(p.select("c_custkey", *MO.ensemble_uncertainty(members)), DIGITS)


# ------------------------------------------------------------- KS drift
def ks_frame(spark, d) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "ts", F.to_date("ts").alias("date"), "value",
                                        F.get_json_object("props", "$.k").cast("double").alias("volume"))
    last = e.agg(F.max("date").alias("__last"))
    j = e.crossJoin(F.broadcast(last))  # one row
    cur = j.where(F.col("date") == F.col("__last")).withColumn("sample", F.lit(1))
    ref = (j.where(F.col("date") < F.col("__last")).orderBy(F.col("ts").desc(), F.col("event_id").desc())
            .limit(100).withColumn("sample", F.lit(0)))   # reference window: the last 100 rows before
    u = cur.unionByName(ref)
    return u.select("sample", F.explode(F.array(
        F.struct(F.lit("value").alias("feature"), F.col("value").alias("v")),
        F.struct(F.lit("volume").alias("feature"), F.col("volume").alias("v")))).alias("s")).select("sample", "s.*")


KS_SQL = """WITH e AS (SELECT event_id, ts, CAST(ts AS DATE) AS date, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume FROM events),
  l AS (SELECT max(date) AS last_d FROM e),
  events_u AS (SELECT * FROM (SELECT e.*, 1 AS sample FROM e, l WHERE date = last_d)
     UNION ALL SELECT * FROM (SELECT e.*, 0 AS sample FROM e, l WHERE date < last_d ORDER BY ts DESC, event_id DESC LIMIT 100)),
  u AS (SELECT sample, 'value' AS feature, value AS v FROM events_u UNION ALL SELECT sample, 'volume', volume FROM events_u),
  c AS (SELECT feature, v, sum(CASE WHEN sample = 0 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN sample = 1 THEN 1 ELSE 0 END) AS b
        FROM u WHERE v IS NOT NULL GROUP BY feature, v),
  r AS (SELECT feature, v, sum(a) OVER (PARTITION BY feature ORDER BY v ROWS UNBOUNDED PRECEDING) AS au,
               sum(b) OVER (PARTITION BY feature ORDER BY v ROWS UNBOUNDED PRECEDING) AS bu,
               sum(a) OVER (PARTITION BY feature) AS na, sum(b) OVER (PARTITION BY feature) AS nb FROM c),
  k AS (SELECT feature, na AS n_a, nb AS n_b, max(abs(au / na - bu / nb)) AS ks_stat FROM r GROUP BY feature, na, nb),
  kl AS (SELECT *, sqrt(n_a * n_b / (n_a + n_b)) * ks_stat AS lam FROM k)
  SELECT feature, n_a, n_b, ks_stat, CASE WHEN lam <= 0 THEN 1.0 ELSE least(greatest((SELECT sum(2.0 * (CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END)
     * exp(-2.0 * j * j * lam * lam)) FROM range(1, 101) t(j)), 0.0), 1.0) END AS p_value FROM kl"""


@register("ks_drift", sql_round(f"""WITH ks AS ({KS_SQL})
  SELECT feature, n_a, n_b, ks_stat, p_value, avg(p_value) OVER () AS mean_p_value, avg(p_value) OVER () < 0.2 AS drift FROM ks""",
    keep=["drift"], digits=DIGITS))
def q_ks(spark, d):
    k = ks_two_sample(ks_frame(spark, d), "v", "sample", group="feature")
    # one row per feature: a window over it is bounded by the feature count
    w = Window.partitionBy()
    return round_doubles(k.select("feature", "n_a", "n_b", "ks_stat", "p_value",
                                  F.avg("p_value").over(w).alias("mean_p_value"),
                                  (F.avg("p_value").over(w) < 0.2).alias("drift")), DIGITS)


# ------------------------------------------------------------- performance alert
WIN = 50


@register("performance_alert", psql(f"""WITH r AS (SELECT c_nationkey, c_custkey, CAST(y_pred = y_true AS DOUBLE) AS correct,
    row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM pred),
  w AS (SELECT c_nationkey, (rn - 1) // {WIN} AS window_id, avg(correct) AS accuracy, count(*) AS n FROM r GROUP BY 1, 2)
  SELECT c_nationkey, window_id, accuracy, n, accuracy < 0.7 AS alert,
    sum(CAST(accuracy < 0.7 AS INTEGER)) OVER (PARTITION BY c_nationkey ORDER BY window_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 AS retrain
  FROM w""", keep=["alert", "retrain"]))
def q_perf(spark, d):
    return round_doubles(MO.performance_alert(predictions(spark, d), "c_nationkey", "c_custkey", WIN), DIGITS)


# ------------------------------------------------------------- model / system health
@register("model_health_score", sql_round(with_cte(f"pred AS ({PRED_SQL}), ks AS ({KS_SQL})", """
  SELECT min_accuracy, max_drift, stability, 100 - CASE WHEN min_accuracy < 0.8 THEN 30 WHEN min_accuracy < 0.85 THEN 15 ELSE 0 END
    - CASE WHEN max_drift > 0.3 THEN 25 WHEN max_drift > 0.2 THEN 10 ELSE 0 END - CASE WHEN stability < 0.85 THEN 20 ELSE 0 END AS health_score
  FROM (SELECT (SELECT min(acc) FROM (SELECT avg(CAST(y_pred = y_true AS DOUBLE)) AS acc FROM pred GROUP BY c_mktsegment) a) AS min_accuracy,
               (SELECT max(ks_stat) FROM ks) AS max_drift, (SELECT 1.0 - avg(ks_stat) FROM ks) AS stability) x"""), digits=DIGITS))
def q_model_health(spark, d):
    acc = predictions(spark, d).groupBy("c_mktsegment").agg(F.avg((F.col("y_pred") == F.col("y_true")).cast("double")).alias("acc"))
    ks = ks_two_sample(ks_frame(spark, d), "v", "sample", group="feature")
    return round_doubles(MO.model_health(acc, ks), DIGITS)


# Metric stand-ins drawn from the event stream (event type → metric).
SYSTEM_METRICS = {"click": "cpu_percent", "view": "memory_percent", "purchase": "disk_percent", "signup": "service_up"}


def metric_table(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    m = F.create_map(*[x for k, v in SYSTEM_METRICS.items() for x in (F.lit(k), F.lit(v))])
    name = F.element_at(m, F.col("event_type"))
    val = F.when(name == "service_up", (F.col("value") > 1).cast("double")).otherwise(F.col("value") / 5.0)
    return e.select(name.alias("name"), val.alias("value"), "ts", "event_id")


METRIC_SQL = ("SELECT CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SYSTEM_METRICS.items())
              + " END AS name, CASE WHEN event_type = 'signup' THEN CAST(value > 1 AS DOUBLE) ELSE value / 5.0 END AS value, ts, event_id FROM events")
LATEST_SQL = f"""SELECT name, value FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ts DESC, event_id DESC) AS rn
  FROM ({METRIC_SQL}) m) x WHERE rn = 1"""


@register("system_health_score", sql_round(f"""WITH l AS ({LATEST_SQL})
  SELECT cpu, mem, disk, services_down, 100 - CASE WHEN cpu > 80 THEN 20 ELSE 0 END - CASE WHEN mem > 85 THEN 25 ELSE 0 END
    - CASE WHEN disk > 90 THEN 15 ELSE 0 END - CASE WHEN services_down > 0 THEN 30 ELSE 0 END AS health_score FROM (
    SELECT max(CASE WHEN name = 'cpu_percent' THEN value END) AS cpu, max(CASE WHEN name = 'memory_percent' THEN value END) AS mem,
      max(CASE WHEN name = 'disk_percent' THEN value END) AS disk,
      CAST(sum(CASE WHEN name = 'service_up' AND value = 0 THEN 1 ELSE 0 END) AS BIGINT) AS services_down FROM l) x""", digits=DIGITS))
def q_system_health(spark, d):
    return round_doubles(MO.system_health(MO.latest_metrics(metric_table(spark, d))), DIGITS)


# The reference's default alert rules (metric, threshold, comparison, severity).
ALERT_RULES = [("system_cpu_percent", 80.0, "gt", "warning"), ("system_memory_percent", 85.0, "gt", "critical"),
               ("model_accuracy", 0.8, "lt", "critical"), ("model_drift_score", 0.3, "gt", "warning"),
               ("api_latency_p95", 2.0, "gt", "warning"), ("external_api_cost_usd", 100.0, "gt", "warning")]


def _metric_rules_sql() -> str:
    rules = ", ".join(f"('{m}', CAST({t!r} AS DOUBLE), '{c}', '{s}')" for m, t, c, s in ALERT_RULES)
    body = f"""SELECT metric_name, value, threshold, comparison, severity,
    coalesce(CASE comparison WHEN 'gt' THEN value > threshold WHEN 'lt' THEN value < threshold ELSE value = threshold END, false) AS triggered
  FROM (SELECT * FROM (VALUES {rules}) t(metric_name, threshold, comparison, severity)) r
  LEFT JOIN (SELECT 'system_cpu_percent' AS metric_name, (SELECT value FROM l WHERE name = 'cpu_percent') AS value
    UNION ALL SELECT 'system_memory_percent', (SELECT value FROM l WHERE name = 'memory_percent')
    UNION ALL SELECT 'model_accuracy', (SELECT min(acc) FROM (SELECT avg(CAST(y_pred = y_true AS DOUBLE)) AS acc FROM pred GROUP BY c_mktsegment) a)
    UNION ALL SELECT 'model_drift_score', (SELECT max(ks_stat) FROM ks)
    UNION ALL SELECT 'api_latency_p95', (SELECT quantile_cont(value / 100.0, 0.95) FROM events)
    UNION ALL SELECT 'external_api_cost_usd', (SELECT {sqlgen.sum_of('value / 100.0')} FROM events
                                               WHERE event_type IN ('purchase', 'signup', 'error'))) v
  USING (metric_name)"""
    return sql_round(with_cte(f"pred AS ({PRED_SQL}), ks AS ({KS_SQL}), l AS ({LATEST_SQL})", body),
                     keep=["triggered", "comparison"], digits=DIGITS)


@register("metric_rules", _metric_rules_sql())
def q_metric_rules(spark, d):
    from riskloom.operators.ranks import exact_quantiles
    latest = MO.latest_metrics(metric_table(spark, d))
    acc = predictions(spark, d).groupBy("c_mktsegment").agg(F.avg((F.col("y_pred") == F.col("y_true")).cast("double")).alias("acc"))
    ks = ks_two_sample(ks_frame(spark, d), "v", "sample", group="feature")
    e = table(spark, d, "events")
    lat = exact_quantiles(e.select((F.col("value") / 100.0).alias("lat")), "lat", [0.95], prefix="value")
    cost = e.where(F.col("event_type").isin("purchase", "signup", "error")).agg(sum_of(F.col("value") / 100.0).alias("value"))
    values = (latest.where(F.col("name") == "cpu_percent").select(F.lit("system_cpu_percent").alias("metric_name"), "value")
              .unionByName(latest.where(F.col("name") == "memory_percent").select(F.lit("system_memory_percent").alias("metric_name"), "value"))
              .unionByName(acc.agg(F.min("acc").alias("value")).select(F.lit("model_accuracy").alias("metric_name"), "value"))
              .unionByName(ks.agg(F.max("ks_stat").alias("value")).select(F.lit("model_drift_score").alias("metric_name"), "value"))
              .unionByName(lat.select(F.lit("api_latency_p95").alias("metric_name"), "value"))
              .unionByName(cost.select(F.lit("external_api_cost_usd").alias("metric_name"), "value")))
    rules = spark.createDataFrame(ALERT_RULES, "metric_name string, threshold double, comparison string, severity string")
    return round_doubles(MO.metric_rules(values, rules), DIGITS)


@register("latency_p95", sql_round("""SELECT event_type AS fn, quantile_cont(value / 100.0, 0.95) AS p95_latency,
  count(*) AS n FROM events GROUP BY event_type""", keep=["fn"], digits=DIGITS))
def q_latency_p95(spark, d):
    from riskloom.operators.ranks import exact_quantiles
    e = table(spark, d, "events").select(F.col("event_type").alias("fn"), (F.col("value") / 100.0).alias("lat"))
    q = exact_quantiles(e, "lat", [0.95], prefix="p95_latency", group="fn")
    n = e.groupBy("fn").agg(F.count(F.lit(1)).alias("n"))
    return round_doubles(q.join(n, "fn"), DIGITS)


BUDGET_USD = 1000.0


@register("cost_rollup", sql_round(f"""WITH c AS (SELECT CASE WHEN event_type IN ('click', 'view') THEN 'compute' ELSE 'api' END AS kind,
    event_type AS component, value / 100.0 AS cost, CAST(ts AS DATE) AS date FROM events),
  nd AS (SELECT count(DISTINCT date) AS n_days FROM c)
  SELECT kind, component, total_cost, total_cost / {BUDGET_USD!r} * 100.0 AS budget_used_pct,
    total_cost / n_days * 30.0 AS projected_monthly FROM (
    SELECT kind, component, {sqlgen.sum_of('cost')} AS total_cost FROM c GROUP BY ROLLUP (kind, component)) r, nd""",
    digits=DIGITS))
def q_cost(spark, d):
    e = table(spark, d, "events")
    c = e.select(F.when(F.col("event_type").isin("click", "view"), "compute").otherwise("api").alias("kind"),
                 F.col("event_type").alias("component"), (F.col("value") / 100.0).alias("cost"), F.to_date("ts").alias("date"))
    return round_doubles(MO.cost_rollup(c, BUDGET_USD), DIGITS)
