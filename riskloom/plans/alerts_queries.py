"""Score history, alerts, folds, TTL / rate monitors and drift (§2.10, §2.5).

Score stream stand-in: events → (id = user_id, ts, event_id, score = value / 100).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import alerts as A
from riskloom.operators.aggregates import mean_of
from riskloom.plans import sqlgen
from riskloom.plans.common import register, round_doubles, sql_round, with_cte
from riskloom.sources import panel as P
from riskloom.sources.tables import table
from riskloom.streaming import folds

DIGITS = 6
ORDER = ["ts", "event_id"]


def stream(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("id"), "ts", "event_id",
                                            (F.col("value") / F.lit(100.0)).alias("score"))


STREAM_SQL = "SELECT user_id AS id, ts, event_id, value / 100.0 AS score FROM events"
W = "PARTITION BY id ORDER BY ts, event_id"
TREND_SQL = f"""SELECT id, ts, event_id, score, lag(score) OVER ({W}) AS previous_score,
  CASE WHEN score IS NULL OR lag(score) OVER ({W}) IS NULL THEN 'FLAT' WHEN score > lag(score) OVER ({W}) THEN 'IMPROVING'
       WHEN score < lag(score) OVER ({W}) THEN 'WORSENING' ELSE 'FLAT' END AS trend,
  score - lag(score) OVER ({W}) AS delta FROM stream"""
ALERT_SQL = f"""SELECT *, abs(delta) AS delta_abs, CAST({A.ALERT_DELTA_ABS!r} AS DOUBLE) AS threshold,
  CASE WHEN delta > 0 THEN 'UP' WHEN delta < 0 THEN 'DOWN' ELSE 'FLAT' END AS direction
  FROM ({TREND_SQL}) t WHERE abs(delta) >= {A.ALERT_DELTA_ABS!r}"""


def ssql(body: str, keep=()) -> str:
    return sql_round(with_cte(f"stream AS ({STREAM_SQL})", body), keep=list(keep), digits=DIGITS)


@register("score_trend", ssql(TREND_SQL))
def q_score_trend(spark, d):
    return round_doubles(A.score_trend(stream(spark, d), "id", ORDER, "score"), DIGITS)


@register("score_change_alert", ssql(ALERT_SQL))
def q_change_alert(spark, d):
    return round_doubles(A.change_alerts(A.score_trend(stream(spark, d), "id", ORDER, "score")), DIGITS)


@register("last_two_per_key", ssql(f"""SELECT id, ts, score AS current_score, previous_score, trend FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_id DESC) AS recency FROM ({TREND_SQL}) t) x WHERE recency = 1"""))
def q_last_two(spark, d):
    t = A.score_trend(stream(spark, d), "id", ORDER, "score")
    r = A.last_n_per_key(t, "id", ORDER, 1)
    return round_doubles(r.select("id", "ts", F.col("score").alias("current_score"), "previous_score", "trend"), DIGITS)


@register("bounded_history", ssql(f"""SELECT id, ts, event_id, score, recency FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_id DESC) AS recency FROM stream) x
  WHERE recency <= {A.HISTORY_DEPTH}"""))
def q_bounded(spark, d):
    return round_doubles(A.last_n_per_key(stream(spark, d), "id", ORDER, A.HISTORY_DEPTH), DIGITS)


T7_SQL = f"""WITH r AS (SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS recency
    FROM prices_daily),
  g AS (SELECT ticker, {sqlgen.mean_of("CASE WHEN recency <= 7 THEN close END")} AS recent_avg,
    {sqlgen.mean_of("CASE WHEN recency > 7 THEN close END")} AS older_avg, count(*) AS n,
    max(CASE WHEN recency = 1 THEN close END) AS current_score FROM r WHERE recency <= 14 GROUP BY ticker),
  t AS (SELECT ticker, current_score, CASE WHEN n >= 2 AND older_avg IS NOT NULL THEN recent_avg - older_avg ELSE 0.0 END AS trend_magnitude
    FROM g)
  SELECT ticker, current_score, trend_magnitude, CASE WHEN trend_magnitude > 2.0 THEN 'improving'
    WHEN trend_magnitude < -2.0 THEN 'declining' ELSE 'neutral' END AS trend FROM t"""


def trend7(spark, d):
    from riskloom.operators.alerts import last_n_per_key
    p = P.prices_daily(spark, d)
    r = last_n_per_key(p, "ticker", ["date"], 14)
    g = r.groupBy("ticker").agg(mean_of(F.when(F.col("recency") <= 7, F.col("close"))).alias("recent_avg"),
                                mean_of(F.when(F.col("recency") > 7, F.col("close"))).alias("older_avg"),
                                F.count(F.lit(1)).alias("n"),
                                F.max(F.when(F.col("recency") == 1, F.col("close"))).alias("current_score"))
    mag = (F.when((F.col("n") >= 2) & F.col("older_avg").isNotNull(), F.col("recent_avg") - F.col("older_avg"))
            .otherwise(F.lit(0.0)))
    t = g.select("ticker", "current_score", mag.alias("trend_magnitude"))
    return t.withColumn("trend", F.when(F.col("trend_magnitude") > A.TREND_BAND, "improving")
                        .when(F.col("trend_magnitude") < -A.TREND_BAND, "declining").otherwise("neutral"))


@register("score_trend_7v7", P.with_panel_views(sql_round(T7_SQL, digits=DIGITS), "prices_daily"))
def q_trend7(spark, d):
    return round_doubles(trend7(spark, d), DIGITS)


@register("score_event_alerts", P.with_panel_views(sql_round(f"""WITH t7 AS ({T7_SQL})
  SELECT ticker, 'significant_change' AS alert_type, CASE WHEN abs(trend_magnitude) > 10.0 THEN 'high' ELSE 'medium' END AS severity,
    printf('Credit score %s by %.1f points', CASE WHEN trend_magnitude > 0 THEN 'improved' ELSE 'declined' END,
           round(abs(trend_magnitude) * 10) / 10) AS message FROM t7 WHERE abs(trend_magnitude) > 5.0
  UNION ALL
  SELECT ticker, 'threshold_breach', 'critical', 'Credit score below investment grade threshold' FROM t7 WHERE current_score < 50.0""",
    digits=DIGITS), "prices_daily"))
def q_event_alerts(spark, d):
    return A.score_event_alerts(trend7(spark, d), "ticker")


# ---------------------------------------------------------------- rule alerts
# Example rule templates (one set per ticker) -- name, field,
# condition, threshold, severity.
RULE_TEMPLATES = [("score_low", "score", "less_than", 10.0, "high"),
                  ("volatile", "volatility", "greater_than", 100.0, "medium"),
                  ("volume_50", "volume", "equals", 50.0, "low")]


def conditions(spark, d):
    t = P.ticks(spark, d)
    r = A.last_n_per_key(t, "ticker", ORDER, 30)
    return r.groupBy("ticker").agg(
        F.max(F.when(F.col("recency") == 1, F.col("close"))).alias("score"),
        F.stddev_samp("close").alias("volatility"),
        (F.max(F.when(F.col("recency") == 1, F.col("close"))) - F.max(F.when(F.col("recency") == 2, F.col("close"))))
        .alias("price_change"),
        F.max(F.when(F.col("recency") == 1, F.col("volume"))).alias("volume"))


def rules(spark, d):
    tick = table(spark, d, "events").select(F.col("user_id").alias("ticker")).distinct()
    tpl = spark.createDataFrame(RULE_TEMPLATES, "alert_type string, condition_field string, condition string, "
                                                "threshold double, severity string")
    # the template table is a fixed 3-row literal: broadcast is bounded
    return (tick.crossJoin(F.broadcast(tpl))
                .withColumn("rule_id", F.concat_ws(":", F.col("ticker").cast("string"), F.col("alert_type")))
                .withColumn("enabled", F.lit(True)))


COND_SQL = """SELECT ticker, max(CASE WHEN recency = 1 THEN close END) AS score, stddev_samp(close) AS volatility,
    max(CASE WHEN recency = 1 THEN close END) - max(CASE WHEN recency = 2 THEN close END) AS price_change,
    max(CASE WHEN recency = 1 THEN volume END) AS volume
  FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC, event_id DESC) AS recency FROM ticks) r
  WHERE recency <= 30 GROUP BY ticker"""
RULES_SQL = ("SELECT t.ticker, CAST(t.ticker AS VARCHAR) || ':' || alert_type AS rule_id, alert_type, condition_field, condition, "
             "threshold, severity, true AS enabled FROM (SELECT DISTINCT user_id AS ticker FROM events) t, (VALUES "
             + ", ".join(f"('{a}', '{f}', '{c}', CAST({th!r} AS DOUBLE), '{s}')" for a, f, c, th, s in RULE_TEMPLATES)
             + ") v(alert_type, condition_field, condition, threshold, severity)")


@register("rule_alerts", P.with_panel_views(sql_round(f"""WITH c AS ({COND_SQL}), rl AS ({RULES_SQL}),
  j AS (SELECT rl.*, CASE condition_field WHEN 'score' THEN c.score WHEN 'volatility' THEN c.volatility
          WHEN 'price_change' THEN c.price_change WHEN 'volume' THEN c.volume END AS current_value
        FROM rl JOIN c ON rl.ticker = c.ticker WHERE enabled)
  SELECT ticker, rule_id, alert_type, severity, current_value, threshold,
    printf('%s %s %s %.2f', CAST(ticker AS VARCHAR), condition_field, condition, threshold) AS message FROM j
  WHERE current_value IS NOT NULL AND ((condition = 'less_than' AND current_value < threshold)
     OR (condition = 'greater_than' AND current_value > threshold)
     OR (condition = 'equals' AND abs(current_value - threshold) < 0.01))""", digits=DIGITS), "ticks"))
def q_rule_alerts(spark, d):
    a = A.rule_alerts(rules(spark, d), conditions(spark, d))
    msg = F.format_string("%s %s %s %.2f", F.col("ticker").cast("string"), F.col("condition_field"),
                          F.col("condition"), F.col("threshold"))
    return round_doubles(a.select("ticker", "rule_id", "alert_type", "severity", "current_value", "threshold",
                                  msg.alias("message")), DIGITS)


# ---------------------------------------------------------------- folds
# Metric alert rules over the event stream (metric, comparison,
# threshold, severity); critical rules cool down 30 min, others 60 min.
METRIC_RULES = [("error", "gt", 200.0, "critical"), ("purchase", "gt", 150.0, "warning")]


def metric_candidates(spark, d):
    return candidates_from(spark, table(spark, d, "events"))


def candidates_from(spark, e, keep_others=False):
    """Events breaching a metric rule (batch or streaming input);
    ``keep_others``: also the others, as rows without a metric name."""
    r = spark.createDataFrame(METRIC_RULES, "metric_name string, comparison string, threshold double, severity string")
    j = e.join(F.broadcast(r), e.event_type == r.metric_name, "left" if keep_others else "inner")  # fixed 2-row rule table
    hit = F.when(F.col("comparison") == "gt", F.col("value") > F.col("threshold")).otherwise(F.col("value") < F.col("threshold"))
    cd = F.when(F.col("severity") == "critical", F.lit(A.COOLDOWN_CRITICAL_S)).otherwise(F.lit(A.COOLDOWN_OTHER_S))
    name = F.when(hit, F.col("metric_name")) if keep_others else F.col("metric_name")
    return (j if keep_others else j.where(hit)).select(name.alias("metric_name"), "ts", "event_id", "value", "severity",
                                                       cd.cast("double").alias("cooldown_s"))


CAND_SQL = ("SELECT metric_name, ts, event_id, value, severity, CAST(CASE WHEN severity = 'critical' THEN 1800 ELSE 3600 END AS DOUBLE) "
            "AS cooldown_s FROM events JOIN (VALUES " + ", ".join(f"('{m}', '{c}', CAST({t!r} AS DOUBLE), '{s}')" for m, c, t, s in METRIC_RULES)
            + ") r(metric_name, comparison, threshold, severity) ON event_type = metric_name "
            "WHERE (comparison = 'gt' AND value > threshold) OR (comparison = 'lt' AND value < threshold)")


@register("alert_cooldown", sql_round(f"""WITH RECURSIVE c AS (SELECT *, epoch_us(ts) AS us,
    row_number() OVER (PARTITION BY metric_name ORDER BY ts, event_id) AS rn FROM ({CAND_SQL}) x),
  f(metric_name, rn, last_fired, fired) AS (
    SELECT metric_name, rn, us, true FROM c WHERE rn = 1
    UNION ALL
    SELECT c.metric_name, c.rn, CASE WHEN c.us - f.last_fired > c.cooldown_s * 1000000 THEN c.us ELSE f.last_fired END,
           c.us - f.last_fired > c.cooldown_s * 1000000
    FROM f JOIN c ON c.metric_name = f.metric_name AND c.rn = f.rn + 1)
  SELECT c.metric_name, c.ts, c.event_id, c.value, c.severity, c.cooldown_s, f.fired FROM c JOIN f USING (metric_name, rn)""",
    keep=["fired"], digits=DIGITS))
def q_cooldown(spark, d):
    return round_doubles(folds.alert_cooldown(metric_candidates(spark, d), "metric_name", "ts", "event_id", "cooldown_s"), DIGITS)


# An emitted value expires after an hour; a series' score is its
# events' value over 50.
BROADCAST_TTL_S, SERIES_UNIT = 3600.0, 50.0


def series_scores(e):
    """(series, ts, event_id, score) of events, batch or stream; one series per
    event type."""
    return e.select(F.col("event_type").alias("series"), "ts", "event_id", (F.col("value") / F.lit(SERIES_UNIT)).alias("score"))


@register("broadcast_on_change", sql_round(f"""WITH RECURSIVE s AS (SELECT event_type AS series, ts, event_id, value / {SERIES_UNIT} AS score,
    epoch_us(ts) AS us, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events),
  f(series, rn, last_val, last_us, emitted, change) AS (
    SELECT series, rn, score, us, true, 0.0::DOUBLE FROM s WHERE rn = 1
    UNION ALL
    SELECT d.series, d.rn, CASE WHEN d.expired OR d.moved THEN d.score ELSE d.last_val END,
      CASE WHEN d.expired OR d.moved THEN d.us ELSE d.last_us END, d.expired OR d.moved,
      CASE WHEN d.expired THEN 0.0::DOUBLE WHEN d.moved THEN d.score - d.last_val END
    FROM (SELECT s.series, s.rn, s.score, s.us, f.last_val, f.last_us, s.us - f.last_us >= {int(BROADCAST_TTL_S * 1e6)} AS expired,
            abs(s.score - f.last_val) >= 1.0 AS moved
          FROM f JOIN s ON s.series = f.series AND s.rn = f.rn + 1) d)
  SELECT s.series, s.ts, s.event_id, s.score, f.emitted, f.change FROM s JOIN f USING (series, rn)""",
    keep=["series", "emitted"], digits=DIGITS))
def q_broadcast(spark, d):
    s = series_scores(table(spark, d, "events"))
    return round_doubles(folds.emit_on_change(s, "series", ["ts", "event_id"], "score", A.BROADCAST_MIN_CHANGE, BROADCAST_TTL_S), DIGITS)


@register("broadcast_on_change_daily", P.with_panel_views(sql_round(f"""WITH RECURSIVE s AS (SELECT ticker, date, close,
    row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn FROM prices_daily),
  f(ticker, rn, last_val, emitted, change) AS (
    SELECT ticker, rn, close, true, 0.0::DOUBLE FROM s WHERE rn = 1
    UNION ALL
    SELECT s.ticker, s.rn, CASE WHEN abs(s.close - f.last_val) >= 1.0 THEN s.close ELSE f.last_val END,
      abs(s.close - f.last_val) >= 1.0, CASE WHEN abs(s.close - f.last_val) >= 1.0 THEN s.close - f.last_val END
    FROM f JOIN s ON s.ticker = f.ticker AND s.rn = f.rn + 1)
  SELECT s.ticker, s.date, s.close, f.emitted, f.change FROM s JOIN f USING (ticker, rn)""",
    keep=["emitted"], digits=DIGITS), "prices_daily"))
def q_broadcast_daily(spark, d):
    return round_doubles(folds.emit_on_change(P.prices_daily(spark, d).select("ticker", "date", "close"), "ticker", ["date"], "close",
                                              A.BROADCAST_MIN_CHANGE), DIGITS)


# ---------------------------------------------------------------- TTL / rate
TTL_S = 24 * 3600


@register("ttl_latest", sql_round(f"""WITH now_ AS (SELECT max(epoch_us(ts)) AS now_us FROM events),
  live AS (SELECT user_id, event_type, value, ts FROM events, now_ WHERE epoch_us(ts) > now_us - {TTL_S * 1_000_000})
  SELECT user_id, event_type, value, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type
    ORDER BY ts DESC, value DESC) AS rn FROM live) x WHERE rn = 1""", keep=["event_type"], digits=DIGITS))
def q_ttl(spark, d):
    e = table(spark, d, "events")
    now = e.agg(F.max(A.micros("ts")).alias("__now"))
    j = e.crossJoin(F.broadcast(now))  # one row
    return round_doubles(A.ttl_latest(j, ["user_id", "event_type"], "ts", "value", F.col("__now"), TTL_S), DIGITS)


RATE_WINDOW_S, RATE_LIMIT = 86400, 5


@register("rate_breach", sql_round(f"""SELECT user_id, ts, event_id, n_in_window FROM (
  SELECT user_id, ts, event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)
    RANGE BETWEEN {RATE_WINDOW_S * 1_000_000 - 1} PRECEDING AND CURRENT ROW) AS n_in_window FROM events) x
  WHERE n_in_window > {RATE_LIMIT}""", digits=DIGITS))
def q_rate(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id")
    return A.rate_breach(e, "user_id", "ts", RATE_WINDOW_S, RATE_LIMIT)


@register("hourly_metrics", sql_round("""SELECT event_type AS fn, time_bucket(INTERVAL 1 hour, ts) AS window_start,
  count(*) AS n, avg(value) AS avg_value FROM events GROUP BY 1, 2""", keep=["fn"], digits=DIGITS))
def q_hourly(spark, d):
    e = table(spark, d, "events")
    g = e.groupBy(F.col("event_type").alias("fn"), F.window("ts", "1 hour").alias("w")).agg(
        F.count(F.lit(1)).alias("n"), mean_of(F.col("value")).alias("avg_value"))
    return round_doubles(g.select("fn", F.col("w.start").alias("window_start"), "n", "avg_value"), DIGITS)


@register("latency_by_hour", sql_round("""SELECT event_type AS fn, time_bucket(INTERVAL 1 hour, ts) AS window_start,
  avg(value) AS avg_latency, quantile_cont(value, 0.95) AS p95_latency FROM events GROUP BY 1, 2""", keep=["fn"], digits=DIGITS))
def q_latency(spark, d):
    from riskloom.operators.ranks import exact_quantiles
    e = table(spark, d, "events").select(F.col("event_type").alias("fn"),
                                         F.window("ts", "1 hour").start.alias("window_start"), "value")
    g = e.withColumn("__g", F.concat_ws("|", "fn", F.col("window_start").cast("string")))
    q = exact_quantiles(g, "value", [0.95], prefix="p95_latency", group="__g")
    m = g.groupBy("__g", "fn", "window_start").agg(mean_of(F.col("value")).alias("avg_latency"))
    return round_doubles(m.join(q, "__g").drop("__g"), DIGITS)


@register("reference_window", ssql("""SELECT id, ts, event_id, score FROM (SELECT *, row_number() OVER
  (PARTITION BY id ORDER BY ts DESC, event_id DESC) AS rn FROM stream) x WHERE rn <= 100"""))
def q_refwin(spark, d):
    return round_doubles(A.last_n_per_key(stream(spark, d), "id", ORDER, 100).drop("recency"), DIGITS)


# the streaming twins (plans.stream_queries) are checked against the same SQL
def _oracle(name: str) -> str:
    from riskloom.plans.common import ORACLE
    return ORACLE[name]


ORACLE_COOLDOWN = _oracle("alert_cooldown")
ORACLE_BROADCAST = _oracle("broadcast_on_change")
