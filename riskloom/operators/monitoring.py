"""Monitoring scores computed from tables.

Every input is an aggregate of the data (freshness per source, accuracy per
model, KS per feature, latest value per metric); the scores are projections
over those small tables, joined as one-row sides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.aggregates import sum_of
from riskloom.operators.ranks import value_counts_ranked

# Reference thresholds.
STALE_S, FAILED_S, MISSING_MAX = 3600, 86400, 0.1
Z95 = 1.96


def status(score: Column) -> Column:
    return F.when(score >= 80, "healthy").when(score >= 60, "warning").otherwise("critical")


def data_freshness(df: DataFrame, source: str, us: str) -> DataFrame:
    """Seconds since the newest record per source; now = newest record overall."""
    now = df.agg(F.max(us).alias("__now"))
    g = df.groupBy(source).agg(F.max(us).alias("__last"))
    return (g.crossJoin(F.broadcast(now))  # one row
             .select(F.col(source).alias("source"), ((F.col("__now") - F.col("__last")) / 1e6).alias("age_seconds")))


def data_quality_score(fresh: DataFrame, missing: DataFrame) -> DataFrame:
    s = fresh.agg(F.sum((F.col("age_seconds") > STALE_S).cast("int")).cast("bigint").alias("n_stale"),
                  F.sum((F.col("age_seconds") > FAILED_S).cast("int")).cast("bigint").alias("n_failed"))
    j = s.crossJoin(missing)
    score = (F.lit(100) - F.col("n_stale") * 15 - F.col("n_failed") * 25
             - F.when(F.col("missing_share") > MISSING_MAX, 20).otherwise(0))
    return j.select("n_stale", "n_failed", "missing_share", score.alias("quality_score"), status(score).alias("status"))


def classification_metrics(df: DataFrame, y: str, pred: str, proba: str, eps: float = 1e-15) -> DataFrame:
    yt, yp = F.col(y), F.col(pred)
    tp = F.sum(yp * yt)
    fp = F.sum(yp * (1 - yt))
    fn = F.sum((1 - yp) * yt)
    p = F.least(F.greatest(F.col(proba), F.lit(eps)), F.lit(1 - eps))
    ll = -F.avg(yt * F.log(p) + (1 - yt) * F.log(1 - p))
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg((yp == yt).cast("double")).alias("accuracy"),
                  F.when(F.sum(yp) > 0, tp * 1.0 / F.sum(yp)).alias("precision"),
                  F.when(F.sum(yt) > 0, tp * 1.0 / F.sum(yt)).alias("recall"),
                  F.when(2 * tp + fp + fn > 0, 2.0 * tp / (2 * tp + fp + fn)).alias("f1"),
                  ll.alias("log_loss"))


def ensemble_uncertainty(members: Sequence[Column]) -> list[Column]:
    """mean ± 1.96 · population sd over ensemble members (our definition)."""
    n = float(len(members))
    s = members[0]
    for m in members[1:]:
        s = s + m
    mean = s / F.lit(n)
    ss = None
    for m in members:
        t = (m - mean) * (m - mean)
        ss = t if ss is None else ss + t
    sd = F.sqrt(ss / F.lit(n))
    return [mean.alias("mean_probability"), (mean - Z95 * sd).alias("lower"), (mean + Z95 * sd).alias("upper"),
            F.greatest(F.lit(0.0), F.lit(1.0) - 2 * Z95 * sd).alias("confidence")]


def performance_alert(pred: DataFrame, group: str, order: str, window_rows: int,
                      min_accuracy: float = 0.7, drift_windows: int = 3) -> DataFrame:
    """Tumbling windows of ``window_rows`` predictions per group: accuracy,
    alert below ``min_accuracy``, retrain after ``drift_windows`` alerts in a row.
    Row positions come from distributed prefix counts (no per-group sort)."""
    r = value_counts_ranked(pred.select(group, order), order, group=group).select(group, order, "n_upto")
    j = pred.join(r, [group, order])
    w = (j.withColumn("window_id", F.floor((F.col("n_upto") - 1) / window_rows))
          .groupBy(group, "window_id").agg(F.avg((F.col("y_pred") == F.col("y_true")).cast("double")).alias("accuracy"),
                                           F.count(F.lit(1)).alias("n")))
    alert = F.col("accuracy") < min_accuracy
    last = Window.partitionBy(group).orderBy("window_id").rowsBetween(-(drift_windows - 1), 0)
    return w.select(group, "window_id", "accuracy", "n", alert.alias("alert"),
                    (F.sum(alert.cast("int")).over(last) == drift_windows).alias("retrain"))


def model_health(acc: DataFrame, ks: DataFrame) -> DataFrame:
    a = acc.agg(F.min("acc").alias("min_accuracy"))
    k = ks.agg(F.max("ks_stat").alias("max_drift"), (F.lit(1.0) - F.avg("ks_stat")).alias("stability"))
    j = a.crossJoin(k)
    score = (F.lit(100)
             - F.when(F.col("min_accuracy") < 0.8, 30).when(F.col("min_accuracy") < 0.85, 15).otherwise(0)
             - F.when(F.col("max_drift") > 0.3, 25).when(F.col("max_drift") > 0.2, 10).otherwise(0)
             - F.when(F.col("stability") < 0.85, 20).otherwise(0))
    return j.select("min_accuracy", "max_drift", "stability", score.alias("health_score"))


def latest_metrics(m: DataFrame) -> DataFrame:
    """Newest value per metric name (max by (ts, event_id))."""
    return m.groupBy("name").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


def system_health(latest: DataFrame) -> DataFrame:
    v = latest.agg(F.max(F.when(F.col("name") == "cpu_percent", F.col("value"))).alias("cpu"),
                   F.max(F.when(F.col("name") == "memory_percent", F.col("value"))).alias("mem"),
                   F.max(F.when(F.col("name") == "disk_percent", F.col("value"))).alias("disk"),
                   F.sum(((F.col("name") == "service_up") & (F.col("value") == 0)).cast("int")).cast("bigint")
                   .alias("services_down"))
    score = (F.lit(100) - F.when(F.col("cpu") > 80, 20).otherwise(0) - F.when(F.col("mem") > 85, 25).otherwise(0)
             - F.when(F.col("disk") > 90, 15).otherwise(0) - F.when(F.col("services_down") > 0, 30).otherwise(0))
    return v.select("cpu", "mem", "disk", "services_down", score.alias("health_score"))


def metric_rules(values: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules (metric, threshold, gt/lt/eq, severity) against current values."""
    j = rules.join(values, "metric_name", "left")
    v, t, c = F.col("value"), F.col("threshold"), F.col("comparison")
    hit = F.when(c == "gt", v > t).when(c == "lt", v < t).otherwise(v == t)
    return j.select("metric_name", "value", "threshold", "comparison", "severity",
                    F.coalesce(hit, F.lit(False)).alias("triggered"))


def cost_rollup(c: DataFrame, budget: float) -> DataFrame:
    nd = c.agg(F.count_distinct("date").alias("__nd"))
    r = c.rollup("kind", "component").agg(sum_of(F.col("cost")).alias("total_cost"))
    return (r.crossJoin(F.broadcast(nd))  # one row
             .select("kind", "component", "total_cost", (F.col("total_cost") / budget * 100.0).alias("budget_used_pct"),
                     (F.col("total_cost") / F.col("__nd") * 30.0).alias("projected_monthly")))
