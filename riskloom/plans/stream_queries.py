"""Structured Streaming jobs run to completion (Trigger.AvailableNow) over a
landing folder that Spark derives from the events table; results are read
back from the sink and compared with the batch oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import alerts as A
from riskloom.plans import alerts_queries as AQ
from riskloom.plans.alerts_queries import ALERT_SQL, ssql
from riskloom.plans.common import register, round_doubles, sql_round
from riskloom.session import scratch_table_path
from riskloom.sources.tables import table
from riskloom.streaming import jobs

DIGITS = 6


PARTS = 3


def _land(spark, ev, landing, run):
    """Lands events oldest first, in ``PARTS`` parts of several files, and runs
    the stream after each; a heartbeat ends the input.  Inside a part files are
    in no order, so rows are late by up to a part's width, which is the
    watermark's delay; state and restarts connect the parts."""
    lo, hi = ev.agg(F.min("ts"), F.max("ts")).first()
    if lo is None:
        return
    width = (hi - lo).total_seconds() / PARTS + 1.0
    part = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(lo).cast("timestamp"))) / (width * 1e6))
    for i in range(PARTS):
        ev.where(part == i).repartition(4, "event_id").write.parquet(f"{landing}/part{i}")
        if i == PARTS - 1:
            jobs.heartbeat(spark, landing, width)
        run(width)


@register("stream_score_alerts", ssql(ALERT_SQL))
def q_stream_alerts(spark, d):
    base = scratch_table_path(spark, "stream-alerts")
    _land(spark, table(spark, d, "events"), f"{base}/landing", lambda width: jobs.score_alert_stream(
        spark, f"{base}/landing", f"{base}/sink", f"{base}/checkpoint", lateness_s=width))
    return round_doubles(jobs.read_sink(spark, f"{base}/sink", jobs.ALERT_SCHEMA), DIGITS)


@register("stream_hourly_metrics", sql_round("""SELECT fn, window_start, n, avg_value FROM (
  SELECT event_type AS fn, time_bucket(INTERVAL 1 hour, ts) AS window_start, count(*) AS n, avg(value) AS avg_value
  FROM events GROUP BY 1, 2) g WHERE window_start + INTERVAL 1 hour <= (SELECT max(ts) FROM events) - INTERVAL 1 hour""",
    keep=["fn"], digits=DIGITS))
def q_stream_hourly(spark, d):
    base = scratch_table_path(spark, "stream-hourly")
    table(spark, d, "events").write.parquet(f"{base}/landing")
    q = jobs.hourly_metrics_stream(spark, f"{base}/landing", f"{base}/sink", f"{base}/checkpoint")
    q.awaitTermination()
    return round_doubles(spark.read.parquet(f"{base}/sink"), DIGITS)


@register("stream_alert_cooldown", AQ.ORACLE_COOLDOWN)
def q_stream_cooldown(spark, d):
    base = scratch_table_path(spark, "stream-cooldown")
    _land(spark, table(spark, d, "events"), f"{base}/landing", lambda width: jobs.cooldown_stream(
        spark, f"{base}/landing", f"{base}/sink", f"{base}/checkpoint", lateness_s=width))
    return round_doubles(jobs.read_sink(spark, f"{base}/sink", jobs.COOLDOWN_SCHEMA), DIGITS)


@register("stream_broadcast_on_change", AQ.ORACLE_BROADCAST)
def q_stream_broadcast(spark, d):
    base = scratch_table_path(spark, "stream-broadcast")
    _land(spark, table(spark, d, "events"), f"{base}/landing", lambda width: jobs.emit_on_change_stream(
        spark, f"{base}/landing", f"{base}/sink", f"{base}/checkpoint", A.BROADCAST_MIN_CHANGE, AQ.BROADCAST_TTL_S, lateness_s=width))
    return round_doubles(jobs.read_sink(spark, f"{base}/sink", jobs.EMIT_SCHEMA), DIGITS)
