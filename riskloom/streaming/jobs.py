"""Structured Streaming versions of the stateful operators.

Each job reads a landing folder with ``readStream``, writes to a sink, and
checkpoints to the shared folder: a restarted query (or a lost executor)
resumes from the checkpoint.  Jobs whose result depends on the order of events
(score changes, cooldown, emit-on-change) keep their state in the state store
and decide rows in event-time order (``streaming.stateful``), so neither the
number of files nor their order matters, as long as no row is later than the
watermark's delay.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import alerts as A
from riskloom.streaming import stateful as S

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
ALERT_SCHEMA = ("id bigint, ts timestamp_ntz, event_id bigint, score double, previous_score double, trend string, "
                "delta double, delta_abs double, threshold double, direction string")
COOLDOWN_SCHEMA = ("metric_name string, ts timestamp_ntz, event_id bigint, value double, severity string, "
                   "cooldown_s double, fired boolean")
EMIT_SCHEMA = "series string, ts timestamp_ntz, event_id bigint, score double, emitted boolean, change double"
# Fixed value: how late an event may arrive (the refresh interval).
LATENESS_S = 1800.0


def _landed(spark: SparkSession, landing: str, max_files: int | None) -> DataFrame:
    r = spark.readStream.schema(EVENT_SCHEMA)
    return (r.option("maxFilesPerTrigger", max_files) if max_files else r).option("recursiveFileLookup", "true").parquet(landing)


def _step_ms(lateness_s: float) -> int:
    return max(1000, int(lateness_s * 1000) // 16)


def heartbeat(spark: SparkSession, landing: str, lateness_s: float = LATENESS_S) -> None:
    """Ends a landing folder: an event of no key, late enough that the watermark
    passes every row before it."""
    newest = spark.read.schema(EVENT_SCHEMA).option("recursiveFileLookup", "true").parquet(landing).agg(F.max("ts")).first()[0]
    if newest is not None:
        later = newest + dt.timedelta(seconds=2 * lateness_s + 2 * _step_ms(lateness_s) / 1000 + 1)
        spark.createDataFrame([(None, later, None, None, None, None)], EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(
            f"{landing}/heartbeat")


def score_alert_stream(spark: SparkSession, landing: str, sink: str, checkpoint: str,
                       max_files_per_trigger: int | None = 64, lateness_s: float = LATENESS_S):
    """events landing folder → per-id change alerts (parquet sink)."""
    rows = _landed(spark, landing, max_files_per_trigger).select(
        F.col("user_id").alias("id"), "ts", F.col("event_id").alias("tie"), (F.col("value") / 100.0).alias("value"))
    step = S.ScoreAlerts(_step_ms(lateness_s), A.ALERT_DELTA_ABS)
    return S.run_to_end(S.in_order(rows, "id", step, ALERT_SCHEMA, lateness_s), sink, checkpoint)


def cooldown_stream(spark: SparkSession, landing: str, sink: str, checkpoint: str,
                    max_files_per_trigger: int | None = 64, lateness_s: float = LATENESS_S):
    """events landing folder → rule candidates (stream-static join with the
    rule table; events that break no rule only move the watermark) → cooldown →
    parquet sink."""
    from riskloom.plans.alerts_queries import candidates_from
    rows = candidates_from(spark, _landed(spark, landing, max_files_per_trigger), keep_others=True).withColumnRenamed("event_id", "tie")
    step = S.Cooldown(_step_ms(lateness_s), float(max(A.COOLDOWN_CRITICAL_S, A.COOLDOWN_OTHER_S)))
    return S.run_to_end(S.in_order(rows, "metric_name", step, COOLDOWN_SCHEMA, lateness_s), sink, checkpoint)


def emit_on_change_stream(spark: SparkSession, landing: str, sink: str, checkpoint: str, min_change: float, ttl_s: float,
                          max_files_per_trigger: int | None = 64, lateness_s: float = LATENESS_S):
    """events landing folder → a score per series (event type) → emit-on-change
    with expiry → parquet sink."""
    from riskloom.plans.alerts_queries import series_scores
    rows = series_scores(_landed(spark, landing, max_files_per_trigger)).withColumnsRenamed({"event_id": "tie", "score": "value"})
    step = S.EmitOnChange(_step_ms(lateness_s), min_change, ttl_s)
    return S.run_to_end(S.in_order(rows, "series", step, EMIT_SCHEMA, lateness_s), sink, checkpoint)


def read_sink(spark: SparkSession, sink: str, schema: str) -> DataFrame:
    """A sink's rows; none where the stream has not written yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(sink)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(sink)


def hourly_metrics_stream(spark: SparkSession, landing: str, sink: str, checkpoint: str):
    """Per function and hour: count and mean; an hour is final (and dropped
    from state) once the watermark passes it."""
    # watermarks need an instant type: read the wall-clock column as UTC
    ev = spark.readStream.schema(EVENT_SCHEMA).parquet(landing).withColumn("ts", F.col("ts").cast("timestamp"))
    g = (ev.withWatermark("ts", "1 hour")
           .groupBy(F.col("event_type").alias("fn"), F.window("ts", "1 hour").alias("w"))
           .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("avg_value")))
    out = g.select("fn", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n", "avg_value")
    return (out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
               .outputMode("append").trigger(availableNow=True).start())


__all__ = ["heartbeat", "read_sink", "score_alert_stream", "cooldown_stream", "emit_on_change_stream", "hourly_metrics_stream"]
