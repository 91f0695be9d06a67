"""Score history, trends, alerts and rate/TTL monitors -- batch twins (§2.10).

Everything here is a keyed window or aggregate (parallel over keys, one
exchange on the key).  The decision-dependent folds live in streaming.folds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values (reference thresholds).
ALERT_DELTA_ABS = 0.05
HISTORY_DEPTH = 120
TREND_BAND = 2.0
SIG_CHANGE, HIGH_CHANGE, BREACH_SCORE = 5.0, 10.0, 50.0
EQUALS_TOL = 0.01
COOLDOWN_CRITICAL_S, COOLDOWN_OTHER_S = 1800, 3600
BROADCAST_MIN_CHANGE = 1.0


def micros(ts: str) -> Column:
    """Microseconds since 1970-01-01 of a TIMESTAMP_NTZ (time-zone free)."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def score_trend(df: DataFrame, key: str, order: list[str], score: str) -> DataFrame:
    """Previous score, trend (IMPROVING if the score rose), delta -- per row.
    One row of look-back: a hot key is split into exact halo blocks."""
    from riskloom.operators.windows import home_rows, key_frames
    b, w = key_frames(df, key, order, 1)
    prev = F.lag(score).over(w)
    cur = F.col(score)
    trend = (F.when(cur.isNull() | prev.isNull(), "FLAT").when(cur > prev, "IMPROVING")
              .when(cur < prev, "WORSENING").otherwise("FLAT"))
    out = b.select(*[F.col(c) for c in df.columns], "__i", "__b", "__home",
                   prev.alias("previous_score"), trend.alias("trend"), (cur - prev).alias("delta"))
    return home_rows(out)


def change_alerts(trended: DataFrame, threshold: float = ALERT_DELTA_ABS) -> DataFrame:
    d = F.col("delta")
    return (trended.where(F.abs(d) >= threshold)
                   .withColumn("delta_abs", F.abs(d))
                   .withColumn("threshold", F.lit(float(threshold)))
                   .withColumn("direction", F.when(d > 0, "UP").when(d < 0, "DOWN").otherwise("FLAT")))


def last_n_per_key(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """Newest ``n`` rows per key (rank 1 = newest); hot keys stay distributed."""
    from riskloom.operators.windows import newest_n
    return newest_n(df, key, order, n, "recency")


def trend_7v7(daily: DataFrame, key: str, order: str, score: str) -> DataFrame:
    """Mean of the newest 7 vs the 7 before; > +2 improving, < -2 declining."""
    r = last_n_per_key(daily, key, [order], 14)
    g = r.groupBy(key).agg(F.avg(F.when(F.col("recency") <= 7, F.col(score))).alias("recent_avg"),
                           F.avg(F.when(F.col("recency") > 7, F.col(score))).alias("older_avg"),
                           F.count(F.lit(1)).alias("n"),
                           F.max_by(F.col(score), -F.col("recency")).alias("current_score"))
    mag = F.when((F.col("n") >= 2) & F.col("older_avg").isNotNull(), F.col("recent_avg") - F.col("older_avg")).otherwise(0.0)
    return g.select(key, "current_score", mag.alias("trend_magnitude"),
                    F.when(mag > TREND_BAND, "improving").when(mag < -TREND_BAND, "declining")
                     .otherwise("neutral").alias("trend"))


def score_event_alerts(t: DataFrame, key: str) -> DataFrame:
    """significant_change if |trend| > 5 (high if > 10), threshold_breach if score < 50."""
    m = F.col("trend_magnitude")
    sig = F.when(F.abs(m) > SIG_CHANGE, F.struct(
        F.lit("significant_change").alias("alert_type"),
        F.when(F.abs(m) > HIGH_CHANGE, "high").otherwise("medium").alias("severity"),
        F.format_string("Credit score %s by %.1f points", F.when(m > 0, "improved").otherwise("declined"),
                        F.round(F.abs(m) * 10) / 10).alias("message")))
    brk = F.when(F.col("current_score") < BREACH_SCORE, F.struct(
        F.lit("threshold_breach").alias("alert_type"), F.lit("critical").alias("severity"),
        F.lit("Credit score below investment grade threshold").alias("message")))
    return (t.select(key, F.explode(F.array_compact(F.array(sig, brk))).alias("a"))
             .select(key, "a.alert_type", "a.severity", "a.message"))


def rule_matches(field_value: Column, condition: Column, threshold: Column) -> Column:
    return (F.when(field_value.isNull(), F.lit(False))
             .when(condition == "less_than", field_value < threshold)
             .when(condition == "greater_than", field_value > threshold)
             .when(condition == "equals", F.abs(field_value - threshold) < EQUALS_TOL)
             .otherwise(F.lit(False)))


def rule_alerts(rules: DataFrame, conditions: DataFrame, key: str = "ticker",
                fields=("score", "volatility", "price_change", "volume")) -> DataFrame:
    """Enabled rules joined to the current condition row of their key; the
    field is picked by name from a map built per row."""
    m = F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).cast("double"))])
    c = conditions.select(key, m.alias("__vals"))
    j = rules.where(F.col("enabled")).join(c, key, "inner")
    v = F.element_at(F.col("__vals"), F.col("condition_field"))
    return (j.withColumn("current_value", v)
             .where(rule_matches(F.col("current_value"), F.col("condition"), F.col("threshold")))
             .drop("__vals"))


def ttl_latest(df: DataFrame, key: list[str], ts: str, value: str, now: Column, ttl_seconds: int) -> DataFrame:
    """Newest value per key among rows still inside their time-to-live."""
    live = df.where(micros(ts) > (now - F.lit(int(ttl_seconds) * 1_000_000)))
    return live.groupBy(*key).agg(F.max_by(value, F.struct(ts, value)).alias(value), F.max(ts).alias(ts))


def rate_breach(df: DataFrame, key: str, ts: str, window_seconds: int, limit: int,
                block_rows: int = 1 << 16) -> DataFrame:
    """Rows at which more than ``limit`` requests fell in the trailing window.

    A key larger than ``block_rows`` is split by time into buckets one window
    wide; each row is also copied into the next bucket, where it can fall in
    a later row's window.  Counting then runs per (key, bucket)."""
    from riskloom.operators.windows import _largest_key
    win = int(window_seconds) * 1_000_000
    c = df.withColumn("__us", micros(ts))
    frame = lambda *part: Window.partitionBy(*part).orderBy("__us").rangeBetween(-(win - 1), 0)
    if _largest_key(df, key) <= block_rows:
        c = c.withColumn("n_in_window", F.count(F.lit(1)).over(frame(key)))
        return c.where(F.col("n_in_window") > limit).drop("__us")
    home = F.floor(F.col("__us") / F.lit(win))
    c = (c.withColumn("__tb", F.explode(F.array(home, home + 1))).withColumn("__home", F.col("__tb") == home)
          .withColumn("n_in_window", F.count(F.lit(1)).over(frame(key, "__tb"))))
    return c.where(F.col("__home") & (F.col("n_in_window") > limit)).drop("__us", "__tb", "__home")
