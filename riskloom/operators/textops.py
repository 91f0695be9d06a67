"""Frame-level text operators built from the expressions in functions.text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import text as TX


def enrich_articles(a: DataFrame) -> DataFrame:
    """All article annotators in one projection (no per-row Python) over the
    content lower-cased once."""
    return a.withColumn("__low", F.lower("content")).select(
        "doc_id", "ticker",
        TX.sentiment_label(F.col("title")).alias("label"),
        TX.event_types(F.col("__low"), TX.CONTENT_EVENT_PATTERNS).alias("key_events"),
        TX.sentiment_score(F.col("content"), F.col("__low")).alias("sentiment_score"),
        TX.impact_category(F.col("title"), F.col("description")).alias("impact_level"),
        F.lit(True).alias("nlp_processed"),
    )


def sentiment_summary(a: DataFrame, key: str = "ticker", order: str = "doc_id") -> DataFrame:
    """Per key: mean score, counts by ±0.1, trend of the newest 3 vs the rest (±0.1).

    The newest 3 ids per key come from a ``row_number() <= 3`` filter on the
    id columns alone (Spark limits it per map task before the shuffle, so a
    key with most of the documents is never sorted whole); they are joined
    back as a flag and every statistic is one grouped aggregation."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    newest = (a.select(key, order).withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= 3)
               .select(key, order, F.lit(True).alias("__new")))
    s = (a.select(key, order, TX.sentiment_score(F.col("content")).alias("sc"))
          .join(newest, [key, order], "left"))
    is_new = F.coalesce(F.col("__new"), F.lit(False))
    recent = F.avg(F.when(is_new, F.col("sc")))
    older = F.coalesce(F.avg(F.when(~is_new, F.col("sc"))), recent)
    n = F.count(F.lit(1))
    trend = (F.when(n < 2, "neutral").when(recent > older + 0.1, "improving")
              .when(recent < older - 0.1, "declining").otherwise("stable"))
    return s.groupBy(key).agg(
        F.avg("sc").alias("average_sentiment"), n.alias("total_articles"),
        F.count(F.when(F.col("sc") > 0.1, 1)).alias("positive_count"),
        F.count(F.when(F.col("sc") < -0.1, 1)).alias("negative_count"),
        F.count(F.when((F.col("sc") >= -0.1) & (F.col("sc") <= 0.1), 1)).alias("neutral_count"),
        trend.alias("trend"))


def impact_text(a: DataFrame, key: str = "ticker") -> DataFrame:
    hi = (TX.impact_category(F.col("title"), F.col("description")) == "high").cast("int")
    s = a.select(key, TX.sentiment_score(F.col("content")).alias("sc"), hi.alias("hi"))
    g = s.groupBy(key).agg(F.sum("hi").alias("n_hi"), F.avg("sc").alias("avg_sc"))
    msg = (F.when(F.col("n_hi") > 0, F.concat(F.lit("Significant credit-relevant events detected. "),
                                               F.col("n_hi").cast("string"),
                                               F.lit(" high-impact news items may affect creditworthiness.")))
            .when(F.col("avg_sc") > 0.2, "Positive news sentiment detected. Overall market confidence appears supportive of credit profile.")
            .when(F.col("avg_sc") < -0.2, "Negative news sentiment detected. Market concerns may create headwinds for credit quality.")
            .otherwise("Mixed news sentiment with no clear directional impact on credit risk."))
    return g.select(key, msg.alias("message"))


def batch_summary(df: DataFrame, batch: str, order: str, title: str, top: int = 5) -> DataFrame:
    """First ``top`` titles per batch joined by ' | ' (empty ones skipped) and
    the keyword sentence.  Only ``top`` rows per batch are collected."""
    w = Window.partitionBy(batch).orderBy(order)
    # a row_number filter: limited per map task before the shuffle
    r = df.select(batch, title, F.row_number().over(w).alias("__rn")).where(F.col("__rn") <= top)
    keep = F.col(title) != ""
    g = r.groupBy(batch).agg(F.array_sort(F.collect_list(F.when(keep, F.struct("__rn", title)))).alias("__h"))
    joined = F.array_join(F.transform("__h", lambda s: s[title]), " | ")
    return g.select(batch, joined.alias("headlines")).withColumn("summary", TX.summary_sentence(F.col("headlines")))
