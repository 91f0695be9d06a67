"""Quality classifier: hierarchical empirical Bayes over sites.

A logistic regression on plain text statistics gives each document its own
evidence.  Documents belong to a host and to a path of it.  Every host and path
adds up its documents' quality (the label where there is one, the classifier's
probability elsewhere) and gets a posterior mean:

    host = (sum + k0 * global) / (n + k0)
    path = (sum + k1 * host) / (n + k1)

``k0`` and ``k1`` are fitted by moments from the spread of rates between hosts,
and between paths of a host, beyond what their sizes explain; where hosts do
not differ they are large.  So sparse sites fall back on their host and on all
sites.  A document's log-odds are its evidence plus what its path's log-odds
add to the global ones; it is kept from ``KEEP`` on.

Sums are grouped aggregates with partial sums; the classifier is fitted on at
most ``TRAIN_ROWS`` labelled rows.

Results for special cases: null text counts as empty (its statistics are zero);
null hosts and paths are sites of their own; without labels of both classes
the evidence is even and everything is judged by the smoothed share of label
1; several labels of an id count as the highest; repeated rows give repeated
rows; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import SPACE, checkpointed, register, table
from riskloom.llm.quality_rules import base_counts

TRAIN_ROWS = 20_000
PENALTY = 1e-4
KEEP = 0.5
MAX_K = 1e4           # prior strength where sites do not differ
EDGE = 1e-4           # rates are kept this far from 0 and 1 in log-odds

STATS = [
    "least(sqrt(n_symbols / greatest(word_chars, 1)), 1) * 5",
    "least(sqrt(n_dup_lines / greatest(n_lines, 1)), 1) * 2",
    "least(sqrt(n_repeat_words / greatest(n_words, 1)), 1) * 4",
    "ln(greatest(word_chars, 1) / greatest(n_words, 1))",
    "ln(n_words + 1) / 2",
    "least(sqrt(n_marks / greatest(n_words, 1)), 2) * 2",
    "least(n_distinct / greatest(n_words, 1), 1) * 3",
    "least(sqrt(n_digits / greatest(word_chars, 1)), 1) * 2",
]


def evidence_stats(docs: DataFrame, id_col: str, text_col: str, host_col: str, path_cols: tuple[str, ...]) -> DataFrame:
    """(doc_id, host, path, stats) of every document."""
    site = lambda cols: F.to_json(F.struct(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(cols)]))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"),
                       site([host_col]).alias("host"), site([host_col, *path_cols]).alias("path"))
    rows = rows.select("*", F.regexp_count("text", F.lit("[.,!?;:]")).alias("n_marks"),
                       F.regexp_count("text", F.lit("[0-9]")).alias("n_digits"),
                       F.size(F.array_distinct(F.array_remove(F.split("text", f"{SPACE}+"), ""))).alias("n_distinct"))
    return base_counts(rows).select("doc_id", "host", "path", F.array(*[F.expr(s).cast("double") for s in STATS]).alias("stats"))


def classifier(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """``stats`` with ``evidence`` (log-odds) and ``p``.  ``labels``: (l_id, y)."""
    some = checkpointed(labels.orderBy(F.xxhash64("l_id"), "l_id").limit(TRAIN_ROWS))
    train = stats.join(F.broadcast(some), F.col("doc_id") == F.col("l_id")).select(
        array_to_vector("stats").alias("x"), F.col("y").cast("double").alias("y"))
    if train.select("y").distinct().count() < 2:
        return stats.withColumn("evidence", F.lit(0.0)).withColumn("p", F.lit(None).cast("double"))
    model = LogisticRegression(labelCol="y", featuresCol="x", regParam=PENALTY, maxIter=100).fit(train)
    w = model.coefficients.toArray().tolist()
    z = sum((F.get("stats", F.lit(i)) * v for i, v in enumerate(w)), F.lit(float(model.intercept)))
    return stats.withColumn("evidence", z).withColumn("p", 1 / (1 + F.exp(-F.col("evidence"))))


def _strength(sites: DataFrame, mean) -> float:
    """Prior strength by moments: between-site variance of rates is what is
    left of their squared deviations after the binomial part."""
    r = F.col("s") / F.col("n")
    # n * ((r - m)^2 - m (1 - m) / n), weighted by n
    row = sites.select(F.sum(F.col("n") * F.pow(r - mean, 2) - mean * (1 - mean)).alias("between"),
                       F.sum("n").alias("n"), F.sum(F.col("n") * mean * (1 - mean)).alias("inner")).first()
    if not row.n or row.between is None or row.inner is None or row.between <= 0 or row.inner <= 0:
        return MAX_K
    return min(max(row.inner / row.between - 1, 1.0), MAX_K)


def _logit(p):
    p = F.least(F.greatest(p, F.lit(EDGE)), F.lit(1 - EDGE))
    return F.log(p / (1 - p))


def quality_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  host_col: str = "source", path_cols: tuple[str, ...] = ("lang",), label_col: str = "quality",
                  train_only=None) -> DataFrame:
    """One row per document: ``evidence``, posterior means of its host and path,
    ``score`` and ``kept``.  ``train_only`` is a condition on label rows."""
    y = F.col(f"`{label_col}`")
    given = labels.where(y.isin(0, 1) & F.col("doc_id").isNotNull())
    given = given if train_only is None else given.where(train_only)
    given = given.groupBy(F.col("doc_id").alias("l_id")).agg(F.max(y).cast("int").alias("y"))
    stats = checkpointed(evidence_stats(docs, id_col, text_col, host_col, path_cols))
    rows = classifier(stats, given)
    known = rows.join(given, F.col("doc_id") == F.col("l_id"), "left").withColumn(
        "q", F.coalesce(F.col("y").cast("double"), F.col("p")))
    paths = checkpointed(known.where("q IS NOT NULL").groupBy("host", "path").agg(
        F.sum("q").alias("s"), F.count("*").cast("double").alias("n")))
    hosts = paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    total = hosts.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    mean = ((total.s or 0.0) + 1.0) / ((total.n or 0.0) + 2.0)
    k0 = _strength(hosts, F.lit(mean))
    hosts = checkpointed(hosts.select("host", ((F.col("s") + k0 * mean) / (F.col("n") + k0)).alias("host_mean")))
    with_host = paths.join(hosts, "host")
    k1 = _strength(with_host, F.col("host_mean"))
    sites = with_host.select("host", "path", "host_mean", (
        (F.col("s") + k1 * F.col("host_mean")) / (F.col("n") + k1)).alias("path_mean"))
    out = rows.join(sites.drop("host"), "path", "left").select(
        "doc_id", "evidence", F.coalesce("host_mean", F.lit(mean)).alias("host_mean"),
        F.coalesce("path_mean", F.lit(mean)).alias("path_mean"))
    z = F.col("evidence") + _logit(F.col("path_mean")) - (_logit(F.lit(mean)) if total.n else F.lit(0.0))
    return out.withColumn("score", 1 / (1 + F.exp(-z))).withColumn("kept", F.col("score") >= KEEP)


@register("op5_quality_model")
def q_quality_model(spark, sf_dir):
    return quality_model(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
