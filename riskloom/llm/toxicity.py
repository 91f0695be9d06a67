"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes
log-count ratios.

Texts are lower-cased, white space runs become one space, and the byte n-grams
of ``ORDERS`` are hashed to ``2 ** HASH_BITS`` numbers.  A feature is the
presence of an n-gram, scaled by its log-count ratio

    r = log((pos + 1) / (P + 2)) - log((neg + 1) / (N + 2))

over labelled texts, and a logistic regression weighs the ``FEATURES`` n-grams
that depend most on the label (by chi-square).  Labels come from at most
``TRAIN_ROWS`` labelled rows (the smallest hashes of their ids); counts,
selection and fit are Spark jobs, and what reaches the driver is one number
per selected n-gram.  Every text is scored whole.

Results for special cases: null text counts as empty, and a text without any
selected n-gram gets the model's base rate; without labels of both classes
every score is the share of label 1, smoothed; several labels of one id count
as the highest; a null id is scored and never held out; repeated rows give
repeated rows; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import checkpointed, register, table, text_of

ORDERS = (3, 5)
HASH_BITS = 18
FEATURES = 2048
LEAST_ROWS = 4         # labelled texts that must hold a selected n-gram
TRAIN_ROWS = 20_000
PENALTY = 1e-3
PREDICT = 0.7


def grams(text: str) -> np.ndarray:
    """Hashes of all n-grams of a text, with repeats."""
    b = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode(), np.uint8).astype(np.uint32) + np.uint32(1)
    out = []
    for n in ORDERS:
        if len(b) < n:
            continue
        h = b[:len(b) - n + 1].copy()
        for i in range(1, n):
            h *= np.uint32(0x9E3779B1)
            h += b[i:len(b) - n + 1 + i]
        h = h * np.uint32(0x85EBCA6B) + np.uint32(n * 0x27D4EB2F & 0xFFFFFFFF)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        out.append(h >> np.uint32(32 - HASH_BITS))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _counts(train: DataFrame) -> DataFrame:
    """(gram, pos, neg): labelled texts of either class that hold a gram."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 1 << HASH_BITS), np.int64)
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n[y, np.unique(grams(text))] += 1
        some = np.flatnonzero(n.any(axis=0))
        yield pa.RecordBatch.from_pydict({"gram": some, "neg": n[0, some], "pos": n[1, some]})
    return (train.select("text", "y").mapInArrow(count, "gram long, neg long, pos long")
            .groupBy("gram").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic") -> tuple[np.ndarray, np.ndarray, float]:
    """(gram numbers, weight of each, base): score = sigmoid(base + weights of
    the grams that a text holds)."""
    y = F.col(f"`{label_col}`")
    rows = labels.where(y.isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.max(y).cast("int").alias("y"))
    some = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS).withColumnRenamed("doc_id", "l_id")
    # at most TRAIN_ROWS rows of 12 bytes; the texts that they name are read once
    train = checkpointed(docs.join(F.broadcast(checkpointed(some)), F.col("doc_id") == F.col("l_id")).select("text", "y"))
    totals = {r.y: r["count"] for r in train.groupBy("y").count().collect()}
    p, n = totals.get(1, 0), totals.get(0, 0)
    none = np.empty(0, np.int64), np.empty(0)
    if not p or not n:
        return *none, math.log((p + 1) / (n + 1))
    expect = (F.col("pos") + F.col("neg")) * (p / (p + n))
    best = (_counts(train).where(F.col("pos") + F.col("neg") >= LEAST_ROWS)
            .withColumn("score", F.pow(F.col("pos") - expect, 2) / expect)
            .orderBy(F.desc("score"), "gram").limit(FEATURES).orderBy("gram").collect())
    if not best:
        return *none, math.log((p + 1) / (n + 1))
    chosen = np.array([r.gram for r in best])
    ratio = np.array([math.log((r.pos + 1) / (p + 2)) - math.log((r.neg + 1) / (n + 2)) for r in best])
    place = np.full(1 << HASH_BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [np.unique(place[grams(x)]) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"at": pa.array([a[a >= 0] for a in at], pa.list_(pa.int32())),
                                              "y": batch.column(1)})
    size, scale = len(chosen), ratio.tolist()
    vector = F.udf(lambda at: SparseVector(size, at, [scale[i] for i in at]), VectorUDT())
    data = checkpointed(train.mapInArrow(vectors, "at array<int>, y int"))
    model = LogisticRegression(labelCol="y", featuresCol="x", regParam=PENALTY, elasticNetParam=0.0, standardization=False,
                               maxIter=100).fit(data.select(vector("at").alias("x"), F.col("y").cast("double").alias("y")))
    return chosen, model.coefficients.toArray() * ratio, float(model.intercept)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """(doc_id, score) for rows of (doc_id, text)."""
    chosen, weight, base = model
    types = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << HASH_BITS, -1, np.int32)
        place[chosen] = np.arange(len(chosen))
        for batch in batches:
            z = np.full(batch.num_rows, base)
            for i, text in enumerate(batch.column(1).to_pylist()):
                at = place[grams(text)]
                z[i] += weight[np.unique(at[at >= 0])].sum()
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))],
                                             schema=types)
    return docs.mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic") -> DataFrame:
    """One row per document: ``held_out``, ``score``, ``predicted``."""
    rows = text_of(docs, id_col, text_col)
    out = score(rows, fit(rows, labels, label_col))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= PREDICT).cast("int").alias("predicted"))


@register("op8_toxicity")
def q_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
