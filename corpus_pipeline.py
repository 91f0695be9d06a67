"""The corpus pipeline: quality rules, near duplicates, secrets, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read back as the next stage's documents.  All but the
last return the columns of ``documents``.

1. ``quality_rules`` drops documents that the rules reject.
2. ``near_duplicates`` keeps the smallest id of each class of documents that
   are alike (five-word shingles, similarity 0.8).
3. ``secrets`` masks secret spans in texts; candidates count as live below
   ``EXAMPLE_OWNERS`` owners and ``EXAMPLE_REPOS`` repositories.
4. ``mixing`` orders rows so that sources interleave by target weight.
5. ``tokens`` encodes every text; one row per document with its ids, and its
   slot and place in the mixture (worked out again: files and blocks keep no
   order).  Sorting by slot and place gives the mixture.

Extra columns, whatever their names, pass the first four stages unchanged.
Null or empty texts fail the quality rules.  Rows that share an id share their
class; repeated rows with the smallest id of a class all stay.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from riskloom.llm.mixing import mix
from riskloom.llm.quality_rules import passing
from riskloom.llm.secret_scan import mask_secrets
from riskloom.llm.shingle_join import near_documents
from riskloom.llm.word_codec import encode
from riskloom.session import ensure_checkpoint_dir, prepare

ORACLE_SQL = None  # BPE encoding and robust estimates are beyond SQL; tests use a brute-force version


def quality_rules(spark, docs, sf_dir):
    prepare(spark)
    return passing(docs)


def near_duplicates(spark, docs, sf_dir):
    prepare(spark)
    classes = near_documents(docs.select("doc_id", "text"), width=5, percent=80)
    losers = classes.where("component_id <> doc_id").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(losers, docs["doc_id"] == losers["__id"], "left_anti")


def secrets(spark, docs, sf_dir):
    prepare(spark)
    return mask_secrets(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def mixing(spark, docs, sf_dir):
    prepare(spark)
    at = "mix_place"
    while at in docs.columns:
        at += "_"
    return mix(docs, out_col=at).orderBy(f"{at}.slot", f"{at}.place").drop(at)


def tokens(spark, docs, sf_dir):
    prepare(spark)
    import public_tokenizers
    placed = mix(docs.select("doc_id", "source", "text")).select("doc_id", "text", F.col("mix_place.slot").cast("long").alias("slot"),
                              F.col("mix_place.place").cast("long").alias("place"))
    ids = encode(placed, public_tokenizers.path("word_bpe_49k.json"), carry=("slot", "place"))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "slot", "place")


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("secrets", secrets),
          ("mixing", mixing), ("tokens", tokens)]


def run(spark, sf_dir):
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = os.path.join(ensure_checkpoint_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
