"""Imports every operator module, so that its query registers."""

from __future__ import annotations

import importlib

from riskloom.llm.common import ORACLE, QUERIES
from riskloom.session import prepare

MODULES = ["mixing", "token_counts", "word_codec", "suffix_dedup", "quality_model", "quality_rules",
           "metric_join", "toxicity", "secret_scan", "shingle_join", "line_dedup", "token_alignment",
           "hard_negatives"]


def _ready(fn):
    def query(spark, sf_dir):
        prepare(spark)
        return fn(spark, sf_dir)
    return query


def queries():
    for m in MODULES:
        importlib.import_module(f"riskloom.llm.{m}")
    return {name: _ready(fn) for name, fn in QUERIES.items()}


def oracle_sql():
    queries()
    return dict(ORACLE)
