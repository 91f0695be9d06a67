"""Imports every plan module so their queries register, then exposes them."""

from __future__ import annotations

import functools
import importlib

from riskloom.plans.common import ORACLE, QUERIES
from riskloom.session import prepare

PLAN_MODULES = [
    "riskloom.plans.client_features",
    "riskloom.plans.company_panel",
    "riskloom.plans.portfolio",
    "riskloom.plans.text_queries",
    "riskloom.plans.alerts_queries",
    "riskloom.plans.profiling_queries",
    "riskloom.plans.stats_queries",
    "riskloom.plans.sets_queries",
    "riskloom.plans.monitoring_queries",
    "riskloom.plans.explain_queries",
    "riskloom.plans.source_queries",
    "riskloom.plans.misc_queries",
    "riskloom.plans.ml_queries",
    "riskloom.plans.stream_queries",
    "riskloom.plans.history_queries",
]

for _m in PLAN_MODULES:
    importlib.import_module(_m)


def _ready(fn):
    return functools.wraps(fn)(lambda spark, sf_dir: fn(prepare(spark), sf_dir))


def queries():
    return {name: _ready(fn) for name, fn in QUERIES.items()}


def oracle_sql():
    return dict(ORACLE)
