"""Named ratio columns of applications, previous applications and instalments
(SURVEY §2.2).  A ratio is NULL where its divisor is 0 or NULL; the sentinel of
day columns counts as NULL first."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.scalar import null_if_sentinel, sdiv

# Ratio → (dividend, divisor).
APPLICATION_RATIOS = {
    "DAYS_EMPLOYED_PERC": ("DAYS_EMPLOYED", "DAYS_BIRTH"),
    "INCOME_CREDIT_PERC": ("AMT_INCOME_TOTAL", "AMT_CREDIT"),
    "INCOME_PER_PERSON": ("AMT_INCOME_TOTAL", "CNT_FAM_MEMBERS"),
    "ANNUITY_INCOME_PERC": ("AMT_ANNUITY", "AMT_INCOME_TOTAL"),
    "PAYMENT_RATE": ("AMT_ANNUITY", "AMT_CREDIT"),
}
PREVIOUS_RATIOS = {"APP_CREDIT_PERC": ("AMT_APPLICATION", "AMT_CREDIT")}
SENTINEL_COLS = ("DAYS_EMPLOYED",)


def ratio_columns(df: DataFrame, ratios: Mapping[str, tuple[str, str]], sentinels: tuple[str, ...] = SENTINEL_COLS) -> DataFrame:
    """``df`` with one column per ratio, in one projection."""
    def value(c):
        x = F.col(f"`{c}`")
        return (null_if_sentinel(x) if c in sentinels else x).cast("double")
    return df.select("*", *[sdiv(value(a), value(b)).alias(name) for name, (a, b) in ratios.items()])
