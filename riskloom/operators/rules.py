"""Rule tables expressed as ``when`` chains.

Fixed values: all thresholds and labels below are the reference's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def risk_level(score) -> Column:
    """0-100 score: >= 80 low, >= 60 medium, >= 40 high, else very_high."""
    s = _c(score)
    return (F.when(s >= 80, "low").when(s >= 60, "medium").when(s >= 40, "high")
             .when(s.isNotNull(), "very_high"))


def cut_bins(score) -> Column:
    """Right-closed bins (0,550] High, (550,700] Medium, (700,850] Low."""
    s = _c(score)
    return (F.when((s > 0) & (s <= 550), "High").when((s > 550) & (s <= 700), "Medium")
             .when((s > 700) & (s <= 850), "Low"))


def risk_band(p, high: float = 0.8, low: float = 0.2) -> Column:
    p = _c(p)
    return F.when(p > high, "high").when(p < low, "low").when(p.isNotNull(), "medium")


def market_cap_bucket(cap) -> Column:
    c = _c(cap)
    return (F.when(c > 200_000_000_000, "mega_cap").when(c > 10_000_000_000, "large_cap")
             .when(c > 2_000_000_000, "mid_cap").otherwise("small_cap"))


def ensemble_blend(weighted: Sequence[tuple[str, float]]) -> Column:
    """Σ w_i·p_i / Σ w_i (weights are a parameter; the reference ships two sets)."""
    num = None
    for c, w in weighted:
        t = _c(c) * F.lit(float(w))
        num = t if num is None else num + t
    return num / F.lit(float(sum(w for _, w in weighted)))


def ensemble_blend_sql(weighted: Sequence[tuple[str, float]]) -> str:
    num = " + ".join(f"{c} * {float(w)!r}" for c, w in weighted)
    return f"({num}) / {float(sum(w for _, w in weighted))!r}"


SEVERITY_ORDER = ["critical", "high", "medium", "low"]


def severity_rank(sev) -> Column:
    s = _c(sev)
    e = F.lit(len(SEVERITY_ORDER))
    for i, v in reversed(list(enumerate(SEVERITY_ORDER))):
        e = F.when(s == v, F.lit(i)).otherwise(e)
    return e


def trend_label(delta, up: float = 2.0, down: float = -2.0, pos="improving", neg="declining", flat="neutral") -> Column:
    d = _c(delta)
    return F.when(d > up, pos).when(d < down, neg).otherwise(flat)


def flag_from_text(c) -> Column:
    """'true', '1', 't', 'y' (any case) → true."""
    return F.coalesce(F.lower(F.trim(_c(c))).isin("true", "1", "t", "y"), F.lit(False))


def validate_ticker(c) -> Column:
    """Non-empty, at most 10 characters, letters and digits only."""
    return F.coalesce(_c(c).rlike(r"^[\p{L}\p{N}]{1,10}$"), F.lit(False))
