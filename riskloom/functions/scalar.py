"""Small scalar helpers shared by the operators (all JVM-side expressions)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")


def sdiv(n, d) -> Column:
    """NULL-safe division: NULL when the divisor is 0 or NULL (ANSI-safe)."""
    return F.try_divide(_c(n), _c(d))


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def rnd(c, digits: int = 6) -> Column:
    return F.round(_c(c), digits)


def null_if_sentinel(c, sentinel=365243) -> Column:
    return F.nullif(_c(c), F.lit(sentinel))


def null_if_infinite(c) -> Column:
    c = _c(c)
    return F.when(F.abs(c) == F.lit(INF), F.lit(None).cast("double")).otherwise(c)


def is_infinite(c) -> Column:
    return F.coalesce(F.abs(_c(c)) == F.lit(INF), F.lit(False))


def clamp_positive(c) -> Column:
    """x if x > 0 else 0 (NULL → 0, as the reference's lambda)."""
    c = _c(c)
    return F.when(c > 0, c).otherwise(F.lit(0).cast("double"))


def sum_cols(cols) -> Column:
    return reduce(lambda a, b: a + b, [_c(c) for c in cols])


def clip(c, lo, hi) -> Column:
    return F.least(F.greatest(_c(c), F.lit(lo)), F.lit(hi))


def safe_log(c) -> Column:
    c = _c(c)
    return F.when(c > 0, F.log(c))


def evaluate_once(df: DataFrame, keep: Sequence[str], named: dict[str, Column]) -> DataFrame:
    """Project ``keep`` plus ``named`` expressions, each evaluated once per row.

    A later filter on one of these columns would otherwise be pushed below the
    projection with the expression inlined, so an expensive expression (a
    keyword scan over a whole text) runs twice per row.  A one-element
    generator is a boundary such a filter is not pushed through."""
    return df.select(*keep, F.inline(F.array(F.struct(*[e.alias(n) for n, e in named.items()]))))
