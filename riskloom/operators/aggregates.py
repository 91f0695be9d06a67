"""Keyed multi-statistic aggregation.

All statistics of one key are produced by a single ``groupBy().agg()`` so
Spark plans one partial (map-side) aggregation and one shuffle on the key.
A hot key therefore costs one partial row per map task, not a hot reducer.
Category shares are ``avg(col <=> v)`` expressions instead of a physical
one-hot table; conditional subsets (active / closed ...) are conditional
aggregates in the same pass instead of extra group-bys and joins.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAT_FUNCS = ("min", "max", "mean", "sum", "var", "size", "nunique", "std", "median")


# Sums, means and variances accumulate in doubles; their last bits depend on
# the order of rows, so registered queries round their output.  Infinities and
# NaN stay what they are.
def sum_of(x: Column) -> Column:
    return F.sum(x.cast("double"))


def mean_of(x: Column) -> Column:
    return F.avg(x)


def var_of(x: Column, ddof: int = 1) -> Column:
    """NULL where fewer than ``ddof + 1`` values are there."""
    return F.var_samp(x) if ddof == 1 else F.var_pop(x)


def stat_expr(fn: str, c: Column, cond: Column | None = None, integral: bool = False) -> Column:
    """One pandas-style statistic as a Spark aggregate.

    pandas semantics: ``sum`` of only NULLs is 0, ``var`` has ddof=1,
    ``size`` counts rows including NULLs, ``nunique`` ignores NULLs.  With a
    ``cond`` (subset aggregation in one pass) a key without any subset row
    yields NULL for every statistic, as the reference's separate subset
    aggregate followed by a left join does.
    """
    x = c if cond is None else F.when(cond, c)
    if fn == "min":
        e = F.min(x)
    elif fn == "max":
        e = F.max(x)
    elif fn == "mean":
        e = mean_of(x)
    elif fn == "sum":
        if integral:
            e = F.coalesce(F.sum(x), F.lit(0).cast("bigint"))
        else:
            e = F.coalesce(sum_of(x), F.lit(0.0))
    elif fn == "var":
        e = var_of(x)
    elif fn == "std":
        e = F.sqrt(var_of(x))
    elif fn == "median":
        e = F.percentile(x, 0.5)
    elif fn == "size":
        e = F.count(F.lit(1)) if cond is None else F.count(F.when(cond, F.lit(1)))
    elif fn == "nunique":
        e = F.count_distinct(x)
    else:
        raise ValueError(f"unknown statistic {fn!r}")
    if cond is not None and fn in ("sum", "size", "nunique"):
        e = F.when(F.count(F.when(cond, F.lit(1))) > 0, e)
    return e


def stat_name(prefix: str, col: str, fn: str) -> str:
    return f"{prefix}{col}_{fn.upper()}"


def multi_stat_exprs(spec: Mapping[str, Sequence[str]], prefix: str = "",
                     cond: Column | None = None, integral: Iterable[str] = ()) -> list[Column]:
    """``{col: [fn, ...]}`` → aliased aggregate columns ``PREFIX_COL_FN``.

    ``integral`` names the integer-typed columns (their sums stay integers).
    """
    integral = set(integral)
    out = []
    for col, fns in spec.items():
        for fn in fns:
            out.append(stat_expr(fn, F.col(col), cond, col in integral).alias(stat_name(prefix, col, fn)))
    return out


def integral_columns(df: DataFrame) -> set[str]:
    from pyspark.sql.types import IntegralType
    return {f.name for f in df.schema.fields if isinstance(f.dataType, IntegralType)}


def clean_token(v) -> str:
    """Category value → column-name token (non-alphanumerics become '_')."""
    return re.sub(r"[^0-9A-Za-z]+", "_", str(v)).strip("_") or "blank"


MAX_CATEGORIES = 20_000   # values of all category columns together; each becomes an output column


def category_values(pairs: DataFrame) -> dict[str, list]:
    """Sorted distinct values ``v`` of each column name ``k``.  No more than
    ``MAX_CATEGORIES`` + 1 rows reach the driver; more values than that are an
    error, as they would be columns."""
    found = pairs.where(F.col("v").isNotNull()).distinct().limit(MAX_CATEGORIES + 1).collect()
    if len(found) > MAX_CATEGORIES:
        raise ValueError(f"more than {MAX_CATEGORIES} category values would become columns; "
                         f"leave out the columns that are no categories: {sorted({r['k'] for r in found})}")
    vocab: dict[str, list] = {}
    for r in found:
        vocab.setdefault(r["k"], []).append(r["v"])
    return {k: sorted(vs) for k, vs in vocab.items()}


def discover_vocabulary(df: DataFrame, cols: Sequence[str]) -> dict[str, list]:
    """Distinct values per categorical column in one distributed job."""
    if not cols:
        return {}
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in cols
    ])).alias("p")).select("p.k", "p.v")
    vocab = category_values(pairs)
    return {c: vocab.get(c, []) for c in cols}


def category_tokens(values: Sequence) -> dict:
    """Column-name token of each category value.  Values whose tokens would be
    equal (up to letter case) get the value's CRC appended, so names stay unique
    whatever the other values are."""
    plain = [clean_token(v).lower() for v in values]
    return {v: clean_token(v) if plain.count(p) == 1 and p != "nan" else f"{clean_token(v)}_{zlib.crc32(str(v).encode()):08x}"
            for v, p in zip(values, plain)}


def category_share_exprs(vocab: Mapping[str, Sequence], prefix: str = "", suffix: str = "_MEAN",
                         nan_category: bool = True) -> list[Column]:
    """Mean of the one-hot indicator of each category value per key.

    ``avg(col <=> v)`` equals the mean of pandas' dummy column; the NaN
    dummy is ``avg(col IS NULL)``.
    """
    out = []
    for col, values in vocab.items():
        for v, token in category_tokens(values).items():
            out.append(F.avg(F.col(col).eqNullSafe(F.lit(v)).cast("double")).alias(f"{prefix}{col}_{token}{suffix}"))
        if nan_category:
            out.append(F.avg(F.col(col).isNull().cast("double")).alias(f"{prefix}{col}_nan{suffix}"))
    return out


def one_hot_exprs(vocab: Mapping[str, Sequence], nan_category: bool = False,
                  keep: Iterable[str] = ()) -> list[Column]:
    """Indicator columns (0/1 int) per category value, for row-level one-hot."""
    out = [F.col(k) for k in keep]
    for col, values in vocab.items():
        for v, token in category_tokens(values).items():
            out.append(F.col(col).eqNullSafe(F.lit(v)).cast("int").alias(f"{col}_{token}"))
        if nan_category:
            out.append(F.col(col).isNull().cast("int").alias(f"{col}_nan"))
    return out


def agg_multi_stat(df: DataFrame, key: str, spec: Mapping[str, Sequence[str]], prefix: str,
                   vocab: Mapping[str, Sequence] | None = None,
                   subsets: Mapping[str, Column] | None = None,
                   count_name: str | None = None) -> DataFrame:
    """Group by ``key``: statistics, category shares and conditional subsets.

    NULL keys are dropped first (pandas drops NaN group keys).
    """
    ints = integral_columns(df)
    exprs = multi_stat_exprs(spec, prefix, integral=ints)
    if vocab:
        exprs += category_share_exprs(vocab, prefix)
    for sub_prefix, cond in (subsets or {}).items():
        exprs += multi_stat_exprs(spec, sub_prefix, cond, integral=ints)
    if count_name:
        exprs.append(F.count(F.lit(1)).alias(count_name))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*exprs)


def agg_all_columns(df: DataFrame, key: str, prefix: str, fns: Sequence[str] = ("min", "max", "mean", "sum", "var"),
                    exclude: Sequence[str] = (), count_name: str | None = None) -> DataFrame:
    """Every non-key numeric column × every statistic (generated from the schema)."""
    from pyspark.sql.types import NumericType
    cols = [f.name for f in df.schema.fields
            if f.name != key and f.name not in exclude and isinstance(f.dataType, NumericType)]
    return agg_multi_stat(df, key, {c: list(fns) for c in cols}, prefix, count_name=count_name)
