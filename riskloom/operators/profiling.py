"""Column profiling and column-level cleaning decisions.

One aggregate pass computes every per-column statistic; the result is a
table with one row per column (bounded by the schema width), from which the
cleaning decisions (constant, non-variable, sparse columns) are derived.
Dropping columns is then a plain ``select`` on the original frame.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from riskloom.operators.aggregates import var_of

SPARSE_KEEP_SHARE = 0.3      # keep columns with non-null share > 0.3
MISSING_DROP_RATIO = 0.3     # drop columns with null share > 0.3
UNFILLED_THRESHOLD_PCT = 30  # share of columns with more than 30 % missing


def distinct_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column_name, n_unique): columns unpivoted to (column, value), so every
    column is one grouped count and no row is copied per column and key."""
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("v"))
                                          for c in cols])).alias("p")).select("p.*").where("v IS NOT NULL").distinct()
    return pairs.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_unique"))


def profile(df: DataFrame, cols: Sequence[str] | None = None, distinct: bool = False) -> DataFrame:
    """Per column: n, non-null, % missing, dtype, min, max, std, and ``n_unique``
    where ``distinct`` asks for it (NULL otherwise).  Without it the plan is one
    aggregate over one scan."""
    cols = list(cols or df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    aggs = [F.count(F.lit(1)).alias("__n")]
    for c in cols:
        x = F.col(f"`{c}`")
        num = isinstance(types[c], NumericType)
        aggs += [F.count(x).alias(f"nn__{c}"),
                 (F.min(x).cast("double") if num else F.lit(None).cast("double")).alias(f"mn__{c}"),
                 (F.max(x).cast("double") if num else F.lit(None).cast("double")).alias(f"mx__{c}"),
                 (F.sqrt(var_of(x.cast("double"))) if num else F.lit(None).cast("double")).alias(f"sd__{c}")]
    row = df.agg(*aggs)
    structs = [F.struct(F.lit(c).alias("column_name"), F.lit(types[c].simpleString()).alias("dtype"),
                        F.col(f"nn__{c}").alias("non_null"),
                        F.col(f"mn__{c}").alias("min"), F.col(f"mx__{c}").alias("max"),
                        F.col(f"sd__{c}").alias("std")) for c in cols]
    long = row.select("__n", F.explode(F.array(*structs)).alias("s")).select("__n", "s.*")
    if distinct:
        long = long.join(distinct_counts(df, cols), "column_name", "left").withColumn(
            "n_unique", F.coalesce("n_unique", F.lit(0).cast("bigint")))
    else:
        long = long.withColumn("n_unique", F.lit(None).cast("bigint"))
    return long.select("column_name", "dtype", F.col("__n").alias("n_rows"), "non_null",
                       ((F.col("__n") - F.col("non_null")) * 100.0 / F.nullif("__n", F.lit(0))).alias("pct_missing"),
                       "n_unique", "min", "max", "std")


def fill_rate(prof: DataFrame, top: int | None = None, include_full: bool = False) -> DataFrame:
    """% filled (half-even rounding as numpy) and bucket of 7; the ``top``
    fullest columns where a report asks for some."""
    taux = F.bround(F.lit(100.0) - F.col("pct_missing"), 0)
    r = prof.select("column_name", taux.alias("taux"))
    if not include_full:
        r = r.where(F.col("taux") < 99.99)
    if top is not None:
        r = r.orderBy(F.col("taux").desc(), F.col("column_name")).limit(top)
    return r.withColumn("bucket", F.floor(F.col("taux") / 7) * 7)


def decisions(prof: DataFrame) -> DataFrame:
    """Boolean cleaning decisions per column."""
    share = F.col("non_null") / F.nullif("n_rows", F.lit(0))  # a table without rows has no shares
    return prof.select(
        "column_name",
        (F.col("n_unique") == 1).alias("single_value"),
        F.coalesce(F.col("std") == 0, F.lit(False)).alias("non_var"),
        (share > SPARSE_KEEP_SHARE).alias("keep_sparse_rule"),
        ((F.lit(1.0) - share) > MISSING_DROP_RATIO).alias("drop_missing_rule"),
        (F.col("non_null") == F.col("n_rows")).alias("all_filled"),
        (F.col("non_null") < F.col("n_rows")).alias("has_nulls"),
    )


def drop_by(df: DataFrame, dec: DataFrame, flag: str, keep_when_true: bool = False) -> DataFrame:
    """Drop the columns whose decision ``flag`` is true (or keep only those).

    The decision table has one row per column, so collecting it is bounded
    by the schema width, not by the data.
    """
    hits = {r["column_name"] for r in dec.where(F.col(flag)).select("column_name").collect()}
    keep = [c for c in df.columns if (c in hits) == keep_when_true]
    return df.select(*[F.col(f"`{c}`") for c in keep])


def share_over_threshold(prof: DataFrame, threshold: float = UNFILLED_THRESHOLD_PCT) -> DataFrame:
    return prof.agg(F.avg((F.col("pct_missing") > threshold).cast("double")).alias("share_unfilled"),
                    F.count(F.lit(1)).alias("n_columns"))


def clean_name(name: str) -> str:
    """space → '_', strip [^A-Za-z0-9_], then one pass of '__' → '_'."""
    name = name.replace(" ", "_")
    name = re.sub("[^A-Za-z0-9_]+", "", name)
    return name.replace("__", "_")


def rename_clean(df: DataFrame) -> DataFrame:
    return df.toDF(*[clean_name(c) for c in df.columns])


def numeric_columns_only(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, NumericType)])


def downcast_plan(prof: DataFrame) -> DataFrame:
    """Narrowest type holding [min, max] (integers: tiny/small/int/bigint by
    strict bounds; floats: float when within float32 range, else double)."""
    mn, mx, dt = F.col("min"), F.col("max"), F.col("dtype")
    is_int = dt.isin("tinyint", "smallint", "int", "bigint")
    target = (F.when(is_int & (mn > -128) & (mx < 127), "tinyint")
               .when(is_int & (mn > -32768) & (mx < 32767), "smallint")
               .when(is_int & (mn > -2147483648) & (mx < 2147483647), "int")
               .when(is_int, "bigint")
               .when(dt.isin("float", "double") & (mn > -3.4028235e38) & (mx < 3.4028235e38), "float")
               .when(dt.isin("float", "double"), "double"))
    return prof.select("column_name", "dtype", target.alias("target_dtype"))


def infinite_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    inf = float("inf")
    row = df.agg(*[F.sum(F.coalesce((F.abs(F.col(c)) == inf).cast("int"), F.lit(0))).alias(f"i__{c}") for c in cols])
    structs = [F.struct(F.lit(c).alias("column_name"), F.col(f"i__{c}").alias("inf_count")) for c in cols]
    return row.select(F.explode(F.array(*structs)).alias("s")).select("s.*").where(F.col("inf_count") > 0)


def infinite_rows(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    inf = float("inf")
    any_inf = F.lit(False)
    for c in cols:
        any_inf = any_inf | F.coalesce(F.abs(F.col(c)) == inf, F.lit(False))
    return df.where(any_inf).select(key)
