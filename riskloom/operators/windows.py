"""Per-key ordered window features.

All features of one panel share a single ``Window.partitionBy(key)
.orderBy(order)`` specification so Catalyst plans one hash exchange and one
sort for all of them; different frames (lag, rolling-N, running) reuse that
distribution.  "N days" in the reference means N *rows* (§2.15-B3): frames are
``rowsBetween``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from riskloom.functions.scalar import sdiv


def key_window(key: str | Sequence[str], order: str | Sequence[str]) -> WindowSpec:
    keys = [key] if isinstance(key, str) else list(key)
    orders = [order] if isinstance(order, str) else list(order)
    return Window.partitionBy(*keys).orderBy(*orders)


def last_n(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def rest(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(0, Window.unboundedFollowing)


def with_min_periods(c: Column, w: WindowSpec, n: int, k: int, value: Column) -> Column:
    """``value`` only where the N-row frame holds at least ``k`` non-NULL ``c``."""
    return F.when(F.count(c).over(last_n(w, n)) >= k, value)


def rolling_mean(c, w: WindowSpec, n: int, min_periods: int | None = None) -> Column:
    """Mean over the trailing n rows."""
    c = F.col(c) if isinstance(c, str) else c
    return with_min_periods(c, w, n, n if min_periods is None else min_periods, F.avg(c).over(last_n(w, n)))


def rolling_std(c, w: WindowSpec, n: int, min_periods: int | None = None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    k = n if min_periods is None else min_periods
    # ddof=1; a frame with one value has no sample std (NULL), like pandas.
    return with_min_periods(c, w, n, max(k, 1), F.stddev_samp(c).over(last_n(w, n)))


def rolling_corr(a, b, w: WindowSpec, n: int) -> Column:
    """pandas ``a.rolling(n).corr(b)``: needs n complete (a, b) pairs."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    both = a.isNotNull() & b.isNotNull()
    fr = last_n(w, n)
    pa, pb = F.when(both, a), F.when(both, b)
    # covariance / (std·std) with try_divide: a constant frame gives NULL
    # (the built-in corr raises under ANSI when a variance is zero)
    r = F.try_divide(F.covar_samp(pa, pb).over(fr), F.stddev_samp(pa).over(fr) * F.stddev_samp(pb).over(fr))
    return F.when(F.count(F.when(both, F.lit(1))).over(fr) == n, r)


def lag_n(c, w: WindowSpec, n: int) -> Column:
    return F.lag(c, n).over(w)


def ffill(c, w: WindowSpec) -> Column:
    return F.last(c, ignorenulls=True).over(running(w))


def bfill(c, w: WindowSpec) -> Column:
    return F.first(c, ignorenulls=True).over(rest(w))


def pct_change(df: DataFrame, col: str, w: WindowSpec, n: int, out: str) -> DataFrame:
    """pandas ``groupby(key)[col].pct_change(n)`` (forward fill first, §2.15-C).

    Division by zero gives NULL (pandas: ±inf, later treated as missing).
    """
    tmp = f"__ff_{out}"
    df = df.withColumn(tmp, ffill(F.col(col), w))
    return df.withColumn(out, sdiv(F.col(tmp), F.lag(F.col(tmp), n).over(w)) - F.lit(1.0)).drop(tmp)


def diff_n(c, w: WindowSpec, n: int) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c - F.lag(c, n).over(w)


def rsi(c, w: WindowSpec, n: int = 14) -> tuple[Column, Column, None]:
    """(gain, loss) expressions; ``rsi_from`` then averages them over n rows
    (two steps because the rolling means are windows over these columns).
    The first delta is NULL and becomes gain = loss = 0 (pandas ``where``)."""
    c = F.col(c) if isinstance(c, str) else c
    delta = c - F.lag(c, 1).over(w)
    gain = F.when(delta > 0, delta).otherwise(F.lit(0.0))
    loss = F.when(delta < 0, -delta).otherwise(F.lit(0.0))
    return gain, loss, None


def rsi_from(gain: str, loss: str, w: WindowSpec, n: int = 14) -> Column:
    fr = last_n(w, n)
    full = F.count(F.lit(1)).over(fr) >= n
    g = F.avg(gain).over(fr)
    lo = F.avg(loss).over(fr)
    return (F.when(full & (lo == 0) & (g > 0), F.lit(100.0))
             .when(full & (lo > 0), F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + g / lo)))


def volume_spike(volume, trend) -> Column:
    volume = F.col(volume) if isinstance(volume, str) else volume
    trend = F.col(trend) if isinstance(trend, str) else trend
    return F.coalesce(volume > trend * 2, F.lit(False)).cast("double")


def group_mean_relative(df: DataFrame, col: str, keys: Sequence[str], out: str) -> DataFrame:
    """``out`` = col / mean(col) of the row's group.  The mean is a grouped
    aggregate (partial aggregation before the shuffle) joined back on the keys
    (NULL-safe), so a large group is never buffered whole in one task, as an
    unordered window partition would be."""
    keys = list(keys)
    m = df.groupBy(*keys).agg(F.avg(col).alias("__gm")).select(*[F.col(k).alias(f"__g_{k}") for k in keys], "__gm")
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__g_{k}"))
        cond = c if cond is None else cond & c
    j = df.join(m, cond, "left")
    return j.select(*[F.col(c) for c in df.columns], sdiv(F.col(col), F.col("__gm")).alias(out))


def trend_slope_last_n(df: DataFrame, key: str, order: str, col: str, n: int, out: str) -> DataFrame:
    """Slope of a least-squares line through the last ``n`` values per key,
    written to every row of the key (reference behaviour, look-ahead included).
    Keys with fewer than ``n`` rows get NULL."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    last = (df.select(key, col, F.row_number().over(w).alias("__rn"))
              .where(F.col("__rn") <= n)
              .groupBy(key)
              .agg(F.when(F.count(F.lit(1)) == n,
                          F.regr_slope(F.col(col), (F.lit(n) - F.col("__rn")).cast("double"))).alias(out)))
    return df.join(last, key, "left")




# ---------------------------------------------------------------------------
# Hot keys: ordered row frames split into blocks.
#
# A window partitioned by key alone sends every row of a key to one task; a
# ticker holding a third of all ticks would be sorted and scanned by one
# core.  Frames that look back at most ``lookback`` rows are split exactly:
#
# 1. each row gets its exact 0-based position ``__i`` within its key
#    (distributed prefix counts, ``ranks.value_counts_ranked``);
# 2. a key is cut into blocks of ``block_rows`` positions, and the last
#    ``lookback`` rows of a block are copied into the next block as halo rows;
# 3. windows run over (key, block) ordered by ``__i``; only home rows are kept.
#
# A home row's frame then sees exactly the rows it would see in the unsplit
# window.  Forward fill looks back without limit, so it is done before
# blocking: a running last value inside each block plus the carried last
# value of earlier blocks (a table with one row per block).
BLOCK_ROWS = 1 << 16


def row_position(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Adds ``__i``: the 0-based position of each row within its key in
    ``order`` (which must be unique within a key, e.g. time + event id)."""
    from riskloom.operators.ranks import value_counts_ranked
    d = df.withColumn("__o", F.struct(*[F.col(c) for c in order]))
    r = value_counts_ranked(d.select(key, "__o"), "__o", group=key)
    return d.join(r.select(key, "__o", F.col("n_before").alias("__i")), [key, "__o"]).drop("__o")


def ffill_positioned(df: DataFrame, key: str, cols: dict[str, str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact forward fill over ``__i`` (``cols``: source → output column)."""
    d = df.withColumn("__fb", F.floor(F.col("__i") / F.lit(block_rows)))
    wb = Window.partitionBy(key, "__fb").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    d = d.select("*", *[F.last(F.col(c), ignorenulls=True).over(wb).alias(f"__run_{o}") for c, o in cols.items()])
    last = d.groupBy(key, "__fb").agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("__i"))).alias(f"__last_{o}") for c, o in cols.items()])
    before = Window.partitionBy(key).orderBy("__fb").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select(key, "__fb", *[F.last(f"__last_{o}", ignorenulls=True).over(before).alias(f"__carry_{o}")
                                       for o in cols.values()])
    d = d.join(carry, [key, "__fb"], "left")
    d = d.select("*", *[F.coalesce(F.col(f"__run_{o}"), F.col(f"__carry_{o}")).alias(o) for o in cols.values()])
    return d.drop("__fb", *[f"__run_{o}" for o in cols.values()], *[f"__carry_{o}" for o in cols.values()])


def halo_blocks(df: DataFrame, key: str, lookback: int, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, WindowSpec]:
    """Positioned rows → (rows with ``__b`` and ``__home``, window over the blocks)."""
    if lookback > block_rows:
        raise ValueError("lookback must not exceed block_rows")
    blk = F.floor(F.col("__i") / F.lit(block_rows))
    halo = (F.col("__i") % F.lit(block_rows)) >= F.lit(block_rows - lookback)
    d = (df.withColumn("__b", F.explode(F.when(halo & F.lit(lookback > 0), F.array(blk, blk + 1)).otherwise(F.array(blk))))
           .withColumn("__home", F.col("__b") == blk))
    return d, Window.partitionBy(key, "__b").orderBy("__i")


def home_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col("__home")).drop("__b", "__home", "__i")


def pct_change_filled(filled: str, w: WindowSpec, n: int) -> Column:
    """pct_change over an already forward-filled column."""
    return sdiv(F.col(filled), F.lag(F.col(filled), n).over(w)) - F.lit(1.0)


def key_frames(df: DataFrame, key: str, order: Sequence[str], lookback: int,
               ffill: dict[str, str] | None = None, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, WindowSpec]:
    """Rows ready for per-key frames that look back at most ``lookback`` rows.

    Decided at run time from the largest key (one aggregate row): if every
    key fits in one block, the plain window partitioned by key is used (one
    exchange); otherwise keys are split into exact halo blocks.  Either way
    the result carries ``__i`` / ``__b`` / ``__home``; finish with
    ``home_rows``.  ``ffill`` maps columns to forward-filled outputs.
    """
    largest = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).agg(F.max("__n")).first()[0] or 0
    if largest > block_rows:
        p = row_position(df, key, order)
        if ffill:
            p = ffill_positioned(p, key, ffill, block_rows)
        return halo_blocks(p, key, lookback, block_rows)
    w = Window.partitionBy(key).orderBy(*order)
    d = df.withColumn("__b", F.lit(0)).withColumn("__home", F.lit(True)).withColumn("__i", F.lit(0))
    if ffill:
        d = d.select("*", *[F.last(F.col(c), ignorenulls=True).over(running(w)).alias(o) for c, o in ffill.items()])
    return d, w


def _largest_key(df: DataFrame, key: str | Sequence[str]) -> int:
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).agg(F.max("__n")).first()[0] or 0


def newest_n(df: DataFrame, key: str, order: Sequence[str], n: int, out: str = "recency",
             block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Newest ``n`` rows per key by ``order`` (unique within a key), with
    ``out`` = 1 for the newest.  For n up to the window group limit, or keys
    within a block: a window per key.  Otherwise (large n and a key larger
    than a block): exact positions from distributed prefix counts, so its
    rows are never sorted by one task."""
    # n within Spark's window group limit: the row_number filter is cut to n
    # rows per key in every map task before the shuffle -- hot keys are safe
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n <= limit or _largest_key(df, key) <= block_rows:
        w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
        return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)
    p = row_position(df, key, order)
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))  # one row per key
    return (p.join(sizes, key).withColumn(out, (F.col("__n") - F.col("__i")).cast("int"))
             .where(F.col(out) <= n).drop("__i", "__n"))
