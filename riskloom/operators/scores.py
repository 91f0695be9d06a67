"""Ratios, normalisations and composite scores.

All are column expressions (projection, whole-stage codegen).  Whole-table
statistics (min/max for normalisation) come from one aggregate row that is
broadcast-joined back: a one-row side is bounded by construction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.scalar import sdiv


def nclip(c: Column, lo: float, hi: float) -> Column:
    """pandas ``clip``: NULL stays NULL (``least``/``greatest`` skip NULLs)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


# ------------------------------------------------------------- ratios
def financial_ratios(df: DataFrame) -> DataFrame:
    """Ten balance-sheet ratios; optional inputs (gross_profit, inventory,
    cash) fall back to NULL / 0 as in the reference."""
    cols = set(df.columns)
    c = F.col
    inventory = c("inventory") if "inventory" in cols else F.lit(0.0)
    cash = c("cash") if "cash" in cols else F.lit(0.0)
    gross = sdiv("gross_profit", "revenue") if "gross_profit" in cols else F.lit(None).cast("double")
    return df.select(
        "*",
        sdiv("total_debt", "shareholders_equity").alias("debt_to_equity_ratio"),
        sdiv("current_assets", "current_liabilities").alias("current_ratio"),
        sdiv("net_income", "total_assets").alias("roa"),
        sdiv("net_income", "shareholders_equity").alias("roe"),
        sdiv("revenue", "total_assets").alias("asset_turnover"),
        sdiv("total_debt", "total_assets").alias("debt_ratio"),
        sdiv("net_income", "revenue").alias("profit_margin"),
        gross.alias("gross_margin"),
        sdiv(c("current_assets") - inventory, c("current_liabilities")).alias("quick_ratio"),
        sdiv(cash, c("current_liabilities")).alias("cash_ratio"),
    )


def statement_ratio(n, d) -> Column:
    """Filing-statement ratio: NULL when either side is NULL or zero."""
    n = F.col(n) if isinstance(n, str) else n
    d = F.col(d) if isinstance(d, str) else d
    return F.try_divide(F.nullif(n, F.lit(0.0)), F.nullif(d, F.lit(0.0)))


# ------------------------------------------------------------- normalisation
def minmax_component(df: DataFrame, cols: Sequence[str], suffix: str = "_norm") -> DataFrame:
    """(x - min) / (max - min) over the whole table; 0 for a constant column."""
    stats = df.agg(*[F.min(c).alias(f"__mn_{c}") for c in cols], *[F.max(c).alias(f"__mx_{c}") for c in cols])
    j = df.crossJoin(F.broadcast(stats))  # one row, bounded by construction
    out = [F.when(F.col(f"__mx_{c}") == F.col(f"__mn_{c}"), F.lit(0.0))
            .otherwise((F.col(c) - F.col(f"__mn_{c}")) / (F.col(f"__mx_{c}") - F.col(f"__mn_{c}")))
            .alias(f"{c}{suffix}") for c in cols]
    return j.select(*df.columns, *out)


# Composite credit-risk weights of the reference.
COMPOSITE_WEIGHTS = [("debt_to_equity_ratio", 0.25), ("current_ratio", -0.20), ("roa", -0.20), ("roe", -0.15),
                     ("news_sentiment_30d", -0.10), ("event_impact_score", 0.10)]


def composite_weighted(df: DataFrame, weights=COMPOSITE_WEIGHTS, out: str = "credit_risk_composite_score") -> DataFrame:
    avail = [(c, w) for c, w in weights if c in df.columns]
    if not avail:
        return df
    total = sum(abs(w) for _, w in avail)
    n = minmax_component(df, [c for c, _ in avail], suffix="__mm")
    expr = None
    for c, w in avail:
        term = F.lit(w) * F.col(f"{c}__mm")
        expr = term if expr is None else expr + term
    return n.withColumn(out, expr / F.lit(total)).drop(*[f"{c}__mm" for c, _ in avail])


def stress_indicator(columns: Sequence[str]) -> Column:
    """Mean of available stress flags; a NULL comparison counts as 0."""
    conds = {"debt_to_equity_ratio": lambda c: c > 1.5, "current_ratio": lambda c: c < 1.0,
             "roa": lambda c: c < 0, "cash_flow_operations": lambda c: c < 0}
    flags = [F.coalesce(f(F.col(k)), F.lit(False)).cast("double") for k, f in conds.items() if k in columns]
    if not flags:
        return F.lit(None).cast("double")
    s = flags[0]
    for f in flags[1:]:
        s = s + f
    return s / F.lit(float(len(flags)))


def confidence_index(df: DataFrame) -> Column:
    """Mean of filled 7-row sentiment, filled 30-row momentum and the volume
    trend brought to 0..1 (``volume_trend_norm`` of ``minmax_component``; not
    filled, so rows without a trend have no index)."""
    parts = []
    if "news_sentiment_7d" in df.columns:
        parts.append(F.coalesce(F.col("news_sentiment_7d"), F.lit(0.0)))
    if "price_momentum_30d" in df.columns:
        parts.append(F.coalesce(F.col("price_momentum_30d"), F.lit(0.0)))
    if "volume_trend_norm" in df.columns:
        parts.append(F.col("volume_trend_norm"))
    if not parts:
        return F.lit(None).cast("double")
    s = parts[0] + F.lit(0.0) if len(parts) == 1 else parts[0]
    for p in parts[1:]:
        s = s + p
    return s / F.lit(float(len(parts)))


def liquidity_risk() -> Column:
    c = F.col
    return (F.lit(0.4) * (F.lit(2.0) - nclip(c("current_ratio"), 0.0, 4.0)) / F.lit(4.0)
            + F.lit(0.4) * (F.lit(1.5) - nclip(c("quick_ratio"), 0.0, 3.0)) / F.lit(3.0)
            + F.lit(0.2) * (F.lit(0.5) - nclip(c("cash_ratio"), 0.0, 1.0)) / F.lit(1.0))


def profitability_trend(columns: Sequence[str]) -> Column:
    cols = [c for c in ["revenue_growth_yoy", "profit_margin", "roa", "roe"] if c in columns]
    if not cols:
        return F.lit(None).cast("double")
    s = F.coalesce(F.col(cols[0]), F.lit(0.0))
    for c in cols[1:]:
        s = s + F.coalesce(F.col(c), F.lit(0.0))
    return s / F.lit(float(len(cols)))


# Event-impact weights, truncated to the available columns.
EVENT_COLUMNS = ["regulatory_risk_score", "management_sentiment", "earnings_sentiment"]
EVENT_WEIGHTS = [0.4, 0.3, 0.3]


def event_impact_weights(columns: Sequence[str]) -> tuple[list[str], list[float]]:
    avail = [c for c in EVENT_COLUMNS if c in columns]
    raw = EVENT_WEIGHTS[:len(avail)]
    total = sum(raw)
    return avail, [w / total for w in raw]


def event_impact(columns: Sequence[str]) -> Column:
    """np.average(filled values, weights) = Σ v·w / Σ w."""
    avail, ws = event_impact_weights(columns)
    if not avail:
        return F.lit(None).cast("double")
    num = None
    for c, w in zip(avail, ws):
        t = F.coalesce(F.col(c), F.lit(0.0)) * F.lit(w)
        num = t if num is None else num + t
    return num / F.lit(sum(ws))


def beta(ticks: DataFrame, min_rows_table: int = 100, min_rows_key: int = 30) -> DataFrame:
    """cov_samp(ticker return, market return) / var_pop(market return) per ticker.

    Market return: mean close per date, pct_change over dates (a table with
    one row per distinct date).  Ticker returns: 1-row pct_change over exact
    blocks of each ticker's ticks (a hot ticker spreads over tasks).  NULL
    returns → 0 before the statistics; zero market variance → 1.0; gates:
    table > 100 rows, ticker > 30 rows.
    """
    from pyspark.sql import Window
    from riskloom.operators import windows as W
    idx = ticks.groupBy("date").agg(F.avg("close").alias("idx"))
    # one row per date: ordering the date table needs no key partitioning
    mr = idx.select("date", (sdiv(F.col("idx"), F.lag("idx").over(Window.orderBy("date"))) - F.lit(1.0)).alias("mret"))
    b, w = W.key_frames(ticks, "ticker", ["ts", "event_id"], 1, {"close": "__ff_close"})
    t = W.home_rows(b.select("ticker", "date", "__i", "__b", "__home", W.pct_change_filled("__ff_close", w, 1).alias("ret")))
    t = t.join(mr, "date", "left").select(
        "ticker", F.coalesce("ret", F.lit(0.0)).alias("r"), F.coalesce("mret", F.lit(0.0)).alias("m"))
    total = ticks.agg(F.count(F.lit(1)).alias("__n"))
    g = t.groupBy("ticker").agg(F.count(F.lit(1)).alias("__cnt"), F.covar_samp("r", "m").alias("__cov"),
                                F.var_pop("m").alias("__var"))
    g = g.crossJoin(F.broadcast(total))
    b = F.when(F.col("__var") == 0, F.lit(1.0)).otherwise(F.col("__cov") / F.col("__var"))
    return g.select("ticker", F.when((F.col("__n") > min_rows_table) & (F.col("__cnt") > min_rows_key), b)
                    .alias("beta_coefficient"))
