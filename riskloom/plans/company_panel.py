"""Part B: company panel -- as-of merge, window features, ratios, scores.

Window features of one table share one (ticker, order) window specification,
so each query below plans a single exchange on ticker plus one sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.functions.scalar import clip, sdiv
from riskloom.operators import joins as J
from riskloom.operators import windows as W
from riskloom.operators.scores import (COMPOSITE_WEIGHTS as COMPOSITE, composite_weighted, confidence_index, event_impact, event_impact_weights,
                                       financial_ratios, liquidity_risk, minmax_component, profitability_trend,
                                       stress_indicator)
from riskloom.plans.common import register, round_doubles, sql_round
from riskloom.session import scratch_table_path
from riskloom.sources import panel as P

DIGITS = 6
PRICE_TOL, NEWS_TOL = 30, 7
PRICE_COLS = ["close", "volume"]
NEWS_COLS = ["sentiment_score", "news_volume", "regulatory_risk_score", "management_sentiment"]
FUND_COLS = ["revenue", "total_debt", "shareholders_equity", "total_assets", "current_assets",
             "current_liabilities", "net_income", "cash_flow_operations"]


# ------------------------------------------------------------------ Spark side
def merged_panel(spark: SparkSession, d: str) -> DataFrame:
    f = P.fundamentals(spark, d)
    m = J.asof_nearest_join(f, P.prices_daily(spark, d), "ticker", "date", PRICE_TOL, PRICE_COLS)
    return J.asof_nearest_join(m, P.news_daily(spark, d), "ticker", "date", NEWS_TOL, NEWS_COLS)


def tick_window():
    return W.key_window("ticker", ["ts", "event_id"])


def day_window():
    return W.key_window("ticker", "date")


def ticks_blocked(t: DataFrame, lookback: int, ffill: dict[str, str] | None = None,
                  block_rows: int = W.BLOCK_ROWS):
    """Tick rows per ticker for frames of ``lookback`` rows; a ticker larger
    than one block is split into exact halo blocks (operators.windows)."""
    return W.key_frames(t, "ticker", ["ts", "event_id"], lookback, ffill, block_rows)


def market_features(t: DataFrame, block_rows: int = W.BLOCK_ROWS) -> DataFrame:
    # longest frame: 200 rows (ma_200d) -> 199 rows of look-back
    b, w = ticks_blocked(t, 199, {"close": "__ff_close"}, block_rows)
    out = b.select(
        "ticker", "ts", "event_id", "date", "close", "volume", "__i", "__b", "__home",
        W.pct_change_filled("__ff_close", w, 30).alias("price_momentum_30d"),
        W.pct_change_filled("__ff_close", w, 90).alias("price_momentum_90d"),
        W.rolling_std("close", w, 30, 10).alias("price_volatility_30d"),
        W.rolling_std("close", w, 90, 30).alias("price_volatility_90d"),
        W.rolling_mean("close", w, 20, 10).alias("ma_20d"),
        W.rolling_mean("close", w, 50, 25).alias("ma_50d"),
        W.rolling_mean("close", w, 200, 100).alias("ma_200d"),
        W.rolling_mean("volume", w, 30, 10).alias("volume_trend"),
        W.rolling_std("volume", w, 30, 10).alias("volume_volatility"),
    )
    return W.home_rows(out)


def news_features(n: DataFrame, w=None) -> DataFrame:
    w = w or day_window()
    cols = [F.col(c) for c in n.columns]
    out = n.select(*cols,
                   *[W.rolling_mean("sentiment_score", w, k, max(1, k // 3)).alias(f"news_sentiment_{k}d")
                     for k in (7, 30, 90)],
                   W.rolling_std("sentiment_score", w, 30, 10).alias("sentiment_volatility_30d"),
                   W.rolling_mean("news_volume", w, 30, 10).alias("news_volume_trend"),
                   W.diff_n("sentiment_score", w, 7).alias("sentiment_momentum"))
    out = out.withColumn("news_volume_spike", W.volume_spike("news_volume", "news_volume_trend"))
    return out.withColumn("event_impact_score", event_impact(out.columns))


# ------------------------------------------------------------------ SQL side
def sql_asof(left: str, right: str, key: str, on: str, tol: int, lcols: list[str], rcols: list[str]) -> str:
    lsel = ", ".join(f"l.{c}" for c in lcols)
    bsel = ", ".join(f"b.{c} AS __b_{c}" for c in rcols)
    fsel = ", ".join(f"fw.{c} AS __f_{c}" for c in rcols)
    pick = (f"CASE WHEN b.{on} IS NOT NULL AND (fw.{on} IS NULL OR datediff('day', b.{on}, l.{on}) <= datediff('day', l.{on}, fw.{on})) "
            f"THEN (CASE WHEN datediff('day', b.{on}, l.{on}) <= {tol} THEN 'B' END) "
            f"WHEN fw.{on} IS NOT NULL THEN (CASE WHEN datediff('day', l.{on}, fw.{on}) <= {tol} THEN 'F' END) END")
    outer = ", ".join(lcols) + ", " + ", ".join(
        f"CASE WHEN __pick = 'B' THEN __b_{c} WHEN __pick = 'F' THEN __f_{c} END AS {c}" for c in rcols)
    return (f"SELECT {outer} FROM (SELECT {lsel}, {bsel}, {fsel}, {pick} AS __pick FROM ({left}) l "
            f"ASOF LEFT JOIN ({right}) b ON l.{key} = b.{key} AND l.{on} >= b.{on} "
            f"ASOF LEFT JOIN ({right}) fw ON l.{key} = fw.{key} AND l.{on} <= fw.{on}) x")


MERGED_SQL = sql_asof(
    sql_asof("SELECT * FROM fundamentals", "SELECT * FROM prices_daily", "ticker", "date", PRICE_TOL,
             ["ticker", "date"] + FUND_COLS, PRICE_COLS),
    "SELECT * FROM news_daily", "ticker", "date", NEWS_TOL, ["ticker", "date"] + FUND_COLS + PRICE_COLS, NEWS_COLS)

TW = "PARTITION BY ticker ORDER BY ts, event_id"
DW = "PARTITION BY ticker ORDER BY date"


def s_rows(n: int, w: str) -> str:
    return f"OVER ({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def s_mean(c: str, w: str, n: int, k: int) -> str:
    return f"CASE WHEN count({c}) {s_rows(n, w)} >= {k} THEN avg({c}) {s_rows(n, w)} END"


def s_std(c: str, w: str, n: int, k: int) -> str:
    return f"CASE WHEN count({c}) {s_rows(n, w)} >= {max(k, 1)} THEN stddev_samp({c}) {s_rows(n, w)} END"


def s_clip(c: str, lo: float, hi: float) -> str:
    return f"(CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, {lo!r}), {hi!r}) END)"


def s_ffill(c: str, w: str) -> str:
    return f"last({c} IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def s_bfill(c: str, w: str) -> str:
    return f"first({c} IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def s_sdiv(n: str, d: str) -> str:
    return f"(CASE WHEN ({d}) <> 0 THEN ({n}) / ({d}) END)"


def s_pct(c: str, w: str, n: int) -> str:
    """pct_change over a pre-computed forward-filled column ``__ff_c``."""
    return f"({s_sdiv(f'__ff_{c}', f'lag(__ff_{c}, {n}) OVER ({w})')} - 1.0)"


MARKET_SQL = f"""
SELECT ticker, ts, event_id, date, close, volume,
  {s_pct('close', TW, 30)} AS price_momentum_30d, {s_pct('close', TW, 90)} AS price_momentum_90d,
  {s_std('close', TW, 30, 10)} AS price_volatility_30d, {s_std('close', TW, 90, 30)} AS price_volatility_90d,
  {s_mean('close', TW, 20, 10)} AS ma_20d, {s_mean('close', TW, 50, 25)} AS ma_50d,
  {s_mean('close', TW, 200, 100)} AS ma_200d,
  {s_mean('volume', TW, 30, 10)} AS volume_trend, {s_std('volume', TW, 30, 10)} AS volume_volatility
FROM (SELECT *, {s_ffill('close', TW)} AS __ff_close FROM ticks) t"""


def news_sql(src: str, w: str = DW, keep: str = "*") -> str:
    inner = f"""SELECT {keep},
      {s_mean('sentiment_score', w, 7, 2)} AS news_sentiment_7d,
      {s_mean('sentiment_score', w, 30, 10)} AS news_sentiment_30d,
      {s_mean('sentiment_score', w, 90, 30)} AS news_sentiment_90d,
      {s_std('sentiment_score', w, 30, 10)} AS sentiment_volatility_30d,
      {s_mean('news_volume', w, 30, 10)} AS news_volume_trend,
      sentiment_score - lag(sentiment_score, 7) OVER ({w}) AS sentiment_momentum
    FROM ({src}) s"""
    avail, ws = event_impact_weights(["regulatory_risk_score", "management_sentiment"])
    num = " + ".join(f"coalesce({c}, 0.0) * {w!r}" for c, w in zip(avail, ws))
    return f"""SELECT *, CAST(coalesce(news_volume > news_volume_trend * 2, false) AS DOUBLE) AS news_volume_spike,
      ({num}) / {sum(ws)!r} AS event_impact_score
    FROM ({inner}) n"""


# ------------------------------------------------------------------ registry
@register("asof_nearest_join", with_panel := P.with_panel_views(
    sql_round(MERGED_SQL, digits=DIGITS), "fundamentals", "prices_daily", "news_daily"))
def q_asof(spark, d):
    return round_doubles(merged_panel(spark, d), DIGITS)


@register("inner_join_multi_key", P.with_panel_views(sql_round(
    "SELECT f.*, t.target FROM fundamentals f JOIN target_daily t ON f.ticker = t.ticker AND f.date = t.date",
    digits=DIGITS), "fundamentals", "target_daily"))
def q_inner_multi(spark, d):
    return round_doubles(P.fundamentals(spark, d).join(P.target_daily(spark, d), ["ticker", "date"], "inner"), DIGITS)


@register("map_lookup_join", P.with_panel_views(sql_round(
    "SELECT p.*, s.sector FROM prices_daily p LEFT JOIN sectors s ON p.ticker = s.ticker", digits=DIGITS),
    "prices_daily", "sectors"))
def q_map_lookup(spark, d):
    return round_doubles(P.prices_daily(spark, d).join(P.sectors(spark, d), "ticker", "left"), DIGITS)


@register("market_index", P.with_panel_views(sql_round(
    "SELECT date, avg(close) AS market_close, count(*) AS n_tickers FROM prices_daily GROUP BY date",
    digits=DIGITS), "prices_daily"))
def q_market_index(spark, d):
    p = P.prices_daily(spark, d)
    return round_doubles(p.groupBy("date").agg(F.avg("close").alias("market_close"),
                                               F.count(F.lit(1)).alias("n_tickers")), DIGITS)


@register("rolling_mean", P.with_panel_views(sql_round(
    f"SELECT ticker, ts, event_id, ma_20d, ma_50d, ma_200d, volume_trend FROM ({MARKET_SQL}) m", digits=DIGITS), "ticks"))
def q_rolling_mean(spark, d):
    return round_doubles(market_features(P.ticks(spark, d)).select(
        "ticker", "ts", "event_id", "ma_20d", "ma_50d", "ma_200d", "volume_trend"), DIGITS)


@register("rolling_std", P.with_panel_views(sql_round(
    f"SELECT ticker, ts, event_id, price_volatility_30d, price_volatility_90d, volume_volatility FROM ({MARKET_SQL}) m",
    digits=DIGITS), "ticks"))
def q_rolling_std(spark, d):
    return round_doubles(market_features(P.ticks(spark, d)).select(
        "ticker", "ts", "event_id", "price_volatility_30d", "price_volatility_90d", "volume_volatility"), DIGITS)


@register("pct_change", P.with_panel_views(sql_round(
    f"SELECT ticker, ts, event_id, price_momentum_30d, price_momentum_90d FROM ({MARKET_SQL}) m", digits=DIGITS), "ticks"))
def q_pct_change(spark, d):
    return round_doubles(market_features(P.ticks(spark, d)).select(
        "ticker", "ts", "event_id", "price_momentum_30d", "price_momentum_90d"), DIGITS)


NEWS_SQL = news_sql("SELECT * FROM news_daily")


@register("rolling_mean_news", P.with_panel_views(sql_round(
    f"SELECT ticker, date, news_sentiment_7d, news_sentiment_30d, news_sentiment_90d, news_volume_trend FROM ({NEWS_SQL}) n",
    digits=DIGITS), "news_daily"))
def q_rolling_mean_news(spark, d):
    return round_doubles(news_features(P.news_daily(spark, d)).select(
        "ticker", "date", "news_sentiment_7d", "news_sentiment_30d", "news_sentiment_90d", "news_volume_trend"), DIGITS)


@register("diff_n", P.with_panel_views(sql_round(
    f"SELECT ticker, date, sentiment_momentum FROM ({NEWS_SQL}) n", digits=DIGITS), "news_daily"))
def q_diff_n(spark, d):
    return round_doubles(news_features(P.news_daily(spark, d)).select("ticker", "date", "sentiment_momentum"), DIGITS)


@register("volume_spike", P.with_panel_views(sql_round(
    f"SELECT ticker, date, news_volume, news_volume_trend, news_volume_spike FROM ({NEWS_SQL}) n", digits=DIGITS),
    "news_daily"))
def q_volume_spike(spark, d):
    return round_doubles(news_features(P.news_daily(spark, d)).select(
        "ticker", "date", "news_volume", "news_volume_trend", "news_volume_spike"), DIGITS)


@register("event_impact", P.with_panel_views(sql_round(
    f"SELECT ticker, date, event_impact_score FROM ({NEWS_SQL}) n", digits=DIGITS), "news_daily"))
def q_event_impact(spark, d):
    return round_doubles(news_features(P.news_daily(spark, d)).select("ticker", "date", "event_impact_score"), DIGITS)


@register("rolling_corr", P.with_panel_views(sql_round(f"""
SELECT ticker, ts, event_id,
  CASE WHEN n_rows > 30 AND count(CASE WHEN ret IS NOT NULL AND sentiment_score IS NOT NULL THEN 1 END) {s_rows(30, TW)} = 30
       THEN {s_sdiv(f"covar_samp(pa, pb) {s_rows(30, TW)}", f"stddev_samp(pa) {s_rows(30, TW)} * stddev_samp(pb) {s_rows(30, TW)}")} END
       AS sentiment_price_correlation
FROM (SELECT *, CASE WHEN ret IS NOT NULL AND sentiment_score IS NOT NULL THEN sentiment_score END AS pa,
             CASE WHEN ret IS NOT NULL AND sentiment_score IS NOT NULL THEN ret END AS pb
      FROM (SELECT *, {s_pct('close', TW, 1)} AS ret, count(*) OVER (PARTITION BY ticker) AS n_rows
      FROM (SELECT *, {s_ffill('close', TW)} AS __ff_close FROM ticks) a) a2) b""", digits=DIGITS), "ticks"))
def q_rolling_corr(spark, d):
    t = P.ticks(spark, d)
    # 30-row frame over 1-row returns: 30 rows of look-back
    b, w = ticks_blocked(t, 30, {"close": "__ff_close"})
    b = b.withColumn("ret", W.pct_change_filled("__ff_close", w, 1))
    out = W.home_rows(b.select("ticker", "ts", "event_id", "__i", "__b", "__home",
                               W.rolling_corr("sentiment_score", "ret", w, 30).alias("__corr")))
    n_rows = t.groupBy("ticker").agg(F.count(F.lit(1)).alias("__n"))  # one row per ticker
    out = out.join(n_rows, "ticker")
    return round_doubles(out.select("ticker", "ts", "event_id",
                                    F.when(F.col("__n") > 30, F.col("__corr")).alias("sentiment_price_correlation")),
                         DIGITS)


@register("rsi_14", P.with_panel_views(sql_round(f"""
SELECT ticker, ts, event_id,
  CASE WHEN count(*) {s_rows(14, TW)} >= 14 THEN
    CASE WHEN avg(loss) {s_rows(14, TW)} = 0 AND avg(gain) {s_rows(14, TW)} > 0 THEN 100.0
         WHEN avg(loss) {s_rows(14, TW)} > 0 THEN 100.0 - 100.0 / (1.0 + avg(gain) {s_rows(14, TW)} / avg(loss) {s_rows(14, TW)}) END
  END AS rsi_14d
FROM (SELECT *, CASE WHEN dlt > 0 THEN dlt ELSE 0.0 END AS gain, CASE WHEN dlt < 0 THEN -dlt ELSE 0.0 END AS loss
      FROM (SELECT *, close - lag(close) OVER ({TW}) AS dlt FROM ticks) a) b""", digits=DIGITS), "ticks"))
def q_rsi(spark, d):
    # 14-row means of 1-row deltas: 14 rows of look-back
    b, w = ticks_blocked(P.ticks(spark, d), 14)
    gain, loss, _ = W.rsi("close", w)
    t = b.select("ticker", "ts", "event_id", "__i", "__b", "__home", gain.alias("gain"), loss.alias("loss"))
    return round_doubles(W.home_rows(t.select("ticker", "ts", "event_id", "__i", "__b", "__home",
                                              W.rsi_from("gain", "loss", w, 14).alias("rsi_14d"))), DIGITS)


@register("trend_slope_last_n", P.with_panel_views(sql_round("""
SELECT f.ticker, f.date, s.revenue_trend FROM fundamentals f LEFT JOIN (
  SELECT ticker, CASE WHEN count(*) = 4 THEN regr_slope(revenue, CAST(4 - rn AS DOUBLE)) END AS revenue_trend
  FROM (SELECT ticker, revenue, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM fundamentals) r
  WHERE rn <= 4 GROUP BY ticker) s ON f.ticker = s.ticker""", digits=DIGITS), "fundamentals"))
def q_trend_slope(spark, d):
    f = P.fundamentals(spark, d)
    return round_doubles(W.trend_slope_last_n(f, "ticker", "date", "revenue", 4, "revenue_trend")
                         .select("ticker", "date", "revenue_trend"), DIGITS)


@register("beta", P.with_panel_views(sql_round(f"""
WITH mi AS (SELECT date, avg(close) AS idx FROM ticks GROUP BY date),
mr AS (SELECT date, {s_sdiv('idx', 'lag(idx) OVER (ORDER BY date)')} - 1.0 AS mret FROM mi),
tr AS (SELECT t.ticker, coalesce({s_pct('close', TW, 1)}, 0.0) AS r, coalesce(mr.mret, 0.0) AS m
       FROM (SELECT *, {s_ffill('close', TW)} AS __ff_close FROM ticks) t LEFT JOIN mr ON t.date = mr.date),
tot AS (SELECT count(*) AS n FROM ticks)
SELECT ticker, CASE WHEN max(tot.n) > 100 AND count(*) > 30 THEN
   CASE WHEN var_pop(m) = 0 THEN 1.0 ELSE covar_samp(r, m) / var_pop(m) END END AS beta_coefficient
FROM tr, tot GROUP BY ticker""", digits=DIGITS), "ticks"))
def q_beta(spark, d):
    from riskloom.operators.scores import beta
    return round_doubles(beta(P.ticks(spark, d)), DIGITS)


@register("group_mean_relative", P.with_panel_views(sql_round("""
SELECT p.ticker, p.date, s.sector, p.close / nullif(avg(p.close) OVER (PARTITION BY p.date, s.sector), 0) AS close_vs_sector
FROM prices_daily p JOIN sectors s ON p.ticker = s.ticker""", digits=DIGITS), "prices_daily", "sectors"))
def q_group_rel(spark, d):
    p = P.prices_daily(spark, d).join(P.sectors(spark, d), "ticker", "inner")
    return round_doubles(W.group_mean_relative(p.select("ticker", "date", "sector", "close"), "close", ["date", "sector"],
                                               "close_vs_sector").drop("close"), DIGITS)


@register("ffill_bfill", P.with_panel_views(sql_round(f"""
SELECT ticker, date, {', '.join(f"coalesce(coalesce({s_ffill(c, DW)}, {s_bfill(c, DW)}), 0) AS {c}" for c in PRICE_COLS + NEWS_COLS)}
FROM ({MERGED_SQL}) m""", digits=DIGITS), "fundamentals", "prices_daily", "news_daily"))
def q_ffill_bfill(spark, d):
    m = merged_panel(spark, d)
    w = day_window()
    cols = [F.coalesce(W.ffill(F.col(c), w), W.bfill(F.col(c), w), F.lit(0)).alias(c) for c in PRICE_COLS + NEWS_COLS]
    return round_doubles(m.select("ticker", "date", *cols), DIGITS)


# lag groups (fixed values: the reference's keyword lists)
LAG_KEYWORDS = {
    "financial": ["ratio", "margin", "growth", "roa", "roe"],
    "market": ["price", "volume", "momentum", "volatility", "beta"],
    "news": ["sentiment", "news", "event"],
}
LAG_PERIODS = [1, 7, 30]


def lag_columns(columns: list[str]) -> list[tuple[str, int, str]]:
    out, seen = [], set()
    for kws in LAG_KEYWORDS.values():
        for n in LAG_PERIODS:
            for c in columns:
                if any(k in c.lower() for k in kws):
                    name = f"{c}_lag_{n}d"
                    if name not in seen:
                        seen.add(name)
                        out.append((c, n, name))
    return out


def financial_panel(spark: SparkSession, d: str) -> DataFrame:
    """Merged panel + financial ratios, growth, stability (reference stage 2)."""
    m = merged_panel(spark, d)
    m = financial_ratios(m)
    w = day_window()
    for c in ["revenue", "net_income", "total_assets", "shareholders_equity"]:
        m = W.pct_change(m, c, w, 4, f"{c}_growth_yoy")
    m = W.trend_slope_last_n(m, "ticker", "date", "revenue", 4, "revenue_trend")
    return m.select("*", W.rolling_std("profit_margin", w, 4, 2).alias("profit_margin_stability"),
                    W.rolling_std("cash_flow_operations", w, 4, 2).alias("cash_flow_stability"))


FIN_RATIO_SQL = """
  CASE WHEN shareholders_equity <> 0 THEN total_debt / shareholders_equity END AS debt_to_equity_ratio,
  CASE WHEN current_liabilities <> 0 THEN current_assets / current_liabilities END AS current_ratio,
  CASE WHEN total_assets <> 0 THEN net_income / total_assets END AS roa,
  CASE WHEN shareholders_equity <> 0 THEN net_income / shareholders_equity END AS roe,
  CASE WHEN total_assets <> 0 THEN revenue / total_assets END AS asset_turnover,
  CASE WHEN total_assets <> 0 THEN total_debt / total_assets END AS debt_ratio,
  CASE WHEN revenue <> 0 THEN net_income / revenue END AS profit_margin,
  CAST(NULL AS DOUBLE) AS gross_margin,
  CASE WHEN current_liabilities <> 0 THEN (current_assets - 0.0) / current_liabilities END AS quick_ratio,
  CASE WHEN current_liabilities <> 0 THEN 0.0 / current_liabilities END AS cash_ratio"""


def financial_panel_sql() -> str:
    ff = ", ".join(f"{s_ffill(c, DW)} AS __ff_{c}" for c in ["revenue", "net_income", "total_assets", "shareholders_equity"])
    growth = ", ".join(f"{s_pct(c, DW, 4)} AS {c}_growth_yoy" for c in ["revenue", "net_income", "total_assets", "shareholders_equity"])
    return f"""SELECT * EXCLUDE (__ff_revenue, __ff_net_income, __ff_total_assets, __ff_shareholders_equity, rt_ticker),
       {s_std('profit_margin', DW, 4, 2)} AS profit_margin_stability,
       {s_std('cash_flow_operations', DW, 4, 2)} AS cash_flow_stability
    FROM (SELECT *, {growth} FROM (SELECT *, {ff} FROM (SELECT *, {FIN_RATIO_SQL} FROM ({MERGED_SQL}) m0) m1) m2) m3
    LEFT JOIN (SELECT ticker AS rt_ticker, CASE WHEN count(*) = 4 THEN regr_slope(revenue, CAST(4 - rn AS DOUBLE)) END AS revenue_trend
      FROM (SELECT ticker, revenue, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM fundamentals) r
      WHERE rn <= 4 GROUP BY ticker) rt ON m3.ticker = rt.rt_ticker"""


@register("financial_ratios", P.with_panel_views(sql_round(
    f"SELECT ticker, date, {FIN_RATIO_SQL} FROM fundamentals", digits=DIGITS), "fundamentals"))
def q_fin_ratios(spark, d):
    f = financial_ratios(P.fundamentals(spark, d))
    return round_doubles(f.select("ticker", "date", "debt_to_equity_ratio", "current_ratio", "roa", "roe",
                                  "asset_turnover", "debt_ratio", "profit_margin", "gross_margin", "quick_ratio",
                                  "cash_ratio"), DIGITS)


@register("rolling_std_financial", P.with_panel_views(sql_round(
    f"SELECT ticker, date, profit_margin_stability, cash_flow_stability, revenue_growth_yoy, net_income_growth_yoy, "
    f"total_assets_growth_yoy, shareholders_equity_growth_yoy, revenue_trend FROM ({financial_panel_sql()}) f",
    digits=DIGITS), "fundamentals", "prices_daily", "news_daily"))
def q_rolling_std_fin(spark, d):
    return round_doubles(financial_panel(spark, d).select(
        "ticker", "date", "profit_margin_stability", "cash_flow_stability", "revenue_growth_yoy",
        "net_income_growth_yoy", "total_assets_growth_yoy", "shareholders_equity_growth_yoy", "revenue_trend"), DIGITS)


def panel_features(spark: SparkSession, d: str) -> DataFrame:
    """Financial, news and market features on panel rows, written once: scores
    need statistics of the whole panel and then its rows."""
    w = day_window()
    m = news_features(financial_panel(spark, d), w)
    m = W.pct_change(m, "close", w, 30, "price_momentum_30d")
    m = m.withColumn("volume_trend", W.rolling_mean("volume", w, 30, 10))
    path = scratch_table_path(spark, "panel_features")
    m.write.parquet(path)
    return spark.read.parquet(path)


def derived_panel(spark: SparkSession, d: str) -> DataFrame:
    """Panel features + composite scores."""
    m = composite_weighted(minmax_component(panel_features(spark, d), ["volume_trend"]))
    m = m.withColumn("financial_stress_indicator", stress_indicator(m.columns))
    m = m.withColumn("market_confidence_index", confidence_index(m))
    m = m.withColumn("liquidity_risk_score", liquidity_risk())
    return m.withColumn("profitability_trend_score", profitability_trend(m.columns))


def derived_sql() -> str:
    base = f"""SELECT *, {s_pct('close', DW, 30)} AS price_momentum_30d, {s_mean('volume', DW, 30, 10)} AS volume_trend
      FROM (SELECT *, {s_ffill('close', DW)} AS __ff_close FROM ({news_sql(financial_panel_sql(), DW)}) b0) b1"""
    mm = ", ".join(f"min({c}) OVER () AS __mn_{c}, max({c}) OVER () AS __mx_{c}" for c in [*[c for c, _ in COMPOSITE], "volume_trend"])
    norm = lambda c: f"(CASE WHEN __mx_{c} = __mn_{c} THEN 0.0 ELSE ({c} - __mn_{c}) / (__mx_{c} - __mn_{c}) END)"
    total = sum(abs(w) for _, w in COMPOSITE)
    comp = " + ".join(f"({w!r}) * {norm(c)}" for c, w in COMPOSITE)
    stress = ("(CAST(coalesce(debt_to_equity_ratio > 1.5, false) AS DOUBLE) + CAST(coalesce(current_ratio < 1.0, false) AS DOUBLE)"
              " + CAST(coalesce(roa < 0, false) AS DOUBLE) + CAST(coalesce(cash_flow_operations < 0, false) AS DOUBLE)) / 4.0")
    conf = f"(coalesce(news_sentiment_7d, 0.0) + coalesce(price_momentum_30d, 0.0) + {norm('volume_trend')}) / 3.0"
    liq = (f"0.4 * (2.0 - {s_clip('current_ratio', 0.0, 4.0)}) / 4.0 + 0.4 * (1.5 - {s_clip('quick_ratio', 0.0, 3.0)}) / 3.0"
           f" + 0.2 * (0.5 - {s_clip('cash_ratio', 0.0, 1.0)}) / 1.0")
    prof = "(coalesce(revenue_growth_yoy, 0.0) + coalesce(profit_margin, 0.0) + coalesce(roa, 0.0) + coalesce(roe, 0.0)) / 4.0"
    return f"""SELECT ticker, date, ({comp}) / {total!r} AS credit_risk_composite_score,
       {stress} AS financial_stress_indicator, {conf} AS market_confidence_index,
       {liq} AS liquidity_risk_score, {prof} AS profitability_trend_score
    FROM (SELECT *, {mm} FROM ({base}) b) c"""


DERIVED_VIEWS = ("fundamentals", "prices_daily", "news_daily")


def _derived_query(col: str):
    def q(spark, d):
        return round_doubles(derived_panel(spark, d).select("ticker", "date", col), DIGITS)
    return q


for _key, _col in [("composite_weighted", "credit_risk_composite_score"),
                   ("stress_indicator", "financial_stress_indicator"),
                   ("confidence_index", "market_confidence_index"),
                   ("liquidity_risk", "liquidity_risk_score"),
                   ("profitability_trend", "profitability_trend_score")]:
    register(_key, P.with_panel_views(sql_round(f"SELECT ticker, date, {_col} FROM ({derived_sql()}) d", digits=DIGITS),
                                      *DERIVED_VIEWS))(_derived_query(_col))


@register("minmax_component", P.with_panel_views(sql_round(f"""
SELECT ticker, date, {', '.join(f"CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 0.0 ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END AS {c}_norm" for c in ['debt_to_equity_ratio', 'current_ratio', 'roa', 'roe'])}
FROM (SELECT ticker, date, {FIN_RATIO_SQL} FROM fundamentals) f""", digits=DIGITS), "fundamentals"))
def q_minmax(spark, d):
    f = financial_ratios(P.fundamentals(spark, d))
    cols = ["debt_to_equity_ratio", "current_ratio", "roa", "roe"]
    return round_doubles(minmax_component(f, cols, suffix="_norm").select("ticker", "date", *[f"{c}_norm" for c in cols]), DIGITS)


SCALED = ["debt_to_equity_ratio", "roa", "profit_margin", "total_assets", "close", "volume", "news_volume", "sentiment_score"]
SCALE_CUT = "2024-01-16"


def scale_groups() -> list[dict]:
    """The library's groups, news by least and largest value."""
    from riskloom.operators.scaling import GROUPS
    return [{**g, "method": "minmax"} if g["name"] == "news" else g for g in GROUPS]


def _scale_sql() -> str:
    from riskloom.operators.scaling import members
    now, ctes = {c: f"CAST({c} AS DOUBLE)" for c in SCALED}, []
    for g in scale_groups():
        own, k = members(SCALED, g), len(ctes)
        centre = {"robust": "quantile_cont({x}, 0.5)", "standard": "avg({x})", "minmax": "min({x})"}[g["method"]]
        scale = {"robust": "quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25)", "standard": "stddev_pop({x})",
                 "minmax": "max({x}) - min({x})"}[g["method"]]
        before = "".join(f", s_{i}" for i in range(k))
        stats = ", ".join(f"{centre.format(x=now[c])} AS c_{c}_{k}, {scale.format(x=now[c])} AS d_{c}_{k}" for c in own)
        for c in own:
            now[c] = f"(({now[c]}) - coalesce(c_{c}_{k}, 0.0)) / CASE WHEN coalesce(d_{c}_{k}, 0.0) = 0 THEN 1.0 ELSE d_{c}_{k} END"
        ctes.append(f"s_{k} AS (SELECT {stats} FROM p{before} WHERE date < DATE '{SCALE_CUT}')")
    return (f"WITH p AS (SELECT *, {FIN_RATIO_SQL} FROM ({MERGED_SQL}) m), {', '.join(ctes)} SELECT ticker, date, "
            + ", ".join(f"{now[c]} AS {c}" for c in SCALED) + " FROM p, " + ", ".join(f"s_{k}" for k in range(len(ctes))))


@register("scale_by_group", P.with_panel_views(sql_round(_scale_sql(), digits=DIGITS), "fundamentals", "prices_daily", "news_daily"))
def q_scale_by_group(spark, d):
    """Groups fitted on the rows before ``SCALE_CUT``, the model saved and read
    back, then applied to all rows."""
    from riskloom.operators.scaling import GroupScaler, GroupScalerModel
    path = scratch_table_path(spark, "scaled_panel")
    financial_ratios(merged_panel(spark, d)).select("ticker", "date", *SCALED).write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    GroupScaler(SCALED, scale_groups()).fit(rows.where(F.col("date") < F.lit(SCALE_CUT).cast("date"))).save(f"{path}/model")
    return round_doubles(GroupScalerModel.load(f"{path}/model").transform(rows), DIGITS)


@register("lag_features")
def q_lag_features(spark, d):
    m = financial_ratios(merged_panel(spark, d))
    w = day_window()
    lags = lag_columns([c for c in m.columns if c not in ("ticker", "date")])
    return round_doubles(m.select("ticker", "date", *[W.lag_n(F.col(c), w, n).alias(name) for c, n, name in lags]), DIGITS)


def _lag_sql() -> str:
    cols = FUND_COLS + PRICE_COLS + NEWS_COLS + ["debt_to_equity_ratio", "current_ratio", "roa", "roe", "asset_turnover",
                                                 "debt_ratio", "profit_margin", "gross_margin", "quick_ratio", "cash_ratio"]
    lags = lag_columns(cols)
    sel = ", ".join(f"lag({c}, {n}) OVER ({DW}) AS {name}" for c, n, name in lags)
    return P.with_panel_views(sql_round(f"SELECT ticker, date, {sel} FROM (SELECT *, {FIN_RATIO_SQL} FROM ({MERGED_SQL}) m) x",
                                        digits=DIGITS), "fundamentals", "prices_daily", "news_daily")


from riskloom.plans.common import ORACLE as _OR  # noqa: E402

_OR["lag_features"] = _lag_sql()
