"""Panel work on history tables: pruned folders, no shuffle by ticker."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import windows as W
from riskloom.plans import company_panel as CP
from riskloom.plans.common import register, round_doubles, sql_round
from riskloom.sources import history as H
from riskloom.sources import panel as P

DIGITS = 6
SINCE = "2024-01-10"
PERIOD = "week"


def histories(spark, d, *names, since=SINCE):
    """The named panel views, written as histories and read back."""
    return H.read_histories(spark, [H.write_history(getattr(P, n)(spark, d), n, period=PERIOD) for n in names],
                            since, period=PERIOD)


@register("history_rolling", P.with_panel_views(sql_round(f"""
  SELECT ticker, date, {CP.s_mean('close', 'PARTITION BY ticker ORDER BY date', 7, 3)} AS ma_7d,
    {CP.s_std('close', 'PARTITION BY ticker ORDER BY date', 7, 3)} AS sd_7d
  FROM prices_daily WHERE date >= DATE '{SINCE}'""", digits=DIGITS), "prices_daily"))
def q_history_rolling(spark, d):
    prices, = histories(spark, d, "prices_daily")
    rows, w = W.key_frames(prices, "ticker", ["date"], 6)
    return round_doubles(W.home_rows(rows.select(
        "ticker", "date", "__i", "__b", "__home", W.rolling_mean("close", w, 7, 3).alias("ma_7d"),
        W.rolling_std("close", w, 7, 3).alias("sd_7d"))), DIGITS)


@register("history_asof", P.with_panel_views(sql_round(
    CP.sql_asof(f"SELECT * FROM fundamentals WHERE date >= DATE '{SINCE}'", f"SELECT * FROM prices_daily WHERE date >= DATE '{SINCE}'",
                "ticker", "date", CP.NEWS_TOL, ["ticker", "date", *CP.FUND_COLS], CP.PRICE_COLS), digits=DIGITS),
    "fundamentals", "prices_daily"))
def q_history_asof(spark, d):
    filings, prices = histories(spark, d, "fundamentals", "prices_daily")
    left = filings.select("ticker", "date", *CP.FUND_COLS)
    return round_doubles(H.asof_nearest(left, prices, "ticker", "date", CP.NEWS_TOL, CP.PRICE_COLS), DIGITS)


@register("history_beta", P.with_panel_views(sql_round(f"""
  WITH p AS (SELECT * FROM prices_daily WHERE date >= DATE '{SINCE}'),
    m AS (SELECT date, avg(close) AS market FROM p GROUP BY date)
  SELECT ticker, count(*) AS n_days, CASE WHEN var_pop(market) > 0 THEN covar_pop(close, market) / var_pop(market) END AS beta_var
  FROM p JOIN m USING (date) GROUP BY ticker""", digits=4), "prices_daily"))
def q_history_beta(spark, d):
    """Slope of each ticker's close on the day's mean close."""
    p, = histories(spark, d, "prices_daily")
    m = p.groupBy(F.col("date").alias("day")).agg(F.avg("close").alias("market"))
    j = p.join(m, F.col("date") == F.col("day"))
    return round_doubles(j.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n_days"), F.when(F.var_pop("market") > 0, F.covar_pop("close", "market") / F.var_pop("market")).alias("beta_var")), 4)


@register("history_busy_weeks", P.with_panel_views(sql_round("""
  WITH w AS (SELECT CAST(date_trunc('week', date) AS DATE) AS wk, sum(news_volume) AS n FROM news_daily GROUP BY 1),
    busy AS (SELECT wk FROM w WHERE n > (SELECT avg(n) FROM w))
  SELECT p.ticker, p.date, p.close, n.sentiment_score, n.news_volume FROM prices_daily p
    JOIN news_daily n ON p.ticker = n.ticker AND p.date = n.date
  WHERE CAST(date_trunc('week', p.date) AS DATE) IN (SELECT wk FROM busy)""", digits=DIGITS), "prices_daily", "news_daily"))
def q_history_busy_weeks(spark, d):
    """Prices beside news, in weeks of more news than usual: only the folders
    of those weeks are read."""
    p, n = histories(spark, d, "prices_daily", "news_daily", since=None)
    weekly = n.groupBy(F.col("period").alias("wk")).agg(F.sum("news_volume").alias("n"))
    usual = weekly.agg(F.avg("n")).first()[0]  # one number
    busy = weekly.where(F.col("n") > F.lit(usual)).select("wk")  # a row per period at most
    j = p.hint("merge").join(n.withColumnRenamed("period", "n_period"), ["ticker", "date"])
    return round_doubles(j.join(F.broadcast(busy), F.col("period") == F.col("wk"), "left_semi").select(
        "ticker", "date", "close", "sentiment_score", "news_volume"), DIGITS)
