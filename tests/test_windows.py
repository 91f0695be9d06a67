"""Blocked (hot-key) row frames equal the unsplit windows exactly."""

import datetime as dt
import random

from pyspark.sql import functions as F

from riskloom.operators import windows as W
from riskloom.plans.company_panel import market_features


def _ticks(spark, seed=3):
    rnd = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1)
    rows, eid = [], 0
    for ticker, n in ((1, 1000), (2, 37), (3, 250)):
        for i in range(n):
            eid += 1
            # long NULL runs: the forward fill must carry across several blocks
            close = None if (ticker == 1 and 150 <= i < 520) or rnd.random() < 0.1 else round(rnd.uniform(1, 100), 2)
            rows.append((ticker, t0 + dt.timedelta(minutes=i), eid, (t0 + dt.timedelta(minutes=i)).date(),
                         close, float(rnd.randint(0, 99)), rnd.uniform(-1, 1)))
    return spark.createDataFrame(rows, "ticker bigint, ts timestamp_ntz, event_id bigint, date date, "
                                       "close double, volume double, sentiment_score double")


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_market_features_blocked_equals_unsplit(spark):
    t = _ticks(spark)
    small = market_features(t, block_rows=200)   # ticker 1: five blocks, 199-row halos
    whole = market_features(t, block_rows=1 << 20)
    assert small.count() == t.count()
    assert _rows(small) == _rows(whole)


def test_forward_fill_carries_across_blocks(spark):
    t = _ticks(spark)
    p = W.row_position(t, "ticker", ["ts", "event_id"])
    got = {(r["ticker"], r["__i"]): r["ff"] for r in
           W.ffill_positioned(p, "ticker", {"close": "ff"}, block_rows=64).select("ticker", "__i", "ff").collect()}
    by_key = {}
    for r in sorted(t.collect(), key=lambda r: (r.ticker, r.ts, r.event_id)):
        by_key.setdefault(r.ticker, []).append(r.close)
    for k, vals in by_key.items():
        cur = None
        for i, v in enumerate(vals):
            cur = v if v is not None else cur
            assert got[(k, i)] == cur, (k, i)


def test_row_position_is_exact(spark):
    t = _ticks(spark)
    p = W.row_position(t, "ticker", ["ts", "event_id"]).select("ticker", "event_id", "__i")
    want = {}
    for r in sorted(t.collect(), key=lambda r: (r.ticker, r.ts, r.event_id)):
        want[r.event_id] = want.get(("n", r.ticker), 0)
        want[("n", r.ticker)] = want[r.event_id] + 1
    assert all(want[r["event_id"]] == r["__i"] for r in p.collect())


def test_newest_n_hot_path_equals_window(spark):
    t = _ticks(spark)
    key = "spark.sql.optimizer.windowGroupLimitThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "0")  # force the exact-position path for a key > block
    try:
        for n in (1, 7, 300):
            hot = W.newest_n(t, "ticker", ["ts", "event_id"], n, block_rows=100)
            plain = W.newest_n(t, "ticker", ["ts", "event_id"], n, block_rows=1 << 20)
            assert _rows(hot) == _rows(plain)
    finally:
        spark.conf.set(key, old)


def test_rate_breach_time_buckets_equal_window(spark):
    from riskloom.operators.alerts import rate_breach
    t = _ticks(spark)  # one row per minute per ticker
    for win_s, limit in ((300, 4), (3600, 30)):
        hot = rate_breach(t, "ticker", "ts", win_s, limit, block_rows=100)
        plain = rate_breach(t, "ticker", "ts", win_s, limit, block_rows=1 << 20)
        assert hot.count() > 0
        assert _rows(hot) == _rows(plain)
