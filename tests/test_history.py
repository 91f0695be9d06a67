import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from riskloom.operators import joins as J
from riskloom.operators import windows as W
from riskloom.sources import history as H

DAY = dt.date(2024, 1, 1)


def rows_of(seed, n, keys=12, days=120):
    rng = random.Random(seed)
    seen = {(rng.randint(1, keys) if rng.random() < .7 else 0, rng.randint(0, days)) for _ in range(n)}  # key 0 holds a third
    return [(k, DAY + dt.timedelta(days=t), rng.random()) for k, t in seen]


def frame(spark, rows, value="close"):
    return spark.createDataFrame(rows, f"ticker long, date date, {value} double")


def shuffles(df):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_frames_and_aggregates_do_not_shuffle(spark):
    t = H.write_history(frame(spark, rows_of(1, 900)), "h_frames")
    p = H.read_histories(spark, [t], "2024-02-10", "2024-03-20")[0]
    rows, w = W.key_frames(p, "ticker", ["date"], 4)
    df = rows.select("ticker", "date", W.rolling_mean("close", w, 5, 1).alias("m"))
    assert shuffles(df) == [] and shuffles(p.groupBy("ticker").agg(F.avg("close"))) == []
    want = {(r.ticker, r.date) for r in spark.table(t).collect() if dt.date(2024, 2, 10) <= r.date <= dt.date(2024, 3, 20)}
    assert {(r.ticker, r.date) for r in df.collect()} == want and want


def test_frames_of_a_hot_key_are_cut_into_blocks(spark):
    t = H.write_history(frame(spark, rows_of(7, 900)), "h_hot")
    p, = H.read_histories(spark, [t], block_rows=16)
    rows, w = W.key_frames(p, "ticker", ["date"], 4, block_rows=16)
    df = rows.select("ticker", "date", "__i", "__b", "__home", W.rolling_mean("close", w, 5, 1).alias("m"))
    assert any("__b" in s for s in shuffles(df))
    plain = spark.table(t).select("ticker", "date", W.rolling_mean("close", W.key_window("ticker", "date"), 5, 1).alias("m"))
    near = lambda x: {(r.ticker, r.date): round(r.m, 9) for r in x.collect()}
    assert near(W.home_rows(df)) == near(plain)


def test_only_folders_of_the_days_are_read(spark):
    t = H.write_history(frame(spark, rows_of(2, 900)), "h_pruned")
    p = H.read_histories(spark, [t], "2024-02-10", "2024-03-20")[0]
    assert re.search(r"PartitionFilters: \[[^\]]*period#", plan_of(p))
    files = p.inputFiles()
    assert files and all("period=2024-02-01" in f or "period=2024-03-01" in f for f in files)


def test_joins_on_key_and_date_do_not_shuffle(spark):
    a, b = rows_of(3, 900), rows_of(4, 900)
    ta, tb = H.write_history(frame(spark, a), "h_a"), H.write_history(frame(spark, b, "news"), "h_b")
    x, y = [t.drop("period") for t in H.read_histories(spark, [ta, tb])]
    j = x.hint("merge").join(y, ["ticker", "date"])
    assert shuffles(j) == []
    both = {r[:2]: r[2] for r in b}
    assert sorted(map(tuple, j.collect())) == sorted((*r, both[r[:2]]) for r in a if r[:2] in both)
    busy = spark.createDataFrame([(dt.date(2024, m, 1),) for m in (1, 2)], "wk date").where("wk > '2024-01-15'")
    pruned = spark.table(ta).join(F.broadcast(busy), F.col("period") == F.col("wk"), "left_semi")
    assert "dynamicpruning" in plan_of(pruned)
    assert {r.date.month for r in pruned.collect()} == {2}


@pytest.mark.parametrize("block_rows", [W.BLOCK_ROWS, 20])  # 20: keys larger than a block take the shuffled form
def test_asof_equals_the_shuffled_join(spark, block_rows):
    a, b = rows_of(5, 700), rows_of(6, 150)
    a.append((77, dt.date(2024, 1, 5), 1.0))
    tables = H.write_history(frame(spark, a), "h_l"), H.write_history(frame(spark, b, "price"), "h_r")
    left, right = [t.drop("period") for t in H.read_histories(spark, tables, block_rows=block_rows)]
    got = H.asof_nearest(left, right, "ticker", "date", 4, ["price"], block_rows)
    assert (shuffles(got) == []) == (block_rows == W.BLOCK_ROWS)
    by_key = {}
    for k, t, v in b:
        by_key.setdefault(k, []).append((t, v))
    want = []
    for k, t, v in a:
        near = sorted((abs((t - s).days), s, p) for s, p in by_key.get(k, []) if abs((t - s).days) <= 4)
        want.append((k, t, v, near[0][2] if near else None))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert got.exceptAll(J.asof_nearest_join(left, right, "ticker", "date", 4, ["price"])).count() == 0


def test_nulls_empty_tables_and_names(spark):
    rows = [(None, DAY, 1.0), (1, None, 2.0), (1, DAY, None), (1, DAY, None)]
    t = H.write_history(frame(spark, rows), "h_nulls", buckets=3)
    assert sorted(map(str, map(tuple, spark.table(t).drop("period").collect()))) == sorted(map(str, rows))
    assert H.read_histories(spark, [H.write_history(frame(spark, []), "h_empty")], "2024-01-01")[0].count() == 0
    with pytest.raises(ValueError):
        H.write_history(frame(spark, rows, "period"), "h_clash")
    with pytest.raises(ValueError):
        H.write_history(frame(spark, rows), "h_unit", period="hour")


def test_queries_keep_the_layout(spark, sf_small):
    import __spark_entry__ as E
    q = E.queries()
    assert not any("ticker" in s for s in shuffles(q["history_rolling"](spark, sf_small)))
    assert not any("ticker" in s for s in shuffles(q["history_beta"](spark, sf_small)))
    assert shuffles(q["history_asof"](spark, sf_small)) == []
    busy = q["history_busy_weeks"](spark, sf_small)
    assert not any("ticker" in s for s in shuffles(busy)) and "dynamicpruning" in plan_of(busy)
