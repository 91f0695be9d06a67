"""The cooldown by prefix composition equals the sequential fold."""

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskloom.streaming import folds

T0 = dt.datetime(2024, 1, 1)


def _fold(rows):
    """(rule, us, id, cooldown) -> ids that fire."""
    last, out = {}, set()
    for rule, us, eid, cd in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        if rule not in last or (cd is not None and us - last[rule] > cd * 1_000_000):
            out.add(eid)
            last[rule] = us
    return out


def _run(spark, rows, block_rows, extra=()):
    df = spark.createDataFrame([(rule, T0 + dt.timedelta(microseconds=us), eid, cd, 1, 2) for rule, us, eid, cd in rows],
                               "metric_name string, ts timestamp_ntz, event_id bigint, cooldown_s double, block int, k int")
    got = folds.alert_cooldown(df, "metric_name", "ts", "event_id", "cooldown_s", block_rows=block_rows)
    assert got.columns == [*df.columns, "fired"]
    rows = got.collect()
    assert len(rows) == len({r["event_id"] for r in rows}) == df.count()
    return {r["event_id"] for r in rows if r["fired"]}


def _candidates(seed=11, n=900):
    """One hot rule with two cooldowns, bursts, gaps and equal times; small rules."""
    rnd = random.Random(seed)
    rows, eid = [], 0
    for rule, cds, n in (("cpu", (1800.0, 3600.0), n), ("mem", (3600.0,), 150), ("disk", (60.0, None, 0.0), 40), (None, (5.0,), 3)):
        t = 0
        for _ in range(n):
            t += rnd.choice([0, 10, 300, 900, 1700, 1800, 1801, 4000])
            eid += 1
            rows.append((rule, t * 1_000_000, eid, rnd.choice(cds)))
    return rows


@pytest.mark.parametrize("block_rows", [1, 7, 64, 1 << 16])
def test_composition_equals_fold(spark, block_rows, monkeypatch):
    monkeypatch.setattr(folds, "FAN", 5)     # several levels
    rows = _candidates()
    want = _fold(rows)
    assert 50 < len(want) < len(rows) - 50
    assert _run(spark, rows, block_rows) == want


def test_million_candidates_of_one_rule_with_two_cooldowns(spark):
    from pyspark.sql import functions as F
    n = 1_000_000
    df = spark.range(n).select(
        F.lit("cpu").alias("metric_name"), F.col("id").alias("event_id"),
        F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 7 + (id * id) % 5)").alias("ts"),
        F.when(F.xxhash64("id") % 3 == 0, 1800.0).otherwise(3600.0).alias("cooldown_s"))
    rows = df.select("ts", "event_id", "cooldown_s").orderBy("ts", "event_id").toPandas()
    us, cd = rows["ts"].to_numpy().astype("datetime64[us]").astype(np.int64), rows["cooldown_s"].to_numpy() * 1e6
    want, last = [], None
    for t, c, i in zip(us.tolist(), cd.tolist(), rows["event_id"].tolist()):
        if last is None or t - last > c:
            want.append(i)
            last = t
    got = folds.alert_cooldown(df, "metric_name", "ts", "event_id", "cooldown_s").where("fired").select("event_id").collect()
    assert sorted(r[0] for r in got) == sorted(want)


def test_empty(spark):
    df = spark.createDataFrame([], "m string, ts timestamp_ntz, id long, cd double")
    assert folds.alert_cooldown(df, "m", "ts", "id", "cd").count() == 0


steps = st.lists(st.tuples(st.integers(0, 6), st.sampled_from([0.0, 2e-6, 5e-6, 9e-6, float("nan")])), min_size=1, max_size=24)


@settings(max_examples=300, deadline=None)
@given(steps, st.lists(st.integers(0, 24), max_size=5))
def test_composed_functions_carry_the_last_fire(rows, cuts):
    t = np.cumsum([s for s, _ in rows]).astype(np.int64)
    cd = np.array([c for _, c in rows])
    want, last = [], None
    for x, c in zip(t, cd):
        fire = last is None or x - last > c * 1e6
        want.append(fire)
        last = x if fire else last
    edges = sorted({0, len(t), *[c for c in cuts if c < len(t)]})
    blocks = [folds.Block(t[a:b], cd[a:b]) for a, b in zip(edges, edges[1:])]
    at, whole, got = folds.NEVER, None, []
    for b in blocks:
        got += b.fired(int(at)).tolist()
        at = int(folds.applied(b.function(), np.array(at)))
        whole = b.function() if whole is None else folds.composed(whole, b.function())
    assert got == want
    assert at == last == int(folds.applied(whole, np.array(folds.NEVER)))


def test_emit_on_change_with_and_without_expiry(spark):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [("a", at(0), 5.0), ("a", at(10), 5.5), ("a", at(20), 6.0), ("a", at(79), 6.5), ("a", at(80), 6.5), ("a", at(100), None),
            ("a", at(140), 6.6), ("b", at(0), 1.0), (None, at(0), 1.0), (None, at(70), 1.2)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")
    got = {ttl: sorted([(str(r.k), r.ts, r.change) for r in folds.emit_on_change(df, "k", ["ts"], "v", 1.0, ttl).collect() if r.emitted])
           for ttl in (None, 3600.0)}
    assert got[None] == [("None", at(0), 0.0), ("a", at(0), 0.0), ("a", at(20), 1.0), ("b", at(0), 0.0)]
    assert got[3600.0] == [("None", at(0), 0.0), ("None", at(70), 0.0), ("a", at(0), 0.0), ("a", at(20), 1.0), ("a", at(80), 0.0),
                           ("a", at(140), 0.0), ("b", at(0), 0.0)]
