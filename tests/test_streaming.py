"""Stateful streaming jobs equal their batch twins, whatever the order of files."""

import datetime as dt

from pyspark.sql import functions as F

from riskloom.operators import alerts as A
from riskloom.plans import alerts_queries as AQ
from riskloom.session import scratch_table_path
from riskloom.sources.tables import table
from riskloom.streaming import folds, jobs, stateful
from tools.check_oracle import canon_rows

import __spark_entry__ as E


def _same(got, want):
    cols = want.columns
    assert canon_rows(cols, [tuple(r) for r in got.select(*cols).collect()]) == \
        canon_rows(cols, [tuple(r) for r in want.collect()])


def _jobs(spark, base, lateness):
    """Each job as a function that runs it to the end of what has landed."""
    at = lambda n: (spark, f"{base}/landing", f"{base}/sink{n}", f"{base}/ckpt{n}")
    return [lambda: jobs.score_alert_stream(*at(0), lateness_s=lateness),
            lambda: jobs.cooldown_stream(*at(1), lateness_s=lateness),
            lambda: jobs.emit_on_change_stream(*at(2), A.BROADCAST_MIN_CHANGE, AQ.BROADCAST_TTL_S, lateness_s=lateness)]


def _sinks(spark, base):
    return [jobs.read_sink(spark, f"{base}/sink{n}", s) for n, s in enumerate((jobs.ALERT_SCHEMA, jobs.COOLDOWN_SCHEMA, jobs.EMIT_SCHEMA))]


def _batch(spark, ev):
    rows = ev.select(F.col("user_id").alias("id"), "ts", "event_id", (F.col("value") / 100.0).alias("score"))
    alerts = A.change_alerts(A.score_trend(rows, "id", ["ts", "event_id"], "score"))
    return [alerts.select(*[c.split()[0] for c in jobs.ALERT_SCHEMA.split(", ")]),
            folds.alert_cooldown(AQ.candidates_from(spark, ev), "metric_name", "ts", "event_id", "cooldown_s"),
            folds.emit_on_change(AQ.series_scores(ev), "series", ["ts", "event_id"], "score", A.BROADCAST_MIN_CHANGE, AQ.BROADCAST_TTL_S)]


def test_shuffled_files_with_restarts_and_a_delay_below_the_span(spark, sf_small):
    """200 files in four landings; inside a landing files are in no order.  The
    delay is a landing's width, a quarter of the span.  Every landing is a
    restart of all three queries; state connects them."""
    base = scratch_table_path(spark, "test-stream")
    ev = table(spark, sf_small, "events")
    lo, hi = ev.agg(F.min("ts"), F.max("ts")).first()
    width = (hi - lo).total_seconds() / 4 + 1
    parts = ev.withColumn("part", F.floor((F.unix_micros(F.col("ts").cast("timestamp"))
                                           - F.unix_micros(F.lit(lo).cast("timestamp"))) / (width * 1e6)))
    emitted = []
    for i in range(4):
        part = parts.where(F.col("part") == i).drop("part")
        part.withColumn("h", F.pmod(F.xxhash64("event_id"), F.lit(50))).repartition(50, "h").drop("h").sortWithinPartitions(
            F.rand(3)).write.option("maxRecordsPerFile", max(1, part.count() // 50)).parquet(f"{base}/landing/p{i}")
        if i == 3:
            jobs.heartbeat(spark, f"{base}/landing", width)
        queries = [run() for run in _jobs(spark, base, width)]
        assert all(stateful.late_rows(q) == 0 for q in queries)
        emitted.append([s.count() for s in _sinks(spark, base)])
    assert all(0 < a < b for a, b in zip(emitted[1], emitted[3]))       # rows come out before the input has ended
    for got, want in zip(_sinks(spark, base), _batch(spark, ev)):
        _same(got, want)
    flags = [r["change"] for r in _sinks(spark, base)[2].where("emitted").collect()]
    assert 0.0 in flags and any(abs(x) >= 1 for x in flags)
    # after the end no key keeps a waiting row, and expired decisions are gone
    assert [q.lastProgress["stateOperators"][0]["numRowsTotal"] for q in queries[1:]] == [0, 0]
    again = [run() for run in _jobs(spark, base, width)]                # nothing new: nothing comes twice
    assert all(q.exception() is None for q in again)
    assert [s.count() for s in _sinks(spark, base)] == emitted[3]


def test_expiry_and_rows_behind_the_watermark(spark):
    base = scratch_table_path(spark, "test-stream-late")
    t = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    event = lambda i, at, v: (i, at, 1, "error", v, "{}")
    first = [event(1, t(10), 100.0), event(2, t(10, 30), 110.0), event(3, t(10, 59), 200.0), event(4, t(13), 205.0)]
    then = [event(5, t(9), 0.0),             # hours behind the watermark: dropped and counted
            event(6, t(12, 40), 206.0),      # behind event 4, within the delay: takes its place before it
            event(7, t(13, 20), 210.0)]
    spark.createDataFrame(first, jobs.EVENT_SCHEMA).coalesce(1).write.parquet(f"{base}/landing/a=1")
    run = _jobs(spark, base, 1800.0)[2]
    run()
    spark.createDataFrame(then, jobs.EVENT_SCHEMA).coalesce(1).write.parquet(f"{base}/landing/a=2")
    late = stateful.late_rows(run())
    jobs.heartbeat(spark, f"{base}/landing")
    late += stateful.late_rows(run())
    got = {r["event_id"]: (r["emitted"], r["change"]) for r in jobs.read_sink(spark, f"{base}/sink2", jobs.EMIT_SCHEMA).collect()}
    assert late == 1
    assert got == {1: (True, 0.0), 2: (False, None), 3: (True, 2.0), 6: (True, 0.0), 4: (False, None), 7: (False, None)}


def test_empty_events(spark):
    from riskloom.plans import stream_queries as SQ
    base = scratch_table_path(spark, "test-stream-empty")
    none = spark.createDataFrame([], jobs.EVENT_SCHEMA)
    SQ._land(spark, none, f"{base}/landing", lambda width: None)
    assert jobs.read_sink(spark, f"{base}/sink", jobs.ALERT_SCHEMA).count() == 0


def test_online_sgd_stream_equals_batch_learner(spark, sf_small):
    q = E.queries()
    got = q["stream_online_sgd"](spark, sf_small)
    want = q["online_sgd"](spark, sf_small)
    assert got.columns == want.columns
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect())


class _Calls:
    """A handle that counts the calls of a processor to its state."""

    def __init__(self):
        self.calls, self.rows, self.timers = 0, [], set()

    def getListState(self, name, schema):
        return self

    def getValueState(self, name, schema):
        self.value = None
        return _Value()

    def exists(self):
        return bool(self.rows)

    def get(self):
        return iter(self.rows)

    def appendList(self, rows):
        self.calls, self.rows = self.calls + len(rows), self.rows + rows

    def put(self, rows):
        self.calls, self.rows = self.calls + len(rows), list(rows)

    def clear(self):
        self.rows = []

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)


class _Value:
    row = None

    def exists(self):
        return self.row is not None

    def get(self):
        return self.row

    def update(self, row):
        self.row = row

    def clear(self):
        self.row = None


def test_state_is_called_per_block_and_timers_per_key():
    from pyspark.sql import Row
    n, h = 10_000, _Calls()
    p = stateful.ScoreAlerts(1000, 0.1)
    p.init(h)
    made = [Row(id=1, ts=None, us=(i * 7919 % n) * 1_000_000, tie=i, value=float(i % 5)) for i in range(n)]
    assert list(p.handleInputRows((1,), iter(made), None)) == []
    assert h.calls <= n // 1000 and len(h.timers) == 1
    out = []
    for now in (n // 2 * 1000, n * 1000):            # half of the rows are due, then the rest
        clock = type("", (), {"getCurrentWatermarkInMs": lambda self, at=now: at})()
        assert any(t <= now for t in h.timers)
        h.timers = {t for t in h.timers if t > now}
        out += list(p.handleExpiredTimer((1,), clock, None))
    assert not h.exists() and not h.timers
    order = sorted(made, key=lambda r: r.us)
    want = [(b.tie, b.value, a.value) for a, b in zip(order, order[1:]) if abs(b.value - a.value) >= 0.1]
    assert [(r.event_id, r.score, r.previous_score) for r in out] == want
