"""Stateful operators on streams, with state in Spark's state store.

Events reach a key in any order within the watermark's delay.  Each key keeps
its waiting rows as list state (an entry holds up to ``ENTRY_ROWS`` rows, column
by column, so the state store is called per block and not per row) and the
outcome of its last decision (previous score, last fired alert, last emitted
value) as value state.  An event-time timer for the earliest waiting row
releases rows once the watermark has passed them: no row before them can
still come, so they are decided in event-time order, and the result is that of
the batch operator however rows were dealt to files and micro-batches.  Rows
behind the watermark are dropped by Spark and counted in the query's progress
(``late_rows``).

State does not outlive its use: where a last decision expires (an emitted value
after an hour, a fired alert after its longest cooldown), a timer removes it.

The state of one key sits in one task, as in any keyed stream; between two
micro-batches it holds the key's rows of one watermark delay.
"""

from __future__ import annotations

import datetime as dt
from bisect import bisect_right
from collections.abc import Iterator
from operator import itemgetter

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from riskloom.streaming.folds import emit_step

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ENTRY_ROWS = 4096             # rows of one entry of the list state
_EPOCH = dt.datetime(1970, 1, 1)


def _time(us: int) -> dt.datetime:
    return _EPOCH + dt.timedelta(microseconds=us)


class InOrder(StatefulProcessor):
    """Decides the rows of each key in event-time order.

    Input rows: key, ``ts`` (the watermark's column), ``us``, ``tie`` (long) and
    ``value`` (double), then those named in ``more``.  Rows with a null key only
    move the watermark."""

    more = ""                     # further columns of waiting rows, as DDL
    last_schema = ""              # columns of the last decision, as DDL; the first is its time in microseconds

    def __init__(self, step_ms: int):
        self.step_ms = max(1, step_ms)        # timers are set on multiples of this

    def init(self, handle) -> None:
        self.handle = handle
        columns = "us long, tie long, value double" + (f", {self.more}" if self.more else "")
        self.names, types = zip(*(c.split() for c in columns.split(", ")))
        self.waiting = handle.getListState("waiting", ", ".join(f"{n} array<{t}>" for n, t in zip(self.names, types)))
        self.last = handle.getValueState("last", self.last_schema)

    def decide(self, key, row: tuple, last: tuple | None) -> tuple[Row | None, tuple | None]:
        """What to put out for the row, and the last decision after it."""
        raise NotImplementedError

    def expires(self, last: tuple) -> int | None:
        """When a last decision has no more effect, in microseconds."""
        return None

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[0] is None:
            return
        new, at = [], None
        for r in rows:
            at = at or [r.__fields__.index(c) for c in self.names]
            values = tuple(r)
            new.append(tuple([values[i] for i in at]))
        self.waiting.appendList(self.packed(new))
        self.wake(min(r[0] for r in new))
        yield from ()

    def packed(self, rows: list[tuple]) -> list[tuple]:
        return [tuple(map(list, zip(*rows[i:i + ENTRY_ROWS]))) for i in range(0, len(rows), ENTRY_ROWS)]

    def wake(self, us: int) -> None:
        """A timer for the earliest of some waiting rows; when it goes off, the
        earliest of those left gets the next."""
        self.handle.registerTimer(-(-us // (self.step_ms * 1000)) * self.step_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(r for entry in self.waiting.get() for r in zip(*entry)) if self.waiting.exists() else []
        due = rows[:bisect_right(rows, now, key=itemgetter(0))]
        last = tuple(self.last.get()) if self.last.exists() else None
        for row in due:
            out, last = self.decide(key, row, last)
            if out is not None:
                yield out
        if due:
            if len(due) == len(rows):
                self.waiting.clear()
            else:
                self.waiting.put(self.packed(rows[len(due):]))
                self.wake(rows[len(due)][0])
        end = None if last is None else self.expires(last)
        if end is not None and end <= now and len(due) == len(rows):
            last = None
        elif end is not None:
            self.handle.registerTimer(max(end, now) // 1000 + 1)
        if last is None:
            self.last.clear()
        else:
            self.last.update(last)

    def close(self) -> None:
        pass


class ScoreAlerts(InOrder):
    """Rows whose score moved by ``threshold`` or more since the key's previous row."""

    last_schema = "us long, value double"

    def __init__(self, step_ms: int, threshold: float):
        super().__init__(step_ms)
        self.threshold = threshold

    def decide(self, key, row, last):
        us, tie, score = row
        before = None if last is None else last[1]
        delta = None if score is None or before is None else score - before
        out = None
        if delta is not None and abs(delta) >= self.threshold:
            out = Row(id=key[0], ts=_time(us), event_id=tie, score=score, previous_score=before,
                      trend="IMPROVING" if delta > 0 else "WORSENING" if delta < 0 else "FLAT", delta=delta,
                      delta_abs=abs(delta), threshold=self.threshold, direction="UP" if delta > 0 else "DOWN" if delta < 0 else "FLAT")
        return out, (us, score)


class Cooldown(InOrder):
    """All candidates with whether they fire; a fired one stays for the longest
    cooldown."""

    more = "severity string, cooldown_s double"
    last_schema = "us long"

    def __init__(self, step_ms: int, longest_s: float):
        super().__init__(step_ms)
        self.longest_us = int(longest_s * 1e6)

    def decide(self, key, row, last):
        us, tie, value, severity, cooldown = row
        fired = last is None or (cooldown is not None and us - last[0] > cooldown * 1e6)
        return (Row(metric_name=key[0], ts=_time(us), event_id=tie, value=value, severity=severity, cooldown_s=cooldown, fired=fired),
                (us,) if fired else last)

    def expires(self, last):
        return last[0] + self.longest_us + 1


class EmitOnChange(InOrder):
    """All rows with whether their value is emitted; an emitted value expires."""

    last_schema = "us long, value double"

    def __init__(self, step_ms: int, min_change: float, ttl_s: float):
        super().__init__(step_ms)
        self.min_change, self.ttl_us = min_change, int(round(ttl_s * 1e6))

    def decide(self, key, row, last):
        us, tie, value = row
        emitted, change = False, None
        if value is not None:
            at, before = (None, None) if last is None else last
            emitted, change = emit_step(before, at, value, us, self.min_change, self.ttl_us)
        return (Row(series=key[0], ts=_time(us), event_id=tie, score=value, emitted=emitted, change=change),
                (us, value) if emitted else last)

    def expires(self, last):
        return last[0] + self.ttl_us


def in_order(rows: DataFrame, key: str, processor: InOrder, schema: str, lateness_s: float) -> DataFrame:
    """``processor`` over a stream of (key, ts timestamp_ntz, tie, value, ...)."""
    at = rows.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("ts", F.col("ts").cast("timestamp"))
    return (at.withWatermark("ts", f"{int(lateness_s * 1000)} milliseconds").groupBy(key)
            .transformWithState(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime"))


def run_to_end(out: DataFrame, sink: str, checkpoint: str):
    """Runs the stream over all that has landed; returns the finished query."""
    spark = out.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)             # timers and list state need it; kept by the query from its start
    try:
        q = (out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    finally:
        spark.conf.set(name, before)
    q.awaitTermination()
    return q


def late_rows(query) -> int:
    """Rows that came behind the watermark in the query's recent micro-batches."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
