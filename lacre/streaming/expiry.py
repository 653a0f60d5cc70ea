"""Jobs that expire by timers: a state for each job, with a deadline that events may put off.

The time to live runs from a job's first event; ``renewed`` starts it anew. A timer is set for each
deadline, and when it fires the deadline is looked at again: a job that was renewed meanwhile stays
and gets a timer for its new one. So it does not matter whether an old timer still fires. In
processing time the timers go off by the clock, with or without events; in event time by the
watermark. A deleted job leaves a tombstone until its deadline, so that a later event does not bring
it back; after the deadline nothing is kept.

A job's events are folded row by row, and its state is asked for once and written once: each call
to the state is a message to Spark, and with many jobs these, not the events, take the time. Times
are kept as microseconds since 1970, whatever the session's time zone is.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from .jobs import STATES, TTL_MINUTES

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "deadline bigint, ts bigint, seq bigint, event string, began boolean"
RENEWED, DELETED, GONE, EXPIRED = "renewed", "deleted", "apagado", "expirado"
EPOCH, MICROSECOND = datetime(1970, 1, 1, tzinfo=UTC), timedelta(microseconds=1)


class JobLife(StatefulProcessor):
    """A row whenever a job's state changes: status, progresso, expira_em."""

    def __init__(self, ttl: timedelta, by_clock: bool):
        self.ttl, self.by_clock = ttl // MICROSECOND, by_clock
        self.after = {event: (status, progress) for event, status, progress in STATES}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", STATE)

    def now(self, timers) -> int:
        return timers.getCurrentProcessingTimeInMs() if self.by_clock else timers.getCurrentWatermarkInMs()

    def row(self, key: tuple, status: str, progress: float | None, deadline: int) -> Row:
        return Row(id=key[0], status=status, progresso=progress, expira_em=EPOCH + deadline * MICROSECOND)

    def remind(self, deadline: int, now: int, new: bool = False) -> None:
        at = max(deadline // 1000, now + 1)
        if new or at not in set(self.handle.listTimers()):
            self.handle.registerTimer(at)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = last = renewal = move = None
        gone = False
        for row in rows:
            kind, ts = row["event"], row["ts"]
            gone |= kind == DELETED
            if ts is None:
                continue  # an event without a time only deletes
            at = (ts, row["seq"])
            first = at[0] if first is None else min(first, at[0])
            last = at if last is None else max(last, at)
            if kind == RENEWED:
                renewal = at[0] if renewal is None else max(renewal, at[0])
            elif (kind in self.after or kind == DELETED) and (move is None or move[0] <= at):
                move = (at, kind)
        held = self.job.get()
        if held is None and last is None:
            return
        deadline, ts, seq, event, began = held or (None, None, None, None, False)
        known, until = event, deadline
        # Until it is renewed, a job's time runs from its earliest event, also one that comes late.
        if first is not None and (deadline is None or not began and first + self.ttl < deadline):
            until = first + self.ttl
        if renewal is not None:
            until, began = max(until, renewal + self.ttl), True
        if gone:
            event = DELETED
        elif event != DELETED and move and (ts is None or (ts, seq) < move[0]):
            (ts, seq), event = move
        if ts is None:
            ts, seq = last
        self.job.update((until, ts, seq, event, began))
        # A deadline that stays has its timer.
        if until != deadline:
            self.remind(until, self.now(timerValues), deadline is None)
        if event == DELETED:
            if known != DELETED:
                yield self.row(key, GONE, None, until)
        elif event is not None:
            yield self.row(key, *self.after[event], until)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.job.get()
        if held is None:
            return
        deadline, event = held[0], held[3]
        if deadline // 1000 > expiredTimerInfo.getExpiryTimeInMs() and deadline // 1000 > self.now(timerValues):
            self.remind(deadline, self.now(timerValues))
            return
        self.job.clear()
        if event not in (None, DELETED):
            yield self.row(key, EXPIRED, None, deadline)

    def close(self) -> None:
        pass


def lives(events: DataFrame, ttl: timedelta = timedelta(minutes=TTL_MINUTES), by_clock: bool = False) -> DataFrame:
    """The states of jobs, as a stream, from a stream of events (id, ts, seq, event); without ``by_clock`` it needs a watermark on ``ts``."""
    spark = events.sparkSession
    with_rocksdb(spark)
    # The process in which Spark prepares a processor on the driver's side sees no shipped package: the class travels itself.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    output = StructType.fromDDL(f"id {dict(events.dtypes)['id']}, status string, progresso double, expira_em timestamp")
    # Rows come to Python value by value, and a number is read faster than a timestamp.
    rows = events.select("id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "seq", "event")
    mode = "ProcessingTime" if by_clock else "EventTime"
    return rows.groupBy("id").transformWithState(JobLife(ttl, by_clock), output, "Update", mode)


def with_rocksdb(spark: SparkSession) -> None:
    """State with timers is kept in RocksDB; a session that names another provider keeps it."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "HDFSBacked" in spark.conf.get(key, "HDFSBacked"):
        spark.conf.set(key, PROVIDER)
