"""Dialogue sessions with turns: keyed state with event-time timers.

A session of a key ends after a gap of silence. Its turns are the runs of
messages of one role, in order of time, so messages must be put in order before
they are counted. Messages wait in the key's state until the watermark has passed
them (none that is earlier can come any more); then they are folded, in order,
into the open session, of which only its start, its last message, its numbers
and its last role are kept. A timer wakes a key when its first waiting message
or the end of its open session is passed. So the state of a key holds what came
within the watermark's delay, however long a session lasts.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from parley.streaming.jobs import _end_marker, run_and_close

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_COLUMNS = ("key", "start_us", "last_us", "n_messages", "n_turns", "first_role", "last_role")
_OPEN = "start_us bigint, last_us bigint, n_messages bigint, n_turns bigint, first_role string, last_role string"
_WAITING = "us bigint, id string, role string"


class TurnSessions(StatefulProcessor):
    """Folds the messages of one key into sessions; times are microseconds."""

    def __init__(self, gap_us: int):
        self.gap_us = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _OPEN)
        self.waiting = handle.getListState("waiting", _WAITING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is not None:  # the end marker has no key
            first = None
            for frame in rows:
                new = [(int(us), i, role) for us, i, role in zip(frame["us"], frame["id"], frame["role"])]
                if new:
                    self.waiting.appendList(new)
                    first = min([r[0] for r in new] + ([first] if first is not None else []))
            if first is not None:
                self.handle.registerTimer(first // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(((r[0], r[1], r[2]) for r in self.waiting.get()), key=lambda r: (r[0], r[1] or "")) if self.waiting.exists() else []
        session = list(self.open.get()) if self.open.exists() else None
        later = [r for r in waiting if r[0] > passed]
        closed = []
        for us, _, role in waiting[:len(waiting) - len(later)]:
            if session and us - session[1] >= self.gap_us:
                closed.append(session)
                session = None
            if session is None:
                session = [us, us, 1, 1, role, role]
            else:
                session[1], session[2], session[3], session[5] = us, session[2] + 1, session[3] + (role != session[5]), role
        if session and session[1] + self.gap_us <= passed:
            closed.append(session)
            session = None
        if len(later) < len(waiting):
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
        if session:
            self.open.update(tuple(session))
        elif self.open.exists():
            self.open.clear()
        wake = [r[0] for r in later[:1]] + ([session[1] + self.gap_us] if session else [])
        if wake:
            self.handle.registerTimer(min(wake) // 1000 + 1)
        if closed:
            yield pd.DataFrame([(key[0], *s) for s in closed], columns=list(_COLUMNS))

    def close(self) -> None:
        pass


def turn_sessions(messages: DataFrame, root: str, key: str, ts: str, role: str, order: str, gap: str = "30 minutes", delay: str = "1 hour",
                  flush_at_end: bool = True) -> DataFrame:
    """Stream of messages -> closed sessions per key: start, end, messages, turns (runs of one role), duration.

    Messages of one time follow by ``order``. Messages later than the watermark are dropped, those without a key or a
    time left out. A session shows up once the watermark passes its end; with ``flush_at_end`` an end marker closes
    those that are open when the source is drained. A further call with the same ``root`` goes on from its checkpoint.
    """
    spark = messages.sparkSession
    gap_us = spark.sql(f"SELECT CAST(unix_micros(TIMESTAMP '1970-01-01 00:00:00 UTC' + INTERVAL {gap}) AS BIGINT)").first()[0]
    s = messages.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(order).cast("string").alias("id"), F.col(role).alias("role"))
    s = s.where("ts IS NOT NULL")
    marker, close = _end_marker(spark, root, s, dt.datetime(2262, 1, 1))  # the last year that fits pandas' nanoseconds
    out_schema = f"key {s.schema['key'].dataType.simpleString()}, {_OPEN}"

    def build() -> DataFrame:
        rows = s.unionByName(marker).withWatermark("ts", delay).withColumn("us", F.unix_micros("ts"))
        return rows.groupBy("key").transformWithStateInPandas(TurnSessions(gap_us), out_schema, "append", "eventTime")

    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)  # several state variables per key need it; read when a query starts
    try:
        out = run_and_close(build, root, lambda b, e: b, close if flush_at_end else None)
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)
    res = spark.read.schema(f"{out_schema}, epoch bigint").parquet(out)

    def at(us):
        return F.timestamp_micros(us).cast("timestamp_ntz")

    return res.select(F.col("key").alias(key), at(F.col("start_us")).alias("session_start"), at(F.col("last_us") + gap_us).alias("session_end"),
                      "n_messages", "n_turns", "first_role", "last_role", ((F.col("last_us") - F.col("start_us")) / 1e6).alias("duration_sec"))
