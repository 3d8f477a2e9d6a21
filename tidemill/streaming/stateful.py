"""Rules that fold a stream of rows per key, with state that lasts and timers in event time.

A rule is a small step function over one key: it takes the rows of the key in order of time,
keeps a state, and may name a moment at which something falls due.  What falls due before the
next row is given in its place before that row; what is due when no row comes is given by a
timer once the watermark has passed it.  So the result depends on the rows' times alone, not on
how they are cut into micro-batches, as long as no row is later than the watermark allows.

Keys are dealt into a fixed number of buckets, and a call takes the rows of one bucket and one
micro-batch: a call to Python and its state costs some milliseconds, whatever it holds.  So a
stream of many keys needs no more calls than BUCKETS a micro-batch.  A task holds the rows of one
bucket and one micro-batch, which the source's limits bound (maxFilesPerTrigger,
maxBytesPerTrigger), and the states of the bucket's keys.  State lives in the RocksDB store.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HOUR = 3_600_000_000  # microseconds, the unit of all times here
#: Buckets of keys; a stream keeps the number that it began with.
BUCKETS = 1024
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class ChangeLog:
    """Keeps a row whose value differs from the one kept before it, or whose predecessor is older than retain.

    state: (value, kept); a key whose last kept row is past retention is forgotten.
    """

    retain: int | None = None
    state = "value string, kept bigint"
    given = "number bigint, at bigint, value string"

    def step(self, state: tuple | None, row: tuple) -> tuple[tuple | None, list[tuple]]:
        number, at, value = row
        if state is not None and state[0] == value:
            return state, []
        return (value, at), [(number, at, value)]

    def due(self, state: tuple | None) -> int | None:
        return None if state is None or self.retain is None else state[1] + self.retain + 1

    def fire(self, state: tuple, at: int) -> tuple[tuple | None, list[tuple]]:
        return None, []


@dataclass(frozen=True)
class Lifecycle:
    """Offers that are seen, asked about and closed; an open one falls due a while after its last check.

    Values: seen (opens or opens again), open and closed (answers), anything else changes
    nothing.  Answers about offers that are unknown or closed change nothing.
    state: (closed, checked, asked).
    """

    recheck: int = 24 * HOUR
    state = "closed bigint, checked bigint, asked boolean"
    given = "number bigint, at bigint, status string"

    def step(self, state: tuple | None, row: tuple) -> tuple[tuple | None, list[tuple]]:
        number, at, value = row
        is_open = state is not None and state[0] is None
        if value == "seen":
            return (None, at, False), [(number, at, "checked" if is_open else "opened")]
        if is_open and value == "open":
            return (None, at, False), [(number, at, "checked")]
        if is_open and value == "closed":
            return (at, at, False), [(number, at, "closed")]
        return state, []

    def due(self, state: tuple | None) -> int | None:
        return state[1] + self.recheck if state is not None and state[0] is None and not state[2] else None

    def fire(self, state: tuple, at: int) -> tuple[tuple | None, list[tuple]]:
        return (None, state[1], True), [(None, at, "due")]


@dataclass(frozen=True)
class Queue:
    """Documents that are requested, taken, and end ready or failed.

    Values: request (a new round, unless one is pending or running), take (starts a pending one
    that does not wait), done, cut (once back to pending, then failed), refused (failed), credit
    (back to pending, to wait for backoff; the attempt does not count).  One that runs for
    longer than stuck goes back to pending.  state: (status, since, retried, attempts, wait).
    """

    stuck: int = HOUR // 4
    backoff: int = 6 * HOUR
    state = "status string, since bigint, retried boolean, attempts int, wait bigint"
    given = "number bigint, at bigint, cause string, before string, after string, attempts int"

    def step(self, state: tuple | None, row: tuple) -> tuple[tuple | None, list[tuple]]:
        number, at, value = row
        status, since, retried, attempts, wait = state or (None, None, False, 0, None)
        if value == "request" and status in (None, "ready", "failed"):
            new = ("pending", at, False, 0, None)
        elif value == "take" and status == "pending" and wait is None:
            new = ("running", at, retried, attempts + 1, None)
        elif status == "running" and value == "done":
            new = ("ready", at, retried, attempts, None)
        elif status == "running" and value == "cut" and not retried:
            new = ("pending", at, True, attempts, None)
        elif status == "running" and value in ("cut", "refused"):
            new = ("failed", at, retried, attempts, None)
        elif status == "running" and value == "credit":
            new = ("pending", at, retried, attempts - 1, at + self.backoff)
        else:
            return state, []
        return new, [(number, at, value, status, new[0], new[3])]

    def due(self, state: tuple | None) -> int | None:
        if state is None:
            return None
        return state[1] + self.stuck if state[0] == "running" else state[4]

    def fire(self, state: tuple, at: int) -> tuple[tuple | None, list[tuple]]:
        status, _, retried, attempts, _ = state
        return ("pending", at, retried, attempts, None), [(None, at, "requeued" if status == "running" else "resumed", status, "pending", attempts)]


Rule = ChangeLog | Lifecycle | Queue


class Fold(StatefulProcessor):
    """Runs a rule: the states of a bucket's keys as one list, and one timer for what falls due next in the bucket."""

    def __init__(self, rule: Rule) -> None:
        self.rule = rule
        self.columns = ["key", *[x.split()[0] for x in rule.given.split(", ")]]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.states = handle, handle.getListState("states", f"key bigint, {self.rule.state}")

    def _load(self) -> dict[int, tuple]:
        return {row[0]: tuple(row[1:]) for row in self.states.get()}

    def _fire_until(self, key: int, state: tuple | None, now: int, out: list[tuple]) -> tuple | None:
        while (due := self.rule.due(state)) is not None and due <= now:
            state, rows = self.rule.fire(state, due)
            out += [(key, *row) for row in rows]
        return state

    def _store(self, states: dict[int, tuple | None]) -> None:
        kept = {key: state for key, state in states.items() if state is not None}
        if kept:
            self.states.put([(key, *state) for key, state in kept.items()])
        else:
            self.states.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if (due := min((x for x in map(self.rule.due, kept.values()) if x is not None), default=None)) is not None:
            self.handle.registerTimer(-(-due // 1000))

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=self.columns, dtype=object)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        own = sorted((row for frame in rows for row in zip(*[frame[c].tolist() for c in ("key", "at", "number", "value")], strict=True)), key=lambda r: r[:3])
        states, out = self._load(), []
        for k, mine in groupby(own, key=lambda r: r[0]):
            state = states.get(k)
            for _, at, number, value in mine:
                state = self._fire_until(k, state, at, out)
                state, given = self.rule.step(state, (number, at, value))
                out += [(k, *row) for row in given]
            states[k] = state
        self._store(states)
        yield self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out: list[tuple] = []
        now = timerValues.getCurrentWatermarkInMs() * 1000
        self._store({k: self._fire_until(k, state, now, out) for k, state in self._load().items()})
        yield self._frame(out)

    def close(self) -> None:
        pass


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """The session's state store is RocksDB inside; queries that run keep the store they began with."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def fold(stream: DataFrame, rule: Rule, key: str, at: str, number: str, value: Column, delay: str = "1 hour") -> DataFrame:
    """key and what rule gives of the stream's rows; number (bigint) tells rows of one time apart and names them.

    Rows without a key or a time take no part; a row later than delay behind the newest time
    seen in earlier micro-batches is dropped, as by any watermark.
    """
    known = stream.where(F.col(key).isNotNull() & F.col(at).isNotNull()).withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    rows = known.select(F.col(key).cast("bigint").alias("key"), F.col(at).alias("moment"), F.unix_micros(at).alias("at"), F.col(number).cast("bigint").alias("number"), value.cast("string").alias("value"))
    return rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int")).groupBy("bucket").transformWithStateInPandas(Fold(rule), f"key bigint, {rule.given}", "Append", "EventTime")
