"""State that lasts: rules whatever the micro-batches, batches that run again, and readers during a replacement."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from tidemill.operators.published import BatchLog, Published
from tidemill.streaming import feeds, stateful, streams

HOUR = stateful.HOUR
EVENTS = "number long, ts timestamp, user long, value string"


def plain(rule, rows, until):
    """A rule over the rows of one key, in one go."""
    state, out = None, []

    def fire(state, now):
        while (due := rule.due(state)) is not None and due <= now:
            state, given = rule.fire(state, due)
            out.extend(given)
        return state

    for at, number, value in sorted(rows):
        state = fire(state, at)
        state, given = rule.step(state, (number, at, value))
        out.extend(given)
    fire(state, until)
    return out


def test_queue_rule():
    minute = HOUR // 60
    rows = [(0, 1, "take"), (1, 2, "request"), (2, 3, "take"), (20 * minute, 4, "take"), (21 * minute, 5, "credit"), (22 * minute, 6, "take"), (382 * minute, 7, "take"), (383 * minute, 8, "cut"), (384 * minute, 9, "take"), (385 * minute, 10, "cut"), (386 * minute, 11, "request"), (387 * minute, 12, "request")]
    got = [(x[2], x[3], x[4], x[5]) for x in plain(stateful.Queue(), rows, 1000 * minute)]
    assert got == [
        ("request", None, "pending", 0), ("take", "pending", "running", 1), ("requeued", "running", "pending", 1), ("take", "pending", "running", 2), ("credit", "running", "pending", 1),
        ("resumed", "pending", "pending", 1), ("take", "pending", "running", 2), ("cut", "running", "pending", 2), ("take", "pending", "running", 3), ("cut", "running", "failed", 3), ("request", "failed", "pending", 0),
    ]


def test_lifecycle_rule():
    rows = [(0, 1, "closed"), (1, 2, "seen"), (2, 3, "unknown"), (3, 4, "open"), (30 * HOUR, 5, "closed"), (31 * HOUR, 6, "open"), (32 * HOUR, 7, "seen")]
    got = [(x[1], x[2]) for x in plain(stateful.Lifecycle(), rows, 50 * HOUR)]
    assert got == [(1, "opened"), (3, "checked"), (3 + 24 * HOUR, "due"), (30 * HOUR, "closed"), (32 * HOUR, "opened")]


@pytest.mark.parametrize("rule", [stateful.Queue(2 * HOUR, 9 * HOUR), stateful.Lifecycle(5 * HOUR), stateful.ChangeLog(7 * HOUR)], ids=lambda r: type(r).__name__)
def test_rules_do_not_depend_on_the_batches(spark, rule):
    rng = random.Random(2)
    words = ["request", "take", "take", "done", "cut", "credit", "refused"] if isinstance(rule, stateful.Queue) else ["seen", "open", "closed", "unknown"]
    rows = [(i, 1_700_000_000_000_000 + rng.randrange(200) * HOUR + i, rng.randrange(6), rng.choice(words)) for i in range(300)]
    frame = spark.createDataFrame(rows, "number long, at long, user long, value string").select("number", F.timestamp_micros("at").alias("ts"), "user", "value")
    edge = [str(frame.agg(F.percentile_approx(F.unix_micros("ts"), q).alias("m")).select(F.timestamp_micros("m")).first()[0]) for q in (0.3, 0.6)]
    newest = max(r[1] for r in rows)
    with stateful.rocks(spark):
        found = streams.run_available(stateful.fold(feeds.staged(frame, "ts", edge), rule, "user", "ts", "number", F.col("value")))
    want = [(user, *x) for user in range(6) for x in plain(rule, [(at, n, v) for n, at, u, v in rows if u == user], newest - HOUR)]
    assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(map(repr, want))


class _Handle:
    """The calls that a stream's state gets."""

    def __init__(self):
        self.rows, self.timers, self.calls = [], [], []

    def getListState(self, name, schema):  # noqa: N802
        return self

    def get(self):
        self.calls.append("get")
        return iter(self.rows)

    def put(self, rows):
        self.calls.append("put")
        self.rows = rows

    def clear(self):
        self.rows = []

    def listTimers(self):  # noqa: N802
        return iter(self.timers)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return 14 * HOUR // 1000


def test_one_call_takes_all_keys_of_a_bucket():
    """A thousand offers in one call: their rows, what falls due among them, one read and one write of state, one timer."""
    fold, handle = stateful.Fold(stateful.Lifecycle(5 * HOUR)), _Handle()
    fold.init(handle)
    rows = [(user, k * 10 * HOUR + user, 2 * user + k, "seen") for k in (1, 0) for user in range(1000)]
    frames = [pd.DataFrame(rows[i : i + 700], columns=["key", "at", "number", "value"]) for i in range(0, 2000, 700)]
    got = [tuple(r) for frame in fold.handleInputRows((0,), iter(frames), None) for r in frame.itertuples(index=False)]
    want = [(user, *x) for user in range(1000) for x in plain(stateful.Lifecycle(5 * HOUR), [r[1:] for r in rows if r[0] == user], 0)]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) == 3000
    assert handle.calls == ["get", "put"] and handle.timers == [15 * HOUR // 1000]
    assert sum(len(f) for f in fold.handleExpiredTimer((0,), handle, None)) == 0  # not before the watermark
    handle.getCurrentWatermarkInMs = lambda: 16 * HOUR // 1000
    assert sum(len(f) for f in fold.handleExpiredTimer((0,), handle, None)) == 1000 and handle.timers == []


def notices(spark, where, n=3):
    rows = [(i, i // 4, i % 5) for i in range(12)]
    frame = spark.createDataFrame(rows, "number long, t long, user long").select("number", F.timestamp_seconds(F.col("t") * 86400).alias("ts"), "user")
    return feeds.staged(frame, "ts", ["1970-01-02", "1970-01-03"])


def test_a_notice_is_sent_once_though_the_batch_runs_again(spark, tmp_path):
    """The sink fails after it has delivered, and before; the batches run again, and each user gets one notice."""
    where, calls = f"file://{tmp_path}", []
    sent = BatchLog(spark, f"{where}/sent", "user bigint, ts timestamp, number bigint")
    stream = notices(spark, where)

    def send(rows, batch):
        calls.append(batch)
        if batch == 1 and calls.count(1) == 1:
            raise RuntimeError("before the delivery")
        sent.write(rows, batch)
        if batch == 1 and calls.count(1) == 2:
            raise RuntimeError("after the delivery")

    for _ in range(2):
        with pytest.raises(Exception, match="delivery"):
            feeds.notify(stream, where, "user", "ts", "user bigint, ts timestamp, number bigint", send)
    outbox = feeds.notify(stream, where, "user", "ts", "user bigint, ts timestamp, number bigint", send)
    assert calls == [0, 1, 1, 1, 2] or calls == [0, 1, 1, 1]
    got = sorted((r.user, r.number) for r in sent.read().collect())
    assert got == [(u, u) for u in range(5)]
    # a batch that is marked sends nothing more, whatever it is given
    outbox.run(spark.createDataFrame([(99, None, 99)], "user bigint, ts timestamp, number bigint"), 0)
    assert calls[-1] != 0 and sent.read().count() == 5


def test_inbox_merge_keeps_the_first_of_each_message(spark, tmp_path):
    """Repeated, late and unsure messages; a batch that runs again changes nothing."""
    rows = [(1, 5, "reject", 10, 0.9), (1, 5, "reject", 10, 0.9), (2, 6, "reject", None, 0.99), (3, 7, "meet", 11, 0.5), (None, 1, "meet", 1, 1.0), (1, 86405, "meet", 12, 0.95), (4, 86406, "meet", 10, 0.95), (2, 3 * 86400, "meet", 11, 0.99), (5, 2, "reject", 10, 0.99)]
    schema = "message long, s long, kind string, key long, confidence double"
    frame = spark.createDataFrame(rows, schema).select("message", F.timestamp_seconds("s").alias("at"), "kind", "key", "confidence")
    where = f"file://{tmp_path}"
    stream = feeds.staged(frame, "at", ["1970-01-02", "1970-01-03"])
    log = feeds.merge_inbox(stream, where, 0.85, ["meet", "reject"])
    state = {r.message: r.state for r in log.read().collect()}
    assert state == {1: "applied", 2: "to_confirm", 3: "to_confirm", 4: "applied", 5: "applied"} and log.read().count() == 5
    status = {r.key: r.status for r in feeds.statuses(log.read(), {"meet": "interview", "reject": "rejected"}).collect()}
    assert status == {10: "interview"}
    before = sorted(map(repr, log.read().collect()))
    feeds.merge_inbox(stream, where, 0.85, ["meet", "reject"])  # nothing new
    assert sorted(map(repr, log.read().collect())) == before


def test_readers_see_a_whole_table(spark, tmp_path):
    table = Published(spark, f"file://{tmp_path}/t", "a bigint")
    assert table.version() is None and table.read().count() == 0
    table.replace(spark.range(5).select(F.col("id").alias("a")))
    old = table.read()
    new = table.write(spark.range(100).select(F.col("id").alias("a")))  # written, not yet published
    assert table.read().count() == 5
    table.point(new)
    assert table.read().count() == 100 and old.count() == 5
    with pytest.raises(Exception, match="broken"):
        table.replace(spark.range(3).select(F.raise_error(F.lit("broken")).cast("bigint").alias("a")))
    assert table.read().count() == 100
    table.prune(1)
    assert table.read().count() == 100 and len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v-")]) == 1


def test_a_batch_that_runs_again_replaces_its_part(spark, tmp_path):
    log = BatchLog(spark, f"file://{tmp_path}/log", "a bigint")
    assert log.read().count() == 0 and not log.has(0)
    for batch, n in ((0, 3), (1, 4), (0, 2)):
        log.write(spark.range(n).select(F.col("id").alias("a")), batch)
    assert log.has(1) and log.of(0).count() == 2 and log.read().count() == 6 and log.before(1).count() == 2
