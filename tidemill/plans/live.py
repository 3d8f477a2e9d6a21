"""Queries over state that lasts: change logs, lifecycles, queues, notices and inboxes as streams, and published tables.

The events table is fed in three micro-batches.  Users stand for offers, documents and
messages, event types for answers and commands; times of a day or so stand for minutes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.published import BatchLog, Published
from ..operators.storage import shared_dir
from ..streaming import feeds, stateful, streams
from .registry import query, table

_BOUNDS = ["2024-01-11", "2024-01-21"]
HOUR = stateful.HOUR


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _feed(spark: SparkSession, d: str) -> DataFrame:
    return feeds.staged(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", _BOUNDS)


def _fold(spark: SparkSession, d: str, rule: stateful.Rule, value: Column) -> DataFrame:
    with stateful.rocks(spark):
        return streams.run_available(stateful.fold(_feed(spark, d), rule, "user_id", "ts", "event_id", value))


#: The events of each user one after the other, for recursion over n.
_ROWS = "rows_ AS (SELECT user_id AS key, event_id AS number, epoch_us(ts) AS t, event_type AS kind, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"
_END = "(SELECT max(epoch_us(ts)) - 3600000000 FROM events)"


@query("SELECT user_id, event_id, event_type AS value FROM (SELECT *, lag(event_type) OVER w AS b, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n = 1 OR event_type IS DISTINCT FROM b")
def stream_change_log(spark: SparkSession, d: str) -> DataFrame:
    """The payload log: a row when a user's event type changes, over three micro-batches."""
    return _fold(spark, d, stateful.ChangeLog(), F.col("event_type")).select(F.col("key").alias("user_id"), F.col("number").alias("event_id"), "value")


@query(
    f"""WITH RECURSIVE {_ROWS},
f AS (SELECT key, n, number, kind AS held, t AS kept, true AS out_ FROM rows_ WHERE n = 1
  UNION ALL SELECT r.key, r.n, r.number, CASE WHEN r.kind = f.held AND r.t <= f.kept + {36 * HOUR} THEN f.held ELSE r.kind END, CASE WHEN r.kind = f.held AND r.t <= f.kept + {36 * HOUR} THEN f.kept ELSE r.t END,
    NOT (r.kind = f.held AND r.t <= f.kept + {36 * HOUR}) FROM f JOIN rows_ r ON r.key = f.key AND r.n = f.n + 1)
SELECT key AS user_id, number AS event_id FROM f WHERE out_"""
)
def stream_retained_log(spark: SparkSession, d: str) -> DataFrame:
    """The same with retention: what was kept more than 36 hours ago is forgotten, so an equal payload is written again."""
    return _fold(spark, d, stateful.ChangeLog(36 * HOUR), F.col("event_type")).select(F.col("key").alias("user_id"), F.col("number").alias("event_id"))


@query(
    f"""WITH RECURSIVE {_ROWS},
kept AS (SELECT key, n, number, t AS last, true AS out_ FROM rows_ WHERE n = 1
  UNION ALL SELECT r.key, r.n, r.number, CASE WHEN r.t > k.last + {72 * HOUR} THEN r.t ELSE k.last END, r.t > k.last + {72 * HOUR} FROM kept k JOIN rows_ r ON r.key = k.key AND r.n = k.n + 1)
SELECT key AS user_id, number AS event_id FROM kept WHERE out_"""
)
def stream_horizon(spark: SparkSession, d: str) -> DataFrame:
    """A user's event counts as new if none was taken within the last 72 hours; older state has expired."""
    return _fold(spark, d, stateful.ChangeLog(72 * HOUR), F.lit("same")).select(F.col("key").alias("user_id"), F.col("number").alias("event_id"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_distinct(spark: SparkSession, d: str) -> DataFrame:
    """One row per user and type within a horizon of 30 days, which the events don't outlast; state past it is dropped by the watermark."""
    events = _feed(spark, d).select("ts", "user_id", "event_type")
    return streams.run_available(streams.distinct_by_keys(events, ["user_id", "event_type"], "ts", "30 days")).select("user_id", "event_type")


def _answer() -> Column:
    return F.when(F.col("event_type").isin("view", "signup"), "seen").when(F.col("event_type") == "click", "open").when(F.col("event_type") == "error", "closed").otherwise("unknown")


_DUE = f"known AND closed IS NULL AND NOT asked AND r.t >= checked + {24 * HOUR}"


@query(
    f"""WITH RECURSIVE {_ROWS},
f AS (SELECT user_id AS key, 0::BIGINT AS n, NULL::BIGINT AS number, NULL::BIGINT AS t, false AS known, NULL::BIGINT AS closed, NULL::BIGINT AS checked, false AS asked, NULL::VARCHAR AS status, NULL::BIGINT AS due FROM events GROUP BY user_id
  UNION ALL SELECT r.key, r.n, r.number, r.t, known OR seen, CASE WHEN seen THEN NULL WHEN closes THEN r.t ELSE closed END, CASE WHEN seen OR checks OR closes THEN r.t ELSE checked END,
    CASE WHEN seen OR checks OR closes THEN false ELSE asked OR due_ END,
    CASE WHEN seen THEN CASE WHEN known AND closed IS NULL THEN 'checked' ELSE 'opened' END WHEN checks THEN 'checked' WHEN closes THEN 'closed' END, CASE WHEN due_ THEN checked + {24 * HOUR} END
  FROM (SELECT r.key, r.n, r.number, r.t, f.known, f.closed, f.checked, f.asked, r.kind IN ('view', 'signup') AS seen, r.kind = 'click' AND known AND closed IS NULL AS checks, r.kind = 'error' AND known AND closed IS NULL AS closes, {_DUE} AS due_
    FROM f JOIN rows_ r ON r.key = f.key AND r.n = f.n + 1) r)
SELECT key AS user_id, number AS event_id, t AS at_us, status FROM f WHERE status IS NOT NULL
UNION ALL SELECT key, NULL, due, 'due' FROM f WHERE due IS NOT NULL
UNION ALL SELECT key, NULL, checked + {24 * HOUR}, 'due' FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC) AS last FROM f) WHERE last = 1 AND known AND closed IS NULL AND NOT asked AND checked + {24 * HOUR} <= {_END}"""
)
def stream_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """Offers opened, checked, closed, and due 24 hours after the last check, by value state and a timer."""
    return _fold(spark, d, stateful.Lifecycle(24 * HOUR), _answer()).select(F.col("key").alias("user_id"), F.col("number").alias("event_id"), F.col("at").alias("at_us"), "status")


_STUCK, _BACKOFF = 12 * HOUR, 36 * HOUR


def _command() -> Column:
    kind, k = F.col("event_type"), F.col("event_id")
    first = F.when(kind == "signup", "request").when(kind == "view", "take").when(kind == "purchase", "done").when(kind == "click", F.when(k % 2 == 0, "take").otherwise("request"))
    return first.otherwise(F.when(k % 3 == 0, "cut").when(k % 3 == 1, "credit").otherwise("refused"))



@query(
    f"""WITH RECURSIVE {_ROWS},
c AS (SELECT key, number, t, n, CASE kind WHEN 'signup' THEN 'request' WHEN 'view' THEN 'take' WHEN 'purchase' THEN 'done' WHEN 'click' THEN CASE WHEN number % 2 = 0 THEN 'take' ELSE 'request' END ELSE CASE number % 3 WHEN 0 THEN 'cut' WHEN 1 THEN 'credit' ELSE 'refused' END END AS cmd FROM rows_),
f AS (SELECT DISTINCT key, 0::BIGINT AS n, NULL::BIGINT AS number, NULL::BIGINT AS t, NULL::VARCHAR AS cmd, NULL::VARCHAR AS before, NULL::VARCHAR AS status, NULL::BIGINT AS since, false AS retried, 0 AS attempts, NULL::BIGINT AS wait, NULL::BIGINT AS due, NULL::VARCHAR AS due_from, 0 AS due_attempts, false AS changed FROM c
  UNION ALL SELECT key, n, number, t, cmd, s, CASE WHEN NOT go THEN s WHEN cmd IN ('request', 'credit') OR cmd = 'cut' AND NOT retried THEN 'pending' WHEN cmd = 'take' THEN 'running' WHEN cmd = 'done' THEN 'ready' ELSE 'failed' END,
    CASE WHEN go THEN t WHEN fired THEN due_at ELSE since END, CASE WHEN go AND cmd = 'request' THEN false WHEN go AND cmd = 'cut' THEN true ELSE retried END,
    CASE WHEN go AND cmd = 'request' THEN 0 WHEN go AND cmd = 'take' THEN attempts + 1 WHEN go AND cmd = 'credit' THEN attempts - 1 ELSE attempts END, CASE WHEN go AND cmd = 'credit' THEN t + {_BACKOFF} WHEN go THEN NULL ELSE w END,
    CASE WHEN fired THEN due_at END, CASE WHEN fired THEN status END, attempts, go
  FROM (SELECT *, CASE cmd WHEN 'request' THEN s IS NULL OR s IN ('ready', 'failed') WHEN 'take' THEN coalesce(s = 'pending', false) AND w IS NULL ELSE coalesce(s = 'running', false) END AS go
    FROM (SELECT *, CASE WHEN fired THEN 'pending' ELSE status END AS s, CASE WHEN fired THEN NULL ELSE wait END AS w
      FROM (SELECT c.key, c.n, c.number, c.t, c.cmd, f.status, f.since, f.retried, f.attempts, f.wait, CASE WHEN f.status = 'running' THEN f.since + {_STUCK} ELSE f.wait END AS due_at, coalesce(CASE WHEN f.status = 'running' THEN f.since + {_STUCK} ELSE f.wait END <= c.t, false) AS fired
        FROM f JOIN c ON c.key = f.key AND c.n = f.n + 1))))
SELECT key AS user_id, number AS event_id, t AS at_us, cmd AS cause, before AS from_state, status AS to_state, attempts FROM f WHERE changed
UNION ALL SELECT key, NULL, due, CASE due_from WHEN 'running' THEN 'requeued' ELSE 'resumed' END, due_from, 'pending', due_attempts FROM f WHERE due IS NOT NULL
UNION ALL SELECT key, NULL, due_at, CASE status WHEN 'running' THEN 'requeued' ELSE 'resumed' END, status, 'pending', attempts
  FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC) AS last, CASE WHEN status = 'running' THEN since + {_STUCK} ELSE wait END AS due_at FROM f) WHERE last = 1 AND due_at <= {_END}"""
)
def stream_queue(spark: SparkSession, d: str) -> DataFrame:
    """The document queue: requests, runs, one retry, stuck runs back after 12 hours and credit stops after 36, by timers."""
    out = _fold(spark, d, stateful.Queue(_STUCK, _BACKOFF), _command())
    return out.select(F.col("key").alias("user_id"), F.col("number").alias("event_id"), F.col("at").alias("at_us"), "cause", F.col("before").alias("from_state"), F.col("after").alias("to_state"), "attempts")


_NOTICE = "user_id bigint, ts timestamp, event_id bigint"


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'purchase' AND value > 60) WHERE n = 1")
def stream_notices(spark: SparkSession, d: str) -> DataFrame:
    """A notice for each user's first large purchase, sent exactly once: planned, sent, marked, batch by batch."""
    where = _place(spark, "notices")
    sent = BatchLog(spark, f"{where}/sent", _NOTICE)
    feeds.notify(_feed(spark, d).where("event_type = 'purchase' AND value > 60"), where, "user_id", "ts", _NOTICE, sent.write)
    return sent.read().select("user_id", "event_id")


_MESSAGES = "SELECT event_id // 3 AS message, ts AS at_, event_type AS kind, CASE WHEN user_id % 5 <> 0 THEN user_id END AS key, value / 100 AS confidence, event_id FROM events"


@query(
    f"""WITH m AS ({_MESSAGES}), first AS (SELECT *, row_number() OVER (PARTITION BY message ORDER BY at_, kind, key NULLS FIRST, confidence) AS n FROM m),
log AS (SELECT * FROM first WHERE n = 1 AND confidence >= 0.85 AND kind IN ('purchase', 'error') AND key IS NOT NULL)
SELECT key, CASE kind WHEN 'purchase' THEN 'interview' ELSE 'rejected' END AS status, message FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY at_ DESC, message DESC) AS last FROM log) WHERE last = 1"""
)
def stream_inbox(spark: SparkSession, d: str) -> DataFrame:
    """Messages come three times and count once; sure ones set the status of their application."""
    messages = _feed(spark, d).select(F.floor(F.col("event_id") / 3).alias("message"), F.col("ts").alias("at"), F.col("event_type").alias("kind"), F.when(F.col("user_id") % 5 != 0, F.col("user_id")).alias("key"), (F.col("value") / 100).alias("confidence"))
    log = feeds.merge_inbox(messages, _place(spark, "inbox"), 0.85, ["purchase", "error"])
    return feeds.statuses(log.read(), {"purchase": "interview", "error": "rejected"})


@query("SELECT c_custkey, c_name, 'new' AS seen FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT c_custkey, c_name, 'before' FROM customer WHERE c_acctbal > 0")
def published_mirror(spark: SparkSession, d: str) -> DataFrame:
    """A mirror replaced as a whole: a reader from before the replacement reads the old table to its end, a new one the new table."""
    mirror = Published(spark, _place(spark, "mirror"), "c_custkey bigint, c_name string")
    rows = table(spark, d, "customer")
    mirror.replace(rows.where("c_acctbal > 0").select("c_custkey", "c_name"))
    before = mirror.read()
    mirror.replace(rows.where("c_acctbal > 5000").select("c_custkey", "c_name"))
    mirror.prune(2)
    return mirror.read().withColumn("seen", F.lit("new")).unionByName(before.withColumn("seen", F.lit("before")))
