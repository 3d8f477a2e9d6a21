"""Registered queries of the joins, state rules, sorts and set operations over the tracking tables.

orders stand for postings and applications, customers for companies, events for logs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import lifecycle as L
from ..operators import relational as R
from ..operators import scoring
from .registry import big, cases, query, table

_TODAY = "1998-08-02"


def _day() -> Column:
    return F.lit(_TODAY).cast("date")


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders")


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer")


def _place(order: list[Column], *keys: str) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")


# --- joins ---------------------------------------------------------------------------------------


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l_orderkey || ':' || (l_orderkey % 7) = o_orderkey || ':' || (o_orderkey % 7) AND l_returnflag = 'R')")
def handled_filter(spark: SparkSession, d: str) -> DataFrame:
    key = lambda c: F.concat_ws(":", c, F.col(c) % 7)
    handled = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(key("l_orderkey").alias("key"))
    return _orders(spark, d).withColumn("key", key("o_orderkey")).join(handled, "key", "left_anti").select("o_orderkey")


@query("SELECT o_orderkey, l_linenumber, l_linestatus FROM orders JOIN lineitem ON l_orderkey || ':1' = o_orderkey || ':1' WHERE l_returnflag IN ('A', 'N') AND l_quantity > 40")
def tracked_jobs(spark: SparkSession, d: str) -> DataFrame:
    tracked = table(spark, d, "lineitem").where("l_returnflag IN ('A', 'N') AND l_quantity > 40").select(F.concat("l_orderkey", F.lit(":1")).alias("key"), "l_linenumber", "l_linestatus")
    return _orders(spark, d).withColumn("key", F.concat("o_orderkey", F.lit(":1"))).join(tracked, "key").select("o_orderkey", "l_linenumber", "l_linestatus")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IS NOT NULL)")
def reset_notified(spark: SparkSession, d: str) -> DataFrame:
    seen = _orders(spark, d).where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return _customers(spark, d).join(seen, "c_custkey", "left_anti").select("c_custkey")


@query("SELECT c_custkey, o_orderkey, l_linenumber FROM (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM customer JOIN orders ON o_custkey = c_custkey) LEFT JOIN (SELECT l_orderkey, min(l_linenumber) AS l_linenumber FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey WHERE n = 1")
def funding_with_article(spark: SparkSession, d: str) -> DataFrame:
    latest = _orders(spark, d).groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))
    article = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_linenumber").alias("l_linenumber"))
    return _customers(spark, d).join(latest, F.col("o_custkey") == F.col("c_custkey")).join(article, "o_orderkey", "left").select("c_custkey", "o_orderkey", "l_linenumber")


@query("SELECT c_custkey, o_orderkey, coalesce(n, 0) AS open_jobs FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, max(o_orderkey) AS o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) USING (c_custkey) LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1) USING (c_custkey)")
def lead_details(spark: SparkSession, d: str) -> DataFrame:
    events = _orders(spark, d).where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("o_orderkey"))
    duplicates = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    jobs = _orders(spark, d).where("o_orderstatus = 'O'").join(duplicates, "o_orderkey", "left_anti").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return _customers(spark, d).join(events, "c_custkey", "left").join(jobs, "c_custkey", "left").select("c_custkey", "o_orderkey", F.coalesce("n", F.lit(0)).alias("open_jobs"))


_LATEST_SQL = "(SELECT user_id, event_type AS label, event_id FROM events WHERE event_id IN (SELECT max(event_id) FROM events GROUP BY user_id))"


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("label"))


@query(f"SELECT user_id, label, event_id, c_name FROM {_LATEST_SQL} LEFT JOIN customer ON c_custkey = user_id AND c_acctbal > 0")
def latest_decisions(spark: SparkSession, d: str) -> DataFrame:
    return _decisions(spark, d).join(_customers(spark, d).where("c_acctbal > 0"), F.col("c_custkey") == F.col("user_id"), "left").select("user_id", "label", "event_id", "c_name")


@query(f"SELECT c_custkey, label, n FROM customer LEFT JOIN {_LATEST_SQL} ON user_id = c_custkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def to_apply_state(spark: SparkSession, d: str) -> DataFrame:
    jobs = _orders(spark, d).groupBy("o_custkey").agg(F.count("*").alias("n"))
    return _customers(spark, d).join(_decisions(spark, d), F.col("user_id") == F.col("c_custkey"), "left").join(jobs, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "label", "n")


@query(f"SELECT o_orderkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '{_TODAY}') AS BIGINT) AS late FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE CAST(o_orderdate AS DATE) <= DATE '{_TODAY}' AND NOT (o_orderpriority = '5-LOW' AND coalesce(c_acctbal < 0, false)) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O')")
def followups_due(spark: SparkSession, d: str) -> DataFrame:
    archived = table(spark, d, "lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("o_orderkey"))
    due = _orders(spark, d).where(F.to_date("o_orderdate") <= _day()).join(_customers(spark, d), F.col("c_custkey") == F.col("o_custkey"), "left")
    kept = due.where(~((F.col("o_orderpriority") == "5-LOW") & F.coalesce(F.col("c_acctbal") < 0, F.lit(False))))
    return kept.join(archived, "o_orderkey", "left_anti").select("o_orderkey", big(F.datediff(_day(), F.to_date("o_orderdate"))).alias("late"))


@query(f"SELECT d.doc_id, d.source, l.quality, v.label FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN {_LATEST_SQL} v ON v.user_id = d.doc_id AND v.label <> 'error' WHERE d.n_chars % 3 = 0")
def disagreement_rows(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("n_chars % 3 = 0").select("doc_id", "source")
    verdicts = _decisions(spark, d).where("label <> 'error'").select(F.col("user_id").alias("doc_id"), "label")
    return docs.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").join(verdicts, "doc_id", "left").select("doc_id", "source", "quality", "label")


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_mktsegment <> 'BUILDING'")
def event_article(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).join(_customers(spark, d).where("c_mktsegment <> 'BUILDING'"), F.col("c_custkey") == F.col("o_custkey"), "left").select("o_orderkey", "c_name", "c_mktsegment")


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_linenumber >= 3)")
def missing_documents(spark: SparkSession, d: str) -> DataFrame:
    there = table(spark, d, "lineitem").where("l_linenumber >= 3").select(F.col("l_orderkey").alias("o_orderkey"))
    return _orders(spark, d).join(there, "o_orderkey", "left_anti").select("o_orderkey")


@query(f"SELECT p.o_orderkey, f.o_orderkey AS funding FROM (SELECT * FROM orders WHERE o_orderstatus = 'O') p LEFT JOIN (SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders WHERE o_orderpriority = '1-URGENT') WHERE n = 1 AND CAST(o_orderdate AS DATE) >= DATE '{_TODAY}' - 90) f ON f.o_custkey = p.o_custkey")
def job_with_funding(spark: SparkSession, d: str) -> DataFrame:
    latest = _orders(spark, d).where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_orderdate"), F.struct("o_orderdate", "o_orderkey")).alias("f"))
    recent = latest.where(F.to_date("f.o_orderdate") >= F.date_sub(_day(), 90)).select("o_custkey", F.col("f.o_orderkey").alias("funding"))
    return _orders(spark, d).where("o_orderstatus = 'O'").join(recent, "o_custkey", "left").select("o_orderkey", "funding")


@query("SELECT event_type, CAST(day AS VARCHAR) AS day, n, prev, n - prev AS diff FROM (SELECT event_type, day, n, lag(n) OVER (PARTITION BY event_type ORDER BY day) AS prev FROM (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL))")
def board_against_previous(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    prev = days.withColumn("prev", F.lag("n").over(Window.partitionBy("event_type").orderBy("day")))
    return prev.select("event_type", F.col("day").cast("string").alias("day"), "n", "prev", (F.col("n") - F.col("prev")).alias("diff"))


# --- duplicates, leads, links -----------------------------------------------------------------------


@query("SELECT doc_id, url_key AS article FROM (SELECT doc_id, source || substr(text, 1, 40) AS url_key, row_number() OVER (PARTITION BY source || substr(text, 1, 40) ORDER BY doc_id) AS n FROM documents) WHERE n = 1 AND url_key NOT IN (SELECT source || substr(text, 1, 40) FROM documents WHERE doc_id % 5 = 0)")
def new_articles(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.concat("source", F.substring("text", 1, 40)).alias("article"))
    stored = docs.where("doc_id % 5 = 0").select("article")
    return docs.groupBy("article").agg(F.min("doc_id").alias("doc_id")).join(stored, "article", "left_anti").select("doc_id", "article")


@query(
    "WITH RECURSIVE o AS (SELECT o_orderkey AS id, o_custkey AS k, CAST(o_orderdate AS DATE) AS dt, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS n FROM orders), "
    "r AS (SELECT id, k, n, dt AS seen, true AS ok FROM o WHERE n = 1 UNION ALL SELECT o.id, o.k, o.n, CASE WHEN date_diff('day', r.seen, o.dt) >= 180 THEN o.dt ELSE r.seen END, date_diff('day', r.seen, o.dt) >= 180 FROM o JOIN r ON o.k = r.k AND o.n = r.n + 1) SELECT id FROM r WHERE ok"
)
def leads_spaced(spark: SparkSession, d: str) -> DataFrame:
    rows = _orders(spark, d).select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderdate")
    return L.spaced(rows, "o_custkey", "o_orderdate", 180).select("id")


@query("SELECT canonical, duplicate, CASE WHEN o IS NULL THEN 'added' WHEN n IS NULL THEN 'removed' ELSE 'kept' END AS change FROM (SELECT o_custkey % 50 AS canonical, o_orderkey AS duplicate, 1 AS o FROM orders WHERE o_orderkey % 3 <> 0) FULL JOIN (SELECT o_custkey % 50 AS canonical, o_orderkey AS duplicate, 1 AS n FROM orders WHERE o_orderkey % 2 = 0 AND o_custkey % 50 <> o_orderkey) USING (canonical, duplicate)")
def link_sync(spark: SparkSession, d: str) -> DataFrame:
    links = _orders(spark, d).select((F.col("o_custkey") % 50).alias("canonical"), F.col("o_orderkey").alias("duplicate"))
    return L.synced(links.where("duplicate % 3 <> 0"), links.where("duplicate % 2 = 0"))


@query("SELECT l_partkey, face, n_places, places, postings FROM (SELECT l_partkey, arg_max(l_orderkey, (l_extendedprice, -l_orderkey)) AS face, count(DISTINCT s_nationkey) AS n_places, array_to_string(list_sort(list(DISTINCT s_nationkey)), ',') AS places, count(*) AS postings FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_partkey) WHERE n_places >= 2")
def grouped_face(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    g = rows.groupBy("l_partkey").agg(F.max_by("l_orderkey", F.struct("l_extendedprice", -F.col("l_orderkey"))).alias("face"), F.array_sort(F.collect_set("s_nationkey")).alias("p"), F.count("*").alias("postings"))
    return g.where(F.size("p") >= 2).select("l_partkey", "face", big(F.size("p")).alias("n_places"), F.array_join(F.col("p").cast("array<string>"), ",").alias("places"), "postings")


@query("SELECT doc_id, sha256(text) AS hash FROM documents WHERE (source, sha256(text)) NOT IN (SELECT source, sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def verdict_cache(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("hash"))
    return docs.join(docs.where("doc_id % 2 = 0").select("source", "hash"), ["source", "hash"], "left_anti").select("doc_id", "hash")


# --- sinks -------------------------------------------------------------------------------------------


@query("SELECT key, name FROM (SELECT c_mktsegment AS key, 'stored ' || c_mktsegment AS name FROM customer WHERE c_mktsegment <= 'BUILDING' GROUP BY 1 UNION ALL SELECT c_mktsegment, min_by(c_name, c_custkey) FROM customer WHERE c_mktsegment > 'BUILDING' GROUP BY 1)")
def company_insert_or_ignore(spark: SparkSession, d: str) -> DataFrame:
    rows = _customers(spark, d)
    stored = rows.where("c_mktsegment <= 'BUILDING'").select(F.col("c_mktsegment").alias("key"), F.concat(F.lit("stored "), "c_mktsegment").alias("name")).distinct()
    return R.insert_or_ignore(stored, rows.select(F.col("c_mktsegment").alias("key"), F.col("c_name").alias("name"), F.col("c_custkey").alias("at")), "key", "at")


@query("SELECT event_id FROM (SELECT event_id, ts, lag(event_type) OVER w AS b, row_number() OVER w AS n, event_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE (n = 1 OR event_type <> b) AND ts >= TIMESTAMP '2024-01-02 00:00:00'")
def payload_log_pruned(spark: SparkSession, d: str) -> DataFrame:
    kept = R.changes_only(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return kept.where(F.col("ts") >= F.lit("2024-01-02 00:00:00").cast("timestamp")).select("event_id")


@query("SELECT k AS lead, CASE WHEN n.k2 IS NULL THEN o.r ELSE n.r END AS reason, o.s AS status, o.t AS notified FROM (SELECT o_orderkey AS k, o_orderpriority AS r, 'new' AS s, o_totalprice AS t FROM orders) o LEFT JOIN (SELECT o_orderkey AS k2, 'again' AS r FROM orders WHERE o_orderkey % 4 = 0) n ON n.k2 = o.k")
def lead_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = _orders(spark, d).select(F.col("o_orderkey").alias("lead"), F.col("o_orderpriority").alias("reason"), F.lit("new").alias("status"), F.col("o_totalprice").alias("notified"))
    new = old.where("lead % 4 = 0").select("lead", F.lit("again").alias("reason"), F.lit("reset").alias("status"), F.lit(0.0).alias("notified"))
    return R.upsert(old, new, ["lead"], {"status": R.KEEP_OLD, "notified": R.KEEP_OLD})


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 100000)")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    stale = _orders(spark, d).where("o_orderstatus = 'F' AND o_totalprice < 100000").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").join(stale, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 10 = 3 THEN 'closed' ELSE 'open' END AS state, CASE WHEN o_orderkey % 10 = 3 THEN o_totalprice ELSE 0 END AS at FROM orders")
def mark_closed(spark: SparkSession, d: str) -> DataFrame:
    rows = _orders(spark, d).select(F.col("o_orderkey").alias("id"), "o_orderstatus", F.lit("open").alias("state"), F.lit(0.0).alias("at"), "o_totalprice")
    ids = rows.where("id % 10 = 3").select("id")
    return L.set_marks(rows, ids, state=F.lit("closed"), at=F.col("o_totalprice")).select(F.col("id").alias("o_orderkey"), "o_orderstatus", "state", "at")


# --- state rules -----------------------------------------------------------------------------------------


@query(f"SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END, o_orderdate + INTERVAL 10 DAY) >= TIMESTAMP '{_TODAY}' - INTERVAL 45 DAY")
def visible_jobs(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("o_orderdate")
    closed, published = F.when(F.col("o_orderstatus") == "F", at), F.when(F.col("o_orderkey") % 2 == 0, at)
    return _orders(spark, d).where(L.visible(closed, published, at + F.expr("INTERVAL 10 DAYS"), F.lit(_TODAY).cast("timestamp"), 45)).select("o_orderkey")


@query(
    "WITH a AS (SELECT *, (s IN ('5-LOW')) OR (s = '2-HIGH' AND starts_with(id, 'b1:')) AS covered FROM (SELECT o_orderpriority AS s, 'b' || (o_custkey % 3) || ':' || o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'not_asked' WHEN o_orderkey % 7 = 0 THEN 'unknown' WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 2 = 0 OR o_orderkey % 13 = 0 THEN 'closed' ELSE 'open' END AS answer FROM orders)), "
    "c AS (SELECT s, count(*) AS n, count(*) FILTER (WHERE answer = 'closed') AS k FROM a WHERE NOT covered AND answer <> 'not_asked' GROUP BY s), down AS (SELECT s FROM c WHERE n >= 10 AND k / n > 0.3) "
    "SELECT s AS source, id, answer, covered OR (s IN (FROM down) AND answer = 'closed') AS suspended, CASE WHEN NOT covered AND s NOT IN (FROM down) AND answer IN ('open', 'closed') THEN answer END AS mark FROM a"
)
def closure_marks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    answer = F.when(k % 11 == 0, "not_asked").when(k % 7 == 0, "unknown").when((F.col("o_orderpriority") == "1-URGENT") & (k % 2 == 0) | (k % 13 == 0), "closed").otherwise("open")
    answers = _orders(spark, d).select(F.col("o_orderpriority").alias("source"), F.concat(F.lit("b"), F.col("o_custkey") % 3, F.lit(":"), k).alias("id"), answer.alias("answer"))
    return L.closures(answers, spark.createDataFrame([("5-LOW", None), ("2-HIGH", "b1")], "source string, board string"), 10, 0.3)


@cases(
    "source string, run int, fetched int, attempted int, failed int, boards map<string,int>",
    {"kind": "VARCHAR", "mean": "DOUBLE", "down": "VARCHAR"},
    [
        ("a", 1, 30, 10, 0, {"x": 9, "y": 7}, None, None, None), ("a", 2, 20, 10, 0, {"x": 0, "y": 4}, "board_empty", 30.0, "x"), ("a", 3, 0, 10, 9, {"x": 0, "y": 0}, "no_results", 25.0, ""), ("a", 4, 9, 10, 6, {"x": 9, "y": 0}, "requests_failed", 16.6667, ""),
        ("b", 1, 0, 0, 0, {}, None, None, None), ("b", 2, 0, 4, 2, {"z": 0}, None, None, None), ("b", 3, 5, 4, 3, None, "requests_failed", 0.0, ""),
    ],
)
def outage_cases(rows: DataFrame) -> DataFrame:
    found = L.outages(rows, 7, 20, 0.5, 5).select("source", "run", "kind", "mean", F.array_join("boards", ",").alias("down"))
    return rows.select("n", "source", "run").join(found, ["source", "run"], "left").select("n", "kind", "mean", "down")


@query("SELECT DISTINCT event_id FROM events e JOIN (SELECT user_id % 4 AS s, ts AS a, CASE WHEN event_id % 2 = 0 THEN ts + INTERVAL 20 MINUTE ELSE ts + INTERVAL 6 HOUR END AS z FROM events WHERE event_type = 'error' AND value > 95) w ON e.user_id % 4 = w.s AND e.ts BETWEEN w.a AND w.z WHERE e.event_type = 'click'")
def reopen_windows(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("source", F.col("user_id") % 4)
    windows = events.where("event_type = 'error' AND value > 95").select("source", F.col("ts").alias("start"), F.when(F.col("event_id") % 2 == 0, F.col("ts") + F.expr("INTERVAL 20 MINUTES")).alias("stop"))
    closed = events.where("event_type = 'click'").select("event_id", "source", F.col("ts").alias("closed_at"))
    return L.reopened(closed, windows).select("event_id")


_ARCHIVE_SQL = "CASE WHEN {p} IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN CASE WHEN o_orderstatus = 'F' THEN 'expired' WHEN date_diff('day', CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderdate AS DATE) + 100 WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) + 3 END, {t}) > 15 THEN 'kept' WHEN o_orderkey % 5 <> 0 AND date_diff('day', CAST(o_orderdate AS DATE), {t}) > 20 THEN 'published' END END"


def _archived(day: Column) -> Column:
    k, at = F.col("o_orderkey"), F.to_date("o_orderdate")
    status = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM"), "to_apply").otherwise("applied")
    return L.archive_state(status, F.col("o_orderstatus") == "F", F.when(k % 2 == 0, F.date_add(at, 3)), at, F.when(k % 5 == 0, F.date_add(at, 100)), day)


@query(f"SELECT o_orderkey, {_ARCHIVE_SQL.format(p='o_orderpriority', t=f'''DATE '{_TODAY}' ''')} AS state, coalesce({_ARCHIVE_SQL.format(p='o_orderpriority', t=f'''DATE '{_TODAY}' ''')} IS NOT NULL AND {_ARCHIVE_SQL.format(p='o_orderpriority', t=f'''(DATE '{_TODAY}' - 1)''')} IS NULL, false) AS new_today FROM orders")
def archive_new_today(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).select("o_orderkey", _archived(_day()).alias("state"), (_archived(_day()).isNotNull() & _archived(F.date_sub(_day(), 1)).isNull()).alias("new_today"))


@query("SELECT event_id, CASE WHEN event_type = 'view' AND ts <= TIMESTAMP '2024-01-03 00:00:00' - INTERVAL 15 MINUTE OR event_type = 'error' AND user_id % 2 < 1 THEN 'pending' WHEN event_type = 'view' THEN 'running' WHEN event_type = 'error' THEN 'failed' ELSE 'ready' END AS next FROM events")
def document_queue(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("event_type") == "view", "running").when(F.col("event_type") == "error", "failed").otherwise("ready")
    rows = table(spark, d, "events").select("event_id", state.alias("state"), F.col("ts").alias("started_at"), (F.col("user_id") % 2).alias("attempts"))
    return L.queue_step(rows, F.lit("2024-01-03 00:00:00").cast("timestamp"), 15, 1).select("event_id", "next")


@query("SELECT event_id FROM (SELECT event_id, sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM events) WHERE s <= 500")
def budget_cap(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "ts", F.to_date("ts").alias("day"), F.floor("value").alias("cost"))
    return L.within_budget(rows, ["day"], ["ts", "event_id"], "cost", 500).select("event_id")


@query(
    "SELECT message, kind, CASE WHEN confidence >= 85 AND kind IN ('purchase', 'error') AND key IS NOT NULL THEN 'applied' ELSE 'pending' END AS action FROM (SELECT user_id AS message, event_type AS kind, CASE WHEN event_id % 5 <> 0 THEN event_id END AS key, value AS confidence, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type, CASE WHEN event_id % 5 <> 0 THEN event_id END) AS n FROM events) WHERE n = 1 AND message % 3 <> 0"
)
def inbox_autoapply(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select(F.col("user_id").alias("message"), F.col("ts").alias("at"), F.col("event_type").alias("kind"), F.when(F.col("event_id") % 5 != 0, F.col("event_id")).alias("key"), F.col("value").alias("confidence"))
    stored = events.where("message % 3 = 0").select("message").distinct()
    return L.apply_events(events, stored, 85, ["purchase", "error"]).select("message", "kind", "action")


@cases(
    "state string, act string",
    {"next": "VARCHAR", "ok": "BOOLEAN"},
    [("pending", "confirm", "applied", True), ("pending", "correct", "applied", True), ("pending", "ignore", "ignored", True), ("applied", "confirm", "applied", False), ("ignored", "correct", "ignored", False), ("pending", "other", "pending", False)],
)
def inbox_actions(rows: DataFrame) -> DataFrame:
    to = F.when(F.col("act").isin("confirm", "correct"), "applied").when(F.col("act") == "ignore", "ignored")
    ok = F.coalesce((F.col("state") == "pending") & to.isNotNull(), F.lit(False))
    return rows.select("n", F.when(ok, to).otherwise(F.col("state")).alias("next"), ok.alias("ok"))


@query("SELECT user_id AS key, arg_max(event_type, event_id) AS label FROM events WHERE event_id % 4 <> 1 GROUP BY user_id")
def swipe_log(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.col("event_type").alias("label"))
    return L.latest_labels(log, log.where("id % 4 = 1").select("id"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-08-02' - INTERVAL 60 DAY")
def retention(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).where(F.col("o_orderdate") >= F.lit(_TODAY).cast("timestamp") - F.expr("INTERVAL 60 DAYS")).select("o_orderkey")


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL")
def unprocessed_articles(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "labels").where("quality IS NOT NULL").select("doc_id")
    return table(spark, d, "documents").join(done, "doc_id", "left_anti").select("doc_id")


@query("SELECT o_orderkey, CAST((o_custkey - date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))) % 7 + CASE WHEN (o_custkey - date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))) % 7 < 0 THEN 7 ELSE 0 END AS BIGINT) AS due FROM orders")
def read_schedule(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).select("o_orderkey", big(L.due_in_days(F.to_date("o_orderdate"), F.col("o_custkey"), 7)).alias("due"))


@query("SELECT (SELECT count(*) FROM (SELECT p_type FROM part WHERE p_size > 25 EXCEPT SELECT p_type FROM part WHERE p_size <= 5)) + (SELECT count(*) FROM (SELECT p_type FROM part WHERE p_size <= 5 EXCEPT SELECT p_type FROM part WHERE p_size > 25)) > 0 AS changed")
def overrides_changed(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return R.sets_differ(part.where("p_size > 25").select("p_type"), part.where("p_size <= 5").select("p_type")).select("changed")


# --- windows ---------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, max(l_linenumber) + 1 AS next_version FROM lineitem GROUP BY l_orderkey")
def next_version(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg((F.max("l_linenumber") + 1).alias("next_version"))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY CAST(ts AS DATE), event_type, user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'error') WHERE n = 1")
def announced_once(spark: SparkSession, d: str) -> DataFrame:
    errors = table(spark, d, "events").where("event_type = 'error'")
    return R.latest_per_key(errors.withColumn("day", F.to_date("ts")), ["day", "event_type", "user_id"], F.asc("ts"), F.asc("event_id")).select("event_id")


@query("SELECT o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1) // 5 AS batch, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1) % 5 AS done FROM orders")
def queue_batches(spark: SparkSession, d: str) -> DataFrame:
    place = _place([F.desc("o_totalprice"), F.asc("o_orderkey")], "o_custkey") - 1
    return _orders(spark, d).select("o_orderkey", F.floor(place / 5).alias("batch"), (place % 5).alias("done"))


@query("SELECT o_custkey, CASE max(CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'P' THEN 2 ELSE 1 END) WHEN 3 THEN 'F' WHEN 2 THEN 'P' ELSE 'O' END AS status FROM orders GROUP BY o_custkey")
def group_status(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "P", 2).otherwise(1)
    return _orders(spark, d).groupBy("o_custkey").agg(F.max_by("o_orderstatus", rank).alias("status"))


# --- sorts and top k ---------------------------------------------------------------------------------------------


@query("SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY n NULLS FIRST, c_custkey) AS place FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey")
def never_checked_first(spark: SparkSession, d: str) -> DataFrame:
    checked = _orders(spark, d).where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return _customers(spark, d).join(checked, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", _place([F.asc_nulls_first("n"), F.asc("c_custkey")], "c_mktsegment").alias("place"))


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END, o_orderdate DESC, o_orderkey DESC) AS place FROM orders")
def priority_order(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).select("o_orderkey", _place([F.when(F.col("o_orderpriority") == "1-URGENT", 0).otherwise(1), F.desc("o_orderdate"), F.desc("o_orderkey")], "o_custkey").alias("place"))


_LEADS = "SELECT o_orderkey, (o_orderpriority <> '1-URGENT') AS a, (o_orderstatus NOT IN ('O', 'P')) AS b, o_orderdate FROM orders WHERE o_totalprice > 200000"


@query(f"SELECT (SELECT count(*) FROM ({_LEADS})) - 10 AS overflow, o_orderkey, row_number() OVER (ORDER BY a, b, o_orderdate DESC, o_orderkey) AS place FROM ({_LEADS} ORDER BY a, b, o_orderdate DESC, o_orderkey LIMIT 10)")
def lead_selection(spark: SparkSession, d: str) -> DataFrame:
    leads = _orders(spark, d).where("o_totalprice > 200000").withColumns({"a": F.col("o_orderpriority") != "1-URGENT", "b": ~F.col("o_orderstatus").isin("O", "P")})
    return R.capped(leads, 10, [F.asc("a"), F.asc("b"), F.desc("o_orderdate"), F.asc("o_orderkey")]).select("overflow", "o_orderkey", "place")


@query("SELECT doc_id, url || ' | ' || source || ' | ' || lang AS line FROM (SELECT doc_id, 'https://x/' || doc_id AS url, source, lang, n_chars FROM documents WHERE n_chars > 100 AND 'https://x/' || doc_id NOT IN (SELECT 'https://x/' || doc_id FROM labels) ORDER BY n_chars DESC, doc_id LIMIT 25)")
def export_lines(spark: SparkSession, d: str) -> DataFrame:
    url = F.concat(F.lit("https://x/"), "doc_id")
    docs = table(spark, d, "documents").where("n_chars > 100").select("doc_id", "n_chars", url.alias("url"), "source", "lang")
    new = docs.join(table(spark, d, "labels").select(url.alias("url")), "url", "left_anti")
    return R.top_k(new, 25, F.desc("n_chars"), F.asc("doc_id")).select("doc_id", F.concat_ws(" | ", "url", "source", "lang").alias("line"))


_GAPS = "SELECT doc_id, quality = 0 AND n_chars > 3000 AS strong, abs(n_chars // 100 - 100 * quality) AS gap FROM documents JOIN labels USING (doc_id)"


@query(f"SELECT doc_id, strong, CAST(gap AS BIGINT) AS gap, row_number() OVER (ORDER BY strong DESC, gap DESC, doc_id) AS place FROM ({_GAPS} ORDER BY strong DESC, gap DESC, doc_id LIMIT 10)")
def top_disagreements(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    gaps = rows.select("doc_id", ((F.col("quality") == 0) & (F.col("n_chars") > 3000)).alias("strong"), F.abs(F.floor(F.col("n_chars") / 100) - 100 * F.col("quality")).alias("gap"))
    return R.capped(gaps, 10, [F.desc("strong"), F.desc("gap"), F.asc("doc_id")]).select("doc_id", "strong", "gap", "place")


@query("SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 8")
def most_common(spark: SparkSession, d: str) -> DataFrame:
    return R.top_k(table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n")), 8, F.desc("n"), F.asc("p_type"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts >= TIMESTAMP '2024-01-20' DESC, coalesce(CASE WHEN event_type = 'view' THEN 100 - value END, value, -1) DESC, ts DESC, event_id) AS place FROM events WHERE event_type <> 'error'")
def triage_queue(spark: SparkSession, d: str) -> DataFrame:
    rank = scoring.rank_score(F.when(F.col("event_type") == "view", 100 - F.col("value")), F.col("value"))
    new = F.col("ts") >= F.lit("2024-01-20").cast("timestamp")
    return table(spark, d, "events").where("event_type <> 'error'").select("event_id", _place([new.desc(), rank.desc(), F.desc("ts"), F.asc("event_id")], "user_id").alias("place"))


_UNKNOWN_SQL = "SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS v FROM customer"


@query(f"SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY v ASC NULLS LAST, c_custkey) AS up, row_number() OVER (PARTITION BY c_nationkey ORDER BY v DESC NULLS LAST, c_custkey) AS down FROM ({_UNKNOWN_SQL})")
def unknown_last(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    return _customers(spark, d).select("c_custkey", _place([v.asc_nulls_last(), F.asc("c_custkey")], "c_nationkey").alias("up"), _place([v.desc_nulls_last(), F.asc("c_custkey")], "c_nationkey").alias("down"))


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END, CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE o_totalprice END DESC, o_orderkey) AS place FROM orders WHERE o_orderstatus <> 'F'")
def today_queue(spark: SparkSession, d: str) -> DataFrame:
    score = F.coalesce(F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")), F.lit(-1.0))
    return _orders(spark, d).where("o_orderstatus <> 'F'").select("o_orderkey", _place([F.when(F.col("o_orderpriority") == "1-URGENT", 0).otherwise(1), score.desc(), F.asc("o_orderkey")], "o_custkey").alias("place"))


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, coalesce(strftime(CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END, '%Y-%m-%d'), '') DESC, o_orderkey) AS place FROM orders WHERE o_orderstatus IN ('O', 'P')")
def application_filter(spark: SparkSession, d: str) -> DataFrame:
    kept = F.coalesce(F.date_format(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate")), "yyyy-MM-dd"), F.lit(""))
    return _orders(spark, d).where("o_orderstatus IN ('O', 'P')").select("o_orderkey", _place([F.desc("o_totalprice"), kept.desc(), F.asc("o_orderkey")], "o_orderstatus").alias("place"))


@query("SELECT o_orderkey, place FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'O') WHERE place <= 3")
def apply_list(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).where("o_orderstatus = 'O'").select("o_orderkey", _place([F.asc("o_orderdate"), F.asc("o_orderkey")], "o_custkey").alias("place")).where("place <= 3")


_CANDIDATES = "SELECT doc_id, n_chars FROM documents WHERE n_chars >= 500 AND doc_id NOT IN (SELECT doc_id FROM labels)"


@query(f"SELECT doc_id, (SELECT count(*) FROM ({_CANDIDATES})) - 40 AS skipped_cap FROM ({_CANDIDATES} ORDER BY n_chars DESC, doc_id LIMIT 40)")
def ai_candidates(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "documents").where("n_chars >= 500").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")
    return R.capped(new, 40, [F.desc("n_chars"), F.asc("doc_id")]).select("doc_id", F.col("overflow").alias("skipped_cap"))


@query("SELECT event_id, ts FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 15")
def recent_runs(spark: SparkSession, d: str) -> DataFrame:
    return R.top_k(table(spark, d, "events").where("event_type = 'error'"), 15, F.desc("ts"), F.desc("event_id")).select("event_id", "ts")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS n FROM documents) WHERE n <= 20")
def cap_per_query(spark: SparkSession, d: str) -> DataFrame:
    return R.latest_k_per_key(table(spark, d, "documents"), ["source"], 20, F.desc("doc_id")).select("doc_id")


@query("SELECT p_partkey, min(k) AS keyword FROM (SELECT p_partkey, 1 AS k FROM part WHERE p_name LIKE '%ring%' UNION ALL SELECT p_partkey, 2 FROM part WHERE p_type LIKE 'PROMO%' UNION ALL SELECT p_partkey, 3 FROM part WHERE p_size > 40) GROUP BY p_partkey")
def keyword_union(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    lists = [part.where(c).select("p_partkey", F.lit(i).alias("keyword")) for i, c in enumerate(("p_name LIKE '%ring%'", "p_type LIKE 'PROMO%'", "p_size > 40"), 1)]
    return lists[0].unionByName(lists[1]).unionByName(lists[2]).groupBy("p_partkey").agg(F.min("keyword").alias("keyword"))


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    rows = _orders(spark, d)
    return rows.where("o_orderstatus = 'O'").select("o_custkey").subtract(rows.where("o_orderstatus = 'F'").select("o_custkey"))


@query("SELECT o_custkey, list_has_any(list(DISTINCT o_orderpriority), ['1-URGENT', '2-HIGH']) AS overlaps FROM orders GROUP BY o_custkey")
def set_intersection(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).groupBy("o_custkey").agg(F.arrays_overlap(F.collect_set("o_orderpriority"), F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))).alias("overlaps"))


# --- filters ------------------------------------------------------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND n_chars >= 200 AND source = 'src3' AND doc_id BETWEEN 10 AND 900 AND contains(lower(strip_accents(source || ' ' || lang)), 'src')")
def dashboard_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    test = R.optional_filters({"lang": (["en", "fr"], lambda v: F.col("lang").isin(v)), "least": (200, lambda v: F.col("n_chars") >= v), "source": ("src3", lambda v: F.col("source") == v), "from": (10, lambda v: F.col("doc_id") >= v), "to": (900, lambda v: F.col("doc_id") <= v), "status": (None, lambda v: F.col("lang") == v)})
    from ..functions import text as T

    return docs.where(test & T.matches_words(F.concat_ws(" ", "source", "lang"), F.lit("SRC"))).select("doc_id")


_AGE = f"date_diff('day', CAST(o_orderdate AS DATE), DATE '{_TODAY}')"


@query(f"SELECT o_orderkey, {_AGE} >= 0 AND {_AGE} < 7 AS week, {_AGE} >= 0 AND {_AGE} < 30 AS month, {_AGE} > 30 AS old FROM orders WHERE o_custkey % 3 = 0")
def in_period(spark: SparkSession, d: str) -> DataFrame:
    age = F.datediff(_day(), F.to_date("o_orderdate"))
    return _orders(spark, d).where("o_custkey % 3 = 0").select("o_orderkey", ((age >= 0) & (age < 7)).alias("week"), ((age >= 0) & (age < 30)).alias("month"), (age > 30).alias("old"))


@query("SELECT c_custkey, CASE WHEN c_acctbal > 7000 THEN 'stretch' WHEN c_acctbal >= 3000 THEN 'strong' ELSE 'eligible' END AS section, CASE WHEN c_custkey % 3 = 0 THEN 1.5 WHEN c_custkey % 3 = 1 THEN 2.0 WHEN c_acctbal > 7000 THEN 3.0 END AS years, CAST(coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END, CASE WHEN c_custkey % 5 = 0 THEN 50 END, -1) AS INT) AS rank FROM customer")
def section_and_years(spark: SparkSession, d: str) -> DataFrame:
    k, bal = F.col("c_custkey"), F.col("c_acctbal")
    tier = F.when(bal > 7000, "STRETCH").otherwise("ELIGIBLE")
    years = scoring.stored_years(F.when(k % 3 == 0, 1.5), F.when(k % 3 == 1, 2.0), tier, F.lit("stretch: requires 3y, you have 2"))
    return _customers(spark, d).select("c_custkey", scoring.section_of(tier, bal, 3000).alias("section"), years.alias("years"), scoring.rank_score(F.when(k % 2 == 0, F.col("c_nationkey")), F.when(k % 5 == 0, F.lit(50))).alias("rank"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 100 WHEN o_orderkey % 3 = 0 THEN o_orderkey % 100 END AS score, CASE WHEN o_orderkey % 6 = 0 THEN abs(o_custkey % 100 - o_orderkey % 100) END AS divergence, coalesce(CASE WHEN o_orderkey % 6 = 0 THEN abs(o_custkey % 100 - o_orderkey % 100) END >= 25, false) AS needs_review FROM orders")
def combined_scores(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    s = scoring.combined_score({"native": F.when(k % 2 == 0, F.col("o_custkey") % 100), "other": F.when(k % 3 == 0, k % 100)}, 25)
    return _orders(spark, d).select("o_orderkey", s.alias("s")).select("o_orderkey", "s.score", "s.divergence", "s.needs_review")


@query("SELECT skill, CAST(weight AS INT) AS weight FROM (SELECT lower(p_type) AS skill, max(p_size) AS weight FROM part WHERE p_size > 25 GROUP BY 1 UNION ALL SELECT DISTINCT lower(p_name), 2 FROM part WHERE p_size < 5 AND lower(p_name) NOT IN (SELECT lower(p_type) FROM part WHERE p_size > 25))")
def skill_overrides(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    rules = part.where("p_size > 25").groupBy(F.lower("p_type").alias("skill")).agg(F.max("p_size").alias("weight"))
    return scoring.with_overrides(rules, part.where("p_size < 5").select(F.col("p_name").alias("skill")), 2)


@cases(
    "kind string, decision string, ai int, own int",
    {"side": "VARCHAR"},
    [("gap", "good_fit", 90, 40, "ia"), ("gap", "good_fit", 30, 70, "python"), ("gap", "off_topic", 90, 40, "python"), ("gap", "too_senior", 30, 70, "ia"), ("gap", "location", 30, 70, None), ("gap", None, 30, 70, None), ("off_topic_strong", "good_fit", 10, 90, "python"), ("off_topic_strong", "location", 10, 90, "ia"), ("off_topic_strong", None, 10, 90, None)],
)
def side_cases(rows: DataFrame) -> DataFrame:
    return rows.select("n", scoring.sides_with(F.col("kind"), F.col("decision"), F.col("ai"), F.col("own")).alias("side"))
