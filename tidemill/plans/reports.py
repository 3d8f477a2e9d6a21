"""Registered queries of the counters, reports, validators and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import rendering, validation
from ..operators import relational as R
from ..operators.storage import shared_dir
from .registry import big, cases, query, table

# --- counters --------------------------------------------------------------------------------------


@query("SELECT count(*) AS fetched, count(*) FILTER (WHERE o_orderstatus <> 'F') AS eligible, count(*) FILTER (WHERE o_orderstatus = 'O' AND o_totalprice >= 200000) AS strong, count(*) FILTER (WHERE o_orderstatus = 'P') AS stretch, count(*) FILTER (WHERE o_orderkey % 7 = 0) AS duplicates, greatest(count(*) - count(*) FILTER (WHERE o_orderkey % 7 = 0) - count(*) FILTER (WHERE o_orderstatus <> 'F') - count(*) FILTER (WHERE o_orderstatus = 'P'), 0) AS rejected FROM orders")
def run_counters(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("o_orderstatus")
    n = table(spark, d, "orders").agg(F.count("*").alias("fetched"), F.count_if(s != "F").alias("eligible"), F.count_if((s == "O") & (F.col("o_totalprice") >= 200000)).alias("strong"), F.count_if(s == "P").alias("stretch"), F.count_if(F.col("o_orderkey") % 7 == 0).alias("duplicates"))
    return n.withColumn("rejected", F.greatest(F.col("fetched") - F.col("duplicates") - F.col("eligible") - F.col("stretch"), F.lit(0)))


@query("SELECT source, fetched, eligible, array_to_string(list_sort(langs), ',') AS langs FROM (SELECT source, sum(n) AS fetched, sum(e) AS eligible, list(lang || '=' || n) AS langs FROM (SELECT source, coalesce(lang, '?') AS lang, count(*) AS n, count(*) FILTER (WHERE n_chars > 500) AS e FROM documents GROUP BY ALL) GROUP BY source)")
def nested_counts(spark: SparkSession, d: str) -> DataFrame:
    each = table(spark, d, "documents").groupBy("source", F.coalesce("lang", F.lit("?")).alias("lang")).agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 500).alias("e"))
    nested = each.groupBy("source").agg(F.sum("n").alias("fetched"), F.sum("e").alias("eligible"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("m"))
    langs = F.array_join(F.array_sort(F.transform(F.map_entries("m"), lambda x: F.concat_ws("=", x["key"], x["value"]))), ",")
    return nested.select("source", "fetched", "eligible", langs.alias("langs"))


@query("SELECT user_id FROM (SELECT user_id, day, sum(value) AS v FROM (SELECT user_id % 10 AS user_id, CAST(ts AS DATE) AS day, CASE WHEN event_type = 'purchase' AND user_id % 10 IN (1, 2, 3) THEN value ELSE 0 END AS value FROM events) GROUP BY ALL) GROUP BY user_id HAVING count(*) = (SELECT count(DISTINCT CAST(ts AS DATE)) FROM events) AND sum(v) = 0")
def silent_sources(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumns({"source": F.col("user_id") % 10, "day": F.to_date("ts")})
    fetched = F.when((F.col("event_type") == "purchase") & F.col("source").isin(1, 2, 3), F.col("value")).otherwise(0.0)
    runs = events.groupBy("source", "day").agg(F.sum(fetched).alias("v"))
    n_runs = runs.select("day").distinct().agg(F.count("*").alias("runs"))
    silent = runs.groupBy("source").agg(F.count("*").alias("n"), F.sum("v").alias("v")).join(F.broadcast(n_runs), F.col("n") == F.col("runs"))  # one row
    return silent.where("v = 0").select(F.col("source").alias("user_id"))


@query("SELECT (SELECT count(*) FROM labels) AS decisions, (SELECT count(*) FROM labels WHERE quality = 1) AS good, round((SELECT count(*) FROM documents JOIN labels USING (doc_id) WHERE n_chars >= 2000 AND quality = 1) / nullif((SELECT count(*) FROM documents JOIN labels USING (doc_id) WHERE n_chars >= 2000), 0), 4) AS strong_precision, (SELECT count(*) FROM labels) >= 10 AS suggests, (SELECT string_agg(source || ':' || n, ',' ORDER BY n DESC, source) FROM (SELECT source, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE quality = 0 GROUP BY source ORDER BY n DESC, source LIMIT 10)) AS missing")
def calibration_report(spark: SparkSession, d: str) -> DataFrame:
    judged = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    all_labels = table(spark, d, "labels").agg(F.count("*").alias("decisions"), F.count_if(F.col("quality") == 1).alias("good"))
    strong = judged.where("n_chars >= 2000").agg(F.round(F.try_divide(F.count_if(F.col("quality") == 1), F.count("*")), 4).alias("strong_precision"))
    top = R.top_k(judged.where("quality = 0").groupBy("source").agg(F.count("*").alias("n")), 10, F.desc("n"), F.asc("source"))
    missing = top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("r"), "source", "n"))), lambda x: F.concat_ws(":", x["source"], x["n"])), ",").alias("missing"))
    return all_labels.crossJoin(strong).crossJoin(missing).select("decisions", "good", "strong_precision", (F.col("decisions") >= 10).alias("suggests"), "missing")  # a row on each side


@query("SELECT kind, family, count(*) AS n FROM (SELECT CASE WHEN quality = 0 AND n_chars > 3000 THEN 'off_topic_strong' ELSE 'gap' END AS kind, coalesce(lang, '?') AS family FROM documents JOIN labels USING (doc_id) WHERE abs(n_chars // 100 - 100 * quality) > 25) GROUP BY GROUPING SETS ((kind), (family), ())")
def disagreement_report(spark: SparkSession, d: str) -> DataFrame:
    judged = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").where(F.abs(F.floor(F.col("n_chars") / 100) - 100 * F.col("quality")) > 25)
    rows = judged.select(F.when((F.col("quality") == 0) & (F.col("n_chars") > 3000), "off_topic_strong").otherwise("gap").alias("kind"), F.coalesce("lang", F.lit("?")).alias("family"))
    return rows.groupingSets([["kind"], ["family"], []], "kind", "family").agg(F.count("*").alias("n"))


_FUNNEL = "SELECT user_id AS k, bool_or(event_type = 'click') AS kept, bool_or(event_type = 'click') AND bool_or(event_type = 'purchase') AS sent, min(ts) FILTER (WHERE event_type = 'click') AS kept_at, min(ts) FILTER (WHERE event_type = 'purchase') AS sent_at, min(ts) FILTER (WHERE event_type = 'signup') AS reply_at FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 30 DAY GROUP BY 1"


@query(f"SELECT count(*) AS seen, count(*) FILTER (WHERE kept) AS kept, count(*) FILTER (WHERE sent) AS sent, count(*) FILTER (WHERE sent AND reply_at IS NOT NULL) AS replies, round(count(*) FILTER (WHERE sent AND reply_at IS NOT NULL) / nullif(count(*) FILTER (WHERE sent), 0), 4) AS reply_rate, round(avg(CASE WHEN sent AND date_diff('day', CAST(kept_at AS DATE), CAST(sent_at AS DATE)) >= 0 THEN date_diff('day', CAST(kept_at AS DATE), CAST(sent_at AS DATE)) END), 4) AS keep_to_send, count(*) FILTER (WHERE sent AND reply_at IS NULL) AS undated FROM ({_FUNNEL})")
def funnel_report(spark: SparkSession, d: str) -> DataFrame:
    at = lambda kind: F.min(F.when(F.col("event_type") == kind, F.col("ts")))
    events = table(spark, d, "events").where(F.col("ts") >= F.lit("2024-01-30").cast("timestamp") - F.expr("INTERVAL 30 DAYS"))
    rows = events.groupBy("user_id").agg(at("click").alias("kept_at"), at("purchase").alias("bought_at"), at("signup").alias("reply_at"))
    kept, sent, reply = F.col("kept_at").isNotNull(), F.col("kept_at").isNotNull() & F.col("bought_at").isNotNull(), F.col("reply_at").isNotNull()
    gap = F.datediff(F.to_date("bought_at"), F.to_date("kept_at"))
    counted = rows.agg(F.count("*").alias("seen"), F.count_if(kept).alias("kept"), F.count_if(sent).alias("sent"), F.count_if(sent & reply).alias("replies"), F.round(F.avg(F.when(sent & (gap >= 0), gap)), 4).alias("keep_to_send"), F.count_if(sent & ~reply).alias("undated"))
    return counted.withColumn("reply_rate", F.round(F.try_divide("replies", "sent"), 4))


@query("SELECT CAST(week AS VARCHAR) AS week, n FROM (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS week, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 26)")
def last_weeks(spark: SparkSession, d: str) -> DataFrame:
    weeks = table(spark, d, "orders").groupBy(F.to_date(F.date_trunc("week", "o_orderdate")).alias("week")).agg(F.count("*").alias("n"))
    return R.top_k(weeks, 26, F.desc("week")).select(F.col("week").cast("string").alias("week"), "n")


@query("SELECT (SELECT count(*) FROM orders) AS n_orders, (SELECT count(*) FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-10') AS calls, (SELECT round(coalesce(sum(value), 0), 2) FROM events WHERE strftime(ts, '%Y-%m-%d') LIKE '2024-01-%') AS spend, (SELECT round(coalesce(sum(value), 0), 2) FROM events WHERE strftime(ts, '%Y-%m-%d') LIKE '2031-01-%') AS none")
def simple_totals(spark: SparkSession, d: str) -> DataFrame:
    day, value = F.date_format("ts", "yyyy-MM-dd"), F.col("value")
    totals = table(spark, d, "events").agg(F.count_if(day == "2024-01-10").alias("calls"), F.round(F.coalesce(F.sum(F.when(day.like("2024-01-%"), value)), F.lit(0.0)), 2).alias("spend"), F.round(F.coalesce(F.sum(F.when(day.like("2031-01-%"), value)), F.lit(0.0)), 2).alias("none"))
    return table(spark, d, "orders").agg(F.count("*").alias("n_orders")).crossJoin(totals)  # a row on each side


@query("SELECT (SELECT count(DISTINCT k) FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_custkey FROM orders WHERE o_orderdate <= TIMESTAMP '1998-08-02')) AS waiting")
def today_count(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    due = orders.where(F.col("o_orderdate") <= F.lit("1998-08-02").cast("timestamp")).select("o_custkey")
    return orders.where("o_orderstatus = 'O'").select("o_custkey").unionByName(due).agg(F.count_distinct("o_custkey").alias("waiting"))


@query("SELECT c_mktsegment AS status, count(*) AS n, count(*) FILTER (WHERE c_nationkey < 5) AS guessed, round(count(*) FILTER (WHERE c_nationkey < 5 AND c_acctbal > 0) / nullif(count(*) FILTER (WHERE c_nationkey < 5), 0), 4) AS accuracy FROM customer GROUP BY c_mktsegment")
def detection_report(spark: SparkSession, d: str) -> DataFrame:
    guess = F.col("c_nationkey") < 5
    return table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("status")).agg(F.count("*").alias("n"), F.count_if(guess).alias("guessed"), F.round(F.try_divide(F.count_if(guess & (F.col("c_acctbal") > 0)), F.count_if(guess)), 4).alias("accuracy"))


@query("SELECT o_orderpriority AS source, count(*) AS events, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS leads, count(*) FILTER (WHERE o_orderkey % 3 = 1) AS deduped, count(*) FILTER (WHERE c_custkey IS NULL) AS no_company FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 GROUP BY 1")
def funding_counters(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").join(table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left")
    k = F.col("o_orderkey") % 3
    return rows.groupBy(F.col("o_orderpriority").alias("source")).agg(F.count("*").alias("events"), F.count_if(k == 0).alias("leads"), F.count_if(k == 1).alias("deduped"), F.count_if(F.col("c_custkey").isNull()).alias("no_company"))


@query("SELECT event_type AS model, CAST(sum(k * 2 + CAST(floor(value) AS BIGINT) * 10) AS BIGINT) AS micro_usd, round(avg(CASE WHEN n <= 20 THEN k * 2 + CAST(floor(value) AS BIGINT) * 10 END), 4) AS estimate FROM (SELECT event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) GROUP BY event_type")
def model_costs(spark: SparkSession, d: str) -> DataFrame:
    k, out = F.from_json("props", "k BIGINT")["k"], F.floor("value")
    last = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id")))
    cost = table(spark, d, "events").select(F.col("event_type").alias("model"), (k * 2 + out * 10).alias("cost"), last.alias("n"))
    return cost.groupBy("model").agg(F.sum("cost").alias("micro_usd"), F.round(F.avg(F.when(F.col("n") <= 20, F.col("cost"))), 4).alias("estimate"))


# --- sinks ----------------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000")
def replace_all(spark: SparkSession, d: str) -> DataFrame:
    """A mirror that is replaced as a whole: written twice, read as the second writing left it."""
    where = f"{shared_dir(spark)}/mirror-{uuid.uuid4().hex}"
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    for least in (0, 5000):
        rows.where(F.col("c_acctbal") > least).select("c_custkey", "c_name").write.mode("overwrite").parquet(where)
    return spark.read.schema("c_custkey bigint, c_name string").parquet(where)


@query("""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, '{"events":' || count(*) || ',"users":' || count(DISTINCT user_id) || '}' AS summary FROM events GROUP BY 1""")
def run_summaries(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"))
    return days.select("day", F.to_json(F.struct("events", "users")).alias("summary"))


@query("""SELECT s_suppkey, '{"key":"s:' || s_suppkey || '","name":"' || s_name || '","nation":' || s_nationkey || '}' AS entry FROM supplier""")
def allowed_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Only the listed fields reach the snapshot."""
    entry = F.struct(F.concat(F.lit("s:"), "s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return table(spark, d, "supplier").select("s_suppkey", F.to_json(entry).alias("entry"))


@query("""SELECT section, '<h2>' || section || '</h2><ul>' || string_agg(CASE WHEN n % 2 = 0 THEN '<li><a href="https://x/' || n || '">' || t || '</a></li>' ELSE '<li>' || t || '</li>' END, '' ORDER BY n) || '</ul>' AS html FROM (SELECT CASE r_regionkey % 2 WHEN 0 THEN 'strong &amp; new' ELSE 'stretch' END AS section, n_nationkey AS n, '&lt;' || n_name || '&gt; &amp; co' AS t FROM nation JOIN region ON r_regionkey = n_regionkey) GROUP BY section""")
def digest_html(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("r_regionkey") == F.col("n_regionkey"))  # five rows at every scale
    rows = rows.withColumn("section", F.when(F.col("r_regionkey") % 2 == 0, "strong & new").otherwise("stretch"))
    link = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("https://x/"), "n_nationkey")).otherwise("javascript:x")
    return rendering.section_html(rows, "section", [F.col("n_nationkey")], F.concat(F.lit("<"), "n_name", F.lit("> & co")), link).withColumn("section", rendering.escaped(F.col("section")))


@query("SELECT p_type, '| ' || p_type || ' | ' || n || ' | a \\| b |' AS line FROM (SELECT p_type, count(*) AS n FROM part GROUP BY p_type)")
def markdown_report(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n"))
    return n.select("p_type", rendering.markdown_row(F.col("p_type"), F.col("n"), F.lit("a | b")).alias("line"))


# --- validators ---------------------------------------------------------------------------------------------

_STATUSES, _LABELS = ["to_review", "to_apply", "applied", "interview", "rejected", "ignored"], ["good_fit", "off_topic", "too_senior", "missing_skill", "location"]
_OK = {"job_key": "jobs:12", "status": "applied", "applied_at": "2024-02-29", "follow_up_at": None, "note": "x", "cv_url": "https://x/y", "updated_at": "2024-01-01T00:00:00"}


@cases(
    "row map<string,string>",
    {"ok": "BOOLEAN"},
    [
        (_OK, True), (_OK | {"applied_at": "2023-02-29"}, False), (_OK | {"status": "lost"}, False), (_OK | {"cv_url": "http://x"}, False), (_OK | {"extra": "1"}, False), ({k: v for k, v in _OK.items() if k != "note"}, False), (_OK | {"job_key": "no key"}, False),
        (_OK | {"reactivated_at": "2024-01-01T00:00:00"}, True), (_OK | {"reactivated_at": "x"}, False), (_OK | {"updated_at": None}, False), (_OK | {"note": "n" * 2001}, False), (None, False),
    ],
)
def application_validity(rows: DataFrame) -> DataFrame:
    return rows.select("n", validation.application(F.col("row"), _STATUSES).alias("ok"))


_DECISION = {"id": "3", "job_key": "jobs:12", "label": "good_fit", "score_at_decision": "80", "created_at": "2024-01-01T00:00:00"}


@cases("row map<string,string>", {"ok": "BOOLEAN"}, [(_DECISION, True), (_DECISION | {"score_at_decision": "101"}, False), (_DECISION | {"score_at_decision": None}, True), (_DECISION | {"label": "nice"}, False), (_DECISION | {"id": "x"}, False), ({}, False)])
def decision_validity(rows: DataFrame) -> DataFrame:
    return rows.select("n", validation.decision(F.col("row"), _LABELS).alias("ok"))


_VERDICT = {"score": "70", "level": "bon", "reasons": '["a","b"]', "red_flags": "[]"}


@cases(
    "row map<string,string>", {"ok": "BOOLEAN"},
    [(_VERDICT, True), (_VERDICT | {"reasons": '["a","b","c","d"]'}, False), (_VERDICT | {"reasons": "a"}, False), (_VERDICT | {"reasons": '[""]'}, False), (_VERDICT | {"level": "x"}, False), (_VERDICT | {"score": "-1"}, False), (_VERDICT | {"more": "1"}, False)],
)
def verdict_validity(rows: DataFrame) -> DataFrame:
    return rows.select("n", validation.verdict(F.col("row"), ["bon", "moyen", "hors_sujet"]).alias("ok"))


@cases(
    "text string, source string", {"errors": "VARCHAR"},
    [("I led 5 people with Docker", "I led 5 people with docker", ""), ("I led 7 people with Docker at Acme", "I led 5 people", "name Acme|number 7|tool Docker"), ("", "5", ""), ("3,5 years", "3.5 years", "number 3,5")],
)
def document_checks(rows: DataFrame) -> DataFrame:
    return rows.select("n", F.array_join(validation.document_errors(F.col("text"), F.col("source"), ["Docker", "Kubernetes"], ["Acme"]), "|").alias("errors"))


@query("""SELECT event_id, '{"a":' || CAST(json_extract_string(props, '$.k') AS BIGINT) || ',"t":"' || event_type || '"}' AS canonical FROM events""")
def canonical_json(spark: SparkSession, d: str) -> DataFrame:
    """Sorted keys, compact, private fields (_jm_*) dropped."""
    fields = F.create_map(F.lit("t"), F.to_json(F.array("event_type")), F.lit("_jm_x"), F.lit("1"), F.lit("a"), F.from_json("props", "k BIGINT")["k"].cast("string"))
    kept = F.array_sort(F.map_entries(F.map_filter(fields, lambda k, v: ~k.startswith("_jm_"))))
    pairs = F.transform(kept, lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), F.regexp_replace(e["value"], r"^\[|\]$", "")))
    return table(spark, d, "events").select("event_id", F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")).alias("canonical"))


@query("SELECT o_orderkey, CAST(greatest(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02'), 0) AS BIGINT) AS age, CASE WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') > 0 THEN 'late ' || date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') || ' d' ELSE 'today' END AS overdue, CAST(CAST(date_trunc('week', o_orderdate) AS DATE) AS VARCHAR) AS week FROM orders")
def date_rules(spark: SparkSession, d: str) -> DataFrame:
    gap = F.datediff(F.lit("1998-08-02").cast("date"), F.to_date("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", big(F.greatest(gap, F.lit(0))).alias("age"), F.when(gap > 0, F.concat(F.lit("late "), gap, F.lit(" d"))).otherwise("today").alias("overdue"), F.to_date(F.date_trunc("week", "o_orderdate")).cast("string").alias("week"))


@query(
    """SELECT doc_id, array_to_string(list_filter([source || ': amount, company', coalesce(lang, '?') || CASE WHEN doc_id % 2 = 0 THEN ': round, hiring' ELSE ': round' END, CASE WHEN doc_id % 2 = 1 THEN 'x' || doc_id || ': hiring' END], lambda x: x IS NOT NULL)[1 : CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 3 END], '|') AS lines FROM documents WHERE source IS NOT NULL"""
)
def evidence_lines(spark: SparkSession, d: str) -> DataFrame:
    """Fields by the sentence that tells them, sentences in the order of their first field, three at most (two for every fifth row)."""
    rows = table(spark, d, "documents").where("source IS NOT NULL")
    lang, k = F.coalesce("lang", F.lit("?")), F.col("doc_id")
    told = F.array(*[F.struct(F.lit(field).alias("field"), said.alias("said")) for field, said in (("amount", F.col("source")), ("round", lang), ("company", F.col("source")), ("hiring", F.when(k % 2 == 0, lang).otherwise(F.concat(F.lit("x"), k))))])
    few, many = rendering.evidence_lines(told, 2), rendering.evidence_lines(told, 3)
    return rows.select("doc_id", F.array_join(F.when(k % 5 == 0, few).otherwise(many), "|").alias("lines"))
