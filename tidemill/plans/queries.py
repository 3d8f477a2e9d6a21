"""The registered queries of the core library, each beside the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import relational as R
from ..operators import similarity, storage
from ..streaming import streams
from .registry import ORACLE_SQL, QUERIES, big, cases, query, table

__all__ = ["ORACLE_SQL", "QUERIES"]
#: The day that the state rules take as today.
TODAY = "1998-08-02"


#: The folding of functions.text.fold() in SQL; X is the text.
FOLD = r"trim(regexp_replace(regexp_replace(lower(strip_accents(replace(replace(replace(replace(replace(X, 'œ', 'oe'), 'Œ', 'OE'), 'æ', 'ae'), 'Æ', 'AE'), 'ß', 'ss'))), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def fold_sql(x: str) -> str:
    return FOLD.replace("X", x)


TITLE_SQL = "split_part(text, chr(10), 1)"


@query(f"SELECT doc_id, sha256(folded) AS folded_sha256, CAST(length(folded) AS BIGINT) AS n FROM (SELECT doc_id, {fold_sql('text')} AS folded FROM documents)")
def norm_text(spark: SparkSession, d: str) -> DataFrame:
    folded = table(spark, d, "documents").select("doc_id", T.fold(F.col("text")).alias("folded"))
    return folded.select("doc_id", F.sha2("folded", 256).alias("folded_sha256"), big(F.length("folded")).alias("n"))


_URL_SQL = r"""SELECT page_id, base, frag, list_filter(string_split(q, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|source|fbclid|gclid|msclkid)(=|$)')) AS kept
FROM (SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) AS base, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS q, regexp_extract(url, '(#.*)$', 1) AS frag FROM pages)"""


@query(f"SELECT page_id, base || CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(kept, '&') END || frag AS url, lower(regexp_extract(base, '^[A-Za-z]+://([^/?#:]*)', 1)) AS host FROM ({_URL_SQL})")
def url_strip_tracking(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.strip_tracking(F.col("url")).alias("url"), T.host(F.col("url")).alias("host"))


@query(
    rf"""SELECT page_id, origin || CASE WHEN path IN ('', '/') THEN '/' ELSE regexp_replace(path, '/+$', '') END || q AS url FROM
(SELECT page_id, lower(regexp_extract(base, '^([A-Za-z]+://[^/]*)', 1)) AS origin, regexp_replace(base, '^[A-Za-z]+://[^/]*', '') AS path, CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(kept, '&') END AS q FROM ({_URL_SQL}))"""
)
def url_article(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.article_url(F.col("url")).alias("url"))


@query()
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    text = table(spark, d, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))
    return text.select("page_id", big(F.length("text")).alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


_PRINT_SQL = f"sha256({fold_sql('source')} || '|' || {fold_sql(TITLE_SQL)} || '|' || {fold_sql('lang')} || '|' || {fold_sql('substr(text, 1, 500)')})"


def _prints(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.fingerprint(F.col("source"), T.first_line(F.col("text")), F.col("lang"), F.substring("text", 1, 500)).alias("fingerprint"))


@query(f"SELECT doc_id, {_PRINT_SQL} AS fingerprint FROM documents")
def fingerprint_sha256(spark: SparkSession, d: str) -> DataFrame:
    return _prints(spark, d)


_TEXT_PRINT_SQL = f"SELECT doc_id, sha256({fold_sql('text')}) AS fp FROM documents"


def _text_prints(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(T.fold(F.col("text")), 256).alias("fp"))


@query(f"SELECT canonical, doc_id AS duplicate, 1.0 AS similarity FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY fp) AS canonical FROM ({_TEXT_PRINT_SQL})) WHERE canonical < doc_id")
def dedup_exact_links(spark: SparkSession, d: str) -> DataFrame:
    prints = storage.cut(_text_prints(spark, d))  # folded and hashed once, used twice
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("canonical"), F.count("*").alias("n")).where("n > 1")
    return prints.join(first, "fp").where("canonical < doc_id").select("canonical", F.col("doc_id").alias("duplicate"), F.lit(1.0).alias("similarity"))


@query(
    f"""WITH RECURSIVE p AS (SELECT doc_id AS id, lag(doc_id) OVER (PARTITION BY fp ORDER BY doc_id) AS parent FROM ({_TEXT_PRINT_SQL})),
r AS (SELECT id, id AS root FROM p WHERE parent IS NULL UNION ALL SELECT p.id, r.root FROM p JOIN r ON p.parent = r.id) SELECT id, root FROM r"""
)
def duplicate_roots(spark: SparkSession, d: str) -> DataFrame:
    before = Window.partitionBy("fp").orderBy("doc_id")
    parents = _text_prints(spark, d).select(F.col("doc_id").alias("id"), F.lag("doc_id").over(before).alias("parent"))
    return R.roots(parents)


#: Days between collections that similar postings may lie apart; doc_id stands for the day.
_WINDOW = 30


def _posts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "text")
    folded = docs.withColumn("title", T.title_name(F.substring(T.first_line(F.col("text")), 1, 80))).withColumn("text", T.fold(F.col("text")))
    company = F.when(F.col("doc_id") % 10 != 0, F.col("source"))
    return folded.select(F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / 20).alias("at"), company.alias("company"), "title", F.col("lang").alias("place"), F.sha2("text", 256).alias("fp"), "text", (F.col("source") == "src7").alias("rejected"))


@query()
def dedup_fuzzy_links(spark: SparkSession, d: str) -> DataFrame:
    """The links of postings; token-set similarity has no SQL, so tests compare with all pairs by brute force."""
    return similarity.links(_posts(spark, d), _WINDOW)


@cases(
    "a string, b string",
    {"ratio": "DOUBLE"},
    [("data engineer", "engineer data", 100.0), ("data engineer", "data engineer senior paris", 100.0), ("", "x", 0.0), ("abc", "abd", 66.6667), ("fuzzy was a bear", "fuzzy fuzzy was a bear", 100.0), ("ops cloud lyon", "ops cloud nice", 78.5714), ("developer", "developers", 94.7368), ("a b", "c d", 33.3333)],
)
def token_set_cases(rows: DataFrame) -> DataFrame:
    return rows.select("n", F.round(similarity.token_set_ratio(F.col("a"), F.col("b")), 4).alias("ratio"))


_PAIRED = "lower(p_name || ' ' || p_type || ' ' || p_brand)"


@query(
    f"""WITH RECURSIVE t AS (SELECT p_partkey, list_sort(list_distinct(string_split({_PAIRED}, ' '))) AS w FROM part),
p AS (SELECT a.p_partkey, list_filter(a.w, lambda x: list_contains(b.w, x)) AS i, list_filter(a.w, lambda x: NOT list_contains(b.w, x)) AS l, list_filter(b.w, lambda x: NOT list_contains(a.w, x)) AS r FROM t a JOIN t b ON b.p_partkey = a.p_partkey + 1),
s AS (SELECT p_partkey, array_to_string(i, ' ') AS i, len(l) AS nl, len(r) AS nr, array_to_string(list_concat(i, l), ' ') AS a, array_to_string(list_concat(i, r), ' ') AS b FROM p),
c AS (SELECT *, list_transform(range(1, len(a) + 1), lambda k: substr(a, k, 1)) AS ca FROM s),
f AS (SELECT p_partkey, 0 AS j, list_transform(ca, lambda k: 0) AS row_ FROM c
  UNION ALL SELECT p_partkey, j, list_transform(range(1, len(cand) + 1), lambda k: list_max(cand[1:k])) FROM
    (SELECT c.p_partkey, f.j + 1 AS j, list_transform(range(1, len(ca) + 1), lambda k: CASE WHEN ca[k] = substr(b, f.j + 1, 1) THEN coalesce(row_[k - 1], 0) + 1 ELSE row_[k] END) AS cand FROM f JOIN c USING (p_partkey) WHERE f.j < len(b))),
e AS (SELECT p_partkey, row_[len(row_)] AS n FROM f JOIN c USING (p_partkey) WHERE j = len(b))
SELECT p_partkey, round(CASE WHEN len(i) > 0 AND (nl = 0 OR nr = 0) THEN 100 ELSE greatest(200.0 * n / (len(a) + len(b)), CASE WHEN len(i) > 0 THEN 200.0 * len(i) / (len(i) + least(len(a), len(b))) ELSE 0 END) END, 4) AS ratio FROM c JOIN e USING (p_partkey)"""
)
def token_set_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The token-set similarity of each part's words with those of the next."""
    parts = table(spark, d, "part").select("p_partkey", F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("words"))
    pairs = parts.join(parts.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("words").alias("next")), "p_partkey")
    return pairs.select("p_partkey", F.round(similarity.token_set_ratio(F.col("words"), F.col("next")), 4).alias("ratio"))


_GATES_SQL = rf"""SELECT doc_id, list_filter([CASE WHEN NOT (' ' || t LIKE '% th%' OR ' ' || t LIKE '% la%') THEN 'NOT_RELEVANT' END, CASE WHEN ' ' || t || ' ' LIKE '% worthless %' THEN 'TITLE' END,
CASE WHEN n_chars > 8000 THEN 'EXPERIENCE' END, CASE WHEN lang NOT IN ('en', 'fr', 'de') THEN 'CONTRACT' END, CASE WHEN source IN ('src3', 'src7') THEN 'LOCATION' END], lambda x: x IS NOT NULL) AS r FROM (SELECT *, {fold_sql('text')} AS t FROM documents)"""


def _gated(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("t", T.fold(F.col("text")))
    t = F.col("t")
    gates = [("NOT_RELEVANT", ~(T.starts_term(t, "th") | T.starts_term(t, "la"))), ("TITLE", T.names_term(t, "worthless")), ("EXPERIENCE", F.col("n_chars") > 8000), ("CONTRACT", ~F.col("lang").isin("en", "fr", "de")), ("LOCATION", F.col("source").isin("src3", "src7"))]
    return docs.select("doc_id", R.reasons(gates).alias("r"))


@query(f"SELECT doc_id, array_to_string(r, ', ') AS reasons, CASE WHEN len(r) > 0 THEN 'REJECTED' ELSE 'ELIGIBLE' END AS tier FROM ({_GATES_SQL})")
def gate_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _gated(spark, d).select("doc_id", F.array_join("r", ", ").alias("reasons"), F.when(F.size("r") > 0, "REJECTED").otherwise("ELIGIBLE").alias("tier"))


@query(f"SELECT reason, count(*) AS n FROM (SELECT unnest(r) AS reason FROM ({_GATES_SQL})) GROUP BY reason")
def rejected_by_reason(spark: SparkSession, d: str) -> DataFrame:
    return _gated(spark, d).select(F.explode("r").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CASE WHEN c_acctbal <= 3000 THEN 'eligible' WHEN c_acctbal <= 5000 THEN 'stretch' ELSE 'rejected' END AS tier FROM customer")
def stretch_band(spark: SparkSession, d: str) -> DataFrame:
    have, band = 3000, 2000
    return table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") <= have, "eligible").when(F.col("c_acctbal") <= have + band, "stretch").otherwise("rejected").alias("tier"))


_RULES = [("the", 12), ("la", 8), ("der", 5), ("stupid", -30), ("trash", -25), ("that", 3)]
_SCORE_SQL = "SELECT doc_id, greatest(0, least(100, 50" + "".join(f" + CASE WHEN ' ' || t || ' ' LIKE '% {w} %' THEN {n} ELSE 0 END" for w, n in _RULES) + ")) AS score, array_to_string(list_filter([" + ", ".join(f"CASE WHEN ' ' || t || ' ' LIKE '% {w} %' THEN '{w} {n:+d}' END" for w, n in _RULES) + f"], lambda x: x IS NOT NULL), '; ') AS why FROM (SELECT doc_id, {fold_sql('text')} AS t FROM documents)"


@query(_SCORE_SQL)
def score_ledger(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", T.fold(F.col("text")).alias("t"))
    score, said = R.ledger(50, [(w, n, T.names_term(F.col("t"), w)) for w, n in _RULES])
    return docs.select("doc_id", score.alias("score"), F.array_join(said, "; ").alias("why"))


@query(f"SELECT doc_id, score FROM ({_SCORE_SQL}) WHERE doc_id NOT IN (SELECT doc_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY fp) AS c FROM ({_TEXT_PRINT_SQL})) WHERE c < doc_id) ORDER BY score DESC, doc_id LIMIT 20")
def best_canonical_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", T.fold(F.col("text")).alias("t"))
    score, _ = R.ledger(50, [(w, n, T.names_term(F.col("t"), w)) for w, n in _RULES])
    # each text is folded once; the first document of a print carries its score through one aggregation
    scored = docs.select("doc_id", F.xxhash64("t").alias("fp"), F.sha2("t", 256).alias("fp2"), score.alias("score"))
    canonical = scored.groupBy("fp", "fp2").agg(F.min(F.struct("doc_id", "score")).alias("m")).select("m.*")
    return R.top_k(canonical, 20, F.desc("score"), F.asc("doc_id"))


@query(
    """SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE kind = 'profile') AS n_profile FROM (SELECT doc_id, line, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS kind
FROM (SELECT doc_id, pos, line, CASE WHEN length(line) <= 60 THEN CASE WHEN lower(line) LIKE 'th%' OR lower(line) LIKE 'la%' THEN 'profile' ELSE 'other' END END AS head FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents))) GROUP BY doc_id"""
)
def sections_profile(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    head = F.when(F.length("line") <= 60, F.when(F.lower("line").like("th%") | F.lower("line").like("la%"), "profile").otherwise("other"))
    so_far = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    kinds = lines.withColumn("kind", F.last(head, ignorenulls=True).over(so_far))
    return kinds.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(F.col("kind") == "profile").alias("n_profile"))


@query("SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'F' AND o_totalprice > 250000) AND c_acctbal > 0")
def canonical_visible(spark: SparkSession, d: str) -> DataFrame:
    handled = table(spark, d, "orders").where("o_orderstatus = 'F' AND o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").where("c_acctbal > 0").join(handled, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem l WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS returned FROM orders WHERE o_totalprice > 100000 OR EXISTS (SELECT 1 FROM lineitem l WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def closure_candidates(spark: SparkSession, d: str) -> DataFrame:
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(True).alias("returned")).distinct()
    return table(spark, d, "orders").join(returned, "o_orderkey", "left").withColumn("returned", F.coalesce("returned", F.lit(False))).where("o_totalprice > 100000 OR returned").select("o_orderkey", "returned")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return R.latest_per_key(table(spark, d, "events"), ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "event_id", "value")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER w AS b, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n = 1 OR event_type IS DISTINCT FROM b")
def latest_change_only(spark: SparkSession, d: str) -> DataFrame:
    return R.changes_only(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM (SELECT c_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM customer JOIN orders ON o_custkey = c_custkey) WHERE n = 1")
def latest_funding_by_company(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("m"))
    return table(spark, d, "customer").join(orders, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "m.o_orderkey", "m.o_totalprice")


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS open_jobs FROM customer")
def open_jobs(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return table(spark, d, "customer").join(n, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("open_jobs"))


_STATE_SQL = f"SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'expired' WHEN o_orderpriority = '1-URGENT' AND date_diff('day', CAST(o_orderdate AS DATE), DATE '{TODAY}') > 15 THEN 'archived_kept' WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '{TODAY}') > 20 THEN 'archived_published' ELSE 'active' END AS state, greatest(date_diff('day', CAST(o_orderdate AS DATE), DATE '{TODAY}'), 0) AS age FROM orders"


@query(_STATE_SQL.replace("greatest(", "CAST(greatest(").replace(", 0) AS age", ", 0) AS BIGINT) AS age"))
def archive_state(spark: SparkSession, d: str) -> DataFrame:
    age = F.datediff(F.lit(TODAY).cast("date"), F.col("o_orderdate").cast("date"))
    state = F.when(F.col("o_orderstatus") == "F", "expired").when((F.col("o_orderpriority") == "1-URGENT") & (age > 15), "archived_kept").when(age > 20, "archived_published").otherwise("active")
    return table(spark, d, "orders").select("o_orderkey", state.alias("state"), big(F.greatest(age, F.lit(0))).alias("age"))


_DAYS_SQL = "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL"


def _days(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


@query(f"SELECT event_type, CAST(day AS VARCHAR) AS day, n, round(m, 4) AS mean_before, coalesce(n < 0.9 * m, false) AS outage FROM (SELECT *, avg(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS m FROM ({_DAYS_SQL}))")
def outage_against_mean(spark: SparkSession, d: str) -> DataFrame:
    before = Window.partitionBy("event_type").orderBy("day").rowsBetween(-7, -1)
    m = _days(spark, d).withColumn("m", F.avg("n").over(before))
    return m.select("event_type", F.col("day").cast("string").alias("day"), "n", F.round("m", 4).alias("mean_before"), F.coalesce(F.col("n") < 0.9 * F.col("m"), F.lit(False)).alias("outage"))


@query(f"SELECT event_type FROM ({_DAYS_SQL}) WHERE n < 3 * (SELECT avg(n) FROM ({_DAYS_SQL})) GROUP BY event_type HAVING count(*) = (SELECT count(DISTINCT CAST(ts AS DATE)) FROM events)")
def present_every_day(spark: SparkSession, d: str) -> DataFrame:
    days = _days(spark, d)
    whole = days.agg(F.count_distinct("day").alias("days"), F.avg("n").alias("mean"))
    return days.join(F.broadcast(whole)).where("n < 3 * mean").groupBy("event_type", "days").agg(F.count("*").alias("c")).where("c = days").select("event_type")


@query("SELECT event_type, count(*) AS checked, count(*) FILTER (WHERE value > 50) AS closed, round(count(*) FILTER (WHERE value > 50) / count(*), 4) AS ratio FROM events GROUP BY event_type HAVING count(*) >= 10")
def closure_ratio(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("checked"), F.count_if(F.col("value") > 50).alias("closed"))
    return g.where("checked >= 10").withColumn("ratio", F.round(F.col("closed") / F.col("checked"), 4))


_JUDGED = "documents JOIN labels USING (doc_id)"


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").withColumn("score", F.least(F.lit(100), F.floor(F.col("n_chars") / 50)).cast("int"))


_JUDGED_SQL = f"SELECT doc_id, quality, toxic, source, lang, CAST(least(100, floor(n_chars / 50)) AS INT) AS score FROM {_JUDGED}"


@query(f"SELECT quality, count(*) AS n, min(score) AS least, median(score) AS median, max(score) AS most FROM ({_JUDGED_SQL}) GROUP BY quality")
def label_stats(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).groupBy("quality").agg(F.count("*").alias("n"), F.min("score").alias("least"), F.median("score").alias("median"), F.max("score").alias("most"))


@query(f"SELECT quality, least(score // 10, 9) AS bucket, count(*) AS n FROM ({_JUDGED_SQL}) GROUP BY ALL")
def label_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).groupBy("quality", F.least(F.floor(F.col("score") / 10), F.lit(9)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


@query(f"SELECT source, n_off + n_good AS support, round(((n_off + 0.5) / (o + 1)) / ((n_good + 0.5) / (g + 1)), 2) AS lift FROM (SELECT source, count(*) FILTER (WHERE quality = 0) AS n_off, count(*) FILTER (WHERE quality = 1) AS n_good FROM ({_JUDGED_SQL}) GROUP BY source), (SELECT count(*) FILTER (WHERE quality = 0) AS o, count(*) FILTER (WHERE quality = 1) AS g FROM ({_JUDGED_SQL})) WHERE n_off + n_good >= 3")
def rule_lifts(spark: SparkSession, d: str) -> DataFrame:
    judged = _judged(spark, d)
    off, good = F.count_if(F.col("quality") == 0), F.count_if(F.col("quality") == 1)
    each = judged.groupBy("source").agg(off.alias("n_off"), good.alias("n_good"))
    lift = ((F.col("n_off") + 0.5) / (F.col("o") + 1)) / ((F.col("n_good") + 0.5) / (F.col("g") + 1))
    return each.join(F.broadcast(judged.agg(off.alias("o"), good.alias("g")))).where("n_off + n_good >= 3").select("source", (F.col("n_off") + F.col("n_good")).alias("support"), F.round(lift, 2).alias("lift"))


@query(
    f"""SELECT t AS threshold, round(precision, 6) AS precision FROM (SELECT t, count(*) FILTER (WHERE score >= t AND quality = 1) / nullif(count(*) FILTER (WHERE score >= t), 0) AS precision, count(*) FILTER (WHERE score >= t AND quality = 1) / nullif(count(*) FILTER (WHERE quality = 1), 0) AS recall
FROM ({_JUDGED_SQL}), (SELECT unnest(range(0, 101, 5)) AS t) GROUP BY t) WHERE recall >= 0.5 ORDER BY precision DESC, t LIMIT 1"""
)
def best_threshold(spark: SparkSession, d: str) -> DataFrame:
    judged = _judged(spark, d).groupBy("score", "quality").agg(F.count("*").alias("n"))  # at most 202 rows
    at = judged.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(100), F.lit(5)))).groupBy("t").agg(
        F.sum(F.when((F.col("score") >= F.col("t")) & (F.col("quality") == 1), F.col("n")).otherwise(0)).alias("hit"),
        F.sum(F.when(F.col("score") >= F.col("t"), F.col("n")).otherwise(0)).alias("taken"),
        F.sum(F.when(F.col("quality") == 1, F.col("n")).otherwise(0)).alias("good"),
    )
    rated = at.withColumn("precision", F.try_divide("hit", "taken")).where(F.try_divide("hit", "good") >= 0.5)
    return R.top_k(rated.select(F.col("t").cast("bigint").alias("threshold"), F.round("precision", 6).alias("precision")), 1, F.desc("precision"), F.asc("threshold"))


@query("SELECT sum(v) AS seen, sum(c) AS kept, sum(p) AS sent, round(sum(c) / sum(v), 4) AS kept_rate, round(sum(p) / nullif(sum(c), 0), 4) AS sent_rate FROM (SELECT user_id, CAST(max(event_type = 'view') AS INT) AS v, CAST(bool_or(event_type = 'view') AND bool_or(event_type = 'click') AS INT) AS c, CAST(bool_or(event_type = 'view') AND bool_or(event_type = 'click') AND bool_or(event_type = 'purchase') AS INT) AS p FROM events GROUP BY user_id)")
def funnel_rates(spark: SparkSession, d: str) -> DataFrame:
    did = lambda kind: F.bool_or(F.col("event_type") == kind)
    users = table(spark, d, "events").groupBy("user_id").agg(did("view").alias("v"), (did("view") & did("click")).alias("c"), (did("view") & did("click") & did("purchase")).alias("p"))
    total = users.agg(F.count_if("v").alias("seen"), F.count_if("c").alias("kept"), F.count_if("p").alias("sent"))
    return total.select("seen", "kept", "sent", F.round(F.try_divide("kept", "seen"), 4).alias("kept_rate"), F.round(F.try_divide("sent", "kept"), 4).alias("sent_rate"))


@query(
    """SELECT CAST(CAST(week AS DATE) AS VARCHAR) AS week, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series((SELECT date_trunc('week', min(ts)) FROM events)::TIMESTAMP, (SELECT date_trunc('week', max(ts)) FROM events)::TIMESTAMP, INTERVAL 7 DAY)) AS week)
LEFT JOIN (SELECT date_trunc('week', ts)::TIMESTAMP AS week, count(*) AS n FROM events WHERE event_type = 'signup' AND value > 90 GROUP BY 1) USING (week)"""
)
def weekly_counts(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("week", F.to_date(F.date_trunc("week", "ts")))
    spine = events.agg(F.min("week").alias("a"), F.max("week").alias("b")).select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 7 DAYS"))).alias("week"))
    counted = events.where("event_type = 'signup' AND value > 90").groupBy("week").agg(F.count("*").alias("n"))
    return spine.join(counted, "week", "left").select(F.col("week").cast("string").alias("week"), F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT user_id, min(ts) FILTER (WHERE event_type NOT IN ('view', 'signup')) AS first_reply FROM events GROUP BY user_id")
def first_reply(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.min(F.when(~F.col("event_type").isin("view", "signup"), F.col("ts"))).alias("first_reply"))


@query("SELECT event_type, count(*) AS calls, round(sum(value), 2) AS tokens, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k FROM events GROUP BY event_type")
def usage_by_model(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k BIGINT")["k"]
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 2).alias("tokens"), F.sum(k).alias("k"))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM events) WHERE n <= 2")
def running_quota(spark: SparkSession, d: str) -> DataFrame:
    so_far = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    return table(spark, d, "events").withColumn("n", F.row_number().over(so_far)).where("n <= 2").select("event_id")


@query(f"SELECT doc_id, CASE WHEN quality = 0 AND score >= 60 THEN 'off_topic_strong' WHEN abs(score - 100 * quality) > 25 THEN 'gap' END AS kind FROM ({_JUDGED_SQL})")
def disagreement_kind(spark: SparkSession, d: str) -> DataFrame:
    s, q = F.col("score"), F.col("quality")
    return _judged(spark, d).select("doc_id", F.when((q == 0) & (s >= 60), "off_topic_strong").when(F.abs(s - 100 * q) > 25, "gap").alias("kind"))


@query("SELECT o_orderkey, CASE WHEN n.k IS NULL THEN o.s ELSE n.s END AS status, CASE WHEN n.k IS NULL THEN o.p WHEN o.k IS NULL THEN n.p ELSE coalesce(n.p, o.p) END AS priority, CASE WHEN o.k IS NULL THEN n.t ELSE o.t END AS price FROM (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p, o_totalprice AS t FROM orders WHERE o_orderkey % 3 <> 0) o FULL JOIN (SELECT o_orderkey AS k, 'N' AS s, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE '9-NEW' END AS p, o_totalprice + 1 AS t FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0) n ON o.k = n.k, LATERAL (SELECT coalesce(o.k, n.k) AS o_orderkey)")
def merge_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"))
    old = rows.where("o_orderkey % 3 <> 0")
    new = rows.where("o_orderkey % 2 = 0 OR o_orderkey % 3 = 0").select("o_orderkey", F.lit("N").alias("status"), F.when(F.col("o_orderkey") % 5 != 0, "9-NEW").alias("priority"), (F.col("price") + 1).alias("price"))
    return R.upsert(old, new, ["o_orderkey"], {"priority": R.NEW_UNLESS_NULL, "price": R.KEEP_OLD})


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) BETWEEN 0 AND 50 AND value >= 1) AS valid FROM events GROUP BY event_type")
def valid_rows(spark: SparkSession, d: str) -> DataFrame:
    ok = F.from_json("props", "k BIGINT")["k"].between(0, 50) & (F.col("value") >= 1)
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(ok).alias("valid"))


@query(r"SELECT doc_id, regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AS has_email, regexp_matches(text, '\+?[0-9][0-9 ().-]{7,}[0-9]') AS has_phone, regexp_matches(text, 'https?://') AS has_url FROM documents")
def personal_data_flags(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}").alias("has_email"), text.rlike(r"\+?[0-9][0-9 ().-]{7,}[0-9]").alias("has_phone"), text.rlike("https?://").alias("has_url"))


@query("SELECT DISTINCT conv_id, last_value(CASE WHEN length(text) > 600 THEN 'interview' WHEN length(text) < 80 THEN 'refused' END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS status FROM conversations")
def inbox_status(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.length("text") > 600, "interview").when(F.length("text") < 80, "refused")
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max_by(said, F.when(said.isNotNull(), F.col("turn"))).alias("status"))


@query("SELECT l_partkey, count(DISTINCT s_nationkey) AS n_places, max(l_extendedprice) AS best, array_to_string(list_sort(list(DISTINCT s_nationkey)), ',') AS places FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_partkey HAVING count(DISTINCT s_nationkey) >= 2")
def group_across_places(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    g = rows.groupBy("l_partkey").agg(F.array_sort(F.collect_set("s_nationkey")).alias("p"), F.max("l_extendedprice").alias("best"))
    return g.where(F.size("p") >= 2).select("l_partkey", big(F.size("p")).alias("n_places"), "best", F.array_join(F.col("p").cast("array<string>"), ",").alias("places"))


@query("SELECT o_orderkey, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_totalprice * 0.9 >= 50000 AND n_name <> 'CHINA' ORDER BY (o_orderpriority = '1-URGENT') DESC, o_orderdate DESC, o_orderkey LIMIT 10")
def lead_top_k(spark: SparkSession, d: str) -> DataFrame:
    nation = F.broadcast(table(spark, d, "nation"))  # a table of 25 rows at every scale
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
    kept = rows.where((F.col("o_totalprice") * 0.9 >= 50000) & (F.col("n_name") != "CHINA"))
    return R.top_k(kept, 10, F.desc(F.col("o_orderpriority") == "1-URGENT"), F.desc("o_orderdate"), F.asc("o_orderkey")).select("o_orderkey", "n_name")


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY ROLLUP (source, lang)")
def rollup_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").rollup("source", "lang").agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def stream_first_per_user(spark: SparkSession, d: str) -> DataFrame:
    """The first event of each user: the stream keeps the minimum per user within the horizon and hands it on when the watermark has passed."""
    return streams.run_available(streams.first_by_key(streams.events_stream(spark, d), "user_id", "ts", "event_id"), "complete")


@query("SELECT * FROM (SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2) WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def stream_hourly(spark: SparkSession, d: str) -> DataFrame:
    return streams.run_available(streams.hourly(streams.events_stream(spark, d)))


from . import checked, composed, extraction, listings, live, readers, reports, tracking  # noqa: E402, F401  (they register their queries)
