"""Registered queries of the readers' mappings, over fixed answers of each kind."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.storage import shared_dir
from ..sources import boards
from .registry import cases, query, table, worked


def _answer(rows: DataFrame, kind: str) -> DataFrame:
    return rows.select("n", F.from_json("answer", boards.SCHEMAS[kind]).alias("a")).select("n", "a.*")


_SHOWN = {"id": "VARCHAR", "title": "VARCHAR", "location": "VARCHAR", "contract": "VARCHAR", "url": "VARCHAR", "day": "VARCHAR"}


def _shown(postings: DataFrame) -> DataFrame:
    """The mapped columns of the one posting of each kind."""
    return postings.select(F.col("source_job_id").alias("id"), "title", "location", "contract", "url", F.to_date("published_at").cast("string").alias("day"))


def _one(kind: str, mapping: object, answer: dict, told: tuple) -> None:
    def run(rows: DataFrame) -> DataFrame:
        return _shown(mapping(_answer(rows, kind))).select(F.lit(0).alias("n"), "*")

    run.__name__ = f"read_{kind}"
    cases("answer string", _SHOWN, [(json.dumps(answer), *told)])(run)


_one("search", boards.search, {"resultats": [{"id": "1", "intitule": "Dev", "typeContrat": "ALT", "lieuTravail": {"libelle": "75 - Paris"}, "dateCreation": "2024-01-02T03:04:05Z", "origineOffre": {"urlOrigine": "https://x/1"}}]}, ("1", "Dev", "75 - Paris", "ALTERNANCE", "https://x/1", "2024-01-02"))
_one("region", boards.region, {"jobs": [{"id": None, "title": "x"}, {"id": "7", "title": "Stage dev", "location": "Lyon", "snippet": "<p>a</p>", "link": "https://x/7", "updated": "2024-02-03T00:00:00"}]}, ("7", "Stage dev", "Lyon", "STAGE", "https://x/7", "2024-02-03"))
_one("keyword", boards.keyword, {"results": [{"id": "9", "title": "Ops", "company": {"display_name": "Z"}, "location": {"display_name": "Nice"}, "contract_type": "permanent", "redirect_url": "https://x/9", "created": "2024-03-04T05:06:07Z"}]}, ("9", "Ops", "Nice", "CDI", "https://x/9", "2024-03-04"))
_one("html_board", lambda a: boards.html_board(a, "Acme"), {"jobs": [{"id": 3, "title": "CDD dev", "absolute_url": "https://x/3", "location": {"name": "Brest"}, "first_published": "2024-05-06T07:08:09Z", "content": "&lt;p&gt;x&lt;/p&gt;"}]}, ("3", "CDD dev", "Brest", "CDD", "https://x/3", "2024-05-06"))
_one("multi_board", lambda a: boards.multi_board(a, "Acme"), {"postings": [{"id": "z", "text": "T", "hostedUrl": "https://x/z", "categories": {"location": "Paris", "allLocations": ["paris", "Lyon"], "commitment": "CDI"}, "createdAt": 1700000000000}]}, ("z", "T", "Paris, Lyon", "CDI", "https://x/z", "2023-11-14"))
_one(
    "listed_board", lambda a: boards.listed_board(a, "Acme"),
    {"jobs": [{"id": "u", "title": "hidden", "isListed": False}, {"id": "a1", "title": "SRE", "jobUrl": "https://x/a1", "location": "Paris", "employmentType": "Contractor", "publishedAt": "2024-06-07T00:00:00+02:00", "address": {"postalAddress": {"addressLocality": "paris", "addressCountry": "France"}}, "secondaryLocations": [{"location": "Lille"}]}]},
    ("a1", "SRE", "Paris, France, Lille", "FREELANCE", "https://x/a1", "2024-06-06"),
)


@cases(
    "path string, said string", {"id": "VARCHAR", "days": "INT"},
    [("/job/Brest/Ingenieur-CFD_R0347114-1", "Posted Today", "R0347114-1", 0), ("/job/x/plain/", "Posted Yesterday", "plain", 1), ("/a_b c!", "Posted 3 Days Ago", "bc", 3), ("", "Posted 30+ Days Ago", "unknown", 31), ("/x", "soon", "x", 15)],
)
def listing_cases(rows: DataFrame) -> DataFrame:
    return rows.select("n", boards.posting_id(F.col("path")).alias("id"), boards.posted_days(F.col("said")).alias("days"))


def _post(ident: str, said: str) -> dict:
    return {"externalPath": f"/job/X/T_{ident}", "title": f"T {ident}", "postedOn": said, "detail": {"location": "Brest", "additionalLocations": ["brest", "Lyon"], "country": {"descriptor": "France"}, "startDate": "2024-01-05", "jobDescription": "<p>x</p>"}}


@worked("SELECT * FROM (VALUES (CAST(1 AS INT), 'R2', CAST(0 AS INT), 'devops', 'Brest, Lyon, France'), (2, 'R1', 3, 'devops', 'Brest, Lyon, France')) t(place, id, days, keyword, location)")
def read_listing(spark: SparkSession, d: str) -> DataFrame:
    """Two keyword searches of one board: first seen per id, the freshest first, two at most."""
    pages = spark.createDataFrame([("b", "devops", json.dumps({"jobPostings": [_post("R1", "Posted 3 Days Ago"), _post("R2", "Posted Today")]})), ("b", "sre", json.dumps({"jobPostings": [_post("R2", "Posted Today"), _post("R3", "Posted 30+ Days Ago")]}))], "board string, keyword string, answer string")
    fresh = boards.freshest(pages.select("board", "keyword", F.from_json("answer", boards.SCHEMAS["detail_board"]).alias("a")).select("board", "keyword", "a.*"), 2)
    mapped = boards.detail_board(fresh, "Acme").select(F.col("source_job_id").alias("id"), "location")
    return fresh.join(mapped, "id").select("place", "id", "days", "keyword", "location")


@worked("SELECT * FROM (VALUES ('a', CAST(3 AS BIGINT), true), ('b', 2, false)) t(board, got, complete)")
def read_pages(spark: SparkSession, d: str) -> DataFrame:
    page = lambda ids, total: json.dumps({"totalFound": total, "content": [{"id": i, "name": f"N{i}", "company": {"identifier": "c"}} for i in ids]})
    rows = spark.createDataFrame([("a", 0, page("12", 3)), ("a", 2, page("23", 3)), ("b", 0, page("45", 9))], "board string, offset int, answer string")
    pages = rows.select("board", "offset", F.from_json("answer", boards.SCHEMAS["paged_board"]).alias("a")).select("board", "offset", "a.*")
    return boards.paged(pages, 100)[1]


_RSS = """<rss version="2.0"><channel><item><title> Dev </title><link>https://x/offer.aspx?idOffre=25&amp;r=1</link><description>&lt;p&gt;a&lt;/p&gt;</description><pubDate>Tue, 02 Jan 2024 03:04:05 +0000</pubDate><category>IT</category><category>CDI</category><category> Lyon </category></item>
<item><title>No id</title><link>https://x/offer.aspx</link><category>IT</category></item><item><title>Two</title><link>https://x/o?offerReference=7</link><category>IT</category><category>CDD</category></item></channel></rss>"""


@worked("SELECT * FROM (VALUES ('25', 'Dev', 'Lyon', 'CDI', '2024-01-02'), ('7', 'Two', '', 'UNKNOWN', NULL)) t(id, title, location, contract, day)")
def read_feed_board(spark: SparkSession, d: str) -> DataFrame:
    """An RSS file, written to the shared folder and read by Spark's XML reader."""
    where = f"{shared_dir(spark)}/feed-board"
    spark.createDataFrame([(_RSS,)], "value string").coalesce(1).write.mode("overwrite").text(where)
    postings = boards.feed_board(boards.rss(spark, where, boards.FEED_BOARD), "Acme")
    return _shown(postings).select("id", "title", "location", "contract", "day")


@worked("SELECT * FROM (VALUES ('https://ex.org/a', 'T', 'x'), ('https://ex.org/b', 'B', 'z')) t(url, title, extract)")
def read_feed(spark: SparkSession, d: str) -> DataFrame:
    items = [("https://Ex.org/a?utm_source=f", "T", "<p>x</p>", "Tue, 02 Jan 2024 03:04:05 +0000"), ("https://ex.org/a", "U", "y", None), ("", "V", "z", None), ("https://ex.org/old", "O", "o", "Mon, 01 Jan 2018 00:00:00 +0000"), ("https://ex.org/b/", "B", "z", None)]
    return boards.feed(spark.createDataFrame(items, boards.SCHEMAS["feed"]), F.lit("2020-01-01").cast("timestamp")).select("url", "title", "extract")


@cases(
    "page string", {"status": "VARCHAR", "board": "VARCHAR", "identifier": "VARCHAR", "platform": "VARCHAR"},
    [
        ("<a href='https://boards.greenhouse.io/acme/jobs/1'>", "verified", "greenhouse", "acme", None), ("see jobs.lever.co/zed.", "verified", "lever", "zed", None), ("https://x.wd3.myworkdayjobs.com/fr-FR/Careers", "verified", "workday", "x.wd3.myworkdayjobs.com/x/Careers", None), ("https://wd5.myworkdaysite.com/en-US/recruiting/Acme/Jobs_1 ", "verified", "workday", "wd5.myworkdaysite.com/acme/Jobs_1", None), ("https://x.wd3.myworkdayjobs.com/fr-FR", "not_found", None, None, None), ("https://a.eightfold.ai/x", "custom", None, None, "eightfold"),
        ("https://acme.taleo.net/x", "custom", None, None, "taleo"), ("nothing", "not_found", None, None, None), ("https://boards.greenhouse.io/embed/job_board?for=foo", "verified", "greenhouse", "foo", None), ("https://jobs.lever.co/api", "not_found", None, None, None),
    ],
)
def board_detection(rows: DataFrame) -> DataFrame:
    return rows.select("n", boards.detected(F.col("page")).alias("x")).select("n", "x.*")


@cases(
    "path string, value string", {"accepted": "BOOLEAN", "k": "INT"},
    [("a", '[{"success":true,"results":[{"k":5}]}]', True, 5), ("b", '[{"success":false,"results":[{"k":1}]}]', False, None), ("c", "not json", False, None), ("d", '[{"success":true,"results":[]},{"success":true}]', False, None), ("e", '[{"success":true,"results":[]}]', True, None)],
)
def read_export(rows: DataFrame) -> DataFrame:
    return boards.export_rows(rows.select(F.col("n").cast("string").alias("path"), "value"), "k:int").select(F.col("path").cast("int").alias("n"), "accepted", F.col("row.k").alias("k"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderdate >= TIMESTAMP '1995-01-01' AND starts_with(o_orderpriority, '1')")
def unknown_postings(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.lit("s").alias("source"), F.col("o_orderkey").cast("string").alias("source_job_id"), F.col("o_orderdate").alias("published_at"), F.col("o_orderpriority").alias("title"))
    stored = rows.where(F.col("source_job_id").cast("bigint") % 3 == 0)
    kept = boards.unknown_only(rows, stored, F.lit("1995-01-01").cast("timestamp"), T.starts_term(T.fold(F.col("title")), "1"))
    return kept.select(F.col("source_job_id").cast("bigint").alias("o_orderkey"))


_LINES = r"list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '')"


@query(f"SELECT doc_id, sha256(array_to_string({_LINES}, chr(10))) AS text_sha256, CAST(len({_LINES}) AS BIGINT) AS n_lines FROM documents")
def article_texts(spark: SparkSession, d: str) -> DataFrame:
    """The readable text of article pages, here made of documents: signs escaped, a block per line, and links, scripts of style and line breaks of markup around."""
    signs = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;amp;")), F.lit("<"), F.lit("&amp;lt;")), F.lit(">"), F.lit("&amp;gt;"))
    page = F.concat(F.lit("<div class='a'><p>"), F.regexp_replace(signs, "\n", "</p><p>"), F.lit("</p><br/></div>"))
    text = T.html_text(page)
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    return table(spark, d, "documents").select("doc_id", F.sha2(text, 256).alias("text_sha256"), F.size(lines).cast("bigint").alias("n_lines"))


@worked("SELECT 'a,c' AS ready, 'b,x' AS missing")
def source_factory(spark: SparkSession, d: str) -> DataFrame:
    make = lambda n: lambda: spark.createDataFrame([(n,)], "name string")
    tables, missing = boards.enabled({n: make(n) for n in "abc"}, ["a", "b", "x", "c"], {"b": ["KEY"], "c": ["TOKEN"]}, {"TOKEN": "t"})
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    return rows.agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("ready")).withColumn("missing", F.lit(",".join(missing)))
