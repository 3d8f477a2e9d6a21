"""Queries that read paged listings, exported from documents: languages stand for keywords, sources for departments."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import shared_dir
from ..sources import boards, paged
from .registry import query, table

_PAGE, _WINDOW = 5, 14
_CODES = {0: "CDI", 1: "MIS", 2: "ALT"}


def _exported(spark: SparkSession, d: str) -> str:
    """A folder of answers: a document a minute, in pages of 5; pages that hold a document 0 mod 97 answer with an error."""
    docs = table(spark, d, "documents")
    at = F.date_format(F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("doc_id").cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    code = F.element_at(F.create_map(*[F.lit(x) for kv in _CODES.items() for x in kv]), (F.col("doc_id") % 3).cast("int"))
    rows = docs.select(F.col("lang").alias("keyword"), F.col("source").alias("department"), at.alias("published"), F.col("doc_id").alias("id"), code.alias("code"), F.when(F.col("doc_id") % 97 == 0, 400).alias("status"))
    item = F.to_json(F.struct(F.concat(F.lit("d"), "id").alias("id"), F.concat(F.lit("Doc "), "id").alias("intitule"), F.col("published").alias("dateCreation"), F.struct(F.col("department").alias("libelle")).alias("lieuTravail"), F.col("code").alias("typeContrat")))
    where = f"{shared_dir(spark)}/answers-{uuid.uuid4().hex}"
    paged.export_answers(rows, where, item, _PAGE, F.col("status"))
    return where


#: Place and page of each document in its listing, the first page with an error, and what a reader gets.
_READ = f"""ranked AS (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id DESC) - 1 AS place, count(*) OVER (PARTITION BY lang, source) AS total FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL),
bad AS (SELECT lang, source, min(place // {_PAGE}) AS page FROM ranked WHERE doc_id % 97 = 0 GROUP BY lang, source),
got AS (SELECT r.*, b.page AS bad_page FROM ranked r LEFT JOIN bad b USING (lang, source) WHERE place < {_WINDOW} AND (b.page IS NULL OR place // {_PAGE} < b.page))"""
_SINCE = "2024-01-01T02:00:00Z"


@query(
    f"""WITH {_READ} SELECT 'd' || doc_id AS source_job_id, 'Doc ' || doc_id AS title, source AS location, CASE doc_id % 3 WHEN 0 THEN 'CDI' WHEN 1 THEN 'INTERIM' ELSE 'ALTERNANCE' END AS contract, CAST(CAST(TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS DATE) AS VARCHAR) AS published, lang AS keyword
FROM got WHERE doc_id >= 120"""
)
def paged_search(spark: SparkSession, d: str) -> DataFrame:
    """The search source: a listing per keyword and department, its offset window, only what is published since a moment, mapped to postings."""
    read = paged.paged(spark, _exported(spark, d), page=_PAGE, window=_WINDOW, since=_SINCE)
    answers = read.select("keyword", F.from_json(F.concat(F.lit('{"resultats":['), "item", F.lit("]}")), boards.SCHEMAS["search"]).alias("a"))
    posts = boards.search(answers.select("a.resultats"))
    return posts.select("source_job_id", "title", "location", "contract", F.to_date("published_at").cast("string").alias("published")).join(read.select(F.get_json_object("item", "$.id").alias("source_job_id"), "keyword"), "source_job_id")


@query(
    f"""WITH {_READ}, n AS (SELECT lang, source, any_value(total) AS total, count(*) FILTER (WHERE g) AS n, any_value(bad_page) AS bad FROM (SELECT r.lang, r.source, r.total, g.doc_id IS NOT NULL AS g, b.page AS bad_page
  FROM ranked r LEFT JOIN got g USING (lang, source, doc_id) LEFT JOIN bad b USING (lang, source)) GROUP BY lang, source),
e AS (SELECT *, bad IS NOT NULL AND bad < {-(-_WINDOW // _PAGE)} AS failed FROM n)
SELECT lang AS keyword, source AS department, CAST(CASE WHEN failed THEN bad + 1 ELSE least({-(-_WINDOW // _PAGE)}, -(-total // {_PAGE})) END AS INTEGER) AS pages, CAST(n AS INTEGER) AS n,
  CASE WHEN NOT failed OR bad > 0 THEN CAST(total AS INTEGER) END AS total, NOT failed AND n >= total AS complete, CASE WHEN failed THEN 'error' WHEN total <= {-(-_WINDOW // _PAGE) * _PAGE} THEN 'total' ELSE 'window' END AS ended_by FROM e""".replace("-(-total // 5)", "(total + 4) // 5")
)
def paged_report(spark: SparkSession, d: str) -> DataFrame:
    """What each listing gave: pages, results, the total it names, whether that is all, and what ended it."""
    return paged.paged(spark, _exported(spark, d), page=_PAGE, window=_WINDOW, report=True)
