"""Readers' mapping halves: nested answers of job boards and feeds to one posting schema."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

POSTING = ("source", "source_job_id", "title", "company", "location", "contract", "description", "url", "published_at")
#: The nested schemas that the readers expect; never inferred.
SCHEMAS = {
    "search": "resultats ARRAY<STRUCT<id STRING, intitule STRING, description STRING, dateCreation STRING, lieuTravail STRUCT<libelle STRING>, entreprise STRUCT<nom STRING>, typeContrat STRING, origineOffre STRUCT<urlOrigine STRING>>>",
    "region": "totalCount INT, jobs ARRAY<STRUCT<id STRING, title STRING, company STRING, location STRING, snippet STRING, type STRING, link STRING, updated STRING>>",
    "keyword": "count INT, results ARRAY<STRUCT<id STRING, title STRING, company STRUCT<display_name STRING>, location STRUCT<display_name STRING>, description STRING, contract_type STRING, redirect_url STRING, created STRING>>",
    "html_board": "jobs ARRAY<STRUCT<id BIGINT, title STRING, absolute_url STRING, location STRUCT<name STRING>, first_published STRING, updated_at STRING, content STRING>>",
    "multi_board": "postings ARRAY<STRUCT<id STRING, text STRING, hostedUrl STRING, categories STRUCT<commitment STRING, location STRING, allLocations ARRAY<STRING>>, createdAt BIGINT, descriptionPlain STRING>>",
    "listed_board": "jobs ARRAY<STRUCT<id STRING, title STRING, jobUrl STRING, location STRING, isListed BOOLEAN, isRemote BOOLEAN, employmentType STRING, publishedAt STRING, descriptionPlain STRING, descriptionHtml STRING, address STRUCT<postalAddress STRUCT<addressLocality STRING, addressCountry STRING>>, secondaryLocations ARRAY<STRUCT<location STRING>>>>",
    "detail_board": "jobPostings ARRAY<STRUCT<externalPath STRING, title STRING, locationsText STRING, postedOn STRING, detail STRUCT<title STRING, externalUrl STRING, location STRING, additionalLocations ARRAY<STRING>, country STRUCT<descriptor STRING>, startDate STRING, jobDescription STRING>>>",
    "paged_board": "totalFound INT, content ARRAY<STRUCT<id STRING, name STRING, releasedDate STRING, company STRUCT<identifier STRING>, location STRUCT<fullLocation STRING, city STRING, country STRING>, typeOfEmployment STRUCT<id STRING>, postingUrl STRING, sections ARRAY<STRING>>>",
    "feed": "link STRING, title STRING, description STRING, pubDate STRING",
}
#: Contract codes of the search source.
CONTRACT_CODES = {"CDI": "CDI", "CDD": "CDD", "MIS": "INTERIM", "SAI": "CDD", "ALT": "ALTERNANCE", "PRO": "ALTERNANCE", "FRA": "FREELANCE", "LIB": "FREELANCE"}


def when_said(text: Column) -> Column:
    """An ISO or RFC 822 date as UTC timestamp; a date without zone is UTC; null if it can't be read."""
    plain = F.regexp_replace(text, r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss z")))


def distinct_places(places: Column) -> Column:
    """Places without repeats whatever their case, in order, joined by commas."""
    seen = F.aggregate(places, F.array().cast("array<string>"), lambda out, p: F.when(F.exists(out, lambda x: F.lower(x) == F.lower(p)) | (F.trim(p) == ""), out).otherwise(F.concat(out, F.array(p))))
    return F.array_join(seen, ", ")


def _post(source: str, **columns: Column) -> list[Column]:
    return [F.lit(source).alias("source"), *[columns[c].alias(c) if c in columns else F.lit(None).cast("string").alias(c) for c in POSTING[1:]]]


def search(answers: DataFrame) -> DataFrame:
    r = answers.select(F.explode("resultats").alias("r"))
    codes = F.create_map(*[F.lit(x) for kv in CONTRACT_CODES.items() for x in kv])
    return r.select(*_post("search", source_job_id=F.col("r.id"), title=F.col("r.intitule"), company=F.col("r.entreprise.nom"), location=F.col("r.lieuTravail.libelle"), contract=F.coalesce(F.element_at(codes, F.col("r.typeContrat")), F.lit("UNKNOWN")), description=F.col("r.description"), url=F.col("r.origineOffre.urlOrigine"), published_at=when_said(F.col("r.dateCreation"))))


def region(answers: DataFrame) -> DataFrame:
    r = answers.select(F.explode("jobs").alias("r")).where(F.col("r.id").isNotNull())
    return r.select(*_post("region", source_job_id=F.col("r.id"), title=F.col("r.title"), company=F.col("r.company"), location=F.col("r.location"), contract=T.contract_type(F.col("r.type"), F.col("r.title")), description=T.html_text(F.col("r.snippet")), url=F.col("r.link"), published_at=when_said(F.col("r.updated"))))


def keyword(answers: DataFrame) -> DataFrame:
    r = answers.select(F.explode("results").alias("r")).where(F.col("r.id").isNotNull())
    return r.select(*_post("keyword", source_job_id=F.col("r.id"), title=F.col("r.title"), company=F.col("r.company.display_name"), location=F.col("r.location.display_name"), contract=T.contract_type(F.col("r.contract_type"), F.col("r.title")), description=F.col("r.description"), url=F.col("r.redirect_url"), published_at=when_said(F.col("r.created"))))


def html_board(answers: DataFrame, company: str) -> DataFrame:
    r = answers.select(F.explode("jobs").alias("r"))
    content = T.html_text(F.replace(F.replace(F.replace(F.col("r.content"), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&")))
    return r.select(*_post("html_board", source_job_id=F.col("r.id").cast("string"), title=F.col("r.title"), company=F.lit(company), location=F.col("r.location.name"), contract=T.contract_type(F.col("r.title")), description=content, url=F.col("r.absolute_url"), published_at=when_said(F.coalesce("r.first_published", "r.updated_at"))))


def multi_board(answers: DataFrame, company: str) -> DataFrame:
    r = answers.select(F.explode("postings").alias("r"))
    places = F.concat(F.array(F.coalesce("r.categories.location", F.lit(""))), F.coalesce("r.categories.allLocations", F.array().cast("array<string>")))
    return r.select(*_post("multi_board", source_job_id=F.col("r.id"), title=F.col("r.text"), company=F.lit(company), location=distinct_places(places), contract=T.contract_type(F.col("r.categories.commitment"), F.col("r.text")), description=F.col("r.descriptionPlain"), url=F.col("r.hostedUrl"), published_at=F.timestamp_millis("r.createdAt")))


def listed_board(answers: DataFrame, company: str) -> DataFrame:
    """Boards that mark unlisted posts, which are left out; the address adds a place that the location does not name."""
    r = answers.select(F.explode("jobs").alias("r")).where(F.coalesce("r.isListed", F.lit(True)))
    address = F.array("r.address.postalAddress.addressLocality", "r.address.postalAddress.addressCountry")
    new = F.filter(address, lambda p: p.isNotNull() & ~F.contains(F.lower(F.coalesce("r.location", F.lit(""))), F.lower(p)))
    more = F.transform(F.coalesce("r.secondaryLocations", F.array().cast("array<struct<location:string>>")), lambda x: x["location"])
    places = F.filter(F.concat(F.array(F.coalesce("r.location", F.lit(""))), new, more), lambda p: p.isNotNull())
    text = F.coalesce("r.descriptionPlain", T.html_text(F.col("r.descriptionHtml")))
    return r.select(*_post("listed_board", source_job_id=F.col("r.id"), title=F.col("r.title"), company=F.lit(company), location=distinct_places(places), contract=T.contract_type(F.col("r.employmentType"), F.col("r.title")), description=text, url=F.col("r.jobUrl"), published_at=when_said(F.col("r.publishedAt"))))


def posted_days(posted_on: Column) -> Column:
    """How many days ago a board says a post was made; 31 for ``30+``, 15 where it cannot be read."""
    days, more = F.regexp_extract(posted_on, r"(?i)(\d+)\s*(\+)?\s*day", 1), F.regexp_extract(posted_on, r"(?i)(\d+)\s*(\+)?\s*day", 2)
    low = F.lower(posted_on)
    return F.when(F.contains(low, F.lit("today")), 0).when(F.contains(low, F.lit("yesterday")), 1).when(days != "", days.cast("int") + F.when(more == "+", 1).otherwise(0)).otherwise(15)


def posting_id(path: Column) -> Column:
    """The requisition id that ends the path of a post."""
    tail = F.regexp_extract(F.regexp_replace(path, "/+$", ""), "([^/]*)$", 1)
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(F.regexp_extract(tail, "([^_]*)$", 1), r"[^A-Za-z0-9.-]", ""), 1, 100), F.lit("")), F.lit("unknown"))


def freshest(pages: DataFrame, cap: int) -> DataFrame:
    """The posts of listings (board, keyword, postings), the first of each id, those posted last first, at most cap per board."""
    each = pages.select("board", "keyword", F.posexplode("jobPostings").alias("place", "r")).withColumn("id", posting_id(F.col("r.externalPath")))
    first = each.groupBy("board", "id").agg(F.min_by(F.struct("r", "keyword"), F.struct("keyword", "place")).alias("m")).select("board", "id", "m.*").withColumn("days", posted_days(F.col("r.postedOn")))
    order = Window.partitionBy("board").orderBy("days", "id")
    return first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap).select("board", "id", "days", "keyword", "place", "r")


def detail_board(rows: DataFrame, company: str) -> DataFrame:
    """freshest()'s posts with their details; the country is added where no place names it."""
    info = F.col("r.detail")
    places = F.concat(F.array(F.coalesce(info["location"], F.col("r.locationsText"), F.lit(""))), F.coalesce(info["additionalLocations"], F.array().cast("array<string>")))
    country = F.coalesce(info["country"]["descriptor"], F.lit(""))
    named = F.exists(places, lambda p: F.contains(F.lower(p), F.lower(country)))
    where = distinct_places(F.when((country == "") | named, places).otherwise(F.concat(places, F.array(country))))
    return rows.select(*_post("detail_board", source_job_id=F.col("id"), title=F.coalesce(info["title"], F.col("r.title")), company=F.lit(company), location=where, contract=T.contract_type(F.coalesce(info["title"], F.col("r.title"))), description=T.html_text(info["jobDescription"]), url=info["externalUrl"], published_at=when_said(info["startDate"])))


def paged(pages: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """The posts of paged answers (board, offset, totalFound, content), cap per board at most, and per board whether the listing is complete."""
    each = pages.select("board", "totalFound", "offset", F.posexplode("content").alias("i", "r")).withColumn("place", F.col("offset") + F.col("i"))
    kept = each.groupBy("board", F.col("r.id").alias("id")).agg(F.min_by(F.struct("r", "place"), "place").alias("m")).select("board", "id", "m.*").where(F.col("place") < cap)
    totals = pages.groupBy("board").agg(F.max("totalFound").alias("total")).join(kept.groupBy("board").agg(F.count("*").alias("got")), "board", "left")
    return kept, totals.select("board", F.coalesce("got", F.lit(0)).alias("got"), (F.coalesce("got", F.lit(0)) >= F.coalesce("total", F.lit(0))).alias("complete"))


def paged_board(rows: DataFrame) -> DataFrame:
    loc = F.col("r.location")
    where = F.coalesce(loc["fullLocation"], F.concat_ws(", ", loc["city"], loc["country"]))
    url = F.coalesce("r.postingUrl", F.concat(F.lit("https://jobs.smartrecruiters.com/"), "r.company.identifier", F.lit("/"), "r.id"))
    text = F.array_join(F.filter(F.transform("r.sections", T.html_text), lambda x: x != ""), "\n")
    return rows.select(*_post("paged_board", source_job_id=F.col("r.id"), title=F.col("r.name"), company=F.col("r.company.identifier"), location=where, contract=T.contract_type(F.replace(F.coalesce("r.typeOfEmployment.id", F.lit("")), F.lit("_"), F.lit(" "))), description=text, url=url, published_at=when_said(F.col("r.releasedDate"))))


FEED_BOARD = "link STRING, title STRING, description STRING, pubDate STRING, category ARRAY<STRING>"


def feed_board(items: DataFrame, company: str) -> DataFrame:
    """Board feeds: the id stands in the link's query; of three categories the second is the contract, the third the site; others tell nothing."""
    ident = F.coalesce(*[F.nullif(F.regexp_extract("link", rf"[?&]{k}=([^&#]+)", 1), F.lit("")) for k in ("idOffre", "idoffre", "offerReference")])
    three = F.size("category") == 3
    kept = items.withColumn("id", F.regexp_replace(ident, r"[^A-Za-z0-9._-]", "")).where("id IS NOT NULL")
    return kept.select(*_post("feed_board", source_job_id=F.col("id"), title=F.trim("title"), company=F.lit(company), location=F.when(three, F.trim(F.get("category", 2))).otherwise(""), contract=T.contract_type(F.when(three, F.get("category", 1)), F.col("title")), description=T.html_text(F.col("description")), url=F.col("link"), published_at=when_said(F.col("pubDate"))))


def rss(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The items of RSS files, by Spark's XML reader."""
    return spark.read.format("xml").schema(schema).option("rowTag", "item").load(path)


#: Links of public boards, up to the board's identifier; words in its place that are none; platforms without a public board, by parts of their links.
BOARD_LINKS = {
    "smartrecruiters": ["jobs.smartrecruiters.com/", "careers.smartrecruiters.com/", "api.smartrecruiters.com/v1/companies/"],
    "greenhouse": ["boards.greenhouse.io/", "job-boards.greenhouse.io/", "boards.greenhouse.io/embed/job_board?for=", "boards.greenhouse.io/embed/job_board/js?for=", "job-boards.greenhouse.io/embed/job_board?for=", "job-boards.greenhouse.io/embed/job_board/js?for=", "boards-api.greenhouse.io/v1/boards/"],
    "lever": ["jobs.lever.co/", "api.lever.co/v0/postings/"],
    "ashby": ["jobs.ashbyhq.com/", "api.ashbyhq.com/posting-api/job-board/"],
}
NO_IDS = ["embed", "api", "v0", "v1", "js", "static", "assets", "jobs", "job", "share", "careers", "en", "fr", "en-us", "fr-fr", "search", "apply", "widget"]
PLATFORMS = {
    "taleo": [".taleo.net"], "successfactors": ["successfactors.com", "successfactors.eu", "jobs.sap.com", "career.sapsf"], "talentsoft": ["talent-soft.com", "talentsoft.com", "talentsoft.net"], "oracle_hcm": ["oraclecloud.com/hcmui/candidateexperience"],
    "icims": [".icims.com"], "teamtailor": [".teamtailor.com"], "welcometothejungle": ["welcometothejungle.com"], "workable": ["apply.workable.com"], "recruitee": [".recruitee.com"], "jobvite": ["jobs.jobvite.com"], "cornerstone": [".csod.com"],
    "avature": [".avature.net"], "phenom": ["phenompeople.com", "cdn.phenompeople"], "eightfold": [".eightfold.ai"], "digitalrecruiters": ["digitalrecruiters.com"], "jobs_net": [".jobs.net"], "njoyn": [".njoyn.com"], "beetween": ["beetween.com"],
    "flatchr": ["flatchr.io"], "jobaffinity": ["jobaffinity.fr"],
}
_NAME = "[A-Za-z0-9][A-Za-z0-9._-]*"


def _workday(page: Column) -> Column:
    """The Workday boards that a page links to, as host/tenant/site; a language before the site is skipped, and is no site."""
    links = F.regexp_extract_all(page, F.lit(r"(?i)https?://((?:[a-z0-9-]+\.wd\d+\.myworkdayjobs|wd\d+\.myworkdaysite)\.com/[A-Za-z0-9._/-]+)"), F.lit(1))

    def read(link: Column) -> Column:
        parts = F.filter(F.split(link, "/"), lambda x: x != "")
        host = F.lower(F.get(parts, 0))
        steps = F.filter(F.slice(parts, 2, 100), lambda x: ~x.rlike("(?i)^[a-z]{2}([-_][a-z]{2})?$"))
        own = F.contains(host, F.lit("myworkdayjobs"))
        tenant = F.when(own, F.substring_index(host, ".", 1)).when(F.lower(F.get(steps, 0)) == "recruiting", F.lower(F.get(steps, 1)))
        return F.concat_ws("/", host, tenant, F.when(own, F.get(steps, 0)).otherwise(F.get(steps, 2)))

    return F.filter(F.transform(links, read), lambda x: F.size(F.split(x, "/")) == 3)


def detected(page: Column) -> Column:
    """struct(status, board, identifier, platform) of a company's page or link: the first public board by kind, else a known platform, else nothing."""

    def of(links: list[str]) -> Column:
        # longer links first, so that what follows a short one is not taken for an identifier
        named = F.regexp_extract_all(page, F.lit(f"(?i)(?:{'|'.join(re.escape(x) for x in sorted(links, key=len, reverse=True))})({_NAME})"), F.lit(1))
        return F.filter(F.transform(named, lambda x: F.regexp_replace(x, "[.]+$", "")), lambda x: ~F.lower(x).isin(NO_IDS))

    found = {"workday": _workday(page)} | {kind: of(links) for kind, links in BOARD_LINKS.items()}
    first = F.coalesce(*[F.when(F.size(f) > 0, F.struct(F.lit(kind).alias("board"), F.get(f, 0).alias("identifier"))) for kind, f in found.items()])
    platform = F.coalesce(*[F.when(F.lower(page).rlike("|".join(re.escape(x) for x in parts)), name) for name, parts in PLATFORMS.items()])
    return T.let(first, lambda b: F.struct(F.when(b.isNotNull(), "verified").when(platform.isNotNull(), "custom").otherwise("not_found").alias("status"), b["board"].alias("board"), b["identifier"].alias("identifier"), F.when(b.isNull(), platform).alias("platform")))


def export_rows(text: DataFrame, row: str) -> DataFrame:
    """The rows (by the schema row) of JSON exports (path, value): a list of one result object that succeeded; other files are rejected as a whole, with their path kept."""
    whole = text.withColumn("answer", F.from_json("value", f"array<struct<success:boolean,results:array<struct<{row}>>>>"))
    ok = (F.size("answer") == 1) & F.coalesce(F.get("answer", 0)["success"], F.lit(False)) & F.get("answer", 0)["results"].isNotNull()
    return whole.select("path", F.coalesce(ok, F.lit(False)).alias("accepted"), F.explode_outer(F.when(ok, F.get("answer", 0)["results"])).alias("row"))


def enabled(sources: dict[str, Callable[[], DataFrame]], wanted: list[str], needs: dict[str, list[str]], have: dict[str, str]) -> tuple[list[DataFrame], list[str]]:
    """The tables of the wanted sources whose settings are all there, in order, and the names of those left out."""
    ready = [n for n in wanted if n in sources and all(have.get(k) for k in needs.get(n, []))]
    return [sources[n]() for n in ready], [n for n in wanted if n not in ready]


def feed(items: DataFrame, since: Column | None = None) -> DataFrame:
    """RSS items with a link, none from before since; the first of each normalised link stays."""
    kept = items.where(F.coalesce(F.trim("link"), F.lit("")) != "").withColumn("url", T.article_url(F.trim("link")))
    if since is not None:
        kept = kept.where(F.coalesce(when_said(F.col("pubDate")) >= since, F.lit(True)))
    first = kept.groupBy("url").agg(F.min(F.struct(F.coalesce(when_said(F.col("pubDate")), F.lit("9999-01-01").cast("timestamp")).alias("at"), "title", "description")).alias("m"))
    return first.select("url", F.col("m.title").alias("title"), F.when(F.col("m.at") < "9999-01-01", F.col("m.at")).alias("published_at"), T.excerpt(T.html_text(F.col("m.description")), 300).alias("extract"))


def union_of(*postings: DataFrame) -> DataFrame:
    """All sources in one table; a posting that two sources name by the same key comes from the first."""
    out = None
    for k, p in enumerate(postings):
        p = p.withColumn("_order", F.lit(k))
        out = p if out is None else out.unionByName(p)
    return out.groupBy("source", "source_job_id").agg(F.min_by(F.struct(*POSTING[2:]), "_order").alias("p")).select("source", "source_job_id", "p.*")


def unknown_only(postings: DataFrame, stored: DataFrame, since: Column | None = None, titles: Column | None = None) -> DataFrame:
    """The postings that are not stored yet; those older than since, or whose title fails the test titles, are left out before."""
    if since is not None:
        postings = postings.where(F.coalesce(F.col("published_at") >= since, F.lit(True)))
    if titles is not None:
        postings = postings.where(titles)
    return postings.join(stored.select("source", "source_job_id").distinct(), ["source", "source_job_id"], "left_anti")
