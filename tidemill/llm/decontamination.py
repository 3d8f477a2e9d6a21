"""Benchmark decontamination (operator 2), with DataFrame functions only.

The windows of the test items form a broadcast hash table whose size is checked: up to
BLOCK_WINDOWS windows are one table and one scan.  A larger table is cut into blocks; each
block's scan is a job of its own whose hits are written to the shared folder, so that one
block at a time is broadcast, and the hits are joined with the documents in the end.  A window is entered under the hash of one pair of adjacent words (the
longest pair, which is rarely a common one); every word of a document probes the table
with the pair it starts, and only where a pair is found the whole window is compared,
word by word.  Words stay references into their row from the split to the comparison,
so nothing but the hits and one row per document reaches the only shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW = 10
BLOCK_WINDOWS = 100_000


def windows(items: DataFrame) -> DataFrame:
    """window (words), items (ids, as strings), one row per distinct window of items (item_id, text)."""
    words = items.select(F.col("item_id").cast("string").alias("item"), C.ascii_words(F.col("text").cast("string")).alias("words"))
    n = F.size("words")
    starts = F.when(n >= WINDOW, F.sequence(F.lit(1), n - (WINDOW - 1))).when(n > 0, F.array(F.lit(1)))
    return (
        words.select("item", "words", F.explode(starts).alias("start"))
        .select("item", F.slice("words", F.col("start"), WINDOW).alias("window"))
        .groupBy("window")
        .agg(F.collect_set("item").alias("items"))
    )


def keyed(found: DataFrame) -> DataFrame:
    """Adds to windows the place of the word pair they are entered under, and its hash."""
    n = F.size("window")
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: F.struct((-F.length(F.get("window", i)) - F.coalesce(F.length(F.get("window", i + 1)), F.lit(0))).alias("rank"), i.alias("at")))
    return found.withColumn("at", F.array_min(pairs)["at"]).withColumn("key", pair_key(F.get("window", F.col("at")), F.get("window", F.col("at") + 1))).withColumn("width", n)


def pair_key(word: Column, following: Column) -> Column:
    return F.xxhash64(word, following)


def hits(rows: DataFrame, own: DataFrame, single: bool) -> DataFrame:
    """rows (their columns, words) exploded over the words, with the windows of own (key, at, width, window, items) that stand there: span, items (null for none)."""
    key = pair_key(F.col("word"), F.lit(None).cast("string") if single else F.get("words", F.col("pos") + 1))
    start = F.greatest(F.col("pos") - F.col("at"), F.lit(0))
    found = (F.col("probe") == F.col("key")) & (F.col("pos") >= F.col("at")) & (F.slice("words", start + 1, F.col("width")) == F.col("window"))
    each = rows.select("*", F.posexplode_outer("words").alias("pos", "word")).withColumn("probe", key)
    joined = each.join(F.broadcast(own), found, "left")
    return joined.where(F.col("window").isNotNull() | F.col("pos").isNull() | (F.col("pos") == 0)).withColumn("span", F.when(F.col("window").isNotNull(), F.struct(start.alias("start"), F.col("width"))))


def scan(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, row_key, n_words, spans (start, width in words), items (ids as strings, sorted).

    A span is an occurrence of a window of items (item_id, text).  Null and empty texts have
    no words and no spans, on either side; repeated rows and equal ids are scanned one by one;
    items that repeat a window share its spans; without items nothing is hit; texts of any
    length are scanned whole; empty tables give empty ones; other columns are ignored.
    """
    found = keyed(windows(items)).withColumn("block", F.pmod(F.xxhash64("window"), F.lit(1 << 30)))
    # a window of one word is found by that word alone
    found = C.cut(found.withColumn("single", F.col("width") == 1))
    sizes = {r["single"]: r["n"] for r in found.groupBy("single").agg(F.count("*").alias("n")).collect()}
    columns = ["key", "at", "width", "window", "items"]
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", C.row_key(F.col("doc_id"), text).alias("row_key"), C.ascii_words(text).alias("words")).withColumn("n_words", F.size("words").cast("bigint"))
    spans, of_items = F.array_sort("spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items")
    if len(sizes) <= 1 and sum(sizes.values()) <= BLOCK_WINDOWS:
        numbered = rows.withColumn("row", F.monotonically_increasing_id())
        all_hits = hits(numbered, found.select(*columns), bool(sizes.get(True)))
        return all_hits.groupBy("row", "doc_id").agg(F.max("row_key").alias("row_key"), F.max("n_words").alias("n_words"), F.collect_set("span").alias("spans"), F.collect_set("items").alias("items")).select("doc_id", "row_key", "n_words", spans, of_items)
    parts = None
    for single, size in sorted(sizes.items()):
        n_blocks = -(-size // BLOCK_WINDOWS)
        for block in range(n_blocks):
            own = found.where((F.col("single") == single) & (F.pmod("block", F.lit(n_blocks)) == block)).select(*columns)
            part = C.cut(hits(rows.select("row_key", "words"), own, single).where(F.col("span").isNotNull()).select("row_key", "span", "items"))
            parts = part if parts is None else parts.unionAll(part)
    gathered = parts.groupBy("row_key").agg(F.collect_set("span").alias("spans"), F.collect_set("items").alias("items"))
    none = F.array().cast("array<struct<start:int,width:int>>")
    joined = rows.drop("words").join(gathered, "row_key", "left")
    return joined.select("doc_id", "row_key", "n_words", F.coalesce(F.array_sort("spans"), none).alias("spans"), F.coalesce(F.array_sort(F.array_distinct(F.flatten("items"))), F.array().cast("array<string>")).alias("items"))


def digest(scanned: DataFrame) -> DataFrame:
    """The counts of scan()'s rows."""
    places = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["width"] - 1)))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(F.array_distinct(places)).cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that scan() does not find contaminated: rows go by their id and text, so another text of the same (or no) id stays."""
    return C.without(docs, scan(docs, items).where(F.size("spans") > 0).select(F.col("row_key").alias("key")))


#: DuckDB SQL for the digest.
DIGEST_SQL = r"""
WITH item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT item_id, array_to_string(w[s : s + 9], ' ') AS k, least(len(w), 10) AS width
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, least(len(w), 1)) + 1)) AS s FROM item)),
doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
placed AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM doc),
hit AS (SELECT DISTINCT doc_id, s, width, item_id FROM (
          SELECT doc_id, s, d.width, array_to_string(w[s : s + d.width - 1], ' ') AS k FROM placed, (SELECT DISTINCT width FROM win) d WHERE s + d.width - 1 <= len(w)) JOIN win USING (k, width)),
place AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + width)) AS p FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN place USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
