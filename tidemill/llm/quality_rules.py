"""Quality rules by compression bands (operator 5).

zstandard ratios of the whole document and of fixed chunks are compared with
limits that depend on the length: a text that shrinks too far repeats itself, one
that hardly shrinks is noise.  A few counts of the base rules stand beside them.
One pass over the rows, no shuffle; memory grows with the longest text, of which some 30 times its size is held.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: (bytes at least, smallest and largest share that compression may leave); short texts
#: carry the frame's few bytes and little context, so their bands are wide.  Each band
#: holds for whole documents and for chunks of that length.
BANDS = ((0, 0.0, 9.9), (64, 0.40, 9.9), (200, 0.30, 0.98), (1000, 0.25, 0.90), (4000, 0.20, 0.85), (16000, 0.15, 0.80))
CHUNK = 4096
#: Chunks outside their band that a document may have, as a share of its chunks: repetitive ones, noise.
BAD_CHUNKS, NOISE_CHUNKS = 0.5, 0.1
LEVEL = 3
#: (bytes at least, largest share that compression may leave of what it leaves of the same
#: bytes in mixed order, whatever the alphabet; and the share of the text that noise leaves at
#: least).  Noise has no order: hex, base64 and random letters leave 0.989 or more at STRONG.
#: Texts of sf0.1 (samples by length) leave at most 0.956, 0.928 and 0.889 from 1,500, 2,000 and
#: 4,000 bytes on.  Below 1,500 bytes clean text comes as near to 1 as noise, but leaves at most
#: 0.622 (0.592 from 1,000 on) of itself, random letters 0.63 (0.617), hex less than text: hex
#: below 1,500 bytes and all noise below 900 cannot be told from text so.
MIXED = ((900, 0.985, 0.625), (1000, 0.985, 0.605), (1500, 0.973, 0.0), (2000, 0.96, 0.0), (4000, 0.94, 0.0))
#: The level of that comparison, made where LEVEL leaves more than SUSPECT (noise: 0.975 or more).
STRONG, SUSPECT = 19, 0.93

SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_bytes bigint, ratio double, n_chunks bigint, n_low_chunks bigint, n_high_chunks bigint, noise boolean"


def band(n: int, bands: tuple = BANDS) -> tuple[float, float]:
    return next((low, high) for least, low, high in reversed(bands) if n >= least)


def _order(n: int) -> np.ndarray:
    """A fixed order of n bytes; that of a long text is made for it and dropped, 16 bytes for each of its own."""
    return np.argsort(C.spread(np.arange(1, n + 1, dtype=C.U)))


_short_order = lru_cache(64)(_order)


def noisy(piece: bytes, size: int, squeeze: zstandard.ZstdCompressor, strong: zstandard.ZstdCompressor) -> bool:
    """Whether piece, compressed to size by squeeze, shrinks no more than its bytes in mixed order."""
    limit, floor = next(((most, floor) for least, most, floor in reversed(MIXED) if len(piece) >= least), (9.9, 9.9))
    if size <= floor * len(piece):
        return False
    other = np.frombuffer(piece, dtype=np.uint8)[_short_order(len(piece)) if len(piece) <= CHUNK else _order(len(piece))].tobytes()
    return size > SUSPECT * len(squeeze.compress(other)) and len(strong.compress(piece)) > limit * len(strong.compress(other))


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line of the text."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    symbol = np.zeros(256, dtype=bool)
    symbol[list(b"#*$%&|<>")] = True
    leads = C.SPACES & ((np.arange(256) & 0xC0) != 0x80)
    squeeze, strong = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdCompressor(level=STRONG)
    for batch in batches:
        for part in C.chunks(batch):
            raw, at = C.strings(part.column("text"))
            start, end, first = C.word_ranges(raw, at)
            words = C.word_hashes(raw, start, end)
            starts, keys = C.window_hashes(words, first, 8)
            rows = np.repeat(np.arange(len(at) - 1), np.diff(first))
            keys = keys ^ C.spread(rows[starts].astype(C.U) + C.U(1))
            order = np.argsort(keys, kind="stable")
            same = keys[order][1:] == keys[order][:-1]
            twice = np.zeros(len(keys), dtype=bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            again = C.covered(len(words), starts[twice], starts[twice] + 8)
            data, shares = raw.tobytes(), []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                text, low_n, high_n, n = data[a:b], 0, 0, 0
                for i in range(0, len(text), CHUNK):
                    piece = text[i : i + CHUNK]
                    low, high = band(len(piece))
                    size = len(squeeze.compress(piece))
                    share = size / len(piece)
                    n, low_n, high_n = n + 1, low_n + (share < low), high_n + (share > high or noisy(piece, size, squeeze, strong))
                size = len(squeeze.compress(text))
                shares.append((size / len(text) if text else 1.0, n, low_n, high_n, noisy(text, size, squeeze, strong)))
            ratio, n, low_n, high_n, noise = zip(*shares, strict=True)
            lines = [duplicate_lines(x or "") for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), pa.array(np.diff(first)), pa.array(C.sums(leads[raw], at)), pa.array(C.sums(symbol[raw], at)), pa.array(lines, pa.int64()),
                    pa.array(C.sums(again, first)), pa.array(np.diff(at)), pa.array(ratio, pa.float64()), pa.array(n, pa.int64()), pa.array(low_n, pa.int64()), pa.array(high_n, pa.int64()), pa.array(noise, pa.bool_()),
                ],
                names=[x.split()[0] for x in SCHEMA.split(", ")],
            )


def compression_bands(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text) with its counts, ratios and verdict.

    Null and empty texts have no words, so the base rule rejects them; repeated rows
    and equal ids are judged one by one; bands go by the text's bytes; a very long text is
    read in one piece; an empty table gives an empty one; other columns are ignored.
    """
    C.tune(docs.sparkSession)
    measured = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_measure, SCHEMA)
    bytes_band = F.lit(None).cast("string")
    for least, low, high in BANDS:
        verdict = F.when(F.col("ratio") < low, "repetitive").when((F.col("ratio") > high) | F.col("noise"), "incompressible").otherwise("inside")
        bytes_band = verdict if not least else F.when(F.col("n_bytes") >= least, verdict).otherwise(bytes_band)
    chunks_bad = (F.col("n_low_chunks") + F.col("n_high_chunks") > BAD_CHUNKS * F.col("n_chunks")) | (F.col("n_high_chunks") > NOISE_CHUNKS * F.col("n_chunks"))
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        measured.withColumn("band", F.when(chunks_bad & (F.col("n_low_chunks") >= F.col("n_high_chunks")), "repetitive").when(chunks_bad, "incompressible").otherwise(bytes_band))
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("band") == "inside"))
        .drop("noise")
    )


#: DuckDB SQL for the base columns.
BASE_SQL = r"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, array_to_string(w[s : s + 7], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS s FROM doc WHERE len(w) >= 8)),
again AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + 8)) AS p FROM win WHERE k > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM doc) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words, len(w) < 20 OR 100 * coalesce(again.n, 0) > 30 * len(w) AS base_failed
FROM doc LEFT JOIN again USING (doc_id) LEFT JOIN lines USING (doc_id)
"""
