"""Language identification by prediction by partial matching (operator 1).

One byte context tree per language, orders 0 to 4, is counted by Spark over a
bounded sample of labelled rows and then frozen.  The code length of a text under
a language is exact: each byte is coded in the longest known context, an escape
(method C: distinct successors / (occurrences + distinct successors)) is paid for
each context that lacks the byte, and order -1 codes a byte in 8 bits.  The text's
language is the one with the shortest code.

Scoring is one pass without a shuffle.  A byte's code length depends on itself and
the four bytes before it, so a worker keeps the lengths of the five-byte strings it
has met in a fixed-size table and adds table entries up; strings that the table
lacks are looked up in the trees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

ORDER = 4
#: The training sample: so many labelled rows per language on average (by a hash of doc_id), of
#: texts of at most SAMPLE_BYTES, and no more than SAMPLE_TOTAL bytes for all languages together,
#: whatever their number.  This bounds the counts that the driver gathers and every worker receives.
SAMPLE_ROWS = 1500
SAMPLE_BYTES = 16_384
SAMPLE_TOTAL = 24 << 20
#: A text whose best code still takes more bits per byte is no text of a learned language.
MAX_BITS = 7.5
UNKNOWN = "und"

SLOTS = 20
CODE = np.uint64((1 << (8 * (ORDER + 1))) - 1)
COUNTS = "lang string, width int, gram bigint, n bigint"
SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double, bits_per_byte double"


def codes(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each byte with the four before it as one number; a row starts after spaces."""
    raw = C.LOWER[raw]
    rows = np.repeat(np.arange(1, len(at)), np.diff(at))
    place = np.arange(len(raw)) + ORDER * rows
    padded = np.full(len(raw) + ORDER * len(at), 0x20, dtype=np.uint8)
    padded[place] = raw
    out = np.zeros(len(raw), dtype=C.U)
    for back in range(ORDER, -1, -1):
        out = (out << C.U(8)) | padded[place - back]
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        raw, at = C.strings(batch.column("text"))
        code, of = codes(raw, at), np.repeat(langs, np.diff(at))
        for lang in sorted(set(langs)):
            own = code[of == lang]
            for width in range(1, ORDER + 2):
                gram, n = np.unique(own & C.U((1 << (8 * width)) - 1), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(np.full(len(gram), width, np.int32)), pa.array(gram.astype(np.int64)), pa.array(n)], names=["lang", "width", "gram", "n"])


class Tree:
    """The frozen statistics of one language: counts of byte strings and of contexts by width."""

    def __init__(self, width: np.ndarray, gram: np.ndarray, n: np.ndarray) -> None:
        self.levels = []
        for w in range(ORDER + 1, 0, -1):
            order = np.argsort(gram[width == w])
            keys, counts = gram[width == w][order].astype(C.U), n[width == w][order].astype(np.float64)
            contexts, first = np.unique(keys >> C.U(8), return_index=True)
            edges = np.append(first, len(keys))
            total = np.add.reduceat(counts, first) if len(keys) else counts
            self.levels.append((w, keys, counts, contexts, total, np.diff(edges).astype(np.float64)))

    def bits(self, code: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each five-byte string after the four others."""
        out, left = np.zeros(len(code)), np.arange(len(code))
        for w, keys, counts, contexts, total, distinct in self.levels:
            if not len(keys):
                continue
            own = code[left] & C.U((1 << (8 * w)) - 1)
            i = np.minimum(np.searchsorted(contexts, own >> C.U(8)), len(contexts) - 1)
            met = contexts[i] == own >> C.U(8)
            k = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            coded = keys[k] == own
            mass = total[i] + distinct[i]
            out[left] += np.where(coded, np.log2(mass / counts[k]), np.where(met, np.log2(mass / distinct[i]), 0.0))
            left = left[~coded]
        out[left] += 8.0
        return out


class Scorer:
    def __init__(self, langs: list[str], trees: list[Tree]) -> None:
        self.langs, self.trees = langs, trees
        self.keys = np.full(1 << SLOTS, C.MASK, dtype=C.U)
        self.bits = np.zeros((len(langs), 1 << SLOTS), dtype=np.float32)

    def lengths(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Code length in bits of each row (column) under each language (row)."""
        code, out = codes(raw, at), np.zeros((len(self.langs), len(at) - 1))
        slot = ((code * C.U(0x9E3779B97F4A7C15)) >> C.U(64 - SLOTS)).astype(np.int64)
        miss = np.flatnonzero(self.keys[slot] != code)
        missing, back = np.unique(code[miss], return_inverse=True)
        own = np.array([t.bits(missing) for t in self.trees], dtype=np.float32)
        full = np.flatnonzero(np.diff(at))
        for k in range(len(self.langs)):
            bits = self.bits[k][slot]
            bits[miss] = own[k][back]
            if len(full):
                out[k, full] = np.add.reduceat(bits, at[:-1][full], dtype=np.float64)
        # only now: a new string may take the slot of one that was just looked up
        where, pick = np.unique(slot[miss], return_index=True)
        self.keys[where], self.bits[:, where] = code[miss][pick], own[:, back[pick]]
        return out


def train(labelled: DataFrame) -> tuple[list[str], DataFrame]:
    """The languages, and counts (lang, width, gram, n) of the sampled rows of labelled (doc_id, text, lang)."""
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    fits = F.octet_length("text") <= SAMPLE_BYTES
    rows = {r["lang"]: (r["n"], r["bytes"] or 0) for r in known.groupBy("lang").agg(F.count_if(fits).alias("n"), F.sum(F.when(fits, F.octet_length("text"))).alias("bytes")).collect()}  # a row per language
    if not rows:
        return [], known.sparkSession.createDataFrame([], COUNTS)
    each = SAMPLE_TOTAL / len(rows)
    share = F.create_map(*[F.lit(x) for lang, (n, size) in rows.items() for x in (lang, min(1.0, SAMPLE_ROWS / max(n, 1), each / max(size, 1)))])
    lot = F.pmod(F.xxhash64(F.lit("language id"), F.col("doc_id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = known.where((F.octet_length("text") <= SAMPLE_BYTES) & (lot < F.element_at(share, F.col("lang"))))
    counts = sample.select("lang", "text").mapInArrow(_count, COUNTS).groupBy("lang", "width", "gram").agg(F.sum("n").alias("n"))
    return sorted(rows), counts


def trained(labelled: DataFrame) -> tuple[list[str], list[Tree]]:
    langs, counts = train(labelled.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")))
    if not langs:
        return [], []
    learned = counts.toArrow()  # the distinct strings of SAMPLE_TOTAL bytes of text
    of, trees = np.array(learned.column("lang").to_pylist(), dtype=object), []
    columns = [learned.column(c).to_numpy() for c in ("width", "gram", "n")]
    for lang in langs:
        own = of == lang
        trees.append(Tree(*[c[own] for c in columns]))
    return langs, trees


def judge(scorer: Scorer, part: pa.RecordBatch) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and bits per byte of each row of part (text, has_letter)."""
    raw, at = C.strings(part.column("text"))
    size, letters = np.diff(at), np.array(part.column("has_letter").to_pylist(), dtype=bool)
    if not scorer.langs:
        return [UNKNOWN] * len(size), np.zeros(len(size)), np.zeros(len(size))
    length = scorer.lengths(raw, at)
    best = length.argmin(axis=0)
    share = 1.0 / np.exp2(np.maximum(length.min(axis=0) - length, -1000.0)).sum(axis=0)
    names = [scorer.langs[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)]
    return names, np.where(letters, share, 0.0), length.min(axis=0) / np.maximum(size, 1)


def has_letter() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte for each row of docs (doc_id, text).

    labelled (doc_id, text, lang) is the learning table.  score is the share of the best
    language in the sum of 2**-length over all languages; equal lengths go to the first
    name.  Null, empty and letterless texts, and every text when nothing could be learned,
    get ``und`` with score 0.  Repeated rows and ids are scored one by one; a very long text is
    scored whole, in one piece; an empty table gives an empty one; other columns are ignored.
    """
    spark = docs.sparkSession
    C.tune(spark)
    model = spark.sparkContext.broadcast(trained(labelled))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model.value)
        for batch in batches:
            for part in C.chunks(batch):
                names, share, bits = judge(scorer, part)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(share), pa.array(bits)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    held_out = F.coalesce(C.crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out, F.col("text").cast("string").alias("text"))
    return rows.withColumn("has_letter", has_letter()).mapInArrow(score, SCHEMA)


def keep_known(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose text is in a learned language: not ``und``, and coded in MAX_BITS a byte or less."""
    spark = docs.sparkSession
    C.tune(spark)
    model = spark.sparkContext.broadcast(trained(labelled))
    flag = C.fresh(docs.columns, "has_letter")[0]
    schema = docs.schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model.value)
        for batch in batches:
            for part in C.chunks(batch):
                own = pa.RecordBatch.from_arrays([part.column("text"), part.column(flag)], names=["text", "has_letter"])
                names, _, bits = judge(scorer, own)
                yield part.filter(pa.array([n != UNKNOWN and b <= MAX_BITS for n, b in zip(names, bits.tolist(), strict=True)], pa.bool_())).select(schema.names)

    return docs.withColumn(flag, has_letter()).mapInArrow(keep, schema)


def learning_rows(docs: DataFrame) -> DataFrame:
    """The rows that op1 may learn from."""
    return docs.where(F.coalesce(C.crc_mod(F.col("doc_id"), 4) != 2, F.lit(True)))


#: DuckDB SQL for the columns that do not come from the model.
BASE_SQL = rf"""
SELECT doc_id, coalesce({C.crc_sql('doc_id', 4)} = 2, false) AS held_out, NOT coalesce(regexp_matches(text, '\p{{L}}'), false) AS undetermined FROM documents
"""
