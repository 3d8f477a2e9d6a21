"""Helpers that the operators of this subpackage share.

The numpy part works on whole Arrow string columns: the text bytes of a few
hundred documents lie end to end in one array, words are byte ranges found with
a 256-entry table, and 64-bit hashes of words and of word windows take in eight bytes,
or one word, at a step for all words at once.  Only words of more than LONG_WORD bytes
are visited one by one.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The byte classes of the contracts' word patterns.
SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"
ASCII_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Bytes of text that one numpy step handles; its temporaries take about 100 times as much.
CHUNK_BYTES = 1 << 20

U = np.uint64
MASK = (1 << 64) - 1
GOLDEN = 0x9E3779B97F4A7C15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, so that a batch of long texts fits a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, which the cluster (or the test's session) names.

    A session of one process (master local, as in tests) that names none gets a temporary folder; on a
    cluster it is an error to name none, for its executors' disks differ.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = f"file://{tempfile.gettempdir()}/tidemill-checkpoints"
        spark.conf.set("spark.checkpoint.dir", where)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Ids that are sent to all executors at once; more are joined by a shuffle.
BROADCAST_IDS = 500_000


def row_key(doc_id: Column, text: Column) -> Column:
    """What tells rows apart: the id and the text (128 bits of it); rows that repeat both are the same."""
    return F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("-")), F.coalesce(text.cast("string"), F.lit("")).cast("string")).cast("binary"))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text and others) whose row_key() is not among gone (one column, key); all columns stay."""
    key = fresh(docs.columns, "row_key")[0]
    left = cut(gone.select(F.col("key").alias(key)).distinct())
    side = F.broadcast(left) if left.count() <= BROADCAST_IDS else left
    return docs.withColumn(key, row_key(F.col("doc_id"), F.col("text"))).join(side, key, "left_anti").drop(key)


def crc_mod(column: Column, modulus: int) -> Column:
    """crc32(column as text) mod modulus; null for null."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(modulus))


def crc_sql(column: str, modulus: int) -> str:
    """crc_mod() in DuckDB SQL, for columns whose text is ASCII."""
    bits = "list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    text = f"list_transform(string_split(CAST({column} AS VARCHAR), ''), lambda s: CAST(ord(s) AS BIGINT))"
    return f"(xor(list_reduce(list_concat([4294967295], {text}), lambda c, b: {bits}), 4294967295) % {modulus})"


def lower_az(text: Column) -> Column:
    """Lower-cases A-Z only.  Texts of ASCII alone take the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def split_words(lower: Column) -> Column:
    """The words of a lower-cased text: what stands between gaps, less an empty first or last part."""
    return F.array_remove(F.split(lower, ASCII_GAP), "")


def ascii_words(text: Column) -> Column:
    """Words of the contracts that lower-case A-Z; null has none."""
    return split_words(lower_az(F.coalesce(text, F.lit(""))))


# --- numpy over Arrow string columns -------------------------------------------------------


def spread(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that brings every input bit to every output bit."""
    h = h ^ (h >> U(32))
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


def mix(h: np.ndarray, value: np.ndarray) -> np.ndarray:
    """h with one more value taken in; for a given h a bijection of value, and the order of values counts."""
    h = (h ^ value) * U(0x9E3779B97F4A7C15)
    h ^= h >> U(29)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(32)
    return h


def spans_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 1) -> np.ndarray:
    """A hash of values[start:end] for each pair; equal ranges have equal hashes.  As many steps as the longest range."""
    size = end - start
    h = spread(size.astype(U) + U(seed * GOLDEN & MASK))
    for j in range(int(size.max()) if len(size) else 0):
        own = np.flatnonzero(size > j)
        if len(own) == len(h):
            h = mix(h, values[start + j])
        else:
            h[own] = mix(h[own], values[start[own] + j])
    return spread(h)


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and where each row starts; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of batch with about limit bytes of text, each of one row at least."""
    if not batch.num_rows:
        return
    at = strings(batch.column(text))[1]
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1)
        yield batch.slice(row, end - row)
        row = end


SPACES = np.ones(256, dtype=bool)
SPACES[list(SPACE_BYTES)] = False
ASCII_WORDS = np.zeros(256, dtype=bool)
ASCII_WORDS[0x30:0x3A] = ASCII_WORDS[0x61:0x7B] = ASCII_WORDS[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def word_ranges(raw: np.ndarray, at: np.ndarray, is_word: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last+1 byte of each word, and where each row's words start."""
    if not len(raw):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(at), dtype=np.int64)
    inside = is_word[raw]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    before[at[:-1][at[:-1] < len(raw)]] = False
    after[at[1:][at[1:] > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, at)


#: Words of more bytes are hashed one by one.
LONG_WORD = 64
_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each word's bytes; another seed gives an independent one.  Eight bytes are taken at a time."""
    size = end - start
    h = spread(size.astype(U) + U((seed + 77) * GOLDEN & MASK))
    if not len(size):
        return h
    padded = np.concatenate([raw, np.zeros(8, dtype=np.uint8)])
    lanes = np.ndarray((len(raw),), "<u8", padded, 0, (1,))
    short = size <= LONG_WORD
    own = np.flatnonzero(short)
    for j in range(0, LONG_WORD, 8):
        if j:
            own = own[size[own] > j]
        if not len(own):
            break
        lane = lanes[start[own] + j] & _LOW_BYTES[np.minimum(size[own] - j, 8)]
        h[own] = mix(h[own], lane)
    for i in np.flatnonzero(~short).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]].tobytes(), digest_size=8, key=seed.to_bytes(8, "little")).digest(), "little")
    return spread(h)


def window_hashes(words: np.ndarray, first: np.ndarray, k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Start (index of word) and hash of each window of k words inside one row."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U)
    last = np.repeat(first[1:], np.diff(first))[:n]  # where the row of each word ends
    starts = np.flatnonzero(np.arange(n) + k <= last)
    h = np.full(n, U((seed * 31 + k) * GOLDEN & MASK), dtype=U)
    for j in range(k):
        h = mix(h, words[j : n + j])
    return starts, spread(h[starts])


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each lengthened until no column has it (whatever its case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of values[at[i]:at[i+1]] for each row i."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie in any of the ranges."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step[:-1]) > 0
