"""Substring deduplication by recompression (operator 9).

Every text is recompressed in rounds: maximal runs of one symbol get a name, then a hash bit
deals the symbols into left and right ones and every left-right pair of neighbours gets a
name.  A name depends on nothing but what it stands for, so equal substrings have equal
interior symbols in the whole corpus.  Spark then finds which names are shared, from the
high levels down, in three rounds over the same blocks of documents:

1.  Symbols of the levels HIGH stand for some 40, 180 and 750 words.  Where such a symbol
    occurs in a document with a smaller doc_id too, all windows inside of it are repeats:
    shared high-level symbols settle copies, near copies and long passages.
2.  Each other window of WINDOW words picks an anchor: of the symbols of the first ROUNDS
    rounds that are safe in it, the highest, then the one with the smallest name.  A symbol
    is safe in a window that holds all words on which its parsing depended; it is formed in
    every occurrence of the window, whatever surrounds it.  Most anchors occur in no other
    document, and their windows are settled too.
3.  The windows with shared anchors are verified: the smallest document of each is found.

Names that decide on a removal are pairs of independent 64-bit hashes (128 bits), of words
and of everything above.  Documents lie in blocks of BLOCK_BYTES; a name is handed on once
per block, whatever number of documents there hold it, and comes back once per block, so a
name that a third of all documents share is no hot key.  The texts are shuffled once; the
other exchanges carry numbers.  All rounds are one plan, which uses the exchange of the texts again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

WINDOW = 13
#: Rounds of pair naming from which anchors are taken.
ROUNDS = 3
#: Rounds after which symbols are looked up as wholes; a round leaves three quarters of the symbols.
HIGH = (13, 18, 23)
#: Text bytes of a block of documents.
BLOCK_BYTES = 4 << 20
#: Words of a text that are parsed at a time; longer texts are cut with an overlap of WINDOW - 1 words.
SLICE = 200_000
FAR = np.int64(1 << 60)
PAIR = C.U(0xD6E8FEB86659FD93)
RUN = C.U(0xBF58476D1CE4E5B9)

Symbols = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def name_runs(symbols: Symbols) -> Symbols:
    """Names maximal runs of one symbol.  (name, first safe word, last safe word + 1, row) of each symbol.

    A run is known to be maximal, and a single symbol to be no run, by both neighbours;
    at the edge of a row nothing bears witness, so the symbol is not safe there.
    """
    name, lo, hi, row = symbols
    n = len(name)
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = (name[1:] != name[:-1]) | (row[1:] != row[:-1])
    start = np.flatnonzero(fresh)
    end = np.append(start[1:], n)
    named, long = name[start].copy(), end - start > 1
    named[long] = C.spread(named[long] * RUN + (end - start)[long].astype(C.U))
    before, after = np.maximum(start - 1, 0), np.minimum(end, n - 1)
    has_left, has_right = (start > 0) & (row[before] == row[start]), (end < n) & (row[after] == row[start])
    return named, np.where(has_left, lo[before], -1), np.where(has_right, hi[after], FAR), row[start]


def _right(name: np.ndarray, level: int) -> np.ndarray:
    """The side of each symbol in a round."""
    return (C.spread(name + C.U((level + 1) * C.GOLDEN & C.MASK)) >> C.U(63)).astype(bool)


def name_pairs(symbols: Symbols, level: int) -> Symbols:
    """Names every left symbol with a right symbol after it.

    A pair is fixed by its two parts.  A left symbol stays alone because its successor is
    no right one, a right symbol because its predecessor is no left one: their safe spans
    take that neighbour in, and at the edge of a row they are not safe.
    """
    name, lo, hi, row = symbols
    n = len(name)
    right = _right(name, level)
    joined = np.zeros(n, dtype=bool)
    joined[:-1] = ~right[:-1] & right[1:] & (row[1:] == row[:-1])
    head = np.ones(n, dtype=bool)
    head[1:] = ~joined[:-1]
    at = np.flatnonzero(head)
    two, after, before = joined[at], np.minimum(at + 1, n - 1), np.maximum(at - 1, 0)
    named, low, high = name[at].copy(), lo[at].copy(), hi[at].copy()
    named[two] = C.spread(named[two] * PAIR + C.spread(name[after[two]] + C.U(7)))
    waits, follows = ~two & ~right[at], ~two & right[at]
    has_right, has_left = (at + 1 < n) & (row[after] == row[at]), (at > 0) & (row[before] == row[at])
    to_right, to_left = two | waits & has_right, follows & has_left
    low = np.where(to_right, np.minimum(low, lo[after]), np.where(to_left, np.minimum(low, lo[before]), low))
    high = np.where(to_right, np.maximum(high, hi[after]), np.where(to_left, np.maximum(high, hi[before]), high))
    high[waits & ~has_right] = FAR
    low[follows & ~has_left] = -1
    return named, low, high, row[at]


def high_symbols(words: np.ndarray, other: np.ndarray, first: np.ndarray, window: int = WINDOW, levels: tuple[int, ...] = HIGH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word, last word + 1 and the two names of the symbols after the rounds in levels that hold more than one window.

    words and other are independent hashes of the words; first tells where each row's words start.
    """
    name, twin, start = words, other, np.arange(len(words))
    edge = np.zeros(len(words) + 1, dtype=bool)
    edge[first[first < len(words)]] = True
    out: list[tuple[np.ndarray, ...]] = []
    for level in range(max(levels) if len(words) else 0):
        # runs
        opens = edge[start]
        fresh = opens.copy()
        fresh[0] = True
        fresh[1:] |= (name[1:] != name[:-1]) | (twin[1:] != twin[:-1])
        at = np.flatnonzero(fresh)
        if len(at) < len(name):
            size = np.diff(np.append(at, len(name))).astype(C.U)
            long = size > 1
            name, twin, start, opens = name[at], twin[at], start[at], opens[at]
            name[long] = C.spread(name[long] * RUN + size[long])
            twin[long] = C.mix(C.spread(twin[long] + C.U(5)), size[long])
        # pairs
        right = _right(name, level)
        joined = ~right[:-1] & right[1:] & ~opens[1:]
        head = np.ones(len(name), dtype=bool)
        head[1:] = ~joined
        at = np.flatnonzero(head)
        two = np.flatnonzero(np.append(joined, False)[at])
        first_of, second = at[two], at[two] + 1
        paired = C.spread(name[first_of] * PAIR + C.spread(name[second] + C.U(7)))
        paired_twin = C.mix(C.spread(twin[first_of] + C.U(9)), twin[second])
        name, twin, start = name[at], twin[at], start[at]
        name[two], twin[two] = paired, paired_twin
        if level + 1 in levels:
            end = np.append(start[1:], len(words))
            wide = end - start > window
            out.append((start[wide], end[wide], name[wide], twin[wide]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, C.U), np.zeros(0, C.U)
    found = [np.concatenate(x) for x in zip(*out, strict=True)]
    order = np.lexsort((found[1], found[0]))  # a symbol that no round changed stands once
    again = np.zeros(len(order), dtype=bool)
    again[1:] = (found[0][order][1:] == found[0][order][:-1]) & (found[1][order][1:] == found[1][order][:-1]) & (found[2][order][1:] == found[2][order][:-1])
    return tuple(x[order][~again] for x in found)


def anchors(words: np.ndarray, first: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS, needed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Start and anchor key of each window of the rows' words (first: where each row's words start), or of those that start at needed words.

    The key is the hash of the words in the anchor symbol's safe span; a window without a
    safe symbol (inside a long run) has the hash of its own words.
    """
    rows, place = np.repeat(np.arange(len(first) - 1), np.diff(first)), np.arange(len(words))
    fits = place + window <= first[1:][rows] if len(words) else np.zeros(0, bool)
    starts = np.flatnonzero(fits if needed is None else fits & needed)
    keys = np.zeros(len(starts), dtype=C.U)
    if not len(starts):
        return starts, keys
    levels, symbols = [], name_runs((words, place, place + 1, rows))
    for level in range(rounds):
        symbols = name_pairs(symbols, level)
        levels.append(symbols[:3])
    left = np.arange(len(starts))
    for name, lo, hi in reversed(levels):
        safe = (lo >= 0) & (hi - lo <= window)
        name, lo, hi = name[safe], lo[safe], hi[safe]
        if not len(name) or not len(left):
            continue
        begin = starts[left]
        i = np.searchsorted(lo, begin)
        best, rank = np.full(len(left), -1), np.full(len(left), C.MASK, dtype=C.U)
        for _ in range(window):
            k = np.minimum(i, len(name) - 1)
            inside = (i < len(name)) & (lo[k] >= begin) & (hi[k] <= begin + window)
            if not inside.any():
                break
            better = inside & ((name[k] < rank) | (best < 0))
            best, rank = np.where(better, k, best), np.where(better, name[k], rank)
            i = i + 1
        got = best >= 0
        used, back = np.unique(best[got], return_inverse=True)
        keys[left[got]] = C.spans_hash(words, lo[used], hi[used], 3)[back]
        left = left[~got]
    keys[left] = C.spans_hash(words, starts[left], starts[left] + window, 4)
    return starts, keys


class Slice:
    """Words of one slice of a table (id, text): their places, two hashes and rows."""

    def __init__(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, doc: np.ndarray, known: np.ndarray) -> None:
        self.words, self.other, self.first = C.word_hashes(raw, start, end, 1), C.word_hashes(raw, start, end, 2), first
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        #: The document of each word, and whether it has an id.
        self.doc, self.known = doc[row], known[row]

    def covered(self, shared: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        """First word and last + 1 of the high symbols that a smaller document has too."""
        start, end, name, twin = high_symbols(self.words, self.other, self.first)
        least = looked_up(shared, name, twin)
        gone = self.known[start] & (least < self.doc[start])
        return start[gone], end[gone]

    def open_windows(self, covered: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Whether a window that starts at a word lies in no covered symbol."""
        start, end = covered
        long = end - start >= WINDOW
        return self.known & ~C.covered(len(self.words), start[long], end[long] - WINDOW + 1)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts, a = C.window_hashes(self.words, self.first, WINDOW, 5)
        return starts, a, C.window_hashes(self.other, self.first, WINDOW, 6)[1]


def slices(group: pa.Table) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[tuple[int, Slice]]]]:
    """Parts of a table (id, text), the places of their words (start, end, first), and slices with the index of their first word."""
    for batch in group.select(["id", "text"]).to_batches():
        for part in C.chunks(batch):
            raw, at = C.strings(part.column("text"))
            start, end, first = C.word_ranges(raw, at)
            ids = part.column("id")
            doc, known = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False)
            out = []
            if part.num_rows > 1 or len(start) <= SLICE:
                out.append((0, Slice(raw, start, end, first, doc, known)))
            else:
                for a in range(0, max(1, len(start) - WINDOW + 1), SLICE):
                    b = min(len(start), a + SLICE + WINDOW - 1)
                    out.append((a, Slice(raw, start[a:b], end[a:b], np.array([0, b - a]), doc, known)))
            yield part, (raw, start, end, first), out


def table_of(group: pa.Table, kind: int) -> tuple[np.ndarray, ...]:
    """a, b (hashes) and least of the rows of one kind, in order of a and b; the largest number of rows with one a."""
    own = group.filter(pc.equal(group.column("kind"), kind))
    a, b, least = (own.column(c).to_numpy() for c in ("a", "b", "least"))
    a, b = a.astype(C.U), b.astype(C.U)
    order = np.lexsort((b, a))
    a, b, least = a[order], b[order], least[order]
    return a, b, least, np.array([np.unique(a, return_counts=True)[1].max() if len(a) else 0])


def looked_up(table: tuple[np.ndarray, ...], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """least of each pair (a, b); the largest number where table lacks it."""
    own_a, own_b, least, most = table
    out = np.full(len(a), np.iinfo(np.int64).max)
    if len(own_a) and len(a):
        at = np.searchsorted(own_a, a)
        for step in range(int(most[0])):
            k = np.minimum(at + step, len(own_a) - 1)
            hit = (own_a[k] == a) & (own_b[k] == b)
            out[hit] = least[k[hit]]
    return out


def per_block(block: int, a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> pa.Table:
    """NAMES: each pair (a, b) of a block once, with the smallest and the largest document that holds it."""
    order = np.lexsort((b, a))
    a, b, doc = a[order], b[order], doc[order]
    fresh = np.ones(len(a), dtype=bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(fresh)
    least, most = (np.minimum.reduceat(doc, at), np.maximum.reduceat(doc, at)) if len(at) else (doc, doc)
    return pa.table([pa.array(np.full(len(at), block, np.int32)), pa.array(a[at].astype(np.int64)), pa.array(b[at].astype(np.int64)), pa.array(least), pa.array(most)], names=["block", "a", "b", "least", "most"])


NAMES = "block int, a bigint, b bigint, least bigint, most bigint"
KEYS = "block int, a bigint, many boolean"


def _joined(parts: list[tuple[np.ndarray, ...]], n: int) -> list[np.ndarray]:
    none = [np.zeros(0, C.U), np.zeros(0, C.U), np.zeros(0, np.int64)][3 - n :]
    return [np.concatenate([x, *column]) for x, column in zip(none, zip(*parts, strict=True), strict=True)] if parts else none


def _high(group: pa.Table) -> pa.Table:
    found = []
    for _, _, own in slices(group):
        for _, s in own:
            start, _, name, twin = high_symbols(s.words, s.other, s.first)
            known = s.known[start]
            found.append((name[known], twin[known], s.doc[start[known]]))
    return per_block(group.column("block")[0].as_py(), *_joined(found, 3))


def _keys(group: pa.Table, flags: pa.Table) -> pa.Table:
    if not group.num_rows:
        return pa.table({"block": pa.array([], pa.int32()), "a": pa.array([], pa.int64()), "many": pa.array([], pa.bool_())})
    shared, found = table_of(flags, 0), []
    for _, _, own in slices(group):
        for _, s in own:
            starts, keys = anchors(s.words, s.first, needed=s.open_windows(s.covered(shared)))
            found.append((keys, s.doc[starts]))
    keys, doc = _joined(found, 2)
    order = np.argsort(keys, kind="stable")
    keys, doc = keys[order], doc[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    many = np.maximum.reduceat(doc, at) > np.minimum.reduceat(doc, at) if len(at) else np.zeros(0, bool)
    return pa.table([pa.array(np.full(len(at), group.column("block")[0].as_py(), np.int32)), pa.array(keys[at].astype(np.int64)), pa.array(many)], names=["block", "a", "many"])


def _windows(group: pa.Table, flags: pa.Table) -> pa.Table:
    found: list[tuple[np.ndarray, ...]] = []
    if group.num_rows:
        shared, flagged = table_of(flags, 0), table_of(flags, 1)[0]
        for _, _, own in slices(group):
            for _, s in own:
                starts, keys = anchors(s.words, s.first, needed=s.open_windows(s.covered(shared)))
                starts = starts[np.isin(keys, flagged)]
                all_starts, a, b = s.windows()
                mine = np.searchsorted(all_starts, starts)
                found.append((a[mine], b[mine], s.doc[starts]))
    return per_block(group.column("block")[0].as_py() if group.num_rows else 0, *_joined(found, 3))


def removed_words(part: pa.RecordBatch, places: tuple[np.ndarray, ...], own: list[tuple[int, Slice]], shared: tuple[np.ndarray, ...], lost: tuple[np.ndarray, ...]) -> np.ndarray:
    """Whether each word of part goes."""
    gone = np.zeros(len(places[1]), dtype=bool)
    for offset, s in own:
        start, end = s.covered(shared)
        starts, a, b = s.windows()
        mine = starts[s.known[starts] & (looked_up(lost, a, b) < s.doc[starts])]
        gone[offset : offset + len(s.words)] |= C.covered(len(s.words), np.concatenate([start, mine]), np.concatenate([end, mine + WINDOW]))
    return gone


def kept_texts(places: tuple[np.ndarray, ...], gone: np.ndarray) -> list[str]:
    """The words of each row that stay, joined by one space."""
    raw, start, end, first = places
    stay = ~gone
    size = np.where(stay, end - start + 1, 0)
    edge = np.zeros(len(start) + 1, dtype=np.int64)
    np.cumsum(size, out=edge[1:])
    out = np.full(edge[-1], 0x20, dtype=np.uint8)
    letters = np.ones(edge[-1], dtype=bool)
    letters[edge[1:][stay] - 1] = False
    out[letters] = raw[C.covered(len(raw), start[stay], end[stay])]
    data, cuts = out.tobytes(), edge[first].tolist()
    return [data[a : max(a, b - 1)].decode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def in_blocks(docs: DataFrame, others: DataFrame) -> DataFrame:
    """others' columns, id, text and block of each row; rows of one doc_id share a block, rows without one are dealt by their text."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    blocks = max(1, -(-int(size) // BLOCK_BYTES))
    return others.withColumn("block", F.pmod(F.coalesce(F.xxhash64("id"), F.xxhash64("text")), F.lit(blocks)).cast("int"))


def _over(rows: DataFrame, flags: DataFrame, f: Callable[[pa.Table, pa.Table], pa.Table], schema: object) -> DataFrame:
    return rows.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(f, schema)


def flags_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """block, kind, a, b, least: the shared high symbols (kind 0), and with them the lost windows (kind 2), of rows (id, text, block)."""
    same = Window.partitionBy("a", "b")
    names = rows.groupBy("block").applyInArrow(_high, NAMES)

    def smaller(named: DataFrame, kind: int) -> DataFrame:
        """Of names, those that come to their block from a smaller document somewhere."""
        found = named.withColumn("first", F.min("least").over(same)).where(F.col("most") > F.col("first"))
        return found.select("block", F.lit(kind).alias("kind"), "a", "b", F.col("first").alias("least"))

    high = smaller(names, 0)
    keys = _over(rows, high, _keys, KEYS).withColumn("blocks", F.count("*").over(Window.partitionBy("a"))).where("many or blocks > 1")
    anchored = keys.select("block", F.lit(1).alias("kind"), "a", F.lit(0).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("least"))
    windows = _over(rows, high.unionByName(anchored), _windows, NAMES)
    return high, high.unionByName(smaller(windows, 2))


KEPT = "doc_id bigint, n_words bigint, n_removed bigint, kept string"


def _kept(group: pa.Table, flags: pa.Table) -> pa.Table:
    shared, lost, out = table_of(flags, 0), table_of(flags, 2), [[], [], [], []]
    for part, places, own in slices(group) if group.num_rows else ():
        gone = removed_words(part, places, own, shared, lost)
        for column, new in zip(out, (part.column("id").to_pylist(), np.diff(places[3]).tolist(), C.sums(gone, places[3]).tolist(), kept_texts(places, gone)), strict=True):
            column.extend(new)
    return pa.table([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=[x.split()[0] for x in KEPT.split(", ")])


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, one space between) for each row of docs (doc_id, text).

    Words covered by a window of WINDOW words that also starts in a document with a smaller
    doc_id go.  Null and empty texts have no words; texts of fewer than WINDOW words keep all;
    rows that repeat a doc_id take nothing from each other, each owns its windows; rows with a
    null doc_id stay as they are and take nothing; texts of any length are handled whole, in
    slices that overlap; an empty table gives an empty one; other columns are ignored.
    """
    C.tune(docs.sparkSession)
    rows = in_blocks(docs, docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text")))
    return _over(rows, flags_of(rows)[1], _kept, KEPT)


def strip_substrings(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and others) with the text of what dedup_substrings() keeps wherever it removes a word.

    Texts that lose nothing stay as they are, white space included; a column n_chars, if there
    is one, follows the text.  Other columns may have any name.
    """
    C.tune(docs.sparkSession)
    columns = docs.columns
    kinds = {c: docs.schema[c].dataType for c in columns}
    held = [f"c{i}" for i in range(len(columns))]
    rows = in_blocks(docs, docs.toDF(*held).select(F.col(held[columns.index("doc_id")]).cast("bigint").alias("id"), F.col(held[columns.index("text")]).cast("string").alias("text"), *[h for h, c in zip(held, columns, strict=True) if c != "text"]))
    chars = held[columns.index("n_chars")] if "n_chars" in columns else None
    given = [h if c != "text" else "text" for h, c in zip(held, columns, strict=True)]
    schema = rows.select(*given).schema

    def strip(group: pa.Table, flags: pa.Table) -> pa.Table:
        table, out = group.select(given), []
        shared, lost, sizes = table_of(flags, 0), table_of(flags, 2), []
        for part, places, own in slices(group) if group.num_rows else ():
            gone = removed_words(part, places, own, shared, lost)
            for old, removed, kept in zip(part.column("text").to_pylist(), C.sums(gone, places[3]).tolist(), kept_texts(places, gone), strict=True):
                out.append(kept if removed else old)
                sizes.append(len(kept) if removed else None)
        table = table.set_column(given.index("text"), table.schema.field("text"), pa.array(out, table.schema.field("text").type))
        if chars is not None:
            kind = table.schema.field(chars)
            sizes = pa.array(sizes, pa.int64()).cast(kind.type)
            table = table.set_column(given.index(chars), kind, pc.coalesce(sizes, table.column(chars)))
        return table

    done = _over(rows, flags_of(rows)[1], strip, schema).toDF(*columns)
    return done if isinstance(kinds["text"], type(done.schema["text"].dataType)) else done.withColumn("text", F.col("text").cast(kinds["text"]))


#: DuckDB SQL for the digest.
DIGEST_SQL = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s : s + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM doc WHERE len(w) >= 13)),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS p FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY k) AS least FROM win) WHERE least < doc_id),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM doc),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id)
"""
