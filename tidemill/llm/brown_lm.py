"""LM scoring by Brown class-based n-grams (operator 6).

Words are compared with A-Z lower-cased.  The history of a word is the class of the word
before it: one of the CLASSES classes of the CORE most frequent words, the shape of any other
word, or the start.  Exchange clustering assigns words to classes in two steps:

1.  The CORE words are exchanged between classes while the mutual information of neighbouring
    classes grows; what it reads, the pair table of the core words and the shapes, is bounded by
    these parameters.
2.  Every other word that occurs MIN_COUNT times or more is exchanged in Spark rounds: its counts
    after each history, a row per word, are joined by nothing but the class sums of the round
    before (a table of histories times classes), and it goes to the class where it gains most.
    The vocabulary that is clustered grows with the corpus.

A text's probability is the product of P(class | history) and P(word | class), both smoothed by
additive constants; words that occur less often, and unknown ones, form a class of their own,
and so does the end of a text.

Scoring is one pass: workers hold counts and classes of the words that occur most (a cache of at
most TABLE words, without influence on results); the other words of a text are joined with the
whole table of words.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

CORE, CLASSES, SWEEPS = 1000, 40, 6
#: The count from which a word outside of the core is exchanged, and the rounds after all have a class.
#: In a round only the words of one half (by hash) move, for gains hold while the others stay.
MIN_COUNT, ROUNDS = 3, (0, 1)
#: Words of which every worker holds count and class: those of at least the count that so many words reach.
TABLE = 300_000
#: Histories besides the classes: the start of a text, and the shapes of words outside of the core.
SHAPES = 8
FIXED = 1 + SHAPES
HISTORIES = FIXED + CLASSES
#: The class of rare and unknown words, and that of the end.
RARE, END = CLASSES, CLASSES + 1
#: Distinct words (or words after a history) that a counting task holds before it hands them on.
HELD = 250_000
SMOOTH = 0.5

COUNTS = "word bigint, n bigint"
PAIRS = "a int, b int, n bigint"
AFTER = "word bigint, h int, n bigint"
WORDS = "word bigint, n bigint, class int, hs binary, ns binary"
PARTS = "row bigint, doc_id bigint, held_out boolean, word bigint, h int, times bigint, n_tokens bigint, n_known bigint, base double, score double"


def _merge(words: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    word, back = np.unique(np.concatenate(words), return_inverse=True)
    return word, np.bincount(back, weights=np.concatenate(counts), minlength=len(word)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, counts, n = [], [], 0

    def out(word: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(word), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(word[i : i + 50_000].astype(np.int64)), pa.array(count[i : i + 50_000])], names=["word", "n"])

    for batch in batches:
        for part in C.chunks(batch):
            raw, at = C.strings(part.column("text"))
            start, end, _ = C.word_ranges(raw, at)
            word, count = np.unique(C.word_hashes(C.LOWER[raw], start, end), return_counts=True)
            words.append(word)
            counts.append(count)
            n += len(word)
            if n > 2 * HELD:
                word, count = _merge(words, counts)
                words, counts, n = [word], [count], len(word)
                if n > HELD:
                    yield from out(word, count)
                    words, counts, n = [], [], 0
    if n:
        yield from out(*_merge(words, counts))


class Core:
    """The core words (sorted hashes) and the unit of any word: 0 is the start and the end, then shapes, then core words."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = np.sort(words)
        self.n = FIXED + CORE

    def units(self, words: np.ndarray, shape: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return shape + 1
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at + FIXED, shape + 1)


def shapes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The shape of each word: four lengths, and whether all of it is letters (bytes of other scripts count as letters)."""
    letter = np.zeros(256, dtype=np.int64)
    letter[0x61:0x7B] = letter[0x41:0x5B] = letter[0x80:] = 1
    total = np.concatenate([[0], np.cumsum(letter[raw])])
    size = end - start
    return np.digitize(size, [4, 7, 11]) + 4 * (total[end] - total[start] < size)


def sequence(units: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Left and right unit of each neighbourhood: every row starts after an end and closes with one."""
    n = np.diff(first)
    place = np.arange(len(units)) + np.repeat(np.arange(1, len(n) + 1), n)
    flat = np.zeros(len(units) + len(n) + 1, dtype=np.int64)
    flat[place] = units
    return flat[:-1], flat[1:]


def f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(pairs: np.ndarray, fixed: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each unit by exchange clustering; the first ``fixed`` units keep a class of their own.

    pairs counts neighbouring units.  In each sweep every other unit goes to the class that
    gives the largest sum of f(class pairs) - f(left classes) - f(right classes), f(x) = x log x.
    """
    n = len(pairs)
    label = np.concatenate([np.arange(fixed), fixed + np.arange(n - fixed) % classes]).astype(np.int64)
    k = fixed + classes
    half = np.zeros((k, n))
    np.add.at(half, label, pairs)
    joint = np.zeros((k, k))
    np.add.at(joint.T, label, half.T)
    for _ in range(sweeps):
        moved = 0
        for w in range(fixed, n):
            to, fro, own = np.bincount(label, weights=pairs[w], minlength=k), np.bincount(label, weights=pairs[:, w], minlength=k), pairs[w, w]
            if not to.any() and not fro.any():
                continue
            old = label[w]
            to[old] -= own
            fro[old] -= own
            joint[old] -= to
            joint[:, old] -= fro
            joint[old, old] -= own
            left, right = joint.sum(axis=1), joint.sum(axis=0)
            gain = (f(joint + to) - f(joint)).sum(axis=1) + (f(joint.T + fro) - f(joint.T)).sum(axis=1)
            d = np.diag(joint)
            gain += f(d + to + fro + own) - f(d + to) - f(d + fro) + f(d)
            gain -= f(left + to.sum() + own) - f(left) + f(right + fro.sum() + own) - f(right)
            gain[:fixed] = -np.inf
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9:
                new = old
            label[w] = new
            joint[new] += to
            joint[:, new] += fro
            joint[new, new] += own
            moved += new != old
        if not moved:
            break
    return label


def gains(own: np.ndarray, h: np.ndarray, n: np.ndarray, first: np.ndarray, old: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """What each word (row) gains in each class (column): own are the words' counts, (h, n) the words' entries, word i's from first[i].

    sums are the counts of (history, class) without the start; a word's own share is taken out of its old class first (old: -1 for none).
    """
    word = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
    rows = sums[h]
    mine = np.arange(CLASSES)[None, :] == old[word][:, None]
    rows = rows - np.where(mine, n[:, None], 0.0)
    total = sums.sum(axis=0)[None, :] - np.where(np.arange(CLASSES)[None, :] == old[:, None], own[:, None], 0.0)
    return np.add.reduceat(f(rows + n[:, None]) - f(rows), first, axis=0) - (f(total + own[:, None]) - f(total))


def assign(sums: np.ndarray, seeds: dict[int, int] | None = None, half: int | None = None) -> object:
    """A step over WORDS that gives each word of MIN_COUNT or more the class where it gains most; core words, whose class is fixed, have no entries.

    A class without words gains most with any word, and all would go there at once; so none is
    entered but by its seed.  half: only the words of that half move.
    """
    empty = sums.sum(axis=0) == 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 5000):
                part = batch.slice(i, 5000)
                n, old = part.column("n").to_numpy(), part.column("class").to_numpy(zero_copy_only=False).copy()
                hs = [np.frombuffer(x, dtype=np.int32) for x in part.column("hs").to_pylist()]
                word = part.column("word").to_numpy()
                mine = (word >> 7) & 1 == half if half is not None else np.ones(len(n), dtype=bool)
                free = np.flatnonzero((n >= MIN_COUNT) & (np.array([len(x) for x in hs]) > 0) & mine)
                if len(free):
                    ns = part.column("ns").to_pylist()
                    h = np.concatenate([hs[k] for k in free])
                    count = np.concatenate([np.frombuffer(ns[k], dtype=np.int64) for k in free]).astype(np.float64)
                    first = np.concatenate([[0], np.cumsum([len(hs[k]) for k in free])])[:-1]
                    now = np.where(old[free] < CLASSES, old[free], -1)
                    old[free] = np.where(empty, -np.inf, gains(n[free].astype(np.float64), h, count, first, now, sums)).argmax(axis=1)
                    for k in free if seeds else ():
                        old[k] = seeds.get(int(word[k]), old[k])
                yield pa.RecordBatch.from_arrays([part.column("word"), part.column("n"), pa.array(old.astype(np.int32)), part.column("hs"), part.column("ns")], names=["word", "n", "class", "hs", "ns"])

    return run


def _class_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(history, class, n) of the words that have entries and a class, summed over a task."""
    total = np.zeros((HISTORIES, CLASSES), dtype=np.int64)
    for batch in batches:
        for kind, hs, ns in zip(batch.column("class").to_pylist(), batch.column("hs").to_pylist(), batch.column("ns").to_pylist(), strict=True):
            if kind < CLASSES and hs:
                total[np.frombuffer(hs, dtype=np.int32), kind] += np.frombuffer(ns, dtype=np.int64)
    a, b = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[a, b])], names=["a", "b", "n"])


def _profiles(core: np.ndarray, kinds: np.ndarray) -> object:
    """Rows AFTER, in order of word and history, to WORDS: one row per word; core words get their class and no entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)]

        def out(word: np.ndarray, h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            code = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (h[1:] != h[:-1])]))
            word, h, n = word[code], h[code], np.add.reduceat(n, code)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            own, total = word[first].astype(C.U), np.add.reduceat(n, first)
            at = np.minimum(np.searchsorted(core, own), max(len(core) - 1, 0))
            is_core = core[at] == own if len(core) else np.zeros(len(own), bool)
            kind = np.where(is_core, kinds[at] if len(core) else 0, RARE)
            edge = np.append(first, len(word))
            bare = is_core | (total < MIN_COUNT)
            hs = [b"" if bare[i] else h[a:b].tobytes() for i, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True))]
            ns = [b"" if bare[i] else n[a:b].tobytes() for i, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True))]
            return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), pa.array(total), pa.array(kind.astype(np.int32)), pa.array(hs, pa.binary()), pa.array(ns, pa.binary())], names=["word", "n", "class", "hs", "ns"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(c).to_numpy() for c in ("word", "h", "n")]
            word, h, n = (np.concatenate([a, b]) for a, b in zip(kept, new, strict=True))
            cut = int(np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))[-1])  # the last word may go on
            kept = [word[cut:], h[cut:], n[cut:]]
            if cut:
                yield out(word[:cut], h[:cut], n[:cut])
        if len(kept[0]):
            yield out(*kept)

    return run


class Model:
    """Frozen statistics: log10 of P(class | history), what a count plus SMOOTH is divided by in each class, and a cache of words."""

    def __init__(self, core: Core, history: np.ndarray, sums: np.ndarray, seen: np.ndarray, ends: np.ndarray, size: np.ndarray, kinds: np.ndarray, n_tokens: int, n_words: int, n_ends: int) -> None:
        self.core, self.history, self.n_tokens, self.n_ends = core, history, n_tokens, n_ends
        joint = np.column_stack([sums, np.maximum(seen - ends - sums.sum(axis=1), 0), ends])
        self.step = np.log10((joint + SMOOTH) / (seen[:, None] + SMOOTH * (CLASSES + 2)))
        self.over = np.log10(size + SMOOTH * (kinds + 1))
        self.base_over = np.log10(n_tokens + SMOOTH * (n_words + (n_ends > 0) + 1))
        self.words, self.counts, self.classes = np.zeros(0, C.U), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def hold(self, words: np.ndarray, counts: np.ndarray, classes: np.ndarray) -> None:
        order = np.argsort(words)
        self.words, self.counts, self.classes = words[order], counts[order], classes[order].astype(np.int64)

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count (-1: not in the cache) and class of each word."""
        if not len(self.words):
            return np.full(len(words), -1), np.full(len(words), RARE)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        known = self.words[at] == words
        return np.where(known, self.counts[at], -1), np.where(known, self.classes[at], RARE)

    def terms(self, words: np.ndarray, shape: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per row: base and model log10 probability less the terms of words outside the cache; which words are outside, and the history of each word."""
        count, kind = self.find(words)
        outside = count < 0
        left, _ = sequence(self.core.units(words, shape), first)
        h = self.history[left]
        edge = first + np.arange(len(first))  # a row's neighbourhoods are its words and one more
        of_word, of_end = np.delete(h, edge[1:] - 1), h[edge[1:] - 1]
        seen = np.log10(np.maximum(count, 0) + SMOOTH)
        base = np.concatenate([[0.0], np.cumsum(np.where(outside, 0.0, seen - self.base_over))])
        score = np.concatenate([[0.0], np.cumsum(np.where(outside, 0.0, seen - self.over[kind] + self.step[of_word, kind]))])
        ends = np.log10(self.n_ends + SMOOTH) - self.base_over
        return base[first[1:]] - base[first[:-1]] + ends, score[first[1:]] - score[first[:-1]] + self.step[of_end, END], outside, of_word


def learn(rows: DataFrame) -> tuple[Model, DataFrame]:
    """The model of all rows (text), and the words (word, n, class) outside of its cache."""
    spark = rows.sparkSession
    counts = rows.mapInArrow(_count, COUNTS).groupBy("word").agg(F.sum("n").alias("n")).persist(StorageLevel.MEMORY_AND_DISK)
    n_ends = rows.count()
    levels = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).collect()  # distinct counts: some square root of the words
    n_words, n_tokens = sum(r["words"] for r in levels), sum(r["n"] * r["words"] for r in levels) + n_ends
    least, held = None, 0
    for r in levels:
        held += r["words"]
        if held > TABLE:
            break
        least = r["n"]
    top = counts.orderBy(F.desc("n"), "word").limit(CORE).toArrow()
    counts.unpersist()
    core = Core(top["word"].to_numpy().astype(C.U))
    shared = spark.sparkContext.broadcast(core)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Words, unit before each, unit after each (with the ends) of every part."""
        for batch in batches:
            for part in C.chunks(batch):
                raw, at = C.strings(part.column("text"))
                start, end, first = C.word_ranges(raw, at)
                words = C.word_hashes(C.LOWER[raw], start, end)
                left, right = sequence(shared.value.units(words, shapes(raw, start, end)), first)
                yield words, left, right, (first + np.arange(len(first)))[1:] - 1

    def pair_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = shared.value.n
        total = np.zeros(n * n, dtype=np.int64)
        for _, left, right, _ in parts(batches):
            code, times = np.unique(left * n + right, return_counts=True)
            total[code] += times
        code = np.flatnonzero(total)
        for i in range(0, len(code), 50_000):
            own = code[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array((own // n).astype(np.int32)), pa.array((own % n).astype(np.int32)), pa.array(total[own])], names=["a", "b", "n"])

    met = rows.mapInArrow(pair_up, PAIRS).groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()  # at most core.n ** 2 rows
    pairs = np.zeros((core.n, core.n))
    pairs[met["a"].to_numpy(), met["b"].to_numpy()] = met["n"].to_numpy()
    history = exchange(pairs, FIXED)
    seen, ends = np.bincount(history, weights=pairs.sum(axis=1), minlength=HISTORIES), np.bincount(history, weights=pairs[:, 0], minlength=HISTORIES)
    kinds = history[FIXED : FIXED + len(core.words)] - FIXED
    fixed = np.zeros((HISTORIES, CLASSES))
    np.add.at(fixed, (history[:, None], (history[FIXED:] - FIXED)[None, :]), pairs[:, FIXED:])

    def after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0

        def merged() -> tuple[np.ndarray, ...]:
            word, h, times = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((h, word))
            word, h, times = word[order], h[order], times[order]
            at = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (h[1:] != h[:-1])])) if len(word) else np.zeros(0, np.int64)
            return word[at], h[at], np.add.reduceat(times, at) if len(at) else times

        def out(word: np.ndarray, h: np.ndarray, times: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(word), 50_000):
                j = i + 50_000
                yield pa.RecordBatch.from_arrays([pa.array(word[i:j].astype(np.int64)), pa.array(h[i:j].astype(np.int32)), pa.array(times[i:j])], names=["word", "h", "n"])

        for words, left, _, edge in parts(batches):
            held.append((words, history[np.delete(left, edge)].astype(np.int32), np.ones(len(words), dtype=np.int64)))
            n += len(words)
            if n > 2 * HELD:
                held = [merged()]
                n = len(held[0][0])
                if n > HELD:
                    yield from out(*held[0])
                    held, n = [], 0
        if held:
            yield from out(*merged())

    words = rows.mapInArrow(after, AFTER).repartition("word").sortWithinPartitions("word", "h").mapInArrow(_profiles(core.words, kinds), WORDS).persist(StorageLevel.MEMORY_AND_DISK)
    # as in the core, the most frequent words begin the classes that have none
    empty = np.flatnonzero(fixed.sum(axis=0) == 0)
    first = words.where((F.col("n") >= MIN_COUNT) & (F.length("hs") > 0)).orderBy(F.desc("n"), "word").limit(len(empty)).collect() if len(empty) else []  # at most CLASSES rows
    seeds = {r["word"]: int(c) for r, c in zip(first, empty, strict=False)}
    sums, placed = fixed, words
    for half in (None, *ROUNDS):
        before, placed = placed, placed.mapInArrow(assign(sums, seeds if half is None else None, half), WORDS).persist(StorageLevel.MEMORY_AND_DISK)
        found = placed.mapInArrow(_class_sums, PAIRS).groupBy("a", "b").agg(F.sum("n").alias("n")).collect()  # at most HISTORIES * CLASSES rows
        sums = fixed.copy()
        for r in found:
            sums[r["a"], r["b"]] += r["n"]
        before.unpersist()
    of = placed.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()  # a row per class
    size, many = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    for r in of:
        size[r["class"]], many[r["class"]] = r["n"], r["words"]
    model = Model(core, history, sums, seen, ends, size, many, n_tokens, n_words, n_ends)
    if least is not None:
        table = placed.where(F.col("n") >= least).select("word", "n", "class").toArrow()  # at most TABLE rows
        model.hold(table["word"].to_numpy().astype(C.U), table["n"].to_numpy(), table["class"].to_numpy())
        placed = placed.where(F.col("n") < least)
    return model, placed.select("word", "n", "class")


def score(docs: DataFrame, learning: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text).

    learning (text) is counted whole; held_out is a column of docs that is passed on.  Null and
    empty texts have only their end; rows that repeat an id or a text are scored one by one;
    without learning rows every count is 0; of classes where a word gains equally the first wins;
    a very long text is read in one piece (some 30 times its size in a worker); an empty table
    gives an empty one; other columns are ignored.
    """
    C.tune(docs.sparkSession)
    model, rest = learn(learning.select(F.col("text").cast("string").alias("text")))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        names = [x.split()[0] for x in PARTS.split(", ")]
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        for batch in batches:
            for part in C.chunks(batch):
                raw, at = C.strings(part.column("text"))
                start, end, first = C.word_ranges(raw, at)
                words = C.word_hashes(C.LOWER[raw], start, end)
                base, total, outside, h = own.terms(words, shapes(raw, start, end), first)
                rows, n = np.repeat(np.arange(len(first) - 1), np.diff(first)), np.diff(first)
                known = C.sums(~outside, first) + (own.n_ends > 0)
                key = part.column("row").to_numpy()
                # a row per document; its key stands for a word that is none, so that these rows are dealt evenly
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), part.column("held_out"), pa.array(C.spread(key.astype(C.U) + C.U(99)).astype(np.int64)), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.int64()), pa.array(n + 1), pa.array(known), pa.array(base), pa.array(total)],
                    names=names,
                )
                row, word, h = rows[outside], words[outside], h[outside]
                order = np.lexsort((h, word, row))
                row, word, h = row[order], word[order], h[order]
                fresh = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (word[1:] != word[:-1]) | (h[1:] != h[:-1])])) if len(row) else np.zeros(0, np.int64)
                times = np.diff(np.append(fresh, len(row)))
                m = len(fresh)
                yield pa.RecordBatch.from_arrays([pa.array(key[row[fresh]]), pa.nulls(m, types[1]), pa.nulls(m, types[2]), pa.array(word[fresh].astype(np.int64)), pa.array(h[fresh].astype(np.int32)), pa.array(times), *[pa.nulls(m, t) for t in types[6:]]], names=names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(parts, PARTS).join(rest, "word", "left")
    constant = lambda x: F.from_json(F.lit(json.dumps(x.ravel().tolist())), "array<double>")
    kind = F.coalesce("class", F.lit(RARE))
    n = F.when(F.col("times").isNotNull(), F.coalesce("n", F.lit(0)))
    seen = F.log10(n + SMOOTH)
    base = F.coalesce(F.col("times") * (seen - float(model.base_over)), F.lit(0.0))
    logs = F.coalesce(F.col("times") * (seen - F.element_at(constant(model.over), kind + 1) + F.element_at(constant(model.step), F.col("h") * (CLASSES + 2) + kind + 1)), F.lit(0.0))
    return (
        found.groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
            (F.max("n_known") + F.sum(F.when(n > 0, F.col("times")).otherwise(0))).alias("n_known"),
            (F.max("base") + F.sum(base)).alias("base_score"), (F.max("score") + F.sum(logs)).alias("score"),
        )
        .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n_tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
    )


#: DuckDB SQL for the base columns, base_score rounded.
BASE_SQL = rf"""
WITH doc AS (SELECT doc_id, coalesce({C.crc_sql('doc_id', 5)} = 1, false) AS held_out, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS w FROM documents),
counts AS (SELECT x, count(*) AS c FROM (SELECT unnest(w) AS x FROM doc WHERE NOT held_out) GROUP BY x),
total AS (SELECT sum(c) AS n, count(*) AS v FROM counts),
each AS (SELECT doc_id, held_out, x, count(*) AS k FROM (SELECT doc_id, held_out, unnest(w) AS x FROM doc) GROUP BY ALL)
SELECT doc_id, held_out, CAST(sum(k) AS BIGINT) AS n_tokens, CAST(coalesce(sum(k) FILTER (WHERE c > 0), 0) AS BIGINT) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens, round(sum(k * log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))), 4) AS base_score
FROM each LEFT JOIN counts USING (x), total GROUP BY doc_id, held_out
"""
