"""Duplicates of postings: exact prints first, then token-set similarity within blocks; the first match wins.

Pairs are made by a join that carries ids, times, titles and their marks only.  The time window
is cut into buckets of its own length, so a posting meets those of its bucket and the one before,
whatever the size of its block; a block that is still too full in one bucket is dealt over
several tasks by salting.  Marks, computed once per title, spare nine of ten exact comparisons by
a few bit operations, and texts are fetched for the pairs that are left.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..functions import places as P
from .storage import cut

#: The thresholds of titles and of descriptions, and how much of a description counts.
TITLE_RATIO, TEXT_RATIO, TEXT_CHARS = 85.0, 80.0, 1000
#: Tasks that one bucket of a block is dealt over if it has more than FULL parents.
SALTS, FULL = 8, 1000
#: Words of 64 bits that hold the marks of a title.
MARK_WORDS = 16


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit rows."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for c in b:
        hits = row & where.get(c, 0)
        row = (row + hits | row - hits) & full
    return len(a) - row.bit_count()


def token_set(a: str | None, b: str | None) -> float:
    """The token-set similarity of two texts, 0 to 100."""
    x, y = set((a or "").split()), set((b or "").split())
    if not x or not y:
        return 0.0
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    # a text against its own beginning: the shorter one is the common part
    best = max(200.0 * len(both) / (len(both) + len(one)), 200.0 * len(both) / (len(both) + len(two))) if both else 0.0
    return max(best, 200.0 * common_length(one, two) / (len(one) + len(two)))


#: Bytes that the tables of one step of common_lengths() may take, about.
LANE_BYTES = 32 << 20


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts end to end, and where each starts."""
    at = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), at


def _lanes(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, n_codes: int) -> np.ndarray:
    """Common lengths of pairs whose characters are numbered from 0: bit rows of all pairs side by side, a word of 64 places at a time."""
    n, la, lb = len(a_at) - 1, np.diff(a_at), np.diff(b_at)
    words = int(-(-la.max() // 64))
    own = np.repeat(np.arange(n), la)
    place = np.arange(len(a)) - np.repeat(a_at[:-1], la)
    where = np.zeros((n_codes, words, n), dtype=np.uint64)  # the places of each character in each a
    np.bitwise_or.at(where, (a, place // 64, own), np.uint64(1) << (place % 64).astype(np.uint64))
    ones = np.full(words, ~np.uint64(0))
    row = np.repeat(ones[:, None], n, axis=1)
    order = np.argsort(-lb, kind="stable")  # pairs whose b has ended leave at the end
    where, row, first, size = where[:, :, order], row[:, order], b_at[:-1][order], lb[order]
    for j in range(int(lb.max())):
        m = int(np.searchsorted(-size, -j, side="left"))  # those of more than j characters
        hits = where[b[first[:m] + j], :, np.arange(m)].T & row[:, :m]
        carry = np.zeros(m, dtype=np.uint64)
        for w in range(words):
            old = row[w, :m]
            total = old + hits[w]
            over = total < old
            total += carry
            carry = (over | (total < carry)).astype(np.uint64)
            row[w, :m] = total | (old & ~hits[w])
    # places beyond the end of a keep their ones
    out = np.empty(n, dtype=np.int64)
    out[order] = words * 64 - np.bitwise_count(row).sum(axis=0).astype(np.int64)
    return out


def common_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """common_length() of many pairs at once; pairs of similar size share a step, and its tables stay near LANE_BYTES."""
    out = np.zeros(len(a), dtype=np.int64)
    # rows of bits run along the shorter text
    short, long = zip(*[(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)], strict=True) if len(a) else ((), ())
    order = [i for i in sorted(range(len(a)), key=lambda i: (len(short[i]), len(long[i]))) if short[i]]
    while order:
        take = order[-4096:]
        while True:
            x, x_at = _codes([short[i] for i in take])
            y, y_at = _codes([long[i] for i in take])
            known, x = np.unique(x, return_inverse=True)
            if len(take) == 1 or (len(known) + 1) * -(-len(short[take[-1]]) // 64) * len(take) * 8 <= LANE_BYTES:
                break
            take = take[len(take) // 2 :]
        at = np.minimum(np.searchsorted(known, y), len(known) - 1)
        y = np.where(known[at] == y, at, len(known))  # a character that no short text has
        out[take] = _lanes(x, x_at, y, y_at, len(known) + 1)
        order = order[: -len(take)]
    return out


def _common_of(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """Common lengths where they may reach least (null: not asked for); others are 0."""
    asked = np.flatnonzero(a.notna().to_numpy())
    out = np.zeros(len(a), dtype=np.int64)
    if len(asked):
        x, y = a.iloc[asked].tolist(), b.iloc[asked].tolist()
        most = _letters(x, y)
        near = np.flatnonzero(most >= least.iloc[asked].to_numpy())
        out[asked[near]] = common_lengths([x[i] for i in near], [y[i] for i in near])
    return pd.Series(out)


#: Called nondeterministic, or a filter on a ratio is moved below its words and sets and makes them again for each mention.
_common = F.pandas_udf(_common_of, LongType()).asNondeterministic()


def _letters(a: list[str], b: list[str]) -> np.ndarray:
    """Letters in common, whatever their order: no common subsequence is longer."""
    out = np.zeros(len(a), dtype=np.int64)
    for start in range(0, len(a), 1024):
        (x, x_at), (y, y_at) = _codes(a[start : start + 1024]), _codes(b[start : start + 1024])
        known, both = np.unique(np.concatenate([x, y]), return_inverse=True)
        n, k = len(x_at) - 1, max(len(known), 1)
        counts = [np.bincount(np.repeat(np.arange(n), np.diff(at)) * k + codes, minlength=n * k) for at, codes in ((x_at, both[: len(x)]), (y_at, both[len(x) :]))]
        out[start : start + n] = np.minimum(*counts).reshape(n, k).sum(axis=1)
    return out


def _words(text: Column) -> Column:
    return F.sort_array(F.array_distinct(F.array_remove(F.split(F.coalesce(text, F.lit("")), " +"), "")))


def _sets(x: Column, y: Column) -> list[Column]:
    """The common words of two lists of _words(), and those of one alone, each as a text."""
    return [F.array_join(s, " ") for s in (F.array_intersect(x, y), F.array_except(x, y), F.array_except(y, x))]


def _ratio(none: Column, both: Column, left: Column, right: Column, one: Column, two: Column, least: float) -> Column:
    n, n1, n2 = F.length(both).cast("double"), F.length(one).cast("double"), F.length(two).cast("double")
    within = (n > 0) & ((F.length(left) == 0) | (F.length(right) == 0))
    beginning = F.when(n > 0, F.greatest(200 * n / (n + n1), 200 * n / (n + n2))).otherwise(0.0)
    # the length that would change something: more than the beginnings give, and enough to reach least
    goal = F.greatest(beginning, F.lit(float(least))) * (n1 + n2) / 200 - 1e-6
    asked = ~none & ~within & (F.least(n1, n2) >= goal)
    common = _common(F.when(asked, one), F.when(asked, two), F.when(asked, goal))
    return F.when(none, 0.0).when(within, 100.0).otherwise(F.greatest(beginning, 200.0 * common / (n1 + n2)))


def _sides(both: Column, left: Column, right: Column) -> list[Column]:
    return [F.trim(F.concat_ws(" ", both, own)) for own in (left, right)]


def token_set_ratio(a: Column, b: Column, least: float = 0.0) -> Column:
    """token_set() of two columns of folded texts; one that cannot reach least may come out as any number below it.

    Sets, their order and the terms that have a closed form are built-ins; only the longest
    common subsequence is Python, for all pairs of an Arrow batch at once.
    """
    x, y = _words(a), _words(b)
    sets = _sets(x, y)
    return _ratio((F.size(x) == 0) | (F.size(y) == 0), *sets, *_sides(*sets), least)


def scored(pairs: DataFrame, name: str, a: str, b: str, least: float) -> DataFrame:
    """The pairs (columns a and b) whose token_set_ratio() is at least least, which goes into a column name; words and sets are columns of their own, made once a pair."""
    words = pairs.withColumn("_x", _words(F.col(a))).withColumn("_y", _words(F.col(b)))
    sets = words.select(*pairs.columns, ((F.size("_x") == 0) | (F.size("_y") == 0)).alias("_none"), *[c.alias(n) for c, n in zip(_sets(F.col("_x"), F.col("_y")), ("_both", "_left", "_right"), strict=True)])
    own = [F.col(c) for c in ("_both", "_left", "_right")]
    sides = sets.select("*", *[c.alias(n) for c, n in zip(_sides(*own), ("_one", "_two"), strict=True)])
    return sides.select(*pairs.columns, _ratio(F.col("_none"), *own, F.col("_one"), F.col("_two"), least).alias(name)).where(F.col(name) >= least)


def bound(a: Column, b: Column) -> Column:
    """No token-set similarity of two texts is larger; all built-ins, to spare the exact test."""
    x, y = _words(a), _words(b)
    size = lambda s: F.length(F.array_join(s, " ")).cast("double")
    both, left, right = size(F.array_intersect(x, y)), size(F.array_except(x, y)), size(F.array_except(y, x))
    la, lb = both + left + 1, both + right + 1
    return F.when((both > 0) & ((left == 0) | (right == 0)), 100.0).otherwise(100.0 * F.greatest(2 * F.least(la, lb) / (la + lb), F.when(both > 0, 2 * both / (2 * both + 1 + F.least(left, right))).otherwise(0.0)))


def title_marks(text: str) -> list[int]:
    """The pairs of letters of a text's distinct words, each word between two spaces, as MARK_WORDS words of bits; then the number of pairs, and of those that share a bit."""
    grams: dict[tuple[int, int], int] = {}
    bits = n = 0
    for word in set(text.split(" ")) - {""}:
        codes = [32, *map(ord, word), 32]
        for gram in zip(codes, codes[1:]):
            k = grams[gram] = grams.get(gram, 0) + 1  # a pair that comes again is another one
            bits |= 1 << ((gram[0] * 0x9E3779B1 + gram[1] * 0x85EBCA77 + k * 0xC2B2AE3D & 0xFFFFFFFF) >> 7) % (64 * MARK_WORDS)
            n += 1
    return [*np.frombuffer(bits.to_bytes(8 * MARK_WORDS, "little"), dtype="<i8").tolist(), n, n - bits.bit_count()]


@F.pandas_udf(ArrayType(LongType()))
def _marks(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else title_marks(x))


#: The columns of title_marks(): plain numbers, as the join reads them for every pair.
MARKS = [f"mark_{i}" for i in range(MARK_WORDS)] + ["n_marks", "n_lost"]


def may_reach(a: list[Column], b: list[Column], least: float) -> Column:
    """Whether token_set() of two texts may be least or more, by their title_marks().

    A common subsequence of length c leaves 3c - n1 - n2 - 1 pairs of letters in common (a letter
    left out ends two pairs on its side and one on the other), words in common leave all of theirs.
    """
    (*x, nx, lost_x), (*y, ny, lost_y) = a, b
    shared = F.least(lost_x, lost_y)
    for one, two in zip(x, y, strict=True):
        shared = shared + F.bit_count(one.bitwiseAND(two))
    n1, n2, r = nx - 1, ny - 1, least / 100
    beginning = r / (2 - r) * F.least(n1, n2) + 1
    return shared >= F.least(beginning, F.when(F.least(n1, n2) >= r / 2 * (n1 + n2) - 1e-4, (1.5 * r - 1) * (n1 + n2) - 1)) - 1e-4


def _earlier(posts: DataFrame, window: int) -> DataFrame:
    """parent, child ids with order of posts (block, order, as_parent, as_child, id, at, title, fp, place, MARKS): pairs of one block, the parent before the child and within the window, titles similar, prints different."""
    bucket, carried = F.floor(F.col("at") / window), ("id", "at", "title", "fp", "place", *MARKS)
    parents = posts.where("as_parent").select("block", bucket.alias("bucket"), *[F.col(c).alias(f"{c}_a") for c in carried])
    children = posts.where("as_child").select("block", "order", *[F.col(c).alias(f"{c}_b") for c in carried], F.explode(F.array(bucket, bucket - 1)).alias("bucket"))
    full = F.broadcast(parents.groupBy("block", "bucket").agg(F.count("*").alias("n")).where(F.col("n") > FULL).select("block", "bucket", F.lit(SALTS).alias("salts")))  # a row for FULL parents at most
    parents = parents.join(full, ["block", "bucket"], "left").withColumn("salt", F.pmod(F.xxhash64("id_a"), F.coalesce("salts", F.lit(1)))).drop("salts")
    children = children.join(full, ["block", "bucket"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1).cast("array<bigint>"))).drop("salts")
    first = (F.col("at_a") < F.col("at_b")) | ((F.col("at_a") == F.col("at_b")) & (F.col("id_a") < F.col("id_b")))
    near = parents.join(children, ["block", "bucket", "salt"]).where(first & (F.col("at_a") >= F.col("at_b") - window) & (F.col("fp_a") != F.col("fp_b")) & P.same_place(F.col("place_a"), F.col("place_b")) & may_reach(*([F.col(f"{c}_{side}") for c in MARKS] for side in "ab"), TITLE_RATIO))
    return scored(near.select("order", "id_a", "at_a", "id_b", "title_a", "title_b"), "t", "title_a", "title_b", TITLE_RATIO).drop("title_a", "title_b")


def links(posts: DataFrame, window: int) -> DataFrame:
    """parent, child, reason, similarity of posts (id, at, company, title, place, fp, text, rejected): the first matching predecessor of each.

    title and text are folded, place is a block key; at is a number, ties go by id.  Rejected
    posts take no part.  Equal prints match at any distance; else posts of one company, or of
    one title where the child's or the parent's company is hidden, in compatible places and
    within the window, whose titles and first TEXT_CHARS characters of text are similar.
    An exact match goes before the company block, that before the title block.
    """
    known = posts.where(~F.coalesce("rejected", F.lit(False))).withColumn("company", F.coalesce("company", F.lit("")))
    whole = cut(known.select("id", "at", "company", "title", "place", "fp", F.substring("text", 1, TEXT_CHARS).alias("text")))  # folded once
    marked = whole.drop("text").withColumn("marks", _marks("title"))
    rows = cut(marked.select("id", "at", "company", "title", "place", "fp", *[F.col("marks")[i].alias(c) for i, c in enumerate(MARKS)]))
    # equal prints: the one before the first has none; groups share one parent only by their order, so the earliest is the match
    first = rows.groupBy("fp").agg(F.min(F.struct("at", "id")).alias("m"), F.count("*").alias("n")).where("n > 1").select("fp", F.col("m.id").alias("parent"))
    exact = rows.join(first, "fp").where("id <> parent").select("parent", F.col("id").alias("child"), F.lit("exact_fingerprint").alias("reason"), F.lit(1.0).alias("similarity"))
    hidden = F.col("company") == ""
    blocks = [
        rows.where(~hidden).select(F.concat(F.lit("c|"), "company").alias("block"), F.lit(0).alias("order"), F.lit(True).alias("as_parent"), F.lit(True).alias("as_child"), *rows.columns),
        # a child without a company meets any parent; a child with one meets only parents without
        rows.select(F.concat(F.lit("t|"), "title").alias("block"), F.lit(1).alias("order"), F.lit(True).alias("as_parent"), hidden.alias("as_child"), *rows.columns),
        rows.select(F.concat(F.lit("h|"), "title").alias("block"), F.lit(1).alias("order"), hidden.alias("as_parent"), (~hidden).alias("as_child"), *rows.columns),
    ]
    pairs = _earlier(blocks[0].unionByName(blocks[1]).unionByName(blocks[2]), window)
    unmatched = cut(pairs.join(exact.select(F.col("child").alias("id_b")), "id_b", "left_anti"))
    texts = whole.select("id", "text")
    both = unmatched.join(texts.select(F.col("id").alias("id_a"), F.col("text").alias("text_a")), "id_a").join(texts.select(F.col("id").alias("id_b"), F.col("text").alias("text_b")), "id_b")
    best = scored(both, "d", "text_a", "text_b", TEXT_RATIO).groupBy(F.col("id_b").alias("child")).agg(F.min(F.struct("order", "at_a", "id_a", F.round((F.col("t") + F.col("d")) / 200, 3).alias("s"))).alias("m"))
    return exact.unionByName(best.select(F.col("m.id_a").alias("parent"), "child", F.lit("fuzzy").alias("reason"), F.col("m.s").alias("similarity")))
