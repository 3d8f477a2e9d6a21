"""The prefix trie of conversations by Patricia construction (operator 12).

A conversation is a sequence of turns; its path is the digests of its turns, end to end.  Paths
are sorted by range.  In sorted order every branch of the trie is the common beginning of two
neighbours, so one pass with a stack creates only the points of the compressed trie: branches,
ends and leaves, with edges of many turns between them.  Sums over subtrees are made on the
points; an edge's inner nodes, which have one child, follow from sums over the end of the edge.

Each task builds the trie of its range.  What it shares with its neighbours are beginnings of
its first and of its last path, known from the common length with the neighbours' paths; these
few nodes leave the task as partial sums and are merged, all others are whole.  A node counts
once for its first task, so that all sums add up.

Equal conversations are one path with a count; the ids that end there are hashed as a stream,
from lists made by tasks that each hold a range of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from . import common as C

#: Characters of a turn's digest.
WIDTH = 32
#: Fixed values of the rule that rebuilds conversations: those of one block of ids share up to MOST - 1 first turns.
BLOCK, MOST = 20, 4
NOBODY = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (turn, digest, words; in order) of each conversation; texts stay where they are."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.md5(text("role").cast("binary")), F.md5(text("text").cast("binary"))).cast("binary"))
    words = F.size(F.array_remove(F.split(text("text"), r"[\x20\x09-\x0D]+"), ""))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.struct(F.col("turn").cast("bigint").alias("turn"), digest.alias("digest"), words.alias("words")).alias("own"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("own")).alias("turns"))


def rebuilt(each: DataFrame, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """turns()'s rows, the first h turns of each replaced by those of the block's first conversation; h is crc32(conv_id) mod most."""
    shared = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int")
    heads = each.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("head"), F.slice("turns", 1, most - 1).alias("first"))
    both = each.withColumn("head", F.col("conv_id") - F.col("conv_id") % block).withColumn("h", shared).join(heads, "head", "left")
    own = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return both.select("conv_id", F.when(F.col("first").isNull(), own).otherwise(F.concat(F.slice("first", F.lit(1), F.col("h")), own)).alias("turns"))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal seq in sorted rows, each with its ids as one text."""
    for batch in batches:
        out: list[tuple] = []
        seqs, ids = batch.column("seq").to_pylist(), batch.column("conv_id").to_pylist()
        start = 0
        for i in range(1, len(seqs) + 1):
            if i == len(seqs) or seqs[i] != seqs[start]:
                out.append((seqs[start], ids[start], i - start, ",".join(map(str, ids[start:i]))))
                start = i
        columns = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["seq", "conv_id", "n", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """seq, conv_id (the smallest), n, ends of the runs, those of a seq one after the other."""
    at, first, n, sha = None, 0, 0, hashlib.sha256()
    for batch in batches:
        out: list[tuple] = []
        for seq, conv, size, ids in zip(*[batch.column(c).to_pylist() for c in ("seq", "conv_id", "n", "ids")], strict=True):
            if seq == at:
                sha.update(b",")
            else:
                if at is not None:
                    out.append((at, first, n, sha.hexdigest()))
                at, first, n, sha = seq, conv, 0, hashlib.sha256()
            n += size
            sha.update(ids.encode())
        yield _ends(out)
    if at is not None:
        yield _ends([(at, first, n, sha.hexdigest())])


def _ends(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["seq", "conv_id", "n", "ends"])


def paths(sequences: DataFrame) -> DataFrame:
    """conv_id (the smallest), path, words, n, ends of each distinct sequence of turns (conv_id, turns)."""
    path = F.array_join(F.transform("turns", lambda t: t["digest"]), "")
    rows = C.cut(sequences.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["words"]).alias("words")).withColumn("seq", F.md5(F.col("path").cast("binary"))))
    listed = rows.select("seq", "conv_id").repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id").mapInArrow(_listed, "seq string, conv_id bigint, n bigint, ids string")
    ends = listed.repartition("seq").sortWithinPartitions("seq", "conv_id").mapInArrow(_hashed, "seq string, conv_id bigint, n bigint, ends string")
    return ends.drop("seq").join(rows.drop("seq"), "conv_id")


def common_turns(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        middle = (low + high + 1) // 2
        if a[: middle * WIDTH] == b[: middle * WIDTH]:
            low = middle
        else:
            high = middle - 1
    return low


@F.pandas_udf(IntegerType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else common_turns(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


class _Point:
    """A branch, end or leaf of the compressed trie, with sums over what lies below it."""

    __slots__ = ("depth", "n", "conv", "leaves", "below", "once", "children", "inner", "ends", "waiting")

    def __init__(self, depth: int, n: int = 0, conv: int | None = None, ends: str | None = None) -> None:
        self.depth, self.n, self.conv, self.ends = depth, n, conv, ends
        #: words of members' turns below, of distinct nodes below, distinct children, and rows that wait for this point's conv_id
        self.leaves = self.below = self.once = self.children = 0
        self.inner, self.waiting = False, []


ROWS = "conv_id bigint, depth int, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, below bigint, once bigint, ends string, key string, parent_key string"
_TYPES = [pa.int64(), pa.int32(), *[pa.int64()] * 6, pa.string(), pa.string(), pa.string()]
_NAMES = [x.split()[0] for x in ROWS.split(", ")]
#: Rows of one output batch.
OUT = 10_000


def _batch(rows: list[list]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


def _key(path: str, depth: int) -> str:
    return hashlib.md5(path[: depth * WIDTH].encode()).hexdigest()


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of the trie of one task's sorted paths."""
    stack, out, path, sums = [_Point(0)], [], None, [0]
    left = right = spine = -1

    def close(p: _Point, shared: int) -> None:
        """Gives the rows that wait for p its conv_id, or its key if other tasks share it (nodes of up to shared turns)."""
        for row in p.waiting:
            if p.depth <= shared:
                row[10] = _key(path, p.depth)
            else:
                row[2] = p.conv
            out.append(row)
        p.waiting = []

    def attach(p: _Point, q: _Point, last: bool) -> None:
        """p, whose path has ended, goes below q; the edge's nodes are written."""
        before = min(left, spine)  # nodes of so many turns stand in an earlier task, too
        shared = max(before, right if last else -1)
        close(p, shared)
        leaves = p.leaves if p.inner else int(not (last and right == p.depth))
        total, below, once = sums[p.depth], p.below, p.once
        for d in range(p.depth, q.depth, -1):
            below, once = p.below + p.n * (total - sums[d - 1]), p.once + total - sums[min(max(d - 1, before), p.depth)]
            point = d == p.depth
            row = [p.conv, d, None, p.n, p.children if point else int(d + 1 > before), leaves, below, once, p.ends if point else None, _key(path, d) if d <= shared else None, None]
            if d == q.depth + 1:
                q.waiting.append(row)
            else:
                if d - 1 <= shared:
                    row[10] = _key(path, d - 1)
                else:
                    row[2] = p.conv
                out.append(row)
        q.n, q.conv, q.leaves, q.inner = q.n + p.n, p.conv if q.conv is None else min(q.conv, p.conv), q.leaves + leaves, True
        q.below, q.once, q.children = q.below + below, q.once + once, q.children + int(q.depth + 1 > before)

    for batch in batches:
        for new, words, conv, n, ends, lo, hi in zip(*[batch.column(c).to_pylist() for c in ("path", "words", "conv_id", "n", "ends", "left", "right")], strict=True):
            depth = len(words)
            if path is None:
                left, right, spine, common = lo, hi, depth, 0
            else:
                common = common_turns(path, new)
                while stack[-1].depth > common:
                    p = stack.pop()
                    if stack[-1].depth < common:
                        stack.append(_Point(common))
                    attach(p, stack[-1], False)
                spine = min(spine, common)
            if depth == 0:
                stack[0].n, stack[0].conv, stack[0].ends = n, conv, ends
            else:
                stack.append(_Point(depth, n, conv, ends))
            path, sums = new, [0, *accumulate(words)]
            if len(out) >= OUT:
                yield _batch(out)
                out.clear()
    if path is not None:
        while len(stack) > 1:
            p = stack.pop()
            attach(p, stack[-1], True)
        root, shared = stack[0], max(left, right)
        close(root, 0 if shared >= 0 else -1)
        leaves = root.leaves if root.inner else int(right != 0)
        out.append([root.conv, 0, None, root.n, root.children, leaves, root.below, root.once, root.ends, _key("", 0) if shared >= 0 else None, None])
    yield _batch(out)


def trie(sequences: DataFrame) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, is_point.

    sequences has conv_id (each once) and turns (array of structs with digest, WIDTH characters,
    and words).  A node is the beginning of depth turns of conv_id, its smallest member;
    is_point says whether it is a point of the compressed trie (the root, a branch, an end or
    a leaf).  Sequences without a turn end at the root; equal sequences share all nodes; an
    empty table has no nodes.  A task holds the points of its own range of paths.
    """
    own = C.cut(paths(sequences).repartitionByRange("path").sortWithinPartitions("path").withColumn("part", F.spark_partition_id()))
    order = Window.orderBy("part")  # a row per partition
    edges = own.groupBy("part").agg(F.min("path").alias("lo"), F.max("path").alias("hi")).select("part", "lo", "hi", F.lag("hi").over(order).alias("before"), F.lead("lo").over(order).alias("after"))
    edges = edges.select("part", F.coalesce(_common("before", "lo"), F.lit(-1)).alias("left"), F.coalesce(_common("hi", "after"), F.lit(-1)).alias("right"))
    rows = C.cut(own.join(F.broadcast(edges), "part").select("path", "words", "conv_id", "n", "ends", "left", "right").mapInArrow(_nodes, ROWS))  # two numbers per partition
    total = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "below", "once")]
    merged = C.cut(rows.where("key IS NOT NULL").groupBy("key", "depth").agg(F.min("conv_id").alias("conv_id"), *total, F.max("ends").alias("ends"), F.max("parent_key").alias("parent_key")))
    every = rows.where("key IS NULL").unionByName(merged, allowMissingColumns=True)
    shared = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("shared_conv"))
    shared = F.broadcast(shared) if merged.count() <= C.BROADCAST_IDS else shared
    below = every.where("parent_key IS NOT NULL").join(shared, "parent_key").withColumn("parent_conv_id", F.col("shared_conv"))
    nodes = every.where("parent_key IS NULL").unionByName(below.drop("shared_conv"))
    point = (F.col("depth") == 0) | (F.col("n_children") != 1) | F.col("ends").isNotNull()
    saved = (F.col("below") - F.col("once")).alias("saved_tokens")
    return nodes.select("conv_id", F.col("depth").cast("bigint").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", saved, F.coalesce("ends", F.lit(NOBODY)).alias("ends_sha256"), point.alias("is_point"))


def conversation_trie(conversations: DataFrame, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """trie() of the rebuilt conversations (conv_id, turn, role, text; see rebuilt()).

    Turns go by turn, null first, then by the digest of role and text; a null role or text is
    empty; a row that repeats is another turn; rows without a conv_id take no part; a text of
    any length is a digest and a count of words; other columns are ignored.
    """
    return trie(rebuilt(turns(conversations), block, most))


#: DuckDB SQL for op12_conversation_trie: members of each beginning, with sums over members' deeper turns.
DIGEST_SQL = rf"""
WITH own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(md5(coalesce(role, '')) || md5(coalesce(text, '')))) AS k,
  md5(md5(coalesce(role, '')) || md5(coalesce(text, ''))) AS digest, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT DISTINCT conv_id, conv_id - conv_id % {BLOCK} AS head, {C.crc_sql("conv_id", MOST)} AS h FROM own),
made AS (SELECT c.conv_id, o.k - 1000000000 AS k, o.digest, o.words FROM convs c JOIN own o ON o.conv_id = c.head AND o.k <= c.h
  UNION ALL SELECT c.conv_id, o.k, o.digest, o.words FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.k > c.h),
steps AS (SELECT conv_id, CAST(row_number() OVER w AS BIGINT) AS depth, md5(string_agg(digest, '') OVER w) AS node, words FROM made
  WINDOW w AS (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
all_steps AS (SELECT conv_id, depth, node, words FROM steps UNION ALL SELECT conv_id, 0, md5(''), 0 FROM convs),
nodes AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words FROM all_steps GROUP BY node, depth),
ends AS (SELECT node, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256 FROM (SELECT conv_id, max_by(node, depth) AS node FROM all_steps GROUP BY conv_id) GROUP BY node),
parents AS (SELECT DISTINCT a.node, b.node AS parent FROM all_steps a JOIN all_steps b ON a.conv_id = b.conv_id AND a.depth = b.depth + 1),
kids AS (SELECT parent AS node, count(*) AS n_children FROM parents GROUP BY parent),
under AS (SELECT v.node, sum((u.n_convs - 1) * u.words) AS saved_tokens, count(*) FILTER (WHERE k.node IS NULL) AS n_leaves
  FROM nodes u JOIN all_steps v ON v.conv_id = u.conv_id AND v.depth <= u.depth LEFT JOIN kids k ON k.node = u.node GROUP BY v.node)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, CAST(u.n_leaves AS BIGINT) AS n_leaves, CAST(u.saved_tokens AS BIGINT) AS saved_tokens,
  coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM nodes n JOIN under u USING (node) LEFT JOIN kids k ON k.node = n.node LEFT JOIN ends e ON e.node = n.node LEFT JOIN parents pp ON pp.node = n.node LEFT JOIN nodes p ON p.node = pp.parent
"""
