"""N-gram Jaccard join by chosen paths (operator 4).

A text is the set of its shingles of SHINGLE words; sets are sketched by COORDINATES
min-wise hashes, the tokens that get sampled.  In each of RUNS runs a set walks down a
random tree: at a node the tree picks one or two coordinates (1 / THRESHOLD on average)
and the set goes on to the child that its token there names, so that sets meet again and
again in proportion to what they share.  Nodes with few sets are compared by brute force,
larger ones are split further.  Sets that stay in large nodes at the last level form dense
clusters (the connected components of these nodes); a cluster is dealt in blocks of BLOCK
sets, and each pair of blocks compares all its sets exactly in one task, which hands on the
sums of links and a spanning forest instead of the pairs.

A pair outside of the clusters has to meet in one of the RUNS runs: of 100,000 simulated
pairs of similarity 0.8 all met, at FIRST_LEVEL and at LAST_LEVEL (with 12 runs and six
levels 5 of 4,000 did not).  Every candidate is verified on the whole shingle sets.
Equal sets are one node throughout; classes are the connected components of the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components

SHINGLE = 5
THRESHOLD = 0.8
COORDINATES = 64
RUNS = 16
#: Levels of the tree: where buckets are first counted, and the last.
FIRST_LEVEL, LAST_LEVEL = 3, 4
#: Sets in a bucket that are compared by brute force.
SMALL = 16
#: Sets in a block of a dense cluster, and distinct shingles that two blocks compare at once.
BLOCK, COLUMNS = 256, 4096
#: Nodes whose ids are sent to all executors to pick the texts for verification; more are joined.
BROADCAST_NODES = 500_000

SKETCH = "doc_id bigint, row_key string, node bigint, n int, sketch binary"
_MIX = C.spread(np.arange(1, 2 * COORDINATES + 1, dtype=C.U))


def shingles(part: pa.RecordBatch, k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row; fewer than k words are one shingle."""
    raw, at = C.strings(part.column("text"))
    start, end, first = C.word_ranges(raw, at)
    words = C.word_hashes(raw, start, end)
    n = np.diff(first)
    _, hashes = C.window_hashes(words, first, k)
    edges = np.concatenate([[0], np.cumsum(np.maximum(n - k + 1, 0))])
    short = C.spans_hash(words, first[:-1], np.minimum(first[1:], first[:-1] + k))  # meant for rows of fewer than k words
    return [np.unique(hashes[a:b]) if b > a else short[i : i + 1] if n[i] else hashes[:0] for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in C.chunks(batch):
            sets = shingles(part)
            n = np.array([len(x) for x in sets])
            full = np.flatnonzero(n)
            flat = np.concatenate([*sets, np.zeros(0, C.U)])
            at = np.concatenate([[0], np.cumsum(n)])[:-1][full]
            sketch = np.zeros((len(n), COORDINATES), dtype=np.uint32)
            node = np.zeros(len(n), dtype=C.U)
            if len(full):
                for j in range(COORDINATES):
                    values = (flat ^ _MIX[2 * j]) * (_MIX[2 * j + 1] | C.U(1))
                    sketch[full, j] = np.minimum.reduceat(values, at) >> C.U(32)
                node[full] = C.spread(np.add.reduceat(C.spread(flat), at) + n[full].astype(C.U))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("row_key"), pa.array(node.astype(np.int64), mask=n == 0), pa.array(n.astype(np.int32)), pa.array([x.tobytes() for x in sketch], pa.binary())],
                names=["doc_id", "row_key", "node", "n", "sketch"],
            )


def step(path: np.ndarray, sketch: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children (path, row) of each (path, row): one, or two at every fourth node."""
    two = np.flatnonzero(C.spread(path + C.U(3)) % C.U(4) == 0) if THRESHOLD < 1 else np.zeros(0, np.int64)
    at, turn = np.concatenate([np.arange(len(path)), two]), np.repeat(np.array([1, 2], dtype=C.U), [len(path), len(two)])
    pick = (C.spread(path[at] ^ (turn * C.U(0x9E3779B97F4A7C15))) % C.U(COORDINATES)).astype(np.int64)
    token = sketch[row[at], pick].astype(C.U)
    return C.spread(path[at] * C.U(0xD6E8FEB86659FD93) + (turn << C.U(40)) + token), row[at]


def _paths(row: np.ndarray, path: np.ndarray, part: pa.RecordBatch) -> pa.RecordBatch:
    order = np.lexsort((path, row))
    row, path = row[order], path[order]
    fresh = np.ones(len(row), dtype=bool)
    fresh[1:] = (row[1:] != row[:-1]) | (path[1:] != path[:-1])
    row, path = row[fresh], path[fresh]
    return pa.RecordBatch.from_arrays([pa.array(path.astype(np.int64)), part.column("node").take(pa.array(row)), part.column("n").take(pa.array(row))], names=["path", "node", "n"])


PATHS = "path bigint, node bigint, n int"


def _descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        if part.num_rows:
            sketch = np.frombuffer(b"".join(part.column("sketch").to_pylist()), dtype=np.uint32).reshape(-1, COORDINATES)
            path = np.repeat(C.spread(np.arange(1, RUNS + 1, dtype=C.U) << C.U(20)), part.num_rows)
            row = np.tile(np.arange(part.num_rows), RUNS)
            for _ in range(FIRST_LEVEL):
                path, row = step(path, sketch, row)
            yield _paths(row, path, part)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        if part.num_rows:
            sketch = np.frombuffer(b"".join(part.column("sketch").to_pylist()), dtype=np.uint32).reshape(-1, COORDINATES)
            lists = part.column("paths").to_pylist()
            path = np.array([p for own in lists for p in own], dtype=np.int64).astype(C.U)
            row = np.repeat(np.arange(part.num_rows), [len(own) for own in lists])
            yield _paths(*step(path, sketch, row)[::-1], part)


def candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """a, b (a < b) of nodes (node, n, sketch): the pairs that meet in small buckets, with sizes that allow the similarity; and links of all nodes that share a large bucket of the last level."""
    paths, found = nodes.mapInArrow(_descend, PATHS), None
    for level in range(FIRST_LEVEL, LAST_LEVEL + 1):
        buckets = C.cut(paths.groupBy("path").agg(F.count("*").alias("size"), F.min("node").alias("leader")).where("size > 1"))
        met = paths.join(buckets, "path").persist(StorageLevel.MEMORY_AND_DISK)
        small, large = met.where(F.col("size") <= SMALL), met.where(F.col("size") > SMALL)
        left, right = small.select("path", F.col("node").alias("a"), F.col("n").alias("n_a")), small.select("path", F.col("node").alias("b"), F.col("n").alias("n_b"))
        pairs = left.join(right, "path").where((F.col("a") < F.col("b")) & (F.least("n_a", "n_b") >= THRESHOLD * F.greatest("n_a", "n_b"))).select("a", "b")
        met_here = C.cut(pairs.distinct())
        found = met_here if found is None else found.unionByName(met_here)
        if level == LAST_LEVEL or large.isEmpty():
            break
        own = large.groupBy("node").agg(F.collect_list("path").alias("paths"))  # a node has a few paths
        paths = own.join(nodes, "node").select("node", "n", "sketch", "paths").mapInArrow(_split, PATHS)
    return found.distinct(), C.cut(large.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct())


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in C.chunks(batch):
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([x.tobytes() for x in shingles(part)], pa.binary())], names=["node", "shingles"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        keep = []
        for x, y in zip(part.column("set_a").to_pylist(), part.column("set_b").to_pylist(), strict=True):
            a, b = np.frombuffer(x, dtype=C.U), np.frombuffer(y, dtype=C.U)
            both = len(a) + len(b)
            shared = both - len(np.unique(np.concatenate([a, b])))
            keep.append(shared >= THRESHOLD * (both - shared) - 1e-9)
        part = part.filter(pa.array(keep, pa.bool_()))
        yield part.select(["a", "b"])


def sketched(rows: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), C.row_key(F.col("doc_id"), text).alias("row_key"), text.alias("text")).mapInArrow(_sketch, SKETCH)


def node_sets(rows: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, shingles of each of nodes (node); the texts come from rows (doc_id, text)."""
    first = members.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    wanted = first.join(nodes, "node").persist(StorageLevel.MEMORY_AND_DISK)
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_NODES else wanted
    # rows that repeat a doc_id with other texts: the set's hash decides
    texts = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(side, "doc_id").select("node", "text")
    return texts.mapInArrow(_sets, "node bigint, shingles binary").groupBy("node").agg(F.max("shingles").alias("shingles"))


def verified(rows: DataFrame, members: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets reach the similarity; the texts come from rows (doc_id, text)."""
    pairs = pairs.persist(StorageLevel.MEMORY_AND_DISK)
    sets = node_sets(rows, members, pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b").mapInArrow(_similar, "a bigint, b bigint")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each set of left has in common with each of right (sorted distinct values)."""

    def rows(sets: list[np.ndarray], both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(both, flat), len(both) - 1)
        hit = both[at] == flat
        order = np.argsort(at[hit], kind="stable")
        return at[hit][order], row[hit][order]

    total = np.zeros((len(left), len(right)), dtype=np.float64)
    both = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    if not len(both):
        return total
    (at_l, row_l), (at_r, row_r) = rows(left, both), rows(right, both)
    for i in range(0, len(both), COLUMNS):
        (a, b), (c, d) = np.searchsorted(at_l, [i, i + COLUMNS]), np.searchsorted(at_r, [i, i + COLUMNS])
        x, y = np.zeros((len(left), COLUMNS), dtype=np.float32), np.zeros((len(right), COLUMNS), dtype=np.float32)
        x[row_l[a:b], at_l[a:b] - i] = 1
        y[row_r[c:d], at_r[c:d] - i] = 1
        total += x @ y.T
    return total


LINKED = "a bigint, b bigint, linked bigint"


def _compare(group: pa.Table) -> pa.Table:
    """All pairs of two blocks of a cluster (or within one): for each node (a) the documents linked to it here, and a node (b) of its component here."""
    node, copies = group.column("node").to_numpy(), group.column("copies").to_numpy()
    sets = [np.frombuffer(x, dtype=C.U) for x in group.column("shingles").to_pylist()]
    n = np.array([len(x) for x in sets])
    own, i, j = group.column("block").to_numpy(), group.column("i")[0].as_py(), group.column("j")[0].as_py()
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    linked, root = np.zeros(len(node), dtype=np.int64), np.arange(len(node))
    if len(left) and len(right):
        shared = shared_counts([sets[x] for x in left], [sets[x] for x in right])
        link = shared >= THRESHOLD * (n[left][:, None] + n[right][None, :] - shared) - 1e-9
        link &= left[:, None] != right[None, :]
        linked[left] = link @ copies[right]
        linked[right] = link.T @ copies[left]
        while True:
            before = root.copy()
            root[left] = np.minimum(root[left], np.where(link, root[right][None, :], len(node)).min(axis=1))
            root[right] = np.minimum(root[right], np.where(link, root[left][:, None], len(node)).min(axis=0))
            if (before == root).all():
                break
    some = np.flatnonzero(linked)
    return pa.table([pa.array(node[some]), pa.array(node[root[some]]), pa.array(linked[some])], names=["a", "b", "linked"])


def dense_links(rows: DataFrame, members: DataFrame, nodes: DataFrame, clusters: DataFrame) -> DataFrame:
    """LINKED of all pairs within the clusters (node, label) whose sets reach the similarity."""
    large = clusters.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")  # at most one for BLOCK nodes
    dealt = clusters.join(F.broadcast(C.cut(large)), "label", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    sets = dealt.join(node_sets(rows, members, clusters.select("node")), "node").join(nodes.select("node", "copies"), "node")
    turns = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "copies", "shingles")
    return turns.groupBy("label", "i", "j").applyInArrow(_compare, LINKED)


def one_of_each_class(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, but those near_duplicates() puts in the class of a smaller doc_id; rows go by their id and text."""
    return C.without(docs, classes(docs).where("doc_id <> class_id").select(F.col("row_key").alias("key")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """classes() without the row keys."""
    return classes(docs).drop("row_key")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, class_id, n_links, n_shingles for each row of docs (doc_id, text).

    class_id is the smallest doc_id of the class: all documents that chains of links of
    Jaccard similarity THRESHOLD or more connect.  n_links counts the documents linked to
    this one, in dense groups too; copies count.  Texts without a word (null, empty) have no
    links and are their own class; rows that repeat a text are copies; a null doc_id has a null class and no
    links; a very long text is sketched whole, in one piece; an empty table gives an empty one;
    other columns are ignored.
    """
    C.tune(docs.sparkSession)
    members = sketched(docs).persist(StorageLevel.MEMORY_AND_DISK)
    known = members.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
    nodes = known.groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("copies"), F.min("doc_id").alias("least")).persist(StorageLevel.MEMORY_AND_DISK)
    ids = known.select("node", "doc_id")
    pairs, together = candidates(nodes.select("node", "n", "sketch"))
    clusters = components(together).persist(StorageLevel.MEMORY_AND_DISK)
    dense = C.cut(dense_links(docs, ids, nodes, clusters))
    # a pair within a cluster is counted there
    label_a, label_b = clusters.select(F.col("node").alias("a"), F.col("label").alias("label_a")), clusters.select(F.col("node").alias("b"), F.col("label").alias("label_b"))
    pairs = pairs.join(label_a, "a", "left").join(label_b, "b", "left").where(F.coalesce(F.col("label_a") != F.col("label_b"), F.lit(True))).select("a", "b")
    links = C.cut(verified(docs, ids, pairs))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sizes = nodes.select(F.col("node").alias("b"), "copies")
    linked = both.join(sizes, "b").select("a", F.col("copies").alias("linked")).unionByName(dense.select("a", "linked"))
    degree = linked.groupBy("a").agg(F.sum("linked").alias("linked")).withColumnRenamed("a", "node")
    labels = components(links.unionByName(dense.select("a", "b")))
    clusters.unpersist()
    where = nodes.select("node", "copies", "least").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = where.groupBy("label").agg(F.min("least").alias("class_id"))
    placed = where.join(smallest, "label").join(degree, "node", "left").select("node", "class_id", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return members.join(placed, "node", "left").select(
        "doc_id",
        "row_key",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("n_links"),
        F.col("n").cast("bigint").alias("n_shingles"),
    )
