"""Hard negatives by a pivot table (operator 11).

Inner products become distances: with M the largest length, a row x gets one more component
sqrt(M^2 - |x|^2), a query q gets 0, and then |q - x|^2 = |q|^2 + M^2 - 2 q.x.  The table holds
each row's distances to a few pivots.  By the triangle inequality the distance of a query and
a row lies between the largest difference and the smallest sum of their distances to a pivot,
which brackets the score; rows and whole batches that cannot matter are skipped, and the
survivors get exact scores from integers.

The table is laid out by nearest pivot and distance, so rows of a batch are alike.  Anchors
are sent out in blocks of bounded size; a task runs over its part of the table once and keeps
the best few rows of each anchor, so neither copies nor large labels meet in one place.  Two
runs over the table serve a block: the positives, then the negatives within their bounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Pivots, and the rows that they are chosen from (those with the smallest hashes).
PIVOTS, SAMPLE = 16, 2_048
#: Anchors of a block, about, and rows of it that give first bounds.
ANCHORS, SEEDS = 50_000, 4_096
#: Anchors that are compared with a batch at once; candidates that are held before they are cut.
STRIP, HELD = 1_024, 500_000
#: Integers below this size are exact as doubles; squared lengths must stay below LONGEST for scores to be longs.
EXACT, LONGEST = float(1 << 53), float(1 << 62)
NONE = np.int64(-(1 << 63))

TABLE = "vec_id bigint, label bigint, near int, gap double, vec binary, far binary"


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, label, vec (array of int, floor(256 x)), length2 of the rows that take part."""
    known = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(vector).isNotNull()
    sound = F.forall(F.col(vector), lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(F.coalesce(x.cast("double"), F.lit(0.0))))
    vec = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * 256))
    out = rows.where(known & sound).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), vec.alias("vec"))
    out = out.withColumn("length2", F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).where(F.col("length2") < LONGEST)
    return out.withColumn("vec", F.col("vec").cast("array<int>"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column as rows of dims doubles; shorter lists are filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dims))
    out[np.arange(dims) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _lifted(vectors: np.ndarray, most2: float) -> np.ndarray:
    """vectors with the component that makes all of them equally long."""
    return np.concatenate([vectors, np.sqrt(np.maximum(most2 - (vectors * vectors).sum(axis=1), 0))[:, None]], axis=1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T), 0))


def chosen(sample: np.ndarray, n: int) -> np.ndarray:
    """n rows of sample, each the farthest from those before it."""
    picked, nearest = [0], None
    while len(picked) < min(n, len(sample)):
        d = _distances(sample, sample[picked[-1:]])[:, 0]
        nearest = d if nearest is None else np.minimum(nearest, d)
        picked.append(int(nearest.argmax()))
    return sample[picked]


class Space:
    """What all tasks know of the table: dimensions, the largest squared length, and the pivots."""

    def __init__(self, rows: DataFrame) -> None:
        facts = rows.agg(F.max(F.size("vec")).alias("dims"), F.max("length2").alias("most2")).first()
        self.dims, self.most2 = facts["dims"] or 0, facts["most2"] or 0.0
        sample = rows.select("vec_id", "vec").orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(SAMPLE).toArrow()
        self.pivots = chosen(_lifted(_matrix(sample.column("vec"), self.dims), self.most2), PIVOTS) if sample.num_rows else np.zeros((0, self.dims + 1))

    @property
    def slack(self) -> float:
        """More than the rounding of a squared distance."""
        return 1 + 1e-9 * self.most2


def pivot_table(rows: DataFrame, space: Space) -> DataFrame:
    """The stored table: usable()'s rows with their distances to the pivots, laid out by nearest pivot, distance and id."""
    shared = rows.sparkSession.sparkContext.broadcast(space)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for batch in batches:
            vectors = _matrix(batch.column("vec"), s.dims)
            far = _distances(_lifted(vectors, s.most2), s.pivots)
            near = far.argmin(axis=1).astype(np.int32)
            columns = [batch.column("vec_id"), batch.column("label"), pa.array(near), pa.array(far[np.arange(len(near)), near])]
            packed = [pa.array([x.tobytes() for x in m], pa.binary()) for m in (vectors.astype(np.int32), far)]
            yield pa.RecordBatch.from_arrays([*columns, *packed], names=["vec_id", "label", "near", "gap", "vec", "far"])

    order = ("near", "gap", "vec_id")
    return C.cut(rows.mapInArrow(measure, TABLE).repartitionByRange(*order).sortWithinPartitions(*order))


def _unpacked(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), width)


class Rows:
    """Rows of the table in numpy form."""

    def __init__(self, batch: pa.RecordBatch | pa.Table, space: Space) -> None:
        self.ids, self.labels = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(c).to_numpy()) for c in ("vec_id", "label"))
        self.vectors = _unpacked(batch.column("vec"), np.int32, space.dims).astype(np.float64)
        self.far = _unpacked(batch.column("far"), np.float64, len(space.pivots))
        self.length2 = (self.vectors * self.vectors).sum(axis=1)

    def asking(self, space: Space) -> Rows:
        """These rows as queries: the component that is added is 0, so their distances are others than the table's."""
        self.far = _distances(np.concatenate([self.vectors, np.zeros((len(self), 1))], axis=1), space.pivots)
        return self

    def __len__(self) -> int:
        return len(self.ids)


def scores(a: Rows, some: np.ndarray, b: Rows, other: np.ndarray) -> np.ndarray:
    """Exact inner products of rows some of a with rows other of b."""
    x, y = a.vectors[some], b.vectors[other]
    if len(some) and len(other) and math.sqrt(a.length2[some].max() * b.length2[other].max()) >= EXACT:
        return x.astype(np.int64) @ y.astype(np.int64).T
    return (x @ y.T).astype(np.int64)


class Wanted:
    """What the anchors of a block look for: one list of the best rows for each slot, within bounds of its score.

    A slot belongs to an anchor; low and high bound its scores, same says whether labels must
    be equal (else different), k is the length of its list.
    """

    def __init__(self, anchors: Rows, owner: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> None:
        self.anchors, self.same, self.k = anchors, same, k
        self.owner, self.low, self.high = owner, low, high
        self.first = np.searchsorted(owner, np.arange(len(anchors) + 1))
        self.held: list[tuple[np.ndarray, ...]] = []
        self.n_held = 0

    def reach(self) -> tuple[np.ndarray, np.ndarray]:
        """The lowest and highest score that any slot of each anchor looks for (of none: an empty range)."""
        low, high = np.full(len(self.anchors), np.iinfo(np.int64).max), np.full(len(self.anchors), NONE)
        np.minimum.at(low, self.owner, self.low)
        np.maximum.at(high, self.owner, self.high)
        return low, high

    def meet(self, rows: Rows, space: Space | None) -> None:
        """Takes in rows; space gives the brackets (without it all pairs are scored)."""
        low, high = self.reach()
        alive = low <= high
        if space is not None:
            # scores of an anchor with any row of the batch, from the batch's ranges of distances
            far, top, bottom = self.anchors.far, rows.far.max(axis=0), rows.far.min(axis=0)
            base = self.anchors.length2 + space.most2
            apart = np.maximum(np.maximum(far - top, bottom - far), 0).max(axis=1, initial=0)
            reach = (far + top).min(axis=1, initial=np.inf)
            alive &= ((base - apart * apart) / 2 + space.slack >= low) & ((base - reach * reach) / 2 - space.slack <= high)
        for strip in np.array_split(np.flatnonzero(alive), max(1, math.ceil(alive.sum() / STRIP))):
            if len(strip):
                self._compare(strip, rows, space, low[strip], high[strip])
        if self.n_held > HELD:
            self.cut()

    def _compare(self, strip: np.ndarray, rows: Rows, space: Space | None, low: np.ndarray, high: np.ndarray) -> None:
        a = self.anchors
        fit = (a.labels[strip][:, None] == rows.labels) == self.same
        fit &= a.ids[strip][:, None] != rows.ids
        if space is not None:
            base = (a.length2[strip] + space.most2)[:, None]
            apart, reach = np.zeros(fit.shape), np.full(fit.shape, np.inf)
            for j in range(rows.far.shape[1]):
                x, y = a.far[strip, j][:, None], rows.far[:, j]
                np.maximum(apart, np.abs(x - y), out=apart)
                np.minimum(reach, x + y, out=reach)
            fit &= (base - apart * apart) / 2 + space.slack >= low[:, None]
            fit &= (base - reach * reach) / 2 - space.slack <= high[:, None]
        some, other = np.flatnonzero(fit.any(axis=1)), np.flatnonzero(fit.any(axis=0))
        if not len(some):
            return
        exact = scores(a, strip[some], rows, other)
        hit = fit[np.ix_(some, other)] & (exact >= low[some][:, None]) & (exact <= high[some][:, None])
        i, j = np.nonzero(hit)
        anchor, score, ids = strip[some[i]], exact[i, j], rows.ids[other[j]]
        slots = self.first[anchor + 1] - self.first[anchor]
        for s in range(int(slots.max()) if len(slots) else 0):
            own = np.flatnonzero(slots > s)
            slot = self.first[anchor[own]] + s
            own = own[(score[own] >= self.low[slot]) & (score[own] <= self.high[slot])]
            self.held.append((self.first[anchor[own]] + s, score[own], ids[own]))
            self.n_held += len(own)
            if self.n_held > 4 * HELD:
                self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """slot, score, id of the best k so far; a full list raises its slot's lower bound."""
        slot, score, ids = (np.concatenate([x[c] for x in self.held] or [np.zeros(0, np.int64)]).astype(np.int64) for c in range(3))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        full = rank == self.k - 1
        self.low[slot[full]] = np.maximum(self.low[slot[full]], score[full])
        keep = rank < self.k
        self.held = [(slot[keep], score[keep], ids[keep])]
        self.n_held = int(keep.sum())
        return self.held[0]

    def seed(self, rows: Rows) -> None:
        """Raises the lower bounds by some rows of the table, and forgets these."""
        self.meet(rows, None)
        self.cut()
        self.held, self.n_held = [], 0


def _best(table: DataFrame, wanted: Wanted, space: Space) -> tuple[DataFrame, list[Broadcast]]:
    """slot, score, vec_id, rank of the best rows of each slot."""
    context = table.sparkSession.sparkContext
    parts = [context.broadcast(x) for x in (space, wanted)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, w = parts[0].value, parts[1].value
        own = Wanted(w.anchors, w.owner, w.low.copy(), w.high, w.same, w.k)
        for batch in batches:
            if batch.num_rows:
                own.meet(Rows(batch, s), s)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in own.cut()], names=["slot", "score", "vec_id"])

    found = table.mapInArrow(run, "slot bigint, score bigint, vec_id bigint")
    order = Window.partitionBy("slot").orderBy(F.col("score").desc(), "vec_id")  # a task gives k rows of a slot at most
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted.k), parts


RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def hard_negatives(rows: DataFrame, anchor: Column, n_positives: int = 5, n_negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows has vec_id, label, embedding; anchor is a condition on vec_id.  Scores are inner
    products of floor(256 x).  An anchor's positives are the best n_positives rows of its
    label; for each, the best n_negatives rows of other labels are given whose score is least
    to most percent of the positive's; ties go to the smaller id.

    Rows with a null id, label or vector, a null or infinite component or NaN, or a squared
    length of 2^62 or more (its scores are no longs) take no part; shorter vectors count as
    filled up with zeros; rows that repeat an id are rows of their own, but no partners of
    each other; equal anchors are one anchor; an empty table gives an empty one; other columns
    are ignored.
    """
    spark = rows.sparkSession
    C.tune(spark)
    known = usable(rows)
    space = Space(known)
    table = pivot_table(known, space)
    asked = table.where(anchor).dropDuplicates(["vec_id", "label", "vec"])
    blocks = max(1, math.ceil(asked.count() / ANCHORS))
    if blocks > 1:
        asked = C.cut(asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "label", "vec"), F.lit(blocks))))
    results = []
    for b in range(blocks):
        own = Rows((asked.where(F.col("block") == b) if blocks > 1 else asked).orderBy("vec_id", "label", "vec").toArrow(), space).asking(space)  # about ANCHORS rows
        seeds = _some(own, SEEDS)
        n = len(own)
        wanted = Wanted(own, np.arange(n), np.full(n, NONE), np.full(n, np.iinfo(np.int64).max), True, n_positives)
        wanted.seed(seeds)
        best, parts = _best(table, wanted, space)
        found = best.select("slot", "score", "vec_id").orderBy("slot", F.col("score").desc(), "vec_id").toArrow()  # n_positives rows an anchor
        for x in parts:
            x.destroy()
        owner, score, ids = (found.column(c).to_numpy() for c in ("slot", "score", "vec_id"))
        low = np.array([-(-least * s // 100) for s in score.tolist()], np.int64)  # the ceiling
        high = np.array([most * s // 100 for s in score.tolist()], np.int64)
        wanted = Wanted(own, owner, low, high, False, n_negatives)
        wanted.seed(seeds)
        best, parts = _best(table, wanted, space)
        slots = pa.table({"slot": np.arange(len(owner)), "anchor_id": own.ids[owner], "positive_id": ids, "positive_score": score})
        named = best.join(F.broadcast(spark.createDataFrame(slots)), "slot")  # n_positives rows an anchor
        results.append(C.cut(named.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))))
        for x in parts:
            x.destroy()
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def _some(rows: Rows, n: int) -> Rows:
    """At most n of rows, evenly spread."""
    out = object.__new__(Rows)
    at = np.unique(np.linspace(0, max(len(rows) - 1, 0), min(n, len(rows))).astype(np.int64))
    out.ids, out.labels, out.vectors, out.far, out.length2 = rows.ids[at], rows.labels[at], rows.vectors[at], rows.far[at], rows.length2[at]
    return out


#: DuckDB SQL for op11_hard_negatives.
DIGEST_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
x AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM v),
ok AS (SELECT vec_id FROM x GROUP BY vec_id HAVING count(*) FILTER (WHERE x IS NULL OR isnan(x) OR isinf(x)) = 0),
u AS (SELECT vec_id, label, i, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM x JOIN ok USING (vec_id)),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(sum(a.x * b.x) AS BIGINT) AS score
  FROM u a JOIN u b ON a.i = b.i AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 GROUP BY ALL),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER o AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW o AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER o <= 3
"""
