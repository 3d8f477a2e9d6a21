"""Mixing sources to target weights along a time-varying curriculum (operator 13).

Each source has a weight, which sets how many words the mix takes from it, and a schedule, a
weight over training time from 0 to 1, which sets when.  Shares go by weight; no source gives
more than `most` times its words, and what that leaves over is shared again among the others.

A source's documents stand in the order of their hashes, and its words are numbered in that
order, round after round: copy r of a document that follows c words is wanted at demand
r * source_size + c + size / 2, and is taken if that is below the target.  The integral of the
schedule says what part of the target is wanted by a time; inverted, it gives each copy its
time.  Times of all sources sort the stream (by range), and sums of sizes number its words.

Only ids, sizes and hashes are shuffled.  Rows that repeat an id with its text and source are
one row with a count until the end.  The order of a source is summed up in buckets of its own
hash range, as many as its rows need, so a source may hold any part of the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from . import common as C

#: How often a source, and so each document, may be repeated.
MOST = 3
#: Documents of a bucket of a source, on average.
BUCKET = 10_000
#: Repeated rows that one step unfolds.
UNFOLD = 1_000
#: A schedule that does not change over time.
FLAT = [(0.0, 1.0), (1.0, 1.0)]


def schedule(knots: list[tuple[float, float]]) -> Column:
    """A schedule as a column: (time, weight) knots from time 0 to 1, straight lines between them."""
    times, weights = [t for t, _ in knots], [w for _, w in knots]
    if times != sorted(set(times)) or times[0] != 0 or times[-1] != 1 or min(weights) < 0 or max(weights) == 0:
        raise ValueError(f"times must rise from 0 to 1 and weights be positive: {knots}")
    return F.array(*[F.struct(F.lit(float(t)).alias("at"), F.lit(float(w)).alias("weight")) for t, w in knots])


def integrated(knots: Column) -> Column:
    """The knots with area, the integral of the weight from 0 to the knot."""
    step = lambda before, x: F.struct(x["at"].alias("at"), x["weight"].alias("weight"), (before["area"] + (x["at"] - before["at"]) * (x["weight"] + before["weight"]) / 2).alias("area"))
    first = F.struct(knots[0]["at"].alias("at"), knots[0]["weight"].alias("weight"), F.lit(0.0).alias("area"))
    return F.aggregate(F.slice(knots, 2, 1_000_000), F.array(first), lambda done, x: F.concat(done, F.array(step(F.element_at(done, -1), x))))


def when_wanted(areas: Column, part: Column) -> Column:
    """The time by which that part (0 to 1) of the whole integral is reached: the root of a quadratic within one line."""
    goal = part * F.element_at(areas, -1)["area"]
    # the last knot that is not past the goal, but for the end
    k = F.greatest(F.lit(1), F.least(F.size(areas) - 1, F.size(F.filter(areas, lambda x: x["area"] <= goal))))
    a, b = F.element_at(areas, k), F.element_at(areas, k + 1)
    rest, slope = goal - a["area"], (b["weight"] - a["weight"]) / (b["at"] - a["at"])
    below = a["weight"] + F.sqrt(F.greatest(F.lit(0.0), a["weight"] * a["weight"] + 2 * slope * rest))
    return F.when(below > 0, a["at"] + 2 * rest / below).otherwise(a["at"])


def _numbered(batches: Iterator[pa.RecordBatch], size: str) -> Iterator[pa.RecordBatch]:
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        ends = at + np.cumsum(batch.column(size).to_numpy(zero_copy_only=False).astype(np.int64))
        starts = np.concatenate([[at], ends])[: len(ends)]
        at = int(ends[-1]) if len(ends) else at
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(starts), part, np.int32)), pa.array(starts, pa.int64())], names=[*batch.schema.names, "part", "start"])


def offsets(rows: DataFrame, size: str, *order: Column) -> DataFrame:
    """rows, sorted by range, with start: the sum of size (not null) over all rows that come before."""
    schema = StructType([*rows.schema.fields, StructField("part", IntegerType()), StructField("start", LongType())])
    laid = C.cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(partial(_numbered, size=size), schema))
    base, bases = 0, []
    for r in laid.groupBy("part").agg(F.sum(size).alias("n")).orderBy("part").collect():  # a number per partition
        bases.append((r["part"], base))
        base += r["n"]
    before = rows.sparkSession.createDataFrame(bases, "part int, base bigint")
    return laid.join(F.broadcast(before), "part").withColumn("start", F.col("start") + F.col("base")).drop("part", "base")


def words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("bigint")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, key, n: the documents without their texts; n rows that repeat id, source and text are one."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"), C.row_key(F.col("doc_id"), F.col("text")).alias("key"))
    return C.cut(rows.groupBy(*rows.columns).agg(F.count("*").alias("n")))


def sources(rows: DataFrame) -> DataFrame:
    """source, place (from 0, by code point, null last), n_rows, source_size of sized()'s rows."""
    each = rows.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum(F.col("n") * F.col("size")).alias("source_size")).withColumn("one", F.lit(1).cast("bigint"))
    return offsets(each, "one", F.col("source").asc_nulls_last()).withColumnRenamed("start", "place").drop("one")


def targets(weighted: DataFrame, most: float = MOST) -> DataFrame:
    """weighted (source_size, weight and others) with target: shares by weight of all sizes, none above most times its source's size.

    Each round caps the sources whose share is too large and shares the excess among the others,
    until none is above; only three sums a round come to the driver.
    """
    rows = weighted.withColumn("limit", F.col("source_size") * most).withColumn("weight", F.col("weight").cast("double"))
    total = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    share, n_capped = F.lit(0.0), -1
    while True:
        capped = share > F.col("limit")
        sums = rows.agg(F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0)).alias("weight"), F.coalesce(F.sum(F.when(capped, F.col("limit"))), F.lit(0)).alias("given"), F.count_if(capped).alias("n")).first()
        if sums["n"] == n_capped or not sums["weight"]:
            return rows.withColumn("target", F.when(capped, F.col("limit")).otherwise(share).cast("double")).drop("limit")
        n_capped, share = sums["n"], F.col("weight") * float(total - sums["given"]) / sums["weight"]


def _beside(table: DataFrame, keys: int = C.BROADCAST_IDS) -> DataFrame:
    """table (a row per source), marked for broadcast if it is no larger than keys; else the join shuffles."""
    return F.broadcast(table) if table.count() <= keys else table


def positions(docs: DataFrame, weights: DataFrame | None = None, most: int = MOST) -> DataFrame:
    """The mix: doc_id, source, size, key, row, source_size, target, repeat, at, taken, start; a row per copy, in order of start.

    docs has doc_id, text, source.  weights has source, weight (0 or more) and schedule (see
    schedule(); null is flat); without it sources weigh 1, 2, 3, repeating, in order.  A source
    that weights lacks is not taken.  A document that is not taken has one row, with null
    repeat and at, taken 0, after all others.  A null text, or one without words, has size 0
    and is not taken; null is a source like any other; rows without an id are told apart by
    text; repeated rows (row, from 0) take their turn one after the other; an empty table
    gives an empty one; other columns are ignored.  at is the time from 0 to 1, start the
    number of words of the stream before the copy.
    """
    rows = sized(docs)
    table = sources(rows)
    if weights is None:
        table = table.withColumn("weight", F.col("place") % 3 + 1).withColumn("schedule", schedule(FLAT))
    else:
        w = weights.select(F.col("source").alias("w_source"), F.col("weight").cast("double").alias("weight"), "schedule")
        table = table.join(w, F.col("source").eqNullSafe(F.col("w_source")), "left").drop("w_source").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    table = C.cut(table)
    table = C.cut(targets(table, most).withColumn("areas", integrated(F.coalesce("schedule", schedule(FLAT)))).withColumn("buckets", F.ceil(F.col("n_rows") / BUCKET)))
    given = _beside(table.select(F.col("source").alias("s"), "place", "source_size", "target", "areas", "buckets"))
    placed = rows.join(given, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # equal beginnings of a hash fall into one bucket, so buckets and hashes are in one order
    placed = placed.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 12), 16, 10).cast("double") / float(1 << 48) * F.col("buckets")))
    ahead = Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("place", "bucket").agg(F.sum(F.col("n") * F.col("size")).alias("held")).select("place", "bucket", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("place", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("within", F.coalesce(F.sum(F.col("n") * F.col("size")).over(inside), F.lit(0))).join(sums, ["place", "bucket"])
    # rows that repeat: in two steps, so that no step makes a long list
    many = placed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / UNFOLD))))
    each = many.withColumn("row", F.explode(F.sequence(F.col("block") * UNFOLD, F.least(F.col("block") * UNFOLD + UNFOLD - 1, F.col("n") - 1))))
    each = each.withColumn("before", F.col("ahead") + F.col("within") + F.col("row") * F.col("size"))
    middle = lambda r: r * F.col("source_size") + F.col("before") + F.col("size") / 2
    repeats = F.filter(F.sequence(F.lit(0).cast("bigint"), F.lit(most - 1).cast("bigint")), lambda r: (F.col("size") > 0) & (middle(r) < F.col("target")))
    copies = each.withColumn("repeat", F.explode_outer(repeats))
    at = when_wanted(F.col("areas"), middle(F.col("repeat")) / F.col("target"))
    copies = copies.select("doc_id", "source", "size", "key", "row", "source_size", "target", "repeat", F.when(F.col("repeat").isNotNull(), at).alias("at"), F.when(F.col("repeat").isNotNull(), F.col("size")).otherwise(0).cast("bigint").alias("taken"))
    return offsets(copies, "taken", F.col("at").asc_nulls_last(), F.col("key"), F.col("row"), F.col("repeat"), F.col("source"))


def mixed(docs: DataFrame, weights: DataFrame | None = None, most: int = MOST) -> DataFrame:
    """The training stream: start, at, doc_id, source, repeat, text of each copy that is taken, sorted by range."""
    taken = positions(docs, weights, most).where("taken > 0").select("start", "at", "doc_id", "source", "repeat", "key")
    texts = docs.select(C.row_key(F.col("doc_id"), F.col("text")).alias("key"), F.col("text").cast("string").alias("text")).dropDuplicates(["key"])
    stream = taken.join(texts, "key").select("start", "at", "doc_id", "source", "repeat", "text")
    return stream.repartitionByRange("start").sortWithinPartitions("start")


def digest(copies: DataFrame) -> DataFrame:
    """A row per document of positions()'s rows: what is taken of it, and where it first stands in the stream."""
    own = copies.groupBy("doc_id", "source", "size", "key", "row", "source_size", "target")
    return own.agg(F.sum("taken").alias("taken"), F.round(F.min("at"), 6).alias("first_at"), F.min(F.when(F.col("taken") > 0, F.col("start"))).alias("first_start")).select("doc_id", "size", "source_size", "target", "taken", "first_at", "first_start")


#: What op13_source_mix uses: the schedule of the sources that weigh 1, 2 and 3.
PHASES = [[(0.0, 2.0), (0.5, 1.0), (1.0, 0.5)], FLAT, [(0.0, 0.25), (0.5, 1.0), (1.0, 2.0)]]


def phased(docs: DataFrame) -> DataFrame:
    """source, weight, schedule of the sources of docs: weights 1, 2, 3 and PHASES, repeating, by code point, null last."""
    names = docs.select(F.col("source").cast("string").alias("source")).distinct().withColumn("one", F.lit(1).cast("bigint"))
    turn = offsets(names, "one", F.col("source").asc_nulls_last()).withColumn("turn", F.col("start") % 3)
    own = F.when(F.col("turn") == 0, schedule(PHASES[0])).when(F.col("turn") == 1, schedule(PHASES[1])).otherwise(schedule(PHASES[2]))
    return turn.select("source", (F.col("turn") + 1).alias("weight"), own.alias("schedule"))


def _line(k: int, i: int) -> str:
    """SQL for the time within line i of phase k."""
    knots, area = PHASES[k], 0.0
    for j in range(i):
        area += (knots[j + 1][0] - knots[j][0]) * (knots[j + 1][1] + knots[j][1]) / 2
    (t, w), (u, v) = knots[i], knots[i + 1]
    return f"{t!r}::DOUBLE + 2 * (goal - {area!r}::DOUBLE) / ({w!r}::DOUBLE + sqrt(greatest(0::DOUBLE, {w * w!r}::DOUBLE + 2 * {(v - w) / (u - t)!r}::DOUBLE * (goal - {area!r}::DOUBLE))))"


def _whole(k: int, end: int | None = None) -> float:
    knots = PHASES[k][:end]
    return sum((b[0] - a[0]) * (b[1] + a[1]) / 2 for a, b in zip(knots, knots[1:]))


_GOAL = " ".join(f"WHEN {k} THEN {_whole(k)!r}::DOUBLE" for k in range(3))
_AT = " ".join(f"WHEN turn = {k} AND goal < {_whole(k, i + 2)!r}::DOUBLE THEN {_line(k, i)}" if i + 2 < len(PHASES[k]) else f"WHEN turn = {k} THEN {_line(k, i)}" for k in range(3) for i in range(len(PHASES[k]) - 1))

#: DuckDB SQL for the digest with phased() weights.
DIGEST_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  md5(coalesce(CAST(doc_id AS VARCHAR), '-') || '|' || coalesce(text, '')) AS key FROM documents),
held AS (SELECT source, sum(size) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn FROM docs GROUP BY source),
whole AS (SELECT sum(source_size) AS t, sum(turn + 1) AS w FROM held),
ahead AS (SELECT held.*, t - coalesce(sum({MOST} * source_size) OVER o, 0) AS t_rest, w - coalesce(sum(turn + 1) OVER o, 0) AS w_rest FROM held, whole
  WINDOW o AS (ORDER BY source_size / (turn + 1), source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, {MOST} * source_size * w_rest < (turn + 1) * t_rest AS full_ FROM ahead),
rest AS (SELECT CAST(any_value(t) - coalesce(sum({MOST} * source_size) FILTER (WHERE full_), 0) AS DOUBLE) AS t, CAST(any_value(w) - coalesce(sum(turn + 1) FILTER (WHERE full_), 0) AS DOUBLE) AS w FROM capped, whole),
goals AS (SELECT source, source_size, turn, CASE WHEN full_ THEN CAST({MOST} * source_size AS DOUBLE) ELSE (turn + 1) * t / w END AS target FROM capped, rest),
placed AS (SELECT d.*, g.source_size, g.target, g.turn, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM docs d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source),
copies AS (SELECT p.*, r.r AS again, (r.r * source_size + before + size / 2.0::DOUBLE) AS middle FROM placed p, (SELECT unnest(range({MOST})) AS r) r WHERE size > 0),
wanted AS (SELECT *, middle / target * CASE turn {_GOAL} END AS goal FROM copies WHERE middle < target),
timed AS (SELECT *, CASE {_AT} END AS moment FROM wanted),
laid AS (SELECT *, coalesce(sum(size) OVER (ORDER BY moment, key, rid, again, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_ FROM timed),
own AS (SELECT rid, sum(size) AS taken, min(moment) AS first_at, min(start_) AS first_start FROM laid GROUP BY rid)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, round(first_at, 6) AS first_at, CAST(first_start AS BIGINT) AS first_start
FROM placed LEFT JOIN own USING (rid)
"""
