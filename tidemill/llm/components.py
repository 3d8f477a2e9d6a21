"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Links from which a node is a hub, and hubs (at most one for so many links) that are sent to all executors; more are joined.
HUB, HUBS = 500, 100_000


def _with_least(links: DataFrame, least: DataFrame) -> DataFrame:
    """links (u, v) with m, the least of u: the links of hubs, which would land in one task, meet a broadcast table; the others are joined."""
    hubs = least.where(F.col("n") >= HUB).select(F.col("u").alias("hub"), F.col("m").alias("hub_m"))
    plain = least.select("u", "m")
    if not 0 < hubs.count() <= HUBS:
        return links.join(plain, "u")
    marked = links.join(F.broadcast(hubs), F.col("u") == F.col("hub"), "left")
    return marked.where("hub IS NOT NULL").select("u", "v", F.col("hub_m").alias("m")).unionByName(marked.where("hub IS NULL").select("u", "v").join(plain, "u").select("u", "v", "m"))


def _least(links: DataFrame) -> DataFrame:
    return C.cut(links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or the node)."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).withColumn("m", F.least("m", "u"))
    return _with_least(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node (u) and its smaller neighbours (v) are linked to the smallest of them."""
    least = _least(links)
    moved = _with_least(links, least).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) for each node of links (a, b); a node alone is not listed.

    Self links and repeated links are ignored; without links the table is empty.  The state
    is checkpointed after each round; the number of rounds grows with the logarithm of the
    longest chain.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links, seen = C.cut(links), None
    while True:
        state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == tuple(state) or not state["n"]:
            break
        seen = tuple(state)
        links = C.cut(_small_star(C.cut(_large_star(links))))
    return links.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
