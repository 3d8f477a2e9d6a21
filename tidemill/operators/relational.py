"""Relational building blocks: latest rows, merges, change logs, roots of links, ledgers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut


def latest_per_key(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order, by a window over the key; only the columns asked for are shuffled."""
    position = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(position)).where("_rank = 1").drop("_rank")


def changes_only(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The rows whose value differs from the key's previous one; a key's first row stays."""
    before = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_before", F.lag(value).over(before)).withColumn("_n", F.row_number().over(before)).where((F.col("_n") == 1) | ~F.col(value).eqNullSafe(F.col("_before"))).drop("_before", "_n")


#: How a column of a stored row and of an incoming one merge.
KEEP_OLD: Callable[[Column, Column], Column] = lambda old, new: old
TAKE_NEW: Callable[[Column, Column], Column] = lambda old, new: new
NEW_UNLESS_NULL: Callable[[Column, Column], Column] = lambda old, new: F.coalesce(new, old)


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], policy: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """stored with incoming merged in: each column by its policy where both sides have the key (else the side that has it)."""
    old = stored.select(*[F.col(c).alias(f"old_{c}") for c in stored.columns], F.lit(True).alias("_old"))
    new = incoming.select(*[F.col(c).alias(f"new_{c}") for c in stored.columns], F.lit(True).alias("_new"))
    match = [F.col(f"old_{k}") == F.col(f"new_{k}") for k in keys]

    def merged(c: str) -> Column:
        before, after = F.col(f"old_{c}"), F.col(f"new_{c}")
        both = F.coalesce(before, after) if c in keys else policy.get(c, TAKE_NEW)(before, after)
        return F.when(F.col("_new").isNull(), before).when(F.col("_old").isNull(), after).otherwise(both).alias(c)

    return old.join(new, match, "full_outer").select(*[merged(c) for c in stored.columns])


def roots(parents: DataFrame) -> DataFrame:
    """id, root: follows id, parent (null for heads) to the head by doubling the pointers.

    Each round is checkpointed, so that it is computed once; the number of rounds is the
    logarithm of the longest chain.  Rows that lead into a cycle have no head, and so a null
    root: no chain is longer than the table, so after as many doublings they are what is left.
    """
    at = cut(parents.select("id", F.coalesce("parent", "id").alias("root"), F.col("parent").isNull().alias("head")))
    heads = at.where("head").select(F.col("id").alias("root"), F.lit(True).alias("head"))
    for _ in range(at.count().bit_length() + 1):
        up = at.select(F.col("id").alias("root"), F.col("root").alias("next"))
        at = cut(at.drop("head").join(up, "root").select("id", F.col("next").alias("root")).join(heads, "root", "left").select("id", "root", F.coalesce("head", F.lit(False)).alias("head")))
        if at.where("not head").isEmpty():
            break
    return at.select("id", F.when(F.col("head"), F.col("root")).alias("root"))


def ledger(base: int, rules: list[tuple[str, int, Column]]) -> tuple[Column, Column]:
    """The clamped score (0 to 100) of base and all rules (name, weight, test) that hold, and the explanations in order."""
    total = F.lit(base)
    for _, weight, test in rules:
        total = total + F.when(test, weight).otherwise(0)
    said = F.filter(F.array(*[F.when(test, F.lit(f"{name} {weight:+d}")) for name, weight, test in rules]), lambda x: x.isNotNull())
    return F.greatest(F.lit(0), F.least(F.lit(100), total)), said


def reasons(gates: list[tuple[str, Column]]) -> Column:
    """The names of all gates (name, rejects) that reject, in order; an unknown test does not reject."""
    return F.filter(F.array(*[F.when(rejects, F.lit(name)) for name, rejects in gates]), lambda x: x.isNotNull())


def top_k(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    return rows.orderBy(*order).limit(k)


def capped(rows: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """The first k rows in order with their place (from 1) and overflow, the number of rows that did not fit.

    Only the k rows are numbered; the count is a sum per partition.
    """
    best = rows.orderBy(*order).limit(k)
    placed = best.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    total = rows.agg(F.count("*").alias("_n"))
    return placed.crossJoin(F.broadcast(total)).withColumn("overflow", F.greatest(F.col("_n") - k, F.lit(0))).drop("_n")  # one row beside k


def latest_k_per_key(rows: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each key in order."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_place") <= k).drop("_place")


def insert_or_ignore(stored: DataFrame, incoming: DataFrame, key: str, at: str) -> DataFrame:
    """stored with the keys of incoming that it lacks, each as its first row by at has it."""
    first = incoming.groupBy(key).agg(*[F.min_by(c, at).alias(c) for c in stored.columns if c != key])
    return stored.unionByName(first.join(stored.select(key), key, "left_anti").select(*stored.columns))


def sets_differ(one: DataFrame, other: DataFrame) -> DataFrame:
    """One row, changed: whether two sets of rows differ."""
    gone, new = one.subtract(other).agg(F.count("*").alias("a")), other.subtract(one).agg(F.count("*").alias("b"))
    return gone.crossJoin(new).select(((F.col("a") + F.col("b")) > 0).alias("changed"))  # a row on each side


def optional_filters(filters: dict[str, tuple[object, Callable[[object], Column]]]) -> Column:
    """The conjunction of the filters whose value is given (name: (value or null, test of the value))."""
    out = F.lit(True)
    for value, test in filters.values():
        if value is not None:
            out = out & test(value)
    return out
