"""Rules over configuration tables: each gives all rows that break it, as (rule, subject, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import relational as R


def _said(rows: DataFrame, rule: str, subject: Column | str, detail: Column) -> DataFrame:
    name = F.col(subject) if isinstance(subject, str) else subject
    return rows.select(F.lit(rule).alias("rule"), name.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def required(rows: DataFrame, rule: str, subject: str, column: str) -> DataFrame:
    """A value that is null or blank."""
    return _said(rows.where(F.coalesce(F.trim(F.col(column).cast("string")), F.lit("")) == ""), rule, subject, F.lit(f"{column} is missing"))


def holds(rows: DataFrame, rule: str, subject: str, column: str, test: Column) -> DataFrame:
    """A value that is given and fails a test (an unknown outcome fails, too)."""
    return _said(rows.where(F.col(column).isNotNull() & ~F.coalesce(test, F.lit(False))), rule, subject, F.concat(F.lit(f"{column}: "), F.col(column).cast("string")))


def one_of(rows: DataFrame, rule: str, subject: str, column: str, allowed: list) -> DataFrame:
    return holds(rows, rule, subject, column, F.col(column).isin(allowed))


def unique(rows: DataFrame, rule: str, keys: list[str]) -> DataFrame:
    """Keys that several rows have, with their number; rows with a null in them are none."""
    many = rows.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
    return _said(many, rule, F.concat_ws("/", *[F.col(k).cast("string") for k in keys]), F.concat(F.col("_n"), F.lit(" rows")))


def refers(rows: DataFrame, rule: str, subject: str, column: str, known: DataFrame, key: str) -> DataFrame:
    """References to a key that known lacks."""
    there = known.select(F.col(key).alias("_key")).distinct()
    lost = rows.where(F.col(column).isNotNull()).join(there, F.col(column) == F.col("_key"), "left_anti")
    return _said(lost, rule, subject, F.concat(F.lit(f"{column}: "), F.col(column).cast("string")))


def acyclic(rows: DataFrame, rule: str, key: str, parent: str) -> DataFrame:
    """Rows whose chain of parents never ends; a parent that is no key ends it."""
    links = rows.select(F.col(key).alias("id"), F.col(parent).alias("p"))
    known = links.join(links.select(F.col("id").alias("p")).distinct().withColumn("_there", F.lit(True)), "p", "left")
    roots = R.roots(known.select("id", F.when(F.col("_there"), F.col("p")).alias("parent")))
    return _said(roots.where("root IS NULL"), rule, "id", F.lit("leads into a cycle"))


def violations(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def read_config(spark: SparkSession, where: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The entries of a folder of JSON documents (one object, or a list of objects, per file), and the violations of those that can't be read."""
    files = spark.read.text(where, wholetext=True).select("value", F.col("_metadata.file_name").alias("_file"))
    told = files.withColumn("_list", F.when(F.ltrim("value").startswith("{"), F.concat(F.lit("["), "value", F.lit("]"))).otherwise(F.col("value")))
    told = told.withColumn("_valid", F.coalesce(F.try_parse_json("_list").isNotNull() & F.ltrim("_list").startswith("["), F.lit(False)))
    entries = told.where("_valid").select(F.explode(F.from_json("_list", f"array<struct<{schema}>>")).alias("e")).where("e IS NOT NULL").select("e.*")
    return entries, _said(told.where("NOT _valid"), "readable", "_file", F.lit("is no JSON of this form"))
