"""The registry of the core queries: name, callable, and the SQL that says the same."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: Worked cases: they read no table, so they are tests with an expected result each, not queries.
CASES: dict[str, Query] = {}
CASES_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def worked(sql: str) -> Callable[[Query], Query]:
    """Registers a worked case with its expected rows as SQL."""

    def add(f: Query) -> Query:
        CASES[f.__name__], CASES_SQL[f.__name__] = f, sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def big(column: Column | str) -> Column:
    return column.cast("bigint")


def constant(value: object) -> str:
    """value in SQL."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, str):
        return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return repr(value)


def cases(given: str, told: dict[str, str], rows: Sequence[tuple]) -> Callable[[Callable[[DataFrame], DataFrame]], Query]:
    """Registers a fixed table of worked cases, with the results that each must have.

    given is the schema of the inputs, told the result columns with their SQL types; a row has
    the inputs, then the results.  The function gets the inputs with their number n and returns
    n and the result columns.
    """
    n_given = re.sub("<[^>]*>", "", given).count(",") + 1

    def add(f: Callable[[DataFrame], DataFrame]) -> Query:
        def run(spark: SparkSession, d: str) -> DataFrame:
            return f(spark.createDataFrame([(i, *r[:n_given]) for i, r in enumerate(rows)], f"n int, {given}"))

        run.__name__ = f.__name__
        each = [f"SELECT {i} AS n, " + ", ".join(f"CAST({constant(v)} AS {kind}) AS {name}" for v, (name, kind) in zip(r[n_given:], told.items(), strict=True)) for i, r in enumerate(rows)]
        return worked("\nUNION ALL ".join(each))(run)

    return add
