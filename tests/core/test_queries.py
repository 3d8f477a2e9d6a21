"""Every core query against its SQL on the smallest tables."""

import duckdb
import pytest
from tidemill.plans.queries import ORACLE_SQL, QUERIES
from tidemill.plans.registry import CASES, CASES_SQL

TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


def plain(x):
    if x is None or x != x:
        return None
    return round(float(x), 6) if isinstance(x, float) or type(x).__name__ == "Decimal" else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(CASES))
def test_worked_case(spark, duck, sf_dir, name):
    got = CASES[name](spark, sf_dir)
    want = duck.execute(CASES_SQL[name])
    assert rows([c[0] for c in want.description], want.fetchall()) == rows(got.columns, got.collect())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    found = rows(got.columns, got.collect())
    if name in ORACLE_SQL:
        want = duck.execute(ORACLE_SQL[name])
        assert rows([c[0] for c in want.description], want.fetchall()) == found
        assert sorted(c[0] for c in want.description) == sorted(got.columns)
