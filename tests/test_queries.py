"""Every registered query against its comparison SQL on the smallest given tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_points
from stemma.session import TABLES

DATA = "/root/testdata/sf0.001"
# Queries of the optional subpackage have their own tests.
QUERIES = {n: q for n, q in entry_points.queries().items() if n in entry_points.comparisons()}
SQL = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(value, 9) if isinstance(value, float) else value


def normal(records):
    return sorted((tuple(plain(v) for v in r) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_comparison(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = normal(df.select(*columns).collect())
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert found == normal([r[i] for i in order] for r in result.fetchall())


def test_every_query_has_a_comparison():
    """The search that may miss hits is held against brute force in test_hashed_search.py."""
    assert set(QUERIES) == set(entry_points.QUERIES) - {"vector_search_hashed"}


def test_entry_gives_rows(spark):
    assert entry_points.entry(spark).limit(1).count() == 1
