"""Every query with SQL agrees with it; every other one runs."""

import pytest

import __spark_entry__ as entry
from compare import duck, rows_of, rows_of_sql

SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_sql_has_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, sf, con, name):
    assert rows_of(QUERIES[name](spark, sf)) == rows_of_sql(con, SQL[name])


@pytest.mark.parametrize("name", sorted(n for n in set(QUERIES) - set(SQL) if not n.startswith(("p7", "p8", "p9"))))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).columns


def test_entry(spark, sf):
    assert entry.entry(spark).count() > 0
