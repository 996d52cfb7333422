"""Every registered query equals its independent DuckDB statement on the small tables."""

import pytest

import __spark_entry__ as E
from envlake.checks.compare import compare

from envlake.checks.oracle import oracle_statements
from envlake.plans.registry import all_queries

SQL = oracle_statements()
QUERIES = all_queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, sf, name):
    r = compare(spark, name, QUERIES[name], SQL[name], sf)
    assert "error" not in r, r
    assert r["spark_rows"] == r["duck_rows"], r
    assert r["match"], r


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry_registers_every_query():
    assert set(QUERIES) <= set(E.queries()) and set(SQL) <= set(E.oracle_sql())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["station", "hour", "avg_temp", "avg_humidity", "avg_pm25"]
