"""Every query against DuckDB."""

import pytest

from tidemark.plans import jobs, queries, sql

QUERIES, ORACLE_SQL = queries.QUERIES | jobs.QUERIES, sql.ORACLE_SQL | jobs.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(name, compare):
    compare(QUERIES[name], ORACLE_SQL[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
