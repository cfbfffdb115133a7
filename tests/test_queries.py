"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from hearthgrid import showcase
from tests.oracle import connect, differences

QUERIES = showcase.all_queries()
SQL = showcase.all_sql()


@pytest.fixture(scope="module")
def connection(folder):
    return connect(folder)


def test_every_query_has_its_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, folder, connection, name):
    df = QUERIES[name](spark, folder)
    assert differences(df, SQL[name], connection) == []


def test_entry_has_them_all():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_flagship(spark, folder):
    df = entry.entry(spark)
    assert df.count() > 0 and "median_absolute_error" in df.columns
