"""Queries that SQL can express, against DuckDB."""

from __future__ import annotations

import pytest

from hearthgrid.llm import queries
from tests.oracle import connect, differences


@pytest.mark.parametrize("name", queries.all_sql())
def test_against_sql(spark, folder, name):
    query = queries.all_queries()[name]
    assert differences(query(spark, folder), queries.all_sql()[name], connect(folder)) == []


def test_every_operator_has_one_query():
    numbers = [int(name[2:].split("_")[0]) for name in queries.all_queries()]
    assert sorted(numbers) == list(range(1, 14))
