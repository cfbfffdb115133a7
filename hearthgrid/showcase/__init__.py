"""Queries that run the operators on the given tables, each with an equivalent SQL text."""

from __future__ import annotations

from hearthgrid.showcase import buildings, evaluation, learning, parsing, schema, timeseries
from hearthgrid.showcase.base import Query

THEMES = (evaluation, buildings, parsing, schema, timeseries, learning)


def all_queries() -> dict[str, Query]:
    return {name: query for theme in THEMES for name, query in theme.registry.queries.items()}


def all_sql() -> dict[str, str]:
    return {name: text for theme in THEMES for name, text in theme.registry.sql.items()}
