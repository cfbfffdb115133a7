"""Registration of queries and access to the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from hearthgrid.session import configure

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries of one theme and, where one exists, their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def register(query: Query) -> Query:
            name = query.__name__

            @wraps(query)
            def configured(spark: SparkSession, folder: str) -> DataFrame:
                return query(configure(spark), folder)

            self.queries[name] = configured
            if sql is not None:
                self.sql[name] = sql
            return query

        return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
