"""Comparing query results with their SQL on DuckDB.

Usage: python tests/oracle.py <folder> [query ...]
"""

from __future__ import annotations

import math
import sys
import time
import traceback
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


# DuckDB type of a Spark type, as far as results use them.
SAME_TYPE = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def differences(df, sql: str, connection) -> list[str]:
    """Empty if the DataFrame and the SQL agree in columns, types and rows."""
    answer = connection.execute(sql)
    names = [d[0] for d in answer.description]
    kinds = {d[0]: str(d[1]) for d in answer.description}
    theirs = answer.fetchall()
    if sorted(names) != sorted(df.columns):
        return [f"columns differ: {sorted(set(names) ^ set(df.columns))}"]
    problems = [
        f"type of {name}: {kind} against {kinds[name]}"
        for name, kind in df.dtypes
        if SAME_TYPE.get(kind, kind) != kinds[name]
    ]
    ours, expected = _bag(df.columns, df.collect()), _bag(names, theirs)
    if ours != expected:
        extra, missing = ours - expected, expected - ours
        problems.append(
            f"{sum(extra.values())} unexpected and {sum(missing.values())} missing of "
            f"{sum(expected.values())} rows; columns {sorted(names)}; "
            f"for example {sorted(extra, key=str)[:2]} against {sorted(missing, key=str)[:2]}"
        )
    return problems


def main() -> None:
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from tests.session import local_session

    folder, *chosen = sys.argv[1:]
    spark = local_session()
    connection = connect(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in chosen or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in sql:
                problems = differences(df, sql[name], connection)
            else:
                problems = [] if df.count() else ["no rows"]
        except Exception as error:
            problems = [str(error)[:1500]]
            traceback.print_exc(limit=-3)
        failed += bool(problems)
        mark = "FAIL" if problems else "ok" if name in sql else "ok (rows only)"
        print(f"{name:32} {mark:14} {time.time() - start:6.2f}s", *problems, flush=True)
    print(f"{len(chosen or queries)} queries, {failed} failed")


if __name__ == "__main__":
    main()
