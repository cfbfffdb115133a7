from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from hearthgrid import session
from hearthgrid.operators import comparison, evaluation
from hearthgrid.showcase import all_queries


def exchanges(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


def test_tasks_grow_with_the_rows(spark):
    df = spark.range(10)
    n = 40 * session.TASK_ROWS
    assert session.dealt(df, n, "id").rdd.getNumPartitions() == 40
    assert session.dealt(df, 0, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert session.dealt(df, n, "id").count() == 10


def test_long_rows_are_folded_where_the_wide_ones_are(spark):
    """The unpivoted rows of a building stay in its task, so they are not shuffled."""
    wide = spark.range(50).select(
        F.col("id").alias("building_id"), F.lit(1.0).alias("a"), F.lit(None).cast("double").alias("a-pred"),
        F.lit(3.0).alias("b"), F.lit(4.0).alias("b-pred"),
    )
    wide = session.dealt(wide, 1000, "building_id")
    long = evaluation.unpivot_pairs(wide, ["building_id"], ["a", "b"])
    pairs = evaluation.pivot_fixed(long, ["building_id", "fuel"], "target_type", ["actual", "prediction"])
    assert exchanges(pairs) == 1
    rows = {tuple(r)[1:] for r in pairs.collect()}
    assert rows == {("a", 1.0, None), ("b", 3.0, 4.0)} and pairs.count() == 100


def test_scenarios_side_by_side_need_no_other_shuffle(spark):
    lines = spark.sql("select id div 3 as b, id % 3 as s, double(id) as actual, double(-id) as prediction from range(30)")
    found = comparison.ordering_errors(session.dealt(lines, 30, "b"), ["b"], "s", range(3))
    assert exchanges(found) == 1
    assert {(r["n_wrong"], r["n_compared"]) for r in found.collect()} == {(2, 2)}


@pytest.mark.parametrize("name", ["unpivot_pivot_long", "ordering_error", "ordering_error_global"])
def test_queries_bound_the_rows_of_a_task(spark, folder, monkeypatch, name):
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    plan = all_queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    numbers = [int(line.split(",")[-3].strip(" )")) for line in plan.splitlines() if "REPARTITION_BY_NUM" in line]
    assert numbers and min(numbers) >= 60
