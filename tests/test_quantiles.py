from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hearthgrid.operators import quantiles

KINDS = {"median": ("v", 0.5), "low": ("v", 0.05), "high": ("v", 0.95), "top": ("v", 1.0)}


def expected(rows):
    groups: dict = {}
    for key, value in rows:
        groups.setdefault(key, [])
        if value is not None:
            groups[key].append(value)
    return {
        key: tuple(
            float(np.percentile(v, 100 * q)) if v else None for _, q in KINDS.values()
        )
        for key, v in groups.items()
    }


def found(spark, rows):
    df = spark.createDataFrame(rows, "k string, v double")
    result = quantiles.grouped_quantiles(df, ["k"], KINDS, extra=[F.count("v").alias("n")])
    return {r["k"]: tuple(r[name] for name in KINDS) for r in result.collect()}


def check(spark, rows):
    ours, theirs = found(spark, rows), expected(rows)
    assert set(ours) == set(theirs)
    for key, values in theirs.items():
        for a, b in zip(ours[key], values):
            assert a == (None if b is None else pytest.approx(b, rel=1e-12))


def skewed(n=5000, seed=1):
    chance = random.Random(seed)
    rows = [("hot", chance.choice((chance.gauss(0, 100), 7.0))) for _ in range(n)]
    rows += [(None, float(i)) for i in range(50)]
    rows += [(f"k{i % 40}", chance.random()) for i in range(400)]
    return rows + [("empty", None), ("one", 3.0), ("hot", None)]


def test_heavy_group_with_ties_and_nulls(spark):
    check(spark, skewed())


@pytest.mark.parametrize("small, first, parts", [(1, 64, 4096), (20, 0.01, 50)])
def test_brackets_are_opened_until_they_are_small(spark, monkeypatch, small, first, parts):
    monkeypatch.setattr(quantiles, "SMALL", small)
    monkeypatch.setattr(quantiles, "FIRST_PARTS", first)
    monkeypatch.setattr(quantiles, "PARTS", parts)
    check(spark, skewed(800, parts))


def test_values_of_any_size(spark, monkeypatch):
    """Far apart, next to each other, infinite; some in one bracket until it is opened often."""
    monkeypatch.setattr(quantiles, "SMALL", 20)
    near = [1.0]
    for _ in range(40):
        near.append(float(np.nextafter(near[-1], 2)))
    rows = [("near", v) for v in near] + [("tiny", 5e-324 * i) for i in range(30)]
    rows += [("far", s * 10.0**e) for e in range(-300, 308, 19) for s in (1, -1)] + [("zero", -0.0), ("zero", 0.0)]
    check(spark, rows)
    odd = [("a", v) for v in (float("-inf"), -1.0, 0.0, 1.0, float("inf"))] + [("b", 1.0), ("b", float("nan")), ("b", 2.0)]
    df = spark.createDataFrame(odd, "k string, v double")
    got = quantiles.grouped_quantiles(df, ["k"], {"m": ("v", 0.5), "top": ("v", 1.0), "low": ("v", 0.0)}).collect()
    got = {r["k"]: (r["low"], r["m"], str(r["top"])) for r in got}
    assert got == {"a": (float("-inf"), 0.0, "inf"), "b": (1.0, 2.0, "nan")}


def test_jobs_and_plan(spark):
    """One stored pass; the second one is in the result's plan, and nothing can fail there."""
    df = spark.createDataFrame(skewed(3000), "k string, v double")
    context = spark.sparkContext
    context.setJobGroup("quantiles", "")
    result = quantiles.grouped_quantiles(df, ["k"], KINDS, extra=[F.count("v").alias("n")])
    jobs = len(context.statusTracker().getJobIdsForGroup("quantiles"))
    context.setJobGroup("", "")
    assert jobs <= 6
    assert "raise_error" not in result._jdf.queryExecution().optimizedPlan().toString()


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(
            st.sampled_from(["a", "b", None]),
            st.one_of(st.none(), st.floats(-1e6, 1e6), st.sampled_from([0.0, 1.0])),
        ),
        min_size=1,
        max_size=40,
    )
)
def test_any_rows(spark, rows):
    check(spark, rows)


def test_no_rows(spark):
    assert found(spark, []) == {}


def test_band(spark):
    rows = [("a", float(i)) for i in range(101)] + [("b", 5.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    closed = quantiles.percentile_band(df, ["k"], "v")
    assert closed.columns == ["k", "v"]
    assert closed.where("k = 'a'").agg(F.min("v"), F.max("v"), F.count("v")).first() == (5.0, 95.0, 91)
    assert closed.where("k = 'b'").count() == 1
    strict = quantiles.percentile_band(df, ["k"], "v", strict=True)
    assert strict.agg(F.min("v"), F.max("v"), F.count("v")).first() == (6.0, 94.0, 89)


def test_size_only_changes_the_plan(spark):
    from hearthgrid.session import join_settled, settle

    def joined():
        df = join_settled(left, right, ["k"])
        return df._jdf.queryExecution().executedPlan().toString(), set(df.collect())

    left = spark.createDataFrame([("a", 1), (None, 2), ("c", 3)], "k string, n int")
    right = settle(spark.createDataFrame([("a", 10), (None, 20)], "k string, m int"), "right")
    plan, rows = joined()
    assert "BroadcastHashJoin" in plan and {r["m"] for r in rows} == {10, 20}
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        large_plan, large_rows = joined()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" in large_plan and large_rows == rows
