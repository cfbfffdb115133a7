from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthgrid.operators import linear, splits
from hearthgrid.operators.learning import FeatureSet
from tests.conftest import values

FEATURES = FeatureSet(("fuel", "duct"), ("size", "age"), ("attic",))
SCHEMA = "id int, fuel string, duct string, size double, age int, attic boolean, electricity double, propane double, w double"


def homes(n=300, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        fuel, duct = "gas oil wood".split()[rng.integers(3)], "ab"[rng.integers(2)]
        size, age, attic = float(rng.integers(5, 40)), int(rng.integers(90)), bool(rng.integers(2))
        electricity = 30 * size + 4 * age + 100 * attic + {"gas": 0, "oil": 50, "wood": 90}[fuel] + rng.normal()
        propane = 7 * size + rng.normal() if rng.integers(3) else 0.0
        rows.append((i, fuel, duct, size, age, attic, float(electricity), float(propane), float(rng.integers(1, 4))))
    return rows


def plain_predictions(rows, target, keep=lambda r: True):
    """Weighted least squares by numpy, over rows whose target is not zero."""
    labels = [(1, "gas"), (1, "oil"), (1, "wood"), (2, "a"), (2, "b")]

    def terms(r):
        return [1.0, *[float(r[c] == label) for c, label in labels], r[3], r[4], float(r[5])]

    own = [r for r in rows if r[target] and keep(r)]
    root = np.sqrt([r[8] for r in own])
    found = np.linalg.lstsq(np.array([terms(r) for r in own]) * root[:, None], np.array([r[target] for r in own]) * root)[0]
    return {r[0]: float(np.dot(terms(r), found)) for r in rows}


def test_all_targets_and_segments_as_numpy_has_them(spark):
    rows = homes()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    segments = {"all": "true", "old": "age > 40"}
    models = linear.fit_linear(df, FEATURES, ["electricity", "propane"], "w", segments)
    scored = models.score(linear.in_segments(df, segments), ["id", "segment"], segment="segment").collect()
    assert len(scored) == len(rows) + sum(r[4] > 40 for r in rows)
    for segment, keep in (("all", lambda r: True), ("old", lambda r: r[4] > 40)):
        for name, target in (("electricity", 6), ("propane", 7)):
            wanted = plain_predictions(rows, target, keep)
            for r in scored:
                if r["segment"] == segment:
                    assert r[f"{name}-pred"] == pytest.approx(wanted[r["id"]], abs=1e-6)


def test_scoring_shuffles_nothing(spark, capsys):
    df = spark.createDataFrame(homes(50), SCHEMA)
    models = linear.fit_linear(df, FEATURES, ["electricity"])
    models.score(df, ["id"]).explain()
    assert "Exchange" not in capsys.readouterr().out


def test_odd_rows(spark):
    rows = homes(120)
    odd = [
        (900, None, "a", 9.0, 1, True, 5e9, 1.0, None),
        (901, "gas", "a", None, 1, True, 5e9, 1.0, 1.0),
        (902, "gas", "a", 9.0, 1, None, 5e9, 1.0, 1.0),
        (903, "gas", "a", 9.0, 1, True, None, None, 1.0),
        (904, "gas", "a", 9.0, 1, True, 5e9, 5e9, 0.0),
    ]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    models = linear.fit_linear(df, FEATURES, ["electricity"], "w")
    found = {r[0]: r[1] for r in models.score(df, ["id"]).collect()}
    for key, value in plain_predictions(rows, 6).items():
        assert found[key] == pytest.approx(value, abs=1e-6)
    assert found[901] is None and found[902] is None and found[900] is not None
    none = linear.fit_linear(df.where("false"), FEATURES, ["electricity"])
    assert none.fitted == {} and none.score(df, ["id"]).where("`electricity-pred` is not null").isEmpty()


def test_a_constant_number_adds_nothing(spark):
    df = spark.range(50).selectExpr("1e6D AS flat", "cast(id AS double) AS x", "3.0D * id + 7 AS y")
    models = linear.fit_linear(df, FeatureSet(numeric=("flat", "x")), ["y"])
    constant, flat, slope = models.fitted["all", "y"]
    assert flat == 0 and slope == pytest.approx(3) and constant == pytest.approx(7)


def test_too_many_labels(spark):
    df = spark.range(30).selectExpr("cast(id AS string) AS label", "1.0D AS y")
    with pytest.raises(ValueError, match="more than 29"):
        linear.fit_linear(df, FeatureSet(("label",)), ["y"], max_labels=29)
    assert len(linear.fit_linear(df, FeatureSet(("label",)), ["y"], max_labels=30).terms) == 30


def plain_importance(spark, df, models, keep):
    rows = df.withColumn("number", splits.key_number(["id"], 3)).collect()
    names = ["fuel", "duct", "size", "age", "attic"]
    counted = {}
    for r in rows:
        if keep(r):
            place = (r["number"], r["id"], *[r[n] for n in names], r["electricity"])
            counted[place] = counted.get(place, 0) + 1
    order = sorted(counted)
    constant, *slopes = models.fitted["all", "electricity"]

    def error(found):
        total = 0.0
        for place, features in zip(order, found):
            by_name = dict(zip(names, features))
            guess = constant
            for value, (feature, label) in zip(slopes, models.terms):
                guess += value * (float(by_name[feature]) if label is None else float(by_name[feature] == label))
            total += counted[place] * (place[-1] - guess) ** 2
        return total / sum(counted.values())

    own = [list(place[2:7]) for place in order]
    base = error(own)
    result = {}
    for i, name in enumerate(names):
        moved = [[*o[:i], own[(k + 1) % len(own)][i], *o[i + 1 :]] for k, o in enumerate(own)]
        result[name] = error(moved) - base
    return result, base, sum(counted.values())


def test_importance_against_plain_displacement(spark):
    rows = homes(200)
    rows += rows[:20] * 3  # Copies move as one and count as often as they are there.
    df = spark.createDataFrame(rows, SCHEMA)
    models = linear.fit_linear(df, FEATURES, ["electricity"])
    segments = {"all": "true", "old": "age > 40"}
    arguments = (models.score, FEATURES, "electricity", ["id"], segments, 3)
    found = linear.displacement_importance(df.repartition(1), *arguments)
    again = linear.displacement_importance(df.repartition(9), *arguments)
    got = {(r["segment"], r["feature"]): r for r in found.collect()}
    for r in again.collect():
        assert r["importance"] == pytest.approx(got[r["segment"], r["feature"]]["importance"])
    for segment, keep in (("all", lambda r: True), ("old", lambda r: r["age"] > 40)):
        wanted, base, n = plain_importance(spark, df, models, keep)
        for name, value in wanted.items():
            row = got[segment, name]
            assert row["importance"] == pytest.approx(value, rel=1e-6, abs=1e-6)
            assert row["error"] == pytest.approx(base, rel=1e-6) and row["n_rows"] == n
    strength = sorted(FEATURES.categorical + FEATURES.numeric + FEATURES.flags, key=lambda f: -got["all", f]["importance"])
    assert strength[0] == "size" and strength[-1] == "duct"


def test_importance_of_odd_tables(spark):
    df = spark.createDataFrame(homes(30), SCHEMA)
    models = linear.fit_linear(df, FEATURES, ["electricity"])
    assert linear.displacement_importance(df.where("false"), models.score, FEATURES, "electricity", ["id"]).isEmpty()
    alone = linear.displacement_importance(df.where("id = 3"), models.score, FEATURES, "electricity", ["id"])
    assert {r["importance"] for r in alone.collect()} == {0.0}
    gaps = df.withColumn("electricity", F.when(F.col("id") > 9, F.col("electricity")))
    nulls = linear.displacement_importance(gaps, models.score, FEATURES, "electricity", ["id"])
    assert {r["n_rows"] for r in nulls.collect()} == {20}


def test_positions_are_dense_and_follow_from_key_and_seed(spark):
    df = spark.range(500).withColumn("other", F.lit("x"))
    once = values(splits.seeded_positions(df.repartition(1), ["id"], 4))
    assert once == values(splits.seeded_positions(df.repartition(9), ["id"], 4))
    assert sorted(r[2] for r in once) == list(range(500))
    assert once != values(splits.seeded_positions(df, ["id"], 5))
    copies = df.unionByName(df).withColumn("id", F.when(F.col("id") > 9, F.col("id")))
    assert sorted(r["position"] for r in splits.seeded_positions(copies, ["id"]).collect()) == list(range(1000))
    assert splits.seeded_positions(df.where("false"), ["id"]).isEmpty()
