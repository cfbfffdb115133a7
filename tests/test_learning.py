from __future__ import annotations

import pytest
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import functions as F

from hearthgrid.operators import learning, splits
from tests.conftest import values


def rows(spark, n=200):
    return spark.range(n).select(
        F.col("id").cast("int").alias("building_id"),
        F.when(F.col("id") % 2 == 0, "ResStock 2022.1").otherwise("ResStock 2024.2").alias("building_set"),
        F.explode(F.array(F.lit(0.0), F.lit(0.01), F.lit(3.0))).alias("upgrade_id"),
    ).where("upgrade_id = 3 or (building_set = 'ResStock 2022.1') = (upgrade_id = 0)")


def test_split_does_not_depend_on_the_partitioning(spark):
    a = splits.group_split(rows(spark).repartition(1))
    b = splits.group_split(rows(spark).repartition(13))
    assert values(a) == values(b)
    assert a.select("building_set", "building_id", "split").distinct().count() == 200
    shares = {r["split"]: r["count"] / 400 for r in a.groupBy("split").count().collect()}
    assert shares["train"] == pytest.approx(0.7, abs=0.1)
    assert shares["val"] == pytest.approx(0.2, abs=0.1)


def test_buildings_without_baseline_are_left_out(spark):
    df = rows(spark).where("building_id <> 4 or upgrade_id = 3")
    kept = splits.with_baseline(df, splits.BASELINES)
    assert kept.where("building_id = 4").count() == 0 and kept.count() == 398


def test_down_sampling(spark):
    split = splits.group_split(rows(spark))
    with pytest.raises(ValueError, match="not both"):
        splits.down_sample(split, n_train=1, n_test=1)
    assert splits.down_sample(split).count() == split.count()
    assert splits.down_sample(split, n_train=10_000).count() == split.count()
    few = splits.down_sample(split, n_train=100)
    assert 0 < few.where("split = 'train'").count() < split.where("split = 'train'").count()
    whole = few.groupBy("building_set", "building_id").count().where("count <> 2")
    assert whole.isEmpty()


def test_shuffling_depends_on_key_and_seed_only(spark):
    df = spark.range(50)
    once = [r["id"] for r in splits.shuffled(df, ["id"], 1).collect()]
    again = [r["id"] for r in splits.shuffled(df.repartition(9), ["id"], 1).collect()]
    other = [r["id"] for r in splits.shuffled(df, ["id"], 2).collect()]
    assert once == again and once != other and sorted(once) == list(range(50))


def test_community_of_a_county(spark):
    from hearthgrid.plans.model import community

    df = spark.createDataFrame([("G4200030",), ("G0800310",), ("G9900010",)], "county string")
    assert [r[0] for r in df.select(community()).collect()] == ["Pittsburgh", "Denver", None]


def test_weights(spark):
    assert splits.baseline_weight([0.0, 0.01, 1.0, 3.0], [0.0, 0.01]) == 1.0
    with pytest.raises(ValueError, match="baseline"):
        splits.baseline_weight([1.0], [0.0])
    df = spark.createDataFrame([(0.0,), (3.0,)], "upgrade_id double")
    weight = splits.sample_weight("upgrade_id", [0.0, 1.0, 3.0], [0.0, 0.01])
    assert [r[0] for r in df.select(weight).collect()] == [1.5, 1.0]


def test_targets_need_all_baselines(spark):
    with pytest.raises(ValueError, match="baseline"):
        splits.training_targets(rows(spark), rows(spark), {}, [0.0])


def test_label_index(spark):
    df = spark.createDataFrame([("banana",), ("apple",), ("cherry",), ("apple",)], "fruit string")
    indexer = learning.fit_label_index(df, "fruit")
    assert set(values(learning.index_labels(indexer, df))) == {
        ("apple", 0), ("banana", 1), ("cherry", 2),
    }
    unknown = spark.createDataFrame([("plum",), ("apple",)], "fruit string")
    assert values(learning.index_labels(indexer, unknown)) == [("apple", 0)]
    assert values(learning.label_table(indexer, first=1)) == [
        ("apple", 1), ("banana", 2), ("cherry", 3),
    ]


def test_vocabulary(spark):
    df = spark.createDataFrame([("x", 1), ("y", 2), (None, 3)], "a string, b int")
    assert values(learning.vocabulary(df, ["a", "b"])) == [("a", "x"), ("a", "y")]


def homes(spark):
    return spark.range(300).select(
        (F.col("id") % 10).cast("int").alias("size"),
        F.when(F.col("id") % 3 == 0, "old").otherwise("new").alias("kind"),
        (F.col("id") % 2 == 0).alias("has_ducts"),
        (10.0 + 5 * (F.col("id") % 10) + F.when(F.col("id") % 3 == 0, 7).otherwise(0)).alias("electricity"),
        F.when(F.col("id") % 2 == 0, 3.0 * (F.col("id") % 10)).otherwise(0.0).alias("propane"),
        F.when(F.col("id") % 2 == 0, 1.0).otherwise(2.0).alias("w"),
    )


def test_feature_set_of_schema(spark):
    assert learning.FeatureSet.of(homes(spark), ["kind", "size", "has_ducts"]) == (
        learning.FeatureSet(("kind",), ("size",), ("has_ducts",))
    )


def test_training_and_scoring(spark):
    features = learning.FeatureSet(("kind",), ("size",), ("has_ducts",))
    models = learning.train(
        homes(spark), features, ["electricity", "propane"], weight="w", regressor=LinearRegression()
    )
    scored = models.score(homes(spark), ["electricity", "propane"])
    off = scored.agg(F.max(F.abs(F.col("electricity") - F.col("`electricity-pred`")))).first()[0]
    assert off < 1e-6
    # Zero targets are not learned from, so the fitted homes alone decide the slope.
    sized = scored.where("propane > 0").agg(
        F.max(F.abs(F.col("propane") - F.col("`propane-pred`")))
    ).first()[0]
    assert sized < 1e-6


def test_usable_predictions(spark):
    df = spark.createDataFrame(
        [(-1.0, 5.0, True), (2.0, 5.0, False), (2.0, 5.0, None)],
        "`electricity-pred` double, `propane-pred` double, has_propane_appliance boolean",
    )
    usable = learning.usable_predictions(df, ["electricity", "propane"])
    assert values(usable, "`electricity-pred`", "`propane-pred`", "`total-pred`") == [
        (0.0, 5.0, 5.0), (2.0, None, 2.0), (2.0, None, 2.0),
    ]


def test_what_if(spark):
    features = learning.FeatureSet(numeric=("size",))
    models = learning.train(homes(spark), features, ["propane"], regressor=LinearRegression())
    assert learning.value_grid(homes(spark), "size", 4) == [0.0, 3.0, 6.0, 9.0]
    swept = learning.what_if(models, homes(spark), "size", grid=[1.0, 2.0])
    found = {r["feature_value"]: r for r in swept.collect()}
    assert found[2.0]["mean_prediction"] == pytest.approx(6.0, abs=1e-6)
    assert found[1.0]["median_prediction"] == pytest.approx(3.0, abs=1e-6)


def test_what_if_scores_each_row_once(spark):
    models = learning.train(
        homes(spark), learning.FeatureSet(numeric=("size",)), ["propane"], regressor=LinearRegression()
    )
    swept = learning.what_if(models, homes(spark), "size", grid=[1.0, 2.0])
    # The passes of the spread read stored predictions; no model is left in its plan.
    assert "UDF" not in swept._jdf.queryExecution().optimizedPlan().toString()


def test_importance_names_the_feature_that_matters(spark):
    features = learning.FeatureSet(("kind",), ("size",), ())
    df = homes(spark).withColumns({"cost": 5.0 * F.col("size") + 1, "id": F.monotonically_increasing_id()})
    found = learning.feature_importance(
        df, features, "cost", {"all": "true"}, GBTRegressor(maxIter=3, maxDepth=3, seed=1), key=["id"]
    )
    best = found.orderBy(F.desc("importance")).first()
    assert (best["segment"], best["feature"]) == ("all", "size") and best["r2"] > 0.9


def test_search(spark):
    found = learning.search(
        homes(spark),
        learning.FeatureSet(("kind",), ("size",), ()),
        "electricity",
        {"regParam": [0.0, 100.0]},
        regressor=LinearRegression(),
    )
    assert found.errors[0] < found.errors[1] and found.settings[0] == {"regParam": 0.0}


def test_settings_of_a_space():
    space = {"a": learning.Uniform(2, 4), "b": learning.LogUniform(1e-3, 10), "c": learning.Choice(["x", "y"])}
    many = learning.sampled_settings(space, 400)
    assert many[:5] == learning.sampled_settings(space, 5) != learning.sampled_settings(space, 5, seed=1)
    assert all(2 <= s["a"] < 4 and 1e-3 <= s["b"] < 10 and s["c"] in "xy" for s in many)
    # Half of the draws lie below the middle of each part; that of the second one is 0.1.
    for below in (sum(s["a"] < 3 for s in many), sum(s["b"] < 0.1 for s in many), sum(s["c"] == "x" for s in many)):
        assert 150 < below < 250


def _line(spark):
    noise = F.pmod(F.xxhash64("id"), 11)
    return spark.range(600).select("id", (F.col("id") % 30).alias("size"), (3.0 * (F.col("id") % 30) + noise + 1).alias("cost"))


def _halved(df, settings, **given):
    features = learning.FeatureSet(numeric=("size",))
    return learning.halving_search(df, features, "cost", settings, LinearRegression(), key=["id"], **given)


def test_halving(spark):
    settings = [{"regParam": v} for v in (500.0, 1.0, 0.0, 50.0, 1.0)]
    found = _halved(_line(spark), settings)
    tried = [[i for rung, i, _ in found.errors if rung == n] for n in range(3)]
    assert tried[0] == [0, 1, 2, 3, 4] and len(tried[1]) == 3 and len(tried[2]) == 2
    assert set(tried[2]) <= set(tried[1]) and 0 not in tried[1]
    last = {i: e for rung, i, e in found.errors if rung == 2}
    assert found.winner == min(last, key=lambda i: (last[i], i))
    assert found.best.getOrDefault("regParam") == settings[found.winner]["regParam"]
    # Equal settings have equal errors, and the first one stays.
    first = {i: e for rung, i, e in found.errors if rung == 0}
    assert first[1] == first[4]


def test_halving_is_alike_on_any_partitioning(spark):
    settings = learning.sampled_settings({"regParam": learning.LogUniform(0.1, 1000)}, 6)
    one, many = (_halved(_line(spark).repartition(n), settings, rungs=2, factor=3) for n in (1, 7))
    assert one.winner == many.winner
    for (a, i, e), (b, j, f) in zip(one.errors, many.errors, strict=True):
        assert (a, i) == (b, j) and e == pytest.approx(f)


def test_halving_keeps_rungs_nested_and_held_rows_apart(spark):
    """The parts rungs train on grow, and none has a held-out row."""
    parts = []

    class Spy(LinearRegression):
        def copy(self, extra=None):
            return self

        def fit(self, dataset, params=None):
            # A rung's settings come as a list; each of them is fitted by a call of its own.
            if isinstance(params, list):
                parts.append({r["__place"] for r in dataset.select("__place").distinct().collect()})
            return super().fit(dataset, params)

    features = learning.FeatureSet(numeric=("size",))
    learning.halving_search(_line(spark), features, "cost", [{"regParam": 0.0}, {"regParam": 1.0}], Spy(), key=["id"])
    assert len(parts) == 3 and parts[0] < parts[1] < parts[2] and min(parts[2]) >= 2000


def test_halving_without_rows_or_settings(spark):
    with pytest.raises(ValueError, match="settings"):
        _halved(_line(spark), [])
    with pytest.raises(ValueError, match="held out"):
        _halved(_line(spark), [{"regParam": 0.0}], share=0.0)
