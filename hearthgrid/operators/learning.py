"""Spark ML regressors per fuel: preparation, training, scoring and analysis."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import (
    OneHotEncoder,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthgrid.operators.evaluation import value_spread
from hearthgrid.operators.splits import BUCKETS, hash_bucket
from hearthgrid.session import settle

FUELS = ("electricity", "natural_gas", "fuel_oil", "propane")


def fit_label_index(df: DataFrame, column: str) -> DataFrame:
    """Alphabetical index of the labels of one column, as a table of label and index.

    Labels are sorted by range over all tasks; a label's index is its place in its range
    plus the sizes of the ranges before it. No task and no driver holds all labels.
    """
    labels = df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordered = settle(
        labels.withColumns({"__range": F.spark_partition_id(), "__place": place}), "labels"
    )
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ordered.groupBy("__range").agg(F.count(F.lit(1)).alias("__n")).select(
        "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")
    )
    index = (F.col("__start") + F.col("__place")).cast("int").alias(f"{column}_index")
    return settle(ordered.join(starts, "__range").select(column, index), "label-index")


def index_labels(mapping: DataFrame, df: DataFrame) -> DataFrame:
    """Add the integer index; rows with unknown or no labels are left out."""
    column, index = mapping.columns
    return df.drop(index).join(mapping, column).select(*df.drop(index).columns, index)


def label_table(mapping: DataFrame, first: int = 0) -> DataFrame:
    """The label-to-index mapping, counted from ``first``."""
    column, index = mapping.columns
    return mapping.select(F.col(column).alias("label"), (F.col(index) + first).alias("label_index"))


def vocabulary(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, label): the distinct labels of every string feature."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    strings = [f for f in features if isinstance(kinds[f], T.StringType)]
    if not strings:
        return df.sparkSession.createDataFrame([], "feature string, label string")
    pairs = [F.struct(F.lit(f).alias("feature"), F.col(f).alias("label")) for f in strings]
    return df.select(F.inline(F.array(*pairs))).where("label is not null").distinct()


@dataclass(frozen=True)
class FeatureSet:
    categorical: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    flags: tuple[str, ...] = ()

    @classmethod
    def of(cls, df: DataFrame, names: Sequence[str]) -> FeatureSet:
        kinds = {f.name: f.dataType for f in df.schema.fields}
        strings = tuple(n for n in names if isinstance(kinds[n], T.StringType))
        flags = tuple(n for n in names if isinstance(kinds[n], T.BooleanType))
        numeric = tuple(n for n in names if n not in strings and n not in flags)
        return cls(strings, numeric, flags)

    def as_numbers(self, df: DataFrame) -> DataFrame:
        """Numeric and flag features as doubles, labels untouched."""
        return df.withColumns(
            {n: F.col(n).cast("double") for n in (*self.numeric, *self.flags)}
        )

    def stages(self, one_hot: bool = True) -> list:
        """Index and encode labels, standardise numbers, pass flags through."""
        stages: list = []
        parts: list[str] = []
        if self.categorical:
            indexed = [f"{n}__index" for n in self.categorical]
            stages.append(
                StringIndexer(
                    inputCols=list(self.categorical),
                    outputCols=indexed,
                    stringOrderType="alphabetAsc",
                    handleInvalid="keep",
                )
            )
            if one_hot:
                encoded = [f"{n}__hot" for n in self.categorical]
                stages.append(OneHotEncoder(inputCols=indexed, outputCols=encoded))
                parts += encoded
            else:
                parts += indexed
        if self.numeric:
            stages += [
                VectorAssembler(inputCols=list(self.numeric), outputCol="__numbers"),
                StandardScaler(
                    inputCol="__numbers", outputCol="__scaled", withMean=True, withStd=True
                ),
            ]
            parts.append("__scaled")
        parts += self.flags
        stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
        return stages


@dataclass
class FuelModels:
    """One shared preparation and one regressor per target."""

    feature_set: FeatureSet
    preparation: PipelineModel
    regressors: dict[str, object]

    def score(self, rows: DataFrame, keep: Sequence[str], suffix: str = "-pred") -> DataFrame:
        """Predictions for every row, with the columns in ``keep``."""
        scored = self.preparation.transform(self.feature_set.as_numbers(rows))
        for model in self.regressors.values():
            scored = model.transform(scored)
        return scored.select(
            *keep,
            *[
                F.col(model.getPredictionCol()).alias(f"{target}{suffix}")
                for target, model in self.regressors.items()
            ],
        )


def train(
    rows: DataFrame,
    feature_set: FeatureSet,
    targets: Sequence[str],
    weight: str | None = None,
    regressor=None,
    one_hot: bool = True,
) -> FuelModels:
    """Fit one regressor per target; rows whose target is zero do not count.

    Rows are prepared once and stored, however often the regressors pass over them.
    """
    rows = feature_set.as_numbers(rows)
    preparation = Pipeline(stages=feature_set.stages(one_hot)).fit(rows)
    kept = [*targets, *([weight] if weight else []), "features"]
    prepared = settle(preparation.transform(rows).select(*kept), "prepared")
    template = regressor or GBTRegressor(maxIter=20, maxDepth=5, seed=42)
    fitted = {}
    for target in targets:
        learner = template.copy()
        learner.setLabelCol(target).setFeaturesCol("features").setPredictionCol(f"__{target}")
        if weight:
            learner.setWeightCol(weight)
        fitted[target] = learner.fit(prepared.where(F.col(target) != 0))
    return FuelModels(feature_set, preparation, fitted)


def usable_predictions(
    scored: DataFrame,
    fuels: Sequence[str] = FUELS,
    suffix: str = "-pred",
    always_present: Sequence[str] = ("electricity",),
) -> DataFrame:
    """Clip predictions at zero, blank fuels a home does not have, and add the total."""
    cleaned = {}
    for fuel in fuels:
        clipped = F.greatest(F.col(f"`{fuel}{suffix}`"), F.lit(0.0))
        cleaned[f"{fuel}{suffix}"] = (
            clipped if fuel in always_present else F.when(F.col(f"has_{fuel}_appliance"), clipped)
        )
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cleaned.values()), F.lit(0.0))
    return scored.withColumns(cleaned | {f"total{suffix}": total})


def held_out(rows: DataFrame, key: Sequence[str] | None, share: float, seed: int) -> Column:
    """Whether a row is kept for testing, by the hash of its key (or of all its columns)."""
    return hash_bucket(list(key or rows.columns), seed) < round(share * BUCKETS)


@dataclass
class Search:
    """Settings tried, their mean absolute errors on held-out rows, and the best model."""

    settings: list[dict]
    errors: list[float]
    best: object


def search(
    rows: DataFrame,
    feature_set: FeatureSet,
    target: str,
    grid: Mapping[str, Sequence],
    regressor=None,
    key: Sequence[str] | None = None,
    share: float = 0.2,
    seed: int = 42,
) -> Search:
    """Best regressor of a parameter grid by mean absolute error on held-out rows.

    Rows are held out by the hash of their key, so the same ones on every run and
    partitioning. They are prepared once and stored; all settings read that.
    """
    rows = feature_set.as_numbers(rows.where(F.col(target) != 0).withColumn("__held", held_out(rows, key, share, seed)))
    learner = (regressor or GBTRegressor(maxIter=10, seed=42)).copy()
    learner.setLabelCol(target).setFeaturesCol("features")
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(learner.getParam(name), list(values))
    settings = builder.build()
    # Labels and scales come from trained rows alone.
    preparation = Pipeline(stages=feature_set.stages()).fit(rows.where("not __held"))
    transformed = preparation.transform(rows)
    prepared = settle(transformed.select("features", target, "__held"), "prepared")
    models = learner.fit(prepared.where("not __held"), settings)
    evaluator = RegressionEvaluator(labelCol=target, metricName="mae")
    errors = [evaluator.evaluate(m.transform(prepared.where("__held"))) for m in models]
    best = min(range(len(models)), key=errors.__getitem__)
    return Search([{p.name: v for p, v in s.items()} for s in settings], errors, models[best])


@dataclass(frozen=True)
class Uniform:
    """Any value from ``low`` to ``high``."""

    low: float
    high: float

    def at(self, share: float) -> float:
        return self.low + share * (self.high - self.low)


@dataclass(frozen=True)
class LogUniform:
    """Any value from ``low`` to ``high``, every order of magnitude as likely as the others."""

    low: float
    high: float

    def at(self, share: float) -> float:
        return self.low * (self.high / self.low) ** share


@dataclass(frozen=True)
class Choice:
    """One of some values."""

    values: Sequence

    def at(self, share: float):
        return self.values[int(share * len(self.values))]


def sampled_settings(space: Mapping[str, Uniform | LogUniform | Choice], n: int, seed: int = 42) -> list[dict]:
    """``n`` settings of a described space. Each value follows from a hash of the parameter's
    name, the setting's number and the seed, so more settings do not change the first ones."""

    def share(name: str, number: int) -> float:
        return int(hashlib.md5(f"{name}|{number}|{seed}".encode()).hexdigest()[:8], 16) / 2**32

    return [{name: part.at(share(name, i)) for name, part in space.items()} for i in range(n)]


@dataclass
class Halving:
    """All settings, (rung, setting, error) of those tried, the winner's number and model."""

    settings: list[dict]
    errors: list[tuple[int, int, float]]
    winner: int
    best: object


def halving_search(
    rows: DataFrame,
    feature_set: FeatureSet,
    target: str,
    settings: Sequence[Mapping],
    regressor=None,
    key: Sequence[str] | None = None,
    rungs: int = 3,
    factor: int = 2,
    share: float = 0.2,
    seed: int = 42,
) -> Halving:
    """Best of many settings by successive halving.

    The first rung trains all settings on a small part of the rows, and each next one the best
    of ``factor`` on ``factor`` times as many; the last one has all trained rows. Parts are
    nested ranges of the hash of a row's key, so every rung adds rows to the last one's, alike
    on any partitioning. All rungs are judged on the same held-out rows, all models of a
    rung in one pass over them. Settings of equal errors stay in their order. Labels and
    scales come from trained rows alone, and rows whose target is zero or null take no part.
    """
    if not settings or rungs < 1 or factor < 2:
        raise ValueError("a search needs settings, a rung and a factor of 2 or more")
    test_end = round(share * BUCKETS)
    rows = rows.where(F.col(target) != 0).withColumn("__place", hash_bucket(list(key or rows.columns), seed))
    rows = feature_set.as_numbers(rows)
    preparation = Pipeline(stages=feature_set.stages()).fit(rows.where(F.col("__place") >= test_end))
    prepared = settle(preparation.transform(rows).select("features", target, "__place"), "prepared")
    held = prepared.where(F.col("__place") < test_end)
    learner = (regressor or GBTRegressor(maxIter=10, seed=42)).copy()
    learner.setLabelCol(target).setFeaturesCol("features")
    alive, found, models = list(range(len(settings))), [], {}
    for rung in range(rungs):
        end = test_end + -((test_end - BUCKETS) // factor ** (rungs - 1 - rung))
        part = prepared.where((F.col("__place") >= test_end) & (F.col("__place") < end))
        maps = [{learner.getParam(name): v for name, v in settings[i].items()} for i in alive]
        models = dict(zip(alive, learner.fit(part, maps)))
        scored = held
        for i, model in models.items():
            scored = model.copy({model.predictionCol: f"__p{i}"}).transform(scored)
        errors = scored.agg(*[F.avg(F.abs(F.col(f"__p{i}") - F.col(target))).alias(str(i)) for i in alive]).first()
        if errors[0] is None:
            raise ValueError("no row is held out")
        found += [(rung, i, errors[str(i)]) for i in alive]
        ranked = sorted(alive, key=lambda i: (errors[str(i)], i))
        alive = sorted(ranked[: max(1, -(-len(alive) // factor))]) if rung < rungs - 1 else ranked[:1]
    return Halving([dict(s) for s in settings], found, alive[0], models[alive[0]])


def feature_importance(
    rows: DataFrame,
    feature_set: FeatureSet,
    target: str,
    segments: Mapping[str, str],
    regressor=None,
    key: Sequence[str] | None = None,
    share: float = 0.2,
    seed: int = 42,
) -> DataFrame:
    """(segment, feature, importance, r2) of one boosted-tree model per segment.

    ``segments`` maps a name to the SQL condition of its rows. Labels are indexed
    rather than one-hot encoded, so importances belong to features. ``r2`` is that of rows
    held out by the hash of their key, among those whose target is not zero.
    """
    spark = rows.sparkSession
    names = [*feature_set.categorical, *feature_set.numeric, *feature_set.flags]
    template = regressor or GBTRegressor(maxIter=10, maxDepth=4, maxBins=256, seed=42)
    kept = rows.where(F.col(target) != 0).withColumn("__held", held_out(rows, key, share, seed))
    flags = [F.expr(condition).alias(f"__in_{i}") for i, condition in enumerate(segments.values())]
    kept = settle(kept.select(*names, target, "__held", *flags), "segments")
    evaluator = RegressionEvaluator(labelCol=target, predictionCol=f"{target}_p", metricName="r2")
    found = []
    for i, segment in enumerate(segments):
        own = kept.where(f"__in_{i}")
        models = train(own.where("not __held"), feature_set, [target], regressor=template, one_hot=False)
        scored = models.score(own.where("__held"), [target])
        r2 = evaluator.evaluate(scored.withColumnRenamed(f"{target}-pred", f"{target}_p"))
        importances = models.regressors[target].featureImportances.toArray()
        found += [(segment, name, float(v), float(r2)) for name, v in zip(names, importances)]
    return spark.createDataFrame(
        found, "segment string, feature string, importance double, r2 double"
    )


def value_grid(rows: DataFrame, feature: str, points: int = 20) -> list[float]:
    """Equally spaced values over the range of a feature."""
    low, high = rows.agg(
        F.min(feature).cast("double"), F.max(feature).cast("double")
    ).first()
    if points < 2 or low == high:
        return [low]
    return [low + (high - low) * i / (points - 1) for i in range(points)]


def what_if(
    models: FuelModels,
    rows: DataFrame,
    feature: str,
    grid: Sequence[float] | None = None,
    points: int = 20,
) -> DataFrame:
    """Spread of the total prediction at each value of one feature, all else equal."""
    values = value_grid(rows, feature, points) if grid is None else [float(v) for v in grid]
    varied = rows.withColumn(feature, F.explode(F.array(*[F.lit(v) for v in values])))
    scored = models.score(varied.withColumn("feature_value", F.col(feature)), ["feature_value"])
    predicted = [c for c in scored.columns if c != "feature_value"]
    total = sum((F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in predicted), F.lit(0.0))
    # Stored: the spread passes over the predictions several times, the models score once.
    found = settle(scored.select("feature_value", total.alias("prediction")), "swept")
    return value_spread(found, ["feature_value"], "prediction")
