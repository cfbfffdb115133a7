"""Linear models of many targets and segments from one aggregation of their rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthgrid.operators.learning import FeatureSet, vocabulary
from hearthgrid.operators.splits import dense_positions, key_number
from hearthgrid.session import settle

EVERYTHING = {"all": "true"}


def in_segments(rows: DataFrame, segments: Mapping[str, str]) -> DataFrame:
    """Rows once for each segment they belong to, named in ``segment``.

    ``segments`` maps a name to the SQL condition of its rows; a column named ``segment`` is
    replaced after the conditions are read. Rows of no segment are left out. Nothing is
    shuffled.
    """
    names = [F.when(F.expr(condition), F.lit(name)) for name, condition in segments.items()]
    return rows.withColumn("segment", F.explode(F.array_compact(F.array(*names))))


@dataclass(frozen=True)
class LinearModels:
    """Coefficients of every segment and target.

    ``terms`` are (feature, label) pairs, with no label for numbers and flags. A segment
    and target without rows to learn from has no coefficients: its predictions are null.
    """

    terms: tuple[tuple[str, str | None], ...]
    targets: tuple[str, ...]
    fitted: Mapping[tuple[str, str], tuple[float, ...]]

    def prediction(self, target: str, segment: str = "all") -> Column:
        """Null where a number or flag is null. Unknown labels and null add nothing."""
        found = self.fitted.get((segment, target))
        if found is None:
            return F.lit(None).cast("double")
        total = F.lit(found[0])
        for value, term in zip(found[1:], self.terms):
            total = total + _term(*term) * F.lit(value)
        return total

    def score(
        self,
        rows: DataFrame,
        keep: Sequence[str],
        suffix: str = "-pred",
        segment: str | None = None,
    ) -> DataFrame:
        """Predictions next to the columns in ``keep``.

        ``segment`` names a column with the segment whose model a row takes; without it
        rows take the model of the segment ``all``.
        """
        segments = sorted({name for name, _ in self.fitted})
        predictions = []
        for target in self.targets:
            if segment is None:
                found = self.prediction(target)
            else:
                found = F.lit(None).cast("double")
                for name in segments:
                    found = F.when(F.col(segment) == name, self.prediction(target, name)).otherwise(found)
            predictions.append(found.alias(f"{target}{suffix}"))
        return rows.select(*keep, *predictions)


def _term(feature: str, label: str | None) -> Column:
    column = F.col(f"`{feature}`")
    if label is None:
        return column.cast("double")
    return F.when(column == label, 1.0).otherwise(0.0)


def fit_linear(
    rows: DataFrame,
    feature_set: FeatureSet,
    targets: Sequence[str],
    weight: str | None = None,
    segments: Mapping[str, str] = EVERYTHING,
    max_labels: int = 100,
) -> LinearModels:
    """Least squares of every target in every segment, from one pass over the rows.

    A segment's sums of products of terms and targets are all the fit needs. They fold on
    the map side, so one row per segment and task is shuffled, however many rows, segments
    and targets there are. Rows count for a target where it is neither null nor zero, no
    number or flag is null, and the weight is above zero. Where terms depend on each other
    the coefficients of least length are taken, so each label has a term of its own.

    The number of sums grows with the square of the terms: meant for some dozen of them.
    A feature of more than ``max_labels`` labels is refused, which bounds the sums and what
    the driver solves. Numbers whose mean is far more than a million times their spread
    lose digits; shift them first. Empty tables give models without coefficients.
    """
    labels = _labels(rows, feature_set, max_labels)
    terms = tuple((f, label) for f in feature_set.categorical for label in labels[f])
    terms += tuple((f, None) for f in (*feature_set.numeric, *feature_set.flags))
    complete = F.lit(True)
    for name in (*feature_set.numeric, *feature_set.flags):
        complete = complete & F.col(f"`{name}`").isNotNull()
    plain = in_segments(rows, segments).select(
        "segment",
        F.when(complete, F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)).alias("__weight"),
        *[F.col(f"`{t}`").cast("double").alias(f"__y{k}") for k, t in enumerate(targets)],
        *[_term(*term).alias(f"__x{i}") for i, term in enumerate(terms, 1)],
    )
    counted = plain.where("__weight > 0").withColumn("__x0", F.lit(1.0))
    pairs = [
        (i, j)
        for i in range(len(terms) + 1)
        for j in range(i, len(terms) + 1)
        if not _exclude_each_other(terms, i, j)
    ]
    sums = []
    for k in range(len(targets)):
        y = F.col(f"__y{k}")
        w = F.when(y.isNotNull() & (y != 0), F.col("__weight"))
        sums += [F.sum(w * F.col(f"__x{i}") * F.col(f"__x{j}")).alias(f"s{k}_{i}_{j}") for i, j in pairs]
        sums += [F.sum(w * F.col(f"__x{i}") * y).alias(f"t{k}_{i}") for i in range(len(terms) + 1)]
    fitted = {}
    for row in counted.groupBy("segment").agg(*sums).collect():
        for k, target in enumerate(targets):
            if row[f"s{k}_0_0"] is None:
                continue
            products = np.zeros((len(terms) + 1, len(terms) + 1))
            for i, j in pairs:
                products[i, j] = products[j, i] = row[f"s{k}_{i}_{j}"]
            with_target = np.array([row[f"t{k}_{i}"] for i in range(len(terms) + 1)])
            fitted[row["segment"], target] = _solve(products, with_target)
    return LinearModels(terms, tuple(targets), fitted)


def _labels(rows: DataFrame, feature_set: FeatureSet, most: int) -> dict[str, list[str]]:
    labels: dict[str, list[str]] = {f: [] for f in feature_set.categorical}
    if labels:
        allowed = most * len(labels) + 1
        for feature, label in vocabulary(rows, feature_set.categorical).limit(allowed).collect():
            labels[feature].append(label)
    for feature, found in labels.items():
        if len(found) > most:
            raise ValueError(f"{feature} has more than {most} labels")
    return {feature: sorted(found) for feature, found in labels.items()}


def _exclude_each_other(terms: Sequence[tuple[str, str | None]], i: int, j: int) -> bool:
    """Whether two terms are labels of one feature, of which a row has one at most."""
    if i == 0 or i == j:
        return False
    (feature, label), (other, other_label) = terms[i - 1], terms[j - 1]
    return feature == other and label is not None and other_label is not None


def _solve(products: np.ndarray, with_target: np.ndarray) -> tuple[float, ...]:
    """Constant and coefficients, solved on centred and scaled terms."""
    n = products[0, 0]
    means = products[0, 1:] / n
    spread = products[1:, 1:] / n - np.outer(means, means)
    with_y = with_target[1:] / n - means * with_target[0] / n
    size = np.sqrt(np.clip(np.diag(spread), 0, None))
    # A term of one value has rounding left for its spread; it adds nothing.
    varies = size > 1e-7 * np.sqrt(np.diag(products)[1:] / n)
    scale = np.where(varies, size, 1.0)
    inverse = np.linalg.pinv((spread / np.outer(scale, scale)) * np.outer(varies, varies), rcond=1e-9, hermitian=True)
    slopes = inverse @ (with_y / scale * varies) / scale
    return (float(with_target[0] / n - slopes @ means), *map(float, slopes))


def displacement_importance(
    rows: DataFrame,
    score,
    feature_set: FeatureSet,
    target: str,
    key: Sequence[str],
    segments: Mapping[str, str] = EVERYTHING,
    seed: int = 42,
) -> DataFrame:
    """(segment, feature, importance, error, n_rows): what a model loses without a feature.

    ``error`` is a segment's mean squared error, ``importance`` how much it grows when every
    row takes the feature's value of the next row of its segment, in an order that follows
    from the hash of the key (the last row takes the first one's). All features and segments
    are scored in one pass: ``score(rows, keep)`` gets the rows, with ``segment``, once for
    each feature and returns ``keep`` and the prediction ``<target>-pred``, as
    :meth:`FuelModels.score` does. Pass rows that the model has not seen.

    Rows alike in key, features and target are displaced as one and weighted by their number, so
    copies meet in no single task. Rows whose target or prediction is null do not count.
    """
    names = [*feature_set.categorical, *feature_set.numeric, *feature_set.flags]
    own = [F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(key)]
    keys = [f"__k{i}" for i in range(len(key))]
    used = in_segments(rows, segments).select(
        "segment", key_number(list(key), seed).alias("__number"), *own, *names,
        F.col(f"`{target}`").cast("double").alias("__target"),
    )
    used = used.where("__target is not null")
    distinct = used.groupBy(*used.columns).agg(F.count(F.lit(1)).alias("__n"))
    order = ["segment", "__number", *keys, *names, "__target"]
    placed = settle(dense_positions(distinct, order, "__position").drop("__number", *keys), "placed")
    sizes = placed.groupBy("segment").agg(
        F.min("__position").alias("__first"), F.max("__position").alias("__last")
    )
    after = F.when(F.col("__position") == F.col("__last"), F.col("__first")).otherwise(
        F.col("__position") + 1
    )
    following = placed.select(
        F.col("__position").alias("__after"), F.struct(*names).alias("__next")
    )
    # One row per segment.
    paired = placed.join(F.broadcast(sizes), "segment").withColumn("__after", after).join(following, "__after")
    variants = [F.struct(F.lit(None).cast("string").alias("feature"), *names)]
    for name in names:
        taken = [F.col(f"__next.{n}").alias(n) if n == name else F.col(n) for n in names]
        variants.append(F.struct(F.lit(name).alias("feature"), *taken))
    varied = paired.select("segment", "__target", "__n", F.inline(F.array(*variants)))
    scored = score(varied, ["segment", "feature", "__target", "__n"])
    off = F.col("__target") - F.col(f"`{target}-pred`")
    counted = F.when(off.isNotNull(), F.col("__n"))
    errors = scored.groupBy("segment", "feature").agg(
        (F.sum(off * off * F.col("__n")) / F.sum(counted)).alias("__error"),
        F.sum(counted).alias("n_rows"),
    )
    whole = Window.partitionBy("segment")
    base = F.max(F.when(F.col("feature").isNull(), F.col("__error"))).over(whole)
    return (
        errors.withColumn("error", base)
        .where("feature is not null")
        .select(
            "segment", "feature", (F.col("__error") - F.col("error")).alias("importance"), "error", "n_rows"
        )
    )
