"""Training rows, fuel models, scored test rows and the error report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthgrid.functions.lookup import gisjoin_to_geoid, look_up
from hearthgrid.operators.evaluation import (
    ATTRIBUTES,
    KEYS,
    errors_by_fuel,
    metric_report,
    with_baselines,
)
from hearthgrid.operators.learning import FUELS, FeatureSet, FuelModels, train, usable_predictions
from hearthgrid.operators.scenarios import BASELINE_OF_SET, CATALOGUE
from hearthgrid.operators.splits import (
    down_sample,
    group_split,
    look_up_features,
    sample_weight,
    training_targets,
    with_baseline,
)
from hearthgrid.operators.weather import weather_summary
from hearthgrid.session import settle

# Fuel -> output columns it is the sum of.
TARGETS = {fuel: (f"out_{fuel}_total_energy_consumption_kwh",) for fuel in FUELS}


def split_rows(
    outputs: DataFrame,
    features: DataFrame,
    targets: Mapping[str, Sequence[str]] = TARGETS,
    scenario_ids: Sequence[float] = tuple(CATALOGUE),
    n_train: int | None = None,
    n_test: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Keys, targets and ``split`` of all simulated rows with features."""
    rows = training_targets(outputs, features, targets, scenario_ids)
    rows = group_split(with_baseline(rows, BASELINE_OF_SET), seed=seed)
    return down_sample(rows, n_train, n_test)


def model_rows(
    split: DataFrame, features: DataFrame, hourly: DataFrame, names: Sequence[str]
) -> DataFrame:
    """Rows with building features and the weather summary of their city.

    The summary has one row per city. The hourly arrays never meet the buildings.
    """
    keys = ["building_id", "upgrade_id", "weather_file_city"]
    rows = look_up_features(split, features, keys, names)
    summary = weather_summary(hourly)
    return rows.join(settle(summary, "weather-summary"), "weather_file_city", "left")


# Communities and the codes of their counties.
COMMUNITIES = {
    "Pittsburgh": ("42003", "42007"),
    "Rhode Island": ("44001", "44003", "44005", "44007", "44009"),
    "Atlanta": ("13121", "13089", "13067", "13135", "13063"),
    "Denver": ("08001", "08031", "08059", "08005", "08013", "08014", "08035"),
}


def community(county: str = "county") -> Column:
    """Community of a county code; null outside of all communities."""
    of_geoid = {geoid: name for name, geoids in COMMUNITIES.items() for geoid in geoids}
    return look_up(gisjoin_to_geoid(county), of_geoid)


def savings_rows(
    features: DataFrame,
    savings: DataFrame,
    metadata: DataFrame,
    targets: Sequence[str],
    extra: Sequence[str],
) -> DataFrame:
    """Baseline features, savings and further metadata of each building, with its community.

    Homes that already have a heat pump and mobile homes are left out.
    """
    homes = features.where(
        (F.col("heating_appliance_type") != "ASHP") & ~F.col("is_mobile_home")
    )
    named = metadata.select("building_id", *extra, community().alias("community"))
    return homes.join(savings.select("building_id", *targets), "building_id").join(
        named, "building_id"
    )


def train_models(
    rows: DataFrame, names: Sequence[str], scenario_ids: Sequence[float], **options
) -> FuelModels:
    """One regressor per fuel, fitted to settled training rows."""
    weight = sample_weight("upgrade_id", scenario_ids, list(BASELINE_OF_SET.values()))
    training = settle(rows.where("split = 'train'").withColumn("weight", weight), "training")
    return train(training, FeatureSet.of(training, names), FUELS, weight="weight", **options)


def score_rows(models: FuelModels, rows: DataFrame) -> DataFrame:
    """Usable predictions next to the keys, targets and appliance attributes."""
    flags = [f"has_{fuel}_appliance" for fuel in FUELS if fuel != "electricity"]
    keep = [*KEYS, *FUELS, *ATTRIBUTES, *flags]
    return usable_predictions(models.score(rows, keep)).drop(*flags)


def evaluate(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(errors of every row and fuel, report).

    Scored rows are settled because their baselines are taken from a second reading,
    and rows with baselines because the report passes over them more than once.
    """
    based = settle(with_baselines(settle(scored, "scored"), FUELS), "based")
    errors = errors_by_fuel(based, FUELS)
    return errors, metric_report(errors)
