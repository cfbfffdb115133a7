"""Feature tables of buildings and weather, with a common city index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from hearthgrid.operators import scenarios
from hearthgrid.operators.audit import require_no_nulls, require_same_categories
from hearthgrid.operators.features import building_features
from hearthgrid.operators.learning import fit_label_index, index_labels
from hearthgrid.operators.weather import weather_arrays
from hearthgrid.session import settle
from hearthgrid.sources.tables import save_keyed

WEATHER_FEATURES = ("temp_air", "wind_speed", "ghi", "weekend")
BUILDING_KEYS = ("building_id", "upgrade_id", "weather_file_city")


def changed_scenarios(metadata: DataFrame) -> DataFrame:
    """Features of every building under every scenario that changes something."""
    return scenarios.changed_scenarios(building_features(metadata))


def feature_tables(
    metadata: DataFrame, hourly: DataFrame, variables: Sequence[str] = WEATHER_FEATURES
) -> tuple[DataFrame, DataFrame]:
    """(building features, weather arrays), both with ``weather_file_city_index``.

    Both are settled once: the index is read off the one-row-per-city arrays, and
    the audit shares its computation with the tables written afterwards.
    """
    weather = settle(weather_arrays(hourly, variables), "weather-arrays")
    indexer = fit_label_index(weather.select("weather_file_city"), "weather_file_city")
    buildings = settle(index_labels(indexer, changed_scenarios(metadata)), "features")
    return require_no_nulls(buildings), index_labels(indexer, weather)


def write_feature_tables(
    buildings: DataFrame, weather: DataFrame, buildings_name: str, weather_name: str
) -> None:
    save_keyed(buildings, buildings_name, BUILDING_KEYS)
    save_keyed(weather, weather_name, ["weather_file_city"])


def sampled_features(
    metadata: DataFrame, training_features: DataFrame, weather: DataFrame
) -> DataFrame:
    """Baseline features of sampled buildings, checked against the training features."""
    features = settle(building_features(metadata), "sampled-features")
    reference = training_features.where("upgrade_id = 0.01")
    require_same_categories(reference, features, exclude=["building_set"])
    indexer = fit_label_index(weather.select("weather_file_city"), "weather_file_city")
    return index_labels(indexer, require_no_nulls(features))
