"""Leakage-free splits, down-sampling, weights and keyed lookups for training."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthgrid.functions.metrics import row_sum
from hearthgrid.operators.scenarios import BASELINE_OF_SET as BASELINES
from hearthgrid.session import settle

BUCKETS = 10_000


def key_number(keys: Sequence[str], seed: int = 42) -> Column:
    """Stable pseudo-random number of 32 bits of a key.

    Depends on the key's text and the seed only, so a building lands on the same
    side whatever the partitioning, the engine or the number of retries.
    """
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def hash_bucket(keys: Sequence[str], seed: int = 42) -> Column:
    """Stable pseudo-random number 0..9999 of a key."""
    return key_number(keys, seed) % BUCKETS


def split_name(bucket: Column, validation: float = 0.2, test: float = 0.1) -> Column:
    train_end = round((1 - validation - test) * BUCKETS)
    validation_end = round((1 - test) * BUCKETS)
    return (
        F.when(bucket < train_end, "train")
        .when(bucket < validation_end, "val")
        .otherwise("test")
    )


def with_baseline(
    df: DataFrame,
    baselines: Mapping[str, float],
    building: str = "building_id",
    building_set: str = "building_set",
    scenario: str = "upgrade_id",
) -> DataFrame:
    """Rows of buildings that have the baseline scenario of their set."""
    own = F.lit(False)
    for name, scenario_id in baselines.items():
        own = own | ((F.col(building_set) == name) & (F.col(scenario) == scenario_id))
    complete = df.where(own).select(building, building_set).distinct()
    return df.join(complete, [building, building_set], "left_semi")


def group_split(
    df: DataFrame,
    keys: Sequence[str] = ("building_set", "building_id"),
    validation: float = 0.2,
    test: float = 0.1,
    seed: int = 42,
) -> DataFrame:
    """Add ``split``: all rows of a building share one of train, val and test.

    A column expression; nothing is shuffled.
    """
    return df.withColumn("split", split_name(hash_bucket(keys, seed), validation, test))


def sample_fraction(n_wanted: float, n_rows: int, n_baseline: int, n_split_keys: int) -> float:
    """Share of buildings to keep so that a split has about ``n_wanted`` rows."""
    if not n_split_keys or not n_rows:
        return 1.0
    return min(1.0, max(0.0, n_wanted * (n_baseline / n_rows) / n_split_keys))


def down_sample(
    df: DataFrame,
    n_train: int | None = None,
    n_test: int | None = None,
    building: str = "building_id",
    building_set: str = "building_set",
    scenario: str = "upgrade_id",
    baselines: Mapping[str, float] = BASELINES,
    seed: int = 0,
) -> DataFrame:
    """Thin all splits by one fraction per building set, keeping whole buildings."""
    if n_train and n_test:
        raise ValueError("give n_train or n_test, not both")
    if not n_train and not n_test:
        return df
    wanted, name = (n_train, "train") if n_train else (n_test, "test")
    in_baseline = F.lit(False)
    for set_name, baseline in baselines.items():
        in_baseline = in_baseline | (
            (F.col(building_set) == set_name) & (F.col(scenario) == baseline)
        )
    counts = (
        df.groupBy(building_set)
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(in_baseline).alias("n_baseline"),
            F.count_if(in_baseline & (F.col("split") == name)).alias("n_split"),
        )
        .where(F.col(building_set).isin(list(baselines)))
        .collect()
    )
    n_rows = sum(r["n_rows"] for r in counts)
    # All 32 bits: buckets would round small samples of large inputs.
    position = key_number([building_set, building], seed) / float(1 << 32)
    kept = F.lit(False)
    for r in counts:
        fraction = sample_fraction(wanted, n_rows, r["n_baseline"], r["n_split"])
        kept = kept | ((F.col(building_set) == r[building_set]) & (position < fraction))
    return df.where(kept)


def baseline_weight(
    scenario_ids: Sequence[float], baseline_ids: Sequence[float], proportion: float = 0.5
) -> float:
    """Weight that gives baseline rows ``proportion`` of the total weight per scenario."""
    present = [b for b in baseline_ids if b in scenario_ids]
    if not present:
        raise ValueError("at least one baseline scenario is needed")
    return proportion * len(scenario_ids) / len(present)


def sample_weight(
    scenario: str, scenario_ids: Sequence[float], baseline_ids: Sequence[float], proportion=0.5
) -> Column:
    weight = baseline_weight(scenario_ids, baseline_ids, proportion)
    present = [b for b in baseline_ids if b in scenario_ids]
    return F.when(F.col(scenario).isin(present), weight).otherwise(1.0)


def training_targets(
    outputs: DataFrame,
    features: DataFrame,
    targets: Mapping[str, Sequence[str]],
    scenario_ids: Sequence[float],
    baselines: Mapping[str, float] = BASELINES,
) -> DataFrame:
    """Keys and summed targets of the simulated scenarios that have features."""
    missing = [b for b in baselines.values() if b not in scenario_ids]
    if missing:
        raise ValueError(f"baseline scenarios {missing} must be included")
    wanted = F.col("upgrade_id").isin([float(s) for s in scenario_ids])
    summed = outputs.where(wanted).select(
        "building_id",
        "upgrade_id",
        *[row_sum(members).alias(name) for name, members in targets.items()],
    )
    keys = features.where(wanted).select(
        "building_id", "upgrade_id", "weather_file_city", "building_set"
    )
    return keys.join(summed, ["upgrade_id", "building_id"])


def look_up_features(
    rows: DataFrame, features: DataFrame, keys: Sequence[str], names: Sequence[str]
) -> DataFrame:
    """Left lookup of feature columns by key."""
    return rows.join(features.select(*keys, *names), list(keys), "left")


def shuffled(df: DataFrame, keys: Sequence[str], seed: int) -> DataFrame:
    """Rows in a pseudo-random order that only depends on the key and the seed."""
    return df.orderBy(F.xxhash64(*[F.col(k) for k in keys], F.lit(seed)))


def dense_positions(df: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """Add the 0-based place of every row in the order of the given columns.

    Rows are sorted by range over all tasks and stored once; a row's place is its place in
    its range plus the sizes of the ranges before, one number per range. No task holds all
    rows. Rows that are alike in ``order`` share a range, so let it tell rows apart; nulls
    come first.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordered = settle(
        df.orderBy(*order).withColumns({"__range": F.spark_partition_id(), "__place": place}),
        "positions",
    )
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ordered.groupBy("__range").agg(F.count(F.lit(1)).alias("__size")).select(
        "__range", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start")
    )
    position = (F.col("__start") + F.col("__place")).alias(name)
    # One row per range, and no more ranges than shuffle partitions.
    return ordered.join(F.broadcast(starts), "__range").select(*df.columns, position)


def seeded_positions(
    df: DataFrame, keys: Sequence[str], seed: int = 42, name: str = "position"
) -> DataFrame:
    """Add a dense pseudo-random position that follows from keys and seed only.

    The same on every partitioning. Keys name a row each; of rows that share one, which
    comes first is not said.
    """
    placed = df.withColumn("__number", key_number(keys, seed))
    return dense_positions(placed, ["__number", *keys], name).drop("__number")
