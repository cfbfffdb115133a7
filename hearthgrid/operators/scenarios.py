"""Fan-out of baseline buildings over the retrofit scenarios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthgrid.functions import water_heater
from hearthgrid.functions.lookup import map_literal
from hearthgrid.operators.columns import fill_from
from hearthgrid.operators.features import fuel_presence
from hearthgrid.operators.rules import Rule, apply_stage, col, rule, stage_values
from hearthgrid.operators.vintages import SET_2022, SET_2024
from hearthgrid.session import join_settled, settle
from hearthgrid.sources.dimensions import (
    CEILING_TARGETS,
    COPS,
    HEAT_PUMP_RATINGS,
    RETENTIONS,
    ceiling_targets,
    heat_pump_curves,
    heat_pump_ratings,
    literal,
)

# Scenario id -> (name, building set whose baseline it starts from).
CATALOGUE = {
    0.0: ("Baseline", SET_2022),
    0.01: ("Baseline, no setback", SET_2024),
    1.0: ("Basic enclosure", SET_2022),
    3.0: ("Minimum-efficiency heat pump", SET_2022),
    4.0: ("High-efficiency heat pump", SET_2022),
    6.0: ("Heat pump water heater", SET_2022),
    9.0: ("Whole-home electrification and basic enclosure", SET_2022),
    11.05: ("Medium-efficiency heat pump, no setback", SET_2022),
    11.07: ("Medium-efficiency heat pump, no setback, later stock", SET_2024),
    13.01: ("Medium-efficiency heat pump, no setback, basic enclosure", SET_2022),
    13.02: ("Medium-efficiency heat pump, no setback, light air sealing", SET_2024),
    15.04: ("Cold-climate ductless heat pump, first product", SET_2024),
    15.05: ("Cold-climate ductless heat pump, second product", SET_2024),
    15.06: ("Cold-climate ductless heat pump, third product", SET_2024),
    15.08: ("Cold-climate ducted heat pump", SET_2024),
}
BASELINE_OF_SET = {SET_2022: 0.0, SET_2024: 0.01}

ENCLOSURE = (1.0, 9.0, 13.01)
AIR_SEALING = (13.02,)
# Scenario -> (heat pump with ducts, heat pump without).
BY_DUCTS = {
    3.0: ("ASHP, SEER 15, 9 HSPF", "ASHP, SEER 15, 9 HSPF"),
    4.0: ("MSHP, SEER 24, 13 HSPF", "MSHP, SEER 29.3, 14 HSPF"),
    9.0: ("MSHP, SEER 24, 13 HSPF", "MSHP, SEER 29.3, 14 HSPF"),
    11.05: ("ASHP, SEER 18, 10 HSPF", "ASHP, SEER 18, 10.5 HSPF"),
    11.07: ("ASHP, SEER 18, 10 HSPF", "ASHP, SEER 18, 10.5 HSPF"),
    13.01: ("ASHP, SEER 18, 10 HSPF", "ASHP, SEER 18, 10.5 HSPF"),
    13.02: ("ASHP, SEER 18, 10 HSPF", "ASHP, SEER 18, 10.5 HSPF"),
}
# Scenario -> (single-zone heat pump, multi-zone heat pump).
BY_SIZE = {
    15.04: ("Daikin MSHP SZ, SEER 22.05, 10.64 HSPF", "Daikin MSHP MZ, SEER 22.05, 11.2 HSPF"),
    15.05: (
        "Carrier MSHP SZ, SEER 24.255, 13.104 HSPF",
        "Carrier MSHP MZ, SEER 26.25, 10.64 HSPF",
    ),
    15.06: ("York MSHP SZ, SEER 23.625, 11.21 HSPF", "York MSHP MZ, SEER 25.36, 11.2 HSPF"),
}
# Scenario -> heat pump that only fits homes with ducts.
DUCTED_ONLY = {15.08: "Daikin 7 series ASHP, SEER 20, 10.35 HSPF"}
# Ratings (SEER 25, 12.7 HSPF) from which a ductless product is no gain.
NO_GAIN_HEATING, NO_GAIN_COOLING = 3.722, 21.875
# Duct labels the enclosure scenarios leave alone.
DUCTS_LEFT_ALONE = (
    "0% Leakage to Outside, Uninsulated",
    "30% Leakage to Outside, Uninsulated",
)
SIZED_ACCA = (3.0, 4.0, 9.0)
SIZED_HERS = (11.05, 11.07, 13.01, 13.02, 15.04, 15.05, 15.06)
NO_SETBACK = (0.01, 11.05, 11.07, 13.01, 13.02, 15.04, 15.05, 15.06, 15.08)
HEAT_PUMP_WATER_HEATER = (6.0, 9.0)
APPLIANCES = (9.0,)
SETBACKS = (
    "cooling_setpoint_offset_magnitude_degrees_f",
    "heating_setpoint_offset_magnitude_degrees_f",
)
LOOKUP_ONLY = ("insulation_wall", "water_heater_efficiency")


def _ducts() -> Column:
    return col("has_ducts")


def _ducts_improvable() -> Column:
    return _ducts() & ~col("duct_leakage_and_insulation").isin(*DUCTS_LEFT_ALONE)


def _tier(low: float, high: float | None = None, closed: bool = False):
    """Condition that infiltration lies above ``low`` and not above ``high``."""

    def holds() -> Column:
        ach = col("infiltration_ach50")
        above = ach >= low if closed else ach > low
        return above if high is None else above & (ach <= high)

    return holds


def _scaled(column: str, factor: float):
    return lambda: col(column) * factor


def envelope_rules() -> list[Rule]:
    return [
        rule(
            ENCLOSURE,
            "insulation_ceiling_r_value",
            lambda: col("ceiling_target"),
            lambda: (col("attic_type") == "Vented Attic")
            & (col("insulation_ceiling_r_value") <= col("ceiling_threshold")),
        ),
        rule(
            ENCLOSURE,
            "infiltration_ach50",
            _scaled("infiltration_ach50", 0.7),
            _tier(15, closed=True),
        ),
        rule(
            ENCLOSURE,
            "duct_leakage_percentage",
            lambda: F.least(col("duct_leakage_percentage"), F.lit(0.1)),
            _ducts_improvable,
        ),
        rule(
            ENCLOSURE,
            "duct_insulation_r_value",
            lambda: F.greatest(col("duct_insulation_r_value"), F.lit(8.0)),
            _ducts_improvable,
        ),
        rule(
            ENCLOSURE,
            "insulation_wall_r_value",
            13,
            lambda: col("insulation_wall") == "Wood Stud, Uninsulated",
        ),
        rule(AIR_SEALING, "infiltration_ach50", _scaled("infiltration_ach50", 0.6), _tier(15)),
        rule(AIR_SEALING, "infiltration_ach50", _scaled("infiltration_ach50", 0.7), _tier(10, 15)),
        rule(AIR_SEALING, "infiltration_ach50", _scaled("infiltration_ach50", 0.8), _tier(7.5, 10)),
    ]


def _ductless_gains() -> Column:
    """Homes with heating whose present equipment is below the no-gain ratings."""
    return (col("heating_fuel") != "None") & (
        (col("heating_efficiency_nominal_percentage") < NO_GAIN_HEATING)
        | (col("cooling_efficiency_eer") < NO_GAIN_COOLING)
    )


def _single_zone() -> Column:
    return (
        (col("n_bedrooms") == 1)
        | (col("sqft") <= 749)
        | ((col("n_bedrooms") == 2) & (col("sqft") <= 999))
    )


def _either(condition, yes: str, no: str):
    return lambda: F.when(condition(), F.lit(yes)).otherwise(F.lit(no))


def heat_pump_choice_rules() -> list[Rule]:
    """Choose the product from baseline columns; the curve key may differ from it."""
    rules = []
    for scenario, (ducted, ductless) in BY_DUCTS.items():
        rules += [
            rule([scenario], "hp_label", _either(_ducts, ducted, ductless)),
            rule([scenario], "hvac_heating_efficiency", ducted),
            rule([scenario], "has_ducted_heating", _ducts),
            rule([scenario], "has_ducted_cooling", _ducts),
        ]
    for scenario, (single, multi) in BY_SIZE.items():
        product = _either(_single_zone, single, multi)
        rules += [
            rule([scenario], "hp_label", product, _ductless_gains),
            rule([scenario], "hvac_heating_efficiency", product, _ductless_gains),
            rule([scenario], "hvac_heating_efficiency", ""),
            rule([scenario], "has_ducted_heating", False, _ductless_gains),
            rule([scenario], "has_ducted_cooling", False, _ductless_gains),
        ]
    for scenario, product in DUCTED_ONLY.items():
        rules += [
            rule([scenario], "hp_label", product, _ducts),
            rule([scenario], "hvac_heating_efficiency", product, _ducts),
            rule([scenario], "has_ducted_heating", True, _ducts),
            rule([scenario], "has_ducted_cooling", True, _ducts),
        ]
    return rules


def heat_pump_rules() -> list[Rule]:
    """What all heat-pump scenarios have in common, and the removal of setbacks."""
    common = {
        "heating_appliance_type": "ASHP",
        "heating_fuel": "Electricity",
        "ac_type": "Heat Pump",
        "cooled_space_percentage": 1.0,
    }
    rules = []
    for scenarios, sizing, condition in (
        (SIZED_ACCA, "ACCA", None),
        (SIZED_HERS, "HERS", None),
        (tuple(DUCTED_ONLY), "HERS", _ducts),
    ):
        rules += [rule(scenarios, column, value, condition) for column, value in common.items()]
        rules.append(rule(scenarios, "heat_pump_sizing_methodology", sizing, condition))
    return rules + [rule(NO_SETBACK, column, 0.0) for column in SETBACKS]


def water_heater_rules() -> list[Rule]:
    label = "water_heater_efficiency"
    fits = HEAT_PUMP_WATER_HEATER
    return [
        rule(fits, "water_heater_fuel", "Electricity"),
        rule(fits, label, lambda: col(label), lambda: col(label) == "Electric Tankless"),
        rule(
            fits,
            label,
            "Electric Heat Pump, 50 gal, 3.45 UEF",
            lambda: col("n_bedrooms") <= 3,
        ),
        rule(
            fits,
            label,
            "Electric Heat Pump, 66 gal, 3.35 UEF",
            lambda: col("n_bedrooms") == 4,
        ),
        rule(fits, label, "Electric Heat Pump, 80 gal, 3.45 UEF"),
    ]


def appliance_rules() -> list[Rule]:
    respecified = water_heater.specs(col("water_heater_efficiency"))
    return [
        *[
            rule(HEAT_PUMP_WATER_HEATER, name, lambda spec=spec: spec)
            for name, spec in respecified.items()
        ],
        rule(APPLIANCES, "clothes_dryer_fuel", "Electricity"),
        rule(APPLIANCES, "has_heat_pump_dryer", True),
        rule(APPLIANCES, "cooking_range_fuel", "Electricity"),
        rule(APPLIANCES, "has_induction_range", True),
    ]


def apply_scenarios(df: DataFrame) -> DataFrame:
    """Change the features of each row as its ``upgrade_id`` prescribes.

    Every row is changed on its own: three broadcast lookups of literal tables, no
    shuffle. An id outside the catalogue fails the job.
    """
    spark = df.sparkSession
    known = F.col("upgrade_id").isin(sorted(CATALOGUE))
    df = df.withColumns(
        {
            "upgrade_id": F.when(known, F.col("upgrade_id")).otherwise(
                F.raise_error(F.concat(F.lit("unknown scenario "), F.col("upgrade_id")))
            ),
            "has_heat_pump_dryer": F.lit(False),
            "infiltration_ach50": F.col("infiltration_ach50").cast("double"),
            "duct_insulation_r_value": F.col("duct_insulation_r_value").cast("double"),
            "hp_label": F.lit(None).cast("string"),
        }
    )
    # A zone without ceiling targets has no enclosure scenario.
    df = df.join(F.broadcast(ceiling_targets(spark)), "climate_zone_temp", "left").where(
        ~F.col("upgrade_id").isin(list(ENCLOSURE)) | F.col("ceiling_target").isNotNull()
    )
    df = apply_stage(df, envelope_rules()).drop("ceiling_threshold", "ceiling_target")
    df = apply_stage(df, heat_pump_choice_rules())
    df = df.join(F.broadcast(heat_pump_ratings(spark)), "hp_label", "left").withColumns(
        {
            "heating_efficiency_nominal_percentage": F.coalesce(
                "hp_heating_fraction", "heating_efficiency_nominal_percentage"
            ),
            "cooling_efficiency_eer": F.coalesce("hp_cooling_eer", "cooling_efficiency_eer"),
        }
    )
    df = df.drop("hp_label", "hp_heating_fraction", "hp_cooling_eer")
    df = apply_stage(df, heat_pump_rules())
    df = apply_stage(df, water_heater_rules())
    df = apply_stage(df, appliance_rules())
    df = df.join(F.broadcast(heat_pump_curves(spark)), "hvac_heating_efficiency", "left")
    df = fill_from(df, "heating_efficiency_nominal_percentage", COPS)
    df = df.fillna(1.0, subset=list(RETENTIONS))
    return df.withColumns(fuel_presence()).drop(*LOOKUP_ONLY)


def apply_scenario(features: DataFrame, scenario_id: float) -> DataFrame:
    """Features of all given buildings under one scenario."""
    if float(scenario_id) not in CATALOGUE:
        raise ValueError(f"unknown scenario {scenario_id}")
    return apply_scenarios(features.withColumn("upgrade_id", F.lit(float(scenario_id))))


def catalogue(spark: SparkSession, scenario_ids: Sequence[float] | None = None) -> DataFrame:
    chosen = CATALOGUE if scenario_ids is None else {float(s) for s in scenario_ids}
    rows = [(i, *CATALOGUE[i]) for i in sorted(chosen)]
    return literal(spark, rows, "upgrade_id double, upgrade_name string, building_set string")


def fan_out(features: DataFrame, scenarios: DataFrame, on: Sequence[str]) -> DataFrame:
    """One row per building and scenario of its set.

    A literal scenario table has a known size and is broadcast without being told to.
    """
    return features.join(scenarios, list(on))


def scenario_features(
    features: DataFrame, scenario_ids: Sequence[float] | None = None
) -> DataFrame:
    """Features of every building under every scenario of its building set.

    The baseline is read once: the scenario table is broadcast and the rules run on
    the multiplied rows in the same stage.
    """
    scenarios = catalogue(features.sparkSession, scenario_ids)
    return apply_scenarios(fan_out(features, scenarios, ["building_set"]))


def _before_rules() -> dict[str, Column]:
    """What rules of all scenarios read besides the row, with the limits of its climate zone."""
    limits = map_literal({zone: F.struct(*map(F.lit, pair)) for zone, pair in CEILING_TARGETS.items()})
    limit = limits[F.col("climate_zone_temp").cast("int")]
    return {
        "has_heat_pump_dryer": F.lit(False),
        "infiltration_ach50": F.col("infiltration_ach50").cast("double"),
        "duct_insulation_r_value": F.col("duct_insulation_r_value").cast("double"),
        "hp_label": F.lit(None).cast("string"),
        "ceiling_threshold": limit["col1"],
        "ceiling_target": limit["col2"],
    }


def _ratings() -> Column:
    return map_literal({label: F.struct(*map(F.lit, pair)) for label, pair in HEAT_PUMP_RATINGS.items()})


def scenario_values(
    scenario_id: float, before: dict[str, Column] | None = None, ratings: Column | None = None
) -> dict[str, Column]:
    """Columns that a scenario changes, as expressions over the baseline row.

    The same rules as :func:`apply_scenarios`, whose remaining columns follow from these.
    ``before`` and ``ratings`` are what all scenarios share, made once for many.
    """
    seen = dict(_before_rules() if before is None else before)
    seen = stage_values(envelope_rules, scenario_id, seen)
    seen = stage_values(heat_pump_choice_rules, scenario_id, seen)
    if scenario_id in (*BY_DUCTS, *BY_SIZE, *DUCTED_ONLY):
        rating = (_ratings() if ratings is None else ratings)[seen["hp_label"]]
        for name, field in (("heating_efficiency_nominal_percentage", "col1"), ("cooling_efficiency_eer", "col2")):
            seen[name] = F.coalesce(rating[field], F.col(name))
    seen = stage_values(heat_pump_rules, scenario_id, seen)
    if scenario_id in (*HEAT_PUMP_WATER_HEATER, *APPLIANCES):
        seen = stage_values(appliance_rules, scenario_id, stage_values(water_heater_rules, scenario_id, seen))
    return {n: c for n, c in seen.items() if n not in ("hp_label", "ceiling_threshold", "ceiling_target", *LOOKUP_ONLY)}


def fan_out_flagged(features: DataFrame, scenario_ids: Sequence[float] | None = None) -> DataFrame:
    """One row per building and scenario of its set, with ``applicability``: false where a
    lower scenario changes the row to the very same features.

    The variants of a row are compared inside it: an array holds, for each scenario, the
    columns that any of them changes. Nothing is shuffled and no row is multiplied before
    its scenarios are known. Rows are compared with no others, so a building is to be in
    one row; :func:`changed_scenarios` takes any.
    """
    chosen = CATALOGUE if scenario_ids is None else {float(s) for s in scenario_ids}
    ordered = sorted(chosen)
    before, ratings = _before_rules(), _ratings()
    values = {s: scenario_values(s, before, ratings) for s in ordered}
    changed = sorted({name for own in values.values() for name in own})
    kinds = {f.name: f.dataType.simpleString() for f in features.schema.fields}
    # Numbers are compared as doubles, whatever type a rule's literal has.
    kind = {n: k if (k := kinds.get(n, "boolean")) in ("string", "boolean") else "double" for n in changed}

    own = {n: F.col(n).cast(kind[n]).alias(n) for n in changed if n in kinds}

    def variant(s: float) -> Column:
        fits = F.col("building_set") == CATALOGUE[s][1]
        if s in ENCLOSURE:
            fits &= F.col("climate_zone_temp").cast("int").isin(list(CEILING_TARGETS))
        made = {n: c for n, c in values[s].items() if n not in kinds or c is not before.get(n)}
        columns = [made[n].cast(kind[n]).alias(n) if n in made else own[n] for n in changed]
        return F.when(fits, F.struct(*columns))

    rows = features.withColumn("__variants", F.array(*map(variant, ordered)))
    variants = F.col("__variants")
    scenarios = F.array(*[
        F.when(variants[i].isNotNull(), F.struct(
            F.lit(s).alias("upgrade_id"), F.lit(CATALOGUE[s][0]).alias("upgrade_name"),
            (F.array_position(variants, variants[i]) == i + 1).alias("applicability"),
        ))
        for i, s in enumerate(ordered)
    ])
    names = ["building_set", *[c for c in features.columns if c != "building_set"]]
    return rows.select(*[F.col(f"`{n}`") for n in names], F.inline(F.filter(scenarios, lambda x: x.isNotNull())))


def changed_scenarios(
    features: DataFrame,
    scenario_ids: Sequence[float] | None = None,
    key: Sequence[str] = ("building_id", "building_set"),
    unique: bool = False,
) -> DataFrame:
    """Features of every building under every scenario that changes something against all
    lower ones: :func:`drop_unchanged` of :func:`scenario_features`, without its shuffle.

    Rows whose ``key`` no other row has are compared inside themselves. ``unique`` says that
    all are such, as a keyed table guarantees; else their keys alone are counted first. Rows
    that share a key may equal each other's variants and take the aggregation.
    """
    def apart(rows: DataFrame) -> DataFrame:
        return apply_scenarios(fan_out_flagged(rows, scenario_ids).where("applicability").drop("applicability"))

    if unique:
        return apart(features)
    repeated = features.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key)
    repeated = settle(repeated, "repeated-buildings")
    if repeated.isEmpty():
        return apart(features)
    several = join_settled(features, repeated, key).select(*features.columns)
    together = drop_unchanged(scenario_features(several, scenario_ids))
    renamed = repeated.select(*[F.col(c).alias(f"__{c}") for c in key])
    alike = F.lit(True)
    for c in key:
        alike &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return apart(features.join(renamed, alike, "left_anti")).unionByName(together)


# Copies of a row that are restored at a time.
COPIES = 4096


def flag_changed(
    df: DataFrame,
    scenario_column: str = "upgrade_id",
    scenario_ids: Sequence[float] = tuple(CATALOGUE),
    name_column: str | None = "upgrade_name",
) -> DataFrame:
    """Add ``applicability``: false where a lower scenario has the very same features.

    One aggregation by all features counts the rows of every scenario of the
    catalogue. It folds on the map side, where the scenarios of a building still
    lie together, so neither many copies of a row nor a heavy building gathers in
    one task. All copies are restored after. A scenario outside the catalogue fails
    the job. ``name_column`` follows from the scenario and is looked up again.
    """
    names = name_column if name_column in df.columns else None
    compared = [c for c in df.columns if c not in (scenario_column, names)]
    known = F.when(F.col(scenario_column).isin(list(scenario_ids)), F.col(scenario_column))
    unknown = F.concat(F.lit("unknown scenario "), F.col(scenario_column).cast("string"))
    checked = df.withColumn(scenario_column, known.otherwise(F.raise_error(unknown)))
    ordered = sorted(scenario_ids)
    counted = checked.groupBy(*compared).agg(
        *[F.count_if(F.col(scenario_column) == s).alias(f"__n{i}") for i, s in enumerate(ordered)]
    )
    kind = df.schema[scenario_column].dataType
    present = {
        i: F.when(F.col(f"__n{i}") > 0, F.lit(s).cast(kind)) for i, s in enumerate(ordered)
    }
    per_scenario = [
        F.struct(c.alias(scenario_column), F.col(f"__n{i}").alias("__copies"))
        for i, c in present.items()
    ]
    first = F.coalesce(*present.values())
    rows = (
        counted.select(*compared, first.alias("__first"), F.inline(F.array(*per_scenario)))
        .where(F.col(scenario_column).isNotNull())
        .select(
            *compared,
            scenario_column,
            (F.col(scenario_column) == F.col("__first")).alias("applicability"),
            "__copies",
            # Copies come back in runs: no array of a row is longer than a run, and the
            # list of its runs is as much shorter.
            F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1, F.lit(COPIES).cast("long"))).alias("__run"),
        )
        .withColumn("__left", F.least(F.col("__copies") - F.col("__run"), F.lit(COPIES)).cast("int"))
        .withColumn("__copy", F.explode(F.array_repeat(F.lit(True), F.col("__left"))))
    )
    if names:
        labels = map_literal({i: name for i, (name, _) in CATALOGUE.items()})
        rows = rows.withColumn(names, labels[F.col(scenario_column)])
    return rows.select(*df.columns, "applicability")


def drop_unchanged(df: DataFrame, *args, **options) -> DataFrame:
    """Rows whose scenario changed something against every lower scenario.

    Takes the options of :func:`flag_changed`.
    """
    return flag_changed(df, *args, **options).where("applicability").drop("applicability")


def applicability_mismatches(
    flagged: DataFrame,
    simulated: DataFrame,
    keys: Sequence[str] = ("upgrade_id", "building_id"),
    scenario_column: str = "upgrade_id",
    ignore_scenarios: Sequence[float] = (13.01, 13.02, 11.05, 11.07),
) -> DataFrame:
    """Rows where the features and the simulation disagree about applicability."""
    keys = list(keys)
    theirs = simulated.select(*keys, F.col("applicability").alias("simulated_applicability"))
    return flagged.join(theirs, keys).where(
        (F.col("applicability") != F.col("simulated_applicability"))
        & ~F.col(scenario_column).isin(list(ignore_scenarios))
    )


def require_applicability(flagged: DataFrame, simulated: DataFrame, **options) -> None:
    mismatches = applicability_mismatches(flagged, simulated, **options).count()
    if mismatches:
        raise ValueError(f"{mismatches} rows whose applicability differs from the simulation")
