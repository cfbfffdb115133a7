"""The two older scenario generations, run through the same rule stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthgrid.functions import text
from hearthgrid.operators.rules import Rule, apply_stage, rule
from hearthgrid.sources.dimensions import CEILING_TARGETS

LABEL_SCENARIOS = (0, 1, 2, 3, 4, 5)
NUMERIC_SCENARIOS = (0, 1, 3, 4, 5)
INSULATED = (1, 2)
FULL_ENCLOSURE = (2,)

# Climate zones and ceiling labels upgraded in them -> label after.
ATTIC_UPGRADES = [
    (("1A",), ("Uninsulated", "R-7", "R-13"), "R-30"),
    (
        ("2A", "2B", "3A", "3B", "3C"),
        ("Uninsulated", "R-7", "R-13", "R-19", "R-30"),
        "R-49",
    ),
    (
        ("4A", "4B", "4C", "5A", "5B", "6A", "6B", "7A", "7B"),
        ("Uninsulated", "R-7", "R-13", "R-19", "R-30", "R-38"),
        "R-60",
    ),
]
# Foundations that are crawlspaces.
CRAWLSPACES = ("Unvented Crawlspace", "Vented Crawlspace")
# Existing heat pumps that are still replaced.
WEAK_DUCTED = ("ASHP, SEER 10, 6.2 HSPF", "ASHP, SEER 13, 7.7 HSPF", "ASHP, SEER 15, 8.5 HSPF")
WEAK_DUCTLESS = {
    3: ("MSHP, SEER 14.5, 8.2 HSPF",),
    4: ("MSHP, SEER 14.5, 8.2 HSPF", "MSHP, SEER 29.3, 14 HSPF, Max Load"),
}
# Labels of the installed heat pumps.
DUCTED_AFTER = {3: "ASHP, SEER 15, 9.0 HSPF", 4: "MSHP, SEER 24, 13 HSPF"}
DUCTLESS_AFTER = {
    3: "MSHP, SEER 15, 9.0 HSPF, Max Load",
    4: "MSHP, SEER 29.3, 14 HSPF, Max Load",
}


def _is(column: str, *labels) -> Column:
    return F.col(column).isin(*labels)


def _has_heat_pump() -> Column:
    return F.coalesce(F.col("in_hvac_cooling_type").contains("Heat Pump"), F.lit(False))


def _enclosure_rules() -> list[Rule]:
    attic = [
        rule(
            INSULATED,
            "in_insulation_ceiling",
            after,
            lambda zones=zones, before=before: _is("in_ashrae_iecc_climate_zone_2004", *zones)
            & _is("in_geometry_attic_type", "Vented Attic")
            & _is("in_insulation_ceiling", *before),
        )
        for zones, before, after in ATTIC_UPGRADES
    ]

    def leaky() -> Column:
        return F.col("in_ducts_leakage") > 0

    return attic + [
        rule(
            INSULATED,
            "in_infiltration_ach50",
            lambda: F.col("in_infiltration_ach50") * 0.7,
            lambda: F.col("in_infiltration_ach50") >= 15,
        ),
        rule(INSULATED, "in_ducts_leakage", 10.0, leaky),
        rule(INSULATED, "in_ducts_insulation", "R-8", leaky),
        rule(
            INSULATED,
            "in_insulation_wall",
            "Wood Stud, R-13",
            lambda: _is("in_insulation_wall", "Wood Stud, Uninsulated"),
        ),
        rule(
            FULL_ENCLOSURE,
            "in_insulation_foundation_wall",
            "Wall R-10, Interior",
            lambda: _is("in_geometry_foundation_type", *CRAWLSPACES, "Heated Basement")
            & _is("in_insulation_foundation_wall", "Uninsulated"),
        ),
        rule(
            FULL_ENCLOSURE,
            "in_insulation_roof",
            "Finished, R-30",
            lambda: _is("in_geometry_attic_type", "Finished Attic or Cathedral Ceilings")
            & _is(
                "in_insulation_roof", "Finished, Uninsulated", "Finished, R-7", "Finished, R-13"
            ),
        ),
    ]


def _after_foundation_rules() -> list[Rule]:
    """Rules that read the foundation wall as the stage before left it.

    The rim joist asks for an uninsulated foundation wall, which the stage before
    has just insulated; the published order is kept.
    """
    return [
        rule(
            FULL_ENCLOSURE,
            "in_insulation_rim_joist",
            "R-10, Exterior",
            lambda: _is("in_geometry_foundation_type", *CRAWLSPACES, "Heated Basement")
            & _is("in_insulation_foundation_wall", "Uninsulated"),
        ),
        rule(
            FULL_ENCLOSURE,
            "in_geometry_foundation_type",
            "Unvented Crawlspace",
            lambda: _is("in_geometry_foundation_type", "Unvented Crawlspace"),
        ),
    ]


def _heat_pump_label_rules() -> list[Rule]:
    def ducted() -> Column:
        return F.col("in_hvac_has_ducts")

    def replace_ducted_3() -> Column:
        return ducted() & (~_has_heat_pump() | _is("in_hvac_heating_efficiency", *WEAK_DUCTED))

    def replace_ductless(scenario: int) -> Column:
        weak = _is("in_hvac_heating_efficiency", *WEAK_DUCTLESS[scenario])
        return ~ducted() & (~_has_heat_pump() | weak)

    choices = [
        (3, replace_ducted_3, DUCTED_AFTER[3]),
        (3, lambda: replace_ductless(3), DUCTLESS_AFTER[3]),
        (4, ducted, DUCTED_AFTER[4]),
        (4, lambda: replace_ductless(4), DUCTLESS_AFTER[4]),
        (5, None, "ASHP, SEER 15, 9.0 HSPF"),
    ]
    common = {
        "in_hvac_cooling_type": "Heat Pump",
        "in_hvac_cooling_partial_space_conditioning": "100%",
        "in_heating_fuel": "Electricity",
    }
    backup = "in_hvac_backup_heating_efficiency_nominal_percent"
    rules = []
    for scenario, condition, label in choices:
        rules.append(rule([scenario], "in_hvac_heating_efficiency", label, condition))
        rules += [rule([scenario], c, value, condition) for c, value in common.items()]
        if scenario != 5:
            rules.append(rule([scenario], backup, "100%", condition))
    return rules + [
        rule([5], backup, "100%", lambda: _is("in_hvac_cooling_type", "Heat Pump")),
        rule([5], backup, lambda: F.col("in_hvac_heating_efficiency_nominal_percent")),
        rule([5], "in_backup_heating_fuel", "Electricity"),
    ]


def label_scenarios(metadata: DataFrame) -> DataFrame:
    """Scenarios 0 to 5 on label columns, with ``eligible_for_upgrade``.

    The flag is 1 where a rule held, 0 where none did, and null for the baseline.
    """
    has_pump = _has_heat_pump()
    base = metadata.withColumns(
        {
            "in_hvac_backup_heating_efficiency_nominal_percent": F.when(
                has_pump, "100%"
            ).otherwise("None"),
            "in_backup_heating_fuel": F.when(has_pump, "Electricity").otherwise("None"),
            "in_infiltration_ach50": F.col("in_infiltration_ach50").cast("double"),
            "in_ducts_leakage": F.col("in_ducts_leakage").cast("double"),
        }
    )
    ids = F.array(*[F.lit(float(i)) for i in LABEL_SCENARIOS])
    df = base.withColumn("upgrade_id", F.explode(ids)).withColumn(
        "eligible_for_upgrade", F.when(F.col("upgrade_id") != 0, 0)
    )
    for stage in (_enclosure_rules(), _after_foundation_rules(), _heat_pump_label_rules()):
        df = apply_stage(df, stage, flag="eligible_for_upgrade")
    return df


def label_features(scenarios: DataFrame) -> DataFrame:
    """Numeric columns of the label scenarios: ages and efficiency ratings."""
    label = "in_hvac_heating_efficiency"
    cooling = F.when(
        _has_heat_pump(), F.concat(F.lit("SEER  "), text.seer(label).cast("string"))
    ).otherwise(F.col("in_hvac_cooling_efficiency"))
    return scenarios.withColumns(
        {
            "in_vintage": text.age_in("in_vintage", 2010),
            "in_ducts_leakage": F.coalesce("in_ducts_leakage", F.lit(0.0)),
            "in_geometry_stories": F.col("in_geometry_stories").cast("double"),
            "in_hvac_heating_efficiency_nominal_percent": text.heating_percent(label),
            "in_hvac_seer_rating": text.seer(label),
            "in_hvac_hspf_rating": text.hspf(label),
            "in_hvac_afue_rating": text.afue(label),
            "in_hvac_cooling_efficiency": text.rated_eer_or_99(cooling),
        }
    )


# Fixed values: (heating percent, cooling EER) of the numeric scenarios' heat pumps.
NUMERIC_RATINGS = {
    "SEER 15, 9 HSPF": (263, 13.125),
    "SEER 24, 13 HSPF": (380, 21.0),
    "SEER 29.3, 14 HSPF": (410, 25.6375),
}


def _numeric_rules() -> list[Rule]:
    def leaky() -> Column:
        return F.col("ducts_leakage") > 0

    def ducts() -> Column:
        return F.col("has_ducts") == 1

    zone = F.substring("ashrae_iecc_climate_zone", 1, 1)

    def ceiling(position: int) -> Column:
        pairs = [x for z, t in CEILING_TARGETS.items() for x in (F.lit(str(z)), F.lit(t[position]))]
        return F.create_map(*pairs)[zone]

    rules = [
        rule(
            [1],
            "insulation_ceiling_roof",
            lambda: ceiling(1).cast("double"),
            lambda: (F.col("attic_type") == "Vented Attic")
            & (F.col("insulation_ceiling_roof") <= ceiling(0)),
        ),
        rule(
            [1],
            "infiltration_ach50",
            lambda: F.col("infiltration_ach50") * 0.7,
            lambda: F.col("infiltration_ach50") >= 15,
        ),
        rule([1], "ducts_leakage", 0.1, leaky),
        rule([1], "ducts_insulation", 8.0, leaky),
        rule(
            [1],
            "insulation_wall",
            13.0,
            lambda: F.col("wall_type") == "Wood Stud, Uninsulated",
        ),
        rule([3, 4], "backup_heating_efficiency", 1.0),
        rule([5], "backup_heating_efficiency", lambda: F.col("heating_efficiency")),
        rule([3, 4, 5], "ac_type", "Heat Pump"),
        rule([3, 4, 5], "has_ac", 1),
    ]
    for scenarios, condition, name in (
        ([3, 5], None, "SEER 15, 9 HSPF"),
        ([4], ducts, "SEER 24, 13 HSPF"),
        ([4], None, "SEER 29.3, 14 HSPF"),
    ):
        heating, cooling = NUMERIC_RATINGS[name]
        rules.append(rule(scenarios, "heating_efficiency", float(heating), condition))
        rules.append(rule(scenarios, "cooling_efficiency_eer", cooling, condition))
    return rules


def numeric_scenarios(features: DataFrame, scenario_ids=NUMERIC_SCENARIOS) -> DataFrame:
    """Scenarios 0, 1, 3, 4 and 5 on numeric features; other ids are an error."""
    unknown = set(scenario_ids) - set(NUMERIC_SCENARIOS)
    if unknown:
        raise ValueError(f"unknown scenarios {sorted(unknown)}")
    numeric = (
        "insulation_ceiling_roof",
        "infiltration_ach50",
        "ducts_leakage",
        "ducts_insulation",
        "insulation_wall",
        "heating_efficiency",
        "cooling_efficiency_eer",
        "backup_heating_efficiency",
    )
    ids = F.array(*[F.lit(float(i)) for i in scenario_ids])
    df = features.withColumns({c: F.col(c).cast("double") for c in numeric})
    return apply_stage(df.withColumn("upgrade_id", F.explode(ids)), _numeric_rules())
