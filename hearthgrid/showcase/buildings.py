"""Queries on building features and retrofit scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthgrid.operators import older_scenarios, scenarios, vintages
from hearthgrid.operators.audit import require_key
from hearthgrid.operators.features import building_features as feature_job
from hearthgrid.operators.features import fuel_presence
from hearthgrid.operators.columns import fill_from
from hearthgrid.operators.rules import apply_stage, rule
from hearthgrid.functions.lookup import relabel
from hearthgrid.operators.evaluation import savings_by_building
from hearthgrid.plans.extract import building_metadata, sampled_metadata
from hearthgrid.plans.model import savings_rows
from hearthgrid.showcase.base import Registry, table
from hearthgrid.showcase.buildings_sql import (
    ALIGNED_WITH,
    ELIGIBLE,
    FEATURES_WITH,
    UPGRADED_WITH,
)
from hearthgrid.showcase.stock import (
    BOTH,
    derived_columns,
    duckdb_pick,
    raw_metadata,
    raw_metadata_sql,
    spark_pick,
)
from hearthgrid.sources.dimensions import ceiling_targets, literal

registry = Registry()


def aligned(spark: SparkSession, folder: str) -> DataFrame:
    return building_metadata(raw_metadata(spark, folder, 2022), raw_metadata(spark, folder, 2024))


def features(spark: SparkSession, folder: str) -> DataFrame:
    return feature_job(aligned(spark, folder))


def upgraded(spark: SparkSession, folder: str) -> DataFrame:
    return scenarios.scenario_features(features(spark, folder))


@registry.add(
    f"WITH raw AS ({raw_metadata_sql(2022, every=True)} ) SELECT building_id, heating_fuel, vintage, sqft "
    f"FROM raw WHERE {ELIGIBLE}"
)
def eligibility_filter(spark, folder):
    homes = vintages.clean_metadata(raw_metadata(spark, folder, 2022, every=True))
    return homes.select("building_id", "heating_fuel", "vintage", "sqft")


@registry.add(
    f"WITH raw AS ({raw_metadata_sql(2022, every=True)}), marked AS (SELECT *, "
    "list_extract(['No','No','No','Yes'], cast(building_id % 4 as integer) + 1) AS has_pv FROM raw) "
    "SELECT geometry_foundation_type, count(*) AS n_homes FROM marked "
    "WHERE geometry_building_type_acs = 'Single-Family Detached' AND occupants <> '10+' "
    "AND geometry_stories <= '5' AND cast(sqft AS double) < 8000 "
    "AND hvac_heating_efficiency NOT IN ('Other', 'Shared Heating') "
    "AND hvac_cooling_efficiency <> 'Shared Cooling' AND has_pv = 'No' GROUP BY ALL"
)
def eligibility_detached(spark, folder):
    raw = vintages.edit_columns(raw_metadata(spark, folder, 2022, every=True), strip=("in__",))
    marked = raw.withColumn("has_pv", F.when(F.col("bldg_id") % 4 == 3, "Yes").otherwise("No"))
    homes = marked.where(vintages.eligible_detached_homes())
    return homes.groupBy("geometry_foundation_type").agg(F.count(F.lit(1)).alias("n_homes"))


ALIGNED_COLUMNS = (
    "building_id",
    "building_set",
    "clothes_dryer",
    "clothes_washer",
    "cooking_range",
    "dishwasher",
    "refrigerator",
    "duct_leakage_and_insulation",
    "duct_location",
    "water_heater_location",
    "misc_hot_tub_spa",
    "misc_pool_heater",
    "hvac_cooling_type",
    "hvac_cooling_efficiency",
    "hvac_heating_type_and_fuel",
    "tenure",
)


@registry.add(f"{ALIGNED_WITH} SELECT {', '.join(ALIGNED_COLUMNS)} FROM aligned")
def vintage_align_union(spark, folder):
    return aligned(spark, folder).select(*ALIGNED_COLUMNS)


@registry.add(f"{FEATURES_WITH} SELECT * FROM features")
def building_features(spark, folder):
    return features(spark, folder)


@registry.add(f"{UPGRADED_WITH} SELECT * FROM upgraded")
def scenario_features(spark, folder):
    return upgraded(spark, folder)


# Every column that a scenario can change, which with the building identifies its features.
CHANGEABLE = (
    "building_id, building_set, hvac_heating_efficiency, heating_fuel, heating_appliance_type, "
    "heat_pump_sizing_methodology, has_ducted_heating, has_ducted_cooling, "
    "heating_efficiency_nominal_percentage, cooling_efficiency_eer, ac_type, cooled_space_percentage, "
    "heating_setpoint_offset_magnitude_degrees_f, cooling_setpoint_offset_magnitude_degrees_f, "
    "water_heater_fuel, water_heater_type, water_heater_tank_volume_gal, water_heater_efficiency_ef, "
    "water_heater_recovery_efficiency_ef, duct_insulation_r_value, duct_leakage_percentage, "
    "infiltration_ach50, insulation_wall_r_value, insulation_ceiling_r_value, clothes_dryer_fuel, "
    "cooking_range_fuel, has_heat_pump_dryer, has_induction_range"
)
RANKED = f", ranked AS (SELECT *, rank() OVER (PARTITION BY {CHANGEABLE} ORDER BY upgrade_id) AS place FROM upgraded)"


@registry.add(
    f"{UPGRADED_WITH}{RANKED} SELECT building_id, building_set, upgrade_id, upgrade_name, "
    "infiltration_ach50, water_heater_type, min_cop_47f FROM ranked WHERE place = 1"
)
def applicable_scenarios(spark, folder):
    kept = scenarios.changed_scenarios(features(spark, folder))
    return kept.select(
        "building_id",
        "building_set",
        "upgrade_id",
        "upgrade_name",
        "infiltration_ach50",
        "water_heater_type",
        "min_cop_47f",
    )


@registry.add(
    f"{UPGRADED_WITH}{RANKED} SELECT upgrade_id, count(*) AS n_buildings FROM ranked "
    "WHERE place = 1 GROUP BY upgrade_id"
)
def scenario_counts(spark, folder):
    kept = scenarios.changed_scenarios(features(spark, folder))
    return kept.groupBy("upgrade_id").agg(F.count(F.lit(1)).alias("n_buildings"))


@registry.add(
    f"{UPGRADED_WITH}{RANKED} SELECT upgrade_id, count(*) AS n_mismatches FROM ranked "
    "WHERE (place = 1) <> (building_id % 7 <> 0) AND upgrade_id NOT IN (13.01, 13.02, 11.05, 11.07) "
    "GROUP BY upgrade_id"
)
def applicability_mismatch(spark, folder):
    flagged = scenarios.fan_out_flagged(features(spark, folder))
    simulated = flagged.select(
        "building_id", "upgrade_id", (F.col("building_id") % 7 != 0).alias("applicability")
    )
    different = scenarios.applicability_mismatches(flagged, simulated)
    return different.groupBy("upgrade_id").agg(F.count(F.lit(1)).alias("n_mismatches"))


@registry.add(
    "WITH s(scenario, factor) AS (VALUES (0, 1), (1, 2), (2, 3)) "
    "SELECT c_custkey, scenario, cast(round(c_acctbal * 100) AS bigint) * factor AS scaled_cents "
    "FROM customer, s WHERE scenario <> 2 OR c_mktsegment = 'BUILDING'"
)
def scenario_fanout(spark, folder):
    customers = table(spark, folder, "customer")
    steps = F.array(*[F.struct(F.lit(i).alias("scenario"), F.lit(f).alias("factor")) for i, f in ((0, 1), (1, 2), (2, 3))])
    plan = customers.select("c_mktsegment").distinct().select("c_mktsegment", F.inline(steps))
    plan = plan.where("scenario <> 2 or c_mktsegment = 'BUILDING'")
    cents = F.round(F.col("c_acctbal") * 100).cast("long")
    fanned = scenarios.fan_out(customers, plan, ["c_mktsegment"])
    return fanned.select("c_custkey", "scenario", (cents * F.col("factor")).alias("scaled_cents"))


@registry.add(
    "SELECT p_partkey, upgrade_id, CASE "
    "WHEN upgrade_id = 13.02 AND p_size > 15 THEN round(p_size * 0.6::DOUBLE, 4) "
    "WHEN upgrade_id = 13.02 AND p_size > 10 THEN round(p_size * 0.7::DOUBLE, 4) "
    "WHEN upgrade_id = 13.02 AND p_size > 7.5 THEN round(p_size * 0.8::DOUBLE, 4) "
    "WHEN upgrade_id = 1 AND p_size >= 15 THEN round(p_size * 0.7::DOUBLE, 4) "
    "ELSE p_size::DOUBLE END AS infiltration_ach50 "
    "FROM part, (VALUES (0.0::DOUBLE), (1.0), (13.02)) v(upgrade_id)"
)
def tiered_scaling(spark, folder):
    ids = F.explode(F.array(F.lit(0.0), F.lit(1.0), F.lit(13.02)))
    parts = table(spark, folder, "part").select(
        "p_partkey", F.col("p_size").cast("double").alias("infiltration_ach50"), ids.alias("upgrade_id")
    )
    tiers = [r for r in scenarios.envelope_rules() if r.column == "infiltration_ach50"]
    return apply_stage(parts, tiers).withColumn(
        "infiltration_ach50", F.round("infiltration_ach50", 4)
    )


@registry.add(
    "WITH t(zone, threshold, target) AS (VALUES (1, 13, 30), (2, 30, 49), (3, 30, 49), (4, 38, 60), (5, 38, 60)) "
    "SELECT c_custkey, n_regionkey + 1 AS zone, "
    "CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 50 <= threshold THEN target ELSE cast(c_custkey % 50 AS integer) END AS r_value "
    "FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN t ON zone = n_regionkey + 1"
)
def threshold_dim_upgrade(spark, folder):
    homes = (
        table(spark, folder, "customer")
        .join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "c_custkey",
            (F.col("n_regionkey") + 1).alias("climate_zone_temp"),
            F.when(F.col("c_custkey") % 3 != 0, "Vented Attic").otherwise("None").alias("attic_type"),
            (F.col("c_custkey") % 50).cast("int").alias("insulation_ceiling_r_value"),
            F.lit(1.0).alias("upgrade_id"),
        )
    )
    with_targets = homes.join(F.broadcast(ceiling_targets(spark)), "climate_zone_temp")
    ceiling = [
        r for r in scenarios.envelope_rules() if r.column == "insulation_ceiling_r_value"
    ]
    return apply_stage(with_targets, ceiling).select(
        "c_custkey",
        F.col("climate_zone_temp").alias("zone"),
        F.col("insulation_ceiling_r_value").alias("r_value"),
    )


@registry.add(
    "SELECT l_linenumber, l_returnflag, count(*) AS n_rows, "
    "sum(CASE WHEN l_linestatus = 'O' AND l_returnflag <> 'N' THEN least(d, 4) ELSE d END)::BIGINT AS leakage, "
    "sum(CASE WHEN l_linestatus = 'O' AND l_returnflag <> 'N' THEN greatest(q, 8) ELSE q END)::BIGINT AS insulation "
    "FROM (SELECT *, round(l_discount * 100)::BIGINT AS d, l_quantity::BIGINT AS q FROM lineitem) GROUP BY ALL"
)
def clamp_conditional(spark, folder):
    def improvable():
        return (F.col("l_linestatus") == "O") & ~F.col("l_returnflag").isin("N")

    lines = table(spark, folder, "lineitem").select(
        "l_linenumber",
        "l_returnflag",
        "l_linestatus",
        F.lit(1.0).alias("upgrade_id"),
        F.round(F.col("l_discount") * 100).cast("long").alias("leakage"),
        F.col("l_quantity").cast("long").alias("insulation"),
    )
    changed = apply_stage(
        lines,
        [
            rule([1], "leakage", lambda: F.least("leakage", F.lit(4)), improvable),
            rule([1], "insulation", lambda: F.greatest("insulation", F.lit(8)), improvable),
        ],
    )
    return changed.groupBy("l_linenumber", "l_returnflag").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("leakage").alias("leakage"),
        F.sum("insulation").alias("insulation"),
    )


CHOICE_SQL = """
SELECT p_partkey, upgrade_id,
  CASE WHEN upgrade_id = 15.04 AND applies THEN
      CASE WHEN small THEN 'Daikin MSHP SZ, SEER 22.05, 10.64 HSPF' ELSE 'Daikin MSHP MZ, SEER 22.05, 11.2 HSPF' END
    WHEN upgrade_id = 15.08 AND p_size > 10 THEN 'Daikin 7 series ASHP, SEER 20, 10.35 HSPF'
    WHEN upgrade_id = 4 AND p_size > 10 THEN 'MSHP, SEER 24, 13 HSPF'
    WHEN upgrade_id = 4 THEN 'MSHP, SEER 29.3, 14 HSPF' ELSE 'none' END AS product,
  CASE WHEN upgrade_id <> 6 THEN 'none' WHEN p_brand = 'Brand#1' THEN 'Electric Tankless'
    WHEN beds <= 3 THEN 'Electric Heat Pump, 50 gal, 3.45 UEF'
    WHEN beds = 4 THEN 'Electric Heat Pump, 66 gal, 3.35 UEF'
    ELSE 'Electric Heat Pump, 80 gal, 3.45 UEF' END AS water_heater
FROM (SELECT *, cast(p_size % 5 + 1 AS integer) AS beds, p_retailprice < 950 AS applies,
  p_size % 5 + 1 = 1 OR p_size * 20 <= 749 OR (p_size % 5 + 1 = 2 AND p_size * 20 <= 999) AS small FROM part),
 (VALUES (4.0::DOUBLE), (6.0), (15.04), (15.08)) v(upgrade_id)
"""


@registry.add(CHOICE_SQL)
def choice_by_size(spark, folder):
    ids = F.explode(F.array(*[F.lit(i) for i in (4.0, 6.0, 15.04, 15.08)]))
    homes = (
        table(spark, folder, "part")
        .select(
            "p_partkey",
            (F.col("p_size") % 5 + 1).alias("n_bedrooms"),
            (F.col("p_size") * 20.0).alias("sqft"),
            (F.col("p_size") > 10).alias("has_ducts"),
            F.lit("Natural Gas").alias("heating_fuel"),
            F.when(F.col("p_retailprice") < 950, 0.8)
            .otherwise(5.0)
            .alias("heating_efficiency_nominal_percentage"),
            F.when(F.col("p_retailprice") < 950, 10.0)
            .otherwise(30.0)
            .alias("cooling_efficiency_eer"),
            F.when(F.col("p_brand") == "Brand#1", "Electric Tankless")
            .otherwise("Electric Standard")
            .alias("water_heater_efficiency"),
            F.lit("Electricity").alias("water_heater_fuel"),
            F.lit("").alias("hvac_heating_efficiency"),
            F.lit(True).alias("has_ducted_heating"),
            F.lit(True).alias("has_ducted_cooling"),
            F.lit(None).cast("string").alias("hp_label"),
            ids.alias("upgrade_id"),
        )
    )
    chosen = apply_stage(homes, scenarios.heat_pump_choice_rules())
    chosen = apply_stage(chosen, scenarios.water_heater_rules())
    return chosen.select(
        "p_partkey",
        "upgrade_id",
        F.coalesce("hp_label", F.lit("none")).alias("product"),
        F.when(F.col("upgrade_id") == 6, F.col("water_heater_efficiency"))
        .otherwise("none")
        .alias("water_heater"),
    )


@registry.add(
    "WITH curve(label, cop, retention) AS (VALUES ('ECONOMY', 3.8::DOUBLE, 0.98::DOUBLE), ('PROMO', 4.23, NULL)) "
    "SELECT p_partkey, coalesce(cop, p_size::DOUBLE) AS cop, coalesce(retention, 1.0) AS retention "
    "FROM part LEFT JOIN curve ON label = p_type"
)
def curve_attach_impute(spark, folder):
    curves = literal(
        spark, [("ECONOMY", 3.8, 0.98), ("PROMO", 4.23, None)], "p_type string, cop double, retention double"
    )
    parts = table(spark, folder, "part").select(
        "p_partkey", "p_type", F.col("p_size").cast("double").alias("nominal")
    )
    attached = parts.join(F.broadcast(curves), "p_type", "left")
    filled = fill_from(attached, "nominal", ["cop"]).fillna(1.0, subset=["retention"])
    return filled.select("p_partkey", "cop", "retention")


DUPLICATES_SQL = """
WITH fan AS (
  SELECT c_custkey, scenario, CASE WHEN scenario = 1 AND c_acctbal < 0 THEN 'raised' ELSE 'same' END AS a,
    CASE WHEN scenario = 2 AND c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS b
  FROM customer, (VALUES (0.0::DOUBLE), (1.0), (2.0)) v(scenario)
  UNION ALL SELECT c_custkey, 0.0::DOUBLE, 'same', c_mktsegment FROM customer WHERE c_nationkey = 3),
ranked AS (SELECT *, rank() OVER (PARTITION BY c_custkey, a, b ORDER BY scenario) AS place FROM fan)
"""


def _with_copies(spark, folder) -> DataFrame:
    customers = table(spark, folder, "customer")
    ids = F.explode(F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0))).alias("scenario")
    fan = customers.select("c_custkey", "c_acctbal", "c_mktsegment", ids).select(
        "c_custkey",
        "scenario",
        F.when((F.col("scenario") == 1) & (F.col("c_acctbal") < 0), "raised")
        .otherwise("same")
        .alias("a"),
        F.when(~((F.col("scenario") == 2) & (F.col("c_mktsegment") == "BUILDING")), F.col("c_mktsegment")).alias("b"),
    )
    copies = customers.where("c_nationkey = 3").select(
        "c_custkey", F.lit(0.0).alias("scenario"), F.lit("same").alias("a"), F.col("c_mktsegment").alias("b")
    )
    return fan.unionByName(copies)


@registry.add(f"{DUPLICATES_SQL} SELECT c_custkey, scenario, a FROM ranked WHERE place = 1")
def drop_unchanged_scenarios(spark, folder):
    kept = scenarios.drop_unchanged(_with_copies(spark, folder), "scenario", [0.0, 1.0, 2.0])
    return kept.select("c_custkey", "scenario", "a")


@registry.add(
    "SELECT o_orderkey, list_contains(f, 'A') OR o_orderpriority = '1-URGENT' AS has_natural_gas_appliance, "
    "list_contains(f, 'N') AS has_fuel_oil_appliance, list_contains(f, 'R') AS has_propane_appliance "
    "FROM (SELECT o_orderkey, o_orderpriority, list(DISTINCT l_returnflag) AS f FROM orders "
    "JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"
)
def presence_flags(spark, folder):
    lines = table(spark, folder, "lineitem")
    fuels = {"A": "Natural Gas", "N": "Fuel Oil", "R": "Propane"}
    held = (
        lines.groupBy("l_orderkey")
        .agg(*[F.max(F.col("l_returnflag") == f).alias(f"has_{f}") for f in fuels])
        .select(
            "l_orderkey",
            *[F.when(F.col(f"has_{f}"), fuel).alias(f"fuel_{f}") for f, fuel in fuels.items()],
        )
    )
    orders = table(spark, folder, "orders").select(
        "o_orderkey", (F.col("o_orderpriority") == "1-URGENT").alias("has_gas_grill")
    )
    joined = orders.join(held, F.col("o_orderkey") == F.col("l_orderkey"))
    flags = fuel_presence([f"fuel_{f}" for f in fuels], ["has_gas_grill"])
    return joined.select("o_orderkey", *[c.alias(name) for name, c in flags.items()])


@registry.add(
    f"{FEATURES_WITH} SELECT building_set, count(*) AS n_keys FROM features GROUP BY building_set"
)
def keyed_feature_check(spark, folder):
    checked = require_key(features(spark, folder), ["building_id", "building_set"])
    return checked.groupBy("building_set").agg(F.count(F.lit(1)).alias("n_keys"))


@registry.add(
    f"{FEATURES_WITH}, saved AS (SELECT o_custkey AS building_id, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cost_delta "
    "FROM orders GROUP BY o_custkey) SELECT coalesce(CASE place WHEN 'G0100010' THEN 'Pittsburgh' WHEN 'G0600370' THEN 'Denver' END, 'none') AS community, "
    "heating_appliance_type, count(*) AS n_homes, sum(cost_delta)::BIGINT AS cost_delta FROM features "
    "JOIN saved USING (building_id) JOIN (SELECT building_id, county AS place FROM aligned) USING (building_id) "
    "WHERE heating_appliance_type <> 'ASHP' AND NOT is_mobile_home GROUP BY ALL"
)
def savings_join(spark, folder):
    """Features, savings and metadata joined per building."""
    metadata = aligned(spark, folder)
    named = {"G0100010": "G4200030", "G0600370": "G0800310"}
    placed = metadata.withColumn("county", relabel("county", named))
    savings = savings_by_building(
        table(spark, folder, "orders").select(
            F.col("o_custkey").alias("building_id"),
            F.round(F.col("o_totalprice") * 100).cast("long").alias("cost_delta"),
        ),
        ["building_id"],
        ["cost_delta"],
    )
    rows = savings_rows(feature_job(metadata), savings, placed, ["cost_delta"], ["tenure"])
    return rows.groupBy(
        F.coalesce("community", F.lit("none")).alias("community"), "heating_appliance_type"
    ).agg(F.count(F.lit(1)).alias("n_homes"), F.sum("cost_delta").alias("cost_delta"))


# --- older generations -------------------------------------------------------------

LABEL_INPUT = {
    "in_ashrae_iecc_climate_zone_2004": BOTH["ashrae_iecc_climate_zone_2004"],
    "in_geometry_attic_type": BOTH["geometry_attic_type"],
    "in_insulation_ceiling": BOTH["insulation_ceiling"],
    "in_insulation_wall": BOTH["insulation_wall"],
    "in_geometry_foundation_type": (
        109,
        ("Slab", "Heated Basement", "Vented Crawlspace", "Unvented Crawlspace"),
    ),
    "in_insulation_foundation_wall": BOTH["insulation_foundation_wall"],
    "in_insulation_rim_joist": BOTH["insulation_rim_joist"],
    "in_insulation_roof": BOTH["insulation_roof"],
    "in_ducts_insulation": (307, ("R-4", "R-6", "Uninsulated")),
    "in_hvac_heating_efficiency": (
        311,
        (
            "Fuel Furnace, 80% AFUE",
            "ASHP, SEER 13, 7.7 HSPF",
            "ASHP, SEER 16, 9.2 HSPF",
            "MSHP, SEER 14.5, 8.2 HSPF",
            "Electric Baseboard, 100% Efficiency",
        ),
    ),
    "in_hvac_cooling_type": (311, ("Central AC", "Heat Pump", "Heat Pump", "Heat Pump", "Room AC")),
    "in_hvac_heating_efficiency_nominal_percent": (311, ("80%", "226%", "270%", "240%", "100%")),
    "in_hvac_cooling_efficiency": (
        311,
        ("SEER 13", "Heat Pump", "Heat Pump", "Heat Pump", "EER 10.7"),
    ),
    "in_hvac_cooling_partial_space_conditioning": (313, ("100%", "60%")),
    "in_heating_fuel": (317, ("Natural Gas", "Propane", "Electricity")),
    "in_geometry_stories": (331, ("1", "2")),
    "in_vintage": BOTH["vintage"],
}


def label_input(spark, folder) -> DataFrame:
    columns = derived_columns(LABEL_INPUT, spark_pick)
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("building_id"),
        *[F.expr(text).alias(name) for name, text in columns.items()],
        (F.col("c_custkey") % 26).cast("double").alias("in_infiltration_ach50"),
        F.when(F.col("c_custkey") % 4 != 0, (F.col("c_custkey") % 4 * 10 - 10).cast("double")).alias(
            "in_ducts_leakage"
        ),
        (F.col("c_nationkey") % 2 == 0).alias("in_hvac_has_ducts"),
    )


_LABEL_COLUMNS = ", ".join(
    f"{text} AS {name}" for name, text in derived_columns(LABEL_INPUT, duckdb_pick).items()
)
_HP = "in_hvac_cooling_type = 'Heat Pump'"
LABEL_SQL = f"""
WITH base AS (SELECT c_custkey AS building_id, {_LABEL_COLUMNS}, (c_custkey % 26)::DOUBLE AS ach,
    CASE WHEN c_custkey % 4 <> 0 THEN (c_custkey % 4 * 10 - 10)::DOUBLE END AS leak,
    c_nationkey % 2 = 0 AS ducts FROM customer),
fan AS (SELECT *, upgrade_id IN (1, 2) AS ins, upgrade_id = 2 AS full_enclosure,
    in_geometry_attic_type = 'Vented Attic' AND in_insulation_ceiling IN ('Uninsulated', 'R-7', 'R-13') AS low1,
    in_geometry_attic_type = 'Vented Attic' AND in_insulation_ceiling IN ('Uninsulated', 'R-7', 'R-13', 'R-19', 'R-30') AS low2,
    in_geometry_attic_type = 'Vented Attic' AND in_insulation_ceiling IN ('Uninsulated', 'R-7', 'R-13', 'R-19', 'R-30', 'R-38') AS low3,
    CASE WHEN in_ashrae_iecc_climate_zone_2004 = '1A' THEN 1
      WHEN in_ashrae_iecc_climate_zone_2004 IN ('2A', '2B', '3A', '3B', '3C') THEN 2 ELSE 3 END AS zone
  FROM base, (VALUES (0.0::DOUBLE), (1.0), (2.0), (3.0), (4.0), (5.0)) v(upgrade_id)),
ruled AS (SELECT *,
    ins AND ((zone = 1 AND low1) OR (zone = 2 AND low2) OR (zone = 3 AND low3)) AS attic,
    ins AND ach >= 15 AS leaky, ins AND coalesce(leak > 0, false) AS ducty,
    ins AND in_insulation_wall = 'Wood Stud, Uninsulated' AS wall,
    full_enclosure AND in_geometry_foundation_type IN ('Unvented Crawlspace', 'Vented Crawlspace', 'Heated Basement')
      AND in_insulation_foundation_wall = 'Uninsulated' AS foundation,
    full_enclosure AND in_geometry_foundation_type = 'Unvented Crawlspace' AS crawl,
    full_enclosure AND in_geometry_attic_type = 'Finished Attic or Cathedral Ceilings'
      AND in_insulation_roof = 'Finished, R-13' AS roof,
    CASE WHEN upgrade_id = 3 AND ducts AND (NOT {_HP} OR in_hvac_heating_efficiency IN
        ('ASHP, SEER 10, 6.2 HSPF', 'ASHP, SEER 13, 7.7 HSPF', 'ASHP, SEER 15, 8.5 HSPF')) THEN 'ASHP, SEER 15, 9.0 HSPF'
      WHEN upgrade_id = 3 AND NOT ducts AND (NOT {_HP} OR in_hvac_heating_efficiency = 'MSHP, SEER 14.5, 8.2 HSPF')
        THEN 'MSHP, SEER 15, 9.0 HSPF, Max Load'
      WHEN upgrade_id = 4 AND ducts THEN 'MSHP, SEER 24, 13 HSPF'
      WHEN upgrade_id = 4 AND NOT ducts AND (NOT {_HP} OR in_hvac_heating_efficiency IN
        ('MSHP, SEER 14.5, 8.2 HSPF', 'MSHP, SEER 29.3, 14 HSPF, Max Load')) THEN 'MSHP, SEER 29.3, 14 HSPF, Max Load'
      WHEN upgrade_id = 5 THEN 'ASHP, SEER 15, 9.0 HSPF' END AS pump
  FROM fan),
done AS (SELECT building_id, upgrade_id,
    CASE WHEN upgrade_id = 0 THEN -1 WHEN attic OR leaky OR ducty OR wall OR foundation OR crawl OR roof OR pump IS NOT NULL
      THEN 1 ELSE 0 END AS eligible_for_upgrade,
    CASE WHEN attic THEN CASE zone WHEN 1 THEN 'R-30' WHEN 2 THEN 'R-49' ELSE 'R-60' END ELSE in_insulation_ceiling END AS in_insulation_ceiling,
    CASE WHEN leaky THEN round(ach * 0.7, 4) ELSE ach END::DOUBLE AS in_infiltration_ach50,
    CASE WHEN ducty THEN 10 ELSE coalesce(leak, 0) END::DOUBLE AS in_ducts_leakage,
    CASE WHEN ducty THEN 'R-8' ELSE in_ducts_insulation END AS in_ducts_insulation,
    CASE WHEN foundation THEN 'Wall R-10, Interior' ELSE in_insulation_foundation_wall END AS in_insulation_foundation_wall,
    in_insulation_rim_joist,
    CASE WHEN roof THEN 'Finished, R-30' ELSE in_insulation_roof END AS in_insulation_roof,
    CASE WHEN pump IS NULL THEN in_heating_fuel ELSE 'Electricity' END AS in_heating_fuel,
    CASE WHEN upgrade_id = 5 AND NOT {_HP} THEN in_hvac_heating_efficiency_nominal_percent
      WHEN pump IS NOT NULL OR {_HP} THEN '100%' ELSE 'None' END AS in_hvac_backup_heating_efficiency_nominal_percent,
    CASE WHEN upgrade_id = 5 OR {_HP} THEN 'Electricity' ELSE 'None' END AS in_backup_heating_fuel,
    coalesce(pump, in_hvac_heating_efficiency) AS label, pump IS NOT NULL OR {_HP} AS has_pump,
    in_hvac_cooling_efficiency AS ac,
    CASE in_vintage WHEN '<1940' THEN 80 ELSE 2010 - cast(substr(in_vintage, 1, 4) AS integer) END AS in_vintage
  FROM ruled)
SELECT * EXCLUDE (label, has_pump, ac), label AS in_hvac_heating_efficiency,
  round(CASE WHEN contains(label, 'HSPF') THEN cast(regexp_extract(label, '([0-9.]+) HSPF', 1) AS double) * 100 / 3.412
    ELSE cast(regexp_extract(label, '([0-9.]+)%', 1) AS double) END, 4) AS in_hvac_heating_efficiency_nominal_percent,
  coalesce(try_cast(regexp_extract(label, 'SEER ([0-9.]+)', 1) AS double), -1) AS in_hvac_seer_rating,
  coalesce(try_cast(regexp_extract(label, '([0-9.]+) HSPF', 1) AS double), -1) AS in_hvac_hspf_rating,
  coalesce(try_cast(regexp_extract(label, ' ([0-9.]+)%', 1) AS double), -1) AS in_hvac_afue_rating,
  round(CASE WHEN has_pump THEN coalesce(try_cast(regexp_extract(label, 'SEER ([0-9.]+)', 1) AS double) * 0.875, 99)
    WHEN starts_with(ac, 'SEER') THEN cast(substr(ac, 6) AS double) * 0.875
    WHEN starts_with(ac, 'EER') THEN cast(substr(ac, 5) AS double) ELSE 99 END, 4) AS in_hvac_cooling_efficiency
FROM done
"""


@registry.add(LABEL_SQL)
def label_scenarios(spark, folder):
    done = older_scenarios.label_features(older_scenarios.label_scenarios(label_input(spark, folder)))
    numbers = (
        "in_infiltration_ach50",
        "in_hvac_heating_efficiency_nominal_percent",
        "in_hvac_cooling_efficiency",
    )
    ratings = ("in_hvac_seer_rating", "in_hvac_hspf_rating", "in_hvac_afue_rating")
    kept = (
        "building_id",
        "upgrade_id",
        "in_insulation_ceiling",
        "in_ducts_leakage",
        "in_ducts_insulation",
        "in_insulation_foundation_wall",
        "in_insulation_rim_joist",
        "in_insulation_roof",
        "in_heating_fuel",
        "in_hvac_backup_heating_efficiency_nominal_percent",
        "in_backup_heating_fuel",
        "in_vintage",
        "in_hvac_heating_efficiency",
    )
    return done.select(
        *kept,
        F.coalesce("eligible_for_upgrade", F.lit(-1)).alias("eligible_for_upgrade"),
        *[F.round(n, 4).alias(n) for n in numbers],
        *[F.coalesce(r, F.lit(-1.0)).alias(r) for r in ratings],
    )


@registry.add(
    f"WITH base AS (SELECT c_custkey AS building_id, {_LABEL_COLUMNS}, (c_custkey % 26)::DOUBLE AS ach FROM customer "
    "WHERE c_custkey % 2 = 0) SELECT in_heating_fuel, count(*) AS n_homes FROM base "
    "WHERE in_heating_fuel <> 'Other Fuel' AND in_hvac_cooling_type <> 'Room AC' GROUP BY ALL"
)
def eligibility_attached(spark, folder):
    homes = label_input(spark, folder).withColumns(
        {
            "in_geometry_building_type_acs": F.when(
                F.col("building_id") % 2 == 0, "Single-Family Attached"
            ).otherwise("Mobile Home"),
            "in_hvac_cooling_type": F.when(
                F.col("in_hvac_cooling_type") == "Room AC", "Shared Cooling"
            ).otherwise(F.col("in_hvac_cooling_type")),
        }
    )
    kept = homes.where(vintages.ELIGIBILITY["attached"]())
    return kept.groupBy("in_heating_fuel").agg(F.count(F.lit(1)).alias("n_homes"))


NUMERIC_SQL = """
WITH base AS (SELECT p_partkey, upgrade_id, p_size::DOUBLE AS ceiling, p_size::DOUBLE AS ach,
    (p_partkey % 4)::DOUBLE / 10 AS leak, p_partkey % 2 AS ducts, p_partkey % 7 + 1 AS zone,
    p_partkey % 3 <> 0 AS vented, p_type = 'SMALL' AS wood, p_retailprice AS heat
  FROM part, (VALUES (0.0::DOUBLE), (1.0), (3.0), (4.0), (5.0)) v(upgrade_id))
SELECT p_partkey, upgrade_id,
  CASE WHEN upgrade_id = 1 AND vented AND zone = 1 AND ceiling <= 13 THEN 30
    WHEN upgrade_id = 1 AND vented AND zone IN (2, 3) AND ceiling <= 30 THEN 49
    WHEN upgrade_id = 1 AND vented AND zone > 3 AND ceiling <= 38 THEN 60 ELSE ceiling END::DOUBLE AS insulation_ceiling_roof,
  round(CASE WHEN upgrade_id = 1 AND ach >= 15 THEN ach * 0.7 ELSE ach END, 4) AS infiltration_ach50,
  CASE WHEN upgrade_id = 1 AND leak > 0 THEN 0.1 ELSE leak END::DOUBLE AS ducts_leakage,
  CASE WHEN upgrade_id = 1 AND leak > 0 THEN 8 ELSE 0 END::DOUBLE AS ducts_insulation,
  CASE WHEN upgrade_id = 1 AND wood THEN 13 ELSE 0 END::DOUBLE AS insulation_wall,
  CASE WHEN upgrade_id IN (3, 5) THEN 263 WHEN upgrade_id = 4 AND ducts = 1 THEN 380 WHEN upgrade_id = 4 THEN 410
    ELSE heat END::DOUBLE AS heating_efficiency,
  CASE WHEN upgrade_id IN (3, 5) THEN 13.125 WHEN upgrade_id = 4 AND ducts = 1 THEN 21 WHEN upgrade_id = 4 THEN 25.6375
    ELSE 10 END::DOUBLE AS cooling_efficiency_eer,
  CASE WHEN upgrade_id IN (3, 4) THEN 1 WHEN upgrade_id = 5 THEN heat ELSE 0 END::DOUBLE AS backup_heating_efficiency,
  CASE WHEN upgrade_id >= 3 THEN 'Heat Pump' ELSE 'AC' END AS ac_type,
  CASE WHEN upgrade_id >= 3 THEN 1 ELSE 0 END AS has_ac
FROM base
"""


@registry.add(NUMERIC_SQL)
def numeric_scenarios(spark, folder):
    size = F.col("p_size")
    homes = table(spark, folder, "part").select(
        "p_partkey",
        size.alias("insulation_ceiling_roof"),
        size.alias("infiltration_ach50"),
        ((F.col("p_partkey") % 4) / 10).alias("ducts_leakage"),
        F.lit(0).alias("ducts_insulation"),
        F.lit(0).alias("insulation_wall"),
        (F.col("p_partkey") % 2).alias("has_ducts"),
        F.concat((F.col("p_partkey") % 7 + 1).cast("string"), F.lit("A")).alias(
            "ashrae_iecc_climate_zone"
        ),
        F.when(F.col("p_partkey") % 3 != 0, "Vented Attic").otherwise("None").alias("attic_type"),
        F.when(F.col("p_type") == "SMALL", "Wood Stud, Uninsulated").otherwise("Brick").alias("wall_type"),
        F.col("p_retailprice").alias("heating_efficiency"),
        F.lit(10).alias("cooling_efficiency_eer"),
        F.lit(0).alias("backup_heating_efficiency"),
        F.lit("AC").alias("ac_type"),
        F.lit(0).alias("has_ac"),
    )
    done = older_scenarios.numeric_scenarios(homes)
    dropped = ("has_ducts", "ashrae_iecc_climate_zone", "attic_type", "wall_type")
    return done.withColumn("infiltration_ach50", F.round("infiltration_ach50", 4)).drop(*dropped)


@registry.add(
    f"WITH raw AS ({raw_metadata_sql(2024, every=True)}), s AS (SELECT *, CASE geometry_building_type_acs "
    "WHEN 'Mobile Home' THEN 1690 WHEN 'Single-Family Detached' THEN 1690 WHEN 'Single-Family Attached' THEN 1675 "
    "WHEN '2 Unit' THEN 1623 WHEN '3 or 4 Unit' THEN 1623 END AS area, "
    "CASE WHEN heating_fuel = 'Propane' THEN 'Other Fuel' ELSE heating_fuel END AS sampled_fuel, "
    "substr(county, 2, 2) || substr(county, 5, 3) AS county_geoid FROM raw) "
    "SELECT building_id, sampled_fuel AS heating_fuel, area AS sqft, county_geoid, 'Sampled' AS building_set, "
    "'City ' || county_geoid AS weather_file_city "
    f"FROM s WHERE county_geoid <> '48201' AND sampled_fuel <> 'Other Fuel' AND {ELIGIBLE}"
)
def sampled_buildings(spark, folder):
    raw = vintages.edit_columns(raw_metadata(spark, folder, 2024, every=True), strip=("in__",)).drop(
        "sqft", "weather_file_city", "weight", "out__electricity__total"
    )
    samples = raw.withColumns(
        {
            "County and PUMA": F.concat("county", F.lit(", "), "county"),
            "Geometry Floor Area": F.lit("1500-1999"),
            "heating_fuel": F.when(F.col("heating_fuel") == "Propane", "Wood").otherwise(
                F.col("heating_fuel")
            ),
        }
    ).withColumnRenamed("bldg_id", "Building")
    codes = table(spark, folder, "nation").select(
        F.expr("element_at(array('01001', '06037', '17031', '36061'), n_nationkey % 4 + 1)").alias(
            "county_geoid"
        )
    )
    counties = codes.distinct().withColumn(
        "weather_file_city", F.concat(F.lit("City "), F.col("county_geoid"))
    )
    return sampled_metadata(samples, counties, "Sampled").select(
        "building_id", "heating_fuel", "sqft", "county_geoid", "building_set", "weather_file_city"
    )
