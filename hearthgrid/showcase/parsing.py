"""Queries that read typed values out of label text built from table columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthgrid.functions import lookup, text, water_heater
from hearthgrid.showcase.base import Registry, table

registry = Registry()


def _parts(spark, folder, *expressions):
    return table(spark, folder, "part").select("p_partkey", *[F.expr(e) for e in expressions])


@registry.add(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    "CASE WHEN l_linenumber = 7 THEN 0 ELSE round(l_discount * 100) / 100 END::DOUBLE AS share FROM lineitem"
)
def parse_percentage(spark, folder):
    number = F.round(F.col("l_discount") * 100).cast("int").cast("string")
    label = (
        F.when(F.col("l_linenumber") == 7, F.lit("None"))
        .when(F.col("l_linenumber") == 6, F.concat(F.lit("<"), number, F.lit("% Conditioned")))
        .otherwise(F.concat(number, F.lit("% Leakage, Uninsulated")))
    )
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        text.percentage(label, strict=True).alias("share"),
    )


@registry.add(
    "SELECT p_partkey, p_size AS wall, CASE WHEN p_type = 'SMALL' THEN 0 ELSE p_size END AS slab, "
    "CASE WHEN p_type = 'LARGE' THEN 999 ELSE p_size END AS duct FROM part"
)
def parse_r_value(spark, folder):
    parts = _parts(
        spark,
        folder,
        "concat('CMU, 6-in Hollow, R-', p_size, ', Interior') AS wall",
        "CASE WHEN p_type = 'SMALL' THEN 'Uninsulated' ELSE concat('2ft R', p_size, ' Under, Horizontal') END AS slab",
        "CASE WHEN p_type = 'LARGE' THEN 'None' ELSE concat('10% Leakage to Outside, R-', p_size) END AS duct",
    )
    return parts.select(
        "p_partkey",
        text.r_value("wall", strict=True).alias("wall"),
        text.r_value("slab", strict=True).alias("slab"),
        text.r_value("duct", none_as=999, strict=True).alias("duct"),
    )


@registry.add(
    "SELECT p_partkey, round(CASE p_type WHEN 'SMALL' THEN 999 WHEN 'LARGE' THEN 11.375 WHEN 'MEDIUM' THEN 0.91 * r "
    "WHEN 'PROMO' THEN 1.04 * r WHEN 'ECONOMY' THEN r ELSE 0.875 * r END::DOUBLE, 3) AS cooling, "
    "round(CASE p_type WHEN 'SMALL' THEN 9 WHEN 'LARGE' THEN p_size / 100.0 WHEN 'MEDIUM' THEN r / 100 "
    "ELSE r / 3.412142 END::DOUBLE, 3) AS heating FROM (SELECT *, (p_size::DOUBLE + 0.5) AS r FROM part)"
)
def parse_efficiency(spark, folder):
    parts = _parts(
        spark,
        folder,
        "CASE p_type WHEN 'SMALL' THEN 'None' WHEN 'LARGE' THEN 'Heat Pump' "
        "WHEN 'MEDIUM' THEN concat('AC, SEER2 ', p_size, '.5') WHEN 'PROMO' THEN concat('AC, EER2 ', p_size, '.5') "
        "WHEN 'ECONOMY' THEN concat('Room AC, EER ', p_size, '.5') "
        "ELSE concat('ASHP, SEER ', p_size, '.5, 7.7 HSPF') END AS cooling",
        "CASE p_type WHEN 'SMALL' THEN 'None' WHEN 'LARGE' THEN concat('Electric Baseboard, ', p_size, '% Efficiency') "
        "WHEN 'MEDIUM' THEN concat('Fuel Furnace, ', p_size, '.5% AFUE') "
        "ELSE concat('ASHP, SEER 15, ', p_size, '.5 HSPF') END AS heating",
    )
    return parts.select(
        "p_partkey",
        text.cooling_eer("cooling", strict=True).alias("cooling"),
        text.heating_fraction("heating", strict=True).alias("heating"),
    )


@registry.add(
    "SELECT p_partkey, (4 * p_size + 6)::DOUBLE / 4 AS mean, 4 * p_size + 6 AS total FROM part"
)
def parse_wall_ratio(spark, folder):
    label = "concat('F', p_size, ' B', p_size + 1, ' L', p_size + 2, ' R', p_size + 3) AS label"
    return _parts(spark, folder, label).select(
        "p_partkey",
        text.wall_ratio_mean("label", strict=True).alias("mean"),
        text.wall_ratio_total("label", strict=True).alias("total"),
    )


@registry.add(
    "SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN 99 ELSE p_size + 0.25 END::DOUBLE AS factor FROM part"
)
def parse_energy_factor(spark, folder):
    label = (
        "CASE p_type WHEN 'SMALL' THEN 'None' WHEN 'LARGE' THEN concat('EF ', p_size, '.25') "
        "ELSE concat('EF ', p_size, '.25, 100% Usage') END AS label"
    )
    return _parts(spark, folder, label).select(
        "p_partkey", text.energy_factor("label", strict=True).alias("factor")
    )


@registry.add(
    "SELECT p_partkey, (p_size - 25)::DOUBLE AS degrees, (p_size - 95)::DOUBLE AS from_70 FROM part"
)
def parse_temp(spark, folder):
    parts = _parts(spark, folder, "concat(p_size - 25, 'F') AS label")
    return parts.select(
        "p_partkey",
        text.temperature_f("label", strict=True).alias("degrees"),
        text.temperature_f("label", relative_to=70.0, strict=True).alias("from_70"),
    )


@registry.add(
    "SELECT p_partkey, CASE WHEN d < 1940 THEN 1930 ELSE d + 5 END AS midpoint, "
    "CASE WHEN d < 1940 THEN 70 ELSE 2000 - d END AS age_2000, CASE WHEN d < 1940 THEN 80 ELSE 2010 - d END AS age_2010 "
    "FROM (SELECT p_partkey, 1930 + 10 * (p_size % 8) AS d FROM part)"
)
def parse_vintage(spark, folder):
    label = (
        "CASE WHEN p_size % 8 = 0 THEN ' <1940' ELSE concat(1930 + 10 * (p_size % 8), 's') END AS label"
    )
    return _parts(spark, folder, label).select(
        "p_partkey",
        text.vintage_midpoint("label", strict=True).alias("midpoint"),
        text.age_in("label", 2000).alias("age_2000"),
        text.age_in("label", 2010).alias("age_2010"),
    )


@registry.add(
    "SELECT p_partkey, CASE WHEN p_type IN ('SMALL', 'LARGE') THEN -1 ELSE p_size + 0.5 END::DOUBLE AS seer, "
    "CASE WHEN p_type IN ('SMALL', 'LARGE') THEN -1 ELSE p_size + 1.25 END::DOUBLE AS hspf, "
    "CASE WHEN p_type = 'SMALL' THEN 10 + p_size WHEN p_type = 'LARGE' THEN 10 + p_size ELSE -1 END::DOUBLE AS afue, "
    "round(CASE WHEN p_type IN ('SMALL', 'LARGE') THEN 10 + p_size ELSE (p_size + 1.25::DOUBLE) * 100 / 3.412 END, 4)::DOUBLE AS percent, "
    "CASE WHEN p_type IN ('SMALL', 'LARGE') THEN 10 + p_size ELSE floor((p_size + 1.25::DOUBLE) * 100 / 3.413) END::INTEGER AS whole, "
    "CASE p_type WHEN 'PROMO' THEN round((p_size + 0.5::DOUBLE) * 0.875, 4) WHEN 'ECONOMY' THEN p_size + 0.5 ELSE 99 END::DOUBLE AS eer FROM part"
)
def parse_older_ratings(spark, folder):
    parts = _parts(
        spark,
        folder,
        "CASE p_type WHEN 'SMALL' THEN concat('Fuel Furnace, ', 10 + p_size, '% AFUE') "
        "WHEN 'LARGE' THEN concat('Electric Baseboard, ', 10 + p_size, '% Efficiency') "
        "ELSE concat('ASHP, SEER ', p_size, '.5, ', p_size + 1, '.25 HSPF') END AS label",
        "CASE p_type WHEN 'PROMO' THEN concat('SEER ', p_size, '.5') "
        "WHEN 'ECONOMY' THEN concat('EER ', p_size, '.5') WHEN 'MEDIUM' THEN NULL ELSE 'None' END AS cooling",
    )
    absent = F.lit(-1.0)
    return parts.select(
        "p_partkey",
        F.coalesce(text.seer("label"), absent).alias("seer"),
        F.coalesce(text.hspf("label"), absent).alias("hspf"),
        F.coalesce(text.afue("label"), absent).alias("afue"),
        F.round(text.heating_percent("label"), 4).alias("percent"),
        text.heating_percent_integer("label").alias("whole"),
        F.round(text.rated_eer_or_99("cooling"), 4).alias("eer"),
    )


@registry.add(
    "SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 'Instantaneous' WHEN 'LARGE' THEN 'Heat Pump' WHEN 'MEDIUM' THEN 'Heat Pump' ELSE 'Storage' END AS water_heater_type, "
    "CASE p_type WHEN 'SMALL' THEN 0 WHEN 'LARGE' THEN 40 + p_size WHEN 'MEDIUM' THEN 80 ELSE "
    "CASE WHEN bd = 1 THEN 20 WHEN bd = 2 THEN 30 WHEN bd = 3 THEN CASE WHEN el THEN 50 ELSE 40 END "
    "WHEN bd = 4 THEN CASE WHEN el THEN 50 ELSE 40 END WHEN bd = 5 THEN CASE WHEN el THEN 66 ELSE 50 END "
    "WHEN bd = 6 THEN CASE WHEN el THEN 80 ELSE 50 END ELSE -1 END END AS tank, "
    "CASE p_type WHEN 'SMALL' THEN 0.82 WHEN 'LARGE' THEN round(1.2101 * (3 + (p_size % 10) / 10.0) - 0.6052, 3) "
    "WHEN 'MEDIUM' THEN 2.3 WHEN 'PROMO' THEN 0.95 ELSE 0.62 END::DOUBLE AS water_heater_efficiency_ef, "
    "CASE WHEN p_type IN ('SMALL', 'LARGE', 'MEDIUM', 'PROMO') THEN 1.0 ELSE 0.78 END::DOUBLE AS water_heater_recovery_efficiency_ef "
    "FROM (SELECT *, p_size % 7 + 1 AS bd, p_type = 'PROMO' AS el FROM part)"
)
def water_heater_specs(spark, folder):
    label = (
        "CASE p_type WHEN 'SMALL' THEN 'Natural Gas Tankless' "
        "WHEN 'LARGE' THEN concat('Electric Heat Pump, ', 40 + p_size, ' gal, 3.', p_size % 10, ' UEF') "
        "WHEN 'MEDIUM' THEN 'Electric Heat Pump, 80 gal' WHEN 'PROMO' THEN 'Electric Premium' "
        "ELSE 'FIXME Fuel Oil Indirect' END AS label"
    )
    parts = _parts(spark, folder, label, "p_size % 7 + 1 AS beds", "p_type = 'PROMO' AS electric")
    read = parts.withColumn("spec", water_heater.spec_struct("label"))
    sized = water_heater.tank_gallons("beds", F.col("beds") / 2 + 0.5, "electric")
    return read.select(
        "p_partkey",
        "spec.water_heater_type",
        "spec.water_heater_efficiency_ef",
        "spec.water_heater_recovery_efficiency_ef",
        F.coalesce("spec.water_heater_tank_volume_gal", sized, F.lit(-1)).alias("tank"),
    )


@registry.add(
    "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 1 ELSE 0 END AS level, "
    "CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END IS TRUE AS finished, "
    "CASE WHEN o_custkey % 12 > 10 THEN 11 ELSE o_custkey % 12 END::INTEGER AS occupants, "
    "CASE o_custkey % 4 WHEN 0 THEN 15 WHEN 1 THEN 9999 ELSE o_custkey % 4 END::DOUBLE AS distance, "
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'now' ELSE o_orderpriority END AS renamed FROM orders"
)
def map_recode(spark, folder):
    orders = table(spark, folder, "orders")
    people = F.when(F.col("o_custkey") % 12 > 10, "10+").otherwise(
        (F.col("o_custkey") % 12).cast("string")
    )
    near = (
        F.when(F.col("o_custkey") % 4 == 0, "Left/Right at 15ft")
        .when(F.col("o_custkey") % 4 == 1, "None")
        .otherwise((F.col("o_custkey") % 4).cast("string"))
    )
    levels = {"1-URGENT": 3, "2-HIGH": 2, "3-MEDIUM": 1}
    return orders.select(
        "o_orderkey",
        lookup.look_up("o_orderpriority", levels, default=0).alias("level"),
        F.coalesce(lookup.look_up("o_orderstatus", {"F": True, "O": False}), F.lit(False)).alias(
            "finished"
        ),
        text.number_or(people, {"10+": 11}, "int").alias("occupants"),
        text.number_or(near, {"Left/Right at 15ft": 15.0, "None": 9999.0}, "double").alias(
            "distance"
        ),
        lookup.relabel("o_orderpriority", {"1-URGENT": "now"}).alias("renamed"),
    )


@registry.add(
    "SELECT p_partkey, split_part(p_name, ' ', 1) AS first_word, "
    "coalesce(try_cast(split_part(p_brand, '#', 2) AS integer), 0) AS brand, "
    "CASE WHEN p_size % 2 = 0 THEN 0 ELSE p_size END AS cars, "
    "CASE WHEN p_type = 'SMALL' THEN 'Shingle-Asbestos' ELSE 'Vinyl' END AS material, "
    "CASE WHEN p_type = 'SMALL' THEN 'Medium' WHEN p_type = 'LARGE' THEN 'None' ELSE 'Light' END AS color FROM part"
)
def split_pick_default(spark, folder):
    parts = _parts(
        spark,
        folder,
        "p_name",
        "p_brand",
        "CASE WHEN p_size % 2 = 0 THEN 'None' ELSE concat(p_size, ' Car') END AS garage",
        "CASE p_type WHEN 'SMALL' THEN 'Shingle, Asbestos, Medium' WHEN 'LARGE' THEN 'Vinyl' ELSE 'Vinyl, Light' END AS finish",
    )
    return parts.select(
        "p_partkey",
        text.part_of("p_name", " ", 0).alias("first_word"),
        text.part_of("p_brand", "#", 1, "int", default=0).alias("brand"),
        text.part_of("garage", " ", 0, "int", default=0).alias("cars"),
        text.wall_finish_material("finish").alias("material"),
        text.wall_finish_color("finish").alias("color"),
    )


@registry.add(
    "SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 'Wall Furnace' WHEN 'LARGE' THEN 'Furnace' WHEN 'MEDIUM' THEN 'Boiler' "
    "WHEN 'PROMO' THEN 'None' ELSE 'Baseboard' END AS appliance, "
    "CASE WHEN p_size % 3 = 0 THEN 'Electric' WHEN p_size % 3 = 1 THEN 'Electric' ELSE 'Gas' END AS range_fuel FROM part"
)
def replace_classify(spark, folder):
    parts = _parts(
        spark,
        folder,
        "split(p_name, ' ')[0] AS fuel",
        "concat(CASE p_type WHEN 'PROMO' THEN '' ELSE '' END, split(p_name, ' ')[0], CASE p_type WHEN 'SMALL' THEN ' Fuel Wall Furnace' "
        "WHEN 'LARGE' THEN ' Electric Furnace' WHEN 'MEDIUM' THEN ' Fuel Boiler' WHEN 'PROMO' THEN '' ELSE ' Baseboard' END) AS label",
        "CASE p_size % 3 WHEN 0 THEN 'Electric Induction' WHEN 1 THEN 'Electric Resistance' ELSE 'Gas' END AS range",
    )
    return parts.select(
        "p_partkey",
        text.heating_appliance("label", "fuel").alias("appliance"),
        text.range_fuel("range").alias("range_fuel"),
    )


@registry.add(
    "WITH n AS (SELECT *, list_extract(['01','06','17','36','48'], n_regionkey + 1) AS st, lpad((2 * n_nationkey + 1)::VARCHAR, 3, '0') AS co FROM nation) "
    "SELECT c_custkey, st || co AS geoid, 'G' || st || '0' || co || '0' AS gisjoin, "
    "CASE st WHEN '01' THEN 'AL' WHEN '06' THEN 'CA' WHEN '17' THEN 'IL' WHEN '36' THEN 'NY' ELSE 'TX' END AS state, "
    "n_regionkey + 1 AS zone, substr('ABC', n_nationkey % 3 + 1, 1) AS moisture FROM customer JOIN n ON n_nationkey = c_nationkey"
)
def geo_codes(spark, folder):
    nations = table(spark, folder, "nation").select(
        "n_nationkey",
        F.expr(
            "concat('G', element_at(array('01','06','17','36','48'), n_regionkey + 1), '0', "
            "lpad(2 * n_nationkey + 1, 3, '0'), '0')"
        ).alias("gisjoin"),
        F.expr("concat(n_regionkey + 1, substr('ABC', n_nationkey % 3 + 1, 1))").alias("climate"),
    )
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    located = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    geoid = lookup.gisjoin_to_geoid("gisjoin", strict=True)
    return located.select(
        "c_custkey",
        geoid.alias("geoid"),
        lookup.geoid_to_gisjoin(geoid).alias("gisjoin"),
        lookup.gisjoin_state("gisjoin", strict=True).alias("state"),
        text.zone_number("climate").alias("zone"),
        text.zone_moisture("climate").alias("moisture"),
    )


@registry.add(
    "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'Natural Gas' WHEN 1 THEN 'Fuel Oil' ELSE 'Propane' END AS fuel, "
    "CASE p_type WHEN 'SMALL' THEN 'MZ' WHEN 'LARGE' THEN 'SZ' ELSE '' END AS zone, "
    "CASE p_type WHEN 'SMALL' THEN 0.12 WHEN 'LARGE' THEN 0.02 ELSE 0.15 END::DOUBLE AS lamp, "
    "(p_size % 8) * 45 AS heading FROM part"
)
def label_lookups(spark, folder):
    headings = ", ".join(f"'{h}'" for h in lookup.HEADING_DEGREES)
    parts = _parts(
        spark,
        folder,
        "CASE p_size % 3 WHEN 0 THEN 'natural_gas' WHEN 1 THEN 'fuel_oil' ELSE 'propane' END AS fuel",
        "CASE p_type WHEN 'SMALL' THEN 'MSHP MZ, SEER 22' WHEN 'LARGE' THEN 'MSHP SZ, SEER 22' ELSE 'ASHP' END AS pump",
        "CASE p_type WHEN 'SMALL' THEN '100% CFL' WHEN 'LARGE' THEN '100% Incandescent' ELSE '100% LED' END AS lamp",
        f"element_at(array({headings}), p_size % 8 + 1) AS heading",
    )
    return parts.select(
        "p_partkey",
        text.prettify("fuel").alias("fuel"),
        text.zone_type("pump").alias("zone"),
        lookup.look_up("lamp", lookup.LAMP_EFFICIENCY).alias("lamp"),
        lookup.look_up("heading", lookup.HEADING_DEGREES).alias("heading"),
    )
