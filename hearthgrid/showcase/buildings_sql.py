"""SQL of the building-feature and scenario queries, written without the library's rules."""

from __future__ import annotations

from hearthgrid.showcase.stock import raw_metadata_sql

ELIGIBLE = """
  geometry_building_type_acs IN ('Single-Family Detached','Single-Family Attached','Mobile Home','2 Unit','3 or 4 Unit')
  AND heating_fuel NOT IN ('Other Fuel','None') AND water_heater_fuel <> 'Other Fuel'
  AND hvac_heating_type_and_fuel NOT IN ('Electricity ASHP','Electricity MSHP')
  AND vacancy_status = 'Occupied' AND hvac_has_shared_system = 'None' AND water_heater_in_unit = 'Yes'
"""

ALIGNED = f"""
raw22 AS ({raw_metadata_sql(2022)}),
raw24 AS ({raw_metadata_sql(2024)}),
aligned22 AS (
  SELECT * EXCLUDE (ducts, schedules, hvac_secondary_heating_type_and_fuel)
  REPLACE (
    split_part(clothes_dryer, ',', 1) AS clothes_dryer,
    split_part(clothes_washer, ',', 1) AS clothes_washer,
    split_part(dishwasher, ',', 1) AS dishwasher,
    split_part(refrigerator, ',', 1) AS refrigerator,
    CASE split_part(cooking_range, ',', 1) WHEN 'Electric' THEN 'Electric Resistance'
      ELSE split_part(cooking_range, ',', 1) END AS cooking_range,
    CASE misc_hot_tub_spa WHEN 'Electric' THEN 'Electricity' WHEN 'Gas' THEN 'Natural Gas'
      ELSE misc_hot_tub_spa END AS misc_hot_tub_spa,
    CASE misc_pool_heater WHEN 'Electric' THEN 'Electricity' WHEN 'Gas' THEN 'Natural Gas'
      WHEN 'Solar' THEN 'Other Fuel' ELSE misc_pool_heater END AS misc_pool_heater,
    CASE hvac_cooling_type WHEN 'Heat Pump' THEN 'Ducted Heat Pump'
      ELSE hvac_cooling_type END AS hvac_cooling_type),
    replace(ducts, 'Leakage', 'Leakage to Outside') AS duct_leakage_and_insulation,
    CASE WHEN hvac_has_ducts = 'Yes' THEN 'Unknown Location' ELSE 'None' END AS duct_location,
    CASE WHEN water_heater_in_unit = 'Yes' THEN 'Inside Unit' ELSE 'Outside' END AS water_heater_location,
    'ResStock 2022.1' AS building_set
  FROM raw22 WHERE {ELIGIBLE}),
aligned24 AS (
  SELECT * EXCLUDE (clothes_dryer_usage_level, battery, geometry_space_combination)
  REPLACE (
    replace(hvac_heating_type_and_fuel, 'MSHP', 'ASHP') AS hvac_heating_type_and_fuel,
    replace(hvac_heating_efficiency, 'MSHP', 'ASHP') AS hvac_heating_efficiency,
    CASE WHEN hvac_cooling_efficiency IN ('Ducted Heat Pump', 'Non-Ducted Heat Pump')
      THEN 'Heat Pump' ELSE hvac_cooling_efficiency END AS hvac_cooling_efficiency),
    'ResStock 2024.2' AS building_set
  FROM raw24 WHERE {ELIGIBLE}),
aligned AS (SELECT * FROM aligned24 UNION ALL BY NAME SELECT * FROM aligned22)
"""


def _r(column: str, none: int = 0) -> str:
    return (
        f"CASE WHEN lower({column}) = 'none' THEN {none} "
        f"WHEN contains(lower({column}), 'uninsulated') THEN 0 "
        f"ELSE cast(regexp_extract({column}, 'R-?([0-9]+)', 1) AS integer) END"
    )


def _pct(column: str) -> str:
    return (
        f"CASE WHEN {column} = 'None' THEN 0.0::DOUBLE "
        f"ELSE cast(regexp_extract({column}, '^<?([0-9]+)%', 1) AS double) / 100 END"
    )


def _fuel(text: str) -> str:
    return f"CASE {text} WHEN 'Gas' THEN 'Natural Gas' WHEN 'Electric' THEN 'Electricity' ELSE {text} END"


def _ef(column: str) -> str:
    return (
        f"CASE WHEN contains({column}, 'None') THEN 99.0::DOUBLE "
        f"ELSE cast(substr(split_part({column}, ',', 1), 4) AS double) END"
    )


def _deg(column: str) -> str:
    return f"cast(replace({column}, 'F', '') AS double)"


def wh_type(label: str) -> str:
    return (
        f"CASE WHEN contains({label}, 'Tankless') THEN 'Instantaneous' "
        f"WHEN starts_with({label}, 'Electric Heat Pump') THEN 'Heat Pump' ELSE 'Storage' END"
    )


def wh_tank(label: str) -> str:
    return (
        f"CASE WHEN contains({label}, 'Tankless') THEN 0 "
        f"WHEN contains({label}, ' gal') THEN cast(regexp_extract({label}, '([0-9]+) gal', 1) AS integer) END"
    )


def wh_ef(label: str) -> str:
    return (
        f"CASE WHEN contains({label}, ' UEF') THEN "
        f"round(1.2101 * cast(regexp_extract({label}, '([0-9.]+) UEF', 1) AS double) - 0.6052, 3) "
        f"ELSE CASE split_part({label}, ', ', 1) WHEN 'Natural Gas Standard' THEN 0.59 "
        "WHEN 'Propane Standard' THEN 0.59 WHEN 'Fuel Oil Standard' THEN 0.62 "
        "WHEN 'Natural Gas Premium' THEN 0.67 WHEN 'Propane Premium' THEN 0.67 "
        "WHEN 'Fuel Oil Premium' THEN 0.68 WHEN 'Natural Gas Tankless' THEN 0.82 "
        "WHEN 'Propane Tankless' THEN 0.82 WHEN 'Electric Standard' THEN 0.92 "
        "WHEN 'Electric Premium' THEN 0.95 WHEN 'Electric Tankless' THEN 0.99 "
        "WHEN 'Electric Heat Pump' THEN 2.3 END::DOUBLE END"
    )


def wh_re(label: str) -> str:
    return (
        f"CASE split_part({label}, ', ', 1) WHEN 'Natural Gas Standard' THEN 0.76 "
        "WHEN 'Propane Standard' THEN 0.76 WHEN 'Fuel Oil Standard' THEN 0.78 "
        "WHEN 'Natural Gas Premium' THEN 0.78 WHEN 'Propane Premium' THEN 0.78 "
        "WHEN 'Fuel Oil Premium' THEN 0.9 ELSE 1.0 END::DOUBLE"
    )


TANK_BY_ROOMS = """
CASE WHEN bd = 1 THEN 20
 WHEN bd = 2 AND ba < 2 THEN 30
 WHEN bd = 2 AND ba < 3 THEN CASE WHEN el THEN 40 ELSE 30 END
 WHEN bd = 2 THEN CASE WHEN el THEN 50 ELSE 40 END
 WHEN bd = 3 AND ba < 2 THEN CASE WHEN el THEN 40 ELSE 30 END
 WHEN bd = 3 THEN CASE WHEN el THEN 50 ELSE 40 END
 WHEN bd = 4 AND ba < 3 THEN CASE WHEN el THEN 50 ELSE 40 END
 WHEN bd = 4 THEN CASE WHEN el THEN 66 ELSE 50 END
 WHEN bd = 5 THEN CASE WHEN el THEN 66 ELSE 50 END
 WHEN bd = 6 THEN CASE WHEN el THEN 80 ELSE 50 END END
"""

FEATURES = f"""
windowspec(windows, window_ufactor, window_shgc) AS (VALUES
  ('Double, Low-E, H-Gain', 0.29::DOUBLE, 0.56::DOUBLE), ('Double, Clear, Metal, Air', 0.76, 0.67),
  ('Single, Clear, Metal', 1.16, 0.76), ('Single, Clear, Non-metal', 0.84, 0.63),
  ('Triple, Low-E, Non-metal, Air, L-Gain', 0.29, 0.26), ('No Windows', 0.84, 0.63)),
rooms AS (SELECT *, cast(bedrooms AS integer) AS bd, cast(bedrooms AS integer) / 2.0 + 0.5 AS ba,
  water_heater_fuel = 'Electricity' AS el, geometry_building_type_acs AS kind,
  trim(replace(hvac_heating_type_and_fuel, heating_fuel, '')) AS heater FROM aligned),
features AS (
  SELECT building_id, building_set, weather_file_city, bd AS n_bedrooms, cast(ba AS double) AS n_bathrooms,
    geometry_attic_type AS attic_type, cast(sqft AS double) AS sqft,
    geometry_foundation_type AS foundation_type,
    coalesce(try_cast(split_part(geometry_garage, ' ', 1) AS integer), 0) AS garage_size_n_car,
    cast(geometry_stories AS integer) AS n_stories,
    CASE orientation WHEN 'North' THEN 0 WHEN 'Northeast' THEN 45 WHEN 'East' THEN 90
      WHEN 'Southeast' THEN 135 WHEN 'South' THEN 180 WHEN 'Southwest' THEN 225
      WHEN 'West' THEN 270 WHEN 'Northwest' THEN 315 END AS orientation_degrees,
    roof_material,
    (cast(regexp_extract(window_areas, 'F([0-9]+)', 1) AS integer)
     + cast(regexp_extract(window_areas, 'B([0-9]+)', 1) AS integer)
     + cast(regexp_extract(window_areas, 'L([0-9]+)', 1) AS integer)
     + cast(regexp_extract(window_areas, 'R([0-9]+)', 1) AS integer))::DOUBLE / 4 AS window_wall_ratio,
    window_ufactor, window_shgc, heating_fuel,
    CASE WHEN contains(heater, 'Wall Furnace') THEN 'Wall Furnace' WHEN contains(heater, 'Furnace') THEN 'Furnace'
      WHEN contains(heater, 'Boiler') THEN 'Boiler' WHEN heater = '' THEN 'None' ELSE heater END AS heating_appliance_type,
    CASE WHEN heater = 'ASHP' THEN 'ACCA' ELSE 'None' END AS heat_pump_sizing_methodology,
    hvac_heating_type IN ('Ducted Heat Pump', 'Ducted Heating') AS has_ducted_heating,
    round(cast(regexp_extract(hvac_heating_efficiency, '([0-9.]+)%', 1) AS double) / 100, 3)
      AS heating_efficiency_nominal_percentage,
    {_deg('heating_setpoint')} AS heating_setpoint_degrees_f,
    {_deg('heating_setpoint_offset_magnitude')} AS heating_setpoint_offset_magnitude_degrees_f,
    hvac_heating_efficiency,
    split_part(hvac_cooling_efficiency, ',', 1) AS ac_type,
    {_pct('hvac_cooling_partial_space_conditioning')} AS cooled_space_percentage,
    CASE WHEN hvac_cooling_efficiency = 'None' THEN 999.0::DOUBLE
      WHEN contains(hvac_cooling_efficiency, 'SEER') THEN
        round(0.875::DOUBLE * cast(regexp_extract(hvac_cooling_efficiency, 'SEER ([0-9.]+)', 1) AS double), 3)
      ELSE cast(regexp_extract(hvac_cooling_efficiency, 'EER ([0-9.]+)', 1) AS double) END AS cooling_efficiency_eer,
    {_deg('cooling_setpoint')} AS cooling_setpoint_degrees_f,
    {_deg('cooling_setpoint_offset_magnitude')} AS cooling_setpoint_offset_magnitude_degrees_f,
    hvac_cooling_type IN ('Central AC', 'Ducted Heat Pump') AS has_ducted_cooling,
    water_heater_efficiency, water_heater_fuel,
    {wh_type('water_heater_efficiency')} AS water_heater_type,
    coalesce({wh_tank('water_heater_efficiency')}, {TANK_BY_ROOMS}) AS water_heater_tank_volume_gal,
    {wh_ef('water_heater_efficiency')} AS water_heater_efficiency_ef,
    {wh_re('water_heater_efficiency')} AS water_heater_recovery_efficiency_ef,
    water_heater_in_unit = 'Yes' AS has_water_heater_in_unit, water_heater_location,
    duct_leakage_and_insulation, hvac_has_ducts = 'Yes' AS has_ducts, duct_location,
    {_r('duct_leakage_and_insulation', 999)} AS duct_insulation_r_value,
    {_pct('duct_leakage_and_insulation')} AS duct_leakage_percentage,
    cast(split_part(infiltration, ' ', 1) AS integer) AS infiltration_ach50,
    insulation_wall, split_part(insulation_wall, ',', 1) AS wall_material,
    {_r('insulation_wall')} AS insulation_wall_r_value,
    {_r('insulation_foundation_wall')} AS insulation_foundation_wall_r_value,
    {_r('insulation_slab')} AS insulation_slab_r_value,
    {_r('insulation_rim_joist')} AS insulation_rim_joist_r_value,
    {_r('insulation_floor')} AS insulation_floor_r_value,
    {_r('insulation_roof')} AS insulation_roof_r_value,
    {_r('insulation_ceiling')} AS insulation_ceiling_r_value,
    kind NOT IN ('Single-Family Detached', 'Mobile Home') AS is_attached,
    kind = 'Mobile Home' AS is_mobile_home,
    cast(coalesce(nullif(geometry_building_number_units_sfa, 'None'),
      nullif(geometry_building_number_units_mf, 'None'), '1') AS integer) AS n_building_units,
    geometry_building_horizontal_location_sfa = 'Middle' OR geometry_building_horizontal_location_mf = 'Middle'
      AS is_middle_unit,
    geometry_building_level_mf AS unit_level_in_building,
    ceiling_fan <> 'None' AS has_ceiling_fan,
    {_fuel('clothes_dryer')} AS clothes_dryer_fuel, clothes_washer AS clothes_washer_efficiency,
    {_fuel("replace(replace(cooking_range, ' Induction', ''), ' Resistance', '')")} AS cooking_range_fuel,
    cooking_range = 'Electric Induction' AS has_induction_range,
    coalesce(try_cast(split_part(dishwasher, ' ', 1) AS integer), 9999) AS dishwasher_efficiency_kwh,
    CASE lighting WHEN '100% CFL' THEN 0.12 WHEN '100% Incandescent' THEN 0.02 WHEN '100% LED' THEN 0.15 END::DOUBLE
      AS lighting_efficiency,
    {_ef('misc_extra_refrigerator')} AS refrigerator_extra_efficiency_ef,
    misc_freezer <> 'None' AS has_standalone_freezer,
    misc_gas_fireplace <> 'None' AS has_gas_fireplace, misc_gas_grill <> 'None' AS has_gas_grill,
    misc_gas_lighting <> 'None' AS has_gas_lighting, misc_well_pump <> 'None' AS has_well_pump,
    {_fuel('misc_hot_tub_spa')} AS hot_tub_spa_fuel, {_fuel('misc_pool_heater')} AS pool_heater_fuel,
    {_ef('refrigerator')} AS refrigerator_efficiency_ef, {_pct('plug_loads')} AS plug_load_percentage,
    CASE usage_level WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 END AS usage_level_appliances,
    cast(substr(ashrae_iecc_climate_zone_2004, 1, 1) AS integer) AS climate_zone_temp,
    substr(ashrae_iecc_climate_zone_2004, 2, 1) AS climate_zone_moisture,
    CASE WHEN neighbors = 'Left/Right at 15ft' THEN 15 WHEN neighbors = 'None' THEN 9999
      ELSE cast(neighbors AS double) END::DOUBLE AS neighbor_distance_ft,
    CASE WHEN occupants = '10+' THEN 11 ELSE cast(occupants AS integer) END AS n_occupants,
    CASE WHEN starts_with(vintage, '<') THEN 1930 ELSE cast(substr(vintage, 1, 4) AS integer) + 5 END AS vintage
  FROM rooms JOIN windowspec USING (windows))
"""

SCENARIOS = """
scenario(upgrade_id, upgrade_name, building_set) AS (VALUES
  (0.0::DOUBLE, 'Baseline', 'ResStock 2022.1'), (0.01, 'Baseline, no setback', 'ResStock 2024.2'),
  (1.0, 'Basic enclosure', 'ResStock 2022.1'), (3.0, 'Minimum-efficiency heat pump', 'ResStock 2022.1'),
  (4.0, 'High-efficiency heat pump', 'ResStock 2022.1'), (6.0, 'Heat pump water heater', 'ResStock 2022.1'),
  (9.0, 'Whole-home electrification and basic enclosure', 'ResStock 2022.1'),
  (11.05, 'Medium-efficiency heat pump, no setback', 'ResStock 2022.1'),
  (11.07, 'Medium-efficiency heat pump, no setback, later stock', 'ResStock 2024.2'),
  (13.01, 'Medium-efficiency heat pump, no setback, basic enclosure', 'ResStock 2022.1'),
  (13.02, 'Medium-efficiency heat pump, no setback, light air sealing', 'ResStock 2024.2'),
  (15.04, 'Cold-climate ductless heat pump, first product', 'ResStock 2024.2'),
  (15.05, 'Cold-climate ductless heat pump, second product', 'ResStock 2024.2'),
  (15.06, 'Cold-climate ductless heat pump, third product', 'ResStock 2024.2'),
  (15.08, 'Cold-climate ducted heat pump', 'ResStock 2024.2')),
curve(label, r1, r2, r3, r4, r5, r6, c1, c2, c3, c4, c5, c6) AS (VALUES
  ('ASHP, SEER 15, 9 HSPF', 0.98::DOUBLE, 0.62::DOUBLE, 0.50::DOUBLE, 1.01::DOUBLE, 0.64::DOUBLE, 0.52::DOUBLE, 3.80::DOUBLE, 2.79::DOUBLE, 2.41::DOUBLE, 4.34::DOUBLE, 3.23::DOUBLE, 2.78::DOUBLE),
  ('ASHP, SEER 18, 10 HSPF', 1.01, 0.60, 0.44, 1.04, 0.63, 0.47, 4.23, 2.57, 1.98, 5.83, 3.44, 2.85),
  ('Carrier MSHP MZ, SEER 26.25, 10.64 HSPF', 0.34, 0.24, 0.22, 1.16, 0.76, 0.72, 4.92, 2.93, 2.43, 3.54, 2.3, 2.0),
  ('Carrier MSHP SZ, SEER 24.255, 13.104 HSPF', 0.4, 0.24, 0.26, 1.23, 0.77, 0.78, 5.58, 2.37, 2.0, 2.87, 2.33, 2.54),
  ('Daikin 7 series ASHP, SEER 20, 10.35 HSPF', 0.25, 0.41, 0.34, 1.0, 0.94, 0.73, 4.32, 2.75, 2.36, 3.3, 2.32, 2.0),
  ('Daikin MSHP MZ, SEER 22.05, 11.2 HSPF', 0.32, 0.22, 0.18, 1.33, 1.08, 1.0, 4.95, 4.85, 4.96, 2.61, 1.99, 1.80),
  ('Daikin MSHP SZ, SEER 22.05, 10.64 HSPF', 0.24, 0.15, 0.12, 1.13, 0.98, 0.79, 5.76, 5.55, 5.47, 4.25, 2.63, 1.8),
  ('MSHP, SEER 24, 13 HSPF', 0.97, 0.73, 0.63, 1.03, 0.79, 0.69, 5.72, 3.66, 3.26, 8.27, 5.93, 5.31),
  ('York MSHP MZ, SEER 25.36, 11.2 HSPF', 0.44, 0.42, 0.12, 1.55, 1.01, 0.95, 2.3, 1.45, 0.3, 2.9, 2.4, 1.8),
  ('York MSHP SZ, SEER 23.625, 11.21 HSPF', 0.33, 0.42, 0.21, 1.04, 1.0, 0.8, 4.7, 1.95, 1.96, 2.4, 1.86, 1.80)),
installed(product, heat, eer) AS (VALUES
  ('ASHP, SEER 15, 9 HSPF', 2.638::DOUBLE, 13.125::DOUBLE), ('ASHP, SEER 18, 10 HSPF', 2.931, 15.75),
  ('ASHP, SEER 18, 10.5 HSPF', 3.077, 15.75), ('MSHP, SEER 24, 13 HSPF', 3.81, 21.0),
  ('MSHP, SEER 29.3, 14 HSPF', 4.103, 25.637), ('Daikin MSHP SZ, SEER 22.05, 10.64 HSPF', 3.118, 19.294),
  ('Daikin MSHP MZ, SEER 22.05, 11.2 HSPF', 3.282, 19.294), ('Carrier MSHP SZ, SEER 24.255, 13.104 HSPF', 3.84, 21.223),
  ('Carrier MSHP MZ, SEER 26.25, 10.64 HSPF', 3.118, 22.969), ('York MSHP SZ, SEER 23.625, 11.21 HSPF', 3.285, 20.672),
  ('York MSHP MZ, SEER 25.36, 11.2 HSPF', 3.282, 22.19), ('Daikin 7 series ASHP, SEER 20, 10.35 HSPF', 3.033, 17.5)),
multiplied AS (
  SELECT *,
    upgrade_id IN (1, 9, 13.01) AS enclosure,
    upgrade_id IN (3, 4, 9, 11.05, 11.07, 13.01, 13.02) AS by_ducts,
    upgrade_id IN (15.04, 15.05, 15.06) AND heating_fuel <> 'None'
      AND (heating_efficiency_nominal_percentage < 3.722 OR cooling_efficiency_eer < 21.875) AS ductless,
    upgrade_id = 15.08 AND has_ducts AS ducted_only,
    n_bedrooms = 1 OR sqft <= 749 OR (n_bedrooms = 2 AND sqft <= 999) AS small_home,
    has_ducts AND duct_leakage_and_insulation NOT IN
      ('0% Leakage to Outside, Uninsulated', '30% Leakage to Outside, Uninsulated') AS improvable
  FROM features JOIN scenario USING (building_set)),
chosen AS (
  SELECT *,
    CASE WHEN upgrade_id = 3 THEN 'ASHP, SEER 15, 9 HSPF'
      WHEN upgrade_id IN (4, 9) THEN 'MSHP, SEER 24, 13 HSPF'
      WHEN by_ducts THEN 'ASHP, SEER 18, 10 HSPF'
      WHEN ductless THEN CASE upgrade_id
        WHEN 15.04 THEN CASE WHEN small_home THEN 'Daikin MSHP SZ, SEER 22.05, 10.64 HSPF' ELSE 'Daikin MSHP MZ, SEER 22.05, 11.2 HSPF' END
        WHEN 15.05 THEN CASE WHEN small_home THEN 'Carrier MSHP SZ, SEER 24.255, 13.104 HSPF' ELSE 'Carrier MSHP MZ, SEER 26.25, 10.64 HSPF' END
        ELSE CASE WHEN small_home THEN 'York MSHP SZ, SEER 23.625, 11.21 HSPF' ELSE 'York MSHP MZ, SEER 25.36, 11.2 HSPF' END END
      WHEN upgrade_id IN (15.04, 15.05, 15.06) THEN ''
      WHEN ducted_only THEN 'Daikin 7 series ASHP, SEER 20, 10.35 HSPF'
      ELSE hvac_heating_efficiency END AS label
  FROM multiplied),
product AS (
  SELECT *, CASE WHEN by_ducts AND NOT has_ducts THEN
      CASE label WHEN 'MSHP, SEER 24, 13 HSPF' THEN 'MSHP, SEER 29.3, 14 HSPF'
        WHEN 'ASHP, SEER 18, 10 HSPF' THEN 'ASHP, SEER 18, 10.5 HSPF' ELSE label END
    WHEN by_ducts OR ductless OR ducted_only THEN label END AS product,
    by_ducts OR ducted_only OR upgrade_id IN (15.04, 15.05, 15.06) AS pump,
    CASE WHEN upgrade_id IN (6, 9) AND water_heater_efficiency <> 'Electric Tankless' THEN
      CASE WHEN n_bedrooms <= 3 THEN 'Electric Heat Pump, 50 gal, 3.45 UEF'
        WHEN n_bedrooms = 4 THEN 'Electric Heat Pump, 66 gal, 3.35 UEF'
        ELSE 'Electric Heat Pump, 80 gal, 3.45 UEF' END
      ELSE water_heater_efficiency END AS heater_label
  FROM chosen)
"""

UNTOUCHED = """building_id, building_set, weather_file_city, upgrade_id, upgrade_name, n_bedrooms, n_bathrooms,
  attic_type, sqft, foundation_type, garage_size_n_car, n_stories, orientation_degrees, roof_material,
  window_wall_ratio, window_ufactor, window_shgc, heating_setpoint_degrees_f, cooling_setpoint_degrees_f,
  has_water_heater_in_unit, water_heater_location, duct_leakage_and_insulation, has_ducts, duct_location,
  wall_material, insulation_foundation_wall_r_value, insulation_slab_r_value, insulation_rim_joist_r_value,
  insulation_floor_r_value, insulation_roof_r_value, is_attached, is_mobile_home, n_building_units, is_middle_unit,
  unit_level_in_building, has_ceiling_fan, clothes_washer_efficiency, dishwasher_efficiency_kwh, lighting_efficiency,
  refrigerator_extra_efficiency_ef, has_standalone_freezer, has_gas_fireplace, has_gas_grill, has_gas_lighting,
  has_well_pump, hot_tub_spa_fuel, pool_heater_fuel, refrigerator_efficiency_ef, plug_load_percentage,
  usage_level_appliances, climate_zone_temp, climate_zone_moisture, neighbor_distance_ft, n_occupants, vintage"""

UPGRADED = f"""
changed AS (
  SELECT {UNTOUCHED}, label AS hvac_heating_efficiency,
    CASE WHEN pump THEN 'Electricity' ELSE heating_fuel END AS heating_fuel,
    CASE WHEN pump THEN 'ASHP' ELSE heating_appliance_type END AS heating_appliance_type,
    CASE WHEN upgrade_id IN (3, 4, 9) THEN 'ACCA' WHEN pump THEN 'HERS' ELSE heat_pump_sizing_methodology END
      AS heat_pump_sizing_methodology,
    CASE WHEN by_ducts THEN has_ducts WHEN ductless THEN false WHEN ducted_only THEN true
      ELSE has_ducted_heating END AS has_ducted_heating,
    CASE WHEN by_ducts THEN has_ducts WHEN ductless THEN false WHEN ducted_only THEN true
      ELSE has_ducted_cooling END AS has_ducted_cooling,
    coalesce(heat, heating_efficiency_nominal_percentage) AS heating_efficiency_nominal_percentage,
    coalesce(eer, cooling_efficiency_eer) AS cooling_efficiency_eer,
    CASE WHEN pump THEN 'Heat Pump' ELSE ac_type END AS ac_type,
    CASE WHEN pump THEN 1.0 ELSE cooled_space_percentage END AS cooled_space_percentage,
    CASE WHEN upgrade_id IN (0.01, 11.05, 11.07, 13.01, 13.02, 15.04, 15.05, 15.06, 15.08) THEN 0
      ELSE heating_setpoint_offset_magnitude_degrees_f END::DOUBLE AS heating_setpoint_offset_magnitude_degrees_f,
    CASE WHEN upgrade_id IN (0.01, 11.05, 11.07, 13.01, 13.02, 15.04, 15.05, 15.06, 15.08) THEN 0
      ELSE cooling_setpoint_offset_magnitude_degrees_f END::DOUBLE AS cooling_setpoint_offset_magnitude_degrees_f,
    CASE WHEN upgrade_id IN (6, 9) THEN 'Electricity' ELSE water_heater_fuel END AS water_heater_fuel,
    CASE WHEN upgrade_id IN (6, 9) THEN {wh_type('heater_label')} ELSE water_heater_type END AS water_heater_type,
    CASE WHEN upgrade_id IN (6, 9) THEN {wh_tank('heater_label')} ELSE water_heater_tank_volume_gal END AS water_heater_tank_volume_gal,
    CASE WHEN upgrade_id IN (6, 9) THEN {wh_ef('heater_label')} ELSE water_heater_efficiency_ef END AS water_heater_efficiency_ef,
    CASE WHEN upgrade_id IN (6, 9) THEN {wh_re('heater_label')} ELSE water_heater_recovery_efficiency_ef END AS water_heater_recovery_efficiency_ef,
    CASE WHEN enclosure AND improvable THEN greatest(duct_insulation_r_value, 8) ELSE duct_insulation_r_value END::DOUBLE
      AS duct_insulation_r_value,
    CASE WHEN enclosure AND improvable THEN least(duct_leakage_percentage, 0.1) ELSE duct_leakage_percentage END
      AS duct_leakage_percentage,
    CASE WHEN enclosure AND infiltration_ach50 >= 15 THEN infiltration_ach50::DOUBLE * 0.7::DOUBLE
      WHEN upgrade_id = 13.02 AND infiltration_ach50 > 15 THEN infiltration_ach50::DOUBLE * 0.6::DOUBLE
      WHEN upgrade_id = 13.02 AND infiltration_ach50 > 10 THEN infiltration_ach50::DOUBLE * 0.7::DOUBLE
      WHEN upgrade_id = 13.02 AND infiltration_ach50 > 7.5 THEN infiltration_ach50::DOUBLE * 0.8::DOUBLE
      ELSE infiltration_ach50::DOUBLE END AS infiltration_ach50,
    CASE WHEN enclosure AND insulation_wall = 'Wood Stud, Uninsulated' THEN 13 ELSE insulation_wall_r_value END
      AS insulation_wall_r_value,
    CASE WHEN enclosure AND attic_type = 'Vented Attic' AND climate_zone_temp = 1 AND insulation_ceiling_r_value <= 13 THEN 30
      WHEN enclosure AND attic_type = 'Vented Attic' AND climate_zone_temp IN (2, 3) AND insulation_ceiling_r_value <= 30 THEN 49
      WHEN enclosure AND attic_type = 'Vented Attic' AND climate_zone_temp BETWEEN 4 AND 7 AND insulation_ceiling_r_value <= 38 THEN 60
      ELSE insulation_ceiling_r_value END AS insulation_ceiling_r_value,
    CASE WHEN upgrade_id = 9 THEN 'Electricity' ELSE clothes_dryer_fuel END AS clothes_dryer_fuel,
    CASE WHEN upgrade_id = 9 THEN 'Electricity' ELSE cooking_range_fuel END AS cooking_range_fuel,
    upgrade_id = 9 AS has_heat_pump_dryer,
    upgrade_id = 9 OR has_induction_range AS has_induction_range
  FROM product LEFT JOIN installed ON installed.product = product.product),
upgraded AS (
  SELECT changed.*,
    list_contains([heating_fuel, water_heater_fuel, clothes_dryer_fuel, cooking_range_fuel, hot_tub_spa_fuel, pool_heater_fuel], 'Natural Gas')
      OR has_gas_fireplace OR has_gas_grill OR has_gas_lighting AS has_natural_gas_appliance,
    list_contains([heating_fuel, water_heater_fuel, clothes_dryer_fuel, cooking_range_fuel, hot_tub_spa_fuel, pool_heater_fuel], 'Fuel Oil')
      AS has_fuel_oil_appliance,
    list_contains([heating_fuel, water_heater_fuel, clothes_dryer_fuel, cooking_range_fuel, hot_tub_spa_fuel, pool_heater_fuel], 'Propane')
      AS has_propane_appliance,
    coalesce(r1, 1.0) AS min_capacity_retention_47f, coalesce(r2, 1.0) AS min_capacity_retention_17f,
    coalesce(r3, 1.0) AS min_capacity_retention_5f, coalesce(r4, 1.0) AS max_capacity_retention_47f,
    coalesce(r5, 1.0) AS max_capacity_retention_17f, coalesce(r6, 1.0) AS max_capacity_retention_5f,
    coalesce(c1, heating_efficiency_nominal_percentage) AS min_cop_47f,
    coalesce(c2, heating_efficiency_nominal_percentage) AS min_cop_17f,
    coalesce(c3, heating_efficiency_nominal_percentage) AS min_cop_5f,
    coalesce(c4, heating_efficiency_nominal_percentage) AS max_cop_47f,
    coalesce(c5, heating_efficiency_nominal_percentage) AS max_cop_17f,
    coalesce(c6, heating_efficiency_nominal_percentage) AS max_cop_5f
  FROM changed LEFT JOIN curve ON curve.label = changed.hvac_heating_efficiency)
"""

ALIGNED_WITH = f"WITH {ALIGNED}"
FEATURES_WITH = f"WITH {ALIGNED}, {FEATURES}"
UPGRADED_WITH = f"WITH {ALIGNED}, {FEATURES}, {SCENARIOS}, {UPGRADED}"
