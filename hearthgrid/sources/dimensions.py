"""Fixed dimension tables. All are literal and small, so they are always broadcast."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

ARROW_TYPES = {
    T.StringType(): pa.string(),
    T.DoubleType(): pa.float64(),
    T.IntegerType(): pa.int32(),
    T.LongType(): pa.int64(),
}


def literal(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A table held in the plan itself: its size is known and reading it takes no task."""
    fields = T.StructType.fromDDL(schema).fields
    columns = {
        field.name: pa.array([row[i] for row in rows], ARROW_TYPES[field.dataType])
        for i, field in enumerate(fields)
    }
    return spark.createDataFrame(pa.table(columns), schema)

# Window description -> (U-factor, solar heat gain coefficient).
WINDOWS = [
    ("Double, Clear, Thermal-Break, Air", 0.63, 0.62),
    ("Double, Low-E, H-Gain", 0.29, 0.56),
    ("Double, Low-E, L-Gain", 0.26, 0.31),
    ("Single, Clear, Metal, Exterior Low-E Storm", 0.57, 0.47),
    ("Single, Clear, Non-metal, Exterior Low-E Storm", 0.36, 0.46),
    ("Double, Clear, Metal, Exterior Low-E Storm", 0.49, 0.44),
    ("Double, Clear, Non-metal, Exterior Low-E Storm", 0.28, 0.42),
    ("Double, Clear, Metal, Air", 0.76, 0.67),
    ("Double, Clear, Metal, Air, Exterior Clear Storm", 0.55, 0.51),
    ("Double, Clear, Non-metal, Air", 0.49, 0.56),
    ("Double, Clear, Non-metal, Air, Exterior Clear Storm", 0.34, 0.49),
    ("Double, Low-E, Non-metal, Air, M-Gain", 0.38, 0.44),
    ("Double, Low-E, Non-metal, Air, L-Gain", 0.37, 0.30),
    ("Single, Clear, Metal", 1.16, 0.76),
    ("Single, Clear, Metal, Exterior Clear Storm", 0.67, 0.56),
    ("Single, Clear, Non-metal", 0.84, 0.63),
    ("Single, Clear, Non-metal, Exterior Clear Storm", 0.47, 0.54),
    ("Triple, Low-E, Non-metal, Air, L-Gain", 0.29, 0.26),
    ("Triple, Low-E, Insulated, Argon, H-Gain", 0.18, 0.40),
    ("Triple, Low-E, Insulated, Argon, L-Gain", 0.17, 0.27),
    ("No Windows", 0.84, 0.63),
]

# Floor-area bin -> midpoint by building type, in the order of TYPES.
FLOOR_AREA_TYPES = (
    "Mobile Home",
    "Single-Family Detached",
    "Single-Family Attached",
    "2 Unit",
    "3 or 4 Unit",
)
FLOOR_AREA = {
    "0-499": (328, 328, 317, 333, 333),
    "500-749": (633, 633, 617, 617, 617),
    "750-999": (885, 885, 866, 853, 853),
    "1000-1499": (1220, 1220, 1202, 1138, 1138),
    "1500-1999": (1690, 1690, 1675, 1623, 1623),
    "2000-2499": (2176, 2176, 2152, 2115, 2115),
    "2500-2999": (2663, 2663, 2631, 2590, 2590),
    "3000-3999": (3301, 3301, 3241, 3138, 3138),
    "4000+": (8194, 8194, 13414, 12291, 12291),
}

# Climate zone number -> (highest R-value upgraded, R-value after).
CEILING_TARGETS = {
    1: (13, 30),
    2: (30, 49),
    3: (30, 49),
    4: (38, 60),
    5: (38, 60),
    6: (38, 60),
    7: (38, 60),
}

# Names of the heat-pump curve parameters.
RETENTIONS = tuple(
    f"{bound}_capacity_retention_{at}" for bound in ("min", "max") for at in ("47f", "17f", "5f")
)
COPS = tuple(f"{bound}_cop_{at}" for bound in ("min", "max") for at in ("47f", "17f", "5f"))
# Heat pump -> curve parameters, in the order RETENTIONS + COPS.
HEAT_PUMP_CURVES = {
    "ASHP, SEER 15, 9 HSPF": (
        0.98, 0.62, 0.50, 1.01, 0.64, 0.52, 3.80, 2.79, 2.41, 4.34, 3.23, 2.78,
    ),
    "ASHP, SEER 18, 10 HSPF": (
        1.01, 0.60, 0.44, 1.04, 0.63, 0.47, 4.23, 2.57, 1.98, 5.83, 3.44, 2.85,
    ),
    "Carrier MSHP MZ, SEER 26.25, 10.64 HSPF": (
        0.34, 0.24, 0.22, 1.16, 0.76, 0.72, 4.92, 2.93, 2.43, 3.54, 2.3, 2.0,
    ),
    "Carrier MSHP SZ, SEER 24.255, 13.104 HSPF": (
        0.4, 0.24, 0.26, 1.23, 0.77, 0.78, 5.58, 2.37, 2.0, 2.87, 2.33, 2.54,
    ),
    "Daikin 7 series ASHP, SEER 20, 10.35 HSPF": (
        0.25, 0.41, 0.34, 1.0, 0.94, 0.73, 4.32, 2.75, 2.36, 3.3, 2.32, 2.0,
    ),
    "Daikin MSHP MZ, SEER 22.05, 11.2 HSPF": (
        0.32, 0.22, 0.18, 1.33, 1.08, 1.0, 4.95, 4.85, 4.96, 2.61, 1.99, 1.80,
    ),
    "Daikin MSHP SZ, SEER 22.05, 10.64 HSPF": (
        0.24, 0.15, 0.12, 1.13, 0.98, 0.79, 5.76, 5.55, 5.47, 4.25, 2.63, 1.8,
    ),
    "MSHP, SEER 24, 13 HSPF": (
        0.97, 0.73, 0.63, 1.03, 0.79, 0.69, 5.72, 3.66, 3.26, 8.27, 5.93, 5.31,
    ),
    "York MSHP MZ, SEER 25.36, 11.2 HSPF": (
        0.44, 0.42, 0.12, 1.55, 1.01, 0.95, 2.3, 1.45, 0.3, 2.9, 2.4, 1.8,
    ),
    "York MSHP SZ, SEER 23.625, 11.21 HSPF": (
        0.33, 0.42, 0.21, 1.04, 1.0, 0.8, 4.7, 1.95, 1.96, 2.4, 1.86, 1.80,
    ),
}
# Installed heat pump -> (heating fraction, cooling EER).
HEAT_PUMP_RATINGS = {
    "ASHP, SEER 15, 9 HSPF": (2.638, 13.125),
    "ASHP, SEER 18, 10 HSPF": (2.931, 15.75),
    "ASHP, SEER 18, 10.5 HSPF": (3.077, 15.75),
    "MSHP, SEER 24, 13 HSPF": (3.81, 21.0),
    "MSHP, SEER 29.3, 14 HSPF": (4.103, 25.637),
    "Daikin MSHP SZ, SEER 22.05, 10.64 HSPF": (3.118, 19.294),
    "Daikin MSHP MZ, SEER 22.05, 11.2 HSPF": (3.282, 19.294),
    "Carrier MSHP SZ, SEER 24.255, 13.104 HSPF": (3.84, 21.223),
    "Carrier MSHP MZ, SEER 26.25, 10.64 HSPF": (3.118, 22.969),
    "York MSHP SZ, SEER 23.625, 11.21 HSPF": (3.285, 20.672),
    "York MSHP MZ, SEER 25.36, 11.2 HSPF": (3.282, 22.19),
    "Daikin 7 series ASHP, SEER 20, 10.35 HSPF": (3.033, 17.5),
}


def windows(spark: SparkSession) -> DataFrame:
    return literal(
        spark, WINDOWS, "windows string, window_ufactor double, window_shgc double"
    )


def floor_area(spark: SparkSession) -> DataFrame:
    rows = [
        (area, kind, sqft)
        for area, by_type in FLOOR_AREA.items()
        for kind, sqft in zip(FLOOR_AREA_TYPES, by_type)
    ]
    return literal(
        spark, rows, "geometry_floor_area string, geometry_building_type_acs string, sqft int"
    )


def ceiling_targets(spark: SparkSession) -> DataFrame:
    rows = [(zone, *limits) for zone, limits in CEILING_TARGETS.items()]
    return literal(
        spark, rows, "climate_zone_temp int, ceiling_threshold int, ceiling_target int"
    )


def heat_pump_curves(spark: SparkSession) -> DataFrame:
    rows = [(label, *curve) for label, curve in HEAT_PUMP_CURVES.items()]
    columns = ", ".join(f"{name} double" for name in RETENTIONS + COPS)
    return literal(spark, rows, f"hvac_heating_efficiency string, {columns}")


def heat_pump_ratings(spark: SparkSession) -> DataFrame:
    rows = [(label, *ratings) for label, ratings in HEAT_PUMP_RATINGS.items()]
    return literal(
        spark, rows, "hp_label string, hp_heating_fraction double, hp_cooling_eer double"
    )


def label_index(spark: SparkSession, labels: list[str], first: int = 0) -> DataFrame:
    """Two-column table of labels and their positions."""
    rows = [(label, i) for i, label in enumerate(labels, first)]
    return literal(spark, rows, "label string, label_index int")
