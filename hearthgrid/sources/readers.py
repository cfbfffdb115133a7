"""Scans: parquet, delimited text, many directories, and keys held in file paths."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pa_fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthgrid.operators.columns import cast_to, reconcile_types
from hearthgrid.operators.vintages import combine_outputs
from hearthgrid.operators.weather import WEATHER_NAMES
from hearthgrid.session import settle

READINGS_SCHEMA = T.StructType(
    [T.StructField("date_time", T.StringType())]
    + [T.StructField(name, T.DoubleType()) for name in WEATHER_NAMES]
)
# Fixed value: where Spark keeps a table's schema in a parquet footer.
ROW_METADATA = b"org.apache.spark.sql.parquet.row.metadata"


def parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet scan, with the schema enforced if one is given."""
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)


def delimited(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """CSV with a header; all columns are strings unless a schema is given."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def file_key(pattern: str) -> Column:
    """A key taken from the path of the file a row was read from."""
    return F.nullif(F.regexp_extract(F.col("_metadata.file_path"), pattern, 1), F.lit(""))


def weather_readings(
    spark: SparkSession, path_glob: str, schema: T.StructType = READINGS_SCHEMA
) -> DataFrame:
    """Hourly readings of all counties, keyed by the county code in the file name.

    Files are named ``<county>_<kind>.csv`` below hive-style directories.
    """
    return delimited(spark, path_glob, schema).withColumn(
        "county_gisjoin", file_key(r"([^/_]+)_[^/_]*\.csv$")
    )


def file_layouts(spark: SparkSession, directory: str) -> DataFrame:
    """``path`` and ``layout`` of every parquet file below a directory.

    Tasks read the footers, no rows. Files of one layout have the same columns and types.
    The layout is null where Arrow cannot open the kind of path.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", True)
        .load(directory)
        .select("path")
    )

    def layout(path: str) -> str | None:
        try:
            system, name = pa_fs.FileSystem.from_uri(quote(path, safe=":/"))
        except pa.ArrowInvalid as refused:
            if "Unrecognized filesystem type" in str(refused):
                return None
            raise
        with system.open_input_file(name) as opened:
            footer = pq.read_metadata(opened)
        # The first line names the object in memory.
        columns = str(footer.schema).split("\n", 1)[1].encode()
        return hashlib.sha256(columns + (footer.metadata or {}).get(ROW_METADATA, b"")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [layout(path) for path in batch["path"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["path"], pa.array(found, pa.string())], names=["path", "layout"])

    return files.mapInArrow(run, "path string, layout string")


def layout_paths(layouts: DataFrame) -> DataFrame:
    """``layout`` and the ``path``s to read for it: a directory whose files are all of one
    layout, and that has no files further down, stands for its files."""
    files = layouts.withColumn("parent", F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    parents = files.groupBy("parent").agg(
        F.min("layout").alias("layout"),
        (F.count_distinct("layout") == 1).alias("alike"),
        (F.count("layout") == F.count("*")).alias("known"),
    )
    parts = F.split("parent", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    nested = parents.select(F.explode(above).alias("parent")).distinct()
    whole = parents.where("alike and known").join(nested, "parent", "left_anti")
    single = files.join(whole.select("parent"), "parent", "left_anti")
    return whole.select("layout", F.col("parent").alias("path")).unionByName(single.select("layout", "path"))


def tables_by_schema(spark: SparkSession, directory: str) -> list[DataFrame]:
    """One table per schema found among the files of a directory, and of those below it.

    Footers are read by tasks and grouped there. The driver gets a row for each directory
    of files that are alike, and one for each file of a mixed directory, and opens a file of
    each schema. Keys held in folder names are not columns.
    """
    layouts = settle(file_layouts(spark, directory), "file-layouts")
    groups: dict[str, list[str]] = {}
    for row in layout_paths(layouts).orderBy("path").collect():
        # Of a path that Arrow cannot open, the driver reads the footer.
        layout = row["layout"] or parquet(spark, _as_named(row["path"])).schema.json()
        groups.setdefault(layout, []).append(_as_named(row["path"]))
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    return [reader.parquet(*paths) for paths in groups.values()]


def _as_named(path: str) -> str:
    """A path whose characters stand for themselves, not for patterns."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def simulation_runs(
    spark: SparkSession, paths: Mapping[str, float], mixed_schemas: bool = False
) -> DataFrame:
    """Simulation outputs of many directories in one clean table.

    ``paths`` maps each directory to its scenario id. With ``mixed_schemas`` the
    files of one directory may differ in their columns and types.
    """
    runs = [
        (scenario_id, df)
        for path, scenario_id in paths.items()
        for df in (tables_by_schema(spark, path) if mixed_schemas else [parquet(spark, path)])
    ]
    return combine_outputs(runs)


def reconciled(tables: list[DataFrame]) -> list[DataFrame]:
    """The tables with conflicting column types cast to their common type."""
    wanted = reconcile_types([t.schema for t in tables])
    return [cast_to(t, wanted) for t in tables]
