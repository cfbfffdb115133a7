from __future__ import annotations

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from hearthgrid import session
from hearthgrid.sources import dimensions, readers, tables
from tests.conftest import values


@pytest.mark.parametrize(
    ("text", "padded"),
    [("1.2.3", "01_02_03"), ("1_2_3", "01_02_03"), ("dev", "dev"), ("10.0.1", "10_00_01")],
)
def test_padded_version(text, padded):
    assert tables.padded_version(text) == padded


@pytest.fixture(scope="module")
def database(spark, tmp_path_factory):
    spark.sql(f"CREATE DATABASE stock LOCATION '{tmp_path_factory.mktemp('stock')}'")
    yield "stock"
    spark.sql("DROP DATABASE stock CASCADE")


def test_versions_of_tables(spark, database):
    for version in ("01_02_00", "01_10_00", "02_00_00", "other"):
        tables.save(spark.range(1), f"stock.building_{version}")
    tables.save(spark.range(1), "stock.building_extra_09_00_00")
    name = "spark_catalog.stock.building"
    assert tables.latest_table(spark, name) == "spark_catalog.stock.building_02_00_00"
    assert tables.latest_table(spark, name, version_only=True) == "02_00_00"
    assert tables.latest_table(spark, name, "1.10.5", version_only=True) == "01_10_00"
    assert tables.latest_table(spark, name, "0.1.0") is None
    assert tables.latest_table(spark, "stock.unknown") is None
    with pytest.raises(ValueError, match="database"):
        tables.latest_table(spark, "building")


def test_overwriting_changes_the_schema(spark, database):
    tables.save(spark.range(3), "stock.changing")
    tables.save(spark.range(2).select(F.lit("x").alias("y"), "id"), "stock.changing", ["id"])
    assert spark.table("stock.changing").columns == ["y", "id"]
    assert spark.table("stock.changing").count() == 2


def test_partitioned_table_is_pruned(spark, database):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("city"))
    tables.save_partitioned(df, "stock.weather", "city")
    one = spark.table("stock.weather").where("city = 1")
    assert one.count() == 33
    assert "PartitionFilters: [isnotnull(city" in one._jdf.queryExecution().executedPlan().toString()


def test_keyed_table(spark, database):
    with pytest.raises(ValueError, match="not a key"):
        tables.save_keyed(spark.range(2).withColumn("k", F.lit(1)), "stock.keyed", ["k"])
    tables.save_keyed(spark.range(2), "stock.keyed", ["id"])
    assert spark.table("stock.keyed").count() == 2


def test_sql_with_parameters(spark):
    found = tables.query(
        spark, "SELECT count(*) AS n FROM {t} WHERE id > :least", {"t": spark.range(10)}, least=6
    )
    assert found.first()["n"] == 3


def test_county_comes_from_the_file_name(spark, tmp_path):
    header = "date_time," + ",".join(readers.WEATHER_NAMES)
    for state, county, wind in (("AL", "G0100010", 1), ("NY", "G3600610", 2)):
        place = tmp_path / f"state={state}"
        place.mkdir()
        (place / f"{county}_TMY3.csv").write_text(f"{header}\n2007-01-01 01:00:00,5,50,{wind},1,2,3,4\n")
    found = readers.weather_readings(spark, f"{tmp_path}/state=*/*_TMY3.csv")
    assert values(found, "county_gisjoin", "`Wind Speed [m/s]`") == [
        ("G0100010", 1.0), ("G3600610", 2.0),
    ]


def test_delimited_without_schema_is_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text("A b,c\n01,x\n")
    assert values(readers.delimited(spark, str(tmp_path))) == [("01", "x")]


def test_simulation_directories(spark, tmp_path):
    spark.createDataFrame([(1, 2.0, "Success")], "building_id long, end_use_x_m_btu double, completed_status string").write.parquet(f"{tmp_path}/a")
    spark.createDataFrame([(2, 3)], "building_id long, end_use_x_m_btu long").write.parquet(f"{tmp_path}/b")
    found = readers.simulation_runs(spark, {f"{tmp_path}/a": 11.05, f"{tmp_path}/b": 13.01})
    assert found.columns == ["building_id", "x_energy_consumption_kwh", "upgrade_id"]
    assert [r["upgrade_id"] for r in found.orderBy("building_id").collect()] == [11.05, 13.01]
    assert found.schema["x_energy_consumption_kwh"].dataType.typeName() == "double"


def test_files_of_one_directory_may_differ(spark, tmp_path):
    path = f"{tmp_path}/mixed"
    spark.range(2).select(F.col("id").alias("building_id"), F.lit(1).cast("long").alias("x_lb")).write.parquet(path)
    spark.range(2, 4).select(F.col("id").alias("building_id"), F.lit(1.5).alias("x_lb")).write.mode("append").parquet(path)
    found = readers.simulation_runs(spark, {path: 3.0}, mixed_schemas=True)
    assert len(readers.tables_by_schema(spark, path)) == 2
    assert [r["building_id"] for r in found.orderBy("building_id").collect()] == [0, 1, 2, 3]
    assert found.agg(F.max("x_kg")).first()[0] == pytest.approx(1.5 * 0.45359237)


@pytest.fixture
def mixed(spark, tmp_path):
    """A directory with a blank in its name: two folders of one schema, one of two, and files beside folders."""
    path = f"{tmp_path}/all [1] files"
    whole = spark.range(4).select(F.col("id").alias("building_id"), F.lit(1).cast("long").alias("x"))
    real = spark.range(4, 6).select(F.col("id").alias("building_id"), F.lit(0.5).alias("x"))
    whole.repartition(2).write.parquet(f"{path}/a")
    real.write.parquet(f"{path}/b")
    whole.write.parquet(f"{path}/c")
    real.write.mode("append").parquet(f"{path}/c")
    whole.write.mode("append").parquet(path)
    (tmp_path / "all [1] files" / "a" / "notes.txt").write_text("no table")
    return path


def test_directories_of_one_schema_stand_for_their_files(spark, mixed):
    escaped = readers._as_named(mixed)
    layouts = readers.file_layouts(spark, escaped)
    assert layouts.select("layout").distinct().count() == 2
    paths = [r["path"] for r in readers.layout_paths(layouts).collect()]
    names = {p.split("all [1] files")[1] for p in paths}
    assert {"/a", "/b"} <= names and "/c" not in names and "" not in names
    assert all(n in ("/a", "/b") or n.endswith(".parquet") for n in names)


def test_files_of_nested_directories_are_read_once(spark, mixed):
    tables_found = readers.tables_by_schema(spark, readers._as_named(mixed))
    assert sorted(dict(t.dtypes)["x"] for t in tables_found) == ["bigint", "double"]
    ids = sorted(r["building_id"] for t in tables_found for r in t.collect())
    assert ids == sorted([0, 1, 2, 3] * 3 + [4, 5] * 2)


def test_paths_that_arrow_cannot_open(spark, mixed, monkeypatch):
    real = readers.file_layouts(spark, readers._as_named(mixed))
    monkeypatch.setattr(readers, "file_layouts", lambda *_: real.withColumn("layout", F.lit(None).cast("string")))
    found = readers.tables_by_schema(spark, readers._as_named(mixed))
    assert sorted(t.count() for t in found) == [4, 12]


def test_a_directory_without_tables(spark, tmp_path):
    (tmp_path / "notes.txt").write_text("no table")
    assert readers.tables_by_schema(spark, str(tmp_path)) == []


def test_tables_bucketed_alike_join_without_a_shuffle(spark, database):
    keys = ["building_id", "building_set"]
    df = spark.range(1000).select(F.col("id").alias("building_id"), (F.col("id") % 3).cast("string").alias("building_set"), F.lit(1).alias("x"))
    for name in ("stock.outputs", "stock.features"):
        tables.save_keyed(df, name, keys, bucket_by=keys, buckets=4)
    joined = spark.table("stock.outputs").hint("merge").join(spark.table("stock.features"), keys)
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 1000


def test_enforced_schema(spark, tmp_path):
    spark.range(2).write.parquet(f"{tmp_path}/p")
    found = readers.parquet(spark, f"{tmp_path}/p", spark.createDataFrame([], "id long, more string").schema)
    assert values(found) == [(0, None), (1, None)]


def test_export(spark, tmp_path):
    df = spark.range(50).select((F.col("id") % 2 + 1).cast("int").alias("zone"), (-F.col("id")).alias("v"))
    tables.write_export(df, f"{tmp_path}/e", "zone", ["v"])
    assert sorted(p.name for p in (tmp_path / "e").iterdir() if p.is_dir()) == ["zone=1", "zone=2"]
    back = [r["v"] for r in readers.parquet(spark, f"{tmp_path}/e/zone=1").collect()]
    assert back == sorted(back) and len(back) == 25


def _spans(folder, column):
    """Least and greatest value of a column in each file, from the footers."""
    for file in folder.rglob("*.parquet"):
        footer = pq.read_metadata(file)
        at = footer.schema.names.index(column)
        parts = [footer.row_group(g).column(at).statistics for g in range(footer.num_row_groups)]
        yield min(p.min for p in parts), max(p.max for p in parts)


def test_a_filter_on_any_cluster_column_skips_files(spark, tmp_path):
    rows = spark.range(40_000).select(
        (F.col("id") % 2 + 1).cast("int").alias("zone"),
        F.concat(F.lit("fuel "), F.pmod(F.xxhash64("id", F.lit(1)), 5)).alias("a"),
        F.pmod(F.xxhash64("id", F.lit(2)), 9).alias("b"),
        F.pmod(F.xxhash64("id", F.lit(3)), 5000).cast("double").alias("c"),
        F.pmod(F.xxhash64("id", F.lit(4)), 100).cast("int").alias("d"),
    )
    rows = session.settle(rows, "cluster-test")
    # 256 ranges of a zone: two digits of each column tell them apart.
    tables.write_clustered(rows, f"{tmp_path}/z", "zone", ["a", "b", "c", "d"], files=512)
    back = readers.parquet(spark, f"{tmp_path}/z").select(*rows.columns)
    assert back.exceptAll(rows).isEmpty() and rows.exceptAll(back).isEmpty()
    for column, value in (("a", "fuel 2"), ("b", 4), ("c", 2500.0), ("d", 50)):
        spans = list(_spans(tmp_path / "z", column))
        met = sum(low <= value <= high for low, high in spans)
        assert len(spans) >= 400 and met < 0.6 * len(spans), column


def test_rows_of_one_value_are_dealt_to_many_files(spark, tmp_path):
    rows = spark.range(9000).select(
        F.lit(1).alias("zone"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("a"), F.lit(None).cast("string").alias("b"),
        F.create_map(F.lit("k"), F.col("id")).alias("__rank"), F.array("id").alias("c"),
    )
    tables.write_clustered(session.settle(rows, "cluster-test"), f"{tmp_path}/z", "zone", ["a", "b"], files=9)
    back = readers.parquet(spark, f"{tmp_path}/z")
    assert back.count() == 9000 and back.where("a is null").select("_metadata.file_path").distinct().count() >= 3


def test_empty_table_is_clustered(spark, tmp_path):
    rows = spark.createDataFrame([], "zone int, a string, b double")
    tables.write_clustered(rows, f"{tmp_path}/z", "zone", ["a", "b"])
    assert spark.read.schema(rows.schema).parquet(f"{tmp_path}/z").count() == 0


def test_range_numbers_and_digits(spark):
    rows = spark.createDataFrame([(v,) for v in (None, -1.0, 2.0, 2.5, 7.0, float("nan"))], "v double")
    found = rows.select(tables.range_number("v", [2.0, 3.0, 7.0]).alias("n")).collect()
    assert [r["n"] for r in found] == [0, 0, 1, 1, 3, 3]
    digits = spark.range(1).select(tables.interleaved([F.lit(5), F.lit(3)], 3).alias("k"))
    assert digits.first()["k"] == 0b100111
    with pytest.raises(ValueError, match="63"):
        tables.interleaved([F.lit(1)] * 4, 16)


def test_bounds_follow_the_rows(spark):
    rows = spark.range(6400).select(F.col("id").alias("a"), F.lit("x").alias("b"), F.lit(None).cast("int").alias("c"))
    bounds = tables.cluster_bounds(rows, ["a", "b", "c"], bits=3)
    assert bounds == {"a": [800 * i for i in range(1, 8)], "b": [], "c": []}
    near = tables.cluster_bounds(rows, ["a"], bits=3, rows=1000)["a"]
    assert len(near) == 7 and all(abs(v - w) < 640 for v, w in zip(near, bounds["a"], strict=True))


def test_wide_export_suffixes_metadata(spark):
    metadata = spark.createDataFrame([(1, "x")], "building_id int, fuel string")
    features = spark.createDataFrame([(1, "y")], "building_id int, fuel string")
    assert tables.wide_export(metadata, features).columns == ["building_id", "fuel__m", "fuel"]


def test_report_file(spark, tmp_path):
    tables.write_report(spark.range(3), f"{tmp_path}/r")
    files = list((tmp_path / "r").glob("part-*.csv"))
    assert len(files) == 1 and files[0].read_text().splitlines()[0] == "id"


def test_shared_folder_is_the_one_the_cluster_names(spark, monkeypatch, tmp_path):
    class Conf:
        def get(self, key, default=None):
            return "hdfs://shared/work/" if key == "spark.checkpoint.dir" else default

    class Context:
        master, applicationId = "yarn", "app"

    class Session:
        conf, sparkContext = Conf(), Context()

    assert session.shared_folder(Session()) == "hdfs://shared/work"
    Session.conf = type("Empty", (), {"get": lambda self, key, default=None: default})()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())


def test_settled_rows_are_the_same(spark):
    df = spark.range(10).withColumn("x", F.array("id"))
    assert values(session.settle(df, "test")) == values(df)
