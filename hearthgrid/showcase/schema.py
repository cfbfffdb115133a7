"""Queries on column work, table checks, versions and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hearthgrid.operators import audit, columns, learning, vintages
from hearthgrid.plans import extract
from hearthgrid.session import fresh_path, settle
from hearthgrid.showcase.base import Registry, table
from hearthgrid.sources import readers, tables

registry = Registry()


@registry.add(
    "SELECT o_orderkey AS order__id, o_totalprice AS amount, o_orderstatus AS methane_gas_status FROM orders"
)
def column_edit(spark, folder):
    raw = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("order.id"),
        F.col("o_totalprice").alias("amount_shorter"),
        F.col("o_orderstatus").alias("natural_gas_status"),
        F.col("o_custkey").alias("remove.me"),
    )
    return columns.edit_columns(
        raw,
        drop_matching=["remove__me"],
        strip=["_shorter"],
        replace={"natural_gas": "methane_gas"},
    )


@registry.add(
    "SELECT o_orderkey, o_totalprice * (0.00029307107::DOUBLE * 1e6) AS energy_kwh, o_totalprice * 0.45359237::DOUBLE AS emission_kg, "
    "o_totalprice * 0.00029307107::DOUBLE AS power_kw, (o_custkey - 32)::DOUBLE * 5 / 9 AS temp_c FROM orders"
)
def unit_convert(spark, folder):
    raw = table(spark, folder, "orders").select(
        "o_orderkey",
        F.col("o_totalprice").alias("energy_m_btu"),
        F.col("o_totalprice").alias("emission_lb"),
        F.col("o_totalprice").alias("power_btu_h"),
        F.col("o_custkey").cast("double").alias("temp_f"),
    )
    return columns.convert_units(raw)


@registry.add(
    "SELECT c_custkey AS id, round(c_acctbal * 100) AS amount, 1.0::DOUBLE AS flag, 'customer' AS kind, c_mktsegment AS extra FROM customer "
    "UNION ALL SELECT s_suppkey, round(s_acctbal), CASE WHEN s_nationkey > 12 THEN 1 ELSE 0 END, 'supplier', '' FROM supplier"
)
def schema_reconcile_union(spark, folder):
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"),
        F.round(F.col("c_acctbal") * 100).cast("long").alias("amount"),
        F.lit(1).cast("long").alias("flag"),
        F.lit("customer").alias("kind"),
        F.col("c_mktsegment").alias("extra"),
    )
    suppliers = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.round("s_acctbal").alias("amount"),
        (F.col("s_nationkey") > 12).alias("flag"),
        F.lit("supplier").alias("kind"),
    )
    return columns.union_tables([customers, suppliers]).fillna("", subset=["extra"])


@registry.add(
    "SELECT l_orderkey AS building_id, (l_linenumber + 10)::DOUBLE AS upgrade_id, "
    "l_extendedprice * (0.00029307107::DOUBLE * 1e6) AS out_heating_energy_consumption_kwh, "
    "CASE WHEN l_linenumber = 1 THEN l_quantity ELSE -1 END AS hp_bkup_share, l_tax AS site_energy_factor "
    "FROM lineitem WHERE l_returnflag <> 'N'"
)
def simulation_outputs(spark, folder):
    def run(line: int):
        status = F.when(F.col("l_returnflag") != "N", "Success").otherwise("Fail")
        return table(spark, folder, "lineitem").where(F.col("l_linenumber") == line).select(
            F.col("l_orderkey").alias("building_id"),
            F.col("l_extendedprice").alias("report_simulation_output.end_use_heating_m_btu"),
            *([F.col("l_quantity").alias("qoi_report_qoi_heat_pump_backup_share")] if line == 1 else []),
            F.col("l_tax").alias("fuel_use_energy_use_factor"),
            F.col("l_linenumber").alias("job_id"),
            status.alias("completed_status"),
            F.lit(0).alias("apply_upgrade.cost"),
        )

    done = vintages.combine_outputs({10.0 + line: [run(line)] for line in range(1, 8)})
    return done.select(
        "building_id",
        "upgrade_id",
        "out_heating_energy_consumption_kwh",
        F.coalesce("hp_bkup_share", F.lit(-1.0)).alias("hp_bkup_share"),
        "site_energy_factor",
    )


@registry.add(
    "SELECT l_orderkey AS building_id, (l_linenumber % 2 + 1)::DOUBLE AS upgrade_id, "
    "CASE WHEN l_linestatus = 'O' THEN round(l_quantity) ELSE l_quantity / 2 END AS load, "
    "CASE WHEN l_linestatus <> 'O' THEN l_tax END AS share FROM lineitem"
)
def mixed_directories(spark, folder):
    """Runs of two directories; the files of each differ in the type of one column and lack another."""
    lines = table(spark, folder, "lineitem")
    path = fresh_path(spark, "mixed")
    names = {f"{path}/{n}": n + 1.0 for n in (0, 1)}
    for n, place in enumerate(names):
        own = lines.where(F.col("l_linenumber") % 2 == n).withColumnRenamed("l_orderkey", "building_id")
        whole = own.where("l_linestatus = 'O'").select("building_id", F.round("l_quantity").cast("long").alias("load"))
        real = own.where("l_linestatus <> 'O'").select(
            "building_id", (F.col("l_quantity") / 2).alias("load"), F.col("l_tax").alias("share")
        )
        whole.write.parquet(place)
        real.write.mode("append").parquet(place)
    return readers.simulation_runs(spark, names, mixed_schemas=True).select("building_id", "upgrade_id", "load", "share")


@registry.add(
    "SELECT s_suppkey AS supplier_key, s_name AS supplier_name__m, s_acctbal AS account_cop_value__m FROM supplier"
)
def header_normalise(spark, folder):
    raw = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("Supplier Key"),
        F.col("s_name").alias("Supplier  Name"),
        F.col("s_acctbal").alias("account cop VALUE"),
        F.col("s_nationkey").alias("Nation"),
    )
    named = columns.normalise_headers(raw)
    kept = columns.columns_like(named, ".*_(cop|name).*", keep=["supplier_key"])
    return columns.suffix_columns(kept, "__m", ["supplier_key"])


@registry.add(
    "SELECT p_partkey, p_name AS fallback, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_brand END AS brand, "
    "CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_type END AS kind, CASE WHEN p_size % 5 = 0 THEN 1 ELSE p_size END AS size, "
    "coalesce(CASE WHEN p_type <> 'SMALL' THEN p_type END, 'absent') AS units FROM part"
)
def fill_nulls(spark, folder):
    parts = table(spark, folder, "part").select(
        "p_partkey",
        F.col("p_name").alias("fallback"),
        F.when(F.col("p_size") % 2 != 0, F.col("p_brand")).alias("brand"),
        F.when(F.col("p_size") % 3 != 0, F.col("p_type")).alias("kind"),
        F.when(F.col("p_size") % 5 != 0, F.col("p_size")).alias("size"),
        F.when(F.col("p_type") == "SMALL", "None").otherwise(F.col("p_type")).alias("units"),
    )
    filled = columns.fill_from(parts, "fallback", ["brand", "kind"]).fillna(1, subset=["size"])
    return columns.none_to_null(filled, ["units"]).fillna("absent", subset=["units"])


@registry.add(
    "WITH p AS (SELECT *, p_type || ' ' || p_size AS kind, CASE WHEN p_size % 2 = 0 THEN 'l' ELSE 'r' END AS s FROM part), "
    "a AS (SELECT 'p_brand' AS \"column\", p_brand AS value, s FROM p UNION ALL SELECT 'p_name', p_name, s FROM p UNION ALL "
    "SELECT 'p_type', p_type, s FROM p UNION ALL SELECT 'kind', kind, s FROM p) "
    "SELECT \"column\", value, CASE WHEN min(s) = 'l' THEN 'left only' ELSE 'right only' END AS side FROM a GROUP BY ALL HAVING count(DISTINCT s) = 1"
)
def categorical_diff(spark, folder):
    parts = table(spark, folder, "part").withColumn(
        "kind", F.concat_ws(" ", "p_type", F.col("p_size").cast("string"))
    )
    return audit.categorical_difference(
        parts.where("p_size % 2 = 0"), parts.where("p_size % 2 = 1")
    )


@registry.add(
    "SELECT 'c_custkey' AS \"column\", 0::BIGINT AS n_null, count(*) AS n_rows FROM customer UNION ALL "
    "SELECT 'balance', count(*) FILTER (c_acctbal < 0), count(*) FROM customer UNION ALL "
    "SELECT 'segment', count(*) FILTER (c_mktsegment = 'BUILDING'), count(*) FROM customer"
)
def null_audit(spark, folder):
    customers = table(spark, folder, "customer").select(
        "c_custkey",
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment"),
    )
    return audit.null_counts(customers)


@registry.add(
    "SELECT 'c_mktsegment' AS \"column\", count(DISTINCT c_mktsegment) AS n_distinct FROM customer UNION ALL "
    "SELECT 'c_name', count(DISTINCT c_name) FROM customer"
)
def feature_profile(spark, folder):
    customers = table(spark, folder, "customer")
    return audit.distinct_counts(customers, audit.string_columns(customers))


@registry.add(
    "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1"
)
def key_violations(spark, folder):
    return audit.key_violations(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


VERSIONED = "concat('part_', lower(p_type), '_0', p_size % 3, '_', lpad(p_size, 2, '0'), '_', lpad(p_partkey % 100, 2, '0'))"


@registry.add(
    "SELECT 'part_' || lower(p_type) AS table_name, max('0' || (p_size % 3) || '_' || lpad(p_size::VARCHAR, 2, '0') || '_' || "
    "lpad((p_partkey % 100)::VARCHAR, 2, '0')) AS version FROM part WHERE p_type <> 'PROMO' AND "
    "'0' || (p_size % 3) || '_' || lpad(p_size::VARCHAR, 2, '0') || '_' || lpad((p_partkey % 100)::VARCHAR, 2, '0') <= '02_30_00' "
    "GROUP BY 1"
)
def latest_version(spark, folder):
    names = table(spark, folder, "part").select(
        F.when(F.col("p_type") != "PROMO", F.expr(VERSIONED)).otherwise("part_promo").alias("name")
    )
    return tables.latest_versions(names, "name", max_version="2.30.0")


@registry.add(
    "SELECT o_orderpriority, count(*) AS n_orders, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents "
    "FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY ALL"
)
def sql_over_tables(spark, folder):
    return tables.query(
        spark,
        "SELECT o_orderpriority, count(*) AS n_orders, sum(cast(round(o_totalprice * 100) AS bigint)) AS cents "
        "FROM {orders} JOIN {customers} ON c_custkey = o_custkey "
        "WHERE c_mktsegment = :segment GROUP BY o_orderpriority",
        {"orders": table(spark, folder, "orders"), "customers": table(spark, folder, "customer")},
        segment="BUILDING",
    )


@registry.add(
    "SELECT zone, count(*) AS n_rows, count(DISTINCT c_mktsegment) AS n_segments, "
    "sum(round(c_acctbal * 100)::BIGINT)::BIGINT AS cents "
    "FROM (SELECT *, dense_rank() OVER (ORDER BY c_nationkey)::INTEGER AS zone FROM customer) GROUP BY ALL"
)
def zone_export(spark, folder):
    """Written by zone, sorted by segment, and read back."""
    label = F.concat(F.lit("Z"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"))
    customers = table(spark, folder, "customer").withColumn("label", label)
    zones = learning.label_table(learning.fit_label_index(customers, "label"), first=1)
    zoned = customers.join(zones, "label").drop("label")
    path = fresh_path(spark, "zone-export")
    tables.write_export(zoned, path, "label_index", ["c_mktsegment", "c_name"])
    back = readers.parquet(spark, path)
    return back.groupBy(F.col("label_index").alias("zone")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("c_mktsegment").alias("n_segments"),
        F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).alias("cents"),
    )


@registry.add(
    "SELECT l_linenumber::INTEGER AS zone, count(*) AS n_rows, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents, "
    "count(*) FILTER (l_linestatus = 'O') AS n_open, count(*) FILTER (l_returnflag = 'N') AS n_flag, "
    "count(*) FILTER (l_quantity >= 40) AS n_large, count(*) FILTER (l_discount < 0.02) AS n_plain FROM lineitem GROUP BY ALL"
)
def clustered_export(spark, folder):
    """Written by zone, clustered by four columns alike, and read back."""
    lines = table(spark, folder, "lineitem").withColumn("zone", F.col("l_linenumber").cast("int"))
    path = fresh_path(spark, "clustered-export")
    tables.write_clustered(lines, path, "zone", ["l_linestatus", "l_returnflag", "l_quantity", "l_discount"])
    return readers.parquet(spark, path).groupBy("zone").agg(
        F.count("*").alias("n_rows"),
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"),
        F.count_if(F.col("l_linestatus") == "O").alias("n_open"),
        F.count_if(F.col("l_returnflag") == "N").alias("n_flag"),
        F.count_if(F.col("l_quantity") >= 40).alias("n_large"),
        F.count_if(F.col("l_discount") < 0.02).alias("n_plain"),
    )


@registry.add(
    "SELECT n_regionkey AS region, count(*) AS n_rows, sum(c_custkey)::BIGINT AS keys FROM customer "
    "JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL"
)
def path_key_scan(spark, folder):
    """Delimited files whose folder names carry the key."""
    customers = table(spark, folder, "customer").join(
        table(spark, folder, "nation"), F.col("n_nationkey") == F.col("c_nationkey")
    )
    path = fresh_path(spark, "path-key")
    rows = customers.select("c_custkey", F.col("n_regionkey").alias("region"))
    rows.write.option("header", True).partitionBy("region").csv(path)
    back = readers.delimited(spark, f"{path}/region=*", "c_custkey long").select(
        "c_custkey", readers.file_key(r"region=(\d+)/").cast("int").alias("region")
    )
    return back.groupBy("region").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("c_custkey").alias("keys")
    )


@registry.add(
    "SELECT c_custkey::VARCHAR AS c_custkey, c_nationkey::VARCHAR AS c_nationkey, c_mktsegment FROM customer"
)
def text_scan(spark, folder):
    """Delimited files without a schema: every column is text."""
    path = fresh_path(spark, "text-scan")
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    customers.write.option("header", True).csv(path)
    return readers.delimited(spark, path)


@registry.add(
    "SELECT o_orderpriority, count(*) AS n_orders, sum(round(o_totalprice * 200)::BIGINT)::BIGINT AS amount FROM orders GROUP BY ALL"
)
def newest_table(spark, folder):
    """Two versions saved by partition; the newest one is found by name and read back."""
    orders = table(spark, folder, "orders")
    base = f"default.orders_{uuid.uuid4().hex[:12]}"
    for version, factor in (("1_9_0", 100), ("1_10_0", 200)):
        amounts = orders.select("o_orderpriority", F.round(F.col("o_totalprice") * factor).cast("long").alias("amount"))
        tables.save_partitioned(amounts, f"{base}_{tables.padded_version(version)}", "o_orderpriority")
    newest = spark.table(tables.latest_table(spark, base))
    found = newest.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum("amount").alias("amount")
    )
    result = settle(found, "newest")
    for version in ("1_9_0", "1_10_0"):
        spark.sql(f"DROP TABLE {base}_{tables.padded_version(version)}")
    return result


@registry.add(
    "SELECT l_orderkey::INTEGER AS building_id, l_linenumber::DOUBLE AS upgrade_id, true AS applicability, "
    "round(l_extendedprice * 100)::BIGINT AS cents FROM lineitem WHERE l_linestatus = 'O' UNION ALL "
    "SELECT l_orderkey::INTEGER, l_linenumber::DOUBLE, l_returnflag = 'N', NULL FROM lineitem WHERE l_linestatus <> 'O'"
)
def combined_outputs(spark, folder):
    """Own runs and published ones, which lack a column, in one table."""
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("building_id"),
        F.col("l_linenumber").alias("upgrade_id"),
        "l_linestatus",
        "l_returnflag",
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
    )
    own = lines.where("l_linestatus = 'O'").select("building_id", "upgrade_id", "cents")
    published = lines.where("l_linestatus <> 'O'").select(
        "building_id", "upgrade_id", (F.col("l_returnflag") == "N").alias("applicability")
    )
    return extract.annual_outputs(published, own)


@registry.add(
    "SELECT o_orderkey AS building_id, o_orderstatus AS o_orderstatus__m, count(*) AS n_lines, "
    "sum(l_quantity)::BIGINT AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL"
)
def wide_table(spark, folder):
    """Metadata, suffixed, next to the features of the same key; written by zone and read back."""
    metadata = table(spark, folder, "orders").select(F.col("o_orderkey").alias("building_id"), "o_orderstatus")
    features = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("building_id")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").cast("long").alias("quantity")
    )
    path = fresh_path(spark, "wide-table")
    wide = tables.wide_export(metadata, features).withColumn("zone", (F.col("building_id") % 7).cast("int"))
    tables.write_export(wide, path, "zone", ["building_id"])
    return readers.parquet(spark, path).drop("zone")


@registry.add(
    "SELECT o_orderstatus, count(*) AS n_orders, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents FROM orders GROUP BY ALL"
)
def report_file(spark, folder):
    """An aggregated report as one delimited file, read back."""
    report = table(spark, folder, "orders").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"),
    )
    path = fresh_path(spark, "report")
    tables.write_report(report.orderBy("o_orderstatus"), path)
    return readers.delimited(spark, path, report.schema)
