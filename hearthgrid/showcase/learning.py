"""Queries on splits, weights, lookups and Spark ML models."""

from __future__ import annotations

from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthgrid.operators import learning, linear, splits
from hearthgrid.showcase.base import Registry, table

registry = Registry()

NUMBER = "('0x' || substr(md5({}), 1, 8))::BIGINT"
BUCKET = NUMBER + " % 10000"


def _split_sql(key: str) -> str:
    return (
        f"CASE WHEN {BUCKET.format(key)} < 7000 THEN 'train' WHEN {BUCKET.format(key)} < 9000 THEN 'val' ELSE 'test' END"
    )


@registry.add(
    f"SELECT c_custkey, {_split_sql("c_mktsegment || '|' || c_custkey || '|42'")} AS split FROM customer"
)
def group_split(spark, folder):
    customers = table(spark, folder, "customer").select("c_mktsegment", "c_custkey")
    return splits.group_split(customers, ["c_mktsegment", "c_custkey"]).select("c_custkey", "split")


SCENARIO_ROWS = """
WITH r AS (SELECT DISTINCT l_orderkey AS building_id, CASE WHEN l_orderkey % 2 = 0 THEN 'ResStock 2022.1' ELSE 'ResStock 2024.2' END AS building_set,
    CASE WHEN l_linenumber <= 5 THEN CASE WHEN l_orderkey % 2 = 0 THEN 0 ELSE 0.01 END ELSE l_linenumber END::DOUBLE AS upgrade_id FROM lineitem),
b AS (SELECT r.* FROM r WHERE EXISTS (SELECT 1 FROM r x WHERE x.building_id = r.building_id AND x.building_set = r.building_set AND x.upgrade_id < 1)),
s AS (SELECT *, """ + _split_sql("building_set || '|' || building_id || '|42'") + """ AS split,
    """ + NUMBER.format("building_set || '|' || building_id || '|0'") + """ / 4294967296.0::DOUBLE AS position FROM b)
"""


def scenario_rows(spark, folder) -> DataFrame:
    even = F.col("l_orderkey") % 2 == 0
    return (
        table(spark, folder, "lineitem")
        .select(
            F.col("l_orderkey").alias("building_id"),
            F.when(even, "ResStock 2022.1").otherwise("ResStock 2024.2").alias("building_set"),
            F.when(F.col("l_linenumber") <= 5, F.when(even, 0.0).otherwise(0.01))
            .otherwise(F.col("l_linenumber").cast("double"))
            .alias("upgrade_id"),
        )
        .distinct()
    )


@registry.add(
    SCENARIO_ROWS + "SELECT building_set, split, count(*) AS n_rows, count(DISTINCT building_id) AS n_buildings FROM s GROUP BY ALL"
)
def split_with_baseline(spark, folder):
    rows = splits.with_baseline(scenario_rows(spark, folder), splits.BASELINES)
    split = splits.group_split(rows)
    buildings = split.groupBy("building_set", "split", "building_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    return buildings.groupBy("building_set", "split").agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_buildings")
    )


@registry.add(
    SCENARIO_ROWS + ", n AS (SELECT building_set, count(*) FILTER (upgrade_id < 1) AS base, "
    "count(*) FILTER (upgrade_id < 1 AND split = 'train') AS train FROM s GROUP BY ALL), t AS (SELECT count(*) AS total FROM s) "
    "SELECT building_set, split, count(*) AS n_rows FROM s JOIN n USING (building_set), t "
    "WHERE position < least(1.0, 500 * (base / total::DOUBLE) / train) GROUP BY ALL"
)
def down_sample(spark, folder):
    rows = splits.with_baseline(scenario_rows(spark, folder), splits.BASELINES)
    kept = splits.down_sample(splits.group_split(rows), n_train=500)
    return kept.groupBy("building_set", "split").agg(F.count(F.lit(1)).alias("n_rows"))


@registry.add(
    "SELECT l_returnflag, round(sum(l_quantity * CASE WHEN l_linenumber <= 2 THEN 1.75 ELSE 1 END), 2) AS weighted, "
    "round(sum(CASE WHEN l_linenumber <= 2 THEN 1.75 ELSE 1 END), 2)::DOUBLE AS weight FROM lineitem GROUP BY l_returnflag"
)
def sample_weight(spark, folder):
    weight = splits.sample_weight("l_linenumber", range(1, 8), [1, 2])
    return table(spark, folder, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.sum(F.col("l_quantity") * weight), 2).alias("weighted"),
        F.round(F.sum(weight), 2).alias("weight"),
    )


@registry.add(
    "SELECT p_partkey, (dense_rank() OVER (ORDER BY p_brand) - 1)::INTEGER AS p_brand_index FROM part"
)
def label_index(spark, folder):
    parts = table(spark, folder, "part")
    indexer = learning.fit_label_index(parts, "p_brand")
    return learning.index_labels(indexer, parts).select("p_partkey", "p_brand_index")


@registry.add(
    "SELECT DISTINCT p_type AS label, dense_rank() OVER (ORDER BY p_type)::INTEGER AS label_index FROM part"
)
def label_mapping(spark, folder):
    parts = table(spark, folder, "part")
    return learning.label_table(learning.fit_label_index(parts, "p_type"), first=1)


@registry.add(
    "SELECT feature, count(*) AS n_labels, min(label) AS first_label FROM (SELECT DISTINCT 'p_type' AS feature, p_type AS label FROM part "
    "UNION SELECT DISTINCT 'p_brand', p_brand FROM part) GROUP BY feature"
)
def feature_vocabulary(spark, folder):
    found = learning.vocabulary(table(spark, folder, "part"), ["p_type", "p_size", "p_brand"])
    return found.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_labels"), F.min("label").alias("first_label")
    )


@registry.add(
    "SELECT l_orderkey AS building_id, l_linenumber::DOUBLE AS upgrade_id, 'C' || (l_orderkey % 5) AS weather_file_city, "
    "sum(round(l_extendedprice * 100)::BIGINT + round(l_tax * 100)::BIGINT)::BIGINT AS electricity, sum(l_quantity::BIGINT)::BIGINT AS natural_gas "
    "FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber IN (1, 2, 5) GROUP BY ALL"
)
def training_targets(spark, folder):
    """Outputs of chosen scenarios joined to the buildings that have features."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("a"),
        F.sum(F.round(F.col("l_tax") * 100).cast("long")).alias("b"),
        F.sum(F.col("l_quantity").cast("long")).alias("c"),
    )
    outputs = lines.select(
        F.col("l_orderkey").alias("building_id"),
        F.col("l_linenumber").cast("double").alias("upgrade_id"),
        "a",
        "b",
        "c",
    )
    features = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("building_id"),
        F.explode(F.array(*[F.lit(float(i)) for i in range(1, 8)])).alias("upgrade_id"),
        F.concat(F.lit("C"), (F.col("o_orderkey") % 5).cast("string")).alias("weather_file_city"),
        F.lit("all").alias("building_set"),
    )
    targets = {"electricity": ("a", "b"), "natural_gas": ("c",)}
    rows = splits.training_targets(outputs, features, targets, [1.0, 2.0, 5.0], {"all": 1.0})
    return rows.drop("building_set")


@registry.add(
    "SELECT o_orderkey, c_mktsegment, n_name AS n_name__m, n_regionkey AS n_regionkey__m FROM orders "
    "JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey"
)
def keyed_lookup(spark, folder):
    from hearthgrid.operators.columns import suffix_columns

    customers = table(spark, folder, "customer").withColumnsRenamed(
        {"c_custkey": "o_custkey", "c_nationkey": "n_nationkey"}
    )
    rows = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    found = splits.look_up_features(
        rows, customers, ["o_custkey"], ["c_mktsegment", "n_nationkey"]
    )
    nations = suffix_columns(table(spark, folder, "nation"), "__m", ["n_nationkey"])
    return found.join(nations, "n_nationkey").drop("n_nationkey", "o_custkey")


@registry.add(
    "SELECT o_orderkey, greatest(x, 0) AS \"electricity-pred\", CASE WHEN o_orderstatus = 'F' THEN greatest(x - 1000, 0) ELSE -1 END AS \"propane-pred\", "
    "greatest(x, 0) + CASE WHEN o_orderstatus = 'F' THEN greatest(x - 1000, 0) ELSE 0 END AS \"total-pred\" "
    "FROM (SELECT *, round(o_totalprice - 200000, 2) AS x FROM orders)"
)
def score_postprocess(spark, folder):
    raw = F.round(F.col("o_totalprice") - 200000, 2)
    scored = table(spark, folder, "orders").select(
        "o_orderkey",
        (F.col("o_orderstatus") == "F").alias("has_propane_appliance"),
        raw.alias("electricity-pred"),
        (raw - 1000).alias("propane-pred"),
    )
    usable = learning.usable_predictions(scored, ["electricity", "propane"])
    return usable.drop("has_propane_appliance").fillna(-1.0, subset=["propane-pred"])


@registry.add(
    "WITH x AS (SELECT l_returnflag, l_quantity AS q, l_extendedprice AS y, CASE WHEN l_linenumber <= 2 THEN 1.75::DOUBLE ELSE 1 END AS w "
    "FROM lineitem WHERE l_extendedprice <> 0), k AS (SELECT sum(w) AS sw, sum(w * q) AS sq, sum(w * y) AS sy, sum(w * q * q) AS sqq, "
    "sum(w * q * y) AS sqy FROM x), m AS (SELECT (sw * sqy - sq * sy) / (sw * sqq - sq * sq) AS slope, "
    "(sy - (sw * sqy - sq * sy) / (sw * sqq - sq * sq) * sq) / sw AS intercept FROM k) "
    "SELECT l_returnflag, count(*) AS n_rows, round(avg(intercept + slope * l_quantity), 1) AS mean_prediction FROM lineitem, m GROUP BY l_returnflag"
)
def train_score(spark, folder):
    """A weighted linear model of price by quantity, scored over all rows."""
    rows = table(spark, folder, "lineitem").withColumn(
        "weight", splits.sample_weight("l_linenumber", range(1, 8), [1, 2])
    )
    models = learning.train(
        rows,
        learning.FeatureSet(numeric=("l_quantity",)),
        ["l_extendedprice"],
        weight="weight",
        regressor=LinearRegression(solver="normal"),
    )
    scored = models.score(rows, ["l_returnflag"])
    return scored.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.round(F.avg(F.col("`l_extendedprice-pred`")), 1).alias("mean_prediction"),
    )


def _stump() -> GBTRegressor:
    """One tree of one split: on a feature of two values it predicts their means."""
    return GBTRegressor(maxIter=1, maxDepth=1, seed=42)


def _part_rows(spark, folder) -> DataFrame:
    parts = table(spark, folder, "part").select("p_partkey", "p_type", "p_size")
    rows = table(spark, folder, "lineitem").join(parts, F.col("p_partkey") == F.col("l_partkey"))
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        "p_type",
        "p_size",
        "l_quantity",
        "l_extendedprice",
        "l_tax",
        (F.col("l_linestatus") == "O").alias("is_open"),
        (F.col("l_quantity") > 25).alias("is_bulk"),
    )


LINE_KEY = ("l_orderkey", "l_linenumber")
PART_ROWS = (
    "WITH r AS (SELECT p_type, p_size, l_quantity AS q, l_extendedprice AS y, l_tax AS t, l_linestatus = 'O' AS is_open, "
    "l_quantity > 25 AS is_bulk, " + BUCKET.format("l_orderkey || '|' || l_linenumber || '|42'") + " < 2000 AS held "
    "FROM lineitem JOIN part ON p_partkey = l_partkey)"
)


@registry.add(
    PART_ROWS + ", m AS (SELECT is_open, avg(y) FILTER (y <> 0) AS price, avg(t) FILTER (t <> 0) AS tax FROM r GROUP BY is_open) "
    "SELECT p_type, count(*) AS n_rows, round(avg(price), 3) AS mean_price, round(avg(tax), 7) AS mean_tax "
    "FROM r JOIN m USING (is_open) GROUP BY p_type"
)
def boosted_trees(spark, folder):
    rows = _part_rows(spark, folder)
    features = learning.FeatureSet(flags=("is_open",))
    models = learning.train(rows, features, ["l_extendedprice", "l_tax"], regressor=_stump())
    scored = models.score(rows, ["p_type"])
    return scored.groupBy("p_type").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.round(F.avg(F.col("`l_extendedprice-pred`")), 3).alias("mean_price"),
        F.round(F.avg(F.col("`l_tax-pred`")), 7).alias("mean_tax"),
    )


@registry.add(
    PART_ROWS + ", k AS (SELECT avg(q) AS mq, avg(p_size) AS ms, avg(y) AS my, var_pop(q) AS vq, var_pop(p_size) AS vs, "
    "covar_pop(q, p_size) AS qs, covar_pop(q, y) AS qy, covar_pop(p_size, y) AS sy FROM r WHERE y <> 0), "
    "b AS (SELECT *, (qy * vs - sy * qs) / (vq * vs - qs * qs) AS bq, (sy * vq - qy * qs) / (vq * vs - qs * qs) AS bs FROM k), "
    "g AS (SELECT low + (high - low) * i / 4 AS v FROM (SELECT min(q) AS low, max(q) AS high FROM r), range(5) x(i)), "
    "p AS (SELECT v, my + bq * (v - mq) + bs * (p_size - ms) AS pred FROM r, b, g) "
    "SELECT v AS feature_value, round(median(pred), 1) AS median_prediction, round(avg(pred), 1) AS mean_prediction, "
    "round(stddev_samp(pred), 1) AS std_prediction, round(min(pred), 1) AS min_prediction, round(max(pred), 1) AS max_prediction "
    "FROM p GROUP BY v"
)
def whatif_sweep(spark, folder):
    """A linear model of price by quantity and size, over five quantities."""
    rows = _part_rows(spark, folder)
    features = learning.FeatureSet(numeric=("l_quantity", "p_size"))
    linear = LinearRegression(solver="normal")
    models = learning.train(rows, features, ["l_extendedprice"], regressor=linear)
    swept = learning.what_if(models, rows, "l_quantity", points=5)
    return swept.withColumns({c: F.round(c, 1) for c in swept.columns if c != "feature_value"})


@registry.add(
    PART_ROWS + ", s(segment, open) AS (VALUES ('open', true), ('closed', false), ('all', NULL)), "
    "x AS (SELECT segment, is_bulk, held, y FROM r JOIN s ON open IS NULL OR open = is_open WHERE y <> 0), "
    "m AS (SELECT segment, is_bulk, avg(y) AS pred FROM x WHERE NOT held GROUP BY ALL), "
    "h AS (SELECT segment, y, pred, avg(y) OVER (PARTITION BY segment) AS mean FROM x JOIN m USING (segment, is_bulk) WHERE held) "
    "SELECT segment, 'is_bulk' AS feature, 1.0::DOUBLE AS importance, "
    "round(1 - sum((y - pred) * (y - pred)) / sum((y - mean) * (y - mean)), 6) AS r2 FROM h GROUP BY segment"
)
def importance(spark, folder):
    segments = {"open": "is_open", "closed": "not is_open", "all": "true"}
    features = learning.FeatureSet(flags=("is_bulk",))
    found = learning.feature_importance(
        _part_rows(spark, folder), features, "l_extendedprice", segments, _stump(), key=LINE_KEY
    )
    return found.withColumn("r2", F.round("r2", 6))


@registry.add(
    PART_ROWS + ", c AS (SELECT avg(q) AS centre, stddev_samp(q) AS spread FROM r WHERE y <> 0 AND NOT held), "
    "z AS (SELECT held, y, (q - centre) / spread AS x FROM r, c WHERE y <> 0), "
    "k AS (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS start, sum(x * y) / sum(x * x) AS through FROM z WHERE NOT held), "
    "e AS (SELECT avg(abs(y - start - slope * x)) AS a, avg(abs(y - through * x)) AS b FROM z, k WHERE held) "
    "SELECT 0 AS setting, true AS fit_intercept, round(a, 2) AS mean_absolute_error FROM e UNION ALL SELECT 1, false, round(b, 2) FROM e"
)
def parameter_search(spark, folder):
    found = learning.search(
        _part_rows(spark, folder),
        learning.FeatureSet(numeric=("l_quantity",)),
        "l_extendedprice",
        {"fitIntercept": [True, False]},
        regressor=LinearRegression(solver="normal"),
        key=LINE_KEY,
    )
    rows = [
        (i, setting["fitIntercept"], round(float(error), 2))
        for i, (setting, error) in enumerate(zip(found.settings, found.errors))
    ]
    return spark.createDataFrame(
        rows, "setting int, fit_intercept boolean, mean_absolute_error double"
    )


@registry.add(
    PART_ROWS.replace("SELECT p_type,", "SELECT " + BUCKET.format("l_orderkey || '|' || l_linenumber || '|42'") + " AS place, p_type,")
    + ", d AS (SELECT place, held, q, y + 1000 * q AS c FROM r WHERE y + 1000 * q <> 0), setting AS (SELECT s, 100 * pow(10000::DOUBLE, " + NUMBER.format("'regParam|' || s || '|42'") + " / 4294967296.0::DOUBLE) AS reg FROM range(8) t(s)), "
    "part AS (SELECT n AS rung, 2000 + 2000 * pow(2, n)::INTEGER AS stop FROM range(3) t(n)), "
    "line AS (SELECT rung, regr_slope(c, q) AS slope, avg(q) AS centre, avg(c) AS height, stddev_pop(c) AS spread "
    "FROM d JOIN part ON place >= 2000 AND place < stop GROUP BY rung), "
    "fit AS (SELECT rung, s, reg, slope / (1 + reg / spread) AS slope, centre, height FROM line, setting), "
    "err AS (SELECT rung, s, reg, avg(abs(c - height - slope * (q - centre))) AS e FROM fit, d WHERE held GROUP BY ALL), "
    "first AS (SELECT *, row_number() OVER (ORDER BY e, s) AS best FROM err WHERE rung = 0), "
    "second AS (SELECT err.*, row_number() OVER (ORDER BY err.e, err.s) AS best FROM err JOIN first USING (s) WHERE err.rung = 1 AND best <= 4), "
    "third AS (SELECT err.*, row_number() OVER (ORDER BY err.e, err.s) AS best FROM err JOIN second USING (s) WHERE err.rung = 2 AND best <= 2) "
    "SELECT rung::INTEGER AS rung, s::INTEGER AS setting, round(reg, 4) AS reg_param, round(e, 2) AS mean_absolute_error, "
    "rung = 2 AND best = 1 AS wins FROM (SELECT * FROM first UNION ALL SELECT * FROM second UNION ALL SELECT * FROM third)"
)
def search_by_halving(spark, folder):
    """Eight settings of a described space on a quarter of the rows, four on half, two on all."""
    settings = learning.sampled_settings({"regParam": learning.LogUniform(100, 1e6)}, 8)
    # A price alone does not follow from its quantity.
    cost = F.col("l_extendedprice") + 1000 * F.col("l_quantity")
    found = learning.halving_search(
        _part_rows(spark, folder).withColumn("cost", cost),
        learning.FeatureSet(numeric=("l_quantity",)),
        "cost",
        settings,
        regressor=LinearRegression(solver="normal"),
        key=LINE_KEY,
    )
    rows = [
        (rung, i, round(settings[i]["regParam"], 4), round(error, 2), rung == 2 and i == found.winner)
        for rung, i, error in found.errors
    ]
    return spark.createDataFrame(
        rows, "rung int, setting int, reg_param double, mean_absolute_error double, wins boolean"
    )


def _sums_sql(terms: int, target: str, condition: str, mark: str = "", weight: str = "1.0::DOUBLE") -> str:
    """Weighted sums of products of x0, x1, ... and the target, over rows of a condition."""
    sums = [
        f"sum({weight} * x{i} * x{j}) FILTER ({condition}) AS {mark}s_{i}_{j}"
        for i in range(terms)
        for j in range(i, terms)
    ]
    sums += [f"sum({weight} * x{i} * {target}) FILTER ({condition}) AS {mark}t_{i}" for i in range(terms)]
    return ", ".join(sums)


def _solved_sql(terms: int, source: str, marks: tuple[str, ...] = ("",)) -> str:
    """Rows of sums with coefficients b_0, b_1, ..., by elimination in order of the terms."""

    def widened(inner: str, steps: list[str]) -> str:
        return f"(SELECT *, {', '.join(steps)} FROM {inner})"

    found = source
    for j in range(terms):
        pivots, factors = [], []
        for m in marks:
            less = "".join(f" - {m}l_{j}_{k} * {m}l_{j}_{k} * {m}d_{k}" for k in range(j))
            pivots.append(f"{m}s_{j}_{j}{less} AS {m}d_{j}")
            less = "".join(f" - {m}l_{j}_{k} * {m}z_{k}" for k in range(j))
            pivots.append(f"{m}t_{j}{less} AS {m}z_{j}")
            for i in range(j + 1, terms):
                less = "".join(f" - {m}l_{i}_{k} * {m}l_{j}_{k} * {m}d_{k}" for k in range(j))
                factors.append(f"({m}s_{j}_{i}{less}) / {m}d_{j} AS {m}l_{i}_{j}")
        found = widened(found, pivots)
        found = widened(found, factors) if factors else found
    for j in reversed(range(terms)):
        steps = []
        for m in marks:
            less = "".join(f" - {m}l_{i}_{j} * {m}b_{i}" for i in range(j + 1, terms))
            steps.append(f"{m}z_{j} / {m}d_{j}{less} AS {m}b_{j}")
        found = widened(found, steps)
    return found


def _sum_of_terms(terms: int, mark: str = "") -> str:
    return " + ".join(f"{mark}b_{i} * x{i}" for i in range(terms))


@registry.add(
    "WITH x AS (SELECT segment, l_returnflag, l_linestatus, CASE WHEN l_linenumber <= 2 THEN 1.75::DOUBLE ELSE 1 END AS w, "
    "l_extendedprice AS price, l_tax AS tax, 1.0::DOUBLE AS x0, (l_returnflag = 'N')::INTEGER::DOUBLE AS x1, "
    "(l_returnflag = 'R')::INTEGER::DOUBLE AS x2, (l_linestatus = 'O')::INTEGER::DOUBLE AS x3, l_quantity::DOUBLE AS x4, l_discount::DOUBLE AS x5 "
    "FROM lineitem JOIN (VALUES ('all', 0, 99), ('first', 0, 3), ('later', 4, 99)) v(segment, low, high) ON l_linenumber BETWEEN low AND high), "
    "m AS (SELECT segment, " + _sums_sql(6, "price", "price <> 0", "p", "w") + ", " + _sums_sql(6, "tax", "tax <> 0", "q", "w") + " FROM x GROUP BY segment), "
    "k AS (SELECT * FROM " + _solved_sql(6, "m", ("p", "q")) + ") "
    "SELECT segment, l_returnflag, l_linestatus, count(*) AS n_rows, round(avg(" + _sum_of_terms(6, "p") + "), 3) AS mean_price, "
    "round(avg(" + _sum_of_terms(6, "q") + "), 8) AS mean_tax FROM x JOIN k USING (segment) GROUP BY ALL"
)
def linear_models(spark, folder):
    """Weighted models of price and tax by two labels and two numbers, in three segments."""
    rows = table(spark, folder, "lineitem").withColumn(
        "weight", splits.sample_weight("l_linenumber", range(1, 8), [1, 2])
    )
    features = learning.FeatureSet(("l_returnflag", "l_linestatus"), ("l_quantity", "l_discount"))
    segments = {"all": "true", "first": "l_linenumber <= 3", "later": "l_linenumber > 3"}
    models = linear.fit_linear(rows, features, ["l_extendedprice", "l_tax"], "weight", segments)
    groups = ["segment", "l_returnflag", "l_linestatus"]
    scored = models.score(linear.in_segments(rows, segments), groups, segment="segment")
    return scored.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.round(F.avg("`l_extendedprice-pred`"), 3).alias("mean_price"),
        F.round(F.avg("`l_tax-pred`"), 8).alias("mean_tax"),
    )


_DISPLACED = (("l_quantity", 1), ("p_size", 2), ("is_open", 3), ("is_bulk", 4))


@registry.add(
    "WITH r AS (SELECT l_returnflag, l_orderkey AS o, l_linenumber AS l, 1.0::DOUBLE AS x0, l_quantity::DOUBLE AS x1, p_size::DOUBLE AS x2, "
    "(l_linestatus = 'O')::INTEGER::DOUBLE AS x3, (l_quantity > 25)::INTEGER::DOUBLE AS x4, "
    "l_extendedprice + 2000 * l_quantity + 500 * p_size + CASE WHEN l_linestatus = 'O' THEN 12000 ELSE 0 END AS y, "
    + NUMBER.format("l_orderkey || '|' || l_linenumber || '|42'") + " AS number FROM lineitem JOIN part ON p_partkey = l_partkey), "
    "x AS (SELECT segment, r.* FROM r JOIN (VALUES ('all', 'A'), ('all', 'N'), ('all', 'R'), ('returned', 'R')) v(segment, flag) ON flag = l_returnflag), "
    "m AS (SELECT segment, " + _sums_sql(5, "y", "y <> 0 AND number % 10000 >= 2000") + " FROM x GROUP BY segment), "
    "k AS (SELECT * FROM " + _solved_sql(5, "m") + "), "
    "h AS (SELECT segment, number, o, l, x0, x1, x2, x3, x4, y, count(*) AS n FROM x WHERE number % 10000 < 2000 GROUP BY ALL), "
    "d AS (SELECT *, y - (" + _sum_of_terms(5) + ") AS off, "
    + ", ".join(f"coalesce(lead(x{i}) OVER w, first_value(x{i}) OVER w) - x{i} AS step{i}" for _, i in _DISPLACED)
    + " FROM h JOIN k USING (segment) WINDOW w AS (PARTITION BY segment ORDER BY number, o, l, x1, x2, x3, x4, y)), "
    "e AS (" + " UNION ALL ".join(f"SELECT segment, '{name}' AS feature, n, off, off - b_{i} * step{i} AS moved FROM d" for name, i in _DISPLACED) + ") "
    "SELECT segment, feature, round((sum(n * moved * moved) - sum(n * off * off)) / sum(n), 0) AS importance, "
    "round(sqrt(sum(n * off * off) / sum(n)), 4) AS error, sum(n)::BIGINT AS n_rows FROM e GROUP BY ALL"
)
def displaced_importance(spark, folder):
    """What linear models of a line's cost lose on held-out lines without each of four features.

    The cost is the price and a share for quantity, size and open lines: three features of
    different strength, and one that only goes along with the quantity.
    """
    parts = table(spark, folder, "part").select("p_partkey", "p_size")
    rows = table(spark, folder, "lineitem").join(parts, F.col("p_partkey") == F.col("l_partkey"))
    rows = rows.select(
        *LINE_KEY,
        "l_returnflag",
        "l_quantity",
        "p_size",
        (F.col("l_linestatus") == "O").alias("is_open"),
        (F.col("l_quantity") > 25).alias("is_bulk"),
        (
            F.col("l_extendedprice")
            + 2000 * F.col("l_quantity")
            + 500 * F.col("p_size")
            + F.when(F.col("l_linestatus") == "O", 12000).otherwise(0)
        ).alias("cost"),
        learning.held_out(parts, LINE_KEY, 0.2, 42).alias("held"),
    )
    features = learning.FeatureSet((), ("l_quantity", "p_size"), ("is_open", "is_bulk"))
    segments = {"all": "true", "returned": "l_returnflag = 'R'"}
    target = "cost"
    models = linear.fit_linear(rows.where("not held"), features, [target], segments=segments)
    found = linear.displacement_importance(
        rows.where("held"),
        lambda df, keep: models.score(df, keep, segment="segment"),
        features,
        target,
        LINE_KEY,
        segments,
    )
    return found.withColumns(
        {"importance": F.round("importance", 0), "error": F.round(F.sqrt("error"), 4)}
    )


@registry.add(
    "SELECT o_orderkey, (row_number() OVER (ORDER BY " + NUMBER.format("o_orderkey || '|7'") + ", o_orderkey) - 1)::BIGINT AS position FROM orders"
)
def seeded_order(spark, folder):
    """A dense position per order that follows from key and seed."""
    return splits.seeded_positions(table(spark, folder, "orders").select("o_orderkey"), ["o_orderkey"], 7)
