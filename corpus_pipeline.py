"""A corpus pipeline: five operators over the documents, each on what the last one kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthgrid.llm import decontaminate, language, mixing, near_copies, sharding
from hearthgrid.llm.common import prepared, split_number, stored
from hearthgrid.session import configure

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Language ID and grouping by shingles have no SQL form: the tests hold the pipeline
# against a plain version of each stage.
ORACLE_SQL: str | None = None


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is decided: texts without letters go, and texts whose
    likeliest language is less likely than all others together."""
    prepared(configure(spark))
    trained = F.coalesce(split_number(F.col("doc_id"), 4) != 2, F.lit(True))
    model = language.fit_languages(docs.where(trained))
    scored = language.with_language(docs, model)
    return scored.where(language.confident(F.col("score"), F.col("lang_pred"))).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of texts that share 0.8 of their
    runs of five words: pairs are those whose SimHash codes are near, the share decides."""
    prepared(configure(spark))
    return near_copies.without_near_copies(docs)


def keep_clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of ``benchmark``."""
    prepared(configure(spark))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.without_items(docs, items)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    prepared(configure(spark))
    return mixing.repeated_by_mix(docs)


def place_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their ``slot`` and ``shard``."""
    prepared(configure(spark))
    return sharding.with_shards(docs, "doc_id")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", keep_languages),
    ("simhash_near_dedup", keep_one_of_each_group),
    ("benchmark_decontamination", keep_clean_of_benchmark),
    ("mixing", mix_sources),
    ("sharding", place_in_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is stored and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
