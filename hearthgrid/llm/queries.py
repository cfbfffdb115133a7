"""The operators on the given tables: one query for each."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthgrid.llm import (
    centroids,
    decontaminate,
    hamming_search,
    katz,
    language,
    mixing,
    pieces,
    prefix_trie,
    quality,
    secrets,
    sharding,
    simhash,
    sql,
    token_counts,
)
from hearthgrid.llm.common import prepared, split_number
from hearthgrid.session import configure

Query = Callable[[SparkSession, str], DataFrame]
# Folder of the public vocabularies, and the setting that names another one.
TOKENIZERS = "/opt/tokenizers"
TOKENIZERS_KEY = "hearthgrid.tokenizers"
QUALITY_LEAST = 0.7

_queries: dict[str, Query] = {}


def _query(function: Query) -> Query:
    @wraps(function)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return function(prepared(configure(spark)), folder)

    _queries[function.__name__] = run
    return run


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _vocabulary(spark: SparkSession, name: str) -> str:
    return f"{spark.conf.get(TOKENIZERS_KEY, TOKENIZERS)}/{name}"


def _held_out(parts: int) -> F.Column:
    return F.coalesce(split_number(F.col("doc_id"), parts) == 2, F.lit(False))


@_query
def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id")
    return sharding.with_shards(docs, "doc_id")


@_query
def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = language.fit_languages(docs.where(~_held_out(4)))
    rows = docs.select("doc_id", _held_out(4).alias("held_out"), "text")
    return language.with_language(rows, model).drop("text")


@_query
def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    labels = _table(spark, folder, "labels")
    model = quality.fit_quality(docs, labels, trained=~_held_out(4))
    scored = quality.with_quality(docs, model)
    return scored.select(
        "doc_id",
        _held_out(4).alias("held_out"),
        "score",
        (F.col("score") >= QUALITY_LEAST).cast("int").alias("predicted"),
    )


@_query
def op4_hamming_search(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "embeddings")
    return hamming_search.nearest_rows(rows, F.col("vec_id") % 20 == 0)


@_query
def op5_katz(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text", _held_out(7).alias("held_out"))
    return katz.scored_texts(docs)


@_query
def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.with_mix(_table(spark, folder, "documents"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


@_query
def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = _table(spark, folder, "documents"), _table(spark, folder, "benchmark")
    return decontaminate.contained_items(docs, items)


@_query
def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.with_token_counts(_table(spark, folder, "documents"), _vocabulary(spark, "byte_bpe_50k.tiktoken"))


@_query
def op9_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secrets_of(_table(spark, folder, "documents"))


@_query
def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


@_query
def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    sequences = prefix_trie.turn_sequences(_table(spark, folder, "conversations"))
    return prefix_trie.trie_nodes(prefix_trie.with_shared_heads(sequences, group=5, most=9))


@_query
def op12_centroids(spark: SparkSession, folder: str) -> DataFrame:
    found, final = centroids.clustered(_table(spark, folder, "embeddings"))
    # One digest for each centroid: as many as there are clusters.
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in final.tolist()]
    digest = F.array(*map(F.lit, digests))[F.col("cluster")] if digests else F.lit(None).cast("string")
    return centroids.with_inertia(found).withColumn("centroid_sha256", digest)


@_query
def op13_pieces(spark: SparkSession, folder: str) -> DataFrame:
    model = _vocabulary(spark, "piece_bpe_32k.model")
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    tokens = pieces.encoded(docs, model).select("doc_id", "ids")
    return pieces.decoded(tokens, model).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def all_queries() -> dict[str, Query]:
    return dict(_queries)


def all_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
