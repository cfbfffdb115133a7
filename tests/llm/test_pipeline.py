"""The pipeline's stages against plain versions, each on its own input."""

from __future__ import annotations

import importlib.util
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hearthgrid.llm import sharding
from hearthgrid.llm.common import stored
from tests.llm.helpers import ODD_ROWS, documents, sentences
from tests.llm.test_decontaminate import plain_pairs
from tests.llm.test_mixing import plain_mix
from tests.llm.test_sharding import number, plain_table
from tests.llm.test_similar import plain_groups

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def after(spark, folder):
    """What each stage was given, and what it returned."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = documents(spark).select(*COLUMNS)
    docs = stored(docs.unionByName(odd), "test-input")
    steps = []
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, folder), f"test-{name}")
        steps.append((name, [tuple(r) for r in docs.collect()], out.columns, [tuple(r) for r in out.collect()]))
        docs = out
    return {name: rest for name, *rest in steps}


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "simhash_near_dedup", "benchmark_decontamination", "mixing", "sharding",
    ]
    assert importlib.util.find_spec("hearthgrid.llm") is not None


def test_all_but_the_last_keep_the_columns(after):
    for name, (_, columns, _) in after.items():
        assert columns == (COLUMNS if name != "sharding" else [*COLUMNS, "slot", "shard"])


def test_columns_without_an_order(spark, folder):
    """A column of maps goes through every stage; rows that share a key are among those."""
    rows = [*ODD_ROWS, *[(i, t, "en", "s", 1) for i, t in enumerate(sentences(20, 4))]]
    docs = documents(spark, rows).withColumn("marks", F.create_map(F.lit("k"), F.col("n_chars")))
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, folder), f"test-maps-{name}")
    assert docs.columns == [*COLUMNS, "marks", "slot", "shard"]
    assert all(r["marks"] == {"k": r["n_chars"]} for r in docs.collect()) and not docs.isEmpty()


def test_language_id_drops_only_what_has_no_language(after):
    given, _, kept = after["language_id"]
    gone = Counter(given) - Counter(kept)
    assert not Counter(kept) - Counter(given)
    # Rows without letters go; clean texts stay.
    assert {r[0] for r in gone} >= {9001, 9002, 9003, 9004}
    assert sum(any(c.isalpha() for c in r[1] or "") for r in gone.elements()) <= 0.01 * len(given)


def test_one_row_of_each_group(after):
    """Groups are those of an exact Jaccard similarity of 0.8 in runs of five words."""
    given, _, kept = after["simhash_near_dedup"]
    assert Counter(r[0] for r in kept) == Counter({least for _, least in plain_groups(given)})
    assert not set(kept) - set(given)


def test_leaks_go_and_clean_rows_stay(spark, folder, after):
    given, _, kept = after["benchmark_decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    leaks = {p[0] for p in plain_pairs(given, items)}
    assert leaks and Counter(kept) == Counter(r for r in given if r[0] not in leaks)


def test_mix(after):
    given, _, kept = after["mixing"]
    sizes = {(r[0], r[1]): (r[2], r[5]) for r in plain_mix(given)}
    expected = Counter()
    for row in given:
        size, taken = sizes[row[0], row[3]]
        expected[row] += taken // size if size else 0
    assert Counter(kept) == +expected


def test_shards(after):
    given, _, placed = after["sharding"]
    owner = plain_table(list(sharding.SHARDS), sharding.TABLE_SIZE)
    slots = [number("null" if r[0] is None else str(r[0])) % sharding.TABLE_SIZE for r in given]
    assert Counter(placed) == Counter((*r, s, owner[s]) for r, s in zip(given, slots, strict=True))


def test_stages_on_no_rows(spark, folder):
    docs = documents(spark, ODD_ROWS).limit(0).select(*COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).collect() == []


def test_run(spark, folder):
    found = corpus_pipeline.run(spark, folder)
    assert found.columns == [*COLUMNS, "slot", "shard"] and found.count() > 0
    assert sentences(1)
