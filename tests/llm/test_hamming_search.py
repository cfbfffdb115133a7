from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthgrid.llm import hamming_search
from tests.llm.helpers import bag

SCHEMA = "vec_id long, embedding array<float>, label int"


def code(vector):
    return sum(1 << i for i, x in enumerate(vector[:64]) if x is not None and x > 0)


def plain(rows, k, asked=lambda key: key % 20 == 0):
    known = sorted({(key, code(v)) for key, v, _ in rows if key is not None and v is not None})
    out = []
    for key, own in known:
        if asked(key):
            near = sorted(((own ^ c).bit_count(), other) for other, c in known if other != key)[:k]
            out += [(key, rank, other, d) for rank, (d, other) in enumerate(near, 1)]
    return sorted(out, key=str)


def vectors(n, seed, dims=64, clusters=0):
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 1) for _ in range(dims)] for _ in range(max(1, clusters))]
    rows = []
    for i in range(n):
        v = [draw.gauss(0, 1) for _ in range(dims)]
        if clusters and i % 2:
            c = draw.choice(centres)
            v = [x + 0.3 * y for x, y in zip(c, v, strict=True)]
        rows.append((i, v, i % 3))
    return rows


def check(spark, rows, k=10):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert bag(hamming_search.nearest_rows(df, F.col("vec_id") % 20 == 0, k=k)) == plain(rows, k)


@pytest.mark.parametrize("k, clusters", [(10, 5), (1, 0), (3, 2)])
def test_against_all_pairs(spark, monkeypatch, k, clusters):
    monkeypatch.setattr(hamming_search.nearest_codes, "__defaults__", (10, 40, 7))
    check(spark, vectors(400, k, clusters=clusters), k)


def test_many_equal_codes(spark, monkeypatch):
    monkeypatch.setattr(hamming_search.nearest_codes, "__defaults__", (10, 16, 4))
    rows = vectors(150, 2)
    same = rows[7][1]
    check(spark, rows + [(1000 + i, same, 0) for i in range(120)])


def test_odd_rows(spark):
    rows = [
        (0, [1.0] * 64, 1), (20, [], 1), (40, None, 1), (None, [1.0], 1), (3, [1.0, None, -1.0], None),
        (60, [1.0] * 90, 1), (0, [1.0] * 64, 1),
    ]
    check(spark, rows)
    check(spark, rows[:1])
    df = spark.createDataFrame(rows, SCHEMA).withColumn("code", F.lit("x")).withColumn("id", F.lit(1))
    assert bag(hamming_search.nearest_rows(df, F.col("vec_id") % 20 == 0)) == plain(rows, 10)
    assert hamming_search.nearest_rows(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_a_block_reports_each_code_once():
    draw = np.random.default_rng(1)
    codes = np.unique(draw.integers(0, 1 << 63, 300, dtype=np.uint64) >> np.uint64(40))
    weights = ids = np.arange(len(codes))
    seen = []
    for radius in range(17):
        for segment in range(4):
            for _, found, *_ in hamming_search._probe(codes, weights, ids, codes[:1], 16, segment, 0, 0, radius, 10**6):
                seen += found.tolist()
    assert sorted(seen) == codes.tolist()
