from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hearthgrid.llm import queries, simhash
from hearthgrid.llm.components import component_labels
from tests.llm.helpers import ODD_ROWS, as_rows, documents, sentences, words


def plain_fingerprint(text):
    w = words(text)
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))


def plain_components(nodes, linked):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {n: root(n) for n in nodes}


def plain_rows(rows, radius=2):
    prints = [plain_fingerprint(r[1]) for r in rows]
    group = plain_components(sorted(set(prints)), lambda a, b: (a ^ b).bit_count() <= radius)
    least = {}
    for row, p in zip(rows, prints, strict=True):
        if row[0] is not None:
            least[group[p]] = min(least.get(group[p], row[0]), row[0])
    return sorted(((r[0], f"{p:016x}", least.get(group[p])) for r, p in zip(rows, prints, strict=True)), key=str)


def near_copies(seed=1):
    draw = random.Random(seed)
    rows = []
    for text in sentences(25, seed, low=40, high=160):
        rows.append(text)
        for _ in range(draw.randrange(0, 6)):
            w = text.split()
            for _ in range(draw.randrange(0, 3)):
                w[draw.randrange(len(w))] = "other"
            rows.append(" ".join(w))
    draw.shuffle(rows)
    return as_rows(rows, 100)


def found(df, **options):
    rows = simhash.near_duplicates(df, **options)
    return sorted((tuple(r) for r in rows.select("doc_id", "fingerprint", "component_id").collect()), key=str)


def test_fingerprints():
    texts = [r[1] for r in ODD_ROWS] + sentences(20, 2) + ["a", "a b", "a b c", "A  B\nC d"]
    for text in texts:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_against_plain_groups(spark):
    rows = near_copies() + [(i, "the very same text for a third of all rows", "en", "s", 0) for i in range(50)]
    expected = plain_rows(rows)
    assert len({r[2] for r in expected}) < len({r[1] for r in expected})
    assert found(documents(spark, rows).repartition(4)) == expected


def test_odd_rows(spark):
    df = documents(spark, extra=["fingerprint", "group", "component_id", "key"])
    assert found(df) == plain_rows(ODD_ROWS)
    assert found(df.limit(0)) == []
    kept = simhash.without_near_duplicates(df)
    assert kept.columns == df.columns
    keys = sorted((r["doc_id"] for r in kept.collect()), key=str)
    # Null, empty and blank texts are one group, as are rows that repeat.
    assert keys == sorted([None, 9001, 9004, 9005, 9006, 9007], key=str)


def numbers(spark, values):
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    return spark.createDataFrame([(v,) for v in signed], "fingerprint long")


def grouped(spark, values, **options):
    links = simhash.fingerprint_links(numbers(spark, values), **options)
    labels = {r["node"]: r["label"] for r in component_labels(links).collect()}
    groups = {}
    for v in np.array(values, np.uint64).view(np.int64).tolist():
        groups.setdefault(labels.get(v, v), set()).add(v)
    return sorted(map(sorted, groups.values()))


def plain_groups(values, radius=2):
    group = plain_components(values, lambda a, b: (a ^ b).bit_count() <= radius)
    out = {}
    for v in values:
        out.setdefault(group[v], set()).add(int(np.uint64(v).view(np.int64)))
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("tile_rows, other_rows, part_bits", [(4096, 65536, 16), (3, 5, 16), (2, 2, 32), (50, 9, 8)])
def test_tiles_miss_no_link(spark, tile_rows, other_rows, part_bits):
    draw = random.Random(tile_rows)
    values = {0, (1 << 64) - 1, 1, 3, 1 << 63}
    for _ in range(12):
        v = draw.getrandbits(64)
        for _ in range(12):
            values.add(v)
            for _ in range(draw.randrange(1, 4)):
                v ^= 1 << draw.randrange(64)
    values = sorted(values)
    assert grouped(spark, values, tile_rows=tile_rows, other_rows=other_rows, part_bits=part_bits) == plain_groups(values)


def test_a_dense_group_has_few_links(spark):
    """All numbers with one or two bits set: many pairs, no more links than a forest has per block."""
    values = sorted({1 << i | 1 << j for i in range(24) for j in range(24)})
    links = simhash.fingerprint_links(numbers(spark, values))
    assert links.count() < 41 * len(values)
    assert grouped(spark, values) == plain_groups(values)


def test_components(spark):
    draw = random.Random(5)
    chain = [(i + 1, i) for i in range(1, 200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    free = [(draw.randrange(2000, 2100), draw.randrange(2000, 2100)) for _ in range(90)]
    edges = [*chain, *star, *free, (7, 7), (5, 6), (6, 5)]
    links = spark.createDataFrame(edges, "a long, b long")
    nodes = sorted({x for e in edges for x in e})
    near = {frozenset(e) for e in edges}
    expected = plain_components(nodes, lambda a, b: frozenset((a, b)) in near)
    labels = {r["node"]: r["label"] for r in component_labels(links).collect()}
    assert labels == {n: g for n, g in expected.items() if any(n in e for e in edges if e[0] != e[1])}
    assert component_labels(links.limit(0)).collect() == []


@pytest.mark.parametrize("bits", [6, 25])
def test_one_row_of_each_group_stays(spark, monkeypatch, bits):
    monkeypatch.setattr(simhash, "MAP_BITS", bits)
    rows = near_copies(4) + [(50, "zz zz", "en", "s", 0), (50, "aa aa", "en", "s", 0), (51, "zz zz", "en", "s", 0)]
    groups = {(r[2], r[1] if r[2] == 50 else "") for r in plain_rows(rows)}
    kept = simhash.without_near_duplicates(documents(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(g[0] for g in groups)
    # Two groups have the key 50 as their smallest: a row of each stays.
    assert sorted(r["text"] for r in kept if r["doc_id"] == 50) == ["aa aa", "zz zz"]


def test_columns_without_an_order(spark):
    """Of rows that share a key, the one with the smallest columns stays; maps count as JSON."""
    rows = [(1, "same words here", "en", "s", n) for n in (None, 2, 1)] + [(None, "no key", "en", "s", 3)] * 2
    df = documents(spark, rows).where("n_chars is not null").selectExpr(
        "doc_id", "map('k', n_chars) AS marks", "array(struct(map(n_chars, 'x') AS m)) AS deep", "text"
    )
    kept = simhash.without_near_duplicates(df)
    assert kept.dtypes == df.dtypes
    assert sorted((r["doc_id"] or 0, r["marks"]["k"]) for r in kept.collect()) == [(0, 3), (1, 1)]


def test_query(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    result = queries.op10_simhash(spark, folder).select("doc_id", "fingerprint", "component_id")
    assert sorted((tuple(r) for r in result.collect()), key=str) == plain_rows(rows)
    assert result.where(F.col("doc_id") < F.col("component_id")).isEmpty()
