from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from hearthgrid.llm import centroids as C

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, n=8, rounds=10):
    """Key, cluster and distance of each kept row in its order, and the centroids."""
    kept = [
        (k, [math.floor(1024 * float(np.float32(x))) for x in v])
        for k, v in rows
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)
    ]
    text = lambda k: "null" if k is None else str(k)
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{text(r[0])}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in order[:n]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))

    for _ in range(rounds if kept else 0):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for i, own in groups.items():
            centroids[i] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [(k, nearest(v)[1], nearest(v)[0]) for k, v in kept] if kept else []
    return sorted(found, key=str), centroids


def vectors(seed, n=150, values=None):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        v = [draw.choice(values) if values else draw.gauss(0, 0.3) for _ in range(64)]
        rows.append((i, v))
    return rows


ODD = [
    (None, [0.5] * 64), (1000, None), (1001, []), (1002, [0.1] * 63), (1003, [0.1] * 65), (1004, [0.1] * 63 + [None]),
    (1005, [float("nan")] + [0.1] * 63), (1006, [float("inf")] * 64), (1007, [-0.0] * 64), (1007, [-0.0] * 64),
    (1008, [-0.0001] * 64), (1009, [3.0] * 64),
]


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "map('a', 1) AS cluster", "2 AS distance", "3 AS key")
    got, final = C.clustered(df, **options)
    assert got.columns == ["vec_id", "cluster", "distance"]
    return sorted((tuple(r) for r in got.collect()), key=str), final.tolist()


@pytest.mark.parametrize("seed, values", [(1, None), (2, [0.0, 0.25]), (3, [0.1])])
def test_against_plain_rounds(spark, seed, values):
    """Also on vectors many of which are equally near to several centroids."""
    rows = vectors(seed, values=values) + ODD
    expected, centroids = plain(rows)
    got, final = found(spark, rows)
    assert (got, final) == (expected, centroids)


def test_a_walk_finds_the_nearest_of_many():
    draw = np.random.default_rng(5)
    for n, spread in ((1, 5), (2, 1), (7, 2), (40, 3), (300, 400)):
        centroids = draw.integers(-spread, spread + 1, (n, 64))
        own = draw.integers(-spread - 2, spread + 3, (500, 64))
        far = ((own[:, None, :] - centroids[None]) ** 2).sum(axis=2)
        near, distance = C.NearestCentroid(centroids).assign(own)
        assert (near == far.argmin(axis=1)).all() and (distance == far.min(axis=1)).all()


def test_a_walk_ends_before_all_centroids_are_met(monkeypatch):
    """Close by one centroid, the frontier passes it before the far ones are met."""
    centroids = np.arange(50)[:, None] * np.ones((1, 64), int) * 1000
    search = C.NearestCentroid(centroids)
    exact = []
    einsum = np.einsum
    monkeypatch.setattr(C.np, "einsum", lambda *a: exact.append(len(a[1])) or einsum(*a))
    near, distance = search.assign(centroids[[20, 30]] + 3)
    assert near.tolist() == [20, 30] and distance.tolist() == [64 * 9] * 2
    # Distances of the nearest and of the next one only.
    assert sum(exact[::2]) <= 4


def test_bounds_of_components(spark):
    edge = [(0, [131072.0] * 64), (1, [-131072.0] * 64)]
    got, _ = found(spark, edge, n=2, rounds=0)
    assert [r[2] for r in got] == [0, 0]
    got, _ = found(spark, edge, n=1, rounds=0)
    assert sorted(r[2] for r in got) == [0, 64 * (1 << 56)]
    with pytest.raises(Exception, match="too large"):
        found(spark, [(0, [131073.0] * 64)])


def test_fewer_vectors_than_centroids_and_none(spark):
    assert found(spark, vectors(4, n=3)) == plain(vectors(4, n=3))
    assert found(spark, [(1, None)]) == ([], [])


def test_inertia(spark):
    got, _ = C.clustered(spark.createDataFrame(vectors(6), SCHEMA))
    rows = C.with_inertia(got).collect()
    assert len(rows) == 150
    for r in rows:
        assert r["cluster_inertia"] == sum(o["distance"] for o in rows if o["cluster"] == r["cluster"])
        assert r["inertia"] == sum(o["distance"] for o in rows)
