"""Clustering of vectors around centroids, the nearest one found by the threshold algorithm."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthgrid.llm.common import stored

DIMENSIONS = 64
SCALE = 1024
CENTROIDS = 8
ROUNDS = 10
SALT = "3:"
# Components up to this size: squared distances then fit 64 bits.
LARGEST = 1 << 27
# Vectors that are walked together.
_TOGETHER = 2048
_FAR = np.int64(1) << 40


def whole_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key`` and ``vector`` as whole numbers: floor of 1,024 times each component.

    Vectors are kept if they have 64 components, none null, infinite or not a number. Null
    keys are kept like others, and repeated rows are vectors of their own. A component of
    more than 2**27 afterwards would not fit squared distances: that is an error.
    """
    value = F.col(f"`{vector}`")
    number = lambda x: x.cast("double")
    kept = (F.size(value) == DIMENSIONS) & F.forall(
        value, lambda x: x.isNotNull() & ~F.isnan(number(x)) & (F.abs(number(x)) < float("inf"))
    )
    floor = lambda x: F.floor(number(x) * SCALE)
    small = F.forall(value, lambda x: F.abs(number(x)) * SCALE <= LARGEST)
    whole = F.transform(value, floor).cast("array<int>")
    rows = df.where(F.coalesce(kept, F.lit(False)))
    return rows.select(
        F.col(f"`{key}`").alias(key),
        F.when(small, whole).otherwise(F.raise_error(F.lit("a component is too large for exact distances"))).alias("vector"),
    )


def first_centroids(vectors: DataFrame, key: str = "vec_id", n: int = CENTROIDS) -> np.ndarray:
    """The vectors whose salted keys have the smallest hashes, in their order; of the same
    key the smaller vector comes first. A null key counts as the text ``null``."""
    text: Column = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null"))
    rows = vectors.select(F.sha2(F.concat(F.lit(SALT), text), 256).alias("hash"), "vector").orderBy("hash", "vector").limit(n)
    return np.array([r["vector"] for r in rows.collect()], np.int64).reshape(-1, DIMENSIONS)


class NearestCentroid:
    """Exact nearest centroids by the threshold algorithm.

    For each dimension the centroids are sorted by their value there. A vector starts at its
    own value in every list and walks outward, to the nearer of the next centroids below and
    above, one step in all dimensions at a time. A centroid met for the first time gets its
    exact distance. The squared steps of the frontier sum to a bound that no centroid yet
    unmet can go below; the walk ends when it strictly exceeds the best distance, so that of
    equally near centroids the smaller number is found.
    """

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids.astype(np.int64)
        n, d = self.centroids.shape
        order = np.argsort(self.centroids, axis=0, kind="stable")
        self.value = np.take_along_axis(self.centroids, order, axis=0)
        # One more step at both ends, far beyond any value, that belongs to no centroid.
        edge = np.full((1, d), _FAR)
        self.padded = np.concatenate([-edge, self.value, edge])
        none = np.full((1, d), n)
        self.owner = np.concatenate([none, order, none])
        # Flat places: list after list.
        self.steps, self.owners = self.padded.T.ravel().copy(), self.owner.T.ravel().copy()
        self.begin = np.arange(d) * (n + 2)

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each vector's nearest centroid."""
        near, distance = np.zeros(len(vectors), np.int32), np.zeros(len(vectors), np.int64)
        for a in range(0, len(vectors), _TOGETHER):
            near[a : a + _TOGETHER], distance[a : a + _TOGETHER] = self._walk(vectors[a : a + _TOGETHER])
        return near, distance

    def _walk(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, d = self.centroids.shape
        best = np.full(len(vectors), np.iinfo(np.int64).max)
        near = np.full(len(vectors), n, np.int64)
        met = np.zeros((len(vectors), n + 1), bool)
        met[:, n] = True
        # The next place below and above in each list.
        above = np.empty(vectors.shape, np.int64)
        for k in range(d):
            above[:, k] = np.searchsorted(self.value[:, k], vectors[:, k]) + 1 + self.begin[k]
        below = above - 1
        active = np.arange(len(vectors))
        while len(active):
            own = vectors[active]
            low, high = below[active], above[active]
            down, up = own - self.steps[low], self.steps[high] - own
            lower = down <= up
            frontier = np.where(lower, down, up)
            owner = self.owners[np.where(lower, low, high)]
            below[active] = low - (lower & (frontier < _FAR // 2))
            above[active] = high + (~lower & (frontier < _FAR // 2))
            fresh = np.zeros((len(active), n + 1), bool)
            fresh[np.arange(len(active))[:, None], owner] = True
            fresh &= ~met[active]
            row, number = np.nonzero(fresh)
            met[active[row], number] = True
            gap = own[row] - self.centroids[number]
            exact = np.einsum("ij,ij->i", gap, gap)
            # Rows come in order; the least distance, then the least number, of each.
            order = np.lexsort((number, exact, row))
            row, number, exact = row[order], number[order], exact[order]
            first = np.ones(len(row), bool)
            first[1:] = row[1:] != row[:-1]
            row, number, exact = active[row[first]], number[first], exact[first]
            better = (exact < best[row]) | ((exact == best[row]) & (number < near[row]))
            best[row[better]], near[row[better]] = exact[better], number[better]
            # No list ends before all centroids are met.
            ended = met[active].all(axis=1)
            capped = np.minimum(frontier, np.int64(1) << 28)
            ended |= np.einsum("ij,ij->i", capped, capped) > best[active]
            active = active[~ended]
        return near, best


def _numbers(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, DIMENSIONS)


def _moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after each vector went to its nearest: exact floors of the means. Tasks send
    a sum for each centroid and dimension; centroids without vectors stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = NearestCentroid(centroids)
        sums, counts = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            if batch.num_rows:
                own = _numbers(batch["vector"])
                near, _ = search.assign(own)
                np.add.at(sums, near, own)
                counts += np.bincount(near, minlength=len(counts))
        number, dimension = np.indices(sums.shape)
        used = np.repeat(counts, sums.shape[1]) > 0
        columns = number.ravel(), dimension.ravel(), sums.ravel(), np.repeat(counts, sums.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(c[used]) for c in columns], names=["number", "dimension", "total", "n"])

    parts = vectors.select("vector").mapInArrow(run, "number long, dimension long, total long, n long")
    whole = parts.groupBy("number", "dimension").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")
    )
    # Bounded: one row for each centroid and dimension.
    out = centroids.copy()
    for r in whole.collect():
        out[r["number"], r["dimension"]] = int(r["total"]) // r["n"]
    return out


def clustered(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", n: int = CENTROIDS, rounds: int = ROUNDS
) -> tuple[DataFrame, np.ndarray]:
    """``key``, ``cluster`` and squared ``distance`` of every kept vector, and the centroids.

    The first ``n`` centroids come from the hashes of the keys. Each of ``rounds`` rounds
    assigns every vector to the nearest centroid and moves the centroids; then vectors are
    assigned once more. All is in whole numbers, so results are alike on any partitioning.
    A round reads the stored vectors and shuffles sums: ``n`` times 64 for each task. The
    driver holds the centroids only, of fixed size. Fewer vectors than ``n`` make as many
    centroids; none make an empty result.
    """
    vectors = stored(whole_vectors(df, key, vector), "centroid-vectors")
    centroids = first_centroids(vectors, key, n)
    if len(centroids):
        for _ in range(rounds):
            centroids = _moved(vectors, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = NearestCentroid(centroids)
        for batch in batches:
            near, distance = search.assign(_numbers(batch["vector"]))
            yield pa.RecordBatch.from_arrays(
                [batch["key"], pa.array(near, pa.int32()), pa.array(distance)], names=["key", "cluster", "distance"]
            )

    rows = vectors.select(F.col(f"`{key}`").alias("key"), "vector")
    kind = rows.schema["key"].dataType.simpleString()
    found = rows.mapInArrow(run, f"key {kind}, cluster int, distance long")
    return found.withColumnRenamed("key", key), centroids


def with_inertia(found: DataFrame) -> DataFrame:
    """``found`` with ``cluster_inertia`` and ``inertia``, the sums of ``distance`` over its
    cluster and over all. A row for each cluster is joined: a table of fixed size."""
    found = stored(found, "centroid-found")
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    rows = [tuple(r) for r in sums.collect()]
    table = found.sparkSession.createDataFrame(
        [(c, s, sum(r[1] for r in rows)) for c, s in rows], "cluster int, cluster_inertia long, inertia long"
    )
    return found.join(F.broadcast(table), "cluster")
