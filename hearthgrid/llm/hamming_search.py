"""Exact nearest codes in Hamming distance by incremental multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthgrid.llm.common import stored

BITS = 64
NEIGHBOURS = 10
# Codes of one block, and queries that meet them in one block.
BLOCK_CODES = 1 << 13
BLOCK_QUERIES = 1 << 10


def sign_code(vector: Column, bits: int = BITS) -> Column:
    """Bit i is 1 if element i of the vector is above zero; elements it lacks count as 0."""
    flags = F.transform(
        F.slice(vector, 1, bits),
        lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")),
    )
    return F.aggregate(flags, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def segment_bits(n_codes: int, bits: int = BITS) -> int:
    """Width of a segment: about the binary logarithm of the number of codes, a divisor of ``bits``."""
    want = max(1, n_codes).bit_length() - 1
    return max((w for w in (8, 16) if w <= max(8, want + 2)), default=8)


def masks_of(width: int, radius: int) -> np.ndarray:
    """All numbers of ``width`` bits with ``radius`` bits set."""
    every = np.arange(1 << width, dtype=np.uint64)
    return every[np.bitwise_count(every) == radius]


def _probe(codes, weights, ids, queries, width, segment, prefix_bits, prefix, radius, keep):
    """New neighbours in one block: of each query the ``keep`` nearest codes whose first
    match is this segment at this radius.

    A code is met in the round and segment where one of its segments is nearest to the
    query's (the first of those alike), and in no other, so none is reported twice.
    """
    low = np.uint64((1 << width) - 1)
    part = lambda x, j: (x >> np.uint64(j * width)) & low
    values = part(codes, segment).astype(np.int64)
    order = np.argsort(values, kind="stable")
    offsets = np.searchsorted(values[order], np.arange((1 << width) + 1))
    masks = masks_of(width, radius)
    high = masks >> np.uint64(width - prefix_bits)
    for q in queries:
        value = part(q, segment)
        # Only masks that lead into this block's values.
        here = masks[high == (value >> np.uint64(width - prefix_bits)) ^ np.uint64(prefix)]
        probes = (value ^ here).astype(np.int64)
        begin, size = offsets[probes], offsets[probes + 1] - offsets[probes]
        begin, size = begin[size > 0], size[size > 0]
        if not len(begin):
            continue
        at = order[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        differs = codes[at] ^ q
        first = np.ones(len(at), bool)
        for j in range(BITS // width):
            if j != segment:
                apart = np.bitwise_count(part(differs, j))
                first &= apart > radius if j < segment else apart >= radius
        at, differs = at[first], differs[first]
        distance = np.bitwise_count(differs).astype(np.int64)
        best = np.lexsort((ids[at], distance))[:keep]
        yield q, codes[at[best]], weights[at[best]], ids[at[best]], distance[best]


def nearest_codes(
    codes: DataFrame,
    queries: DataFrame,
    k: int = NEIGHBOURS,
    block_codes: int = BLOCK_CODES,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """``query``, ``code``, ``distance`` and ``least`` of the codes that hold the ``k``
    nearest rows of each query, by distance and then ``least``.

    ``codes`` has distinct 64-bit codes (``code``), the number of rows behind each
    (``weight``) and their smallest id (``least``); ``queries`` distinct codes (``query``).

    Multi-index hashing, segment by segment: codes are cut into segments, and a round probes
    all values of each segment that differ in one more bit from the query's. After radius r
    in all m segments, every code within m * (r + 1) - 1 bits has been met (else each segment
    would differ in more than r bits). A query ends as soon as ``k`` verified rows lie
    within the covered distance; the others go on to the next radius, up to the width of a
    segment, where all codes are covered. So the result is exact, whatever the distances.

    The table of a segment lies in blocks by the leading bits of its values; a query goes
    only to blocks whose leading bits differ from its own in as many bits as the radius or
    fewer. Blocks above ``block_codes`` codes are cut by hash, and so are the queries of a
    block above ``block_queries``, so a task's block is bounded whatever the data. A block
    is probed in numpy and reports at most ``k`` codes per query. Rounds are stored; the
    driver only asks how many queries are left.
    """
    spark = codes.sparkSession
    n = codes.count()
    width = segment_bits(n)
    prefix_bits = min(width, max(0, (n // block_codes).bit_length() + 1))
    every_segment = F.explode(F.sequence(F.lit(0), F.lit(BITS // width - 1))).alias("segment")

    def prefix(code: str) -> Column:
        # Bits of the segment, then its leading ones; the segment is a column.
        value = F.call_function("shiftrightunsigned", F.col(code), F.col("segment") * width)
        kept = value.bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        return F.shiftright(kept, width - prefix_bits).cast("int")

    table = codes.select(every_segment, "code", "weight", "least").withColumn("prefix", prefix("code"))
    table = stored(table, "search-table")
    blocks = stored(
        table.groupBy("segment", "prefix").agg(F.ceil(F.count("*") / block_codes).cast("int").alias("cuts")),
        "search-blocks",
    )
    active = stored(queries.select("query"), "search-queries")
    best = None
    left = active.count()
    for radius in range(width + 1):
        if not left or not n:
            break
        steps = [m for m in range(1 << prefix_bits) if m.bit_count() <= radius]
        asked = (
            active.select(every_segment, "query")
            .withColumn("own", prefix("query"))
            .select("segment", "query", F.explode(F.array(*[F.lit(m) for m in steps])).alias("step"), "own")
            .select("segment", F.col("own").bitwiseXOR(F.col("step")).alias("prefix"), "query")
            .join(blocks, ["segment", "prefix"])
        )
        groups = asked.groupBy("segment", "prefix").agg(
            F.ceil(F.count("*") / block_queries).cast("int").alias("groups"), F.first("cuts").alias("cuts")
        )
        groups = stored(groups, "search-groups")
        indexed = table.join(groups, ["segment", "prefix"]).select(
            "segment", "prefix", F.pmod(F.xxhash64("code"), F.col("cuts")).cast("int").alias("cut"),
            F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), "code", "weight", "least",
        )
        sent = asked.join(groups.drop("cuts"), ["segment", "prefix"]).select(
            "segment", "prefix", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"),
            F.pmod(F.xxhash64("query"), F.col("groups")).cast("int").alias("group"),
            F.col("query").alias("code"), F.lit(None).cast("long").alias("weight"), F.lit(None).cast("long").alias("least"),
        )

        def probe(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
            is_query = rows["weight"].is_null().to_numpy()
            values = rows["code"].to_numpy().view(np.uint64)
            mine = rows.filter(pa.array(~is_query))
            out = [[], [], [], [], []]
            for q, *found in _probe(
                values[~is_query], mine["weight"].to_numpy(), mine["least"].to_numpy(), values[is_query],
                width, rows["segment"][0].as_py(), prefix_bits, rows["prefix"][0].as_py(), radius, k,
            ):
                for column, part in zip(out, (np.full(len(found[0]), q), *found), strict=True):
                    column.append(part)
            flat = [np.concatenate(c).view(np.int64) if c else np.empty(0, np.int64) for c in out]
            return pa.table(dict(zip(("query", "code", "weight", "least", "distance"), flat, strict=True)))

        found = (
            indexed.unionByName(sent)
            .groupBy("segment", "prefix", "cut", "group")
            .applyInArrow(probe, "query long, code long, weight long, least long, distance long")
        )
        if best is not None:
            found = found.unionByName(best.where("not done").drop("done"))
        nearest = W.partitionBy("query").orderBy("distance", "least", "code")
        ranked = found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).drop("rank")
        covered = BITS // width * (radius + 1) - 1
        inside = F.sum(F.when(F.col("distance") <= covered, F.col("weight")).otherwise(0)).over(W.partitionBy("query"))
        state = ranked.withColumn("done", inside >= k)
        if best is not None:
            state = state.unionByName(best.where("done"))
        best = stored(state, "search-best")
        done = best.where("done").select("query").distinct()
        active = stored(active.join(done, "query", "left_anti"), "search-active")
        left = active.count()
    if best is None:
        return spark.createDataFrame([], "query long, code long, distance long, least long")
    return best.select("query", "code", "distance", "least")


def nearest_rows(
    df: DataFrame, asked: Column, key: str = "vec_id", vector: str = "embedding", k: int = NEIGHBOURS
) -> DataFrame:
    """``key``, ``rank``, ``neighbour_id`` and ``distance``: of each row that ``asked``
    chooses the ``k`` nearest other rows by sign code, ties by id.

    Rows with equal codes are searched once, as one code with its smallest ids (``k`` + 1
    are enough, as a row is not its own neighbour). Rows with a null vector or key are left
    out; an empty vector has the code 0. Codes are those of the first 64 elements: vectors
    of more are compared by these alone, not refused, so that one odd row ends no job. Rows that share a key count as one if their codes
    are equal, else each. Fewer than ``k`` other rows give fewer neighbours.
    """
    coded = stored(
        df.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
        .select(F.col(key).alias("id"), sign_code(F.col(vector)).alias("code"), asked.alias("asked"))
        .groupBy("id", "code").agg(F.max("asked").alias("asked")),
        "search-codes",
    )
    smallest = W.partitionBy("code").orderBy("id")
    # The limit of a rank is applied before the shuffle too: a hot code sends few rows.
    members = stored(
        coded.withColumn("place", F.row_number().over(smallest)).where(F.col("place") <= k + 1).select("code", "id"),
        "search-members",
    )
    codes = stored(
        members.groupBy("code").agg(F.count("*").alias("weight"), F.min("id").alias("least")), "search-index"
    )
    queries = coded.where("asked")
    found = nearest_codes(codes, queries.select(F.col("code").alias("query")).distinct(), k + 1)
    rows = found.join(members, "code").select("query", "id", "distance")
    nearest = W.partitionBy("query").orderBy("distance", "id")
    shared = stored(
        rows.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= k + 1).drop("place"),
        "search-shared",
    )
    own = queries.select(F.col("id").alias("own"), F.col("code").alias("query")).join(shared, "query").where("own <> id")
    rank = F.row_number().over(W.partitionBy("own", "query").orderBy("distance", "id"))
    return (
        own.withColumn("rank", rank)
        .where(F.col("rank") <= k)
        .select(F.col("own").alias(key), "rank", F.col("id").alias("neighbour_id"), "distance")
    )
