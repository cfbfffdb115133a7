"""SimHash fingerprints and exact near-duplicate groups by tiled comparison."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, LongType, MapType, StructType, VariantType

from hearthgrid.llm.common import stored
from hearthgrid.llm.components import component_labels

RADIUS = 2
SHINGLE = 3
SEED = 42
# Bits of a fingerprint that a part has; a tile holds the fingerprints whose parts have
# equal population counts.
PART_BITS = 16
# Fingerprints of a tile that are compared as one side, and rows of the other side.
TILE_ROWS = 4096
OTHER_ROWS = 65536
# Bits of the map of keys that are not simply kept.
MAP_BITS = 25


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits; each is 1 if more than half of the shingle hashes have it.

    Shingles are runs of ``width`` words, repeats included. A text of fewer words is one
    shingle, a text without words has the fingerprint zero.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    n = len(starts)
    hashes = np.fromiter(
        (digest(joined[a:b], seed) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)),
        np.uint64,
        n,
    )
    votes = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        octets = hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


@F.pandas_udf(LongType())
def fingerprint_column(text: pd.Series) -> pd.Series:
    """The fingerprint of each text, as the signed number that a long holds."""
    values = np.fromiter(map(fingerprint, text), np.uint64, len(text))
    return pd.Series(values.view(np.int64))


def tile_of(value: Column, part_bits: int = PART_BITS) -> Column:
    """The population counts of a fingerprint's parts, as one number with a byte for each."""
    tile = F.lit(0).cast("long")
    mask = (1 << part_bits) - 1
    for i in range(64 // part_bits):
        part = F.shiftrightunsigned(value, i * part_bits).bitwiseAND(F.lit(mask).cast("long"))
        tile = tile + F.shiftleft(F.bit_count(part).cast("long"), 8 * i)
    return tile


def near_tiles(radius: int, part_bits: int = PART_BITS) -> list[int]:
    """Differences between the numbers of tiles whose counts differ by ``radius`` at most."""
    parts = 64 // part_bits
    return [
        sum(step << (8 * i) for i, step in enumerate(steps))
        for steps in product(range(-radius, radius + 1), repeat=parts)
        if sum(map(abs, steps)) <= radius
    ]


def _forest(own: np.ndarray, other: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what fingerprints within the radius connect, fewer than there are nodes.

    Exact comparison by exclusive-or and bit counts, some rows at a time. Only links that
    join two groups are kept, so a dense group costs as many rows as it has members.
    """
    nodes, place = np.unique(np.concatenate([own, other]), return_inverse=True)
    group = np.arange(len(nodes))
    left, right = place[: len(own)], place[len(own) :]
    links = []
    for begin in range(0, len(own), 64):
        near = np.bitwise_count(own[begin : begin + 64, None] ^ other[None, :]) <= radius
        for i in np.flatnonzero(near.sum(axis=1) > 0):
            a = left[begin + i]
            found = right[near[i]]
            groups, where = np.unique(group[found], return_index=True)
            new = groups != group[a]
            if new.any():
                links += [(int(nodes[a]), int(nodes[b])) for b in found[where[new]]]
                group[np.isin(group, groups)] = group[a]
    return links


def fingerprint_links(
    prints: DataFrame,
    radius: int = RADIUS,
    part_bits: int = PART_BITS,
    tile_rows: int = TILE_ROWS,
    other_rows: int = OTHER_ROWS,
) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints (column ``fingerprint``) that connect
    exactly those that steps of ``radius`` differing bits connect.

    The distance of two fingerprints is at least the sum of the differences between the
    population counts of their parts, so only pairs of tiles whose counts differ by no more
    than the radius in sum are compared; all others are skipped without being made. Each
    unordered pair of tiles is one comparison. Tiles above ``tile_rows`` are cut by hash,
    as is the other side above ``other_rows``, so a task holds a bounded block whatever the
    data. No pair goes unseen: blocks of a tile meet every block of its neighbours.
    """
    spark = prints.sparkSession
    tiles = prints.select("fingerprint", tile_of(F.col("fingerprint"), part_bits).alias("tile"))
    sizes = stored(tiles.groupBy("tile").agg(F.count("*").alias("n")), "tile-sizes")
    steps = F.array(*[F.lit(s).cast("long") for s in near_tiles(radius, part_bits) if s >= 0])
    # A tile takes as its other side itself and the neighbours of higher number.
    meets = sizes.select(F.explode(steps).alias("step"), F.col("tile").alias("home"), F.col("n")).select(
        "home", (F.col("home") + F.col("step")).alias("tile"), F.col("n").alias("home_n")
    )
    meets = meets.join(sizes, "tile")
    blocks = stored(
        meets.groupBy("home")
        .agg(F.first("home_n").alias("home_n"), F.sum("n").alias("other_n"), F.collect_list("tile").alias("others"))
        .select(
            "home",
            F.ceil(F.col("home_n") / tile_rows).cast("int").alias("cuts"),
            F.ceil(F.col("other_n") / other_rows).cast("int").alias("other_cuts"),
            "others",
        ),
        "tile-blocks",
    )
    cut = F.xxhash64("fingerprint")
    own = tiles.join(blocks.drop("others").withColumnRenamed("home", "tile"), "tile").select(
        F.col("tile").alias("home"),
        F.pmod(cut, F.col("cuts")).cast("int").alias("cut"),
        F.explode(F.sequence(F.lit(0), F.col("other_cuts") - 1)).alias("other_cut"),
        "fingerprint",
        F.lit(True).alias("own"),
    )
    others = blocks.select("home", "cuts", "other_cuts", F.explode("others").alias("tile"))
    other = tiles.join(others, "tile").select(
        "home",
        F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"),
        F.pmod(cut, F.col("other_cuts")).cast("int").alias("other_cut"),
        "fingerprint",
        F.lit(False).alias("own"),
    )
    key = F.xxhash64("home", "cut", "other_cut")
    rows = (
        own.select(key.alias("block"), "fingerprint", "own")
        .unionByName(other.select(key.alias("block"), "fingerprint", "own"))
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(parts):
            block = np.concatenate([p[0] for p in parts])
            values = np.concatenate([p[1] for p in parts])
            mine = np.concatenate([p[2] for p in parts])
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]])
            out = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                is_own = mine[a:b]
                out += _forest(values[a:b][is_own], values[a:b][~is_own], radius)
            pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            part = [
                batch["block"].to_numpy(),
                batch["fingerprint"].to_numpy().view(np.uint64),
                batch["own"].to_numpy(zero_copy_only=False),
            ]
            # The last block of a batch may go on in the next one.
            last = int(np.searchsorted(part[0], part[0][-1]))
            if last or (held and held[-1][0][-1] != part[0][0]):
                held.append([x[:last] for x in part])
                yield links(held)
                held = []
            held.append([x[last:] for x in part])
        if held:
            yield links(held)

    dealt = rows.repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(compare, "a long, b long")


def near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS
) -> DataFrame:
    """``key``, ``fingerprint`` (16 hex digits), ``component_id`` and ``group`` of every row.

    Rows whose fingerprints differ in at most ``radius`` bits are linked; the component is
    the smallest key that links reach, the row's own included. Copies meet once, as one
    fingerprint. Null and empty texts have the fingerprint zero and are linked like any
    other. Rows with a null key take part; a component of null keys only has a null id.
    ``group`` names the component by its smallest fingerprint, as a signed number.
    """
    fingerprint_of_row = fingerprint_column(F.col(text)).alias("fingerprint")
    prints = stored(df.select(key, fingerprint_of_row), "simhash-fingerprints")
    distinct = stored(
        prints.groupBy("fingerprint").agg(F.min(key).alias("least")), "simhash-distinct"
    )
    links = stored(fingerprint_links(distinct, radius), "simhash-links")
    labels = component_labels(links)
    grouped = distinct.join(labels, distinct.fingerprint == labels.node, "left").select(
        "fingerprint", "least", F.coalesce("label", "fingerprint").alias("label")
    )
    least = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    by_print = stored(
        grouped.join(least, "label").select("fingerprint", "component_id", F.col("label").alias("group")),
        "simhash-components",
    )
    return prints.join(by_print, "fingerprint").select(
        key, F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id", "group"
    )


def without_near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS
) -> DataFrame:
    """One row of each near-duplicate group: the one with the group's smallest key.

    Of a group's rows that share that key, and of the rows of a group that has null keys
    only, the one with the smallest columns, in their order, stays.
    """
    signed = F.conv("fingerprint", 16, -10).cast("long").alias("print")
    found = near_duplicates(df, key, text, radius).select(key, signed, "component_id", "group")
    return one_row_of_each_group(df, stored(found, "simhash-found"), fingerprint_column, key, text)


def unordered(kind: DataType) -> bool:
    """Whether values of a type cannot be compared."""
    if isinstance(kind, ArrayType):
        return unordered(kind.elementType)
    if isinstance(kind, StructType):
        return any(unordered(field.dataType) for field in kind.fields)
    return isinstance(kind, (MapType, VariantType))


def one_row_of_each_group(
    df: DataFrame, found: DataFrame, print_of: Callable[[Column], Column], key: str, text: str
) -> DataFrame:
    """Rows of ``df`` that stay by ``found``: ``key``, ``print``, ``component_id`` and ``group``
    of every row, where ``print_of`` gives a text's print.

    Most rows stay and are not shuffled: a bit map of a fixed size has the hashes of all
    keys that are dropped or that several rows have. Only rows that meet a bit are joined
    with these keys, which tells the few that only share a hash. Columns that have no order,
    those with maps, count as their JSON text where rows are compared.
    """
    keys = found.groupBy(F.col(key).alias("__key")).agg(
        F.count("*").alias("n"), F.first(F.col(key) == F.col("component_id")).alias("least")
    )
    marks = stored(
        keys.where("__key is not null and (n > 1 or not least)").select("__key", (F.col("n") > 1).alias("several")),
        "simhash-marks",
    )
    bit = F.pmod(F.xxhash64("__key"), 1 << MAP_BITS)
    word, place = F.shiftright(bit, 6).alias("__word"), (bit % 64).cast("int").alias("__place")
    flag = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__place"))
    # At most 2 ** (MAP_BITS - 6) rows, whatever the number of keys.
    bit_map = marks.select(word, place).groupBy("__word").agg(F.bit_or(flag).alias("__bits"))
    bit_map = stored(bit_map, "simhash-map")
    packed = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    compared = [
        F.to_json(F.struct(F.col("row")[field.name])) if unordered(field.dataType) else F.col("row")[field.name]
        for field in df.schema.fields
    ]
    rows = df.select(packed, F.col(key).alias("__key"), F.col(text).alias("__text"))
    rows = rows.select("*", word, place).join(F.broadcast(bit_map), "__word", "left")
    met = F.coalesce(F.col("__bits").bitwiseAND(flag) != 0, F.lit(False)) | F.col("__key").isNull()
    single = rows.where(~met).select("row")
    doubtful = rows.where(met).select("row", "__key", "__text").join(marks, "__key", "left")
    unmarked = doubtful.where("several is null and __key is not null").select("row")
    # Rows that share a key, or have none: the group tells which one stays.
    groups = found.select(F.col("print").alias("__print"), "group", "component_id").distinct()
    several = (
        doubtful.where("several or __key is null")
        .withColumn("__print", print_of(F.col("__text")))
        .join(groups, "__print")
        .where(F.col("__key").eqNullSafe(F.col("component_id")))
        .groupBy("group")
        .agg(F.min_by("row", F.struct(*compared)).alias("row"))
        .select("row")
    )
    return single.unionByName(unmarked).unionByName(several).select("row.*")
