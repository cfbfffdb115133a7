"""Containment search of benchmark items in documents."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthgrid.llm.common import stored
from hearthgrid.llm.words import SMALL_SLICE, Words, signed, slices

SHINGLE = 5
CONTAINMENT = 0.8
# Size of the bit maps that documents are held against: 2 ** MAP_BITS bits, whatever the
# benchmark's size. More items only let more shingles through to the join.
MAP_BITS = 22


def required(size: int, containment: float) -> int:
    """Shingles of an item of ``size`` that a document must have."""
    return max(1, math.ceil(containment * size - 1e-9))


def item_sketches(
    items: DataFrame, containment: float = CONTAINMENT, width: int = SHINGLE
) -> DataFrame:
    """Distinct shingles of each item: ``item_id``, ``hash``, ``shingle``, ``n_item``,
    ``size_class`` (binary logarithm of the size) and ``in_sketch``.

    The sketch of an item are its smallest hashes, so many that a document without any of
    them has too few of the others: size - required + 1. Items that share an id are one
    item; null texts and texts without words have no rows.
    """
    source = items.select(F.col("item_id"), F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            for a, b in slices(texts, SMALL_SLICE):
                words = Words(texts[a:b])
                hashes, first, last = words.shingles(width)
                at = words.doc[first] + a if len(first) else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["item_id"].take(pa.array(at)),
                        signed(hashes),
                        pa.array([words.phrase(i, j) for i, j in zip(first, last, strict=True)], pa.string()),
                    ],
                    names=["item_id", "hash", "shingle"],
                )

    kind = source.schema["item_id"].dataType.simpleString()
    rows = source.mapInArrow(run, f"item_id {kind}, hash long, shingle string").distinct()
    # Order of hashes as unsigned numbers.
    order = F.col("hash").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    by_item = rows.groupBy("item_id").agg(
        F.count("*").alias("n_item"),
        F.array_sort(F.collect_list(F.struct(order.alias("order"), "hash", "shingle"))).alias("shingles"),
    )
    need = F.greatest(F.lit(1), F.ceil(F.col("n_item") * containment - 1e-9))
    return by_item.select(
        "item_id", "n_item",
        F.floor(F.log2("n_item")).cast("int").alias("size_class"),
        (F.col("n_item") - need + 1).alias("k"),
        F.posexplode("shingles").alias("place", "s"),
    ).select(
        "item_id", "n_item", "size_class", F.col("s.hash").alias("hash"),
        F.col("s.shingle").alias("shingle"), (F.col("place") < F.col("k")).alias("in_sketch"),
    )


def _class_map(hashes: DataFrame, bits: int = MAP_BITS) -> np.ndarray:
    """For each value of the leading ``bits`` bits of a hash, the size classes that have it.

    Class c is bit c of a number; there are no more than 32 classes, as no item has 2 ** 32
    shingles. At most 2 ** (bits - 6) rows for each class are collected.
    """
    top = F.shiftrightunsigned("hash", 64 - bits)
    words = hashes.groupBy("size_class", F.shiftright(top, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - bits}) & 63 as int))")).alias("flags")
    ).toArrow()
    classes = words["size_class"].to_numpy()
    found = np.zeros(1 << bits, np.uint32)
    for c in np.unique(classes):
        own = classes == c
        flags = np.zeros(1 << (bits - 6), np.int64)
        flags[words["word"].to_numpy()[own]] = words["flags"].to_numpy()[own]
        has = np.unpackbits(flags.view(np.uint8), bitorder="little").view(bool)
        found[has] |= np.uint32(1 << int(c))
    return found


def _open_classes(in_sketch: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Largest sketch hash of each size class, ascending, and the classes (as bits) that reach
    the first, second, ... of these limits; none beyond the last."""
    order = F.col("hash").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    tops = in_sketch.groupBy("size_class").agg(F.max(order).alias("top")).orderBy("top", "size_class").collect()
    limits = np.array([r["top"] + (1 << 63) for r in tops], np.uint64)
    bits = [1 << r["size_class"] for r in tops]
    return limits, np.array([sum(bits[i:]) for i in range(len(bits) + 1)], np.uint32)


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    containment: float = CONTAINMENT,
    width: int = SHINGLE,
    map_bits: int = MAP_BITS,
) -> DataFrame:
    """Pairs ``key``, ``item_id`` with ``n_shared`` and ``n_item``: the items of which a
    document has ``containment`` of the distinct shingles or more.

    MinHash with items partitioned by size: an item's sketch are its smallest hashes, and how
    many depends on its size, not on the document's, so an item of thirty words is found in
    a text of any length. Items whose numbers of shingles have the same binary logarithm are
    one partition, with a limit of its own: its sketches' largest hash. A document is a
    candidate for a partition if one of its hashes is up to the partition's limit and in the
    partition's bits of a map of a fixed size; it can contain none of its items otherwise.
    Candidates send the shingles that an item of these partitions may have, and the join with the
    items' shingles counts the equal ones, as texts: what is reported is exact.

    Shingles are ``width`` words, lower-cased. An item of fewer words is one shingle of its
    own length and is found wherever these words follow each other. Null and empty texts have
    none. Rows that share a key are judged one by one; the pair comes once, with the largest
    share.
    """
    found = _contained(docs, items, key, text, containment, width, map_bits)
    return found.groupBy(F.col("key").alias(key), "item_id").agg(
        F.max("n_shared").alias("n_shared"), F.first("n_item").alias("n_item")
    )


def _contained(docs: DataFrame, items: DataFrame, key: str, text: str, containment: float, width: int, map_bits: int) -> DataFrame:
    """The pairs of :func:`contained_items` for each ``key`` and ``digest`` of a text."""
    shingles = stored(item_sketches(items, containment, width), "item-sketches")
    spark = docs.sparkSession
    in_sketch = shingles.where("in_sketch")
    limits, reached = _open_classes(in_sketch)
    # Lengths of the items' shingles: ``width``, and those of items of fewer words.
    lengths = shingles.agg(F.array_sort(F.collect_set(F.size(F.split("shingle", " "))))).first()[0]
    maps = spark.sparkContext.broadcast((_class_map(in_sketch, map_bits), _class_map(shingles, map_bits)))
    shift = np.uint64(64 - map_bits)
    keyed = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch_map, full_map = maps.value
        for batch in batches:
            texts = batch["text"].to_pylist()
            for a, b in slices(texts, SMALL_SLICE):
                words = Words(texts[a:b])
                runs = [words.shingles(n) for n in lengths] or [words.shingles(width)]
                hashes, first, last = (np.concatenate(parts) for parts in zip(*runs))
                doc = words.doc[first] if len(first) else np.empty(0, np.int64)
                # Few hashes are left at each step.
                known = np.flatnonzero(full_map[hashes >> shift])
                held = sketch_map[hashes[known] >> shift] & reached[np.searchsorted(limits, hashes[known])]
                # Partitions that a text is a candidate for.
                wanted = np.zeros(b - a, np.uint32)
                np.bitwise_or.at(wanted, doc[known], held)
                known = known[(full_map[hashes[known] >> shift] & wanted[doc[known]]) != 0]
                rows = {(doc[i], words.phrase(first[i], last[i])): hashes[i] for i in known}
                at = [d for d, _ in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["key"].take(pa.array([d + a for d in at], pa.int64())),
                        pa.array([int(d) + a for d in at], pa.int64()),
                        signed(np.array([*rows.values()], np.uint64)),
                        pa.array([s for _, s in rows], pa.string()),
                    ],
                    names=["key", "row", "hash", "shingle"],
                )

    kind = keyed.schema["key"].dataType.simpleString()
    # A row is known by its task, batch and place only inside one run, so the digest of the
    # text tells rows that share a key apart.
    keyed = keyed.withColumn("digest", F.xxhash64("text"))

    def with_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in run(iter([batch])):
                yield pa.RecordBatch.from_arrays(
                    [out["key"], batch["digest"].take(out["row"]), out["hash"], out["shingle"]],
                    names=["key", "digest", "hash", "shingle"],
                )

    found = keyed.mapInArrow(with_digest, f"key {kind}, digest long, hash long, shingle string")
    # Equal rows (copies under one key) give equal shingles; they count once.
    matched = found.join(shingles, ["hash", "shingle"])
    counted = matched.groupBy("key", "digest", "item_id").agg(
        F.countDistinct("shingle").alias("n_shared"),
        F.first("n_item").alias("n_item"),
        F.max("in_sketch").alias("candidate"),
    )
    need = F.greatest(F.lit(1), F.ceil(F.col("n_item") * containment - 1e-9))
    return counted.where(F.col("candidate") & (F.col("n_shared") >= need))


def without_items(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    containment: float = CONTAINMENT,
    width: int = SHINGLE,
    map_bits: int = MAP_BITS,
) -> DataFrame:
    """The rows whose text contains no item. Rows that share a key, or have none, are judged
    by their own texts: key and a 64-bit digest of the text name what goes."""
    found = _contained(docs, items, key, text, containment, width, map_bits)
    leaks = stored(found.select(F.col("key").alias("__key"), F.col("digest").alias("__digest")).distinct(), "leaks")
    leaking = docs[key].eqNullSafe(leaks["__key"]) & (F.xxhash64(docs[text]) == leaks["__digest"])
    return docs.join(leaks, leaking, "left_anti")
