"""Groups of texts by the exact Jaccard similarity of their word shingles."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from hearthgrid.llm.common import stored
from hearthgrid.llm.components import component_labels
from hearthgrid.llm.simhash import MAP_BITS, one_row_of_each_group
from hearthgrid.llm.words import SMALL_SLICE, Words, signed, slices

SHINGLE = 5
SIMILARITY = 0.8
# Texts, about so many, that tell which shingles are common; how many of them must have a
# shingle, and the most shingles that are told. This orders shingles and loses no pair.
SAMPLE_ROWS = 20_000
COMMON_LEAST = 2
COMMON_MOST = 1 << 20
# Rounds in which each text meets two others at most, before all pairs that are left.
ROUNDS = 3
# Longs of a text's parity map.
MAP_LONGS = 8
# Prints a task remembers as sent.
KNOWN_PRINTS = 200_000


def bodies(texts: Iterable[str | None]) -> list[bytes]:
    """16 bytes that stand for the words of each text; texts of the same words are equal."""
    return [xxhash.xxh3_128_digest(b" ".join((t or "").encode("utf-8", "replace").lower().split())) for t in texts]


def _body_series(text: pd.Series) -> pd.Series:
    return pd.Series(bodies(text), dtype=object)


# Not deterministic for the planner, or a join on it has a worker more for each task, which
# evaluates it again to drop nulls.
body_column = F.pandas_udf(_body_series, BinaryType()).asNondeterministic()


def shingle_sets(texts: list[str | None], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text: position of the text and hash, in this order."""
    words = Words(texts)
    hashes, first, _ = words.shingles(width)
    doc = words.doc[first] if len(first) else np.empty(0, np.int64)
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[new], hashes[new]


def _lists(doc: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    offsets = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), signed(values))


def common_shingles(df: DataFrame, text: str, width: int, rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Hashes that many texts of a sample have, the rarest first; a bounded number."""
    step = max(1, df.count() // rows)
    sample = df.where(F.pmod(F.xxhash64(F.col(text)), F.lit(step)) == 0).select(F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            for a, b in slices(texts):
                hashes, n = np.unique(shingle_sets(texts[a:b], width)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([signed(hashes), pa.array(n)], names=["hash", "n"])

    counts = sample.mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    counts = stored(counts.where(F.col("n") >= COMMON_LEAST), "similar-common")
    most = counts.orderBy(F.desc("n"), "hash").limit(COMMON_MOST).toArrow()
    return most["hash"].to_numpy().view(np.uint64)[::-1].copy()


def text_prefixes(
    df: DataFrame, common: np.ndarray, key: str, text: str, similarity: float, width: int
) -> DataFrame:
    """``key``, ``print``, the number ``n`` of shingles, those that come ``first`` and their
    parity map ``bits``.

    Texts order their shingles alike, the common ones last. Two texts as similar as asked
    have one in common among the first ``n - required + 1`` of each. A bit of the map tells
    whether an odd number of the shingles have it as their last digits, so two maps differ in
    no more bits than the two sets differ in shingles.
    """
    width_of_map = MAP_LONGS * 64
    by_hash = np.argsort(common)
    shared = df.sparkSession.sparkContext.broadcast((common[by_hash], by_hash + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = shared.value
        for batch in batches:
            texts = batch["text"].to_pylist()
            for a, b in slices(texts):
                doc, hashes = shingle_sets(texts[a:b], width)
                place = np.zeros(len(hashes), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                    place = np.where(known[at] == hashes, rank[at], 0)
                order = np.lexsort((hashes, place, doc))
                doc, hashes = doc[order], hashes[order]
                sizes = np.bincount(doc, minlength=b - a)
                taken = sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1
                use = np.arange(len(doc)) - (np.cumsum(sizes) - sizes)[doc] < taken[doc]
                bit = (hashes % np.uint64(width_of_map)).astype(np.int64)
                odd = np.bincount(doc * width_of_map + bit, minlength=(b - a) * width_of_map) & 1
                maps = np.packbits(odd.astype(np.uint8)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["key"].slice(a, b - a),
                        batch["print"].slice(a, b - a),
                        pa.array(sizes),
                        _lists(doc[use], hashes[use], b - a),
                        pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * MAP_LONGS), pa.array(maps)),
                    ],
                    names=["key", "print", "n", "first", "bits"],
                )

    kind = df.select(F.col(key).alias("key")).schema["key"].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), body_column(F.col(text)).alias("print"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, print binary, n long, first array<long>, bits array<long>")


def meeting(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows whose ``column`` may be among that of ``wanted``: they meet its bit map, which has
    a fixed size. It saves the shuffle of others; a join tells which rows are meant."""
    bit = F.pmod(F.xxhash64(column), 1 << MAP_BITS)
    word, place = F.shiftright(bit, 6).alias("__word"), (bit % 64).cast("int").alias("__place")
    flag = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__place"))
    bits = wanted.select(word, place).groupBy("__word").agg(F.bit_or(flag).alias("__map"))
    met = rows.select("*", word, place).join(F.broadcast(stored(bits, "similar-map")), "__word")
    return met.where(F.col("__map").bitwiseAND(flag) != 0).select(*rows.columns)


def _print_bits(prints: list[bytes]) -> np.ndarray:
    """The bit of each print in a map of 2 ** MAP_BITS: its last digits."""
    ends = np.frombuffer(b"".join(p[-4:] for p in prints), ">u4")
    return ends.astype(np.int64) % (1 << MAP_BITS)


def _print_map(wanted: DataFrame) -> np.ndarray:
    """A bit map of the column ``print``. At most 2 ** (MAP_BITS - 6) rows are collected,
    whatever the number of prints."""
    bit = F.pmod(F.conv(F.hex(F.expr("substring(print, -4, 4)")), 16, 10).cast("long"), F.lit(1 << MAP_BITS))
    flag = F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))
    words = wanted.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(flag).alias("flags")).toArrow()
    found = np.zeros(1 << (MAP_BITS - 6), "<i8")
    found[words["word"].to_numpy()] = words["flags"].to_numpy()
    return found.view(np.uint8)


def _sets(df: DataFrame, text: str, width: int, wanted: DataFrame) -> DataFrame:
    """``print`` and its ``shingles`` for the prints of ``wanted``, once each.

    Texts are held against a bit map of fixed size; only those that meet a bit become sets
    and are shuffled, copies within a task once. One Python worker for each task does it all.
    """
    shared = df.sparkSession.sparkContext.broadcast(_print_map(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        sent: set[bytes] = set()
        for batch in batches:
            if len(sent) > KNOWN_PRINTS:
                sent.clear()
            texts, prints = [], []
            every = batch["text"].to_pylist()
            made = bodies(every)
            bit = _print_bits(made)
            met = known[bit >> 3] >> (bit & 7).astype(np.uint8) & 1
            for i in np.flatnonzero(met):
                if made[i] not in sent:
                    sent.add(made[i])
                    texts.append(every[i])
                    prints.append(made[i])
            for a, b in slices(texts, SMALL_SLICE):
                doc, hashes = shingle_sets(texts[a:b], width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prints[a:b], pa.binary()), _lists(doc, hashes, b - a)], names=["print", "shingles"]
                )

    sets = df.select(F.col(text).alias("text")).mapInArrow(run, "print binary, shingles array<long>")
    return sets.join(wanted, "print", "left_semi").groupBy("print").agg(F.first("shingles").alias("shingles"))


def verified(
    df: DataFrame, met: DataFrame, wanted: DataFrame, text: str, similarity: float, width: int
) -> DataFrame:
    """Those pairs ``a``, ``b`` of ``met`` whose sets of shingles are as similar as asked;
    ``wanted`` has the prints of all pairs."""
    # Not stored: both joins take the sets as they were dealt by print.
    sets = _sets(df, text, width, wanted)
    met = met.join(sets.select(F.col("print").alias("b"), F.col("shingles").alias("others")), "b")
    met = met.join(sets.select(F.col("print").alias("a"), F.col("shingles").alias("own")), "a")
    common = F.size(F.array_intersect("own", "others"))
    both = F.size("own") + F.size("others") - F.col("common")
    found = met.select("a", "b", "own", "others", common.alias("common"))
    return found.where(F.col("common") >= similarity * both - 1e-9).select("a", "b")


def similar_links(
    df: DataFrame, prefixes: DataFrame, text: str, similarity: float, width: int
) -> DataFrame:
    """Links ``a``, ``b`` between prints that connect exactly what pairs of texts of at
    least this similarity connect, as far as 64-bit hashes tell shingles apart.

    Candidates are texts that share one of their first shingles, of sizes and at places that
    allow the similarity, and whose parity maps do not rule it out; the sets of shingles of
    those left are made and decide. In the first rounds each text meets two others at most, by
    two hashes the least of those that its shared shingles name, each shingle the same one
    for all its texts. Groups of many copies are mostly connected by that, and what is
    connected needs no more pairs. Rounds end when they link nothing more; the last one makes
    all pairs that are left: none goes unseen.
    """
    rows = prefixes.select("print", F.col("n").cast("int").alias("n"), F.posexplode("first").alias("at", "hash"))
    several = rows.groupBy("hash").agg(
        F.min(F.xxhash64("print")).alias("low"), F.max(F.xxhash64("print")).alias("high")
    ).where("low <> high")
    several = stored(several.select("hash"), "similar-several")
    rows = stored(meeting(rows, "hash", several).join(several, "hash").distinct(), "similar-shared")
    prints = rows.select("print").distinct()
    maps = prefixes.select("print", "bits", "n").join(prints, "print", "left_semi").dropDuplicates(["print"])
    maps = stored(maps, "similar-maps")
    # Shingles before the first one in common are in one text only, so this many can be in both.
    most = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("other_at"))
    near = most >= similarity * (F.col("n") + F.col("m") - most) - 1e-9
    differing = sum((F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("other_bits")[i])) for i in range(MAP_LONGS)), F.lit(0))
    # Sets this similar differ in no more shingles than that.
    allowed = (F.col("n") + F.col("m")) * ((1 - similarity) / (1 + similarity)) + 1e-6
    links = None
    labelled = rows.withColumn("label", F.col("print"))
    turn = 0
    while turn <= ROUNDS:
        # Shingles of texts that are not all connected.
        open_ = labelled.groupBy("hash").agg(
            F.min("label").alias("low"), F.max("label").alias("high"),
            F.min_by(F.struct("print", "n", "at", "label"), F.xxhash64("print", F.lit(turn))).alias("one"),
        ).where("low <> high")
        left = stored(labelled.join(open_, "hash"), f"similar-open-{turn}")
        if left.isEmpty():
            break
        if turn == ROUNDS:
            mapped = left.select("hash", "print", "n", "at", "label").join(maps.select("print", "bits"), "print")
            other = mapped.select(
                "hash", F.col("print").alias("b"), F.col("n").alias("m"), F.col("at").alias("other_at"),
                F.col("label").alias("other_label"), F.col("bits").alias("other_bits"),
            )
            met = mapped.withColumnRenamed("print", "a").join(other, "hash")
            met = met.where((F.col("a") < F.col("b")) & (F.col("label") != F.col("other_label")) & near & (differing <= allowed))
            met = met.select("a", "b").distinct()
        else:
            met = left.select(
                F.col("one.print").alias("a"), F.col("one.n").alias("n"), F.col("one.at").alias("at"),
                F.col("one.label").alias("label"), F.col("print").alias("b"), F.col("n").alias("m"),
                F.col("at").alias("other_at"), F.col("label").alias("other_label"),
            )
            met = met.where((F.col("label") != F.col("other_label")) & near)
            least = F.min_by("a", F.xxhash64("a", F.lit(turn))), F.min_by("a", F.xxhash64("a", "b", F.lit(turn)))
            met = met.groupBy("b").agg(F.array(*least).alias("a"))
            met = met.select(F.explode(F.array_distinct("a")).alias("a"), "b")
            met = met.join(maps.select(F.col("print").alias("a"), "bits", "n"), "a")
            met = met.join(maps.select(F.col("print").alias("b"), F.col("bits").alias("other_bits"), F.col("n").alias("m")), "b")
            met = met.where(differing <= allowed).select("a", "b")
        met = stored(met, "similar-pairs")
        wanted = stored(met.select(F.col("a").alias("print")).union(met.select("b")).distinct(), "similar-wanted")
        found = verified(df, met, wanted, text, similarity, width)
        found = stored(found, "similar-links")
        links = found if links is None else links.unionByName(found)
        if turn < ROUNDS and found.isEmpty():
            turn = ROUNDS
            continue
        turn += 1
        if turn <= ROUNDS:
            # Shingles of connected texts stay so: only those open now are looked at again.
            labels = component_labels(links).select(F.col("node").alias("print"), F.col("label").alias("new"))
            labelled = left.select("hash", "print", "n", "at").join(labels, "print", "left").select(
                "hash", "print", "n", "at", F.coalesce("new", "print").alias("label")
            )
    return links if links is not None else rows.select(F.col("print").alias("a"), F.col("print").alias("b")).limit(0)


def similar_texts(
    df: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, width: int = SHINGLE
) -> DataFrame:
    """``key``, ``print`` (of the text's words), ``component_id`` and ``group`` of every row.

    Texts whose sets of runs of ``width`` words have a Jaccard similarity of at least
    ``similarity`` are linked; the component is the smallest key that links reach. Texts of
    the same words, letter case aside, are one; those without words are alike. A text of
    fewer words than ``width`` is one run.
    """
    common = common_shingles(df, text, width)
    rows = stored(text_prefixes(df, common, key, text, similarity, width), "similar-prefixes")
    distinct = rows.groupBy("print").agg(F.min("key").alias("least"))
    distinct = stored(distinct, "similar-distinct")
    labels = component_labels(similar_links(df, rows, text, similarity, width))
    grouped = distinct.join(labels.withColumnRenamed("node", "print"), "print", "left").select(
        "print", "least", F.coalesce("label", "print").alias("group")
    )
    grouped = stored(grouped, "similar-groups")
    least = grouped.groupBy("group").agg(F.min("least").alias("component_id"))
    by_print = grouped.select("print", "group").join(least, "group")
    return rows.select(F.col("key").alias(key), "print").join(by_print, "print").select(
        key, "print", "component_id", "group"
    )


def without_similar(
    df: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, width: int = SHINGLE
) -> DataFrame:
    """One row of each group of similar texts, as ``without_near_duplicates`` chooses it."""
    found = stored(similar_texts(df, key, text, similarity, width), "similar-found")
    return one_row_of_each_group(df, found, body_column, key, text)
