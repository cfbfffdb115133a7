"""Groups of near copies: SimHash proposes the pairs, exact Jaccard similarity decides."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthgrid.llm.common import stored
from hearthgrid.llm.components import component_labels
from hearthgrid.llm.similar import SHINGLE, SIMILARITY, _sets, bodies, body_column, shingle_sets, verified
from hearthgrid.llm.simhash import one_row_of_each_group
from hearthgrid.llm.words import SMALL_SLICE, mix, slices

# Longs of a fingerprint, and the bits in which fingerprints of a pair may differ. Each bit of
# two sets of similarity 0.8 differs with a probability of about 0.15: 19 of 128, with a
# deviation of 4. Those of unrelated sets differ in 64, with a deviation of 5.7.
PRINT_LONGS = 2
RADIUS = 44
# Bits of a text's parity map at least; larger sets have a bit for each shingle or more.
MAP_BITS_LEAST = 512
# Rounds in which a text meets one other of each block at most, before all pairs that are left.
ROUNDS = 2
# Rows of a block of one side, and of the other; a block ends at so many bytes of maps and
# shingles as well.
TILE_ROWS = 32_768
OTHER_ROWS = 65_536
BLOCK_BYTES = 1 << 24
# Rows of a file of blocks, about.
FILE_ROWS = 1 << 17
# Rows and columns of one step of a comparison.
STEP_ROWS = 32
STEP_COLUMNS = 8192
# Sets that are held against another at once.
SETS_AT_ONCE = 64
# Shingles whose bits are laid out at once.
VOTE_ROWS = 1 << 13


def set_fingerprints(doc: np.ndarray, hashes: np.ndarray, n: int, longs: int = PRINT_LONGS) -> np.ndarray:
    """SimHash of ``n`` sets: a bit is 1 if more than half of the set's hashes have it.

    ``doc`` is the set of each hash, in ascending order. An empty set has zeros.
    """
    votes = np.zeros((n, 64 * longs), np.int64)
    for begin in range(0, len(doc), VOTE_ROWS):
        own, part = doc[begin : begin + VOTE_ROWS], hashes[begin : begin + VOTE_ROWS]
        salted = np.stack([mix(part + np.uint64(i)) for i in range(longs)], axis=1)
        bits = np.unpackbits(salted.view(np.uint8), axis=1, bitorder="little")
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        votes[own[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int16)
    sizes = np.bincount(doc, minlength=n)
    return np.packbits(votes * 2 > sizes[:, None], axis=1, bitorder="little").view(np.uint64)


def map_bits(sizes: np.ndarray) -> np.ndarray:
    """Bits of the parity map of sets of these sizes: a power of two."""
    larger = 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)
    return np.maximum(larger, MAP_BITS_LEAST)


def parity_maps(doc: np.ndarray, hashes: np.ndarray, n: int) -> list[bytes]:
    """A bit tells whether an odd number of the set's hashes have it as their last digits: two
    maps of one length differ in no more bits than the sets in hashes.

    The length follows the size, as a map of fewer bits than shingles rules nothing out. A map
    whose halves are joined by exclusive-or is the map of half the length.
    """
    width = map_bits(np.bincount(doc, minlength=n))
    ends = np.cumsum(width)
    bit = (hashes % width.astype(np.uint64)[doc]).astype(np.int64)
    odd = np.bincount((ends - width)[doc] + bit, minlength=int(ends[-1]) if n else 0) & 1
    octets = np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()
    return [octets[(e - w) // 8 : e // 8] for e, w in zip(ends.tolist(), width.tolist(), strict=True)]


def _folded(maps: np.ndarray, longs: int) -> np.ndarray:
    """Maps, a row each, at a length of ``longs``."""
    return np.bitwise_xor.reduce(maps.reshape(len(maps), -1, longs), axis=1)


def differing_bits(own: dict, i: int, other: dict, j: np.ndarray) -> np.ndarray:
    """Bits in which the map of row ``i`` and those of the rows ``j`` differ, at the length of
    the shorter one."""
    mine = own["bits"][own["at"][i] : own["at"][i + 1]][None, :]
    sizes = other["at"][j + 1] - other["at"][j]
    found = np.zeros(len(j), np.int64)
    for longs in np.unique(sizes).tolist():
        some = np.flatnonzero(sizes == longs)
        maps = other["bits"][other["at"][j[some]][:, None] + np.arange(longs)]
        short = min(longs, mine.shape[1])
        found[some] = np.bitwise_count(_folded(mine, short) ^ _folded(maps, short)).sum(axis=1, dtype=np.int64)
    return found


def _joined(values: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in values], pa.binary())


def text_prints(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """``key``, ``print`` of the words, number ``n`` of distinct shingles, ``code`` (their
    SimHash) and ``bits`` (their parity map) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            for a, b in slices(texts, SMALL_SLICE):
                doc, hashes = shingle_sets(texts[a:b], width)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["key"].slice(a, b - a),
                        pa.array(bodies(texts[a:b]), pa.binary()),
                        pa.array(np.bincount(doc, minlength=b - a)),
                        _joined(set_fingerprints(doc, hashes, b - a)),
                        pa.array(parity_maps(doc, hashes, b - a), pa.binary()),
                    ],
                    names=["key", "print", "n", "code", "bits"],
                )

    kind = df.select(F.col(key).alias("key")).schema["key"].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, print binary, n long, code binary, bits binary")


def _counts(own: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    """Differing bits of each row and each code, whose longs are a column each."""
    differing = np.empty((len(own), len(columns[0])), np.uint64)
    counts = np.zeros(differing.shape, np.uint8)
    for i, column in enumerate(columns):
        counts += np.bitwise_count(np.bitwise_xor(own[:, i, None], column, out=differing))
    return counts


def block_pairs(own: dict, other: dict, radius: int, similarity: float, all_pairs: bool, turn: int) -> Iterator[tuple]:
    """Positions in ``own`` and ``other`` of pairs that may be as similar as asked.

    Their codes differ in ``radius`` bits at most, and neither their sizes nor their parity
    maps rule the similarity out; the second is the one of the larger size (of equal ones, of
    the larger print). Pairs of one label are left out. Unless all pairs are wanted, each row
    of a side that has a pair gets the one whose hash is the least.
    """
    by_size = np.argsort(other["n"], kind="stable")
    sizes, codes = other["n"][by_size], [c[by_size] for c in other["code"].T]
    share = (1 - similarity) / (1 + similarity)
    place, hashes = [mix(s["print"][:, 0] + np.uint64(turn)) for s in (own, other)]
    least = np.full(len(hashes), np.iinfo(np.uint64).max)
    best = np.full(len(hashes), -1)
    order = np.argsort(own["n"], kind="stable")
    for begin in range(0, len(order), STEP_ROWS):
        some = order[begin : begin + STEP_ROWS]
        first = int(np.searchsorted(sizes, own["n"][some[0]]))
        last = int(np.searchsorted(sizes, own["n"][some[-1]] / similarity + 1e-6, "right"))
        found: dict[int, list] = {}
        for column in range(first, last, STEP_COLUMNS):
            part = [c[column : min(column + STEP_COLUMNS, last)] for c in codes]
            near = _counts(own["code"][some], part) <= radius
            for r in np.flatnonzero(near.any(axis=1)):
                found.setdefault(int(r), []).append(by_size[column + np.flatnonzero(near[r])])
        for r, parts in found.items():
            i, j = some[r], np.concatenate(parts)
            n, m = own["n"][i], other["n"][j]
            a, b = own["print"][i], other["print"][j]
            later = (b[:, 0] > a[0]) | ((b[:, 0] == a[0]) & (b[:, 1] > a[1]))
            kept = (other["label"][j] != own["label"][i]) & ((m > n) | ((m == n) & later)) & (n >= similarity * m - 1e-9)
            j = j[kept]
            j = j[differing_bits(own, i, other, j) <= (n + other["n"][j]) * share + 1e-6]
            if all_pairs:
                yield np.full(len(j), i), j
            elif len(j):
                yield np.array([i]), j[[np.argmin(hashes[j])]]
                less = j[place[i] < least[j]]
                least[less], best[less] = place[i], i
    chosen = np.flatnonzero(best >= 0)
    yield best[chosen], chosen


def similar_pairs(found: Iterator[tuple], own: dict, other: dict, similarity: float) -> Iterator[tuple]:
    """Those of the pairs found whose sets are as similar as asked, one row and another.

    Labels that a pair has linked are one from then on, and pairs of one label are left out:
    there are fewer pairs than labels, and they connect what all of them would.
    """
    above: dict[int, int] = {}

    def top(label: int) -> int:
        passed = []
        while label in above:
            passed.append(label)
            label = above[label]
        above.update(dict.fromkeys(passed, label))
        return label

    def sets(side: dict, rows: np.ndarray) -> np.ndarray:
        places = [np.arange(side["set"][r], side["set"][r + 1]) for r in rows.tolist()]
        return side["shingles"][np.concatenate(places)]

    for i, j in found:
        for begin in range(0, len(j), SETS_AT_ONCE):
            label = top(int(own["label"][i[0]]))
            some = j[begin : begin + SETS_AT_ONCE]
            some = some[[top(x) != label for x in other["label"][some].tolist()]]
            if not len(some):
                continue
            mine, theirs, sizes = sets(own, i[:1]), sets(other, some), other["n"][some]
            at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
            common = np.add.reduceat(mine[at] == theirs, np.cumsum(sizes) - sizes, dtype=np.int64)
            near = common >= similarity * (len(mine) + sizes - common) - 1e-9
            for k in some[near].tolist():
                one = top(int(other["label"][k]))
                if one != label:
                    above[one] = label
                    yield i[:1], np.array([k])


def side_of(columns: dict[str, object]) -> dict:
    """The rows of a block, from its columns of joined values."""
    side = {name: np.frombuffer(columns[name], np.uint64) for name in columns if name not in ("label", "n")}
    side |= {name: np.frombuffer(columns[name], np.int64) for name in ("label", "n")}
    side["print"] = side["print"].reshape(-1, 2)
    side["code"] = side["code"].reshape(len(side["n"]), -1)
    side["at"] = np.concatenate([[0], np.cumsum(map_bits(side["n"]) // 64)])
    side["set"] = np.concatenate([[0], np.cumsum(side["n"])])
    return side


def size_blocks(rows: DataFrame, tile_rows: int, other_rows: int) -> DataFrame:
    """Rows in blocks of like size ``n``: a row each, with joined columns, the least and the
    largest size. All rows are in blocks of both sides, told by ``own``."""
    names = [c for c in ("print", "label", "n", "code", "bits", "shingles") if c in rows.columns]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(parts: list[pa.RecordBatch], own: bool) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts)
            n = table["n"].to_numpy()
            values = {"low": n.min(), "high": n.max(), "own": own}
            values |= {name: table[name].to_numpy().tobytes() for name in ("label", "n")}
            values |= {name: b"".join(table[name].to_pylist()) for name in ("print", "code", "bits")}
            if "shingles" in names:
                values["shingles"] = table["shingles"].combine_chunks().flatten().to_numpy().tobytes()
            return pa.RecordBatch.from_pylist([values], schema)

        kinds = {"low": pa.int64(), "high": pa.int64(), **dict.fromkeys(names, pa.binary()), "own": pa.bool_()}
        schema = pa.schema(list(kinds.items()))
        held: dict[bool, list] = {True: [], False: []}
        for batch in batches:
            for own, limit in ((True, tile_rows), (False, other_rows)):
                begin = 0
                while begin < batch.num_rows:
                    part = batch.slice(begin, limit - sum(p.num_rows for p in held[own]))
                    held[own].append(part)
                    begin += part.num_rows
                    full = sum(p.num_rows for p in held[own]) == limit
                    if full or sum(p[c].nbytes for p in held[own] for c in names[4:]) >= BLOCK_BYTES:
                        yield block(held[own], own)
                        held[own] = []
        for own, parts in held.items():
            if parts:
                yield block(parts, own)

    files = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // FILE_ROWS))
    sorted_ = rows.select(*names).repartitionByRange(files, "n", "print").coalesce(files).sortWithinPartitions("n")
    joined = ", ".join(f"{name} binary" for name in names)
    return sorted_.mapInArrow(pack, f"low long, high long, {joined}, own boolean")


@contextmanager
def _batches(spark: SparkSession, **limits: int) -> Iterator[None]:
    """What a Python worker gets at once, for tables that are stored meanwhile."""
    limits = {f"spark.sql.execution.arrow.{name}": value for name, value in limits.items()}
    before = {name: spark.conf.get(name, None) for name in limits}
    for name, value in limits.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def _stored_pairs(pairs: DataFrame, label: str) -> DataFrame:
    """Stored; a Python worker gets one pair of blocks at once."""
    with _batches(pairs.sparkSession, maxRecordsPerBatch=1):
        return stored(pairs, label)


def near_pairs(
    rows: DataFrame, radius: int, similarity: float, all_pairs: bool, turn: int,
    tile_rows: int = TILE_ROWS, other_rows: int = OTHER_ROWS,
) -> DataFrame:
    """Pairs ``a``, ``b`` of prints by :func:`block_pairs`, from rows of one print each. Rows
    that have their ``shingles`` decide on their pairs at once (:func:`similar_pairs`).

    Blocks of like sizes are stored once for either side. Tasks read pairs of files of blocks,
    a Cartesian product, and compare each block with those whose sizes allow the similarity:
    however many blocks a block meets, it is neither copied nor shuffled for that.
    """
    with _batches(rows.sparkSession, maxBytesPerBatch=BLOCK_BYTES):
        blocks = stored(size_blocks(rows, tile_rows, other_rows), "near-blocks", "own")
    own = blocks.where("own").drop("own")
    other = blocks.where("not own").select(*[F.col(c).alias(f"other_{c}") for c in own.columns])
    meets = (F.col("other_high") >= F.col("low")) & (F.col("other_low") <= F.col("high") / similarity + 1e-6)
    met = own.join(other.hint("shuffle_replicate_nl"), meets)
    names = [c for c in own.columns if c not in ("low", "high")]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                mine, others = (
                    side_of({name: batch[prefix + name][row].as_buffer() for name in names}) for prefix in ("", "other_")
                )
                pairs = block_pairs(mine, others, radius, similarity, all_pairs, turn)
                if "shingles" in names:
                    pairs = similar_pairs(pairs, mine, others, similarity)
                found, size = [], 0
                for i, j in pairs:
                    found.append((i, j))
                    size += len(i)
                    if size >= 1 << 16:
                        yield batch_of(found, mine, others)
                        found, size = [], 0
                yield batch_of(found, mine, others)

    def batch_of(found: list[tuple], mine: dict, others: dict) -> pa.RecordBatch:
        i, j = (np.concatenate([np.asarray(p[k], np.int64) for p in found] or [np.empty(0, np.int64)]) for k in (0, 1))
        return pa.RecordBatch.from_arrays([_joined(mine["print"][i]), _joined(others["print"][j])], names=["a", "b"])

    return met.mapInArrow(compare, "a binary, b binary").distinct()


def near_copies(
    df: DataFrame, key: str = "doc_id", text: str = "text",
    similarity: float = SIMILARITY, width: int = SHINGLE, radius: int = RADIUS,
) -> DataFrame:
    """``key``, ``print`` (of the text's words), ``component_id`` and ``group`` of every row.

    Two texts are linked if the SimHash codes of their distinct runs of ``width`` words differ
    in at most ``radius`` bits and the Jaccard similarity of these runs is at least
    ``similarity``. All pairs of codes whose sizes allow it are compared. Texts of the same
    words, letter case aside, are one; those without words are alike. The component is the
    smallest key that links reach.

    In the first rounds a text meets one other text for each block it is in, so a large group
    of near copies is connected by as many pairs as it has members. Texts that met none have
    no pair and are not looked at again; the last round makes all pairs that are left, from
    blocks that have the sets as well, so no pair of it takes a set through a shuffle.
    """
    prints = stored(text_prints(df, key, text, width), "near-prints")
    distinct = prints.groupBy("print").agg(
        F.min("key").alias("least"), F.first(F.struct("n", "code", "bits")).alias("set")
    )
    distinct = stored(distinct.select("print", "least", "set.*"), "near-distinct")
    rows = distinct.where("n > 0").drop("least").withColumn("label", F.xxhash64("print"))
    links = None
    for turn in range(ROUNDS + 1):
        if turn == ROUNDS:
            rows = stored(rows.join(_sets(df, text, width, rows.select("print")), "print"), "near-sets")
            found = _stored_pairs(near_pairs(rows, radius, similarity, True, turn), "near-links")
        else:
            met = _stored_pairs(near_pairs(rows, radius, similarity, False, turn), "near-pairs")
            wanted = stored(met.select(F.col("a").alias("print")).union(met.select("b")).distinct(), "near-wanted")
            found = stored(verified(df, met, wanted, text, similarity, width), "near-links")
        links = found if links is None else links.unionByName(found)
        if turn == ROUNDS or wanted.isEmpty():
            break
        labels = component_labels(links).select(F.col("node").alias("print"), F.xxhash64("label").alias("new"))
        rows = rows.join(wanted, "print", "left_semi").join(labels, "print", "left")
        rows = stored(rows.withColumn("label", F.coalesce("new", "label")).drop("new"), "near-rows")
    labels = component_labels(links)
    grouped = distinct.join(labels.withColumnRenamed("node", "print"), "print", "left").select(
        "print", "least", F.coalesce("label", "print").alias("group")
    )
    grouped = stored(grouped, "near-groups")
    least = grouped.groupBy("group").agg(F.min("least").alias("component_id"))
    by_print = grouped.select("print", "group").join(least, "group")
    return prints.select(F.col("key").alias(key), "print").join(by_print, "print").select(
        key, "print", "component_id", "group"
    )


def without_near_copies(
    df: DataFrame, key: str = "doc_id", text: str = "text",
    similarity: float = SIMILARITY, width: int = SHINGLE, radius: int = RADIUS,
) -> DataFrame:
    """One row of each group of near copies, as ``without_near_duplicates`` chooses it."""
    found = stored(near_copies(df, key, text, similarity, width, radius), "near-found")
    return one_row_of_each_group(df, found, body_column, key, text)
