"""The trie of what conversations begin with, by ternary search trees over range shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthgrid.llm.common import stored

# Turns and conversations after which a task begins a new tree.
SHARD_TURNS = 200_000
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_sequences(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """``key`` and its ``turns``: an array of ``id`` and ``size`` in the order of ``turn``.

    The id stands for role and text in a dictionary of distinct turns, numbered over the
    whole table; the size is that of the text in bytes of UTF-8. Null turns come first, turns
    of the same number are ordered by their digest. A null role or text is empty, rows
    without a key are left out, repeated rows are turns of their own. Turns are told apart
    by SHA-256 of role and text, so only digests are shuffled, and a turn that many rows
    share is one entry.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    told = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = df.where(F.col(key).isNotNull()).select(
        F.col(key).alias("key"), "turn", F.unhex(F.sha2(told, 256)).alias("digest"), F.octet_length(text).alias("size")
    )
    turns = stored(turns, "trie-turns")
    dictionary = stored(
        turns.groupBy("digest").agg(F.max("size").alias("size")).withColumn("id", F.monotonically_increasing_id()),
        "trie-dictionary",
    )
    coded = turns.drop("size").join(dictionary, "digest")
    ordered = F.sort_array(F.collect_list(F.struct("turn", "digest", "id", "size")))
    sequences = coded.groupBy("key").agg(
        F.transform(ordered, lambda t: F.struct(t["id"].alias("id"), t["size"].alias("size"))).alias("turns")
    )
    return sequences.withColumnRenamed("key", key)


def with_shared_heads(sequences: DataFrame, group: int, most: int, key: str = "conv_id") -> DataFrame:
    """``sequences`` whose first turns come from the first conversation of their group.

    Conversation c gets the first h turns of conversation c - c % group (fewer if it has
    fewer, none if there is none), then its own turns after its first h; h is crc32 of the
    decimal c, modulo ``most``. A conversation may end up without turns.
    """
    sequences = stored(sequences, "trie-sequences")
    heads = sequences.where(F.col(key) % group == 0).select(
        F.col(key).alias("__base"), F.slice("turns", 1, most).alias("__head")
    )
    rows = sequences.withColumn("__base", F.col(key) - F.col(key) % group).join(heads, "__base", "left")
    taken = (F.crc32(F.col(key).cast("string").cast("binary")) % most).cast("int")
    head = F.coalesce(F.slice("__head", F.lit(1), taken), F.slice("turns", 1, 0))
    own = F.slice("turns", taken + 1, F.size("turns"))
    return rows.select(key, F.concat(head, own).alias("turns"))


class TernaryTree:
    """A trie whose nodes keep their children in binary search trees.

    Node 0 is the root. A node has a turn, the nodes of smaller and larger turns beside it
    (``low``, ``high``) and the first of the nodes below it (``below``). Nodes come after
    their parents, so sums go up in one walk backwards.
    """

    def __init__(self) -> None:
        self.turn, self.low, self.high, self.below = [-1], [-1], [-1], [-1]
        self.parent, self.depth, self.size = [-1], [0], [0]

    def _node(self, turn: int, size: int, parent: int) -> int:
        self.turn.append(turn)
        self.low.append(-1)
        self.high.append(-1)
        self.below.append(-1)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.size.append(size)
        return len(self.turn) - 1

    def insert(self, turns: Sequence[int], sizes: Sequence[int]) -> int:
        """The node of a sequence."""
        turn_of, low, high, below = self.turn, self.low, self.high, self.below
        node = 0
        for turn, size in zip(turns, sizes, strict=True):
            at = below[node]
            if at < 0:
                at = below[node] = self._node(turn, size, node)
            while turn_of[at] != turn:
                side = low if turn < turn_of[at] else high
                if side[at] < 0:
                    side[at] = self._node(turn, size, node)
                at = side[at]
            node = at
        return node

    def insert_sorted(self, sequences: Sequence[tuple[Sequence[int], Sequence[int]]]) -> list[int]:
        """The nodes of sequences in ascending order; the middle one goes in first, then those
        of both halves, so that the search trees are balanced."""
        nodes = [0] * len(sequences)
        spans = [(0, len(sequences))]
        while spans:
            a, b = spans.pop()
            if a < b:
                middle = (a + b) // 2
                nodes[middle] = self.insert(*sequences[middle])
                spans += [(a, middle), (middle + 1, b)]
        return nodes

    def path(self, node: int) -> list[int]:
        """From the root to the node."""
        out = []
        while node >= 0:
            out.append(node)
            node = self.parent[node]
        return out[::-1]


_NODES = (
    "conv_id long, depth long, parent_conv_id long, parent_key binary, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string, key binary, size long, shard long, "
    "first boolean, last boolean, end boolean, ends string"
)
_NAMES = [part.split()[0] for part in _NODES.split(", ")]


def _shard_rows(shard: int, groups: list[tuple[list[int], list[int], list[int]]]) -> pa.RecordBatch:
    """One row for each node of a shard's tree; ``groups`` has turns, sizes and keys of each
    distinct sequence, in ascending order.

    Only nodes on the paths of the first and the last sequence can be in other shards too.
    These are told apart by a digest of their turns and carry what merging needs.
    """
    tree = TernaryTree()
    nodes = tree.insert_sorted([(turns, sizes) for turns, sizes, _ in groups])
    n = len(tree.turn)
    members, children, leaves, saved = [0] * n, [0] * n, [0] * n, [0] * n
    least: list[int | None] = [None] * n
    ends: dict[int, list[int]] = {}
    for node, (_, _, keys) in zip(nodes, groups, strict=True):
        ends[node] = keys
        members[node], least[node] = len(keys), keys[0]
    parent, size = tree.parent, tree.size
    for node in range(n - 1, -1, -1):
        leaves[node] += not children[node]
        saved[node] += (members[node] - 1) * size[node]
        if (up := parent[node]) >= 0:
            members[up] += members[node]
            children[up] += 1
            leaves[up] += leaves[node]
            saved[up] += saved[node]
            if least[up] is None or least[node] < least[up]:
                least[up] = least[node]

    first, last = tree.path(nodes[0]), tree.path(nodes[-1])
    on_first, on_last = set(first), set(last)
    keys: dict[int, bytes] = {}
    for path in (first, last):
        key = b""
        for node in path:
            key = hashlib.sha256(key + tree.turn[node].to_bytes(8, "little", signed=True)).digest()
            keys[node] = key
    said = {node: ",".join(map(str, own)) for node, own in ends.items()}
    shared = [node in keys for node in range(n)]
    up_key = [keys.get(up) for up in parent]
    columns = [
        pa.array(least, pa.int64()),
        pa.array(tree.depth, pa.int64()),
        pa.array([None if up < 0 or shared[up] else least[up] for up in parent], pa.int64()),
        pa.array(up_key, pa.binary()),
        pa.array(members, pa.int64()),
        pa.array(children, pa.int64()),
        pa.array(leaves, pa.int64()),
        pa.array(saved, pa.int64()),
        pa.array([hashlib.sha256(said[i].encode()).hexdigest() if i in said else _NO_ENDS for i in range(n)]),
        pa.array([keys.get(i) for i in range(n)], pa.binary()),
        pa.array(size, pa.int64()),
        pa.array([shard] * n, pa.int64()),
        pa.array([i in on_first for i in range(n)]),
        pa.array([i in on_last for i in range(n)]),
        pa.array([i == last[-1] for i in range(n)]),
        pa.array([said.get(i, "") if shared[i] else None for i in range(n)], pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=_NAMES)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trees over the sorted sequences of a partition, a new one after so many turns."""
    shard = TaskContext.get().partitionId() << 32
    groups: list[tuple[list[int], list[int], list[int]]] = []
    held = 0
    for batch in batches:
        for ids, sizes, key in zip(*(batch[c].to_pylist() for c in ("ids", "sizes", "key")), strict=True):
            if held >= SHARD_TURNS:
                yield _shard_rows(shard, groups)
                shard, groups, held = shard + 1, [], 0
            if not groups or groups[-1][0] != ids:
                groups.append((ids, sizes, []))
                held += len(ids)
            groups[-1][2].append(key)
            held += 1
    if groups:
        yield _shard_rows(shard, groups)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined parts of each key, which come one after the other."""
    key, digest = None, None
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for own, ends in zip(batch["key"].to_pylist(), batch["ends"].to_pylist(), strict=True):
            if own != key:
                if digest is not None:
                    done.append((key, digest.hexdigest()))
                key, digest = own, hashlib.sha256(ends.encode())
            else:
                digest.update(b"," + ends.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done])], names=["key", "digest"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], names=["key", "digest"])


def _merged(nodes: DataFrame) -> DataFrame:
    """The nodes that several shards may have, each once.

    Shards are ranges, so a shared node is in one shard after the other, on the path of the
    last sequence of one and of the first of the next. Members add up. A child that an
    earlier shard has too is no further child and its text is no further first copy; a leaf
    that a later shard has too is counted there. What this changes in the sums above is known
    from the shard's own two paths.
    """
    edge = nodes.where(F.col("key").isNotNull())
    span = edge.groupBy("key").agg(F.min("shard").alias("lowest"), F.max("shard").alias("highest"))
    again, later = F.col("shard") > F.col("lowest"), F.col("shard") < F.col("highest")
    upward = Window.partitionBy("shard", "first").orderBy(F.desc("depth"))
    below = upward.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = edge.join(span, "key").select(
        "*",
        F.sum(F.when(F.col("first") & again, F.col("size")).otherwise(0)).over(below).alias("copied"),
        F.coalesce(F.lag(F.col("first") & again).over(upward), F.lit(False)).alias("child_again"),
        F.max(F.col("end") & later).over(Window.partitionBy("shard")).alias("goes_on"),
    )
    totals = edge.groupBy("key").agg(
        F.first("parent_key").alias("parent_key"),
        F.min("conv_id").alias("conv_id"),
        F.min("depth").alias("depth"),
        F.sum("n_convs").alias("n_convs"),
        F.sum(F.col("n_children") - F.col("child_again").cast("long")).alias("n_children"),
        F.sum(F.col("n_leaves") - (F.col("last") & F.col("goes_on")).cast("long")).alias("n_leaves"),
        F.sum(F.col("saved_tokens") + F.col("copied")).alias("saved_tokens"),
    )
    ends = nodes.where("ends <> ''").select("key", "shard", "ends").repartition("key").sortWithinPartitions("key", "shard")
    digests = ends.mapInArrow(_digests, "key binary, digest string")
    return totals.join(digests, "key", "left").withColumn("ends_sha256", F.coalesce("digest", F.lit(_NO_ENDS)))


def trie_nodes(sequences: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row for each distinct beginning of the ``turns`` of ``sequences``, the empty one
    included.

    ``conv_id`` is the smallest key of those that begin so (the members, ``n_convs``),
    ``depth`` the number of turns, ``parent_conv_id`` that of the beginning one turn shorter
    (null at the root), ``n_children`` the beginnings one turn longer, ``n_leaves`` those
    without a longer one in the subtree, itself included, ``saved_tokens`` the bytes of
    repeated last texts in the subtree, ``ends_sha256`` the digest of the keys that end here.
    No sequences have no nodes.

    Sequences are sorted by their turns and then their keys, in ranges: copies of one
    conversation, or of one first turn, are spread over as many tasks as they need. Each task
    builds ternary search trees of bounded size, one after the other. Only nodes on the
    first and last path of a tree, twice its depth, are merged with those of other trees. One
    conversation is a row, its ids and sizes in one task. The digest of the keys that end at
    one node is a single hash over all of them: it is made in one pass over sorted parts, in
    constant memory.
    """
    rows = sequences.select(
        F.col("turns.id").alias("ids"), F.col("turns.size").cast("array<long>").alias("sizes"), F.col(key).alias("key")
    )
    rows = stored(rows, "trie-rows").repartitionByRange("ids", "key").sortWithinPartitions("ids", "key")
    nodes = stored(rows.mapInArrow(_shards, _NODES), "trie-nodes")
    merged = stored(_merged(nodes), "trie-merged")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    inner = nodes.where(F.col("key").isNull())
    below = inner.where(F.col("parent_key").isNotNull()).drop("parent_conv_id").join(parents, "parent_key")
    return (
        inner.where(F.col("parent_key").isNull()).select(*out)
        .unionByName(below.select(*out))
        .unionByName(merged.join(parents, "parent_key", "left").select(*out))
    )
