from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from hearthgrid.llm import prefix_trie
from hearthgrid.llm.prefix_trie import TernaryTree

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_sequences(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            told = f"{len(role.encode())}:{role}{text}".encode()
            own[conv].append((turn is not None, turn or 0, hashlib.sha256(told).digest(), (role, text)))
    return {c: [t[-1] for t in sorted(turns, key=lambda t: t[:3])] for c, turns in own.items()}


def plain_rebuilt(own, group=5, most=9):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        base = c - (abs(c) % group) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def plain_nodes(rebuilt):
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, own in members.items():
        cost = (len(own) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += cost
    rows = []
    for node, own in members.items():
        ends = ",".join(map(str, sorted(c for c in own if tuple(rebuilt[c]) == node)))
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        rows.append((min(own), len(node), parent, len(own), children[node], leaves[node], saved[node], digest))
    return sorted(rows, key=str)


def conversations(seed, n=160):
    """Copies, common first turns, long conversations, odd rows and keys."""
    draw = random.Random(seed)
    rows = []
    for c in range(n):
        kind = draw.randrange(6)
        length = draw.choice([1, 2, 3, 5, 12]) if kind else 40
        turns = [("user", "the same beginning")] if kind < 3 else []
        turns += [(draw.choice(["user", "assistant"]), draw.choice("abcé")) for _ in range(length)]
        if kind == 5:
            turns = [("user", "a copy"), ("assistant", "of one"), ("user", "conversation")]
        rows += [(c * draw.choice([1, 1, 3]), i, *t) for i, t in enumerate(turns)]
    rows += [(None, 0, "user", "no key"), (9001, None, None, None), (9001, 3, "user", ""), (9001, None, "", "x")]
    rows += [(9005, 0, "user", "twice"), (9005, 0, "user", "twice"), (-7, 0, "user", "below zero"), (-5, 1, "a", "b")]
    rows += [(9011, 0, "user", "long " * 30_000), (9016, 0, "user", "long " * 30_000)]
    draw.shuffle(rows)
    return rows


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    sequences = prefix_trie.with_shared_heads(prefix_trie.turn_sequences(df), 5, 9)
    out = prefix_trie.trie_nodes(sequences, **options)
    assert out.columns == NAMES
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("turns", [1, 7, 60, 200_000])
def test_against_all_beginnings(spark, monkeypatch, turns):
    """Trees of a few turns share most of their nodes, and copies, with many others."""
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", turns)
    rows = conversations(turns)
    expected = plain_nodes(plain_rebuilt(plain_sequences(rows)))
    assert found(spark, rows) == expected
    assert any(r[3] > 20 and r[1] for r in expected)


def test_without_shared_heads(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", 3)
    rows = [(c, t, "user", str(t)) for c in range(40) for t in range(1 + c % 4)]
    sequences = prefix_trie.turn_sequences(spark.createDataFrame(rows, SCHEMA))
    got = sorted((tuple(r) for r in prefix_trie.trie_nodes(sequences).collect()), key=str)
    assert got == plain_nodes(plain_sequences(rows))
    # One conversation goes on where the others end: they are no leaves.
    assert [r[5] for r in got] == [1] * 5


def test_turnless_conversations_are_members_of_the_root(spark):
    rows = [(c, 0, "user", "x") for c in (1, 2, 3, 4)]
    got = found(spark, rows)
    # None of these has a first conversation in its group, so heads are dropped.
    assert plain_rebuilt(plain_sequences(rows)) == {1: [], 2: [], 3: [], 4: []}
    assert got == [(1, 0, None, 4, 0, 1, 0, hashlib.sha256(b"1,2,3,4").hexdigest())]


def test_no_rows_and_other_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert found(spark, []) == [] and prefix_trie.turn_sequences(empty).collect() == []
    rows = conversations(3, 30)
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "digest", "size", "turns", "key", "shard"):
        df = df.withColumn(name, F.create_map(F.lit("a"), F.lit(1)))
    got = prefix_trie.trie_nodes(prefix_trie.turn_sequences(df)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_nodes(plain_sequences(rows))


def test_trees_are_balanced():
    sequences = [([i], [1]) for i in range(1 << 10)]
    tree = TernaryTree()
    nodes = tree.insert_sorted(sequences)
    assert [tree.turn[n] for n in nodes] == list(range(1 << 10))

    def height(node):
        return 0 if node < 0 else 1 + max(height(tree.low[node]), height(tree.high[node]))

    assert height(tree.below[0]) <= 11


def test_rows_of_a_hot_conversation_are_spread(spark):
    """The range shuffle deals copies of one conversation by their keys."""
    df = spark.range(4000).selectExpr("id AS conv_id", "0L AS turn", "'user' AS role", "'same' AS text")
    sequences = prefix_trie.turn_sequences(df)
    rows = sequences.select("turns.id", "conv_id").repartitionByRange(4, "id", "conv_id")
    sizes = [r[1] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2000
