from __future__ import annotations

import hashlib
from collections import Counter

import pytest

from hearthgrid.llm import sharding
from tests.llm.helpers import ODD_ROWS, bag, documents


def number(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def plain_table(shards, size):
    """Shards take turns; each claims the first free slot in its own order."""
    owner = [None] * size
    cursor = dict.fromkeys(shards, 0)
    order = {s: (number(f"{s}#start") % size, number(f"{s}#step") % (size - 1) + 1) for s in shards}
    for turn in range(size):
        shard = shards[turn % len(shards)]
        start, step = order[shard]
        while owner[(start + cursor[shard] * step) % size] is not None:
            cursor[shard] += 1
        owner[(start + cursor[shard] * step) % size] = shard
    return owner


@pytest.mark.parametrize("n, size", [(1, 7), (3, 31), (5, 5), (8, 211)])
def test_table(spark, n, size):
    shards = [f"s{i}" for i in range(n)]
    table = sharding.shard_table(spark, shards, size).orderBy("slot").collect()
    assert [r["slot"] for r in table] == list(range(size))
    owner = [r["shard"] for r in table]
    assert owner == plain_table(shards, size)
    shares = Counter(owner).values()
    assert max(shares) - min(shares) <= 1


def test_the_standard_table(spark):
    owner = [r["shard"] for r in sharding.shard_table(spark).orderBy("slot").collect()]
    assert owner == plain_table(list(sharding.SHARDS), sharding.TABLE_SIZE)


def test_a_lost_shard_moves_few_slots():
    shards = [f"s{i}" for i in range(8)]
    before, after = plain_table(shards, 2053), plain_table(shards[:-1], 2053)
    kept = [b == a for b, a in zip(before, after, strict=True) if b != "s7"]
    assert sum(kept) / len(kept) > 0.8


def test_tables_that_cannot_be(spark):
    for shards, size in ((["a"], 9), (["a", "a"], 7), ([], 7), (list("abcdefgh"), 7)):
        with pytest.raises(ValueError):
            sharding.shard_table(spark, shards, size)


def test_rows(spark):
    shards = ["a", "b", "c"]
    df = documents(spark, extra=["shard", "owner", "start"])
    placed = sharding.with_shards(df, "doc_id", shards, 101)
    assert placed.columns == [c for c in df.columns if c != "shard"] + ["slot", "shard"]
    owner = plain_table(shards, 101)
    expected = []
    for row in ODD_ROWS:
        slot = number("null" if row[0] is None else str(row[0])) % 101
        expected.append((*row, "other", "other", slot, owner[slot]))
    assert bag(placed) == sorted(expected, key=str)
    assert sharding.with_shards(df.limit(0), "doc_id", shards, 101).collect() == []


def test_the_plan_has_no_python_and_no_shuffle_of_rows(spark):
    df = documents(spark)
    plan = sharding.with_shards(df, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "Arrow" not in plan
    assert plan.count("Exchange hashpartitioning") <= 1
