from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest

from hearthgrid.llm import mixing
from tests.llm.helpers import ODD_ROWS, as_rows, bag, documents, sentences, words


def plain_targets(sizes):
    """Excess over twice a source's size is dealt out again until there is none."""
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [None] * (None in sizes)
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    left, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [n for n in names if n not in capped]
        level = left / sum(weight[n] for n in free) if free else 0
        over = [n for n in free if level * weight[n] > 2 * sizes[n] + 1e-9]
        if not over:
            return {**{n: level * weight[n] for n in free}, **capped}
        for n in over:
            capped[n] = 2.0 * sizes[n]
            left -= capped[n]


def plain_mix(rows, bits=60):
    sizes = defaultdict(int)
    docs = [(r[0], r[3], len(words(r[1]))) for r in rows]
    for _, source, size in docs:
        sizes[source] += size
    targets = plain_targets(sizes)
    out = []
    for source, total in sizes.items():
        own = defaultdict(list)
        for key, s, size in docs:
            if s == source:
                text = "null" if key is None else str(key)
                own[int(hashlib.md5(text.encode()).hexdigest()[:15], 16) >> (60 - bits)].append((key, size))
        whole = int(targets[source] // total) if total else 0
        rest = targets[source] - whole * total
        best, upto, threshold = abs(rest), 0, -1
        for h in sorted(own):
            upto += sum(size for _, size in own[h])
            if abs(upto - rest) < best:
                best, threshold = abs(upto - rest), h
        for h, members in own.items():
            copies = min(2, whole + (h <= threshold))
            out += [(key, source, size, total, targets[source], size * copies) for key, size in members]
    return sorted(out, key=str)


def check(spark, rows, bits=60):
    mixed = mixing.with_mix(documents(spark, rows), hash_bits=bits)
    found = bag(mixed.select("doc_id", "source", "size", "source_size", "target", "taken"))
    for ours, theirs in zip(found, plain_mix(rows, bits), strict=True):
        assert ours == (*theirs[:4], pytest.approx(theirs[4]), theirs[5])


def hot_rows(n=300, seed=4):
    texts = sentences(n, seed, low=1, high=50)
    return [(i, t, "en", "hot" if i % 3 == 0 else f"s{i % 11}" if i % 10 else None, 0) for i, t in enumerate(texts)]


@pytest.mark.parametrize("bits", [60, 3])
def test_against_a_plain_mix(spark, monkeypatch, bits):
    monkeypatch.setattr(mixing, "LEVEL_BITS", 2 if bits == 3 else 5)
    check(spark, hot_rows(), bits)


def test_odd_rows(spark):
    check(spark, ODD_ROWS)
    check(spark, [r for r in ODD_ROWS if r[0] in (9001, 9002, 9003)])
    df = documents(spark, extra=["size", "hash", "key", "target", "whole", "row"])
    again = mixing.with_mix(df)
    assert bag(again) == bag(mixing.with_mix(documents(spark)))
    assert mixing.with_mix(df.limit(0)).collect() == []
    repeated = mixing.repeated_by_mix(df)
    assert repeated.columns == df.columns
    assert mixing.repeated_by_mix(df.limit(0)).collect() == []


def test_sources_by_code_point(spark):
    names = ["z", "é", "Z", "\U0001d4b3", "ｚ", "", None]
    rows = [(i, t, "en", names[i % len(names)], 0) for i, t in enumerate(sentences(90, 3))]
    check(spark, rows)


def test_rows_repeat_as_the_mix_says(spark):
    rows = hot_rows(120)
    df = documents(spark, rows)
    taken = {(r["doc_id"], r["source"]): r["copies"] for r in mixing.with_mix(df).collect()}
    assert set(taken.values()) == {0, 1, 2} or len(set(taken.values())) > 1
    expected = [r for r in rows for _ in range(taken[r[0], r[3]])]
    assert bag(mixing.repeated_by_mix(df)) == sorted(expected, key=str)


def test_taken_words_come_near_their_targets(spark):
    rows = as_rows(sentences(400, 9))
    mixed = mixing.with_mix(documents(spark, rows)).collect()
    largest = max(r["size"] for r in mixed)
    for source in {r["source"] for r in mixed}:
        own = [r for r in mixed if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= largest
        assert all(r["taken"] <= 2 * r["size"] for r in own)
