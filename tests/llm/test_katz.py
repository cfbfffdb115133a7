"""The Katz model against a plain one over dictionaries."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from hearthgrid.llm import katz, queries
from hearthgrid.llm.common import prepared

SCHEMA = "doc_id long, text string, held_out boolean, score string"
BEGIN, END = "<begin>", "<end>"


def tokens_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), END]


def plain_discounts(counts):
    n = Counter(counts)
    k = katz.DISCOUNTED
    out = {}
    for c in range(1, k + 1):
        star = (c + 1) * n[c + 1] / n[c] if n[c] else 0
        tail = (k + 1) * n[k + 1] / n[1] if n[1] else 0
        d = (star / c - tail) / (1 - tail) if tail < 1 else 0
        out[c] = d if 0 < d < 1 else (c - 0.5) / c
    return lambda c: out.get(c, 1.0)


class Plain:
    """A bigram Katz model, one token at a time."""

    def __init__(self, texts):
        self.uni, self.bi = Counter(), defaultdict(Counter)
        for text in texts:
            before = BEGIN
            for token in tokens_of(text):
                self.uni[token] += 1
                self.bi[before][token] += 1
                before = token
        self.total = sum(self.uni.values())
        d1 = plain_discounts(self.uni.values())
        self.d2 = plain_discounts([c for f in self.bi.values() for c in f.values()])
        freed = sum((1 - d1(c)) * c for c in self.uni.values())
        total = self.total if freed else self.total + 1
        self.share = {w: d1(c) * c / total for w, c in self.uni.items()}
        self.unknown = (freed or 1) / total if self.total else 1.0

    def unigram(self, token):
        return self.share.get(token, self.unknown)

    def given(self, token, context):
        followers = self.bi.get(context)
        if not followers:
            return self.unigram(token)
        size = sum(followers.values())
        freed = sum((1 - self.d2(c)) * c for c in followers.values())
        if not freed:
            freed, size = 1.0, size + 1
        if token in followers:
            return self.d2(followers[token]) * followers[token] / size
        return freed / size / (1 - sum(self.unigram(w) for w in followers)) * self.unigram(token)

    def score(self, text):
        total, before = 0.0, BEGIN
        for token in tokens_of(text):
            total += math.log10(self.given(token, before))
            before = token
        return total


def expected(rows):
    model = Plain([t for _, t, held in rows if not held])
    types = len(model.uni)
    out = []
    for key, text, held in rows:
        tokens = tokens_of(text)
        base = sum(math.log10((model.uni[t] + 1) / (model.total + types + 1)) for t in tokens)
        known = sum(model.uni[t] > 0 for t in tokens)
        out.append((key, held, len(tokens), known, model.total, base, model.score(text)))
    return sorted(out, key=str)


def check(spark, rows, monkeypatch, **settings):
    for name, value in settings.items():
        monkeypatch.setattr(katz, name, value)
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    found = sorted((tuple(r) for r in katz.scored_texts(df).collect()), key=str)
    wanted = expected(rows)
    assert [f[:5] for f in found] == [w[:5] for w in wanted]
    for f, w in zip(found, wanted, strict=True):
        assert f[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


def corpus(n, seed):
    draw = random.Random(seed)
    words = [f"W{i}é" if i % 7 == 0 else f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        size = draw.randrange(0, 40)
        text = " \n".join(words[min(59, int(draw.expovariate(0.12)))] for _ in range(size))
        rows.append((i, text, i % 7 == 2))
    return rows


@pytest.mark.parametrize("hot", [1, 8, 4096])
def test_scores(spark, monkeypatch, hot):
    rows = corpus(120, hot)
    rows += [(500 + i, "hot hot hot copy of a text", i % 2 == 0) for i in range(40)]
    check(spark, rows, monkeypatch, BLOCK_WORDS=200, BUCKET_TOKENS=300, HOT=hot)


def test_odd_rows(spark, monkeypatch):
    rows = [
        (1, None, False), (2, "", False), (2, "", False), (None, "a A b", False), (4, "a " * 5000, False),
        (5, "unseen words", True), (6, None, True), (7, "a b", True),
    ]
    check(spark, rows, monkeypatch, BLOCK_WORDS=50)


def test_nothing_to_learn_from(spark, monkeypatch):
    check(spark, [(1, "a b", True), (2, None, True)], monkeypatch)


def test_no_rows(spark):
    assert katz.scored_texts(spark.createDataFrame([], SCHEMA)).collect() == []


def test_discounts_stay_between_zero_and_one():
    for n in ([0] * 6, [5, 0, 0, 0, 0, 0], [1, 9, 1, 9, 1, 9], [900, 300, 120, 70, 40, 30]):
        assert all(0 < d <= 1 for d in katz.discounts(n))


def test_probabilities_add_up():
    rows = corpus(80, 3)
    model = Plain([t for _, t, _ in rows])
    for context in [*list(model.bi)[:20], "never"]:
        events = sum(model.given(t, context) for t in model.uni) + model.given("unknown", context)
        assert events == pytest.approx(1)


def test_query(spark, folder):
    prepared(spark)
    rows = [
        (r["doc_id"], r["text"], zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        for r in spark.read.parquet(f"{folder}/documents.parquet").collect()
    ]
    found = sorted((tuple(r) for r in queries.op5_katz(spark, folder).collect()), key=str)
    for f, w in zip(found, expected(rows), strict=True):
        assert f[:5] == w[:5] and f[5:] == pytest.approx(w[5:], rel=1e-9)


def test_null_held_is_trained(spark):
    rows = [(i, "one two three one two", bool(i % 2) if i < 6 else None) for i in range(9)]
    schema = "doc_id long, text string, held_out boolean"
    filled = [(k, t, bool(h)) for k, t, h in rows]
    found = [sorted(map(tuple, katz.scored_texts(spark.createDataFrame(r, schema)).drop("held_out").collect())) for r in (rows, filled)]
    assert found[0] == found[1]
