from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
import pytest

from hearthgrid.llm import similar
from tests.llm.helpers import ODD_ROWS, as_rows, documents, sentences, words
from tests.llm.test_simhash import plain_components, plain_fingerprint


def plain_groups(rows, similarity=0.8, width=5):
    """The least key of each row's group, by comparing every pair."""
    bodies = sorted({tuple(words(r[1])) for r in rows})
    sets = {b: {b[i : i + width] for i in range(max(1, len(b) - width + 1))} if b else set() for b in bodies}

    def linked(a, b):
        both = len(sets[a] & sets[b])
        return both and both >= similarity * len(sets[a] | sets[b]) - 1e-9

    group = plain_components(bodies, linked)
    least = {}
    for r in rows:
        if r[0] is not None:
            g = group[tuple(words(r[1]))]
            least[g] = min(least.get(g, r[0]), r[0])
    return sorted(((r[0], least.get(group[tuple(words(r[1]))])) for r in rows), key=str)


def copies(seed, texts=12, low=30, high=120):
    draw = random.Random(seed)
    rows = []
    for text in sentences(texts, seed, low=low, high=high):
        rows.append(text)
        for _ in range(draw.randrange(0, 8)):
            w = text.split()
            for _ in range(draw.randrange(1, 4)):
                w[draw.randrange(len(w))] = f"other{draw.randrange(99)}"
            rows.append(" ".join(w))
    # A line that all texts have, and texts that differ in how often they say a thing.
    rows += [f"{t} this one line is in many texts of the corpus" for t in sentences(20, seed + 1, low=8, high=14)]
    rows += [" ".join(["one two three four five six"] * a + ["seven eight nine ten"] * b) for a, b in ((9, 2), (2, 9))]
    draw.shuffle(rows)
    return as_rows(rows, 100)


def found(df, **options):
    return sorted((tuple(r) for r in similar.similar_texts(df, **options).select("doc_id", "component_id").collect()), key=str)


@pytest.mark.parametrize("rounds, sample", [(4, 5000), (0, 5000), (2, 10)])
def test_against_all_pairs(spark, monkeypatch, rounds, sample):
    monkeypatch.setattr(similar, "ROUNDS", rounds)
    monkeypatch.setattr(similar.common_shingles, "__defaults__", (sample,))
    rows = copies(rounds + 1) + ODD_ROWS
    expected = plain_groups(rows)
    assert len({r[1] for r in expected}) < len({tuple(words(r[1])) for r in rows}) - 10
    assert found(documents(spark, rows).repartition(4)) == expected


def test_parity_maps_never_rule_out_a_similar_pair(spark):
    """They differ in no more bits than the sets in shingles, and tell most others apart."""
    rows = copies(5) + [(9100, "one two three", "en", "a", 1), (9101, "", "en", "a", 1)]
    df = documents(spark, rows)
    got = similar.text_prefixes(df, np.empty(0, np.uint64), "doc_id", "text", 0.8, 5).collect()
    maps = {r["key"]: b"".join((v & (1 << 64) - 1).to_bytes(8, "little") for v in r["bits"]) for r in got}
    sets = {}
    for key, text, *_ in rows:
        body = tuple(words(text))
        sets[key] = {body[i : i + 5] for i in range(max(1, len(body) - 4))} if body else set()
    told = 0
    for a in sets:
        for b in sets:
            bits = (int.from_bytes(maps[a], "little") ^ int.from_bytes(maps[b], "little")).bit_count()
            assert bits <= len(sets[a] ^ sets[b])
            told += bits > (len(sets[a]) + len(sets[b])) / 9
    assert told > 0.8 * len(sets) ** 2


def test_stage_drops_a_copy_with_two_words_changed(spark, folder):
    """Such copies are some bits apart, and went through a stage of two bits."""
    text = sentences(1, 3, low=200, high=201)[0].split()
    changed = [*text[:60], "changed", *text[61:140], "again", *text[141:]]
    rows = as_rows([" ".join(text), " ".join(changed), " ".join(text[:150])])
    bits = plain_fingerprint(rows[0][1]) ^ plain_fingerprint(rows[1][1])
    assert bits.bit_count() > 2
    kept = corpus_pipeline.keep_one_of_each_group(spark, documents(spark, rows), folder).collect()
    # The one with a quarter of its words cut off is not that similar and stays.
    assert sorted(r["doc_id"] for r in kept) == [0, 2]


def test_stage_on_the_documents(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    docs = documents(spark, rows + ODD_ROWS, extra=["print", "group", "n"])
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, folder)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted({g for _, g in plain_groups(rows + ODD_ROWS)}, key=str)
