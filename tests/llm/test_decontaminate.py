from __future__ import annotations

import math
import random

import numpy as np

from hearthgrid.llm import decontaminate
from hearthgrid.llm.words import Words
from tests.llm.helpers import ODD_ROWS, as_rows, bag, documents, sentences, words


def plain_shingles(text, width=5):
    w = words(text)
    if not w:
        return set()
    return {" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}


def plain_pairs(docs, items, containment=0.8):
    """Items of fewer than five words are one run of their own length."""
    known = {}
    for key, text in items:
        known.setdefault(key, set()).update(plain_shingles(text))
    best = {}
    for row in docs:
        own = {s for width in range(1, 6) for s in plain_shingles(row[1], width)}
        for key, shingles in known.items():
            shared = len(own & shingles)
            if shingles and shared >= max(1, math.ceil(containment * len(shingles) - 1e-9)):
                place = (row[0], key)
                best[place] = max(best.get(place, (0, 0)), (shared, len(shingles)))
    return sorted(((*k, *v) for k, v in best.items()), key=str)


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def planted(seed=2):
    """Items whole, cut, edited and spread over long texts, in upper case and other blanks."""
    draw = random.Random(seed)
    items = list(enumerate(sentences(40, seed, low=3, high=50)))
    texts = sentences(200, seed + 1, low=5, high=900)
    for i, text in enumerate(texts):
        w = text.split(" ")
        _, item = draw.choice(items)
        part = item.split(" ")
        for _ in range(draw.randrange(0, 4)):
            part[draw.randrange(len(part))] = "edited"
        if i % 3 == 0:
            at = draw.randrange(len(w) + 1)
            w[at:at] = part
        elif i % 3 == 1:
            half = len(part) // 2 + 4
            w = part[:half] + w + part[max(0, half - 6) :]
        texts[i] = (" " if i % 2 else "\n\t ").join(w)
        if i % 5 == 0:
            texts[i] = texts[i].upper()
    return as_rows(texts), items


def test_against_plain_containment(spark):
    docs, items = planted()
    df, tests = documents(spark, docs).repartition(5), benchmark(spark, items)
    expected = plain_pairs(docs, items)
    assert len(expected) > 20
    assert bag(decontaminate.contained_items(df, tests)) == expected
    low = bag(decontaminate.contained_items(df, tests, containment=0.3))
    assert low == plain_pairs(docs, items, 0.3)
    # A bit map in which everything collides changes the work, not the result.
    assert bag(decontaminate.contained_items(df, tests, map_bits=6)) == expected


def test_odd_rows(spark):
    items = [
        (1, "twice the same row of words here"), (1, "twice the same row of words here"), (2, None), (3, ""),
        (4, "long long long long long long"), (5, "123 456 !!"), (6, "never seen anywhere at all in them"),
        (None, "A ROW of no key, said twice"), (7, "row of"),
    ]
    df = documents(spark, extra=["item_id", "key", "hash", "digest", "__key"])
    tests = benchmark(spark, items)
    assert bag(decontaminate.contained_items(df, tests)) == plain_pairs(ODD_ROWS, items)
    kept = decontaminate.without_items(df, tests)
    assert kept.columns == df.columns
    left = {r["doc_id"] for r in kept.collect()}
    assert left == {9001, 9002, 9003, 9007}
    assert decontaminate.without_items(df, tests.limit(0)).count() == df.count()
    assert decontaminate.contained_items(df.limit(0), tests).collect() == []


def test_a_hot_item_is_found_in_all_its_documents(spark):
    passage = "a passage that a third of all documents hold word for word today"
    docs = [(i, f"{t} {passage}" if i % 3 == 0 else t, "en", "s", 0) for i, t in enumerate(sentences(300, 5))]
    found = decontaminate.contained_items(documents(spark, docs), benchmark(spark, [(8, passage)]))
    assert {r["doc_id"] for r in found.collect()} == set(range(0, 300, 3))


def test_words_and_shingles():
    texts = ["One two\x0bTHREE", None, "", " lead and  trail ", "é x y\x1fz", "a b c d e f g"]
    batch = Words(texts)
    assert batch.counts.tolist() == [len(words(t)) for t in texts]
    hashes = batch.hashes()
    alone = np.concatenate([Words([t]).hashes() for t in texts])
    assert (hashes == alone).all() and len(set(hashes.tolist())) == len({w for t in texts for w in words(t)})
    values, first, last = batch.shingles(5)
    found = {(int(batch.doc[a]), batch.phrase(a, b)) for a, b in zip(first, last, strict=True)}
    assert found == {(i, s) for i, t in enumerate(texts) for s in plain_shingles(t)}
    assert len(set(values.tolist())) == len({s for _, s in found})
    assert Words([]).hashes().tolist() == [] and len(Words([None]).shingles(5)[0]) == 0


def test_short_items_are_found_inside_texts(spark):
    items = [(1, "what is it"), (2, "Z"), (3, "one two three four"), (4, "five words make one run"), (4, "is it")]
    texts = ["x y what is it z", "what  IS\tit", "it is what", "z", "say one two three four five", "zz", "", "is it"]
    docs = as_rows(texts)
    found = bag(decontaminate.contained_items(documents(spark, docs), benchmark(spark, items)))
    assert found == plain_pairs(docs, items)
    assert {(i, k) for i, k, *_ in found} == {(0, 1), (1, 1), (0, 2), (3, 2), (4, 3)}


def test_sizes_apart(spark):
    """Items from one word to thousands, each inside a longer text, whole and in part."""
    draw = random.Random(9)
    sizes = [1, 2, 4, 5, 6, 9, 17, 40, 130, 700, 3000]
    items = [(n, " ".join(f"w{draw.randrange(4000)}" for _ in range(n))) for n in sizes]
    docs = []
    for n, text in items:
        w, around = text.split(" "), [f"v{draw.randrange(9000)}" for _ in range(400)]
        for share in (1.0, 0.9, 0.7):
            docs.append(" ".join(around[:200] + w[: max(1, round(share * n))] + around[200:]))
    docs = as_rows(docs)
    found = bag(decontaminate.contained_items(documents(spark, docs), benchmark(spark, items)))
    assert found == plain_pairs(docs, items) and {k for _, k, *_ in found} == set(sizes)


def test_rows_of_one_key_are_judged_by_their_texts(spark):
    """Clean rows stay beside leaking ones that share their key, or have none either."""
    item = " ".join(f"word{i}" for i in range(20))
    leak, clean = f"before {item} after", "a clean text that says something else entirely"
    rows = [(k, t, "en", "a", 1) for k in (7, None) for t in (leak, clean, clean, None)]
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontaminate.without_items(documents(spark, rows, extra=["digest", "hash"]), items).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted(
        ((k, t) for k in (7, None) for t in (clean, clean, None)), key=str
    )
