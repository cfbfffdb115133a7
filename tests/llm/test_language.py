from __future__ import annotations

import math
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from hearthgrid.llm import language, queries
from tests.llm.helpers import ODD_ROWS, as_rows, bag, documents, sentences


def grams(text):
    """All n-grams of letters and single blanks that have a letter."""
    kept = " "
    for c in f"{text.lower()} ":
        kept += c if c.isalpha() else "" if kept.endswith(" ") else " "
    found = [kept[i : i + n] for n in (1, 2, 3) for i in range(len(kept) - n + 1)]
    return [g for g in found if any(c.isalpha() for c in g)]


def test_buckets_are_those_of_the_grams():
    texts = ["Hé wörld! 12 ab", "", None, "x", " - ", "a  b\n\nc", "\U0001d4b3 z"]
    found, where, has = language.ngram_buckets(texts, 3, 1 << 40)
    for i, text in enumerate(texts):
        assert sorted(Counter(found[where == i].tolist()).values()) == sorted(Counter(grams(text or "")).values())
    assert has.tolist() == [True, False, False, True, False, True, True]


def test_counting_holds_a_small_slice():
    """What a task holds does not follow the size of its batches."""
    texts = sentences(400, 9, 400, 2000, 2100)
    batch = pa.RecordBatch.from_pydict({"lang": ["aa", "bb"] * 200, "text": texts})
    assert sum(map(len, texts)) > 4 << 20
    tracemalloc.start()
    counts = language.ngram_counts([batch])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000
    assert {name: int(total[-1]) for name, total in counts.items()} == {"aa": 200, "bb": 200}
    alone = [language.ngram_counts([batch.slice(i, 1)]) for i in range(400)]
    for name, total in counts.items():
        assert (total == sum(one[name] for one in alone if name in one)).all()


def plain_prediction(train, text):
    """Naive Bayes over exact n-grams."""
    counts, texts = defaultdict(Counter), Counter()
    for t, lang in train:
        counts[lang].update(grams(t))
        texts[lang] += 1
    names = sorted(counts)
    size = 1 << 22
    logs = []
    for name in names:
        total = sum(counts[name].values()) + language.SMOOTHING * size
        logs.append(
            math.log((texts[name] + 1) / (sum(texts.values()) + len(names)))
            + sum(math.log((counts[name][g] + language.SMOOTHING) / total) for g in grams(text))
        )
    best = int(np.argmax(logs))
    return names[best], 1 / sum(math.exp(x - logs[best]) for x in logs)


def test_against_a_plain_model(spark):
    train = [(t, "aa") for t in sentences(6, 1, 30)] + [(t, "bb") for t in sentences(6, 2, 30)]
    rows = [(i, t, lang, "s", 0) for i, (t, lang) in enumerate(train)]
    # So many buckets that no two n-grams meet in one.
    model = language.fit_languages(documents(spark, rows), buckets=1 << 22)
    tests = ["the", "a b", *sentences(4, 3, 30, 1, 3)]
    names, scores = language.predict_languages(tests, model)
    for text, name, score in zip(tests, names, scores, strict=True):
        expected = plain_prediction(train, text)
        assert name == expected[0] and score == pytest.approx(expected[1], rel=1e-4)


def test_odd_rows(spark):
    df = documents(spark, extra=["score", "bucket"])
    model = language.fit_languages(df)
    found = language.with_language(df, model)
    assert found.columns == [c for c in df.columns if c != "score"] + ["lang_pred", "score"]
    rows = {r["doc_id"]: r for r in found.collect()}
    assert found.count() == len(ODD_ROWS)
    for key in (9001, 9002, 9003, 9004):
        assert (rows[key]["lang_pred"], rows[key]["score"]) == ("und", 0.0)
    assert rows[9006]["lang_pred"] == "en" and 0 <= rows[9007]["score"] <= 1


def test_nothing_learned(spark):
    df = documents(spark)
    model = language.fit_languages(df.limit(0))
    found = language.with_language(df, model)
    assert {(r["lang_pred"], r["score"]) for r in found.collect()} == {("und", 0.0)}
    assert language.with_language(df.limit(0), language.fit_languages(df)).collect() == []


def test_the_languages_of_most_rows_are_learned(spark):
    """A dirty column of languages does not make the matrix grow."""
    texts = sentences(60, 6)
    rows = [(i, t, f"odd {i}" if i % 3 == 0 else "en" if i % 3 == 1 else "de", "s", 1) for i, t in enumerate(texts)]
    df = documents(spark, rows + [(99, None, "fr", "s", 1), (98, "du texte", "fr", "s", 1)])
    assert language.fit_languages(df, most=3).languages == ["de", "en", "fr"]
    assert language.fit_languages(df, most=2).languages == ["de", "en"]
    assert len(language.fit_languages(df).languages) == 23
    assert set(language.predict_languages(texts, language.fit_languages(df, most=2))[0]) <= {"de", "en"}


def test_batches_do_not_matter():
    texts = sentences(40, 5) + ["", None, "q"]
    model = language.LanguageModel(
        ["a", "b"], np.zeros(2), np.random.default_rng(0).normal(size=(1 << 10, 2)).astype(np.float32), 3
    )
    together = language.predict_languages(texts, model)
    alone = [language.predict_languages([t], model) for t in texts]
    assert together[0] == [n for names, _ in alone for n in names]
    assert together[1] == pytest.approx(np.concatenate([s for _, s in alone]))


def test_query(spark, folder):
    found = queries.op2_language_id(spark, folder)
    truth = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    joined = found.join(truth, "doc_id").where("held_out and lang is not null").collect()
    right = sum(r["lang"] == r["lang_pred"] for r in joined)
    assert found.count() == truth.count() and right / len(joined) > 0.9


def test_clean_short_texts_keep_their_language(spark):
    rows = as_rows(sentences(30, 8))
    model = language.fit_languages(documents(spark, rows))
    assert set(language.predict_languages(["ab", "word one"], model)[0]) == {"en"}
    assert bag(language.with_language(documents(spark, rows[:1]), model))[0][-2] == "en"
