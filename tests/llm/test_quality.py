from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthgrid.llm import quality, queries
from tests.llm.helpers import ODD_ROWS, documents, sentences


def test_passages_cover_the_whole_text():
    for n in (1, 39, 40, 59, 60, 61, 400, 40_000):
        text = " ".join(["word"] * n)
        passages = quality.encode_passages(text)
        assert passages.shape == (max(1, (n + 20) // 40), quality.FEATURES)
        assert len(quality.fitted_passages(text)) == min(len(passages), quality.PASSAGES)
    clean, dirty = " ".join(["plain words here"] * 3000), " ".join(["### $$$ %%%"] * 40)
    last = quality.encode_passages(f"{clean} {dirty}")[-1]
    assert not np.allclose(last, quality.encode_passages(clean)[-1])


def test_texts_without_words_are_one_passage_of_zeros():
    for text in (None, "", " \n"):
        assert quality.encode_passages(text).tolist() == [[0.0] * quality.FEATURES]


def test_gradients_fit_the_label_of_one_passage():
    """A bag is low if one of its passages is; only attention can tell which."""
    draw = np.random.default_rng(3)
    bags, labels = [], []
    for i in range(400):
        passages = draw.normal(size=(draw.integers(2, 8), quality.FEATURES)).astype(np.float32)
        passages[:, 0] = passages[:, 6:] = 0
        if i % 2:
            passages[draw.integers(len(passages)), 0] = 3
        bags.append(passages)
        labels.append(1 - i % 2)
    model = quality.fit_bags(bags[:300], np.array(labels[:300], float), np.ones(300))
    scores = np.array([plain_score(b, model) for b in bags[300:]])
    assert ((scores > 0.5) == np.array(labels[300:], bool)).mean() > 0.85


def plain_score(passages, model):
    """The score of one text by the formulas, passage by passage."""
    p, rows = model.weights, []
    for passage in passages:
        x = np.clip((passage.astype(float) - model.mean) / model.scale, -6, 6)
        gate = 1 / (1 + np.exp(-(x @ p["U"])))
        rows.append((np.exp(np.sum(np.tanh(x @ p["V"]) * gate * p["w"])), np.tanh(x @ p["H"] + p["hb"])))
    z = sum(a * h for a, h in rows) / sum(a for a, _ in rows)
    return 1 / (1 + np.exp(-(z @ p["c"] + p["b"][0])))


def test_scores_against_plain_attention():
    texts = [*sentences(12, 1, high=900), None, "", "x", "one two " * 5000 + "### $$$ " * 30]
    bags = [quality.fitted_passages(t) for t in texts]
    model = quality.fit_bags(bags, np.array([0.0, 1.0] * 8), np.ones(16))
    wanted = [plain_score(quality.encode_passages(t), model) for t in texts]
    assert quality.score_texts(texts, model) == pytest.approx(wanted)
    assert quality.score_texts(texts, model, block=3) == pytest.approx(wanted)
    cut = [np.concatenate([*quality.passage_slices(t, 500)]) for t in texts]
    wanted = [plain_score(c, model) for c in cut]
    assert quality.score_texts(texts, model, characters=500, block=7) == pytest.approx(wanted)


def test_slices_hold_all_words_once():
    text = " ".join(f"w{i}" for i in range(3000)) + " "
    parts = [*quality.passage_slices(text, 1000)]
    assert len(parts) > 10
    # The share of a full passage that each one has, summed, is the number of words.
    full = quality.SHAPES - 1
    assert 3000 * 0.9 <= sum(p[:, full].sum() for p in parts) * 40 <= 3000
    assert len([*quality.passage_slices("x" * 5000, 1000)]) == 1


def test_scores_do_not_depend_on_neighbours():
    texts = [*sentences(10, 1), "", "x"]
    model = quality.fit_bags([quality.fitted_passages(t) for t in texts], np.array([0.0, 1.0] * 6), np.ones(12))
    together = quality.score_texts(texts, model)
    assert together == pytest.approx([quality.score_texts([t], model)[0] for t in texts])


def test_odd_rows(spark):
    df = documents(spark, extra=["score", "passages", "label"])
    labels = spark.createDataFrame(
        [(9005, 1, 0), (9005, 0, 0), (9006, 0, 1), (9002, 0, None), (None, 1, 0), (9007, None, 1), (1, 1, 1)],
        "doc_id long, quality int, toxic int",
    )
    found = quality.with_quality(df, quality.fit_quality(df, labels))
    rows = found.collect()
    assert len(rows) == len(ODD_ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    none = quality.fit_quality(df, labels.limit(0))
    assert {r["score"] for r in quality.with_quality(df, none).collect()} == {0.5}
    assert quality.with_quality(df.limit(0), none).collect() == []


def test_only_rows_that_may_be_learned_from_are(spark):
    texts = sentences(40, 2)
    rows = [(i, t.upper() if i % 2 else t, "en", "s", 0) for i, t in enumerate(texts)]
    df = documents(spark, rows)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(40)], "doc_id long, quality int")
    held = F.col("doc_id") >= 20
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    one = quality.with_quality(df, quality.fit_quality(df, labels, trained=~held)).collect()
    two = quality.with_quality(df, quality.fit_quality(df, turned, trained=~held)).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    found = queries.op3_quality(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = found.join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.9
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in rows)
