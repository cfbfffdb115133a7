from __future__ import annotations

import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthgrid.llm import pieces, queries
from tests.llm.helpers import ODD_ROWS, documents

sentencepiece = pytest.importorskip("sentencepiece")
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
if not os.path.exists(MODEL):
    pytest.skip("no model file", allow_module_level=True)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def known():
    return pieces.read_pieces(MODEL)


def odd_texts():
    draw = random.Random(7)
    letters = "abcdefgehij mmm  nnn\n\tthe and ing ▁é中文\U0001f600\x00<s>0x0A.,'\r"
    texts = ["".join(draw.choices(letters, k=draw.randrange(120))) for _ in range(800)]
    texts += ["".join(draw.choices("abcdelmnorstui", k=draw.randrange(1, 40))) for _ in range(4000)]
    for n in range(70):
        texts += [" " * n, " " * n + "foo", "foo" + " " * n + "\n" + " " * n + "x", "a" * n, "\n" * n, "▁" * n + "z"]
    base = "".join(draw.choices("abcdefghijklmnopqrstuvwxyz0123456789+/ABCDEFG", k=8000))
    return [*texts, "".join(draw.choices("abcd", k=3000)), base, "中文字" * 500, " " * 20_000, "", "</s><s>", "long " * 30_000]


def ids_of(packed):
    return [np.frombuffer(p, "<u4").tolist() for p in packed]


def test_against_the_library(library, known):
    texts = odd_texts()
    expected = library.encode(texts, add_bos=True, add_eos=True)
    packed = pieces.Encoder(known).encode(texts)
    assert ids_of(packed) == expected
    assert [pieces.decoded_text(known, np.array(i, np.uint32)) for i in expected] == library.decode(expected)


def test_merges_that_open_better_ones_go_one_by_one(known):
    """Such pieces are many, so the test above meets them; they are not merged at once."""
    assert 0 < known.alone.sum() < len(known.made)


def test_without_cuts_and_with_a_small_memory(library, known):
    """Cutting texts and forgetting words change nothing."""
    texts = [t for t in odd_texts() if len(t) < 400][:600]
    expected = library.encode(texts, add_bos=True, add_eos=True)
    from dataclasses import replace

    assert ids_of(pieces.Encoder(replace(known, words="(?s).+")).encode(texts)) == expected
    small = pieces.Encoder(known, known_words=3)
    assert [ids_of(small.encode([t]))[0] for t in texts] == expected
    assert len(small.known) < 100


def test_any_ids_decode_as_by_the_library(library, known):
    draw = random.Random(3)
    special = [0, 1, 2, *range(3, 259), 28705, 259, 260]
    for source in (range(32_000), special):
        for _ in range(4000):
            ids = draw.choices(source, k=draw.randrange(12))
            assert pieces.decoded_text(known, np.array(ids, np.uint32)) == library.decode(ids), ids
    with pytest.raises(ValueError):
        pieces.decoded_text(known, np.array([32_000], np.uint32))


def test_columns(spark, library):
    docs = documents(spark, extra=["value", "c0", "ids", "key"]).withColumn("a map", F.create_map(F.lit(1), F.lit(2)))
    out = pieces.encoded(docs, MODEL)
    assert sorted(out.columns) == sorted(docs.columns)
    rows = out.collect()
    assert len(rows) == len(ODD_ROWS) and {r["value"] for r in rows} == {"other"}
    for r in rows:
        assert ids_of([r["ids"]])[0] == library.encode(r["text"] or "", add_bos=True, add_eos=True)
    texts = pieces.decoded(out.select("doc_id", "ids"), MODEL).collect()
    assert sorted(t["text"] for t in texts) == sorted(r["text"] or "" for r in rows)
    assert pieces.encoded(docs.limit(0), MODEL).collect() == []
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert [r["text"] for r in pieces.decoded(nothing, MODEL).collect()] == [""]


def test_query(spark, folder, library):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    expected = []
    for key, text in docs:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        packed = np.array(ids, "<u4").tobytes()
        digests = hashlib.sha256(packed).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()
        expected.append((key, len(ids), *digests))
    got = queries.all_queries()["op13_pieces"](spark, folder)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected)


def test_the_plan_shuffles_nothing(spark):
    plan = pieces.decoded(pieces.encoded(documents(spark), MODEL), MODEL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_other_models_are_refused(tmp_path):
    data = bytearray()
    # A unigram model: field 2 (trainer), type 1.
    data += bytes([2 << 3 | 2, 2, 3 << 3, 1])
    path = tmp_path / "other.model"
    path.write_bytes(bytes(data))
    with pytest.raises(ValueError, match="byte-pair"):
        pieces.read_pieces(str(path))
