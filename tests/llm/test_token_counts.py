from __future__ import annotations

import base64
import random

import pytest
from tokenizers import Tokenizer, models

from hearthgrid.llm import queries, token_counts
from tests.llm.helpers import ODD_ROWS, documents, sentences


def plain_count(token, scores):
    """Fewest pieces among the best cuts of a token, by trying all cuts."""
    data = token.encode()
    best = [(0.0, 0)]
    unknown = min(scores.values()) - 10
    for i in range(1, len(data) + 1):
        options = [(best[i - 1][0] + unknown, best[i - 1][1] + 1)]
        options += [
            (best[k][0] + scores[data[k:i]], best[k][1] + 1) for k in range(i) if data[k:i] in scores
        ]
        best.append(max(options, key=lambda o: (o[0], -o[1])))
    return best[-1][1]


SCORES = {b"a": -1.0, b"b": -1.2, b"ab": -1.5, b"abc": -4.0, b"c": -2.0, b"bc": -1.1, b" a": -0.5, "é".encode(): -3.0}


@pytest.mark.parametrize("nodes", [0, 10, 100_000])
def test_trie_against_all_cuts(nodes):
    draw = random.Random(1)
    trie = token_counts.Trie(SCORES, nodes)
    for _ in range(400):
        token = "".join(draw.choices(["a", "b", "c", " a", "é", "z"], k=draw.randrange(0, 12)))
        assert trie.count(token) == plain_count(token, SCORES)
        trie.trimmed()
        assert len(trie.forward) <= max(nodes, 1) or nodes == 100_000


def test_shared_prefixes_are_scored_once():
    trie = token_counts.Trie(SCORES)
    for token in ("abc", "abcc", "abca", "abc"):
        trie.count(token)
    assert len(trie.forward) == 1 + 3 + 1 + 1 and trie.terminal["abc"] == plain_count("abc", SCORES)


def test_against_a_public_unigram_model():
    """The same scores in an installed tokenizer give as many tokens."""
    scores = token_counts.piece_scores(f"{queries.TOKENIZERS}/byte_bpe_50k.tiktoken")
    known = {p.decode(): s for p, s in scores.items() if p.isascii()}
    known.pop("", None)
    model = Tokenizer(models.Unigram([("<unk>", -100.0), *known.items()], 0, False))
    trie = token_counts.Trie({p.encode(): s for p, s in known.items()})
    same = total = 0
    for text in sentences(60, 3):
        for token in text.split():
            total += 1
            same += trie.count(token) == len(model.encode(token).ids)
    assert same == total


def test_odd_rows(spark, tmp_path):
    path = tmp_path / "pieces"
    path.write_text("\n".join(f"{base64.b64encode(p).decode()} {i}" for i, p in enumerate(SCORES)) + "\n")
    scores = token_counts.piece_scores(str(path))
    df = documents(spark, extra=["n_tokens", "key"])
    found = token_counts.with_token_counts(df, str(path)).collect()
    assert len(found) == len(ODD_ROWS)
    import regex

    expected = []
    for row in ODD_ROWS:
        pre = regex.findall(token_counts.PRE_TOKEN, row[1] or "")
        assert "".join(pre) == (row[1] or "")
        expected.append((row[0], len(pre), sum(plain_count(t, scores) for t in pre)))
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)
    assert token_counts.with_token_counts(df.limit(0), str(path)).collect() == []


def test_query(spark, folder):
    scores = token_counts.piece_scores(f"{queries.TOKENIZERS}/byte_bpe_50k.tiktoken")
    import regex

    memo = {}
    counts = {r["doc_id"]: (r["n_pre_tokens"], r["n_tokens"]) for r in queries.op8_token_counts(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(counts) == len(docs)
    for row in docs[::7]:
        pre = regex.findall(token_counts.PRE_TOKEN, row["text"])
        for t in pre:
            if t not in memo:
                memo[t] = plain_count(t, scores)
        assert counts[row["doc_id"]] == (len(pre), sum(memo[t] for t in pre))
