"""Small inputs for the operators' tests."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD_ROWS = [
    (None, "A row of no key, said twice", "en", None, 1),
    (None, "A row of no key, said twice", "en", None, 1),
    (9001, None, None, "a", None),
    (9002, "", "en", "a", 0),
    (9003, " \n\t ", "en", "b", 3),
    (9004, "123 456 !!", None, "b", 10),
    (9005, "twice the same row of words here", "en", "c", 32),
    (9005, "twice the same row of words here", "en", "c", 32),
    (9006, "long " * 30_000, "en", None, 150_000),
    (9007, "Ünïcödé 𝒳 words\x00with odd marks", "de", "é", 30),
]


def words(text):
    """Words as all operators count them, ASCII letters lower-cased."""
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def documents(spark, rows=None, extra=()):
    """A table like ``documents``; ``extra`` adds columns of these names."""
    df = spark.createDataFrame(ODD_ROWS if rows is None else rows, SCHEMA)
    for name in extra:
        df = df.selectExpr("*", f"'other' AS `{name}`")
    return df


def sentences(n, seed=0, vocabulary=400, low=8, high=60):
    draw = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    known = ["".join(draw.choices(letters, k=draw.randrange(2, 9))) for _ in range(vocabulary)]
    return [" ".join(draw.choices(known, k=draw.randrange(low, high))) for _ in range(n)]


def as_rows(texts, start=0):
    return [(start + i, t, "en", f"s{i % 5}", len(t)) for i, t in enumerate(texts)]


def bag(df):
    return sorted((tuple(r) for r in df.collect()), key=str)
