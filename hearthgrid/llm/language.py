"""Language identification by naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from hearthgrid.llm.words import SMALL_SLICE, mix, slices

# Buckets of hashed n-grams, and the longest n-gram.
BUCKETS = 1 << 15
LONGEST = 3
SMOOTHING = 0.1
# The most languages that are learned: those of most rows.
LANGUAGES = 200
UNDECIDED = "und"


# Whether each code point is a letter, a bit each.
LETTERS = np.packbits(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))


def ngram_buckets(texts: list[str | None], longest: int = LONGEST, buckets: int = BUCKETS):
    """Buckets of all character n-grams up to ``longest``, their texts' positions, and
    whether each text has letters.

    Texts are lower-cased. Runs of other characters than letters count as one blank, so
    n-grams see where words begin and end; n-grams of blanks only are left out.
    """
    joined = [np.frombuffer(f" {(t or '').lower()} ".encode("utf-32-le", "replace"), np.uint32) for t in texts]
    sizes = np.fromiter(map(len, joined), np.int64, len(joined))
    points = np.concatenate([*joined, np.empty(0, np.uint32)])
    doc = np.repeat(np.arange(len(joined)), sizes)
    letter = np.unpackbits(LETTERS).view(bool)[points]
    starts = np.cumsum(sizes) - sizes
    first = np.zeros(len(points), bool)
    first[starts] = True
    keep = letter | first | np.concatenate([[False], letter[:-1]])
    points, doc, letter = np.where(letter, points, 32)[keep], doc[keep], letter[keep]
    has = np.zeros(len(joined), bool)
    has[doc[letter]] = True
    found, where = [], []
    value = np.zeros(len(points), np.uint64)
    any_letter = np.zeros(len(points), bool)
    for n in range(1, longest + 1):
        m = len(points) - n + 1
        if m <= 0:
            break
        value = value[:m] * np.uint64(0x100000001B3) + points[n - 1 :] + np.uint64(n)
        any_letter = any_letter[:m] | letter[n - 1 :]
        use = any_letter & (doc[:m] == doc[n - 1 :])
        found.append((mix(value[use]) % np.uint64(buckets)).astype(np.int64))
        where.append(doc[:m][use])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *found]), np.concatenate([none, *where]), has


def ngram_counts(batches: Iterable[pa.RecordBatch], longest: int = LONGEST, buckets: int = BUCKETS) -> dict[str, np.ndarray]:
    """For each ``lang`` the counts of its texts' n-grams by bucket and, last, of its texts with letters."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, langs = batch["text"].to_pylist(), np.array(batch["lang"].to_pylist(), object)
        for a, b in slices(texts, SMALL_SLICE):
            found, where, has = ngram_buckets(texts[a:b], longest, buckets)
            own = langs[a:b]
            for name in set(own):
                mine = own == name
                total = sums.setdefault(name, np.zeros(buckets + 1, np.int64))
                total[:buckets] += np.bincount(found[mine[where]], minlength=buckets)
                total[buckets] += int((mine & has).sum())
    return sums


@dataclass
class LanguageModel:
    """Languages, and for each bucket (row) and language (column) the log probability."""

    languages: list[str]
    priors: np.ndarray
    table: np.ndarray
    longest: int


def fit_languages(
    df: DataFrame,
    text: str = "text",
    lang: str = "lang",
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    smoothing: float = SMOOTHING,
    most: int = LANGUAGES,
) -> LanguageModel:
    """Counts n-grams of all rows with a language and a text.

    Every task sums its rows into one line of counts per language; lines are added up by
    language and bucket. What reaches the driver is one number for each of ``buckets`` and
    language, whatever the number of rows. Of a column with more than ``most`` values, the
    ones of most rows (of null texts too) are learned, the first names of those alike: this
    bounds the matrix.
    """
    labelled = df.where(F.col(lang).isNotNull())
    names = labelled.groupBy(F.col(lang).cast("string").alias("lang")).agg(F.count("*").alias("n"))
    names = [r["lang"] for r in names.orderBy(F.desc("n"), "lang").limit(most + 1).collect()]
    if len(names) > most:
        labelled = labelled.where(F.col(lang).cast("string").isin(names[:most]))
    rows = labelled.where(F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, total in ngram_counts(batches, longest, buckets).items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(total[at])],
                names=["lang", "bucket", "n"],
            )

    counts = (
        rows.mapInArrow(count, "lang string, bucket long, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    names = np.array(counts["lang"].to_pylist(), object)
    languages = sorted(set(names))
    table = np.zeros((buckets + 1, len(languages)))
    for k, name in enumerate(languages):
        mine = names == name
        table[counts["bucket"].to_numpy()[mine], k] = counts["n"].to_numpy()[mine]
    texts, grams = table[buckets] + 1, table[:buckets] + smoothing
    return LanguageModel(
        languages,
        np.log(texts / texts.sum()) if languages else np.empty(0),
        np.log(grams / grams.sum(axis=0)).astype(np.float32),
        longest,
    )


def predict_languages(texts: list[str | None], model: LanguageModel) -> tuple[list[str], np.ndarray]:
    """Most likely language and its probability of each text; the first name of those alike."""
    names, scores = [], np.zeros(len(texts))
    buckets = len(model.table)
    for a, b in slices(texts, SMALL_SLICE):
        found, where, has = ngram_buckets(texts[a:b], model.longest, buckets)
        # Only the buckets a text has, with their counts.
        cells, times = np.unique(where * buckets + found, return_counts=True)
        doc, bucket = cells // buckets, cells % buckets
        logs = np.tile(model.priors, (b - a, 1))
        for k in range(len(model.languages)):
            logs[:, k] += np.bincount(doc, times * model.table[bucket, k], minlength=b - a)
        if not model.languages:
            names += [UNDECIDED] * (b - a)
            continue
        best = logs.argmax(axis=1)
        chance = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        scores[a:b] = np.where(has, chance, 0.0)
        names += [model.languages[k] if h else UNDECIDED for k, h in zip(best, has, strict=True)]
    return names, scores


def with_language(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` to every row; columns of these names are replaced.

    The matrix of log probabilities is broadcast: buckets times languages, a fixed size.
    Null texts and texts without letters are ``und`` with score 0, as are all texts if no
    language was learned. Whole texts are scored.
    """
    shared = df.sparkSession.sparkContext.broadcast(
        (model.languages, model.priors, model.table, model.longest)
    )
    kept = df.drop("lang_pred", "score")
    at = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = LanguageModel(*shared.value)
        for batch in batches:
            names, scores = predict_languages(batch.column(at).to_pylist(), known)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"],
            )


    schema = StructType([*kept.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType())
    return kept.mapInArrow(run, schema)


def confident(score: Column, name: Column, least: float = 0.5) -> Column:
    """Whether a prediction is kept: a language, and likelier than ``least``."""
    return (name != UNDECIDED) & (score >= least)
