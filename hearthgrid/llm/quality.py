"""Text quality by multiple-instance learning with gated attention over passages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthgrid.llm.words import Words, mix

# Words of a passage, whatever the length of the text.
PASSAGE_WORDS = 40
# Passages of a text that the model is fitted to, evenly spread over it. Scoring takes all.
PASSAGES = 48
# Characters of a text that are encoded at once, and passages that are scored at once.
SLICE = 1 << 20
BLOCK = 1 << 14
HASHED = 48
SHAPES = 16
FEATURES = SHAPES + HASHED
HIDDEN = 16
# Labelled rows of each class that the model is fitted to; the bound of what the driver holds.
SAMPLE_ROWS = 2500
STEPS = 300
RATE = 0.02
_BLANK, _WORD = re.compile(r"[\x20\x09-\x0D]"), re.compile(r"[^\x20\x09-\x0D]")


def encode_passages(text: str | None) -> np.ndarray:
    """One row of features per passage; one row of zeros for a text without words.

    Shape: shares of kinds of characters, lengths of words, repetition inside the passage.
    Content: hashed pairs of bytes, so that odd letter sequences show.
    """
    words = Words([text])
    n = len(words.start)
    if not n:
        return np.zeros((1, FEATURES), np.float32)
    length = PASSAGE_WORDS
    first = np.arange(0, n, length)
    # The last passage takes in a rest of less than half a passage.
    if len(first) > 1 and n - first[-1] < length // 2:
        first = first[:-1]
    last = np.append(first[1:], n)
    begin, stop = words.start[first], words.end[last - 1]
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)

    def share(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return (sums[stop] - sums[begin]) / (stop - begin)

    upper = (raw >= 65) & (raw <= 90)
    lower = (raw >= 97) & (raw <= 122)
    digit = (raw >= 48) & (raw <= 57)
    high = raw >= 128
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    mark = np.isin(raw, np.frombuffer(b".,;:'\"!?()-", np.uint8))
    other = ~(upper | lower | digit | high | blank | mark)
    hashes = words.hashes()
    size = (words.end - words.start).astype(float)
    again = np.concatenate([[False], hashes[1:] == hashes[:-1]])
    order = np.repeat(np.arange(len(first)), last - first)
    _, seen = np.unique(mix(order.astype(np.uint64)) + hashes, return_index=True)
    distinct = np.bincount(order[seen], minlength=len(first))
    count = (last - first).astype(float)
    per = lambda x: np.add.reduceat(x.astype(float), first) / count
    out = np.zeros((len(first), FEATURES), np.float32)
    capital = upper[words.start]
    shapes = [
        share(upper), share(lower), share(digit), share(high), share(blank), share(mark), share(other),
        share(raw == 124), share(raw == 33), share(raw == 10) * 10, per(size) / 10, per(size * size) / 200,
        per(again), distinct / count, per(capital), np.minimum(count, PASSAGE_WORDS) / PASSAGE_WORDS,
    ]
    out[:, :SHAPES] = np.stack(shapes, axis=1)
    codes = words.codes
    pairs = (mix(codes[:-1].astype(np.uint64) * np.uint64(256) + codes[1:]) % np.uint64(HASHED)).astype(np.int64)
    passage = np.searchsorted(begin, np.arange(len(pairs)), "right") - 1
    inside = passage >= 0
    cells = np.bincount(passage[inside] * HASHED + pairs[inside], minlength=len(first) * HASHED)
    counts = cells.reshape(-1, HASHED).astype(np.float32)
    out[:, SHAPES:] = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1) * 8
    return out


def passage_slices(text: str | None, characters: int = SLICE) -> Iterator[np.ndarray]:
    """All passages of a text, one matrix for each slice of about so many characters.

    Slices end at a blank, so words stay whole; only a longer single word makes a longer one.
    """
    text = text or ""
    begin = 0
    while True:
        blank = _BLANK.search(text, begin + characters)
        end = blank.start() if blank else len(text)
        yield encode_passages(text[begin:end])
        if not _WORD.search(text, end):
            return
        begin = end


def fitted_passages(text: str | None, most: int = PASSAGES) -> np.ndarray:
    """At most so many passages of a text, evenly spread from its start to its end."""
    every = np.concatenate([*passage_slices(text)])
    return every if len(every) <= most else every[np.arange(most) * len(every) // most]


@dataclass
class QualityModel:
    """Feature scaling, gated attention (V, U, w) and the output weights."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]


def _forward(x: np.ndarray, bag: np.ndarray, n: int, p: dict[str, np.ndarray]):
    """Scores of bags, with what the gradient needs. Each bag has one passage at least."""
    t, g = np.tanh(x @ p["V"]), 1 / (1 + np.exp(-(x @ p["U"])))
    e = (t * g) @ p["w"]
    first = np.searchsorted(bag, np.arange(n))
    a = np.exp(e - np.maximum.reduceat(e, first)[bag])
    a /= np.bincount(bag, a, minlength=n)[bag]
    # The weighted passage representation of a bag, and its score.
    h = np.tanh(x @ p["H"] + p["hb"])
    z = np.add.reduceat(a[:, None] * h, first, axis=0)
    score = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -40, 40)))
    return t, g, a, h, z, score


def fit_bags(bags: list[np.ndarray], labels: np.ndarray, weight: np.ndarray) -> QualityModel:
    """Gradient descent (Adam) on the weighted log loss of bag labels; a fixed start."""
    x = np.concatenate(bags).astype(float)
    bag = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = np.clip((x - mean) / scale, -6, 6)
    n, d = len(bags), x.shape[1]
    random = np.random.default_rng(7)
    p = {
        "V": random.normal(0, d**-0.5, (d, HIDDEN)),
        "U": random.normal(0, d**-0.5, (d, HIDDEN)),
        "w": random.normal(0, HIDDEN**-0.5, HIDDEN),
        "H": random.normal(0, d**-0.5, (d, HIDDEN)),
        "hb": np.zeros(HIDDEN),
        "c": random.normal(0, HIDDEN**-0.5, HIDDEN),
        "b": np.zeros(1),
    }
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    weight = weight / weight.sum()
    for step in range(1, STEPS + 1):
        t, g, a, h, z, score = _forward(x, bag, n, p)
        ds = (score - labels) * weight
        grad = {"c": z.T @ ds, "b": np.array([ds.sum()])}
        dz = ds[:, None] * p["c"]
        dh = a[:, None] * dz[bag] * (1 - h * h)
        grad["H"], grad["hb"] = x.T @ dh, dh.sum(axis=0)
        da = (h * dz[bag]).sum(axis=1)
        de = a * (da - np.bincount(bag, a * da, minlength=n)[bag])
        grad["w"] = (t * g).T @ de
        dgate = de[:, None] * p["w"]
        grad["V"] = x.T @ (dgate * g * (1 - t * t))
        grad["U"] = x.T @ (dgate * t * g * (1 - g))
        for k in p:
            m, v = moment[k]
            g_k = grad[k] + (1e-4 * p[k] if k not in ("b", "hb") else 0)
            m += 0.1 * (g_k - m)
            v += 0.001 * (g_k * g_k - v)
            p[k] = p[k] - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return QualityModel(mean, scale, p)


def _encoded(df: DataFrame, text: str, *columns: str) -> DataFrame:
    """``columns`` and the passages of each text, as the bytes of a matrix."""
    chosen = df.select(*columns, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passages = [fitted_passages(t.as_py()).tobytes() for t in batch.column(len(columns))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(passages, pa.binary())],
                names=[*columns, "passages"],
            )

    kinds = ", ".join(f"{c} {chosen.schema[c].dataType.simpleString()}" for c in columns)
    return chosen.mapInArrow(run, f"{kinds}, passages binary")


def fit_quality(
    df: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    trained: Column | None = None,
    sample_rows: int = SAMPLE_ROWS,
) -> QualityModel:
    """The model of a bounded sample of labelled rows.

    Of each class, the ``sample_rows`` labelled keys with the smallest hashes are used;
    ``trained`` says which keys may be. Classes are weighed as often as they occur among
    all labels. A key with several labels counts as 1 if half of them are. The driver gets
    the passages of the sample, at most 2 * sample_rows * PASSAGES rows, and fits there.
    """
    df = df.select(key, text)
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    if trained is not None:
        known = known.where(trained)
    by_key = known.groupBy(key).agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    totals = {r["label"]: r["n"] for r in by_key.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for value in (0, 1):
        part = by_key.where(F.col("label") == value).orderBy(F.xxhash64(key), key).limit(sample_rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most two times sample_rows keys: a proven bound for the broadcast.
    sample = df.where(F.col(key).isNotNull()).join(F.broadcast(chosen), key)
    # Rows that share a key count once: the one with the smallest text hash.
    sample = sample.groupBy(key, "label").agg(F.min_by(text, F.xxhash64(text)).alias(text))
    rows = _encoded(sample, text, key, "label").orderBy(key).toArrow()
    if not rows.num_rows:
        return QualityModel(np.zeros(FEATURES), np.ones(FEATURES), {})
    y = rows["label"].to_numpy().astype(float)
    bags = [np.frombuffer(b.as_py(), np.float32).reshape(-1, FEATURES) for b in rows["passages"]]
    counts = np.bincount(y.astype(int), minlength=2)
    weight = np.array([totals.get(int(v), 0) / counts[int(v)] for v in y])
    return fit_bags(bags, y, weight)


def _attended(passages: list[np.ndarray], model: QualityModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each slice the largest attention, the sum of attentions relative to it, and the
    sum of passage representations weighted by these."""
    p = model.weights
    x = np.clip((np.concatenate(passages).astype(float) - model.mean) / model.scale, -6, 6)
    e = (np.tanh(x @ p["V"]) / (1 + np.exp(-(x @ p["U"])))) @ p["w"]
    sizes = np.array([len(part) for part in passages])
    first = np.cumsum(sizes) - sizes
    most = np.maximum.reduceat(e, first)
    a = np.exp(e - np.repeat(most, sizes))
    h = np.tanh(x @ p["H"] + p["hb"])
    return most, np.add.reduceat(a, first), np.add.reduceat(a[:, None] * h, first, axis=0)


def score_texts(texts: list[str | None], model: QualityModel, characters: int = SLICE, block: int = BLOCK) -> np.ndarray:
    """Score of each whole text, from 0 to 1; 0.5 if nothing was learned.

    Passages are encoded by slices and scored by blocks; of a text's slices only the sums
    under the attention are kept and put together, so a text of any length takes the memory
    of a slice and a block.
    """
    if not model.weights or not texts:
        return np.full(len(texts), 0.5)
    sums, owners, waiting, n_waiting = [], [], [], 0
    for i, text in enumerate(texts):
        for passages in passage_slices(text, characters):
            owners.append(i)
            waiting.append(passages)
            n_waiting += len(passages)
            if n_waiting >= block:
                sums.append(_attended(waiting, model))
                waiting, n_waiting = [], 0
    if waiting:
        sums.append(_attended(waiting, model))
    most, total, weighted = (np.concatenate(parts) for parts in zip(*sums))
    owner = np.array(owners)
    first = np.searchsorted(owner, np.arange(len(texts)))
    share = np.exp(most - np.maximum.reduceat(most, first)[owner])
    z = np.add.reduceat(weighted * share[:, None], first, axis=0) / np.add.reduceat(total * share, first)[:, None]
    return 1 / (1 + np.exp(-np.clip(z @ model.weights["c"] + model.weights["b"], -40, 40)))


def with_quality(
    df: DataFrame, model: QualityModel, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key`` and ``score`` of every row; whole texts, one pass, no shuffle.

    Every passage of a text takes part in its score. Null and empty texts have one passage
    of zeros. The model is a few kilobytes.
    """
    shared = df.sparkSession.sparkContext.broadcast((model.mean, model.scale, model.weights))
    chosen = df.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = QualityModel(*shared.value)
        for batch in batches:
            scores = score_texts(batch["text"].to_pylist(), known)
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(scores)], names=["key", "score"])

    kind = chosen.schema["key"].dataType.simpleString()
    return chosen.mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)
