"""Katz backoff language model: counts, exact backoff weights and scores of all texts.

Tokens are the words of a text and one end; an event of the model is a known token or "any
other". Counts up to ``DISCOUNTED`` are discounted by Good and Turing's estimate, what that
frees is spread over the events a context has not been seen with, by their unigram share.

Tables, all stored: blocks of encoded texts; unigram counts; bigram counts by bucket of the
context. Texts stay in their block. A block sends each of its distinct bigrams once, with
its count, to the bucket that adds them up, and gets the sum back; so a frequent word or a
text that a third of all rows hold costs no more than one entry per block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthgrid.llm.common import stored
from hearthgrid.llm.words import Words, mix, slices

DISCOUNTED = 5
# Words of a block, and tokens for each bucket of bigrams.
BLOCK_WORDS = 2_000_000
BUCKET_TOKENS = 1_000_000
# A context with more than 1 / HOT of all tokens is split over all buckets; there are at
# most HOT of them, and one for the beginning.
HOT = 4096
# Buckets are counted in so many rounds, so that less is shuffled at a time.
ROUNDS = 2
END, BEGIN = np.uint64(1), np.uint64(2)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays byte by byte: first all lowest bytes, and so on, as high ones are mostly alike."""
    planes = [np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes() for x in arrays]
    return zstandard.compress(b"".join(planes), 3)


def _unpack(data: bytes, *kinds: tuple[type, int]) -> list[np.ndarray]:
    """The arrays of ``_pack``, from their types and lengths."""
    planes = np.frombuffer(zstandard.decompress(data), np.uint8)
    out, begin = [], 0
    for kind, n in kinds:
        width = np.dtype(kind).itemsize
        part = planes[begin : begin + n * width].reshape(width, n)
        out.append(np.ascontiguousarray(part.T).reshape(-1).view(kind))
        begin += n * width
    return out


def _unpack_one(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def discounts(frequencies: list[int]) -> np.ndarray:
    """Factor of counts 1 to k from the numbers of n-grams that occur 1 to k + 1 times.

    Where the estimate is not between 0 and 1 (few n-grams), half a count is taken off.
    """
    n = np.array([0, *frequencies], float)
    k = len(frequencies) - 1
    out = np.ones(k + 1)
    tail = (k + 1) * n[k + 1] / n[1] if n[1] else 0.0
    for c in range(1, k + 1):
        ratio = (c + 1) * n[c + 1] / n[c] / c if n[c] else 0.0
        d = (ratio - tail) / (1 - tail) if tail < 1 else 0.0
        out[c] = d if 0 < d < 1 else (c - 0.5) / c
    return out


@dataclass
class Unigrams:
    """Totals of the training tokens, and their discounts."""

    tokens: int
    types: int
    texts: int
    discount: np.ndarray
    frequencies: list[int]

    def shares(self, counts: np.ndarray) -> np.ndarray:
        """Unigram probability of tokens with these counts; all unknown ones are one event."""
        if not self.tokens:
            return np.ones(len(counts))
        freed = sum((1 - self.discount[c]) * c * n for c, n in enumerate(self.frequencies, 1))
        total = self.tokens
        if not freed:
            freed, total = 1.0, total + 1
        known = self.discount[np.where(counts <= DISCOUNTED, counts, 0)] * counts / total
        return np.where(counts > 0, known, freed / total)


def _blocks(df: DataFrame, key: str, text: str, held: str) -> DataFrame:
    """Texts in blocks: their keys, whether held out, words per text, and words as numbers
    in the block's list of distinct hashes, the most frequent first."""
    chosen = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(F.col(held), F.lit(False)).alias("held"))
    chosen = chosen.withColumn("task", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_now: list[tuple] = []
        made = 0

        def block(task: int) -> pa.RecordBatch:
            hashes = np.concatenate([h[2] for h in held_now])
            words, place, n = np.unique(hashes, return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            rank = np.empty(len(words), np.int32)
            rank[order] = np.arange(len(words), dtype=np.int32)
            keys = pa.chunked_array([h[0] for h in held_now]).combine_chunks()
            size = pa.array([0, len(keys)], pa.int32())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([task << 32 | made], pa.int64()),
                    pa.ListArray.from_arrays(size, keys),
                    pa.array([_pack(np.concatenate([h[1] for h in held_now]))]),
                    pa.array([_pack(np.concatenate([h[3] for h in held_now]).astype(np.int64))]),
                    pa.array([_pack(rank[place])]),
                    pa.array([words[order].tobytes()]),
                ],
                names=["block", "keys", "held", "sizes", "tokens", "words"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            texts, task = batch["text"].to_pylist(), batch["task"][0].as_py()
            is_held = batch["held"].to_numpy(zero_copy_only=False).astype(np.int8)
            for a, b in slices(texts):
                words = Words(texts[a:b])
                held_now.append((batch["key"].slice(a, b - a), is_held[a:b], words.hashes(), words.counts))
                if sum(len(h[2]) for h in held_now) >= BLOCK_WORDS:
                    yield block(task)
                    held_now, made = [], made + 1
        if held_now:
            yield block(task)

    kind = chosen.schema["key"].dataType.simpleString()
    schema = f"block long, keys array<{kind}>, held binary, sizes binary, tokens binary, words binary"
    return chosen.mapInArrow(run, schema)


@dataclass
class _Block:
    """A decoded block: of each token its text, its number and its context's number.

    Numbers beyond the words stand for the end and for the beginning of a text.
    """

    words: np.ndarray
    held: np.ndarray
    doc: np.ndarray
    token: np.ndarray
    context: np.ndarray

    @classmethod
    def of(cls, row: dict) -> _Block:
        words = np.frombuffer(row["words"], np.uint64)
        held, sizes = _unpack_one(row["held"], np.int8).astype(bool), _unpack_one(row["sizes"], np.int64)
        tokens = _unpack_one(row["tokens"], np.int32)
        doc = np.repeat(np.arange(len(sizes)), sizes + 1)
        last = np.cumsum(sizes + 1) - 1
        is_end = np.zeros(len(doc), bool)
        is_end[last] = True
        token = np.full(len(doc), len(words), np.int64)
        token[~is_end] = tokens
        context = np.empty(len(doc), np.int64)
        context[1:] = token[:-1]
        context[last - sizes] = len(words) + 1
        return cls(words, held, doc, token, context)

    def hashes(self) -> np.ndarray:
        return np.concatenate([self.words, [END, BEGIN]])

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Context and token of each distinct bigram, and the place of every token's bigram."""
        width = len(self.words) + 2
        codes, place = np.unique(self.context * width + self.token, return_inverse=True)
        return codes // width, codes % width, place


def _word_counts(blocks: DataFrame) -> DataFrame:
    """``hash`` and ``n`` of all training tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block.of(row)
                known = ~block.held[block.doc]
                n = np.bincount(block.token[known], minlength=len(block.words) + 1)
                at = np.flatnonzero(n)
                hashes = block.hashes()[at]
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n[at])], names=["hash", "n"])

    each = blocks.mapInArrow(run, "hash long, n long")
    return each.groupBy("hash").agg(F.sum("n").alias("n"))


def _counts_by_block(blocks: DataFrame, unigrams: DataFrame) -> DataFrame:
    """``block`` and ``counts``: training counts of its words, in the order of hashes."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["block", "words"]).to_pylist():
                words = np.frombuffer(row["words"], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(words), row["block"])), pa.array(words)], names=["block", "hash"]
                )

    def gather(table: pa.Table) -> pa.Table:
        order = np.argsort(table["hash"].to_numpy().view(np.uint64))
        counts = table["n"].to_numpy()[order]
        return pa.table({"block": table["block"].slice(0, 1), "counts": pa.array([_pack(counts)])})

    asked = blocks.select("block", "words").mapInArrow(ask, "block long, hash long")
    answered = asked.join(unigrams, "hash", "left").select("block", "hash", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    return answered.groupBy("block").applyInArrow(gather, "block long, counts binary")


def _full_counts(block: _Block, row: dict, totals: Unigrams) -> np.ndarray:
    """Counts of a block's words, the end and the beginning; both occur once per text."""
    out = np.full(len(block.words) + 2, totals.texts, np.int64)
    out[np.argsort(block.words)] = _unpack_one(row["counts"], np.int64)
    return out


def _entries(block: _Block, counts: np.ndarray, buckets: int, hot: float):
    """The block's bigrams that training may hold, ordered by bucket, context and token."""
    context, token, place = block.pairs()
    use = np.flatnonzero((counts[context] > 0) & (counts[token] > 0))
    hashes = block.hashes()
    spread = np.where(counts[context[use]] > hot, mix(hashes[token[use]]), np.uint64(0))
    bucket = (mix(hashes[context[use]] + spread) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return context, token, place, use[order], bucket[order]


COUNTED = (
    "kind string, block long, bucket long, hash long, "
    + ", ".join(f"n{c} long" for c in range(1, DISCOUNTED + 2))
    + ", mass double, data binary"
)


def _rows(kind, block, bucket, hashes=None, n=None, mass=None, data=None) -> pa.Table:
    size = len(data) if data is not None else len(n)
    whole = lambda x: pa.array(np.full(size, x), pa.int64()) if np.isscalar(x) else pa.array(x, pa.int64())
    none = pa.nulls(size, pa.int64())
    columns = {
        "kind": pa.array([kind] * size, pa.string()),
        "block": none if block is None else whole(block),
        "bucket": whole(bucket),
        "hash": none if hashes is None else pa.array(hashes.view(np.int64)),
    }
    for c in range(1, DISCOUNTED + 2):
        columns[f"n{c}"] = none if n is None else pa.array(np.ascontiguousarray(n[:, c - 1]), pa.int64())
    columns["mass"] = pa.nulls(size, pa.float64()) if mass is None else pa.array(mass, pa.float64())
    columns["data"] = pa.nulls(size, pa.binary()) if data is None else pa.array(data, pa.binary())
    return pa.table(columns)


def _bigram_round(
    blocks: DataFrame, counts: DataFrame, totals: Unigrams, buckets: int, part: int
) -> DataFrame:
    """Bigram counts of the buckets of one round.

    ``answer``: for a block and bucket the counts of its entries, and of its contexts how
    many tokens follow once, twice and so on, and their unigram share. ``hot``: the same of
    contexts split over buckets. ``total``: how many bigrams occur once, twice and so on.
    """
    hot = max(totals.tokens / HOT, 1.0)

    def send(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        block = _Block.of(row)
        known = _full_counts(block, right.to_pylist()[0], totals)
        context, token, place, chosen, bucket = _entries(block, known, buckets, hot)
        trained = np.bincount(place[~block.held[block.doc]], minlength=len(context))
        hashes = block.hashes()
        out = []
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b or bucket[a] % ROUNDS != part:
                continue
            at = chosen[a:b]
            first = np.flatnonzero(np.diff(context[at], prepend=-1))
            out.append(
                (
                    bucket[a], hashes[context[at[first]]].tobytes(), _pack(known[context[at[first]]]),
                    _pack(np.diff(np.append(first, b - a))), hashes[token[at]].tobytes(),
                    _pack(known[token[at]]), _pack(trained[at]),
                )
            )
        kinds = [pa.int64(), *[pa.binary()] * 6]
        columns = list(zip(*out, strict=True)) or [[]] * 7
        arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
        names = ["bucket", "contexts", "context_counts", "runs", "tokens", "token_counts", "n"]
        return pa.table([pa.array([key[0].as_py()] * len(out), pa.int64()), *arrays], names=["block", *names])

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        runs = [_unpack_one(r["runs"], np.int64) for r in rows]
        contexts = [np.frombuffer(r["contexts"], np.uint64) for r in rows]
        context = np.concatenate([np.repeat(h, n) for h, n in zip(contexts, runs, strict=True)])
        token = np.concatenate([np.frombuffer(r["tokens"], np.uint64) for r in rows])
        token_count = np.concatenate([_unpack_one(r["token_counts"], np.int64) for r in rows])
        context_count = np.concatenate([np.repeat(_unpack_one(r["context_counts"], np.int64), n) for r, n in zip(rows, runs, strict=True)])
        n = np.concatenate([_unpack_one(r["n"], np.int64) for r in rows])
        order = np.lexsort((token, context))
        context, token = context[order], token[order]
        new_context = np.concatenate([[True], context[1:] != context[:-1]])
        new = new_context | np.concatenate([[True], token[1:] != token[:-1]])
        first = np.flatnonzero(new)
        count = np.add.reduceat(n[order], first)
        answer = np.empty(len(order), np.int64)
        answer[order] = count[np.cumsum(new) - 1]
        # Of each context: its tokens by how often they follow, and their unigram share.
        owner = np.cumsum(new_context[first]) - 1
        n_contexts = int(owner[-1]) + 1
        by_count = np.zeros((n_contexts, DISCOUNTED + 1), np.int64)
        few = (count > 0) & (count <= DISCOUNTED + 1)
        np.add.at(by_count, (owner[few], count[few] - 1), 1)
        seen = count > 0
        share = np.bincount(owner[seen], totals.shares(token_count[order][first])[seen], minlength=n_contexts)
        names = context[new_context]
        split = context_count[order][new_context] > hot
        bucket = key[0].as_py()
        out = [_rows("total", None, bucket, n=by_count.sum(axis=0)[None, :])]
        if split.any():
            out.append(_rows("hot", None, bucket, names[split], by_count[split], share[split]))
        data, begin = [], 0
        for own, run in zip(contexts, runs, strict=True):
            end = begin + int(run.sum())
            at = np.searchsorted(names, own)
            data.append(_pack(answer[begin:end], by_count[at, :DISCOUNTED], share[at]))
            begin = end
        out.append(_rows("answer", np.array([r["block"] for r in rows], np.int64), bucket, data=data))
        return pa.concat_tables(out)

    sent = blocks.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(
        send,
        "block long, bucket long, contexts binary, context_counts binary, runs binary, "
        "tokens binary, token_counts binary, n binary",
    )
    return sent.groupBy("bucket").applyInArrow(add, COUNTED)


def scored_texts(
    df: DataFrame, key: str = "doc_id", text: str = "text", held: str = "held_out"
) -> DataFrame:
    """Scores all texts by a bigram model of those that are not ``held``.

    ``key``, ``held``, ``n_tokens``, ``n_known`` (tokens that training has), ``train_tokens``,
    ``base_score`` (add-one unigrams) and ``score`` (the model's), both sums of log10 over
    the tokens, the end included. A token seen after its context has its discounted share;
    else the context's backoff weight times the token's own level below, and so on: that of
    the unigrams, and at last the share of all unknown tokens. Backoff weights are exact:
    what a context's discounts free, over what unigrams give to tokens it was not seen
    with; a context whose tokens are all too frequent to be discounted gives up one count.

    Null and empty texts have one token, the end. Rows are scored one by one, whether keys
    repeat or not; a null key is kept. Words meet as 64-bit hashes.
    """
    spark = df.sparkSession
    blocks = stored(_blocks(df, key, text, held), "katz-blocks")
    unigrams = stored(_word_counts(blocks), "katz-unigrams")
    sums = unigrams.agg(
        F.sum("n").alias("tokens"),
        F.count("*").alias("types"),
        F.sum(F.when(F.col("hash") == int(END), F.col("n"))).alias("texts"),
        *[F.count_if(F.col("n") == c).alias(f"n{c}") for c in range(1, DISCOUNTED + 2)],
    ).first()
    frequencies = [sums[f"n{c}"] for c in range(1, DISCOUNTED + 2)]
    totals = Unigrams(
        sums["tokens"] or 0, sums["types"], sums["texts"] or 0, discounts(frequencies), frequencies[:-1]
    )
    # A block without words has no counts; it needs a row all the same.
    counts = blocks.select("block").join(_counts_by_block(blocks, unigrams), "block", "left")
    none = F.lit(_pack(np.empty(0, np.int64)))
    counts = stored(counts.select("block", F.coalesce("counts", none).alias("counts")), "katz-counts")
    buckets = max(ROUNDS, totals.tokens // BUCKET_TOKENS)
    rounds = [
        stored(_bigram_round(blocks, counts, totals, buckets, part), "katz-bigrams", "kind")
        for part in range(ROUNDS)
    ]
    bigrams = reduce(DataFrame.unionByName, rounds)
    columns = [f"n{c}" for c in range(1, DISCOUNTED + 2)]
    found = bigrams.where("kind = 'total'").agg(*[F.sum(c).alias(c) for c in columns]).first()
    discount = discounts([found[c] or 0 for c in columns])
    # At most HOT + 1 contexts are split: a proven bound.
    hot_rows = (
        bigrams.where("kind = 'hot'").groupBy("hash")
        .agg(*[F.sum(c).alias(c) for c in columns[:-1]], F.sum("mass").alias("mass")).collect()
    )
    hot_contexts = {r["hash"] & ((1 << 64) - 1): (np.array(r[1 : DISCOUNTED + 1]), r["mass"]) for r in hot_rows}
    shared = spark.sparkContext.broadcast((discount, hot_contexts))
    hot = max(totals.tokens / HOT, 1.0)

    def score(key_: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        discount, hot_contexts = shared.value
        row = left.to_pylist()[0]
        answers = sorted((r for r in right.to_pylist()), key=lambda r: r["bucket"])
        block = _Block.of(row)
        known = _full_counts(block, answers[0], totals)
        context, token, place, chosen, bucket = _entries(block, known, buckets, hot)
        hashes = block.hashes()
        pair_count = np.zeros(len(context), np.int64)
        followers, mass = np.zeros((len(hashes), DISCOUNTED), np.int64), np.zeros(len(hashes))
        begin = 0
        for answer in answers[1:]:
            end = np.searchsorted(bucket, answer["bucket"], "right")
            at = chosen[begin:end]
            own = context[at][np.flatnonzero(np.diff(context[at], prepend=-1))]
            kinds = (np.int64, len(at)), (np.int64, DISCOUNTED * len(own)), (np.float64, len(own))
            pair_count[at], few, mass[own] = _unpack(answer["data"], *kinds)
            followers[own] = few.reshape(-1, DISCOUNTED)
            begin = end
        for i in np.flatnonzero(known > hot):
            followers[i], mass[i] = hot_contexts.get(int(hashes[i]), (0, 0.0))
        share = totals.shares(known)
        # Backoff weight and size of each context.
        freed = followers @ ((1 - discount[1:]) * np.arange(1, DISCOUNTED + 1))
        size = np.where(freed > 0, known, known + 1).astype(float)
        weight = np.where(known > 0, np.where(freed > 0, freed, 1.0) / np.maximum(size, 1) / (1 - mass), 1.0)
        seen = pair_count > 0
        level = discount[np.where(pair_count <= DISCOUNTED, pair_count, 0)] * pair_count / np.maximum(size[context], 1)
        with np.errstate(divide="ignore"):
            logs = np.log10(np.where(seen, level, weight[context] * share[token]))
        n = len(block.held)
        base = np.log10((known + 1.0) / (totals.tokens + totals.types + 1.0))
        add = lambda x: np.bincount(block.doc, x, minlength=n)
        return pa.table(
            {
                "key": left["keys"].combine_chunks().flatten(),
                "held": pa.array(block.held),
                "n_tokens": pa.array(add(np.ones(len(block.doc))).astype(np.int64)),
                "n_known": pa.array(add(known[block.token] > 0).astype(np.int64)),
                "train_tokens": pa.array(np.full(n, totals.tokens, np.int64)),
                "base_score": pa.array(add(base[block.token])),
                "score": pa.array(add(logs[place])),
            }
        )

    # The row of counts sorts before all buckets.
    heads = counts.select("block", F.lit(-1).cast("long").alias("bucket"), "counts", F.lit(None).cast("binary").alias("data"))
    tails = bigrams.where("kind = 'answer'").select("block", "bucket", F.lit(None).cast("binary").alias("counts"), "data")
    kind = df.schema[key].dataType.simpleString()
    out = blocks.groupBy("block").cogroup(heads.unionByName(tails).groupBy("block")).applyInArrow(
        score,
        f"key {kind}, held boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
    return out.withColumnsRenamed({"key": key, "held": held})
