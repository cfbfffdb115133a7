"""Token counts under a unigram model of pieces, scored on a trie of pre-tokens."""

from __future__ import annotations

import base64
import math
from collections.abc import Callable, Iterator, Mapping
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A word with the blank before it, else a run of blanks, of digits or of other marks.
PRE_TOKEN = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
# Nodes after which a task begins a new trie, about 150 bytes each.
TRIE_NODES = 1_000_000
# Characters beyond which the pre-tokens of a text are taken one by one.
LONG_TEXT = 1 << 20


@cache
def piece_scores(path: str) -> dict[bytes, float]:
    """Log probabilities of a vocabulary's pieces by their ranks.

    ``path`` is a file of base64 pieces and ranks, as public tokenizers publish them. Ranks
    are taken as frequencies by Zipf's law: the piece of rank r has a share of 1 / (r + 1).
    """
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
    total = math.log(sum(1 / (r + 1) for r in ranks.values()))
    return {piece: -math.log(r + 1) - total for piece, r in ranks.items()}


class _Terminals(dict):
    """Counts of inserted pre-tokens; one that is asked for first is inserted."""

    def __init__(self, insert: Callable[[str], int]) -> None:
        self.insert = insert

    def __missing__(self, token: str) -> int:
        count = self[token] = self.insert(token)
        return count


class Trie:
    """Pre-tokens inserted so far, each prefix scored once.

    A node is a prefix. Its forward score is the best sum of piece scores over all ways to
    cut the prefix into pieces: the best, over the pieces that end there, of the score of
    the node where the piece begins plus the piece's own. Its count is the number of pieces
    of that way; of ways alike in score the one with fewer pieces counts. Prefixes shared by
    pre-tokens are scored once, and an inserted pre-token keeps its terminal count. A byte
    that no piece covers counts as one token, at a score below any piece's.
    """

    def __init__(self, scores: Mapping[bytes, float], nodes: int = TRIE_NODES) -> None:
        self.nodes = nodes
        # What pieces end with, and the score of what is a piece: a walk back from the end
        # of a prefix stops where no piece reaches further.
        self.ends: dict[bytes, float | None] = {piece[k:]: None for piece in scores for k in range(len(piece))}
        self.ends.update(scores)
        self.unknown = min(scores.values(), default=0.0) - 10
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}
        self.forward = [0.0]
        self.pieces = [0]
        self.terminal = _Terminals(self.insert)

    def insert(self, token: str) -> int:
        """The number of tokens of a pre-token, whose prefixes become nodes."""
        data = token.encode("utf-8", "replace")
        children, forward, pieces = self.children, self.forward, self.pieces
        end_of = self.ends.get
        path = [0]
        node = 0
        for i, byte in enumerate(data, 1):
            edge = node << 8 | byte
            node = children.get(edge, -1)
            if node < 0:
                best, count = forward[path[-1]] + self.unknown, pieces[path[-1]] + 1
                for k in range(i - 1, -1, -1):
                    score = end_of(data[k:i], False)
                    if score is False:
                        break
                    if score is not None:
                        at = path[k]
                        total, n = forward[at] + score, pieces[at] + 1
                        if total > best or (total == best and n < count):
                            best, count = total, n
                node = children[edge] = len(forward)
                forward.append(best)
                pieces.append(count)
            path.append(node)
        return pieces[node]

    def count(self, token: str) -> int:
        return self.terminal[token]

    def trimmed(self) -> None:
        """Start anew once the trie is full: counts stay right, memory stays bounded."""
        if len(self.forward) > self.nodes:
            self.clear()


def with_token_counts(
    df: DataFrame,
    vocabulary: str,
    key: str = "doc_id",
    text: str = "text",
    pattern: str = PRE_TOKEN,
    scores: Callable[[str], Mapping[bytes, float]] = piece_scores,
) -> DataFrame:
    """``key``, ``n_pre_tokens`` and ``n_tokens`` of every row.

    Texts are cut into pre-tokens by ``pattern``. A task keeps one trie over its batches:
    distinct pre-tokens are inserted once, and what they share is scored once. Nothing is
    shuffled; a third of all rows in one source or one text changes nothing. The vocabulary
    is read where the path is readable on the driver and sent once (its size is fixed).
    Null and empty texts have no tokens. Whole texts count, of any length.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(dict(scores(vocabulary)))
    chosen = df.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(shared.value)
        compiled = regex.compile(pattern)
        for batch in batches:
            pre, tokens = [], []
            for value in batch["text"]:
                text = value.as_py() or ""
                count = trie.terminal.__getitem__
                if len(text) <= LONG_TEXT:
                    found = compiled.findall(text)
                    pre.append(len(found))
                    tokens.append(sum(map(count, found)))
                else:
                    n = total = 0
                    for match in compiled.finditer(text):
                        n += 1
                        total += count(match[0])
                    pre.append(n)
                    tokens.append(total)
                trie.trimmed()
            yield pa.RecordBatch.from_arrays(
                [batch["key"], pa.array(pre, pa.int64()), pa.array(tokens, pa.int64())],
                names=["key", "n_pre_tokens", "n_tokens"],
            )

    kind = chosen.schema["key"].dataType.simpleString()
    counted = chosen.mapInArrow(run, f"key {kind}, n_pre_tokens long, n_tokens long")
    return counted.withColumnRenamed("key", key)
