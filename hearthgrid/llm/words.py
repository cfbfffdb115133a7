"""Words, word hashes and shingles of batches of texts, as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

# Odd, so that powers have an inverse modulo 2**64.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``_BASE ** i`` and its inverse for i < n; kept between calls up to a fixed size."""
    global _powers
    if len(_powers[0]) >= n:
        return _powers
    size = max(n, 1 << 20)
    tables = []
    for base in (_BASE, _INVERSE):
        table = np.full(size, base)
        table[0] = 1
        tables.append(np.cumprod(table, dtype=np.uint64))
    if size <= 1 << 22:
        _powers = tables[0], tables[1]
    return tables[0], tables[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers; one to one."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """The words of some texts, ASCII letters lower-cased.

    A word is a run of characters other than space and the control characters 9 to 13.
    ``start`` and ``end`` are byte offsets into ``data``, ``doc`` the position of the
    text that a word belongs to, ``first`` the number of words before each text (with
    one more entry at the end).
    """

    def __init__(self, texts: Iterable[str | None]) -> None:
        encoded = [(t or "").encode("utf-8", "replace") for t in texts]
        self.data = b" ".join([*encoded, b""]).lower()
        sizes = np.fromiter((len(e) + 1 for e in encoded), np.int64, len(encoded))
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        self.codes = np.frombuffer(self.data, np.uint8)
        inside = (self.codes != 32) & ((self.codes < 9) | (self.codes > 13))
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
        self.start, self.end = edges[0::2], edges[1::2]
        self.first = np.searchsorted(self.start, bounds)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(encoded)), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.start):
            return np.empty(0, np.uint64)
        powers, inverse = _power_tables(len(self.codes) + 1)
        sums = np.zeros(len(self.codes) + 1, np.uint64)
        np.cumsum(
            (self.codes.astype(np.uint64) + np.uint64(1)) * powers[: len(self.codes)],
            out=sums[1:],
        )
        return mix((sums[self.end] - sums[self.start]) * inverse[self.start])

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, first word and last word of each run of ``width`` words inside a text.

        A text of fewer words has one shingle, all its words; one without words has none.
        """
        hashes = self.hashes()
        short = np.flatnonzero((self.counts > 0) & (self.counts < width))
        full = np.flatnonzero(self.counts >= width)
        runs = self.counts[full] - width + 1
        offsets = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
        first = np.repeat(self.first[full], runs) + offsets
        value = np.zeros(len(first), np.uint64)
        for i in range(width):
            value = mix(value + hashes[first + i])
        whole = np.zeros(len(short), np.uint64)
        for k, doc in enumerate(short):
            for h in hashes[self.first[doc] : self.first[doc + 1]]:
                whole[k : k + 1] = mix(whole[k : k + 1] + h)
        return (
            np.concatenate([value, whole]),
            np.concatenate([first, self.first[short]]),
            np.concatenate([first + width - 1, self.first[short + 1] - 1]),
        )

    def phrase(self, first: int, last: int) -> str:
        """Words ``first`` to ``last``, joined by one space."""
        span = self.data[self.start[first] : self.end[last]]
        return b" ".join(span.split()).decode("utf-8", "replace")


# Characters of a slice where a step holds a hundred bytes or more for each.
SMALL_SLICE = 1 << 18


def slices(texts: list[str | None], characters: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts that together have about so many characters; one text at least."""
    begin = size = 0
    for i, text in enumerate(texts):
        size += len(text or "") + 1
        if size >= characters:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def signed(hashes: np.ndarray) -> pa.Array:
    """64-bit hashes as the signed numbers that Spark's long holds."""
    return pa.array(np.ascontiguousarray(hashes).view(np.int64))
