"""Encoding and decoding with SentencePiece byte-pair models, by vectorised merge rounds."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthgrid.llm.words import slices

BLANK = "▁"
# Distinct words after which a task forgets what it has encoded.
KNOWN_WORDS = 400_000
_NEVER = np.int32(np.iinfo(np.int32).max)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + size]
            at += size


@dataclass
class Pieces:
    """A model's merges as arrays; its size is that of the vocabulary.

    Symbols are numbered: the pieces by their ids, then characters that only occur within
    pieces. ``pairs`` holds left * symbols + right, sorted, of all pairs that make a piece,
    ``made`` that piece and ``rank`` its place in the order of scores. ``alone`` marks
    pieces all of whose occurrences may be merged at once. ``beside`` holds, sorted, the
    pairs of character symbols that stand side by side in some piece.
    """

    symbols: int
    characters: dict[int, int]
    pairs: np.ndarray
    made: np.ndarray
    rank: np.ndarray
    alone: np.ndarray
    beside: np.ndarray
    surface: list[bytes]
    bytes_from: np.ndarray
    begin: int
    end: int
    unknown: int
    dummy_prefix: bool
    words: str


# Fixed numbers of the model format: kinds of pieces, and of models.
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_BPE = 2


def read_pieces(path: str) -> Pieces:
    """The merges of a model file.

    Models that change characters before they merge, drop blanks, know no bytes, or are no
    byte-pair models are refused.
    """
    with open(path, "rb") as file:
        data = file.read()
    names, scores, kinds = [], [], []
    trainer: dict[int, int | bytes] = {}
    normalizer: dict[int, int | bytes] = {}
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            names.append(piece.get(1, b"").decode())
            scores.append(np.frombuffer(piece.get(2, bytes(4)), "<f4")[0])
            kinds.append(piece.get(3, _NORMAL))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normalizer = dict(_fields(value))
    if trainer.get(3, 1) != _BPE or not trainer.get(35, 0):
        raise ValueError("only byte-pair models with byte fallback are known")
    if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1):
        raise ValueError("only models that keep characters and blanks are known")
    if set(kinds) - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
        raise ValueError("user-defined and unused pieces are not known")

    known = {n: i for i, (n, k) in enumerate(zip(names, kinds, strict=True)) if k == _NORMAL}
    order = {s: r for r, s in enumerate(sorted({scores[i] for i in known.values()}, reverse=True))}
    rank = {n: order[scores[i]] for n, i in known.items()}
    symbol = dict(known)
    for name in known:
        for c in name:
            symbol.setdefault(c, len(names) + len(symbol) - len(known))
    symbols = len(names) + len(symbol) - len(known)

    rows, beside = [], set()
    times: dict[int, int] = {}
    for r in rank.values():
        times[r] = times.get(r, 0) + 1
    alone = np.array([False] * symbols)
    for name, i in known.items():
        alone[i] = times[rank[name]] == 1
    for name, i in known.items():
        for k in range(1, len(name)):
            beside.add(symbol[name[k - 1]] * symbols + symbol[name[k]])
            left, right = symbol.get(name[:k]), symbol.get(name[k:])
            if left is not None and right is not None:
                rows.append((left * symbols + right, i, rank[name]))
                # A merge that opens a better one is not made at several places at once.
                for part in (name[:k], name[k:]):
                    if part in rank and rank[name] <= rank[part]:
                        alone[known[part]] = False
    rows.sort()

    # No merge reaches over these places, so texts are cut there: before a blank that
    # follows another character, and around characters that are in no piece.
    single = set("".join(known))
    apart = "".join(c for c in "\n\t\r" if c not in single)
    runs = sorted(len(n) for n in known if len(n) > 1 and not n.strip(BLANK))
    inner = any(re.search(f"[^{BLANK}]{BLANK}|{BLANK}{BLANK}[^{BLANK}]", n) for n in known)
    if inner:
        words = r"(?s).+"
    else:
        words = f"{BLANK}*[^{BLANK}{apart}]+|{BLANK}+" + (f"|[{apart}]" if apart else "")
        last = {n for n in known if len(n) > 1 and rank[n] == len(order) - 1}
        if runs and last == {BLANK * n for n in runs} and _merged_run(runs) == [runs[-1]]:
            # Runs of blanks merge after everything else, from the left, into the longest
            # piece of blanks; only a run's last blank may go with what follows.
            words = f"{BLANK}{{{runs[-1]}}}(?={BLANK})|{words}"

    surface = [
        b"" if k == _CONTROL else bytes([int(n[3:5], 16)]) if k == _BYTE else n.replace(BLANK, " ").encode()
        for n, k in zip(names, kinds, strict=True)
    ]
    unknown = kinds.index(_UNKNOWN)
    surface[unknown] = trainer.get(44, " ⁇ ".encode())
    bytes_from = np.zeros(256, np.uint32)
    for i, k in enumerate(kinds):
        if k == _BYTE:
            bytes_from[surface[i][0]] = i
    return Pieces(
        symbols=symbols,
        characters={ord(c): s for c, s in symbol.items() if len(c) == 1},
        pairs=np.array([r[0] for r in rows], np.int64),
        made=np.array([r[1] for r in rows], np.int32),
        rank=np.array([r[2] for r in rows], np.int32),
        alone=alone,
        beside=np.array(sorted(beside), np.int64),
        surface=surface,
        bytes_from=bytes_from,
        begin=names.index(trainer.get(46, b"<s>").decode()),
        end=names.index(trainer.get(47, b"</s>").decode()),
        unknown=unknown,
        dummy_prefix=bool(normalizer.get(3, 1)),
        words=words,
    )


def _merged_run(sizes: list[int]) -> list[int]:
    """What a run as long as the longest size becomes when pairs merge from the left."""
    run = [1] * sizes[-1]
    while (at := next((i for i in range(len(run) - 1) if run[i] + run[i + 1] in sizes), None)) is not None:
        run[at : at + 2] = [run[at] + run[at + 1]]
    return run


class Encoder:
    """Ids of texts. Distinct words are merged once, many at a time."""

    def __init__(self, pieces: Pieces, known_words: int = KNOWN_WORDS) -> None:
        self.pieces, self.known_words = pieces, known_words
        self.find = re.compile(pieces.words).findall
        self.symbol_of = np.full(0x110000, -1, np.int32)
        self.symbol_of[list(pieces.characters)] = list(pieces.characters.values())
        self.known: dict[str, bytes] = {}
        self.first = np.array([pieces.begin], "<u4").tobytes()
        self.last = np.array([pieces.end], "<u4").tobytes()

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of pairs of symbols."""
        p = self.pieces
        if not len(p.pairs):
            return np.full(len(left), _NEVER), np.zeros(len(left), np.int32)
        key = left.astype(np.int64) * p.symbols + right
        at = np.minimum(np.searchsorted(p.pairs, key), len(p.pairs) - 1)
        there = (p.pairs[at] == key) & (left >= 0) & (right >= 0)
        return np.where(there, p.rank[at], _NEVER), p.made[at]

    def _merged(self, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first character, and symbol, of what is left when no pair remains.

        ``bounds`` are the places where words begin. All words are one flat array of symbols.
        Each round finds the least rank in each word and merges its occurrences, from the
        left and without overlap; words without a pair leave the array.
        """
        p = self.pieces
        symbol = self.symbol_of[codes]
        place = np.arange(len(codes))
        starts = np.zeros(len(codes), bool)
        starts[bounds] = True
        # A word is cut further where no piece has two characters side by side.
        key = symbol[:-1].astype(np.int64) * p.symbols + symbol[1:]
        at = np.minimum(np.searchsorted(p.beside, key), max(0, len(p.beside) - 1))
        beside = (p.beside[at] == key) if len(p.beside) else np.zeros(len(key), bool)
        starts[1:] |= ~beside | (symbol[:-1] < 0) | (symbol[1:] < 0)
        rank = np.full(len(codes), _NEVER)
        made = np.zeros(len(codes), np.int32)
        rank[:-1], made[:-1] = self._pairs(symbol[:-1], symbol[1:])
        rank[np.flatnonzero(starts)[1:] - 1] = _NEVER
        done_places, done_symbols = [], []
        while len(symbol):
            begins = np.flatnonzero(starts)
            least = np.minimum.reduceat(rank, begins)
            sizes = np.diff(np.append(begins, len(symbol)))
            if (ended := least == _NEVER).any():
                gone = np.repeat(ended, sizes)
                done_places.append(place[gone])
                done_symbols.append(symbol[gone])
                stay = ~gone
                symbol, place, starts, rank, made = symbol[stay], place[stay], starts[stay], rank[stay], made[stay]
                if not len(symbol):
                    break
                least, sizes = least[~ended], sizes[~ended]
            chosen = np.flatnonzero(rank == np.repeat(least, sizes))
            word = np.cumsum(starts)[chosen]
            run = np.ones(len(chosen), bool)
            run[1:] = chosen[1:] != chosen[:-1] + 1
            begun = chosen[np.maximum.accumulate(np.where(run, np.arange(len(chosen)), 0))]
            first = np.ones(len(chosen), bool)
            first[1:] = word[1:] != word[:-1]
            chosen = chosen[np.where(p.alone[made[chosen]], (chosen - begun) % 2 == 0, first)]
            symbol[chosen] = made[chosen]
            stay = np.ones(len(symbol), bool)
            stay[chosen + 1] = False
            # Places of the merged symbols once the others have gone, and of those before.
            moved = chosen - np.arange(len(chosen))
            symbol, place, starts, rank, made = symbol[stay], place[stay], starts[stay], rank[stay], made[stay]
            touched = np.zeros(len(symbol), bool)
            touched[moved] = True
            touched[np.maximum(moved - 1, 0)] = True
            fresh = np.flatnonzero(touched)
            inside = fresh[fresh + 1 < len(symbol)]
            rank[fresh] = _NEVER
            rank[inside], made[inside] = self._pairs(symbol[inside], symbol[inside + 1])
            rank[inside[starts[inside + 1]]] = _NEVER
        places, symbols = np.concatenate(done_places), np.concatenate(done_symbols)
        order = np.argsort(places, kind="stable")
        return places[order], symbols[order]

    def learn(self, words: list[str]) -> None:
        """Encode words that are not empty."""
        if not words:
            return
        codes = np.frombuffer("".join(words).encode("utf-32-le", "replace"), np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        bounds = np.cumsum(sizes) - sizes
        places, symbols = self._merged(codes, bounds)
        # Characters that are no piece become their bytes.
        code = codes[places]
        spelt = (symbols < 0) | (symbols >= len(self.pieces.surface))
        width = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
        count = np.where(spelt, width, 1)
        ends = np.cumsum(count)
        ids = np.repeat(symbols, count).astype("<u4")
        if spelt.any():
            raw = np.frombuffer("".join(map(chr, code[spelt])).encode(), np.uint8)
            ids[np.repeat(spelt, count)] = self.pieces.bytes_from[raw]
        data = ids.tobytes()
        cuts = 4 * (ends - count)[np.searchsorted(places, bounds)]
        for word, a, b in zip(words, cuts.tolist(), [*cuts[1:].tolist(), len(data)], strict=True):
            self.known[word] = data[a:b]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids with begin and end, as little-endian unsigned numbers of 32 bits."""
        if len(self.known) > self.known_words:
            self.known.clear()
        prefix = BLANK if self.pieces.dummy_prefix else ""
        cut = [self.find(prefix + t.replace(" ", BLANK)) if t else [] for t in texts]
        known = self.known
        self.learn(list({w for words in cut for w in words if w not in known}))
        return [b"".join([self.first, *map(known.__getitem__, words), self.last]) for words in cut]


def decoded_text(pieces: Pieces, ids: np.ndarray) -> str:
    """The text of some ids. Ids outside the vocabulary are refused."""
    if len(ids) and ids.max() >= len(pieces.surface):
        raise ValueError("an id is not in the vocabulary")
    surface = pieces.surface
    parts = [surface[i] for i in ids.tolist()]
    lead = next((k for k, part in enumerate(parts) if part), None)
    if pieces.dummy_prefix and lead is not None and parts[lead][:1] == b" " and ids[lead] not in pieces.bytes_from:
        if ids[lead] != pieces.unknown:
            parts[lead] = parts[lead][1:]
    if all(parts[1:-1]):
        try:
            return b"".join(parts).decode()
        except UnicodeDecodeError:
            pass
    return _with_broken_bytes(pieces, ids, parts)


def _with_broken_bytes(pieces: Pieces, ids: np.ndarray, parts: list[bytes]) -> str:
    """The text, where bytes that make no character with those beside them become a mark."""
    spelt = np.isin(ids, pieces.bytes_from).tolist()
    out, run = [], bytearray()
    for part, byte in zip([*parts, b""], [*spelt, False], strict=True):
        if byte:
            run += part
            continue
        at = 0
        while at < len(run):
            for n in (1, 2, 3, 4):
                try:
                    out.append(run[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    pass
            else:
                out.append("�")
                at += 1
        run.clear()
        out.append(part.decode())
    return "".join(out)


def encoded(df: DataFrame, model: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the column ``ids``: the ids of each text, packed as files of tokens hold
    them (little-endian unsigned numbers of 32 bits), with those of begin and end around.

    ``model`` is the path of a model file, read on the driver and sent once; its size is
    fixed. Nothing is shuffled. A task keeps the ids of up to ``KNOWN_WORDS`` words and
    merges new words of about a million characters at a time, so copies and frequent words
    cost a lookup. Null texts count as empty: begin and end only. Texts of any length are
    encoded whole; a text of more than a million characters is a batch of its own, and one
    word without a blank takes a round for each of the ranks in it. Other columns are kept
    as they are; ``ids`` replaces a column of that name.
    """
    return _mapped(df, model, text, ids, "binary", lambda pieces: Encoder(pieces).encode, pa.binary())


def decoded(df: DataFrame, model: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``df`` with the column ``text`` of the packed ``ids``; null ids give an empty text."""

    def decoder(pieces: Pieces):
        def run(values: list[bytes | None]) -> list[str]:
            return [decoded_text(pieces, np.frombuffer(v or b"", "<u4")) for v in values]

        return run

    return _mapped(df, model, ids, text, "string", decoder, pa.string())


def _mapped(df: DataFrame, model: str, given: str, made: str, kind: str, prepare, arrow) -> DataFrame:
    """One column computed from another by batches; other columns pass."""
    shared = df.sparkSession.sparkContext.broadcast(read_pieces(model))
    kept = [c for c in df.columns if c != made]
    # Names may clash or hold any character, so columns travel by place.
    rows = df.select(F.col(f"`{given}`").alias("value"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = prepare(shared.value)
        for batch in batches:
            values = batch.column(0).to_pylist()
            for a, b in slices(values):
                rest = [column.slice(a, b - a) for column in batch.columns[1:]]
                names = [f"c{i}" for i in range(len(rest))]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(apply(values[a:b]), arrow)], names=[*names, "value"])

    schema = rows.drop("value").schema.add("value", kind)
    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], F.col("value").alias(made))
