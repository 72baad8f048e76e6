"""Token counts by byte-pair merging on a heap and a linked list; no identifier is ever looked up.

The symbols of a piece of text form a doubly linked list. A heap holds the adjacent pairs that the vocabulary knows as one
token, lowest rank first and leftmost first among equals. Each pop joins a pair and queues the two new neighbours. The count is
the number of symbols at the start minus the number of merges; a character that is not in the vocabulary starts as its UTF-8
bytes and loses them all when it is merged.

Two kinds of vocabulary are read: sentence-piece models (BPE with byte fallback and the identity normaliser) and rank files of
byte-level tokenizers. Text is cut only where no token of the vocabulary can reach across, which is found from the vocabulary.
"""

from __future__ import annotations

import base64
import heapq
import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.common import map_column

SPACE = "▁"
#: Counts of short pieces kept per worker, in two generations: a full one replaces the older.
PIECES_KEPT, PIECE_CHARS = 200_000, 48
#: Piece types of a sentence-piece model.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


@dataclass(frozen=True)
class Vocabulary:
    """``ranks``: token to rank, low first, equal ranks allowed. ``pattern``: what is merged on its own, or None for a model.

    ``fallback``: characters outside ``ranks`` count as their UTF-8 bytes (else as one token).
    """

    ranks: dict[str, float]
    pattern: str | None
    fallback: bool


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of one protocol-buffer message."""
    at = 0

    def number() -> int:
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
        field, kind = divmod(number(), 8)
        if kind == 0:
            yield field, number()
        elif kind == 2:
            length = number()
            at += length
            yield field, data[at - length : at]
        else:
            width = {1: 8, 5: 4}[kind]
            at += width
            yield field, struct.unpack("<d" if width == 8 else "<f", data[at - width : at])[0]


def read_model(path: str) -> Vocabulary:
    """A sentence-piece BPE model. Models with another normaliser, user-defined or unused pieces are refused."""
    ranks: dict[str, float] = {}
    trainer: dict = {}
    normaliser: dict = {}
    with open(path, "rb") as file:
        for field, value in _fields(file.read()):
            if field == 1:
                piece = dict(_fields(value))
                kind = piece.get(3, NORMAL)
                if kind == NORMAL:
                    ranks[piece[1].decode()] = -piece.get(2, 0.0)
                elif kind not in (UNKNOWN, CONTROL, BYTE):
                    raise ValueError(f"pieces of type {kind} are not supported")
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normaliser = dict(_fields(value))
    if trainer.get(3, 1) != 2 or trainer.get(24, 0):
        raise ValueError("only BPE models with the space before the word are supported")
    if normaliser.get(1) != b"identity" or not normaliser.get(3, 1) or normaliser.get(4, 1) or not normaliser.get(5, 1):
        raise ValueError("only the identity normaliser with a space in front is supported")
    return Vocabulary(ranks, None, bool(trainer.get(35, 0)))


def read_ranks(path: str, pattern: str) -> Vocabulary:
    """A rank file of a byte-level tokenizer; bytes stand as the characters of the same number."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    return Vocabulary({base64.b64decode(t).decode("latin-1"): float(r) for t, r in pairs}, pattern, False)


def merge_count(symbols: str, ranks: dict[str, float], start: list[int]) -> int:
    """Tokens left of ``symbols`` after all merges; ``start`` is how many tokens each symbol is before the first one."""
    n = len(symbols)
    end = list(range(1, n + 1))  # a symbol starting at i reaches to end[i]; 0: merged into its left neighbour
    before = list(range(-1, n - 1))
    left = sum(start)
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(symbols[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= stop or end[middle] != stop:
            continue  # one of the two has been merged since
        left -= start[i] + start[middle] - 1
        start[i], end[i], end[middle] = 1, stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(symbols[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if i:
            b = before[i]
            if (r := ranks.get(symbols[b:stop])) is not None:
                heapq.heappush(heap, (r, b, stop))
    return left


class Counter:
    """Counts the tokens of whole texts."""

    def __init__(self, vocabulary: Vocabulary):
        self.ranks, self.fallback = vocabulary.ranks, vocabulary.fallback
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}
        if vocabulary.pattern is not None:
            cut = regex.compile(vocabulary.pattern).findall
            self.pieces: Callable[[str], list[str]] = lambda text: [p.encode().decode("latin-1") for p in cut(text)]
        else:
            cut = re.compile(self._cuts()).findall
            self.pieces = lambda text: cut(SPACE + text.replace(" ", SPACE)) if text else []

    def _cuts(self) -> str:
        """A character inside no token of two or more stands alone; a space sign starts a piece unless some token has one further in."""
        long = [t for t in self.ranks if len(t) > 1]
        inside = "".join(sorted({c for t in long for c in t} - {SPACE}))
        marked = re.escape(inside)
        if not inside:
            return f"{SPACE}+|[^{SPACE}]"
        if any(a != SPACE and b == SPACE for t in long for a, b in zip(t, t[1:])):
            return f"[{marked}{SPACE}]+|[^{marked}{SPACE}]"
        return f"{SPACE}*[{marked}]+|{SPACE}+|[^{marked}{SPACE}]"

    def _fresh(self, piece: str) -> int:
        n = self.older.get(piece)
        if n is None:
            ranks = self.ranks
            n = merge_count(piece, ranks, [1 if not self.fallback or c in ranks else len(c.encode()) for c in piece])
        if len(self.known) >= PIECES_KEPT:
            self.older, self.known = self.known, {}
        if len(piece) <= PIECE_CHARS:
            self.known[piece] = n
        return n

    def count(self, text: str) -> int:
        known, fresh = self.known.get, self._fresh
        total = 0
        for piece in self.pieces(text):
            n = known(piece)
            if n is None:
                n = fresh(piece)
                known = self.known.get
            total += n
        return total


_COUNTERS: dict[int, tuple[Vocabulary, Counter]] = {}


def _counter(vocabulary: Vocabulary) -> Counter:
    """One counter per Python worker and vocabulary, so that later tasks find it warm."""
    key = hash((len(vocabulary.ranks), vocabulary.pattern, frozenset(list(vocabulary.ranks.items())[:1000])))
    if key not in _COUNTERS or _COUNTERS[key][0] != vocabulary:
        _COUNTERS.clear()
        _COUNTERS[key] = vocabulary, Counter(vocabulary)
    return _COUNTERS[key][1]


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, *, text: str = "text", limit: int = 4096, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default) with n_bytes, n_tokens and whether these are more than ``limit``, of every whole text.

    A null or empty text has 0 of both. Repeated rows stay; a kept column named like a new one gives way to it. Map only: the
    vocabulary is broadcast (its size is that of the file), the rest is one text at a time.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        counter = _counter(shared.value)

        def work(texts: list) -> dict:
            n = [counter.count(t) if t else 0 for t in texts]
            return {"n_bytes": [len(t.encode()) if t else 0 for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

        return work

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return map_column(docs, text, fields, make, keep)
