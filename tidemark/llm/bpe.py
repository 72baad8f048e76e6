"""Byte-level BPE encoding and decoding.

The merges are compiled into a finite-state transducer over bytes. Two facts make that possible. A sequence of tokens is the
BPE encoding of its bytes exactly when every two neighbours encode to themselves; and every prefix of a piece has one
encoding. So a nondeterministic machine may guess where tokens start, and needs only the token before each guess. Its
deterministic form is made lazily: a state is the set of open guesses, each a place in the token trie. How long a guess stays
open is bounded by the longest token; what all open guesses agree on leaves the machine.

Null texts count as empty and give no ids. Texts of any length are read whole. Ids outside the vocabulary cannot be decoded
(``KeyError``). Repeated rows give repeated results; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.common import map_column

#: Sizes at which a worker's tables start anew: remembered pieces (the generation before stays), states, checked pairs.
PIECES_KEPT = 300_000
STATES_KEPT = 200_000
PAIRS_KEPT = 2_000_000
#: Bytes of one piece after which the tokens that all guesses share leave the machine.
AGREE_AFTER = 4096
#: Ids that the decoder joins before they pass the UTF-8 machine.
DECODE_STEP = 4096


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank from a file of ``base64 rank`` lines."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * (max(int(r) for _, r in pairs) + 1)
    for text, rank in pairs:
        tokens[int(rank)] = base64.b64decode(text)
    return tokens


class Transducer:
    """Bytes of one piece in, token ids out; deterministic states are made when first reached.

    A state is the set of trie nodes of all open guesses; with the nodes fixed, so are the tokens that may end after the next
    byte. Which of them does end is settled by the token before its start, kept for each position still open.
    """

    ROOT = 0

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens) if t}
        self.next: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for t, i in self.rank.items():
            at = self.ROOT
            for byte in t:
                step = self.next[at].get(byte)
                if step is None:
                    step = self.next[at][byte] = len(self.next)
                    self.next.append({})
                    self.ends.append(-1)
                at = step
            self.ends[at] = i
        self.longest = max(map(len, self.rank))
        self.fits: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.states: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.moves: dict[int, tuple[int, tuple[tuple[int, int], ...]]] = {}
        self._state((self.ROOT,))

    def _state(self, nodes: tuple[int, ...]) -> int:
        found = self.numbers.get(nodes)
        if found is None:
            found = self.numbers[nodes] = len(self.states)
            self.states.append(nodes)
        return found

    def merge(self, data: bytes) -> list[bytes]:
        """The definition: join the neighbouring parts of lowest rank, leftmost first, until no pair is a token."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while True:
            ranked = [(r, i) for i in range(len(parts) - 1) if (r := self.rank.get(parts[i] + parts[i + 1])) is not None]
            if not ranked:
                return parts
            _, i = min(ranked)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def fit(self, left: int, right: int) -> bool:
        """May ``right`` follow ``left``? With ``left`` -1, at the start of a piece: is ``right`` its own encoding?"""
        key = (left + 1) << 20 | right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= PAIRS_KEPT:
                self.fits.clear()
            own = [self.tokens[right]] if left < 0 else [self.tokens[left], self.tokens[right]]
            known = self.fits[key] = self.merge(b"".join(own)) == own
        return known

    def _move(self, state: int, byte: int) -> tuple[int, tuple[tuple[int, int], ...]]:
        """The next state, and (length, id) of the tokens that may end with ``byte``, longest first."""
        live, ends = [], []
        for node in self.states[state]:
            node = self.next[node].get(byte)
            if node is None:
                continue
            if self.next[node]:
                live.append(node)
            token = self.ends[node]
            if token >= 0 and self.fit(-1, token):
                ends.append((len(self.tokens[token]), token))
        move = self.moves[state << 8 | byte] = (self._state((*live, self.ROOT)), tuple(ends))
        return move

    def encode(self, piece: bytes) -> list[int]:
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > STATES_KEPT:
            self._reset()
        moves, fits, out = self.moves, self.fits, []
        state, last = 0, [-1]
        for byte in piece:
            move = moves.get(state << 8 | byte) or self._move(state, byte)
            state = move[0]
            for length, token in move[1]:
                before = last[-length]
                fit = fits.get((before + 1) << 20 | token)
                if fit or (fit is None and self.fit(before, token)):
                    break
            else:
                raise ValueError("the vocabulary lacks a single byte")
            last.append(token)
            if len(last) > AGREE_AFTER:
                last = self._agree(last, out)
        return out + self._path(last)

    def _path(self, last: list[int]) -> list[int]:
        """Tokens up to the last position."""
        at, tokens = len(last) - 1, []
        while at > 0:
            tokens.append(last[at])
            at -= len(self.tokens[last[at]])
        return tokens[::-1]

    def _agree(self, last: list[int], out: list[int]) -> list[int]:
        """Emit the tokens that all open guesses share; what stays behind is bounded by the longest token."""
        common: set[int] | None = None
        for at in range(max(0, len(last) - 1 - self.longest), len(last)):
            way = {0}
            while at > 0:
                way.add(at)
                at -= len(self.tokens[last[at]])
            common = way if common is None else common & way
        at = max(common)
        out += self._path(last[: at + 1])
        return last[at:]


class Utf8Stream:
    """Incremental UTF-8: holds back an unfinished sequence until its bytes have come; what can never be a character becomes U+FFFD."""

    def __init__(self):
        self.rest = b""

    def feed(self, data: bytes, last: bool = False) -> str:
        data = self.rest + data
        open_at = len(data) if last else len(data) - self._unfinished(data)
        self.rest = data[open_at:]
        return data[:open_at].decode("utf-8", "replace")

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """Bytes at the end that start a character and lack some of it."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte >= 0xC0:
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                return back if need > back else 0
            if byte < 0x80:
                return 0
        return 0


class Codec:
    """Whole texts to ids and back. ``pattern`` cuts a text into the pieces that are encoded on their own."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import regex

        self.tokens = tokens
        self.machine = Transducer(tokens)
        self.pieces = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _packed(self, piece: str) -> bytes:
        if len(self.known) >= PIECES_KEPT:
            self.older, self.known = self.known, {}
        packed = self.older.get(piece) or array("I", self.machine.encode(piece.encode())).tobytes()
        if len(piece) <= 64:
            self.known[piece] = packed
        return packed

    def encode(self, text: str) -> np.ndarray:
        packed = self._packed
        return np.frombuffer(b"".join([self.known.get(p) or packed(p) for p in self.pieces(text)]), "I").astype("<u4", copy=False)

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        stream, token = Utf8Stream(), self.tokens.__getitem__
        ids = ids.tolist() if isinstance(ids, np.ndarray) else list(ids)
        for at in range(0, len(ids), DECODE_STEP):
            yield stream.feed(b"".join(map(token, ids[at : at + DECODE_STEP])))
        yield stream.feed(b"", last=True)

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_stream(ids))


_CODECS: dict[tuple, Codec] = {}


def _codec(tokens: list[bytes], pattern: str) -> Codec:
    """One codec per Python worker, so that tasks after the first find the machine warm."""
    key = (hashlib.sha256(b"\0".join(tokens)).digest(), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(tokens, pattern)
    return _CODECS[key]


def _shared(df: DataFrame, path: str):
    """The vocabulary as a broadcast of fixed size; executors need no file of their own."""
    return df.sparkSession.sparkContext.broadcast(read_ranks(path))


def encode_documents(docs: DataFrame, path: str, pattern: str, *, text: str = "text", out: str = "ids") -> DataFrame:
    """All columns of ``docs`` and the array ``out`` of token ids of the whole text."""
    vocabulary = _shared(docs, path)

    def make():
        codec = _codec(vocabulary.value, pattern)
        return lambda texts: {out: [codec.encode(t or "").astype("int32") for t in texts]}

    return map_column(docs, text, [T.StructField(out, T.ArrayType(T.IntegerType()))], make)


def decode_documents(rows: DataFrame, path: str, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of ``rows`` and the text ``out`` that the array ``ids`` stands for; a null array gives an empty text."""
    vocabulary = _shared(rows, path)

    def make():
        codec = _codec(vocabulary.value, "(?!)")
        return lambda arrays: {out: [codec.decode(a or []) for a in arrays]}

    return map_column(rows, ids, [T.StructField(out, T.StringType())], make)


def round_trip_digests(docs: DataFrame, path: str, pattern: str, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` with n_tokens, the digest of the ids and the digest of the text decoded from them, in one pass over the texts."""
    vocabulary = _shared(docs, path)

    def make():
        codec = _codec(vocabulary.value, pattern)

        def work(texts: list) -> dict:
            n, a, b = [], [], []
            for t in texts:
                ids = codec.encode(t or "")
                back = hashlib.sha256()
                for chunk in codec.decode_stream(ids):
                    back.update(chunk.encode())
                n.append(len(ids))
                a.append(hashlib.sha256(ids.tobytes()).hexdigest())
                b.append(back.hexdigest())
            return {"n_tokens": n, "ids_sha256": a, "decoded_sha256": b}

        return work

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return map_column(docs, text, fields, make, keep)
