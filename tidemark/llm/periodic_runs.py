"""Periodic runs of words: every maximal stretch that repeats a unit at least so many times, whatever the unit's length.

A run is a maximal stretch with smallest period q, at least ``power`` * q and ``shortest`` words long. The words of a batch of
texts become numbers, texts are set apart by numbers that occur once, and numpy looks through the whole batch at once:

* Short periods (below 4 * ``BLOCK``) by direct lag scans. A run keeps ``word[i] == word[i + q]`` over two units at least, so
  of samples half a least stretch apart two neighbours must agree; only there are words compared one by one.
* Longer periods by minimizers, one scale for each doubling. At scale k a position is kept if its block of k words has the
  least hash of some window of k blocks. Windows one period apart inside a run hold the same blocks, so kept positions repeat at
  distance q; pairs of equal kept blocks 4k to 8k apart are the seeds. A seed is tested by hashes of one unit and then extended
  word by word, so hashes never decide what is a run.

Blocks that have a period of k/3 or less themselves lie in runs that smaller scales have found; they take no part, since they
could hide the others. The blocks left occur less than 24 times in any 8k words, so each is paired with its next 24 equals and
no pair is lost. A primitive unit always has a block that takes part (two periods whose sum fits into the overlap of two
blocks share a divisor).
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.common import map_column

#: Words of a block at the smallest scale; periods below four of them are scanned directly.
BLOCK = 24
#: How many following equal blocks a kept position is paired with: 8k / (k / 3).
PARTNERS = 24
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_MIX = np.uint64(0xD6E8FEB86659FD93)

Run = tuple[int, int, int]


class _Words:
    """The numbered words of a batch, with hashes of any stretch and exact comparison."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.n = ids, len(ids)
        self._sums: np.ndarray | None = None

    def _prepare(self) -> None:
        salted = (self.ids.astype(np.uint64) + np.uint64(1)) * _MIX
        salted ^= salted >> np.uint64(32)
        powers = np.full(self.n, _BASE, np.uint64)
        powers[:1] = 1
        np.cumprod(powers, out=powers)
        self._sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(salted * powers, out=self._sums[1:])
        self._back = np.full(self.n + 1, _BACK, np.uint64)
        self._back[:1] = 1
        np.cumprod(self._back, out=self._back)

    def hashes(self, at: np.ndarray | slice, length: np.ndarray | int) -> np.ndarray:
        """Hash of the ``length`` words from each position; equal stretches have equal hashes."""
        if self._sums is None:
            self._prepare()
        if isinstance(at, slice):
            return (self._sums[length:] - self._sums[: self.n + 1 - length]) * self._back[: self.n + 1 - length]
        return (self._sums[at + length] - self._sums[at]) * self._back[at]

    def reach(self, at: int, lag: int) -> tuple[int, int]:
        """The stretch [a, b) around ``at`` in which every word equals the one ``lag`` later; empty if not even ``at`` does."""
        ids, step, b = self.ids, 64, at
        while b < self.n - lag:
            stop = min(b + step, self.n - lag)
            differ = np.flatnonzero(ids[b:stop] != ids[b + lag : stop + lag])
            if len(differ):
                b += int(differ[0])
                break
            b, step = stop, step * 2
        a, step = at, 64
        while a > 0:
            start = max(a - step, 0)
            differ = np.flatnonzero(ids[start:a] != ids[start + lag : a + lag])
            if len(differ):
                a = start + int(differ[-1]) + 1
                break
            a, step = start, step * 2
        return a, b

    def primitive(self, at: int, period: int) -> bool:
        """Whether the unit of ``period`` words from ``at`` is no repetition of a shorter one."""
        return not any(np.array_equal(self.ids[at : at + period - d], self.ids[at + d : at + period]) for d in _maximal_divisors(period))


def _maximal_divisors(n: int) -> list[int]:
    """n / p for each prime p of n: a unit with any shorter period that divides n has one of these."""
    out, rest, p = [], n, 2
    while p * p <= rest:
        if rest % p == 0:
            out.append(n // p)
            while rest % p == 0:
                rest //= p
        p += 1
    return out + ([n // rest] if rest > 1 else [])


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every window of ``width``, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _sliding_max(values: np.ndarray, width: int) -> np.ndarray:
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.maximum(out[:-step], out[step:])
        have += step
    return out


def _follow(words: _Words, seeds: np.ndarray, lag: int, found: list[Run]) -> None:
    """Extend ascending seeds of one lag; those inside a stretch already seen are jumped over."""
    at = 0
    while at < len(seeds):
        a, b = words.reach(int(seeds[at]), lag)
        length = b - a + lag
        if b > a and length >= max(BLOCK, 3 * lag) and words.primitive(a, lag):
            found.append((a, length, lag))
        at = int(np.searchsorted(seeds, max(b, int(seeds[at]) + 1)))


def _lag_scan(words: _Words, lag: int, found: list[Run]) -> None:
    least = max(BLOCK - lag, 2 * lag)  # words that agree with the word one lag later
    if words.n < least + lag:
        return
    step = max(least // 2, 1)
    same = words.ids[: words.n - lag : step] == words.ids[lag :: step]
    seeds = np.flatnonzero(same[:-1] & same[1:]) * step
    for part in (step // 2, step // 4, 3 * step // 4):  # words between two samples of one stretch agree as well
        if len(seeds):
            seeds = seeds[words.ids[seeds + part] == words.ids[seeds + part + lag]]
    _follow(words, seeds, lag, found)


def _covered(n: int, size: int, runs: list[Run], most: int) -> np.ndarray:
    """Which block starts lie wholly inside a run of period ``most`` or less."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        if period <= most and length >= size:
            edges[start] += 1
            edges[start + length - size + 1] -= 1
    return np.cumsum(edges[:-1]) > 0


def _minimizer_scan(words: _Words, size: int, found: list[Run]) -> None:
    """Runs with periods from 4 to 8 ``size`` (the latter not included)."""
    n = words.n
    if n < 12 * size:
        return
    blocks = words.hashes(slice(None), size) * _MIX
    blocks ^= blocks >> np.uint64(29)
    never = np.uint64(2**64 - 1)
    np.minimum(blocks, never - np.uint64(1), out=blocks)
    blocks[_covered(len(blocks), size, found, size // 3)] = never
    least = _sliding_min(blocks, size)
    # the largest of the minima of all windows around a position; at the ends fewer windows reach it
    padded = np.concatenate([np.zeros(size - 1, np.uint64), least, np.zeros(size - 1, np.uint64)])
    kept = np.flatnonzero((_sliding_max(padded, size) == blocks) & (blocks != never))
    order = kept[np.argsort(blocks[kept], kind="stable")]
    values = blocks[order]
    seeds, lags = [], []
    for ahead in range(1, min(PARTNERS, len(order) - 1) + 1):
        apart = order[ahead:] - order[:-ahead]
        fits = (values[ahead:] == values[:-ahead]) & (apart >= 4 * size) & (apart < 8 * size)
        seeds.append(order[:-ahead][fits])
        lags.append(apart[fits])
    if not seeds:
        return
    at, lag = np.concatenate(seeds), np.concatenate(lags)
    ahead = np.zeros(len(at), bool)
    room = at + 2 * lag <= n
    ahead[room] = words.hashes(at[room], lag[room]) == words.hashes(at[room] + lag[room], lag[room])
    room = (at >= lag) & (at + lag <= n) & ~ahead
    ahead[room] = words.hashes(at[room] - lag[room], lag[room]) == words.hashes(at[room], lag[room])
    at, lag = at[ahead], lag[ahead]
    order = np.lexsort((at, lag))
    at, lag = at[order], lag[order]
    cuts = np.flatnonzero(np.diff(lag)) + 1
    for positions, same in zip(np.split(at, cuts), np.split(lag, cuts)):
        if len(same):
            _follow(words, positions, int(same[0]), found)


def find_runs(ids: np.ndarray, power: int = 3, shortest: int = 24, longest: int | None = None) -> list[Run]:
    """(start, length, period) of all runs of a sequence of numbers, by start and period; none is longer than ``longest``.

    The search itself always looks for three units and ``BLOCK`` words, since larger scales rely on what it finds.
    """
    if power < 3 or shortest < BLOCK:
        raise ValueError(f"runs of at least 3 units and {BLOCK} words are found")
    words, found, longest = _Words(ids), [], len(ids) if longest is None else longest
    for lag in range(1, min(4 * BLOCK, longest // 3 + 1)):
        _lag_scan(words, lag, found)
    size = BLOCK
    while 12 * size <= longest:
        _minimizer_scan(words, size, found)
        size *= 2
    return sorted({r for r in found if r[1] >= max(shortest, power * r[2])}, key=lambda r: (r[0], r[2]))


def runs_of_texts(texts: list[list[bytes]], power: int, shortest: int) -> list[list[Run]]:
    """The runs of each of several sequences, found together; a scale sees only the sequences long enough for it."""
    numbers: dict[bytes, int] = {}
    number = numbers.setdefault
    rows = [np.fromiter((number(w, len(numbers)) for w in words), np.int64, len(words)) for words in texts]
    out: list[list[Run]] = [[] for _ in texts]
    for low, high in _lengths(max((len(r) for r in rows), default=0), shortest):
        chosen = [i for i, r in enumerate(rows) if low <= len(r) < high]
        if not chosen:
            continue
        parts, starts, at = [], [], 0
        for k, i in enumerate(chosen):
            starts.append(at)
            parts += [rows[i], np.array([-1 - k], np.int64)]
            at += len(rows[i]) + 1
        for start, length, period in find_runs(np.concatenate(parts), power, shortest, max(len(rows[i]) for i in chosen)):
            k = int(np.searchsorted(starts, start, "right")) - 1
            out[chosen[k]].append((start - starts[k], length, period))
    return out


def _lengths(longest: int, shortest: int) -> Iterator[tuple[int, int]]:
    """Classes of like length, so that a long text does not put its scales upon the short ones."""
    low, high = shortest, 12 * BLOCK
    while low <= longest:
        yield low, high
        low, high = high, high * 4


def strongest(runs: list[Run]) -> Run | None:
    """The run with the greatest length / period; ties to the smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None


def collapse(words: list[bytes], runs: list[Run]) -> bytes:
    """The words joined by one space, without those that some run holds after its first unit."""
    if not runs:
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)])


_RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
FIELDS = [T.StructField("runs", T.ArrayType(_RUN)), T.StructField("strongest", _RUN), T.StructField("collapsed", T.StringType())]


def periodic_runs(docs: DataFrame, *, text: str = "text", power: int = 3, shortest: int = 24, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default) with ``runs``, the ``strongest`` run and the ``collapsed`` text of every whole text.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A null or empty text has no runs, a null ``strongest`` and an empty
    ``collapsed``. Repeated rows stay; a kept column named like a new one gives way to it. Map only: texts meet in a batch for
    speed alone, and runs never reach from one into another.
    """

    def make():
        def work(texts: list) -> dict:
            words = [(t or "").encode().split() for t in texts]
            runs = runs_of_texts(words, power, shortest)
            named = lambda r: None if r is None else dict(zip(("start", "length", "period"), r))
            return {
                "runs": [[named(r) for r in rs] for rs in runs],
                "strongest": [named(strongest(rs)) for rs in runs],
                "collapsed": pa.array([collapse(w, rs) for w, rs in zip(words, runs)], pa.binary()).cast(pa.string()),
            }

        return work

    return map_column(docs, text, FIELDS, make, keep)
