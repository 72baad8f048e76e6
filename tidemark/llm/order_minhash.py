"""Order MinHash fingerprints of whole texts.

A text is read as its k-mers of code points, each numbered by how often it has occurred before. The digest of (k-mer, number)
puts it into one of ``slots`` groups and ranks it there. Each slot selects its ``ell`` smallest; a slot with fewer borrows the
smallest of the slots that follow, after the last the first ones, so that it carries an order too. The selected are put back into
the order in which they stand in the text and the tuple is hashed; only a text of fewer than ``ell`` k-mers has shorter tuples. A
slot without k-mers of its own stays empty. Two texts agree in a slot when they select the same k-mers *in the same
order*, so moved, inserted and deleted passages all cost, as in edit distance. Likeness is the share of slots that agree among
those that either text fills; two texts without any k-mer are alike in full.

Texts shorter than ``k`` are one k-mer; empty and null texts fill no slot. Equal texts have equal fingerprints. Every code point
is read, whatever the length.

:func:`with_next_edits` pairs each document with the next one in descending id order (after the last comes the first). Rows go
to ranges of ids in one shuffle, each range with one guard row, the first of the range after it; a task streams its ranges in
order and holds two texts at a time. Repeated ids follow each other by text; null ids come last. Other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import text_batches

K = 5
ELL = 2
SLOTS = 64
#: Documents per range of ids; the number of ranges ends at MAX_RANGES, from where ranges are longer streams.
RANGE_ROWS = 2_000
MAX_RANGES = 4_096
PLACE_BITS = 24

_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Powers:
    """Powers of the base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            top, low = self.up[-1] * _BASE, self.down[-1] * _INVERSE
            self.up, self.down = np.concatenate([self.up, self.up * top]), np.concatenate([self.down, self.down * low])
        return self.up[:n], self.down[:n]


_POWERS = Powers()


def kmer_digests(codes: np.ndarray, k: int) -> np.ndarray:
    """One digest per window of ``k`` code points, equal for equal windows."""
    with np.errstate(over="ignore"):
        k = min(k, len(codes))
        up, down = _POWERS.get(len(codes) + 1)
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes + np.uint64(1)) * up[1:], out=total[1:])
        return (total[k:] - total[:-k]) * down[: len(codes) - k + 1]


def numbered_kmers(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of (k-mer, how often it has stood before), and the place of each; in no order.

    The upper bits of the digest and the place share one sorted word, so that equal k-mers stand together in text order after
    a plain sort; a text with more places than fit is sorted by digest, stably.
    """
    index = np.arange(len(digests), dtype=np.uint64)
    if len(digests) >> PLACE_BITS:
        place = np.argsort(digests >> np.uint64(PLACE_BITS), kind="stable").astype(np.uint64)
        mer = (digests >> np.uint64(PLACE_BITS))[place]
    else:
        word = digests >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS) | index
        word.sort()
        mer, place = word >> np.uint64(PLACE_BITS), word & np.uint64((1 << PLACE_BITS) - 1)
    start = np.where(np.append(True, mer[1:] != mer[:-1]), index, np.uint64(0))
    with np.errstate(over="ignore"):
        return _mix(mer + (index - np.maximum.accumulate(start)) * _BASE), place


def signature(text: str, k: int = K, ell: int = ELL, slots: int = SLOTS) -> np.ndarray:
    """``slots`` hashes; 0 marks a slot without k-mers. ``slots`` is a power of two."""
    out = np.zeros(slots, np.uint32)
    if not text:
        return out
    with np.errstate(over="ignore"):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        mers, places = numbered_kmers(kmer_digests(codes, k))
        shift = np.uint64(64 - (slots.bit_length() - 1))
        # far more k-mers than can be selected: look at the low ranks first, at all only where some slot then lacks any
        if len(mers) > 32 * slots:
            low = np.flatnonzero(mers << (np.uint64(64) - shift) < np.uint64((1 << 64) // (len(mers) // (16 * slots))))
            if len(low) and np.bincount((mers[low] >> shift).astype(np.int64), minlength=slots).min() >= ell:
                mers, places = mers[low], places[low]
        order = np.argsort(mers)
        ranked, places = mers[order], places[order]
        edges = np.searchsorted(ranked, np.arange(slots, dtype=np.uint64) << shift)
        own = np.append(edges[1:], len(ranked)) > edges
        # the selected of each slot, or the next in rank where it has too few, put back into text order; padded at the end
        picks = (edges[:, None] + np.arange(ell)[None, :]) % len(ranked)
        filled = own[:, None] & (np.arange(ell) < len(ranked))[None, :]
        spots = np.where(filled, places[picks].astype(np.int64), np.iinfo(np.int64).max)
        values = np.where(filled, ranked[picks], np.uint64(0))
        values = np.take_along_axis(values, np.argsort(spots, axis=1, kind="stable"), axis=1)
        hashed = np.zeros(slots, np.uint64)
        for column in range(ell):
            hashed = _mix(hashed * _BASE + values[:, column])
        hashed = (hashed >> np.uint64(32)).astype(np.uint32)
        return np.where(own, np.maximum(hashed, 1), 0).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    filled = (a != 0) | (b != 0)
    return float((a == b)[filled].mean()) if filled.any() else 1.0


def as_text(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last third of ``text`` replaced by as much of the start of ``following`` as there is."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _range_of(value: Column, cuts: list[int]) -> Column:
    """Number of cuts at or below ``value``, by binary search."""
    if not cuts:
        return F.lit(0)
    held = F.array(*[F.lit(c).cast("long") for c in cuts])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])

    def halve(found: Column, step: Column) -> Column:
        probe = found + step
        return F.when((probe <= len(cuts)) & (F.get(held, probe - 1) <= value), probe).otherwise(found)

    return F.aggregate(steps, F.lit(0), halve)


OUT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])


def with_next_edits(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = K, ell: int = ELL, slots: int = SLOTS) -> DataFrame:
    """Per row of ``docs``: its fingerprint, that of the text edited with the next document, and both likenesses."""
    spark = text_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = rows.count()
    ranges = max(1, min(MAX_RANGES, -(-n // RANGE_ROWS)))
    cuts: list[int] = []
    if ranges > 1:
        found = rows.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0]
        cuts = sorted(set(found or []))
    rows = rows.withColumn("_b", F.when(F.col("doc_id").isNull(), -1).otherwise(_range_of(F.col("doc_id"), cuts)))
    # the first row of each range also guards the end of the range before it; ranges are at most MAX_RANGES + 1
    tops = rows.groupBy("_b").agg(F.max("doc_id").alias("top")).orderBy(F.col("_b").desc()).collect()
    firsts = [(tops[i]["_b"], tops[i]["top"], tops[i - 1]["_b"]) for i in range(len(tops))]
    guards = F.broadcast(spark.createDataFrame(firsts, "_gb int, _top long, _to int"))
    rows = rows.join(guards, (F.col("_b") == F.col("_gb")) & F.col("doc_id").eqNullSafe(F.col("_top")), "left")
    own = F.struct(F.col("_b").alias("b"), F.lit(False).alias("guard"))
    sent = F.when(F.col("_to").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("_to").alias("b"), F.lit(True).alias("guard"))))
    rows = rows.select("doc_id", "text", F.explode(sent).alias("_s")).select(F.col("_s.b").alias("b"), F.col("_s.guard").alias("guard"), "doc_id", "text")
    rows = rows.repartition(max(1, len(tops)), "b").sortWithinPartitions("b", "guard", F.col("doc_id").desc_nulls_last(), "text")
    names = OUT.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *[(c, pa.string()) for c in names[2:5]], ("near_edited", pa.float64()), ("near_next", pa.float64())])
        waiting = None
        for batch in batches:
            out: list[tuple] = []
            for b, guard, ident, t in zip(*(batch.column(c).to_pylist() for c in ("b", "guard", "doc_id", "text"))):
                if guard and waiting is None:
                    continue
                sig = signature(t, k, ell, slots)
                if waiting is not None:
                    _, wid, wtext, wsig = waiting
                    new = edited(wtext, t)
                    nsig = signature(new, k, ell, slots)
                    out.append((wid, len(wtext), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), as_text(wsig), as_text(nsig), likeness(wsig, nsig), likeness(wsig, sig)))
                waiting = None if guard else (b, ident, t, sig)
            yield pa.RecordBatch.from_pydict({c: [r[i] for r in out] for i, c in enumerate(names)}, schema=schema)

    return rows.mapInArrow(run, OUT)
