"""Near-duplicate texts by SimHash.

Fingerprints are majority votes over the hashes of 4-word shingles. Two fingerprints link when they differ in at most ``radius``
bits, and a document's component is what it reaches over links.

Search. A fingerprint is cut into segments of two bits and mapped to the number of ones in each. The Manhattan distance of two
such count vectors never exceeds the number of differing bits, so it bounds the search from below. Counts are written in unary
(one bit for "at least one", one for "two"), which makes that distance the number of differing bits of two longs. The grid: the
coordinates are dealt into ``groups``; vectors within ``radius`` agree on all but ``radius`` groups at most, so they meet in a
cell of one of the ``C(groups, radius)`` projections. Within a cell the Manhattan bound is tested, then the bits themselves.

No cell is expanded into all its pairs. Copies of a fingerprint count once. Each cell's members are first compared with one
pivot of the cell, chosen anew per cell, and what links is made one component. Then only pairs of different components are
compared: in each cell, the members outside the component that is most frequent there meet the others. A crowd of near copies
thus costs as many comparisons as it has members, and every link between different components is still tested.

Cells are merged, never broadcast: Spark sizes them as the points before they are laid out, a seventieth of what they hold.
"""

from __future__ import annotations

from itertools import combinations
from operator import itemgetter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import components, map_column, written

SHINGLE = 4
SEED = 42
RADIUS = 4
GROUPS = 8
#: Rounds of pivots before components are compared; it sets the work only, not the result.
PIVOT_ROUNDS = 2
#: Shingles whose hashes are held at a time.
CHUNK = 50_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of the whole text; 0 without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(shingle, len(words))
    first, last = starts[: len(words) - size + 1], ends[size - 1 :]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(first), CHUNK):
        pairs = zip(first[at : at + CHUNK].tolist(), last[at : at + CHUNK].tolist())
        hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in pairs], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(first)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None, out: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint as a signed long."""

    def make():
        return lambda texts: {out: [f - (1 << 64) if f >= 1 << 63 else f for f in map(fingerprint, texts)]}

    return map_column(docs, text, [T.StructField(out, T.LongType())], make, keep)


def thermometer(fp: Column) -> Column:
    """Ones per two-bit segment in unary, as a long."""
    odd = F.lit(0x5555555555555555)
    high = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(high).bitwiseAND(odd).bitwiseOR(F.shiftleft(fp.bitwiseAND(high).bitwiseAND(odd), 1))


def manhattan(a: Column, b: Column) -> Column:
    """Distance of two count vectors in unary: a lower bound of the differing bits of their fingerprints."""
    return F.bit_count(a.bitwiseXOR(b))


def projections(groups: int, radius: int) -> list[int]:
    """Masks over the unary counts: every choice of ``groups - radius`` groups of segments, as signed longs."""
    masks = [sum(3 << (2 * s) for s in range(g, 32, groups)) for g in range(groups)]
    full = [sum(pick) for pick in combinations(masks, groups - radius)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in full]


def _cells(points: DataFrame, groups: int, radius: int) -> DataFrame:
    """``points`` (fp, ...) once for each projection, with the cell it falls into. Colliding cell hashes only add comparisons."""
    masks = F.array(*[F.lit(m) for m in projections(groups, radius)])
    rows = points.select("*", F.posexplode(masks).alias("_p", "_mask"))
    return rows.select(*points.columns, F.xxhash64("_p", thermometer(F.col("fp")).bitwiseAND(F.col("_mask"))).alias("cell"))


def _near(a: str, b: str, radius: int) -> Column:
    x, y = F.col(a), F.col(b)
    return (manhattan(thermometer(x), thermometer(y)) <= radius) & (F.bit_count(x.bitwiseXOR(y)) <= radius)


def _relabel(points: DataFrame, links: DataFrame) -> DataFrame:
    """Points with their labels replaced after the links between labels are merged."""
    merged = components(links, "a", "b").select(F.col("node").alias("label"), F.col("label").alias("_to"))
    return written(points.join(merged, "label", "left").select("fp", F.coalesce("_to", "label").alias("label")), "points")


def link_components(fps: DataFrame, *, radius: int = RADIUS, groups: int = GROUPS) -> DataFrame:
    """``(fp, label)`` for distinct fingerprints ``fps``: equal labels exactly where links lead from one to the other."""
    if not 0 <= radius < groups <= 32:
        raise ValueError("0 <= radius < groups <= 32 is asked for")
    points = written(fps.select("fp", F.col("fp").alias("label")), "points")
    for turn in range(PIVOT_ROUNDS):
        cells = _cells(points, groups, radius)
        # min_by takes one member at random per cell, the same one in every run
        pivots = cells.groupBy("cell").agg(F.min(F.struct(F.xxhash64("fp", "cell", F.lit(turn)), "fp", "label")).alias("_p"), F.min("label").alias("_lo"), F.max("label").alias("_hi"))
        pivots = pivots.filter("_lo <> _hi").select("cell", F.col("_p.fp").alias("pivot"), F.col("_p.label").alias("a"))
        links = cells.join(pivots.hint("merge"), "cell").filter((F.col("label") != F.col("a")) & _near("fp", "pivot", radius))
        points = _relabel(points, links.select("a", F.col("label").alias("b")))
    cells = _cells(points, groups, radius)
    usual = cells.groupBy("cell", "label").agg(F.count(F.lit(1)).alias("n"))
    usual = usual.groupBy("cell").agg(F.max(F.struct("n", "label")).alias("_u"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
    open_cells = usual.select("cell", F.col("_u.label").alias("usual"))
    members = written(cells.join(open_cells.hint("merge"), "cell"), "cells")
    others = members.filter("label <> usual").select("cell", F.col("fp").alias("fp_a"), F.col("label").alias("a"))
    meets = others.join(members.select("cell", "fp", F.col("label").alias("b"), "usual").hint("merge"), "cell")
    # two members that are both unusual meet twice; one direction is enough
    wanted = (F.col("a") != F.col("b")) & ((F.col("b") == F.col("usual")) | (F.col("a") < F.col("b"))) & _near("fp_a", "fp", radius)
    return _relabel(points, meets.filter(wanted).select("a", "b"))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, groups: int = GROUPS) -> DataFrame:
    """``(doc_id, fp, component_id, label)``: one row per row of ``docs``; component_id is the smallest id reachable over links.

    ``label`` is a component's own name: where an id stands on rows of several components, these may share a component_id.

    Null and wordless texts have fingerprint 0 and link like any other. A null id keeps its row; it is never a component_id
    unless the component holds no other id. Repeated rows stay repeated. Other columns of ``docs`` do not matter.
    """
    rows = written(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), text="_text", keep=["doc_id"]), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    labels = link_components(distinct, radius=radius, groups=groups)
    smallest = labels.join(distinct, "fp").groupBy("label").agg(F.min("first").alias("component_id"))
    classes = written(labels.join(smallest, "label").select("fp", "component_id", "label"), "classes")
    return rows.join(classes, "fp", "left").select("doc_id", "fp", "component_id", "label")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
