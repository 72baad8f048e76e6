"""Critical paths of whole span trees inside a task: many small traces at once, as arrays.

A trace that fits a bucket needs one shuffle by its keys; the levels of its tree are then slices of arrays, not joins.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Spans of one trace that a task may hold; the size of the chunks of whole traces it works on.
TRACE_ROWS = 200_000
CHUNK_ROWS = 100_000


def _depths(up: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Depth below its root, and whether a root is reached, from each row's parent row (-1: a root); doubling, so log rounds."""
    top = up < 0
    to, depth = np.where(top, np.arange(len(up)), up), (~top).astype(np.int64)
    for _ in range(len(up).bit_length()):
        if top[to].all():
            break
        depth, to = depth + depth[to], to[to]
    return depth, top[to]


def _clusters(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether a row opens a cluster of overlapping intervals; rows come by owner and start."""
    fresh = np.append(True, owner[1:] != owner[:-1])
    ends, rank = np.unique(end, return_inverse=True)
    base = (np.cumsum(fresh) - 1) * len(ends)
    seen = ends[np.maximum.accumulate(base + rank) - base]
    return fresh | np.append(True, start[1:] >= seen[:-1])


def tree_paths(up: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Own time, critical path, depth and whether a root is reached, per span; ``up`` is the row of the parent or -1."""
    depth, reached = _depths(up)
    own = end - start
    kids = np.flatnonzero(up >= 0)
    a, b = np.maximum(start[kids], start[up[kids]]), np.minimum(end[kids], end[up[kids]])
    inside = a < b
    kids, a, b = kids[inside], a[inside], b[inside]
    if not len(kids):
        return own, own, depth, reached
    order = np.lexsort((a, up[kids]))
    kids, a, b = kids[order], a[order], b[order]
    opens = _clusters(up[kids], a, b)
    first = np.flatnonzero(opens)
    np.subtract.at(own, up[kids[first]], np.maximum.reduceat(b, first) - a[first])
    path = own.copy()
    # deepest parents first; the rows of a cluster stay together
    order = np.argsort(-depth[up[kids]], kind="stable")
    kids, opens = kids[order], opens[order]
    kids, opens = kids[reached[kids]], opens[reached[kids]]
    if not len(kids):
        return own, path, depth, reached
    above = depth[up[kids]]
    cuts = np.append(np.flatnonzero(np.append(True, above[1:] != above[:-1])), len(kids))
    for low, high in zip(cuts[:-1], cuts[1:]):
        level, first = kids[low:high], np.flatnonzero(opens[low:high])
        np.add.at(path, up[level[first]], np.maximum.reduceat(path[level], first))
    return own, path, depth, reached


def _chunk(rows: pa.Table, keys: Sequence[str], fresh: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    """The result rows of whole traces; ``fresh`` marks the first row of each."""
    rows = rows.combine_chunks()
    column = lambda i: rows.column(i).chunk(0)
    n = len(keys)
    trace = pa.array(np.cumsum(fresh)).cast(pa.string())
    name = lambda c: pc.binary_join_element_wise(trace, c.cast(pa.string()), ":")
    parent = column(n + 1)
    up = pc.index_in(name(parent), value_set=name(column(n))).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    own, path, depth, reached = tree_paths(up, *(column(i).cast(pa.int64()).to_numpy(zero_copy_only=False) for i in (n + 2, n + 3)))
    orphan = (up < 0) & ~parent.is_null().to_numpy(zero_copy_only=False)
    status = pa.array(np.array(["OK", "ORPHAN", "CYCLE"])).take(pa.array(np.where(reached, orphan, 2)))
    out = [*(column(i) for i in range(n + 1)), pa.array(depth, mask=~reached), pa.array(own), pa.array(path, mask=~reached), status]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(out, schema)], schema=schema)


def small_tree_paths(spans: DataFrame, keys: Sequence[str], span: str, parent: str, start: str, end: str) -> DataFrame:
    """``keys, span, depth, exclusive, critical_path, span_status`` of traces that each fit a task; no value but ``parent`` is null."""
    keys = list(keys)
    longs = lambda *names: [T.StructField(c, T.LongType()) for c in names]
    result = T.StructType([*[spans.schema[c] for c in (*keys, span)], T.StructField("depth", T.IntegerType()), *longs("exclusive", "critical_path"), T.StructField("span_status", T.StringType())])
    schema = to_arrow_schema(result)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(len(b) for b in held) < CHUNK_ROWS:
                continue
            rows = pa.Table.from_batches(held)
            fresh = _borders(rows, len(keys))
            last = int(np.flatnonzero(fresh)[-1])  # this trace may go on
            if last:
                yield _chunk(rows.slice(0, last), keys, fresh[:last], schema)
            held = rows.slice(last).to_batches()
        if sum(len(b) for b in held):
            rows = pa.Table.from_batches(held)
            yield _chunk(rows, keys, _borders(rows, len(keys)), schema)

    return spans.select(*keys, span, parent, start, end).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, result)


def _borders(rows: pa.Table, n: int) -> np.ndarray:
    fresh = np.zeros(len(rows), bool)
    fresh[0] = True
    for i in range(n):
        c = rows.column(i).combine_chunks()
        c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
        fresh[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return fresh
