"""Longest paths over many graphs by contraction, in a number of rounds that does not follow their depth.

A value is ``max(own, largest predecessor value + length of the edge)``. Rounds shrink the graphs until nothing is left:

* Nodes are given to buckets of bounded size: a whole graph where it fits into one, else ranges of its nodes in the first
  round, and single nodes with their edges after that. An edge between two buckets holds its ends back for the round.
* A bucket finishes nodes without open predecessors, and takes out nodes whose removal adds no edges (one edge in or out, or
  two of each): every way through such a node becomes one longer edge, a maximum where there are several.
* When no node is left that can be finished or taken out, the taken ones get their values, last round first.

In later rounds a node is taken out if its hash is the least among its neighbours', so a third of any chain goes each round,
in whatever order its nodes are numbered. What no round can finish lies on or behind a cycle.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Mapping, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.operators.ordered import ordered_scan
from tidemark.session import cut_lineage, fresh_path

#: Nodes and edges of one bucket.
BUCKET_ROWS = 200_000
#: Kinds of rows that go into a bucket: nodes, edges of a whole graph, edges of a part; and that come out of it.
NODE, EDGE, PART_EDGE = 0, 1, 2
DONE, OPEN, LINK, NEWS, TAKEN = 0, 1, 2, 3, 4
#: Below every value; stands for no value.
NOTHING = {"bigint": -(1 << 90), "double": float("-inf")}


class _Bucket:
    """The nodes and edges of one bucket. Values are lists: first the level, then one entry per base."""

    def __init__(self, width: int, nothing):
        self.own: dict = {}
        self.weight: dict = {}
        self.after: dict = {}
        self.before: dict = {}
        self.width, self.nothing = width, nothing
        self.news: dict = {}

    def node(self, name, weight, values: list) -> None:
        self.own[name] = [self.nothing if v is None else v for v in values]
        self.weight[name] = weight

    def edge(self, a, b, hops: int, length, whole: bool) -> None:
        if whole and (a not in self.own or b not in self.own):
            return
        length = self.weight[b] if length is None else length
        known = self.after.setdefault(a, {}).get(b)
        if known:
            hops, length = max(hops, known[0]), max(length, known[1])
        self.after[a][b] = self.before.setdefault(b, {})[a] = (hops, length)

    def _send(self, values: list, to, way: tuple) -> None:
        """A value that is known along one edge: to a node of the bucket, or as news to one outside."""
        own = self.own.get(to)
        if own is None:
            own = self.news.setdefault(to, [self.nothing] * self.width)
        hops, length = way
        for i, v in enumerate(values):
            v += length if i else hops
            if v > own[i]:
                own[i] = v

    def finish(self) -> Iterator[tuple]:
        """Nodes without open predecessors, and those that become so."""
        ready = deque(n for n in self.own if not self.before.get(n))
        while ready:
            n = ready.popleft()
            values = self.own.pop(n)
            yield n, values
            for to, way in self.after.pop(n, {}).items():
                self._send(values, to, way)
                del self.before[to][n]
                if to in self.own and not self.before[to]:
                    ready.append(to)

    def take_out(self) -> Iterator[tuple]:
        """Nodes taken out, in order, with their own value and the edges that led to them."""
        look, queued = deque(self.own), set(self.own)
        while look:
            n = look.popleft()
            queued.discard(n)
            ins, outs = self.before.get(n, {}), self.after.get(n, {})
            if n not in self.own or n in outs or len(ins) * len(outs) > len(ins) + len(outs):
                continue
            values = self.own.pop(n)
            yield n, values, list(ins.items())
            for to, way in outs.items():
                self._send(values, to, way)
                del self.before[to][n]
                for a, first in ins.items():
                    self.edge(a, to, first[0] + way[0], first[1] + way[1], False)
            for a in ins:
                del self.after[a][n]
            self.before.pop(n, None)
            self.after.pop(n, None)
            for near in {*ins, *outs} - queued:
                if near in self.own:
                    queued.add(near)
                    look.append(near)

    def links(self) -> Iterator[tuple]:
        for a, outs in self.after.items():
            for b, way in outs.items():
                yield a, b, way


def _rows(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """The rows of each bucket; they come in order of their first ``keys`` columns."""
    flat = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
    return groupby(flat, lambda row: row[:keys])


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield batch()
            held = []
    if held:
        yield batch()


class _Contraction:
    """Rounds over tables of nodes (keys, n, w, v0 ...) and edges (keys, a, b, hops, len)."""

    def __init__(self, keys: Sequence[str], width: int, kind: str, node_type: T.DataType, key_types: Sequence[T.DataType], spark):
        self.keys, self.width, self.kind, self.spark = list(keys), width, kind, spark
        self.values = [f"v{i}" for i in range(width)]
        number = T.DoubleType() if kind == "double" else T.LongType()
        self.value_fields = [T.StructField(v, number) for v in self.values]
        named = [T.StructField(k, t) for k, t in zip(self.keys, key_types)]
        body = [T.StructField("a", node_type), T.StructField("b", node_type), T.StructField("hops", T.LongType()), T.StructField("len", number)]
        kind_of = T.StructField("kind", T.IntegerType())
        self.input = T.StructType([*named, T.StructField("bucket", node_type), kind_of, *body, *self.value_fields])
        self.output = T.StructType([*named, T.StructField("bucket", node_type), kind_of, T.StructField("place", T.LongType()), *body, *self.value_fields])
        self.node_type, self.number = node_type, number

    def solve(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        """(keys, n, v0 ...) of every node that has a value."""
        done, taken = [], []
        depth, left = 0, True
        while left:
            given, nodes_kept, edges_kept = self._dealt(nodes, edges, depth)
            out, counts = self._contracted(given)
            part = lambda kind: out.filter(F.col("kind") == kind)
            done.append(part(DONE).select(*self.keys, F.col("a").alias("n"), *self.values))
            taken.append(part(TAKEN) if counts["taken"] else None)
            # ranges may hold every node back; any later round gets on unless only cycles are left
            left = (counts["open"] or nodes_kept is not None) and (depth == 0 or counts["done"] + counts["taken"] > 0)
            if left:
                nodes, edges, left = self._next(part, nodes_kept, edges_kept)
            depth += 1
        return self._values(done, taken)

    def _dealt(self, nodes: DataFrame, edges: DataFrame, depth: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
        """What goes into buckets, and the nodes and edges that stay out of this round (None: none do)."""
        keys = self.keys
        none = F.lit(None).cast(self.node_type)
        as_nodes = lambda df, bucket: df.select(*keys, bucket.alias("bucket"), F.lit(NODE).alias("kind"), F.col("n").alias("a"), none.alias("b"), F.lit(None).cast("long").alias("hops"), F.col("w").alias("len"), *self.values)
        as_edges = lambda df, bucket, kind: df.select(*keys, bucket.alias("bucket"), kind.alias("kind"), "a", "b", "hops", "len", *[F.lit(None).cast(self.number).alias(v) for v in self.values])
        sizes = nodes.select(*keys).unionByName(edges.select(*keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
        most = sizes.agg(F.max("_rows")).first()[0] or 0
        if most <= BUCKET_ROWS:
            return as_nodes(nodes, none).unionByName(as_edges(edges, none, F.lit(EDGE))), None, None
        large = cut_lineage(sizes.filter(F.col("_rows") > BUCKET_ROWS).select(*keys), "dag-large")
        whole = as_nodes(nodes.join(large, keys, "left_anti"), none).unionByName(as_edges(edges.join(large, keys, "left_anti"), none, F.lit(EDGE)))
        nodes, edges = nodes.join(large, keys, "left_semi"), edges.join(large, keys, "left_semi")
        edges = edges.join(nodes.select(*keys, F.col("n").alias("b"), "w"), [*keys, "b"]).withColumn("len", F.coalesce("len", "w")).drop("w")
        edges = edges.join(nodes.select(*keys, F.col("n").alias("a")), [*keys, "a"], "left_semi")
        owned = cut_lineage(self._ranges(nodes) if depth == 0 else self._centres(nodes, edges, depth), "dag-owners")
        ends = lambda table, column, name: table.select(*keys, F.col("n").alias(column), F.col("bucket").alias(name))
        joined = edges.join(ends(owned, "a", "_of_a"), [*keys, "a"], "left").join(ends(owned, "b", "_of_b"), [*keys, "b"], "left")
        if depth == 0:
            joined = cut_lineage(joined, "dag-edges")
            across = joined.filter("_of_a <> _of_b")
            held = across.select(*keys, F.col("a").alias("n")).unionByName(across.select(*keys, F.col("b").alias("n"))).distinct().withColumn("_held", F.lit(True))
            held = cut_lineage(held, "dag-held")
            owned = owned.join(held, [*keys, "n"], "left_anti")
            for end in ("a", "b"):
                joined = joined.join(held.withColumnsRenamed({"n": end, "_held": f"_held_{end}"}), [*keys, end], "left").withColumn(f"_of_{end}", F.when(F.col(f"_held_{end}").isNull(), F.col(f"_of_{end}"))).drop(f"_held_{end}")
        joined = cut_lineage(joined.withColumn("bucket", F.coalesce("_of_a", "_of_b")).select(*keys, "a", "b", "hops", "len", "bucket"), "dag-dealt")
        named = cut_lineage(nodes.join(owned.select(*keys, "n", "bucket"), [*keys, "n"], "left"), "dag-named")
        inside = as_nodes(named.filter("bucket IS NOT NULL"), F.col("bucket")).unionByName(as_edges(joined.filter("bucket IS NOT NULL"), F.col("bucket"), F.lit(PART_EDGE)))
        return whole.unionByName(inside), named.filter("bucket IS NULL").drop("bucket"), joined.filter("bucket IS NULL").drop("bucket")

    def _ranges(self, nodes: DataFrame) -> DataFrame:
        """Neighbouring nodes, by their order, up to a share of a bucket; a bucket is named after its first node."""
        ranked = ordered_scan(nodes.select(*self.keys, "n"), self.keys, ["n"], rank="_r").withColumn("_p", F.floor((F.col("_r") - 1) / (BUCKET_ROWS // 4)))
        first = ranked.groupBy(*self.keys, "_p").agg(F.min("n").alias("bucket"))
        return ranked.join(first, [*self.keys, "_p"]).select(*self.keys, "n", "bucket")

    def _centres(self, nodes: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
        """Nodes that may be taken out or finished and whose hash is less than that of all such neighbours."""
        keys = self.keys
        end = lambda column, i, o: edges.select(*keys, F.col(column).alias("n"), F.lit(i).alias("_i"), F.lit(o).alias("_o"), (F.col("a") == F.col("b")).cast("int").alias("_self"))
        degrees = end("a", 0, 1).unionByName(end("b", 1, 0)).groupBy(*keys, "n").agg(F.sum("_i").alias("_i"), F.sum("_o").alias("_o"), F.max("_self").alias("_self"))
        fit = nodes.select(*keys, "n").join(degrees, [*keys, "n"], "left").fillna(0, ["_i", "_o", "_self"])
        fit = fit.filter("_self = 0 AND _i * _o <= _i + _o").select(*keys, "n", F.struct(F.xxhash64(F.lit(depth), "n").alias("h"), "n").alias("_h"))
        fit = cut_lineage(fit, "dag-fit")
        side = lambda column, name: fit.select(*keys, F.col("n").alias(column), F.col("_h").alias(name))
        pairs = edges.select(*keys, "a", "b").join(side("a", "_ha"), [*keys, "a"]).join(side("b", "_hb"), [*keys, "b"])
        beaten = pairs.select(*keys, F.when(F.col("_ha") > F.col("_hb"), F.col("a")).otherwise(F.col("b")).alias("n")).distinct()
        return fit.join(beaten, [*keys, "n"], "left_anti").select(*keys, "n", F.col("n").alias("bucket"))

    def _contracted(self, given: DataFrame) -> tuple[DataFrame, dict]:
        width, nothing, n_keys, schema = self.width, NOTHING[self.kind], len(self.keys), to_arrow_schema(self.output)

        def outcome(key: tuple, rows) -> Iterator[tuple]:
            bucket = _Bucket(width, nothing)
            for row in rows:
                kind, a, b, hops, length = row[n_keys + 1 : n_keys + 6]
                if kind == NODE:
                    bucket.node(a, length, list(row[n_keys + 6 :]))
                else:
                    bucket.edge(a, b, hops, length, kind == EDGE)
            plain = lambda values: [None if v < nothing / 2 else v for v in values] if nothing != float("-inf") else [None if v == nothing else v for v in values]
            empty = [None] * width
            for name, values in bucket.finish():
                yield (*key, DONE, None, name, None, None, None, *plain(values))
            if key[-1] is None:  # a whole graph: what is left lies on or behind a cycle
                return
            for place, (name, values, ins) in enumerate(bucket.take_out()):
                for a, (hops, length) in ins:
                    yield (*key, TAKEN, place, name, a, hops, length, *plain(values))
            for name, values in bucket.own.items():
                yield (*key, OPEN, None, name, None, None, bucket.weight[name], *plain(values))
            for name, values in bucket.news.items():
                yield (*key, NEWS, None, name, None, None, None, *plain(values))
            for a, b, (hops, length) in bucket.links():
                yield (*key, LINK, None, a, b, hops, length, *empty)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _batches((row for key, rows in _rows(batches, n_keys + 1) for row in outcome(key, rows)), schema)

        dealt = given.repartition(*self.keys, "bucket").sortWithinPartitions(*self.keys, "bucket", "kind")
        seen, path = Observation(), fresh_path(self.spark, "dag-round")
        count = lambda kind: F.count_if(F.col("kind") == kind)
        dealt.mapInArrow(run, self.output).observe(seen, count(DONE).alias("done"), count(TAKEN).alias("taken"), count(OPEN).alias("open")).write.parquet(path)
        return self.spark.read.schema(self.output).parquet(path), seen.get

    def _next(self, part, nodes_kept: DataFrame | None, edges_kept: DataFrame | None) -> tuple[DataFrame, DataFrame, int]:
        keys = self.keys
        nodes = part(OPEN).select(*keys, F.col("a").alias("n"), F.col("len").alias("w"), *self.values)
        edges = part(LINK).select(*keys, "a", "b", "hops", "len")
        if nodes_kept is not None:
            news = part(NEWS).select(*keys, F.col("a").alias("n"), F.lit(None).cast(self.number).alias("w"), *self.values)
            nodes = nodes.unionByName(nodes_kept).unionByName(news).groupBy(*keys, "n").agg(F.max("w").alias("w"), *[F.max(v).alias(v) for v in self.values])
            edges = edges.unionByName(edges_kept).groupBy(*keys, "a", "b").agg(F.max("hops").alias("hops"), F.max("len").alias("len"))
        seen = Observation()
        nodes = cut_lineage(nodes.observe(seen, F.count(F.lit(1)).alias("n")), "dag-nodes")
        return nodes, cut_lineage(edges, "dag-edges"), int(seen.get["n"] or 0)

    def _values(self, done: list[DataFrame], taken: list[DataFrame | None]) -> DataFrame:
        """Values of the nodes taken out, from the last round back; a round needs only what later rounds have found."""
        known = None
        for finished, out in zip(reversed(done), reversed(taken)):
            if out is not None:
                found = self._resolved(out, known)
                finished = finished.unionByName(cut_lineage(found, "dag-values"))
            known = finished if known is None else known.unionByName(finished)
        return known

    def _resolved(self, out: DataFrame, known: DataFrame | None) -> DataFrame:
        keys, width, n_keys, nothing = self.keys, self.width, len(self.keys), NOTHING[self.kind]
        given = [f"k{i}" for i in range(width)]
        if known is None:
            rows = out.withColumns({g: F.lit(None).cast(self.number) for g in given}).withColumn("_has", F.lit(False))
        else:
            had = known.select(*keys, F.col("n").alias("b"), *[F.col(v).alias(g) for v, g in zip(self.values, given)], F.lit(True).alias("_has"))
            rows = out.join(had, [*keys, "b"], "left").fillna(False, ["_has"])
        rows = rows.select(*keys, "bucket", (-F.col("place")).alias("place"), "a", "b", "hops", "len", "_has", *self.values, *given)
        schema = T.StructType([*[self.output[k] for k in keys], T.StructField("n", self.node_type), *self.value_fields])
        arrow = to_arrow_schema(schema)

        def of_bucket(key: tuple, rows) -> Iterator[tuple]:
            values: dict = {}
            for _, group in groupby(rows, lambda row: row[n_keys + 1]):
                best, lost, name = None, False, None
                for row in group:
                    name, a, hops, length, has = row[n_keys + 2 : n_keys + 7]
                    rest = row[n_keys + 7 :]
                    if best is None:
                        best = [nothing if v is None else v for v in rest[:width]]
                    there = [nothing if v is None else v for v in rest[width:]] if has else values.get(a)
                    if there is None:
                        lost = True
                        continue
                    for i, v in enumerate(there):
                        best[i] = max(best[i], v + (length if i else hops))
                if not lost:
                    values[name] = best
                    yield (*key[:n_keys], name, *[None if v == nothing or v < -(1 << 80) else v for v in best])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _batches((row for key, group in _rows(batches, n_keys + 1) for row in of_bucket(key, group)), arrow)

        return rows.repartition(*keys, "bucket").sortWithinPartitions(*keys, "bucket", "place").mapInArrow(run, schema)


def longest_values(nodes: DataFrame, edges: DataFrame, keys: Sequence[str], node: str, source: str, target: str, weight: Column, bases: Mapping[str, Column], kind: str, level: str) -> DataFrame:
    """``keys``, ``node``, ``level`` and per base ``weight + max(base, largest predecessor value)`` of nodes off every cycle.

    The level is the largest number of edges that lead to a node. ``kind`` is bigint or double. Edges with an unknown end are
    ignored, repeated edges count once; node names are unique within their keys.
    """
    names = list(bases)
    first = F.lit(0).cast(kind)
    points = nodes.select(*keys, F.col(node).alias("n"), weight.cast(kind).alias("w"), first.alias("v0"), *[(b.cast(kind) + weight.cast(kind)).alias(f"v{i}") for i, b in enumerate(bases.values(), 1)])
    links = edges.select(*keys, F.col(source).alias("a"), F.col(target).alias("b"), F.lit(1).cast("long").alias("hops"), F.lit(None).cast(kind).alias("len")).filter("a IS NOT NULL AND b IS NOT NULL")
    key_types = [nodes.schema[k].dataType for k in keys]
    found = _Contraction(keys, len(names) + 1, kind, nodes.schema[node].dataType, key_types, nodes.sparkSession).solve(points, links)
    return found.select(*keys, F.col("n").alias(node), F.col("v0").cast("int").alias(level), *[F.col(f"v{i}").alias(n) for i, n in enumerate(names, 1)])
