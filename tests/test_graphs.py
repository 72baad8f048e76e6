"""Closures and longest paths on graphs of every shape, against plain walks."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.operators import contraction, dag


def plain_reach(starts, edges):
    after = defaultdict(set)
    for g, a, b in edges:
        after[g, a].add(b)
    out = []
    for g, s in set(starts):
        seen, front, d = {s}, [s], 0
        while front:
            d += 1
            front = sorted({t for n in front for t in after[g, n]} - seen)
            seen.update(front)
            out += [(g, s, t, d) for t in front]
    return sorted(out)


def shapes(rng):
    up = [(1, n, rng.randrange(n)) for n in range(1, 60)] + [(2, n, n + 1) for n in range(40)]
    ring = [(1, n, (n + 1) % 7) for n in range(7)] + [(1, 20, 3), (1, 21, 20), (2, 5, 5)]
    mesh = [(1, rng.randrange(25), rng.randrange(25)) for _ in range(60)]
    turned = lambda edges: [(g, b, a) for g, a, b in edges]
    return {"up": up, "down": turned(up), "ring": ring, "ring down": turned(ring), "mesh": mesh, "none": []}


def test_reach_of_every_shape(spark):
    rng = random.Random(3)
    for name, edges in shapes(rng).items():
        starts = [(g, n) for g in (1, 2) for n in rng.sample(range(60), 9)] + [(1, 0), (1, 0)]
        got = dag.reach(spark.createDataFrame(starts, "g int, start int"), spark.createDataFrame(edges + edges[:2], "g int, a int, b int"), "g", "start", "a", "b")
        assert sorted(map(tuple, got.select("g", "start", "node", "distance").collect())) == plain_reach(starts, edges), name


def plain_longest(nodes, edges):
    before, after = defaultdict(set), defaultdict(set)
    for g, a, b in edges:
        if (g, a) in nodes and (g, b) in nodes:
            before[g, b].add((g, a))
            after[g, a].add((g, b))
    left, out = {k: len(before[k]) for k in nodes}, {}
    ready = [k for k in nodes if not left[k]]
    while ready:
        k = ready.pop()
        weight, base = nodes[k]
        out[k] = max([out[p][0] + 1 for p in before[k]], default=0), max([base, *(out[p][1] for p in before[k])]) + weight
        for n in after[k]:
            left[n] -= 1
            if not left[n]:
                ready.append(n)
    return out


def some_graph(rng, shape, n):
    names = list(range(100, 100 + n))
    rng.shuffle(names)
    pairs = [(i if shape != "tree" else rng.randint(0, i), i + 1) for i in range(n - 1)] if shape != "mesh" else []
    pairs += [(i, i + 2) for i in range(n - 2) if shape == "skips"]
    pairs += [tuple(sorted(rng.sample(range(n), 2))) for _ in range(2 * n) if shape == "mesh" and n > 1]
    pairs += [(n // 2 + 1, n // 2 - 1)] if shape == "cycle" and n > 4 else []
    return names, [(names[a], names[b]) for a, b in pairs] + [(names[0], 9999)]


@pytest.mark.parametrize("rows", [10**6, 14])
def test_longest_paths_whole_and_contracted(spark, monkeypatch, rows):
    monkeypatch.setattr(contraction, "BUCKET_ROWS", rows)
    rng, nodes, edges = random.Random(5), {}, set()
    for g, (shape, n) in enumerate([("chain", 30), ("tree", 20), ("skips", 18), ("mesh", 9), ("cycle", 12), ("chain", 1)]):
        names, links = some_graph(rng, shape, n)
        nodes |= {(g, x): (rng.randint(0, 9), rng.randint(0, 20)) for x in names}
        edges |= {(g, a, b) for a, b in links}
    frame = spark.createDataFrame([(*k, *v) for k, v in nodes.items()], "g int, n int, w int, b int")
    links = spark.createDataFrame([*edges, *list(edges)[:3]], "g int, s int, t int")
    got = {(r.g, r.n): (r.level, r.v) for r in dag.longest_paths(frame, links, "g", "n", "s", "t", "w", {"v": F.col("b")}).collect()}
    want = plain_longest(nodes, edges)
    assert got == {k: want.get(k, (None, None)) for k in nodes} and any(v == (None, None) for v in got.values())


def test_a_chain_of_100_000_nodes(spark):
    n = 100_000
    order = spark.range(n).select(F.lit("g").alias("g"), F.col("id").cast("string").alias("n"), F.lit(0.5).alias("w"))
    links = spark.range(n - 1).select(F.lit("g").alias("g"), F.col("id").cast("string").alias("s"), (F.col("id") + 1).cast("string").alias("t"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "chain")
    try:
        last = dag.longest_paths(order, links, "g", "n", "s", "t", "w", {"v": F.lit(0.0)}).orderBy(F.desc("level")).first()
    finally:
        jobs = len(tracker.getJobIdsForGroup("chain"))
        spark.sparkContext.setJobGroup("", "")
    assert (last.n, last.level, last.v) == (str(n - 1), n - 1, n / 2) and jobs < 40


def test_small_span_trees_take_one_shuffle_and_match_the_levels(spark, monkeypatch):
    draw = random.Random(5)
    rows = []
    for trace in range(40):
        for i in range(draw.randrange(1, 30)):
            at = draw.randrange(60)
            # parents of any number: chains, orphans (above 25) and cycles
            rows.append((trace, f"s{i}", None if i == 0 else f"s{draw.randrange(max(i, 26) if draw.random() < 0.2 else i)}", at, at + draw.randrange(40)))
    spans = spark.createDataFrame(rows, "k int, id string, up string, s bigint, e bigint")
    want = sorted(map(tuple, dag._tree_by_levels(spans, ["k"], "id", "up", "s", "e").collect()), key=str)
    assert len({w[-1] for w in want}) == 3
    written = []
    monkeypatch.setattr(dag, "cut_lineage", lambda df, label="cut": written.append(label))
    found = dag.span_tree_critical_path(spans, ["k"], "id", "up", "s", "e")
    assert sorted(map(tuple, found.collect()), key=str) == want and not written
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange") == 1


def test_large_span_trees_go_by_levels(spark, monkeypatch):
    rows = [(t, f"s{i}", None if i == 0 else f"s{(i - 1) // 2}", i, 50) for t, n in ((1, 9), (2, 3)) for i in range(n)]
    spans = spark.createDataFrame([*rows, (3, "s0", None, 0, None)], "k int, id string, up string, s bigint, e bigint")
    want = {tuple(r) for r in dag.span_tree_critical_path(spans, ["k"], "id", "up", "s", "e").collect()}
    monkeypatch.setattr(dag, "TRACE_ROWS", 4)
    assert {tuple(r) for r in dag.span_tree_critical_path(spans, ["k"], "id", "up", "s", "e").collect()} == want and len(want) == 13
