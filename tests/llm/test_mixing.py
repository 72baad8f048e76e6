import random

from tidemark.llm import mixing as M

COLUMNS = "doc_id long, text string, source string, size int, target string, _r int"


def shared(sizes, weights, limit=3):
    """Targets by resharing the excess until nobody is above the limit."""
    total, fixed = float(sum(sizes)), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        rest = total - sum(fixed.values())
        share = {i: rest * weights[i] / sum(weights[j] for j in free) for i in free}
        over = [i for i in free if share[i] > limit * sizes[i]]
        if not over:
            return [fixed.get(i, share.get(i)) for i in range(len(sizes))]
        fixed |= {i: float(limit * sizes[i]) for i in over}


def test_targets_and_taken_words(spark):
    rng = random.Random(4)
    names = ["b", "a", None, "é", "Z"]
    rows = [(i, " ".join("w" * rng.choice([1, 3]) for _ in range(rng.choice([0, 1, 7, 60, 900]))), names[min(4, int(rng.expovariate(0.9)))]) for i in range(400)]
    rows += [(1000, None, "a"), (None, "two words", "a"), (5, "again again", "b"), (5, "again again", "b")]
    df = spark.createDataFrame([(i, t, s, 0, "x", 1) for i, t, s in rows], COLUMNS)
    for block in (1024, 16, 1):
        got = M.mix(df, block_words=block).collect()
        assert len(got) == len(rows)
        order = sorted({s for _, _, s in rows if s is not None}) + [None]
        sizes = [sum(len((t or "").split()) for _, t, s in rows if s == o) for o in order]
        want = dict(zip(order, shared(sizes, [1 + i % 3 for i in range(len(order))])))
        for o, size in zip(order, sizes):
            mine = [r for r in got if r.source == o]
            assert all(r.source_size == size and abs(r.target - want[o]) < 1e-6 * size for r in mine)
            assert abs(sum(r.taken for r in mine) - want[o]) <= 1
            assert all(0 <= r.taken <= 3 * r.size for r in mine)
    assert sorted(map(str, M.mix(df.repartition(7)).collect())) == sorted(map(str, M.mix(df).collect()))


def test_words_of_odd_texts(spark):
    texts = [None, "", "   ", "a", " a\tb\x0bc \n", "é é x", "\x1ca b"]
    got = [r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").select(M.words(M.F.col("t")).alias("n")).collect()]
    assert got == [0, 0, 0, 1, 3, 2, 2]


def test_schedule_is_spread(spark):
    plan = spark.createDataFrame([("a", 10_000, 10_000), ("b", 40_000, 30_000)], "source string, source_size long, quota long")
    slots = sorted(M.schedule(plan, block_words=100).collect(), key=lambda r: r.slot)
    assert sum(r.words for r in slots if r.source == "a") == 10_000 and sum(r.words for r in slots if r.source == "b") == 30_000
    for n in range(20, 380, 20):
        assert abs(sum(r.source == "a" for r in slots[:n]) - n / 4) < 4


def test_tiny_sources_need_few_slots(spark, monkeypatch):
    plan = spark.createDataFrame([("a", 3, 9), ("b", 4_000_000_000, 4_000_000_000), (None, 1, 1), ("c", 300_000, 900_000)], "source string, source_size long, quota long")
    asked = []
    ranged = type(spark).range
    monkeypatch.setattr(type(spark), "range", lambda self, *a: asked.append(a[0]) or ranged(self, *a))
    slots = M.schedule(plan).collect()
    assert sum(asked) < 2 * 4_000_000_000 / M.BLOCK_WORDS
    taken, count = {}, {}
    for r in slots:
        taken[r.source], count[r.source] = taken.get(r.source, 0) + r.words, count.get(r.source, 0) + 1
    assert taken == {"a": 9, "b": 4_000_000_000, None: 1, "c": 900_000} and count["a"] == 3 and count["c"] == 3 * 293
    assert all(0 <= r.slot < sum(asked) for r in slots)
    places = sorted(r.slot for r in slots if r.source == "c")
    assert max(b - a for a, b in zip(places, places[1:])) < 1.1 * 4_000_900_010 / M.BLOCK_WORDS / len(places) + 1


def test_many_tiny_sources(spark):
    plan = spark.createDataFrame([(str(i), i % 7 + 1, 3 * (i % 7 + 1)) for i in range(10_000)], "source string, source_size long, quota long")
    got = M.schedule(plan, block_words=2).groupBy("source").agg(M.F.sum("words").alias("n")).collect()
    assert len(got) == 10_000 and all(r.n == 3 * (int(r.source) % 7 + 1) for r in got)


def test_taken_words_of_a_tiny_source(spark):
    df = spark.createDataFrame([(i, "w " * 5_000, "a") for i in range(40)] + [(90, "one two three", "b"), (91, None, "c"), (92, "x", None)], "doc_id long, text string, source string")
    assert {r.doc_id: r.taken for r in M.mix(df, block_words=16).collect() if r.doc_id >= 90} == {90: 9, 91: 0, 92: 3}


def test_pieces_of_documents_are_not_broadcast(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i * 97 % 3000), "ab"[i % 2]) for i in range(20)], "doc_id long, text string, source string")
    plan = M.mix(docs)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "_bb#" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
