"""The automaton over stale values against the rule it speeds up, and its use over samples."""

import random
import re
import time
from collections import Counter

from pyspark.sql import functions as F

from tidemark.functions.matching import ValueFinder
from tidemark.operators import retrieval, temporal


def slow(values, text):
    n = 0
    for v in sorted({v for v in values if v}, key=lambda v: (-len(v), v)):
        if v in text:
            n, text = n + 1, text.replace(v, " ")
    return n


def test_consuming_from_the_longest():
    rng = random.Random(4)
    for _ in range(3000):
        alphabet = rng.choice(["ab", "ab ", "aß漢"])
        values = ["".join(rng.choices(alphabet, k=rng.randint(0, 5))) for _ in range(rng.randint(0, 7))]
        text = "".join(rng.choices(alphabet + "x", k=rng.randint(0, 25)))
        finder = ValueFinder(values)
        assert finder.consumed(text) == slow(values, text), (values, text)
        found = {(finder.values[v], at) for v, at in finder.occurrences(text)}
        assert found == {(v, i) for v in set(values) if v for i in range(len(text)) if text.startswith(v, i)}


def test_a_long_text_and_many_values():
    rng = random.Random(5)
    values = [f"value-{i:04d}-{rng.randrange(10**6)}" for i in range(1000)]
    text = " ".join(rng.choice(values) if i % 7 == 0 else f"word{i}" for i in range(100_000))
    started = time.perf_counter()
    assert ValueFinder(values).consumed(text) == slow(values, text) == 1000 and len(text) > 10**6
    assert time.perf_counter() - started < 60


EDGES = "sample long, edge_id long, source_key string, relation string, text string, valid_at long, invalid_at long, expired_at long"


def test_states_over_shares(spark, monkeypatch):
    monkeypatch.setattr(temporal, "TEXTS_PER_SHARE", 2)
    samples = spark.createDataFrame([(1, "New"), (2, "Now"), (3, "none")], "sample long, expected string")
    stale = spark.createDataFrame([(1, "older"), (1, "old"), (1, ""), (2, "old")], "sample long, stale_value string")
    rows = [(1, i, "S", "r", f"{'new' if i == 0 else ''} OLDER {i}", None, None, None) for i in range(9)]
    rows += [(1, 20, "s", "R", "old and older", None, None, None), (1, 21, "other", "r", "old", None, None, None), (2, 1, "s", "r", "now", None, None, None), (2, 2, "s", "r", None, None, None, None)]
    got = temporal.inspect_current_state(samples, stale, spark.createDataFrame(rows, EDGES), "sample", F.lit(5))
    cols = ["sample", "current_active", "current_inactive", "stale_active", "transition_mentions", "status"]
    assert sorted(map(tuple, got.select(*cols).collect())) == [(1, 1, 0, 10, 1, "AMBIGUOUS"), (2, 1, 0, 0, 0, "PASS"), (3, 0, 0, 0, 0, "FAIL")]


def test_nearest_prompt_by_definition(spark):
    rng = random.Random(7)
    words = lambda: None if rng.random() < 0.05 else " ".join(rng.choices(["a", "bb", "a.", "ä", "B"], k=rng.randint(0, 6)))
    row = lambda i, names: (i, rng.choice(names), rng.choice("xy"), words(), "0" * 12 + f"{rng.randrange(16**6):06x}" + f"{i:014x}")
    requests, records = [row(i, "abcd") for i in range(80)], [row(1000 + i, "aaaaaaaab" + "c" * (i > 320)) for i in range(330)]

    def bag(text):
        return Counter(re.findall(r"\w+|[^\w\s]", (text or "").lower()))

    def best(q):
        gap = lambda r: None if q[3] is None or r[3] is None else abs(len(q[3]) - len(r[3]))
        last = lambda g: 10**9 if g is None else g
        near = sorted(records, key=lambda r: (r[1] != q[1], r[2] != q[2], last(gap(r)), r[4]))[:16]
        dice = lambda r: round(2 * (bag(q[3]) & bag(r[3])).total() / n, 9) if (n := (bag(q[3]) + bag(r[3])).total()) else 1.0
        r = max(near, key=lambda r: (r[1] == q[1], r[2] == q[2], dice(r), -last(gap(r)), r[4]))
        return q[0], r[0], int(r[1] == q[1]), int(r[2] == q[2]), gap(r), dice(r)

    schema = "id long, name string, part string, text string, hash string"
    got = retrieval.nearest_prompt(spark.createDataFrame(requests, schema), spark.createDataFrame(records, schema), row_id="id", name="name", component="part", text="text", digest="hash")
    assert sorted(map(tuple, got.select("id", "nearest", "name_match", "component_match", "length_gap", "dice").collect())) == [best(q) for q in requests]


def test_requests_of_one_length_share_their_shortlist(spark):
    """2,000 requests that differ in nothing but their words: no row per request and neighbour is shuffled."""
    rows = lambda n, at: spark.range(at, at + n).select("id", F.lit("n").alias("name"), F.lit("c").alias("part"), F.format_string("w%05d", "id").alias("text"), F.md5(F.col("id").cast("string")).alias("hash"))
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("shortlists", "")
    try:
        got = retrieval.nearest_prompt(rows(2000, 0), rows(500, 5000), row_id="id", name="name", component="part", text="text", digest="hash")
        assert got.select(F.count_distinct("id"), F.min("nearest") >= 5000).first() == (2000, True)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = {s for j in jobs.getJobIdsForGroup("shortlists") for s in jobs.getJobInfo(j).stageIds if jobs.getStageInfo(s)}
    store = spark.sparkContext._jsc.sc().statusStore()
    assert sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages) < 20_000
