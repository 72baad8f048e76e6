"""Hand-made rows for the cases the tables do not show, and the published numbers the arithmetic must give."""

import json
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.digests import row_hash
from tidemark.functions.measures import amdahl, ratio, round_double, wilson_bounds
from tidemark.functions.text import event_time_us, glob_to_regex, json_keys, normalize_display
from tidemark.operators import dag, gates, intervals, pairing, records, retrieval, rollups, snapshots, statistics, temporal, timeseries
from tidemark.operators.quantiles import LINEAR, exact_quantiles
from tidemark.session import fresh_path
from tidemark.sources import records as sources
from tidemark.streaming import operators as streaming
from tidemark.streaming.runs import run_available


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def spans(spark, *rows):
    return spark.createDataFrame(list(rows), "k string, s bigint, e bigint")


def test_touching_and_empty_intervals(spark):
    rows = spans(spark, ("a", 0, 10), ("a", 10, 20), ("a", 5, 5), ("a", 30, 40), ("a", 31, 32))
    assert one(intervals.interval_union(rows, ["k"], "s", "e", "u")).u == 30
    merged = sorted((r.s, r.e) for r in intervals.merge_intervals(rows, ["k"], "s", "e").collect())
    assert merged == [(0, 20), (30, 40)]


def test_no_intervals(spark):
    rows = spans(spark, ("a", 5, 5))
    assert intervals.interval_union(rows, ["k"], "s", "e").count() == 0


def test_child_partly_outside_its_parent(spark):
    rows = spark.createDataFrame([("t", "p", None, 0, 100), ("t", "c", "p", 50, 150), ("t", "d", "p", 60, 70)], "k string, id string, up string, s bigint, e bigint")
    own = {r.id: r.x for r in intervals.exclusive_duration(rows, ["k"], "id", "up", "s", "e", "x").collect()}
    assert own == {"p": 50, "c": 100, "d": 10}


def test_arrival_before_publication_at_one_instant(spark):
    rows = spans(spark, ("a", 0, 10), ("a", 10, 20))
    got = one(timeseries.backlog_summary(rows, ["k"], "s", "e"))
    assert (got.maximum_backlog, got.final_backlog, got.backlog_auc, got.backlog_at_final_arrival) == (2, 0, 20, 2)
    netted = one(timeseries.concurrency_sweep(rows, ["k"], "s", "e"))
    assert netted.active_max == 1


def test_pairwise_intersections_count_once(spark):
    left, right = spans(spark, ("a", 0, 10), ("a", 5, 15)), spans(spark, ("a", 8, 20), ("a", 9, 12))
    assert one(intervals.both_active_time(left, right, ["k"], "s", "e", "t")).t == 7


@pytest.mark.parametrize("n", [1, 2, 3, 20, 101])
def test_quantiles_by_definition(spark, n):
    values = [(i * 37) % 50 for i in range(n)]
    rows = spark.createDataFrame([("a", v) for v in values], "k string, v bigint")
    xs = sorted(values)
    near, lin = one(exact_quantiles(rows, ["k"], "v", {"q": 0.95})).q, one(exact_quantiles(rows, ["k"], "v", {"q": 0.95}, method=LINEAR)).q
    assert near == xs[max(1, math.ceil(0.95 * n)) - 1]
    at = (n - 1) * 0.95
    assert lin == pytest.approx(xs[math.floor(at)] + (xs[math.ceil(at)] - xs[math.floor(at)]) * (at - math.floor(at)))


def test_published_numbers(spark):
    row = one(
        spark.range(1).select(
            F.round(ratio(F.lit(188), F.lit(8501.162)), 6).alias("goodput"),
            F.round(ratio(F.lit(2403.57), F.lit(1613.13)), 3).alias("speedup"),
            F.round(wilson_bounds(F.lit(2), F.lit(4))[0], 3).alias("low"),
            F.round(wilson_bounds(F.lit(2), F.lit(4))[1], 3).alias("high"),
            wilson_bounds(F.lit(0), F.lit(0))[0].alias("none"),
        )
    )
    assert (row.goodput, row.speedup, row.low, row.high, row.none) == (0.022115, 1.49, 0.15, 0.85, None)
    p = (1 - 1 / 1.129) * 2
    got = one(spark.range(1).select(amdahl(F.lit(p), 4).alias("four"), amdahl(F.lit(p), 8).alias("eight")))
    assert got.four == pytest.approx(1.208, abs=2e-3) and got.eight == pytest.approx(1.251, abs=3e-3)


def test_constant_labels_and_kappa(spark):
    rows = spark.createDataFrame([("same", True, True)] * 3 + [("off", True, False)] * 3, "k string, h boolean, p boolean")
    got = {r.k: (r.kappa, r.observed_agreement) for r in statistics.confusion_and_kappa(rows, ["k"], "h", "p").collect()}
    assert got == {"same": (1.0, 1.0), "off": (0.0, 0.0)}


def test_all_verdicts_invalid(spark):
    rows = spark.createDataFrame([("A", None, False), ("A", None, False)], "m string, c boolean, v boolean")
    got = one(rollups.judge_outcomes(rows, ["m"], "c", "v"))
    assert (got.valid_denominator, got.qa_accuracy, got.headline_eligible) == (0, None, False)


def test_both_sets_empty(spark):
    row = one(spark.createDataFrame([(0, 0, 0)], "h bigint, l bigint, r bigint").withColumns(__import__("tidemark.functions.measures", fromlist=["x"]).precision_recall_f1(F.col("h"), F.col("l"), F.col("r"))))
    assert (row.precision, row.recall, row.f1) == (1.0, 1.0, 1.0)


def test_empty_gold_and_recall(spark):
    ranked = spark.createDataFrame([("q", 1, "a"), ("q", 2, "b"), ("z", 1, "c")], "q string, rank int, i string")
    gold = spark.createDataFrame([("q", "b"), ("q", "x")], "q string, i string")
    got = {r.q: r.recall_at_10 for r in retrieval.evidence_recall(ranked, gold, "q", "i", 10).collect()}
    assert got == {"q": 0.5, "z": 1.0}
    first = one(retrieval.session_ranking_metrics(ranked, gold, "q", "i"))
    assert (first.recall_at_1, first.mrr, first.best_rank) == (0.0, 0.5, 2)


def test_rank_biased_overlap_by_definition(spark):
    a, b, p = ["a", "b", "c", "d"], ["b", "a", "e"], 0.9
    rows = lambda xs: spark.createDataFrame([("q", i + 1, x) for i, x in enumerate(xs)], "q string, rank int, i string")
    want, last = 0.0, 0.0
    for d in range(1, 5):
        last = len(set(a[:d]) & set(b[:d])) / d
        want += p ** (d - 1) * last
    want = (1 - p) * want + p**4 * last
    assert one(retrieval.rank_biased_overlap(rows(a), rows(b), ["q"], "i")).rbo == pytest.approx(want)


def test_cycle_and_lone_node(spark):
    nodes = spark.createDataFrame([("g", n, 1) for n in range(5)], "g string, n bigint, w bigint")
    edges = spark.createDataFrame([("g", 0, 1), ("g", 1, 2), ("g", 2, 1)], "g string, a bigint, b bigint")
    got = {r.n: r.level for r in dag.longest_paths(nodes, edges, "g", "n", "a", "b", "w", {"f": F.lit(0)}).collect()}
    assert got == {0: 0, 1: None, 2: None, 3: 0, 4: 0}


def test_paths_of_doubles_nulls_and_many_graphs(spark):
    nodes = spark.createDataFrame([("g", 0, 1.6), ("g", 1, 1.6), ("g", 2, None)], "g string, n bigint, w double")
    edges = spark.createDataFrame([("g", 0, 1), ("g", 1, 2), ("g", 0, 9)], "g string, a bigint, b bigint")
    got = {r.n: (r.level, r.f) for r in dag.longest_paths(nodes, edges, "g", "n", "a", "b", "w", {"f": F.lit(0)}).collect()}
    assert got == {0: (0, 1.6), 1: (1, 3.2), 2: (2, 3.2)}
    big = spark.createDataFrame([("g", 0, 2**53 + 1), ("g", 1, None)], "g string, n bigint, w bigint")
    assert {r.f for r in dag.longest_paths(big, edges, "g", "n", "a", "b", "w", {"f": F.lit(0)}).collect()} == {2**53 + 1}
    many = spark.range(400).select((F.col("id") % 7).alias("g"), F.col("id").alias("n"), (F.col("id") % 13).alias("w"))
    far = many.select("g", F.col("n").alias("a"), (F.col("n") + 7 * (1 + F.col("n") % 3)).alias("b"))
    links = far.unionByName(many.select("g", F.col("n").alias("a"), (F.col("n") + 70).alias("b"))).filter("b < 400")
    best, depth = {}, {}
    before = {}
    for r in links.collect():
        before.setdefault(r.b, set()).add(r.a)
    for n in range(400):
        best[n] = n % 13 + max([n % 5, *(best[p] for p in before.get(n, ()))])
        depth[n] = max((depth[p] + 1 for p in before.get(n, ())), default=0)
    got = dag.longest_paths(many, links, "g", "n", "a", "b", "w", {"f": F.col("n") % 5}).collect()
    assert {r.n: (r.level, r.f) for r in got} == {n: (depth[n], best[n]) for n in range(400)}


def test_diamond_slack(spark):
    nodes = spark.createDataFrame([("g", 0, 5, 0, False), ("g", 1, 10, 0, False), ("g", 2, 3, 0, False), ("g", 3, 1, 0, True)], "g string, n bigint, w bigint, r bigint, sink boolean")
    edges = spark.createDataFrame([("g", 0, 1), ("g", 0, 2), ("g", 1, 3), ("g", 2, 3)], "g string, a bigint, b bigint")
    got = {r.n: (r.slack, r.on_critical_path) for r in dag.critical_path_slack(nodes, edges, "g", "n", "a", "b", "w", F.col("r"), "sink").collect()}
    assert got == {0: (0, True), 1: (0, True), 2: (7, False), 3: (0, True)}


def test_fork_join_tree(spark):
    rows = spark.createDataFrame(
        [("t", "r", None, 0, 100), ("t", "a", "r", 10, 40), ("t", "b", "r", 20, 50), ("t", "c", "r", 50, 60), ("t", "d", "a", 10, 20)], "k string, id string, up string, s bigint, e bigint"
    )
    got = {r.id: r.critical_path for r in dag.span_tree_critical_path(rows, ["k"], "id", "up", "s", "e").collect()}
    # Own time 50, the cluster of a and b counts once with 30, c opens the next one with 10.
    assert got == {"r": 90, "a": 30, "b": 30, "c": 10, "d": 10}


def test_orphans_and_cycles_of_spans_are_reported(spark):
    rows = spark.createDataFrame([("t", "r", None, 0, 10), ("t", "o", "gone", 0, 7), ("t", "k", "o", 1, 3), ("t", "x", "y", 0, 5), ("t", "y", "x", 0, 5)], "k string, id string, up string, s bigint, e bigint")
    got = {r.id: (r.span_status, r.critical_path) for r in dag.span_tree_critical_path(rows, ["k"], "id", "up", "s", "e").collect()}
    assert got == {"r": ("OK", 10), "o": ("ORPHAN", 7), "k": ("OK", 2), "x": ("CYCLE", None), "y": ("CYCLE", None)}


def test_weights_that_differ_in_high_bits(spark):
    rows = spark.createDataFrame([("k", 1, 0, 10, 5), ("k", 2, 1, 20, 5 + (1 << 40))], "k string, id bigint, sub bigint, st bigint, w bigint")
    got = {r.id: (r.width, r.heavier_waited) for r in pairing.choice_set_at_start(rows, ["k"], "id", "sub", "st", "w").collect()}
    assert got == {1: (2, True), 2: (1, False)}


def test_unresolved_provenance(spark):
    rows = spark.createDataFrame([("e1", ["x", "y", "x"]), ("e2", [])], "e string, ids array<string>")
    lookup = spark.createDataFrame([("x", "s1")], "id string, s string")
    got = {r.e: (r.resolved, r.unresolved) for r in pairing.resolve_provenance(rows, "e", "ids", lookup, "id", "s").collect()}
    assert got == {"e1": (["s1"], 1), "e2": ([], 0)}


def test_longer_stale_value_is_consumed_first(spark):
    samples = spark.createDataFrame([("s", "Lima")], "sample string, expected string")
    stale = spark.createDataFrame([("s", "Rome"), ("s", "New Rome"), ("s", "Oslo")], "sample string, stale_value string")
    edge = "sample string, edge_id int, source_key string, relation string, text string, valid_at bigint, invalid_at bigint, expired_at bigint"
    edges = spark.createDataFrame([("s", 1, "Ann", "lives", "Ann lives in Lima", None, None, None), ("s", 2, "ann", "LIVES", "in New Rome", None, None, None), ("s", 3, "Ann", "lives", "in Oslo", None, 5, None)], edge)
    got = one(temporal.inspect_current_state(samples, stale, edges, "sample", F.lit(10)))
    assert (got.status, got.stale_active, got.current_active) == ("AMBIGUOUS", 1, 1)


def test_graph_hash_ignores_order_only(spark):
    rows = spark.createDataFrame([("g", i % 7, "f") for i in range(50)], "g string, a bigint, f string")
    other = rows.unionByName(rows.limit(1))
    h = lambda d: one(snapshots.graph_hash({"e": d}, {"e": ["a", "f"]}, ["g"])).graph_hash
    assert h(rows) == h(rows.orderBy(F.desc("a")).repartition(3)) != h(other)


def test_fingerprint_sees_order(spark):
    a = spark.createDataFrame([("k", 1, "x"), ("k", 2, "y")], "k string, p int, v string")
    b = spark.createDataFrame([("k", 1, "y"), ("k", 2, "x")], "k string, p int, v string")
    fa, fb = (one(snapshots.fingerprint_records(d, ["k"], ["p"], ["v"])) for d in (a, b))
    assert fa.membership_digest == fb.membership_digest and fa.ordered_digest != fb.ordered_digest


def test_json_arrays_and_lines_in_one_folder(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.LongType())])
    (tmp_path / "array.json").write_text("\n [ {\"a\": 1},\n {\"a\": 2} ]\n")
    (tmp_path / "lines.json").write_text('{"a": 3}\n\n5\n{"a": 4}\n')
    (tmp_path / "cut.json").write_text('[{"a": 9}, ')
    good, bad = sources.read_json_records(spark, str(tmp_path), schema)
    assert sorted(r.a for r in good.collect()) == [1, 2, 3, 4] and sorted(r.value for r in bad.collect()) == ["5", '[{"a": 9}, ']


def test_tampered_and_regressing_lines(spark):
    import hashlib
    import random

    def line(seq, at, tamper=False):
        body = json.dumps({"row": {"p": "w", "q": seq, "t": at}, "schema_version": "v1"}, separators=(",", ":"))
        return '{"record":' + body + ',"record_sha256":"' + hashlib.sha256((body + ("x" if tamper else "")).encode()).hexdigest() + '"}'

    text = spark.createDataFrame([(line(0, 10),), (line(1, 9),), (line(2, 20, True),), (line(3, 30),), ("{}",)], "value string")
    schema = T.StructType([T.StructField("p", T.StringType()), T.StructField("q", T.LongType()), T.StructField("t", T.LongType())])
    got = sorted((r.q is None, r.q, r.seal_status) for r in sources.verify_sealed_lines(text, "v1", schema, "p", "q", "t").collect())
    assert got == [(False, 0, "OK"), (False, 1, "TIME_REGRESSION"), (False, 2, "HASH_MISMATCH"), (False, 3, "SEQUENCE_GAP"), (True, None, "ENVELOPE_INVALID")]
    # Keys in another order and blanks do not matter; further keys in the envelope do.
    loose = json.loads(line(0, 10))
    turned = json.dumps({"record_sha256": loose["record_sha256"], "record": {"schema_version": "v1", "row": dict(reversed(loose["record"]["row"].items()))}})
    more = json.dumps({**loose, "extra": 1})
    text = spark.createDataFrame([(turned,), (more,)], "value string")
    assert sorted(r.seal_status for r in sources.verify_sealed_lines(text, "v1", schema, "p", "q", "t").collect()) == ["ENVELOPE_INVALID", "OK"]


def test_row_hashes_tell_rows_apart(spark):
    rows = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "x"), ("~", "x"), ("", "x"), ("1:a", None)], "a string, b string")
    assert rows.select(row_hash(F.col("a"), F.col("b"))).distinct().count() == 6


def test_text_helpers(spark):
    row = one(
        spark.createDataFrame([("ﬁne – ×2  STRASSE ß", '{"a":"\\":","b":{"Prompt":[{"c":1}]}}', "2024/01/05 (Fri) 10:30")], "t string, j string, d string").select(
            normalize_display(F.col("t")).alias("t"), json_keys(F.col("j")).alias("k"), event_time_us(F.col("d")).alias("d"), event_time_us(F.lit("nope")).alias("none")
        )
    )
    assert row.t == "fine - x2 strasse ss" and row.k == ["a", "b", "Prompt", "c"] and row.d == 1704450600000000 and row.none is None
    assert glob_to_regex("eventqa*?.v1") == r"(?s)^eventqa.*.\.v1$"


def test_private_columns_are_refused(spark):
    df = spark.createDataFrame([("q", "gold"), (" ", "x")], "question string, answer string")
    with pytest.raises(ValueError):
        records.gold_blind_projection(df, ["question", "answer"], ["answer"])
    with pytest.raises(Exception, match="blank public field"):
        records.gold_blind_projection(df, ["question"], ["answer"]).collect()


def test_context_is_one_json_list(spark):
    rows = "q string, rank int, raw_evidence string, ts_us bigint, source_id string"
    facts = spark.createDataFrame([("q", 1, "Same  Text", 20, "f1"), ("q", 2, "late", None, "f2")], rows)
    rounds = spark.createDataFrame([("q", 1, "same text", 10, "s1"), ("q", 2, "early", 5, "s2")], rows)
    pack = one(retrieval.context_pack(retrieval.context_rows(facts, rounds, ["q"]), ["q"]))
    assert [x["source_id"] for x in json.loads(pack.context_json)] == ["s2", "f1", "f2"] and pack.evidence_count == 3


def test_first_rule_wins_and_null_does_not_hold(spark):
    rows = spark.createDataFrame([(1, None), (5, 2.0), (0, 9.0)], "a int, b double")
    rules = [gates.Rule("b > 1", "STOP", "b"), gates.Rule("a > 0", "GO", "a")]
    assert sorted(r.verdict for r in gates.rule_gate(rows, rules, ("NONE", "none")).collect()) == ["GO", "STOP", "STOP"]


def two_batches(spark, build, schema, first, second):
    """What a stream emits when ``second`` arrives after ``first`` has been processed."""
    path, out, check = (fresh_path(spark, n) for n in ("two-in", "two-out", "two-check"))
    for rows in (first, second):
        spark.createDataFrame(rows, schema).withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)
        run_available(build(spark.readStream.schema(schema.replace("at string", "at timestamp")).parquet(path)), out, check)
    return spark.read.parquet(out)


def test_hot_keys_do_not_depend_on_arrival(spark):
    build = lambda s: streaming.recent_hot_keys(s, "stream", "item", "seq", "at", window=8, threshold=3, delay="1 hour")
    at = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    rows = [(1, "x", s, at(s)) for s in (100, 1, 2)]
    schema = "stream bigint, item string, seq bigint, at string"
    late = [(1, "x", 3, at(3)), (9, "z", 0, "2024-01-02 00:00:00")]
    assert [(r.stream, r.seq) for r in two_batches(spark, build, schema, rows, late).collect()] == [(1, 3)]


def test_lifecycle_twins_agree(spark):
    from tidemark.plans.stream_queries import LIFE, life_events, with_cents
    from tidemark.plans.inputs import table

    sf = "/root/testdata/sf0.001"
    rows = with_cents(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    batch = streaming.lifecycle_batch(life_events(rows), ["event_id", "user_id"], "event", "at_us", LIFE)
    from tidemark.plans import registry

    stream = registry.load_all()["lifecycle_assembly"].run(spark, sf)
    assert sorted(map(tuple, batch.collect()), key=str) == sorted(map(tuple, stream.select(batch.columns).collect()), key=str)


def test_missing_measurements_are_named(spark):
    rows = [("a", True, True, 10, 1, 1), ("b", True, None, 10, 1, 1), ("c", True, True, 10, 1, -1), ("d", True, False, 10, 1, 1)]
    df = spark.createDataFrame(rows, "k string, reuse boolean, parity boolean, ex long, sp long, ov long")
    value = lambda overlap: {r.k: r for r in rollups.speculation_value(df, ["k"], "reuse", "parity", "ex", "sp", "ov", overlap).collect()}
    got = value(0)
    assert {k: (r.decision, r.missing_fields, r.net_saved_ns) for k, r in got.items()} == {
        "a": ("POTENTIAL_BUT_NO_OVERLAP", "", 8),
        "b": ("DATA_INSUFFICIENT", "state_parity", None),
        "c": ("DATA_INSUFFICIENT", "validation_overhead_ns", None),
        "d": ("UNSAFE", "", None),
    }
    assert {r.missing_fields for r in value(None).values()} == {"overlap_exposed_ns", "overlap_exposed_ns,state_parity", "overlap_exposed_ns,validation_overhead_ns"}


def test_gauges_hold_until_the_next_scrape(spark):
    rows = [("a", 0, 1, 10.0), ("a", 9, 2, 0.0), ("a", 10, 3, 4.0), ("b", 5, 1, 3.0)]
    df = spark.createDataFrame(rows, "k string, ts long, c long, g double")
    got = {r.k: r for r in rollups.telemetry_reduce(df, ["k"], "ts", ["c"], gauges=["g"]).collect()}
    assert (got["a"].g_mean, got["a"].g_above_zero, got["a"].g_p95, got["a"].g_max) == (9.0, 0.9, 10.0, 10.0)
    assert (got["b"].g_mean, got["b"].g_above_zero, got["b"].g_status) == (3.0, 1.0, "OK")


def test_partitions_without_candidates(spark):
    parts = spark.createDataFrame([(1,), (2,), (3,)], "p int")
    rows = spark.createDataFrame([(1, "i", "f"), (1, "i", "f"), (1, "j", "f"), (2, "i", "f")], "p int, i string, f string")
    got = {r.p: r for r in rollups.candidate_partition_diagnosis(parts, rows, ["p"], "i", "f").collect()}
    assert [got[p].classification for p in (1, 2, 3)] == ["AMBIGUOUS", "UNIQUE", "EMPTY"]
    assert (got[1].identity_multiplicity, got[1].fact_multiplicity, got[3].identity_multiplicity, got[3].candidates) == ("1x1 2x1", "3x1", "", 0)


def test_value_chain_pairs_over_tiles(spark, monkeypatch):
    import random

    rng = random.Random(8)
    ops = [(rng.choice("ab"), i, rng.choice([None, 1, 2, 3]), rng.choice([1, 2, 3]), rng.randint(0, 2)) for i in range(90)]
    df = spark.createDataFrame(ops, "t string, p int, o int, n int, s int")
    live = [x for x in ops if x[2] is not None and x[2] != x[3]]
    want = sorted((a[0], a[1], b[1], b[2], a[4], b[4]) for a in live for b in live if a[0] == b[0] and a[1] < b[1] and a[3] == b[2] and a[2] != b[3] and a[4] != b[4])
    for tile in (3, 4096):
        monkeypatch.setattr(pairing, "TILE", tile)
        assert sorted(map(tuple, pairing.value_chain_pairs(df, ["t"], "p", "o", "n", "s").collect())) == want
    assert want


def test_recently_hot_items(spark):
    import random

    rng = random.Random(9)
    published = [(g, p, i) for g in (1, 2) for p in range(1, 40) for i in {rng.choice("xyz"), rng.choice("xyz")}]
    asked = [(100 * g + p, g, p, i) for g in (1, 2) for p in range(0, 42, 3) for i in "xyz"]
    for threshold in (1, 2, 4):
        got = pairing.recent_hot_items(spark.createDataFrame(published, "g int, p long, i string"), spark.createDataFrame(asked, "c int, g int, p long, i string"), "g", "p", ["i"], "c", window=6, threshold=threshold)
        want = sorted((c, i) for c, g, p, i in asked if sum(1 for a, q, j in published if a == g and j == i and p - 6 < q <= p) >= threshold)
        assert sorted(map(tuple, got.collect())) == want and want


def test_pooled_sums_past_64_bits(spark):
    from tidemark.plans.rollup_queries import narrowed

    blocks = spark.createDataFrame([("a", 1.0, 6 * 10**18, 1, 2)] * 2 + [("b", 0.5, 7, 0, 1)], "m string, accuracy double, makespan bigint, violations bigint, backlog bigint")
    samples = spark.createDataFrame([("a", 3), ("b", 4)], "m string, v bigint")
    table = rollups.pooled_method_table(blocks, samples, "m", ["accuracy"], ["makespan", "violations"], ["backlog"], "v", "makespan")
    exact = {r.m: (int(r.sum_makespan), r.goodput_per_s) for r in table.collect()}
    assert exact == {"a": (12 * 10**18, 1 / 12e9), "b": (7, 1e9 / 7)}
    fits = {r.m: (r.sum_makespan, r.sum_violations) for r in narrowed(table).collect()}
    assert fits == {"a": (None, 2), "b": (7, 0)}


def test_rounding_is_that_of_the_sql(spark):
    import duckdb

    values = [41 / 640, -41 / 640, 1.0000005, 2.5e-6, 0.5e-6, 123456.7890125, 1 / 3, 0.0, 5e15, float("inf"), None]
    values += [n / 640 for n in range(641)] + [n / 1024 for n in range(0, 1025, 7)]
    got = [r.v for r in spark.createDataFrame(list(enumerate(values)), "i int, v double").orderBy("i").select(round_double(F.col("v"), 6).alias("v")).collect()]
    con = duckdb.connect()
    assert got == [con.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in values]
    assert round(41 / 640 * 1e6) == 64062 and got[0] == 0.064062


def test_scrapes_of_two_sources_at_one_instant(spark):
    lines = ['up{instance="a"} 1 5', 'load{model="m",instance="a"} 2 5', 'up{instance="b"} 3 5', 'load{model="m",instance="b"} 4 5', 'load{model="m",instance="b"} 4 5', 'up{instance="a"} 6 9']
    text = spark.createDataFrame([(x,) for x in lines], "value string")
    rows = {(r.instance, r.ts): (r.up, r.load, r.series_status) for r in sources.read_metric_text(text, {"up": "up", "load": "load"}, "instance").collect()}
    assert rows == {("a", 5): (1.0, 2.0, "OK"), ("b", 5): (3.0, 4.0, "DUPLICATE"), ("a", 9): (6.0, None, "INCOMPLETE")}
    assert {(r.ts, r.up, r.series_status) for r in sources.read_metric_text(text, {"up": "up", "load": "load"}).collect()} == {(5, 3.0, "DUPLICATE"), (9, 6.0, "INCOMPLETE")}


def test_metric_query_keeps_events_of_one_instant(spark, tmp_path):
    from tidemark.plans import registry

    spark.sql("SELECT 7L event_id, TIMESTAMP_NTZ'2024-01-01 00:00:00' ts, 1L user_id, 'view' event_type, 2.5D value UNION ALL SELECT 8L, TIMESTAMP_NTZ'2024-01-01 00:00:00', 2L, 'view', 3.5D").write.parquet(f"{tmp_path}/events.parquet")
    rows = registry.load_all()["read_metric_text"].run(spark, str(tmp_path)).collect()
    assert sorted((r.running, r.tokens, r.series_status) for r in rows) == [(250.0, 7.0, "OK"), (350.0, 8.0, "OK")]


@pytest.mark.parametrize("cell", [1024, 4096])
def test_replicates_drawn_in_tasks_are_the_drawn_rows(spark, cell):
    n, samples, seed = 2500, 40, 20260806
    units = spark.range(n).select(F.col("id").alias("_i"), F.lit(n).cast("long").alias("_n"), F.when(F.col("id") % 7 != 3, F.ln(F.col("id") + 1.0)).alias("_ln"))
    want = {r._b: (r.s, r.k) for r in statistics._replicates(units, seed, samples).join(units.select("_i", "_ln"), "_i").groupBy("_b").agg(F.sum("_ln").alias("s"), F.count("_ln").alias("k")).collect()}
    parts = statistics._replicate_logs(units, seed, samples, cell)
    # one row per replicate and range of positions comes back, not one per draw
    assert parts.count() == samples * -(-n // cell)
    got = {r._b: (r.s, r.k) for r in parts.groupBy("_b").agg(F.sum("_s").alias("s"), F.sum("_k").alias("k")).collect()}
    assert got.keys() == want.keys()
    assert all(got[b][1] == want[b][1] and math.isclose(got[b][0], want[b][0], rel_tol=1e-12) for b in want)


def test_common_prefix_of_pairs(spark):
    texts = {1: ["a", "b", "c"], 2: ["a", "b"], 3: ["a", "x", "c"], 4: [], 5: None, 6: ["a", "b", "c"]}
    rows = spark.createDataFrame(list(texts.items()), "id int, blocks array<string>")
    pairs = spark.createDataFrame([(1, 2), (2, 1), (1, 3), (1, 4), (1, 5), (1, 6), (4, 4), (1, 9)], "a int, b int")
    out = retrieval.prefix_match_length(pairs, rows, "id", "blocks", "a", "b", 4)
    assert {(r.a, r.b): r.matched for r in out.collect()} == {(1, 2): 8, (2, 1): 8, (1, 3): 4, (1, 4): 0, (1, 5): 0, (1, 6): 12, (4, 4): 0, (1, 9): 0}
    # no row per block
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_hot_items_lay_rows_out_once(spark):
    published = spark.createDataFrame([(1, p, "x") for p in (1, 2, 2, 3, 9)] + [(1, 4, "y")], "g int, p long, i string")
    asked = spark.createDataFrame([(1, 3, "x", 50), (1, 2, "x", 51), (1, 9, "x", 52), (1, 4, "y", 53)], "g int, p long, i string, c int")
    out = pairing.recent_hot_items(published, asked, "g", "p", ["i"], "c", window=8, threshold=3)
    # the repeat at 2 does not count for 51; at 9 the third latest is 2
    assert {(r.c, r.i) for r in out.collect()} == {(50, "x"), (52, "x")}
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_conflict_signatures_are_hashed_not_sorted(spark):
    nodes = spark.createDataFrame([(1, "x", "Ann", "T", "a"), (1, "y", "Bob", "T", "b"), (2, "x", " ", "T", "c"), (3, None, "Cy", None, "d")], "unit int, ns string, name string, label string, node string")
    edges = spark.createDataFrame([(1, "a", "b"), (2, "c", "c"), (4, "e", "e")], "unit int, source string, target string")
    found = records.conflict_signature(nodes, edges, "unit", "ns", "name", "label", "node", "source", "target")
    got = {r.unit: (r.n_names, r.n_types, r.n_endpoints, r.reasons) for r in found.collect()}
    assert got == {1: (2, 2, 2, "MIXED_NAMESPACES"), 2: (0, 0, 0, "ENTITY_NAME_INVALID,RELATION_ENDPOINT_UNRESOLVED"), 3: (1, 1, 0, "")}
    # sets and flags of a unit are summed in a hash table
    last = found._jdf.queryExecution().optimizedPlan().toString().split("Aggregate [unit", 2)[1]
    assert "min(" not in last and last.count("sha2(") <= 6


def test_conflict_signatures_hash_whole_sorted_sets(spark, monkeypatch):
    import hashlib
    import random

    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    frame = lambda *values: "".join("~" if v is None else f"{len(v)}:{v}" for v in values)
    draw = random.Random(9)
    units = {u: [(u, draw.choice("xy") if u == 1 else "x", f" N{draw.randrange(900)}  é" if i else " ", draw.choice(["T", "U", None]), f"i{i // 2 if u == 2 else i}") for i in range(n)] for u, n in ((1, 2300), (2, 7), (None, 5))}
    rows = [r for u in units for r in units[u]]
    links = [(u, r[4], r[4] if draw.random() < 0.5 else draw.choice(units[u])[4]) for u in units for r in units[u] if draw.random() < 0.3] + [(2, "i1", None), (3, "i1", "i2")]
    nodes = spark.createDataFrame(rows, "unit int, ns string, name string, label string, node string").repartition(5)
    edges = spark.createDataFrame(links, "unit int, source string, target string")
    want = {}
    for u, own in units.items():
        canon = lambda r: " ".join(r[2].lower().split())
        ends = {e for l in links if l[0] == u for e in l[1:]}
        names = sorted({canon(r) for r in own if canon(r)})
        types = sorted({(canon(r), r[3]) for r in own if canon(r)}, key=lambda t: (t[0], t[1] or ""))
        met = sorted({canon(r) for r in own if canon(r) and r[4] in ends})
        digest = lambda items: sha("".join(sha("".join(items[i : i + 1000])) for i in range(0, len(items), 1000))) if items else None
        want[u] = (len(names), len(types), len(met), digest([frame(n) for n in names]), digest([frame(*t) for t in types]), digest([frame(n) for n in met]))
    call = lambda: records.conflict_signature(nodes, edges, "unit", "ns", "name", "label", "node", "source", "target")
    plain = call()
    got = {r.unit: tuple(r)[1:] for r in plain.collect()}
    assert {u: g[:6] for u, g in got.items()} == want and max(w[1] for w in want.values()) > 1000
    # one shuffle by unit: both aggregates go by its partitions
    assert plain._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
    monkeypatch.setattr(records, "UNIT_ROWS", 6)
    assert {r.unit: tuple(r)[1:] for r in call().collect()} == got


def test_diff_keys_are_bytes(spark):
    left = spark.createDataFrame([(1, 1, "a"), (1, 1, "a"), (1, 2, None)], "g int, x int, y string")
    right = spark.createDataFrame([(1, 1, "b"), (1, 3, None), (2, 1, "a")], "g int, x int, y string")
    found = snapshots.canonical_diff({"t": left}, {"t": right}, {"xs": ("t", ["x"]), "both": ("t", ["x", "y"])}, ["g"])
    assert sorted(map(tuple, found.collect())) == [(1, 2, 4, 6, False), (2, 1, 1, 2, False)]
    # what is shuffled is half as long as the hex digits
    assert "unhex(sha2(" in found._jdf.queryExecution().optimizedPlan().toString()


def test_facts_are_read_once_for_the_latest(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def passed(fact):
        seen.add(1)
        return fact

    rows = [(1, "Q 1", "stale", 1, 5, 5), (1, "q  2", "active", 2, 6, 6), (1, "q 2", "stale", 3, 7, 7), (2, "a", "active", 1, 1, 1), (3, "a", "stale", 1, None, 1), (3, "b", "active", 2, None, 2)]
    facts = spark.createDataFrame(rows, "g int, fact string, status string, rank bigint, valid bigint, ref bigint").withColumn("fact", passed.asNondeterministic()("fact"))
    found = temporal.latest_valid_fact(facts, ["g"], "fact", "status", "rank", "valid", "ref")
    assert sorted(map(tuple, found.collect())) == [(1, 2, 1), (3, 2, 1)] and seen.value == len(rows)


def test_observed_rows_are_counted_in_one_pass(spark):
    rows = spark.createDataFrame([("a", 1, 1, 2), ("b", 2, 1, None), ("c", 1, None, 0), ("c", 0, 1, 4), ("d", None, None, None)], "k string, q int, g int, s int")
    got = pairing.observability_by_source(rows, {"queue": F.col("q"), "graph_work": F.col("g")}, {"span": F.col("s")}, ["k"])
    assert sorted(map(tuple, got.collect())) == [("a", 1, 1, 2, True), ("b", 2, 1, 0, False), ("c", 1, 1, 4, True), ("d", 0, 0, 0, False)]
    from tidemark.plans import registry

    out = registry.load_all()["observability_rows_by_source"].run(spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and plan.count("Relation") == 1
