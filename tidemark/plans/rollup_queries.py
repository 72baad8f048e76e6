"""Queries that roll episodes up to runs, phases, histories, blocks and methods."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.digests import row_hash
from tidemark.functions.measures import round_double
from tidemark.operators import rollups as ru
from tidemark.operators import snapshots as sn
from tidemark.operators import statistics as st
from tidemark.operators.ordered import Running, ordered_scan
from tidemark.plans.inputs import EV, LINES, QA, ROOTS, RUNS, judged, lifecycle, line_spans, root_spans, runs, sequenced, table, turns, whole
from tidemark.plans.interval_queries import REQ, STREAM_SWEEP, islands_sql, requests, sweep_sql
from tidemark.plans.registry import query
from tidemark.plans.statistic_queries import ACCURACY, SAMPLES_CLUSTER, SEED, cluster_sql, dist_rounded, dist_sql, rounded


@query(
    "episode_run_summary",
    f"""WITH {EV} SELECT stream, kind, event_id % 2 AS repeat, max(publish_ns)-min(arrival_ns) AS makespan, max(publish_ns)-max(arrival_ns) AS drain, count(*) AS episode_count,
 round(quantile_cont(cents,0.5),4) AS p50, round(quantile_cont(cents,0.95),4) AS p95, round(quantile_cont(cents,0.99),4) AS p99 FROM ev GROUP BY ALL""",
)
def _(spark, sf):
    rows = lifecycle(spark, sf).withColumn("repeat", F.col("event_id") % 2)
    return rounded(ru.episode_run_summary(rows, ["stream", "kind", "repeat"], "arrival_ns", "publish_ns", "cents"), 4, "p50", "p95", "p99")


@query(
    "block_timing",
    f"""WITH {EV} SELECT stream, max(start_ns)-min(arrival_ns) AS build_makespan_ns, max(start_ns)-max(arrival_ns) AS drain_tail_ns, max(publish_ns)-max(start_ns) AS validation_seal_latency_ns,
 max(arrival_ns) <= max(start_ns) AND max(start_ns) <= max(publish_ns) AS in_order FROM ev GROUP BY 1""",
)
def _(spark, sf):
    return ru.block_timing(lifecycle(spark, sf), ["stream"], "arrival_ns", "start_ns", "publish_ns")


@query(
    "block_outcome_metrics",
    f"""WITH {EV}, o AS (SELECT *, CASE event_id % 10 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'CENSORED' ELSE 'PUBLISHED' END AS st, CASE WHEN event_id % 10 <> 1 THEN publish_ns END AS term FROM ev)
 SELECT stream, count(*) AS expected, count(*) FILTER (st='PUBLISHED') AS published, count(*) FILTER (st='FAILED') AS failed, count(*) FILTER (st='CENSORED') AS censored,
 max(term)-min(start_ns) FILTER (term IS NOT NULL) AS makespan_ns, quantile_disc(publish_ns-arrival_ns,0.95) FILTER (st='PUBLISHED') AS p95_freshness_ns,
 round(count(*) FILTER (st='PUBLISHED')*1000000000.0::DOUBLE/(max(term)-min(start_ns) FILTER (term IS NOT NULL)),9) AS goodput_per_s FROM o GROUP BY 1""",
)
def _(spark, sf):
    e = F.col("event_id") % 10
    rows = lifecycle(spark, sf).withColumns(
        {"status": F.when(e == 0, "FAILED").when(e == 1, "CENSORED").otherwise("PUBLISHED"), "terminal_ns": F.when(e != 1, F.col("publish_ns"))}
    )
    return rounded(ru.block_outcome_metrics(rows, ["stream"], "status", "arrival_ns", "start_ns", "publish_ns", "terminal_ns"), 9, "goodput_per_s")


@query(
    "aligned_performance",
    f"""WITH {EV}, {STREAM_SWEEP}, {sweep_sql("wt", "ev", "stream", "arrival_ns", "start_ns")}, a AS (SELECT stream, max(active) AS m FROM sw GROUP BY 1), b AS (SELECT stream, max(active) AS m FROM wt GROUP BY 1)
 SELECT stream, count(*) AS episode_count, max(publish_ns)-min(arrival_ns) AS makespan_ns, quantile_disc(publish_ns-arrival_ns,0.95) AS p95_freshness_ns, quantile_disc(publish_ns-arrival_ns,0.99) AS p99_freshness_ns,
 max(a.m) AS max_outstanding, max(b.m) AS max_waiting, round(count(*)*1000000000.0::DOUBLE/(max(publish_ns)-min(arrival_ns)),9) AS goodput_per_s FROM ev JOIN a USING (stream) JOIN b USING (stream) GROUP BY 1""",
)
def _(spark, sf):
    return rounded(ru.aligned_performance(lifecycle(spark, sf), ["stream"], "arrival_ns", "start_ns", "publish_ns"), 9, "goodput_per_s")


@query(
    "history_metrics",
    f"""WITH {EV}, l AS (SELECT stream, unnest(['queue_delay','service','freshness']) AS metric, unnest([start_ns-arrival_ns, publish_ns-start_ns, publish_ns-arrival_ns])//1000000 AS ms FROM ev
  UNION ALL SELECT stream, 'terminal', (publish_ns-arrival_ns)//1000000 + 1000 FROM ev), d AS ({dist_sql("stream, metric", "l", "ms")}),
 s AS (SELECT stream, count(*) AS episode_count, max(publish_ns//1000000+1000)-min(arrival_ns//1000000) AS makespan_ns, max(cents % 8) AS max_backlog, CAST(sum(cents) AS BIGINT) AS tokens, 'OBSERVED' AS max_backlog_status FROM ev GROUP BY 1)
 SELECT d.*, episode_count, makespan_ns, max_backlog, tokens, max_backlog_status, round(episode_count*1000000000.0::DOUBLE/makespan_ns,6) AS goodput_per_s FROM d JOIN s USING (stream)""",
)
def _(spark, sf):
    a, s, p = F.col("arrival_ns"), F.col("start_ns"), F.col("publish_ns")
    rows = lifecycle(spark, sf).select(
        "stream", whole(a, 1_000_000).alias("a"), F.col("cents"), (whole(a, 1_000_000) + whole(s - a, 1_000_000)).alias("s"), (whole(a, 1_000_000) + whole(p - a, 1_000_000)).alias("p"), (F.col("cents") % 8).alias("depth")
    ).withColumn("t", F.col("p") + 1000)
    out = ru.history_metrics(rows, ["stream"], "a", "s", "p", "t", "depth", {"tokens": F.col("cents")})
    return dist_rounded(rounded(out, 6, "goodput_per_s"))


@query(
    "phase_metrics",
    f"""WITH {LINES}, {islands_sql("isl", "lines", "trace, phase", "start_ns", "end_ns")}, u AS (SELECT trace, phase, sum(e-s) AS d FROM isl GROUP BY ALL)
 SELECT trace, phase, count(*) AS span_count, CAST(sum(quantity) AS BIGINT) AS quantity, CAST(sum(price) AS BIGINT) AS price, CAST(coalesce(max(d),0) AS BIGINT) AS duration_ns FROM lines LEFT JOIN u USING (trace, phase) GROUP BY ALL""",
)
def _(spark, sf):
    return ru.phase_metrics(line_spans(spark, sf), ["trace"], "phase", "start_ns", "end_ns", ["quantity", "price"])


@query(
    "phase_occupancy",
    f"""WITH {LINES}, {ROOTS}, {islands_sql("isl", "lines", "trace, phase", "start_ns", "end_ns")}, u AS (SELECT trace, phase, sum(e-s) AS d FROM isl GROUP BY ALL), n AS (SELECT trace, phase, count(*) AS span_count FROM lines GROUP BY ALL)
 SELECT trace, phase, span_count, CAST(coalesce(d,0) AS BIGINT) AS duration_ns, end_ns-start_ns AS root_ns, round(CASE WHEN end_ns>start_ns THEN CAST(coalesce(d,0) AS DOUBLE)/(end_ns-start_ns) ELSE 0 END,6) AS occupancy_fraction
 FROM n LEFT JOIN u USING (trace, phase) JOIN roots USING (trace)""",
)
def _(spark, sf):
    return rounded(ru.phase_occupancy(line_spans(spark, sf), root_spans(spark, sf), ["trace"], "phase", "start_ns", "end_ns"), 6, "occupancy_fraction")


@query(
    "work_counters",
    f"""WITH {LINES} SELECT trace, count(*) FILTER (phase='R') AS r_calls, count(*) FILTER (phase='A') AS a_calls, count(*) FILTER (phase='N' AND status='O') AS n_open, count(*) FILTER (phase='N' AND status='F') AS n_errors,
 CAST(sum(CASE WHEN phase='R' THEN quantity ELSE 0 END) AS BIGINT) AS r_tokens, CAST(sum(CASE WHEN phase='A' THEN price ELSE 0 END) AS BIGINT) AS a_cost FROM lines GROUP BY 1""",
)
def _(spark, sf):
    ph, st = F.col("phase"), F.col("status")
    return ru.work_counters(
        line_spans(spark, sf),
        ["trace"],
        {"r_calls": ph == "R", "a_calls": ph == "A", "n_open": (ph == "N") & (st == "O"), "n_errors": (ph == "N") & (st == "F")},
        {"r_tokens": (ph == "R", F.col("quantity")), "a_cost": (ph == "A", F.col("price"))},
    )


@query("sum_counter_maps", f"WITH {EV} SELECT stream, c AS counter, CAST(sum(v) AS BIGINT) AS total FROM (SELECT stream, kind AS c, cents AS v FROM ev UNION ALL SELECT stream, 'calls', 1 FROM ev) GROUP BY ALL")
def _(spark, sf):
    rows = lifecycle(spark, sf).select("stream", F.create_map(F.col("kind"), F.col("cents"), F.lit("calls"), F.lit(1).cast("long")).alias("counters"))
    return ru.sum_counter_maps(rows, ["stream"], "counters")


PROFILE = """pf AS (SELECT dimension, member, count(*) AS calls, CAST(sum(quantity) AS BIGINT) AS tokens, CAST(sum((end_ns-start_ns)//1000000000) AS BIGINT) AS service_s FROM (
 SELECT 'ALL' AS dimension, NULL AS member, * FROM lines UNION ALL SELECT 'phase', phase, * FROM lines UNION ALL SELECT 'status', status, * FROM lines UNION ALL SELECT 'supplier', CAST(supplier AS VARCHAR), * FROM lines) GROUP BY ALL)"""
LINES_S = LINES.replace("l_linestatus AS status,", "l_linestatus AS status, l_suppkey AS supplier,")


@query(
    "block_operator_profile",
    f"""WITH {LINES_S}, {PROFILE}, s AS (SELECT dimension, sum(calls) AS c, sum(tokens) AS t, sum(service_s) AS v FROM pf GROUP BY 1), a AS (SELECT * FROM s WHERE dimension='ALL')
 SELECT pf.*, s.c = a.c AND s.t = a.t AND s.v = a.v AS reconciled FROM pf JOIN s USING (dimension), a""",
)
def _(spark, sf):
    rows = line_spans(spark, sf).withColumn("supplier", F.split("span_id", "-").getItem(2))
    profile = ru.grouped_profile(
        rows,
        ["phase", "status", "supplier"],
        [F.count(F.lit(1)).alias("calls"), F.sum("quantity").alias("tokens"), F.sum(F.floor((F.col("end_ns") - F.col("start_ns")) / 1_000_000_000)).alias("service_s")],
    )
    check = ru.reconcile_profile(profile, ["calls", "tokens", "service_s"]).select("dimension", "reconciled")
    return profile.join(check, "dimension")


@query(
    "work_delta",
    f"""WITH {LINES}, b AS (SELECT quantity AS operator, count(*) AS c, sum(price) AS t FROM lines WHERE status='O' GROUP BY 1), d AS (SELECT quantity AS operator, count(*) AS c, sum(price) AS t FROM lines WHERE status='F' GROUP BY 1),
 j AS (SELECT operator, CAST(coalesce(d.c,0)-coalesce(b.c,0) AS BIGINT) AS call_delta, CAST(coalesce(d.t,0)-coalesce(b.t,0) AS BIGINT) AS token_delta FROM b FULL JOIN d USING (operator))
 SELECT *, CASE WHEN call_delta=0 THEN 'UNKNOWN' WHEN operator=1 THEN 'repeated_work' WHEN operator=2 THEN 'batching' ELSE 'state_divergence' END AS category FROM j WHERE call_delta<>0 OR token_delta<>0""",
)
def _(spark, sf):
    rows = line_spans(spark, sf).withColumnRenamed("quantity", "operator")
    side = lambda s: rows.filter(F.col("status") == s).groupBy("operator").agg(F.count(F.lit(1)).alias("calls"), F.sum("price").alias("tokens"))
    return ru.work_delta(side("O"), side("F"), "operator", "calls", "tokens", {1: "repeated_work", 2: "batching"})


@query(
    "construction_main_table",
    f"""WITH {RUNS}, m AS (SELECT method, count(DISTINCT question) AS histories, count(*) AS episodes, CAST(sum(metric) AS BIGINT) AS makespan, CAST(sum(run_id % 1000) AS BIGINT) AS tokens, count(*) FILTER (status='P') AS violations FROM runs GROUP BY 1)
 SELECT m.*, round(CAST(b.makespan AS DOUBLE)/m.makespan,6) AS speedup_vs_base, round(CAST(m.tokens AS DOUBLE)/b.tokens,6) AS token_ratio, round(CAST(m.tokens AS DOUBLE)/m.makespan,9) AS tokens_per_unit FROM m, (SELECT * FROM m WHERE method='1') b""",
)
def _(spark, sf):
    rows = runs(spark, sf).groupBy("method").agg(
        F.countDistinct("question").alias("histories"),
        F.count(F.lit(1)).alias("episodes"),
        F.sum("metric").alias("makespan"),
        F.sum(F.col("run_id") % 1000).alias("tokens"),
        F.count_if(F.col("status") == "P").alias("violations"),
    )
    out = ru.against_base(rows, "method", "1", {"speedup_vs_base": ("makespan", True), "token_ratio": ("tokens", False)})
    out = out.withColumn("tokens_per_unit", round_double(ru.ratio(F.col("tokens"), F.col("makespan")), 9))
    return rounded(out, 6, "speedup_vs_base", "token_ratio")


@query(
    "quality_main_table",
    f"""WITH {QA}, r AS (SELECT *, CASE WHEN method='A' THEN item % 12 + 1 ELSE item % 9 + 1 END AS rk FROM qa)
 SELECT method, count(*) AS qa_n, round(avg(CASE WHEN rk<=1 THEN 1.0 ELSE 0.0 END),6) AS recall_at_1, round(avg(CASE WHEN rk<=5 THEN 1.0 ELSE 0.0 END),6) AS recall_at_5, round(avg(CASE WHEN rk<=10 THEN 1.0 ELSE 0.0 END),6) AS recall_at_10, round(avg(1.0::DOUBLE/rk),6) AS mrr,
 round(CAST(count(*) FILTER (correct) AS DOUBLE)/count(*),6) AS accuracy_invalid_wrong, count(*) FILTER (NOT judge_valid) AS invalid, round(CAST(count(*) FILTER (correct) AS DOUBLE)/count(*) FILTER (judge_valid),6) AS valid_only_accuracy FROM r GROUP BY 1""",
)
def _(spark, sf):
    rank = F.when(F.col("method") == "A", F.col("item") % 12 + 1).otherwise(F.col("item") % 9 + 1)
    rows = judged(spark, sf).withColumn("rk", rank)
    for k in (1, 5, 10):
        rows = rows.withColumn(f"recall_at_{k}", (F.col("rk") <= k).cast("double"))
    names = ["recall_at_1", "recall_at_5", "recall_at_10", "mrr"]
    out = ru.quality_main_table(rows.withColumn("mrr", 1 / F.col("rk")), "method", names, "correct", "judge_valid")
    return rounded(out, 6, *names, "accuracy_invalid_wrong", "valid_only_accuracy")


_INTERVALS = cluster_sql("SELECT method, context AS c, count(*) FILTER (correct) AS k, count(*) FILTER (judge_valid) AS v FROM qa GROUP BY ALL", ACCURACY, "method, ")


@query(
    "method_summary",
    f"""WITH {QA}, {_INTERVALS}, y AS (SELECT *, CASE WHEN NOT judge_valid THEN CASE item % 3 WHEN 0 THEN 'judge_timeout' WHEN 1 THEN 'unparsable' ELSE 'unknown' END END AS fc, CASE WHEN item % 5 <> 1 THEN item % 11 END AS recall, item % 7 AS mrr FROM qa),
 x AS (SELECT *, 'ALL' AS dimension, NULL AS member FROM y UNION ALL SELECT *, 'context', context FROM y UNION ALL SELECT *, 'question_type', question_type FROM y),
 fl AS (SELECT method, dimension, member, string_agg(fc || ':' || n, ',' ORDER BY fc) AS failures FROM (SELECT method, dimension, member, fc, count(*) AS n FROM x WHERE fc IS NOT NULL GROUP BY ALL) GROUP BY ALL),
 g AS (SELECT method, dimension, member, count(*) AS qa_count, count(*) FILTER (judge_valid) AS valid_count, count(*) FILTER (NOT judge_valid) AS invalid_count, count(*) FILTER (correct) AS correct_count,
  round(CASE WHEN count(*) FILTER (judge_valid) > 0 THEN CAST(count(*) FILTER (correct) AS DOUBLE)/count(*) FILTER (judge_valid) END,6) AS qa_accuracy, round(CAST(sum(recall) AS DOUBLE)/count(recall),6) AS mean_recall, round(CAST(sum(mrr) AS DOUBLE)/count(mrr),6) AS mean_mrr FROM x GROUP BY ALL)
 SELECT g.*, coalesce(failures, '') AS failures, ci_low, ci_high FROM g LEFT JOIN fl ON fl.method = g.method AND fl.dimension = g.dimension AND fl.member IS NOT DISTINCT FROM g.member LEFT JOIN ci ON ci.method = g.method AND g.dimension = 'ALL'""",
)
def _(spark, sf):
    i = F.col("item")
    failure = F.when(i % 3 == 0, "judge_timeout").when(i % 3 == 1, "unparsable")
    rows = judged(spark, sf).withColumns({"failure": failure, "recall": F.when(i % 5 != 1, i % 11), "mrr": i % 7})
    counts = rows.select("method", "context", F.coalesce("correct", F.lit(False)).cast("long").alias("k"), F.col("judge_valid").cast("long").alias("v"))
    ci = st.cluster_bootstrap(counts, "context", ["k", "v"], st.ratio(F.col("k"), F.col("v")), samples=SAMPLES_CLUSTER, seed=SEED, by=["method"])
    out = ru.method_summary(rows, "method", ["context", "question_type"], "correct", "judge_valid", "failure", ["recall", "mrr"], ci)
    return rounded(out, 6, "qa_accuracy", "mean_recall", "mean_mrr", "ci_low", "ci_high")


@query(
    "paired_disagreements",
    f"""WITH {QA}, p AS (SELECT a.context, a.item, a.judge_valid AS lv, b.judge_valid AS rv, coalesce(a.correct,false) AS lc, coalesce(b.correct,false) AS rc FROM qa a JOIN qa b USING (context, item) WHERE a.method='A' AND b.method='B')
 SELECT context, count(*) AS qa_count, count(*) FILTER (lv AND rv AND lc AND rc) AS both_correct, count(*) FILTER (lv AND rv AND lc AND NOT rc) AS left_only_correct, count(*) FILTER (lv AND rv AND NOT lc AND rc) AS right_only_correct,
 count(*) FILTER (lv AND rv AND NOT lc AND NOT rc) AS both_wrong, count(*) FILTER (NOT lv) AS invalid_left, count(*) FILTER (NOT rv) AS invalid_right,
 round(CAST(count(*) FILTER (rc) AS DOUBLE)/count(*) FILTER (rv) - CAST(count(*) FILTER (lc) AS DOUBLE)/count(*) FILTER (lv),6) AS delta_accuracy FROM p GROUP BY 1""",
)
def _(spark, sf):
    return rounded(ru.paired_disagreements(judged(spark, sf), [], "item", "method", "A", "B", "correct", "judge_valid", ["context"]), 6, "delta_accuracy")


@query(
    "judge_outcomes",
    f"""WITH {QA} SELECT method, question_type, count(*) AS total_attempted, count(*) FILTER (judge_valid) AS valid_denominator, count(*) FILTER (correct) AS correct_count, count(*) FILTER (NOT correct) AS incorrect_count, count(*) FILTER (NOT judge_valid) AS invalid_count,
 round(CASE WHEN count(*) FILTER (judge_valid)>0 THEN CAST(count(*) FILTER (correct) AS DOUBLE)/count(*) FILTER (judge_valid) END,6) AS qa_accuracy, bool_and(judge_valid) AS headline_eligible FROM qa GROUP BY ALL""",
)
def _(spark, sf):
    return rounded(ru.judge_outcomes(judged(spark, sf), ["method", "question_type"], "correct", "judge_valid"), 6, "qa_accuracy")


@query(
    "macro_micro_accuracy",
    f"""WITH {QA} SELECT method, count(*) AS question_count, count(*) FILTER (judge_valid) AS valid_judge_count, count(*) FILTER (NOT judge_valid) AS invalid_judge_count, round(CAST(count(*) FILTER (correct) AS DOUBLE)/count(*) FILTER (judge_valid),6) AS qa_accuracy,
 round(CAST(sum(n_chars) AS DOUBLE)/count(*),4) AS coverage_macro FROM qa GROUP BY ROLLUP (method)""",
)
def _(spark, sf):
    out = ru.macro_micro_accuracy(judged(spark, sf), "method", "correct", "judge_valid", "n_chars")
    return rounded(rounded(out, 6, "qa_accuracy"), 4, "coverage_macro")


OPP = f"""{LINES}, {ROOTS}, inn AS (SELECT l.trace, l.phase, greatest(l.start_ns, r.start_ns) AS a, least(l.end_ns, r.end_ns) AS b FROM lines l JOIN roots r USING (trace)),
 lo AS (SELECT * FROM inn WHERE phase='R'), hi AS (SELECT * FROM inn WHERE phase IN ('R','N')), {islands_sql("li", "lo", "trace", "a", "b")}, {islands_sql("hi2", "hi", "trace", "a", "b")},
 ll AS (SELECT trace, sum(e-s) AS v FROM li GROUP BY 1), hh AS (SELECT trace, sum(e-s) AS v FROM hi2 GROUP BY 1),
 op AS (SELECT trace, end_ns-start_ns AS total_ns, CAST(coalesce(ll.v,0) AS BIGINT) AS lower_ns, CAST(coalesce(hh.v,0) AS BIGINT) AS upper_ns FROM roots LEFT JOIN ll USING (trace) LEFT JOIN hh USING (trace) WHERE end_ns > start_ns)"""


def opportunities(spark, sf):
    phase = F.col("phase")
    return ru.opportunity_bounds(root_spans(spark, sf), line_spans(spark, sf).select("trace", "phase", "start_ns", "end_ns"), ["trace"], "start_ns", "end_ns", phase == "R", phase == "N")


@query(
    "opportunity_bounds",
    f"""WITH {OPP}, q AS (SELECT *, CAST(lower_ns AS DOUBLE)/total_ns AS pl, CAST(upper_ns AS DOUBLE)/total_ns AS ph FROM op) SELECT trace, total_ns, lower_ns, upper_ns, round(pl,6) AS p_low, round(ph,6) AS p_high, """
    + ", ".join(f"round(1/((1-p{s[0]})+p{s[0]}/{w}),6) AS speedup_{s}_{w}" for w in (2, 4, 8) for s in ("low", "high"))
    + " FROM q",
)
def _(spark, sf):
    out = opportunities(spark, sf)
    return rounded(out, 6, "p_low", "p_high", *[c for c in out.columns if c.startswith("speedup_")])


def dependency_rules(spark):
    return spark.createDataFrame([("R", "D0"), ("A", "D2"), ("N", "unknown")], "phase string, dependency_class string")


@query(
    "dependency_class_time",
    f"""WITH {LINES}, {ROOTS}, inn AS (SELECT l.trace, CASE phase WHEN 'R' THEN 'D0' WHEN 'A' THEN 'D2' ELSE 'unknown' END AS c, greatest(l.start_ns, r.start_ns) AS a, least(l.end_ns, r.end_ns) AS b FROM lines l JOIN roots r USING (trace) WHERE r.end_ns > r.start_ns),
 {islands_sql("ci", "inn", "trace, c", "a", "b")}, {islands_sql("ai", "inn", "trace", "a", "b")}, cov AS (SELECT trace, sum(e-s) AS v FROM ai GROUP BY 1),
 al AS (SELECT trace, c, e-s AS t FROM ci UNION ALL SELECT trace, 'unknown', end_ns-start_ns-coalesce(v,0) FROM roots LEFT JOIN cov USING (trace) WHERE end_ns > start_ns)
 SELECT trace, c AS dependency_class, CAST(sum(t) AS BIGINT) AS time_ns FROM al GROUP BY ALL""",
)
def _(spark, sf):
    spans = line_spans(spark, sf).select("trace", "phase", "start_ns", "end_ns")
    return ru.dependency_class_time(root_spans(spark, sf), spans, dependency_rules(spark), ["trace"], "phase", "start_ns", "end_ns")


@query(
    "episode_opportunity_rollup",
    f"""WITH {OPP}, t AS (SELECT count(*) AS episodes, sum(total_ns) AS t, sum(lower_ns) AS l, sum(upper_ns) AS u FROM op)
 SELECT episodes, round(CAST(t AS DOUBLE)/86400e9,3) AS total_days, round(CAST(l AS DOUBLE)/t,6) AS p_low, round(CAST(u AS DOUBLE)/t,6) AS p_high, round(1/((1-CAST(l AS DOUBLE)/t)+(CAST(l AS DOUBLE)/t)/4),6) AS speedup_low_4 FROM t""",
)
def _(spark, sf):
    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    t = opportunities(spark, sf).agg(F.count(F.lit(1)).alias("episodes"), wide("total_ns").alias("t"), wide("lower_ns").alias("l"), wide("upper_ns").alias("u"))
    low, high = ru.ratio(F.col("l"), F.col("t")), ru.ratio(F.col("u"), F.col("t"))
    return t.select("episodes", round_double(F.col("t").cast("double") / 86400e9, 3).alias("total_days"), round_double(low, 6).alias("p_low"), round_double(high, 6).alias("p_high"), round_double(ru.amdahl(low, 4), 6).alias("speedup_low_4"))


OBS = f"""{EV}, ob AS (SELECT stream, event_id, cents, event_id % 3 <> 0 AS chance, CASE cents % 4 WHEN 0 THEN 'HIGH_CONFLICT' WHEN 1 THEN 'UNKNOWN' ELSE 'LOW_CONFLICT' END AS conflict, CASE WHEN kind IN ('click','view') THEN 'LLM' ELSE 'RULE' END AS mode,
 cents % 5 <> 0 AS resource_ok, cents % 7 <> 0 AS value_ok, CASE cents % 6 WHEN 0 THEN 'MISS' WHEN 1 THEN NULL ELSE 'HIT' END AS outcome, CASE WHEN event_id % 50 <> 1 THEN 'proof' END AS proof, CASE WHEN event_id % 70 <> 2 THEN 'proof' END AS meant, CASE WHEN event_id % 90 <> 4 THEN 'proof' END AS afforded, CASE WHEN event_id % 110 <> 5 THEN 'proof' END AS valued FROM ev)"""


def observations(spark, sf):
    c, e = F.col("cents"), F.col("event_id")
    return lifecycle(spark, sf).select(
        "stream",
        "event_id",
        "cents",
        (e % 3 != 0).alias("chance"),
        F.when(c % 4 == 0, "HIGH_CONFLICT").when(c % 4 == 1, "UNKNOWN").otherwise("LOW_CONFLICT").alias("conflict"),
        F.when(F.col("kind").isin("click", "view"), "LLM").otherwise("RULE").alias("mode"),
        (c % 5 != 0).alias("resource_ok"),
        (c % 7 != 0).alias("value_ok"),
        F.when(c % 6 == 0, "MISS").when(c % 6 == 1, F.lit(None).cast("string")).otherwise("HIT").alias("outcome"),
        F.when(e % 50 != 1, "proof").alias("proof"),
        F.when(e % 70 != 2, "proof").alias("meant"),
        F.when(e % 90 != 4, "proof").alias("afforded"),
        F.when(e % 110 != 5, "proof").alias("valued"),
    )


FUNNEL_SQL = """SELECT stream, count(*) FILTER (chance) AS opportunities, count(*) FILTER (chance AND conflict='LOW_CONFLICT') AS low_conflict, count(*) FILTER (chance AND conflict='HIGH_CONFLICT') AS high_conflict, count(*) FILTER (chance AND conflict='UNKNOWN') AS unknown_conflict,
 count(*) FILTER (chance AND mode='LLM') AS model_required, count(*) FILTER (chance AND conflict='LOW_CONFLICT' AND mode='LLM') AS after_model_filter, count(*) FILTER (chance AND conflict='LOW_CONFLICT' AND mode='LLM' AND resource_ok) AS after_resource,
 count(*) FILTER (chance AND conflict='LOW_CONFLICT' AND mode='LLM' AND resource_ok AND value_ok) AS would_launch,
 round(CASE WHEN count(*) FILTER (chance AND conflict='LOW_CONFLICT' AND outcome IS NOT NULL)>0 THEN CAST(count(*) FILTER (chance AND conflict='LOW_CONFLICT' AND outcome='HIT') AS DOUBLE)/count(*) FILTER (chance AND conflict='LOW_CONFLICT' AND outcome IS NOT NULL) END,6) AS low_hit_rate,
 round(CASE WHEN count(*) FILTER (chance AND conflict='HIGH_CONFLICT' AND outcome IS NOT NULL)>0 THEN CAST(count(*) FILTER (chance AND conflict='HIGH_CONFLICT' AND outcome='HIT') AS DOUBLE)/count(*) FILTER (chance AND conflict='HIGH_CONFLICT' AND outcome IS NOT NULL) END,6) AS high_hit_rate,
 bool_and(CASE WHEN chance THEN proof IS NOT NULL END) AS conflict_complete, bool_and(CASE WHEN chance THEN meant IS NOT NULL END) AS semantic_complete, bool_and(CASE WHEN chance AND conflict='LOW_CONFLICT' AND mode='LLM' THEN afforded IS NOT NULL END) AS resource_complete, bool_and(CASE WHEN chance AND conflict='LOW_CONFLICT' AND mode='LLM' AND resource_ok THEN valued IS NOT NULL END) AS value_complete, bool_and(CASE WHEN chance AND conflict<>'UNKNOWN' THEN outcome IS NOT NULL AND proof IS NOT NULL END) AS selectivity_complete FROM ob GROUP BY 1"""


def funnel(spark, sf):
    return ru.opportunity_funnel(observations(spark, sf), ["stream"], "chance", "conflict", "mode", "resource_ok", "value_ok", "outcome", {"conflict": "proof", "semantic": "meant", "resource": "afforded", "value": "valued", "outcome": "proof"})


@query("opportunity_funnel", f"WITH {OBS} {FUNNEL_SQL}")
def _(spark, sf):
    return rounded(funnel(spark, sf), 6, "low_hit_rate", "high_hit_rate")


@query(
    "validated_reuse_summary",
    f"""WITH {EV}, k AS (SELECT *, CASE WHEN stream % 4 = 0 THEN kind || '-slow' ELSE kind || '-' || stream % 4 END AS lane FROM ev),
 v AS (SELECT lane AS kind, cents, event_id, CASE WHEN stream % 4 = 1 AND kind <> 'error' OR cents % 5 > 2 THEN 'STABLE' WHEN cents % 5 = 0 THEN NULL WHEN cents % 5 = 1 THEN 'UNSTABLE' ELSE 'OPAQUE' END AS sh, CASE cents % 7 WHEN 0 THEN NULL WHEN 1 THEN 'UNSTABLE' WHEN 2 THEN 'OPAQUE' ELSE 'STABLE' END AS ex,
  CASE WHEN kind = 'click' THEN 0 ELSE cents % 3 END = event_id % 3 AS eq, event_id % 5 <> 2 AS rd, stream % 4 <> 0 AND cents % 2 = 0 AS ea, CASE WHEN kind = 'signup' AND event_id % 50 = 7 THEN 1 ELSE 0 END AS wr, CASE WHEN stream % 4 = 2 THEN 9000 ELSE 12 END + 8 AS co, NOT (kind = 'error' AND event_id % 90 = 3) AS ga FROM k),
 w AS (SELECT *, sh='STABLE' AND ex='STABLE' AND eq AS hit, sh='STABLE' AND ex='STABLE' AND NOT eq AS miss FROM v),
 r AS (SELECT kind, count(sh) AS attempts, count(*) FILTER (sh='STABLE') AS stable, count(*) FILTER (sh='UNSTABLE' OR (sh='STABLE' AND ex='UNSTABLE')) AS unstable, count(*) FILTER (sh='OPAQUE' OR (sh='STABLE' AND ex IS NULL) OR (sh='STABLE' AND ex='OPAQUE')) AS opaque,
 count(*) FILTER (hit) AS hits, count(*) FILTER (miss) AS misses, count(*) FILTER (rd) AS locally_ready, count(*) FILTER (rd AND ea) AS ready_early, count(*) FILTER (wr > 0 OR NOT ga) AS bad, CAST(sum(CASE WHEN hit THEN cents ELSE 0 END) AS BIGINT) AS hideable_ns, CAST(sum(co) AS BIGINT) AS cost_ns FROM w GROUP BY ROLLUP (kind)),
 q AS (SELECT *, CASE WHEN hits + misses > 0 THEN CAST(hits AS DOUBLE)/(hits+misses) END AS hr, hideable_ns - cost_ns AS net_ns FROM r),
 z AS (SELECT *, CASE WHEN bad > 0 THEN 1 WHEN CAST(ready_early AS DOUBLE)/greatest(locally_ready, 1) < 0.05 THEN 2 WHEN attempts = 0 OR CAST(stable AS DOUBLE)/attempts < 0.5 THEN 3 WHEN hr IS NULL OR hr < 0.1 THEN 4 WHEN net_ns < 1 THEN 5 ELSE 6 END AS rule FROM q)
 SELECT kind, attempts, stable, unstable, opaque, hits, misses, locally_ready, ready_early, hideable_ns, cost_ns, round(hr, 6) AS hit_rate, net_ns,
 ['STOP_INSTRUMENTATION_FAILURE', 'STOP_MEG_NO_FINER_GRAINED_WINDOW', 'STOP_READVIEW_UNSTABLE', 'STOP_VALIDATED_CONTINUATION_LOW_STABILITY', 'STOP_VALIDATED_CONTINUATION_LOW_STABILITY', 'GO_VALIDATED_SEMANTIC_CONTINUATION'][rule] AS status,
 ['OFFLINE_OR_CAPTURE_CORRECTNESS_GATE_FAILED', 'LOCAL_READINESS_NOT_MATERIALLY_EARLIER', 'STABLE_READVIEW_FRACTION_BELOW_THRESHOLD', 'VALIDATION_HIT_FRACTION_BELOW_THRESHOLD', 'NON_POSITIVE_SHADOW_UPPER_BOUND_VALUE', 'ALL_VALIDATED_CONTINUATION_GATES_PASSED'][rule] AS reason FROM z""",
)
def _(spark, sf):
    c, e, k = F.col("cents"), F.col("event_id"), F.col("kind")
    lane = F.col("stream") % 4
    other = F.when(c % 5 == 0, F.lit(None).cast("string")).when(c % 5 == 1, "UNSTABLE").otherwise("OPAQUE")
    exact = F.when(c % 7 == 0, F.lit(None).cast("string")).when(c % 7 == 1, "UNSTABLE").when(c % 7 == 2, "OPAQUE").otherwise("STABLE")
    rows = lifecycle(spark, sf).select(
        F.concat(k, F.when(lane == 0, "-slow").otherwise(F.concat(F.lit("-"), lane))).alias("kind"),
        "cents",
        F.when(((lane == 1) & (k != "error")) | (c % 5 > 2), "STABLE").otherwise(other).alias("sh"),
        exact.alias("ex"),
        F.when(k == "click", 0).otherwise(c % 3).alias("ds"),
        (e % 3).alias("dx"),
        F.when(lane == 2, 9000).otherwise(12).cast("long").alias("capture"),
        F.lit(8).cast("long").alias("check"),
        (e % 5 != 2).alias("ready"),
        ((lane != 0) & (c % 2 == 0)).alias("early"),
        F.when((k == "signup") & (e % 50 == 7), 1).otherwise(0).alias("writes"),
        (~((k == "error") & (e % 90 == 3))).alias("gate"),
    )
    out = ru.validated_reuse_summary(rows, "kind", "sh", "ex", "ds", "dx", "cents", "capture", "check", ready="ready", early="early", side_effects=["writes"], gates=F.col("gate"))
    return rounded(out, 6, "hit_rate")


@query(
    "hideable_service",
    f"""WITH {EV}, p AS (SELECT *, lag(publish_ns) OVER (PARTITION BY stream ORDER BY seq) AS pub FROM ev),
 r AS (SELECT stream, CASE cents % 3 WHEN 0 THEN 'DISJOINT' WHEN 1 THEN 'CONFLICT' ELSE 'UNKNOWN' END AS dep, start_ns AS prep, CASE WHEN cents % 4 <> 0 THEN start_ns + 1000000000 END AS probe, pub, cents % 5 <> 0 AS same, publish_ns-start_ns AS svc FROM p WHERE pub IS NOT NULL),
 f AS (SELECT *, prep < pub AS early, coalesce(prep < pub AND probe < pub, false) AS pe FROM r),
 g AS (SELECT *, CASE WHEN pe AND (dep='DISJOINT' OR (dep='UNKNOWN' AND same)) THEN least(svc, pub-probe) ELSE 0 END AS gain FROM f),
 c AS (SELECT stream, count(*) AS pairs, count(*) FILTER (early) AS prepared_early, count(*) FILTER (pe) AS probe_early, count(*) FILTER (dep='DISJOINT') AS disjoint, count(*) FILTER (dep='UNKNOWN') AS unknown,
 count(*) FILTER (pe AND dep='UNKNOWN' AND same) AS validation_hits, count(*) FILTER (pe AND dep='UNKNOWN' AND NOT same) AS validation_misses, count(*) FILTER (gain>0) AS hideable_count, CAST(sum(greatest(gain,0)) AS BIGINT) AS hideable_ns FROM g GROUP BY 1)
 SELECT *, CASE WHEN probe_early=0 THEN 'STOP_NO_LEGAL_WINDOW' WHEN disjoint+validation_hits=0 THEN 'STOP_DEPENDENCY_BOUNDARY' WHEN hideable_ns<=0 THEN 'STOP_NO_HIDEABLE_SERVICE' ELSE 'GO' END AS decision FROM c""",
)
def _(spark, sf):
    c = F.col("cents")
    rows = ordered_scan(lifecycle(spark, sf), ["stream"], ["arrival_ns", "event_id"], lag={"pub": "publish_ns"}).filter(F.col("pub").isNotNull())
    rows = rows.select(
        "stream",
        F.when(c % 3 == 0, "DISJOINT").when(c % 3 == 1, "CONFLICT").otherwise("UNKNOWN").alias("dep"),
        F.col("start_ns").alias("prep"),
        F.when(c % 4 != 0, F.col("start_ns") + 1_000_000_000).alias("probe"),
        "pub",
        (c % 5 != 0).alias("same"),
        (F.col("publish_ns") - F.col("start_ns")).alias("svc"),
    )
    return ru.hideable_service(rows, ["stream"], "dep", "prep", "probe", "pub", "same", "svc")


@query(
    "speculation_value",
    f"""WITH {EV}, r AS (SELECT kind, event_id % 7 AS lane, cents % 3 <> 0 AS reuse, CASE WHEN event_id % 70 <> 24 THEN event_id % 500 <> 7 END AS parity, cents AS ex, cents // 3 AS sp, CASE WHEN event_id % 70 = 13 THEN -1 WHEN event_id % 140 <> 38 THEN cents % 11 END AS ov FROM ev),
 a AS (SELECT kind, lane, count(*) AS eligible_count, count(*) FILTER (reuse) AS reuse_count, CAST(sum(ex) AS BIGINT) AS exact_ns, CAST(sum(sp) AS BIGINT) AS speculative_ns, CAST(sum(ov) AS BIGINT) AS ovs, CAST(sum(CASE WHEN reuse THEN ex ELSE 0 END) AS BIGINT) AS avoided_ns,
  count(*) FILTER (parity IS NULL) AS np, count(*) FILTER (ov IS NULL OR ov < 0) AS no, count(*) FILTER (parity IS FALSE) AS bad FROM r GROUP BY ALL),
 m AS (SELECT *, concat_ws(',', CASE WHEN np > 0 THEN 'state_parity' END, CASE WHEN no > 0 THEN 'validation_overhead_ns' END) AS missing_fields FROM a)
 SELECT kind, lane, eligible_count, reuse_count, exact_ns, speculative_ns, CASE WHEN missing_fields = '' THEN ovs END AS validation_ns, avoided_ns, missing_fields, CASE WHEN missing_fields = '' THEN round(CAST(avoided_ns AS DOUBLE)/exact_ns,6) END AS reuse_rate,
 CASE WHEN missing_fields = '' AND bad = 0 THEN avoided_ns-speculative_ns-ovs END AS net_saved_ns, CASE WHEN missing_fields <> '' THEN 'NOT_MEASURED' WHEN bad > 0 THEN 'FAIL' ELSE 'PASS' END AS correctness_gate,
 CASE WHEN missing_fields <> '' THEN 'DATA_INSUFFICIENT' WHEN bad > 0 THEN 'UNSAFE' WHEN avoided_ns-speculative_ns-ovs > 0 THEN 'POTENTIAL_SUPPORTED' ELSE 'LOW_POTENTIAL' END AS decision FROM m""",
)
def _(spark, sf):
    c, e = F.col("cents"), F.col("event_id")
    overhead = F.when(e % 70 == 13, -1).when(e % 140 != 38, c % 11)
    rows = lifecycle(spark, sf).select("kind", (e % 7).alias("lane"), (c % 3 != 0).alias("reuse"), F.when(e % 70 != 24, e % 500 != 7).alias("parity"), c.alias("ex"), F.floor(c / 3).alias("sp"), overhead.alias("ov"))
    return rounded(ru.speculation_value(rows, ["kind", "lane"], "reuse", "parity", "ex", "sp", "ov", 1), 6, "reuse_rate")


@query(
    "event_counts",
    "SELECT user_id, count(*) AS event_count, count(DISTINCT event_type) AS event_types, count(*) FILTER (event_type='click') AS hits, count(*) FILTER (event_type='error') AS misses, round(CASE WHEN count(*) FILTER (event_type IN ('click','error'))>0 THEN CAST(count(*) FILTER (event_type='click') AS DOUBLE)/count(*) FILTER (event_type IN ('click','error')) END,6) AS hit_rate FROM events GROUP BY 1",
)
def _(spark, sf):
    return rounded(ru.event_counts(table(spark, sf, "events"), ["user_id"], "event_type", "click", "error"), 6, "hit_rate")


@query(
    "direct_evidence_counts",
    f"""WITH {EV}, i AS (SELECT cents AS evidence, min(CASE cents % 3 WHEN 0 THEN 'lost' WHEN 1 THEN 'stale' ELSE 'order' END) AS observation, count(DISTINCT kind) > 1 AS bad FROM ev GROUP BY 1)
 SELECT observation, count(*) FILTER (NOT bad) AS evidence_count, count(*) FILTER (bad) AS conflicting_ids FROM i GROUP BY 1""",
)
def _(spark, sf):
    c = F.col("cents")
    rows = lifecycle(spark, sf).select(c.alias("evidence"), F.when(c % 3 == 0, "lost").when(c % 3 == 1, "stale").otherwise("order").alias("observation"), "kind")
    return ru.direct_evidence_counts(rows, "evidence", "observation", ["observation", "kind"])


@query(
    "failed_run_rates",
    f"""WITH {RUNS} SELECT method, count(*) AS planned, count(*) FILTER (status='F' AND run_id % 4 <> 0) AS failed_count, round(CAST(count(*) FILTER (status='F' AND run_id % 4 <> 0) AS DOUBLE)/count(*),6) AS failed_rate FROM runs GROUP BY 1""",
)
def _(spark, sf):
    plan = runs(spark, sf)
    statuses = plan.filter(F.col("run_id") % 4 != 0).select("run_id", F.when(F.col("status") == "F", "failed").otherwise("done").alias("state"))
    return rounded(ru.failed_run_rates(plan, statuses, "run_id", "method", "state"), 6, "failed_rate")


@query(
    "workload_complexity",
    """SELECT conv_id, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS characters, CAST(sum(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> ''))) AS BIGINT) AS tokens FROM conversations GROUP BY ROLLUP (conv_id)""",
)
def _(spark, sf):
    return ru.workload_complexity(turns(spark, sf), "conv_id", "text")


TELE = f"""{EV}, tm AS (SELECT kind, arrival_ns AS ts, event_id, CAST(sum(cents) OVER (PARTITION BY kind ORDER BY arrival_ns, event_id) AS BIGINT) AS total, CAST(sum(cents % 100) OVER (PARTITION BY kind ORDER BY arrival_ns, event_id) AS BIGINT) AS hits, cents % 8 AS depth, cents AS raw FROM ev)"""


@query(
    "telemetry_reduce",
    f"""WITH {TELE}, l AS (SELECT *, lag(total) OVER w AS pt, lag(raw) OVER w AS pr, lag(hits) OVER w AS ph, coalesce(lead(ts) OVER w - ts, 0) AS d FROM tm WINDOW w AS (PARTITION BY kind ORDER BY ts, event_id))
 SELECT kind, count(*) AS sample_count, round((max(ts)-min(ts))/1e9,6) AS duration_s, arg_max(total, ts)-arg_min(total, ts) AS total_delta, count(*) FILTER (total<pt) AS total_resets, CASE WHEN count(*) FILTER (raw<pr) = 0 THEN arg_max(raw, ts)-arg_min(raw, ts) END AS raw_delta, count(*) FILTER (raw<pr) AS raw_resets,
 arg_max(hits, ts)-arg_min(hits, ts) AS hits_delta, count(*) FILTER (hits<ph) AS hits_resets, 'OK' AS total_status, CASE WHEN count(*) FILTER (raw<pr) > 0 THEN 'RESET' ELSE 'OK' END AS raw_status, 'OK' AS hits_status,
 round(CAST(sum(depth * d) AS DOUBLE)/sum(d),6) AS depth_mean, round(CAST(sum(d) FILTER (depth > 0) AS DOUBLE)/sum(d),6) AS depth_above_zero, list_sort(list(depth))[CAST(ceil(0.95 * count(*)) AS BIGINT)] AS depth_p95, max(depth) AS depth_max, 'OK' AS depth_status,
 CAST(NULL AS DOUBLE) AS odd_mean, CAST(NULL AS DOUBLE) AS odd_above_zero, CAST(NULL AS BIGINT) AS odd_p95, CAST(NULL AS BIGINT) AS odd_max, 'INCOMPLETE' AS odd_status,
 round((arg_max(total, ts)-arg_min(total, ts))/((max(ts)-min(ts))/1e9),6) AS total_per_s, round(CASE WHEN count(*) FILTER (raw<pr) = 0 THEN (arg_max(raw, ts)-arg_min(raw, ts))/((max(ts)-min(ts))/1e9) END,6) AS raw_per_s, round((arg_max(hits, ts)-arg_min(hits, ts))/((max(ts)-min(ts))/1e9),6) AS hits_per_s,
 round(CAST(arg_max(hits, ts)-arg_min(hits, ts) AS DOUBLE)/(arg_max(total, ts)-arg_min(total, ts)),6) AS hit_rate FROM l GROUP BY 1""",
)
def _(spark, sf):
    rows = ordered_scan(lifecycle(spark, sf), ["kind"], ["arrival_ns", "event_id"], running={"total": Running("sum", F.col("cents")), "hits": Running("sum", F.col("cents") % 100)})
    # one gauge that every scrape has and one that some lack
    rows = rows.select("kind", F.col("arrival_ns").alias("ts"), "event_id", "total", "hits", F.col("cents").alias("raw"), (F.col("cents") % 8).alias("depth"), F.when(F.col("event_id") % 2 == 1, F.col("cents")).alias("odd"))
    out = ru.telemetry_reduce(rows, ["kind"], "ts", ["total", "raw", "hits"], gauges=["depth", "odd"], hit_rate=("hits", "total"), tie=["event_id"])
    return rounded(out, 6, "duration_s", "total_per_s", "raw_per_s", "hits_per_s", "depth_mean", "depth_above_zero", "odd_mean", "odd_above_zero", "hit_rate")


HOUR_NS = 3_600_000_000_000


@query(
    "sampler_coverage",
    f"""WITH {EV}, s AS (SELECT stream, arrival_ns AS ts, bool_or(cents % 4 <> 0) AS gpu FROM ev GROUP BY ALL), g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY stream ORDER BY ts) AS gap FROM s)
 SELECT stream, count(*) AS actual_samples, (max(ts)-min(ts))//{HOUR_NS}+1 AS expected_samples, round(CAST(count(*) FILTER (gpu) AS DOUBLE)/count(*),6) AS gpu_coverage, round(least(1.0, CAST(count(*) AS DOUBLE)/((max(ts)-min(ts))//{HOUR_NS}+1)),6) AS coverage,
 quantile_disc(gap,0.5) AS gap_p50_ns, quantile_disc(gap,0.95) AS gap_p95_ns, max(gap) AS gap_max_ns FROM g GROUP BY 1""",
)
def _(spark, sf):
    rows = lifecycle(spark, sf).withColumnRenamed("arrival_ns", "ts")
    return rounded(ru.sampler_coverage(rows, ["stream"], "ts", HOUR_NS, {"gpu": F.col("cents") % 4 != 0}), 6, "gpu_coverage", "coverage")


@query(
    "retrieval_parity_summary",
    f"""WITH {QA} SELECT method, context, count(*) AS comparisons, count(DISTINCT question_type) AS instances, round(avg(item % 11 / 10.0::DOUBLE),6) AS mean_overlap, round(min(item % 11 / 10.0::DOUBLE),6) AS min_overlap, round(avg(item % 7 / 6.0::DOUBLE),6) AS mean_rbo, round(min(item % 7 / 6.0::DOUBLE),6) AS min_rbo FROM qa GROUP BY ALL""",
)
def _(spark, sf):
    rows = judged(spark, sf).withColumns({"overlap": F.col("item") % 11 / F.lit(10.0), "rbo": F.col("item") % 7 / F.lit(6.0)})
    return rounded(ru.retrieval_parity_summary(rows, ["method", "context"], "question_type", ["overlap", "rbo"]), 6, "mean_overlap", "min_overlap", "mean_rbo", "min_rbo")


@query(
    "vector_bag_compare",
    f"""WITH {LINES}, b AS (SELECT phase, concat_ws('|', quantity, price) AS h, count(*) FILTER (status='O') AS ca, count(*) FILTER (status='F') AS cb FROM lines GROUP BY ALL)
 SELECT phase, CAST(sum(ca) AS BIGINT) AS total_a, CAST(sum(cb) AS BIGINT) AS total_b, count(*) FILTER (ca>0) AS distinct_a, count(*) FILTER (cb>0) AS distinct_b, count(*) FILTER (ca>0 AND cb>0) AS shared, count(*) FILTER (ca>0 AND cb=0) AS only_a, count(*) FILTER (ca=0 AND cb>0) AS only_b, bool_and(ca=cb) AS bag_equal FROM b GROUP BY 1""",
)
def _(spark, sf):
    rows = line_spans(spark, sf).withColumn("h", row_hash(F.col("quantity"), F.col("price")))
    return ru.vector_bag_compare(rows.filter("status = 'O'"), rows.filter("status = 'F'"), ["phase"], "h")


@query(
    "candidate_partition_diagnosis",
    f"""WITH {LINES}, k AS (SELECT * FROM lines WHERE phase = 'R'), i AS (SELECT trace, quantity // 10 AS q, price//20000 AS p, count(*) AS m FROM k GROUP BY ALL), f AS (SELECT trace, quantity // 10 AS q, count(*) AS m FROM k GROUP BY ALL),
 ih AS (SELECT trace, m, count(*) AS n FROM i GROUP BY ALL), fh AS (SELECT trace, m, count(*) AS n FROM f GROUP BY ALL),
 a AS (SELECT trace, CAST(sum(m * n) AS BIGINT) AS candidates, CAST(sum(n) AS BIGINT) AS identities, CAST(coalesce(sum(n) FILTER (m > 1), 0) AS BIGINT) AS ambiguous_groups, max(m) AS max_multiplicity, string_agg(m || 'x' || n, ' ' ORDER BY m) AS identity_multiplicity FROM ih GROUP BY 1),
 b AS (SELECT trace, CAST(sum(n) AS BIGINT) AS facts, CAST(coalesce(sum(n) FILTER (m > 1), 0) AS BIGINT) AS duplicate_fact_groups, string_agg(m || 'x' || n, ' ' ORDER BY m) AS fact_multiplicity FROM fh GROUP BY 1)
 SELECT o_orderkey AS trace, coalesce(candidates, 0) AS candidates, coalesce(identities, 0) AS identities, coalesce(ambiguous_groups, 0) AS ambiguous_groups, coalesce(max_multiplicity, 0) AS max_multiplicity, coalesce(identity_multiplicity, '') AS identity_multiplicity,
 coalesce(facts, 0) AS facts, coalesce(duplicate_fact_groups, 0) AS duplicate_fact_groups, coalesce(fact_multiplicity, '') AS fact_multiplicity, CASE WHEN candidates IS NULL THEN 'EMPTY' WHEN ambiguous_groups > 0 THEN 'AMBIGUOUS' ELSE 'UNIQUE' END AS classification
 FROM orders LEFT JOIN a ON a.trace = o_orderkey LEFT JOIN b ON b.trace = o_orderkey""",
)
def _(spark, sf):
    # every order is a partition; the returned lines are its candidates
    tens = F.call_function("div", F.col("quantity"), F.lit(10))
    rows = line_spans(spark, sf).filter("phase = 'R'").withColumns({"identity": row_hash(tens, F.call_function("div", F.col("price"), F.lit(20000))), "fact": row_hash(tens)})
    return ru.candidate_partition_diagnosis(table(spark, sf, "orders").select(F.col("o_orderkey").alias("trace")), rows, ["trace"], "identity", "fact")


BLOCKS = f"""{EV}, bk AS (SELECT kind, stream, max(publish_ns)-min(arrival_ns) AS makespan, count(*) FILTER (cents%10=0) AS violations, max(cents%8) AS backlog, avg(CASE WHEN cents%3=0 THEN 1.0 ELSE 0.0 END) AS accuracy FROM ev GROUP BY ALL)"""


def blocks(spark, sf):
    c = F.col("cents")
    return lifecycle(spark, sf).groupBy("kind", "stream").agg(
        (F.max("publish_ns") - F.min("arrival_ns")).alias("makespan"), F.count_if(c % 10 == 0).alias("violations"), F.max(c % 8).alias("backlog"), F.avg((c % 3 == 0).cast("double")).alias("accuracy")
    )


def narrowed(df):
    """The pooled sums as BIGINT, the type of the SQL; NULL where the exact sum does not fit it."""
    return df.withColumns({c: F.col(c).try_cast("long") for c in ("sum_makespan", "sum_violations")})


POOLED = """SELECT kind, count(*) AS blocks, round(avg(accuracy),6) AS mean_accuracy, CAST(sum(makespan) AS BIGINT) AS sum_makespan, CAST(sum(violations) AS BIGINT) AS sum_violations, max(backlog) AS max_backlog FROM bk GROUP BY 1"""


@query(
    "aligned_blocks_table",
    f"""WITH {BLOCKS}, b AS ({POOLED}), s AS (SELECT kind, quantile_disc(cents,0.5) AS p50, quantile_disc(cents,0.95) AS p95, quantile_disc(cents,0.99) AS p99, count(*) AS episodes FROM ev GROUP BY 1)
 SELECT *, round(episodes*1000000000.0::DOUBLE/sum_makespan,9) AS goodput_per_s FROM b JOIN s USING (kind)""",
)
def _(spark, sf):
    out = ru.pooled_method_table(blocks(spark, sf), lifecycle(spark, sf), "kind", ["accuracy"], ["makespan", "violations"], ["backlog"], "cents", "makespan")
    return rounded(rounded(narrowed(out), 6, "mean_accuracy"), 9, "goodput_per_s")


@query(
    "graph_work_delta",
    f"""WITH {EV}, b AS (SELECT stream, seq, lag(cents) OVER w AS before, cents AS after, lag(publish_ns) OVER w AS pb, publish_ns AS pa FROM ev WINDOW w AS (PARTITION BY stream ORDER BY seq)) SELECT stream, seq, after-before AS node_delta, pa-pb AS publish_delta FROM b""",
)
def _(spark, sf):
    rows = ordered_scan(sequenced(spark, sf), ["stream"], ["seq"], lag={"nodes_before": "cents", "pub_before": "publish_ns"})
    return ru.counter_deltas(rows, {"node_delta": ("nodes_before", "cents"), "publish_delta": ("pub_before", "publish_ns")}).select("stream", "seq", "node_delta", "publish_delta")


@query(
    "request_service_summary",
    f"""WITH {REQ} SELECT stream, count(*) AS submitted, count(*) FILTER (request_kind='click') AS n_click, count(*) FILTER (request_kind='view') AS n_view, CAST(sum(cents) AS BIGINT) AS token_total,
 round(quantile_cont(terminal_ns-start_ns,0.5)/1e6,3) AS p50_ms, round(quantile_cont(terminal_ns-start_ns,0.95)/1e6,3) AS p95_ms, count(terminal_ns) AS complete FROM req GROUP BY 1""",
)
def _(spark, sf):
    out = ru.request_service_summary(requests(spark, sf), ["stream"], ["click", "view"], "request_kind", "cents", "start_ns", "terminal_ns")
    return out.withColumns({c[:-3] + "_ms": round_double(F.col(c) / 1e6, 3) for c in ("p50_ns", "p95_ns")}).drop("p50_ns", "p95_ns")


@query(
    "method_report",
    f"""WITH {BLOCKS}, b AS ({POOLED.replace("CAST(sum(violations)", "string_agg(DISTINCT CASE WHEN violations>0 THEN 'VIOLATED' ELSE 'CLEAN' END, ',' ORDER BY CASE WHEN violations>0 THEN 'VIOLATED' ELSE 'CLEAN' END) AS statuses, CAST(sum(violations)")}),
 s AS (SELECT kind, quantile_disc(publish_ns-arrival_ns,0.95) AS p95_freshness, quantile_disc(publish_ns-arrival_ns,0.99) AS p99_freshness FROM ev GROUP BY 1) SELECT kind, blocks, mean_accuracy, sum_makespan, sum_violations, max_backlog, statuses, p95_freshness, p99_freshness FROM b JOIN s USING (kind)""",
)
def _(spark, sf):
    b = blocks(spark, sf).withColumn("status", F.when(F.col("violations") > 0, "VIOLATED").otherwise("CLEAN"))
    fresh = lifecycle(spark, sf).select("kind", (F.col("publish_ns") - F.col("arrival_ns")).alias("f"))
    out = ru.pooled_method_table(b, fresh, "kind", ["accuracy"], ["makespan", "violations"], ["backlog"], "f", "makespan")
    seen = b.groupBy("kind").agg(F.array_join(F.sort_array(F.collect_set("status")), ",").alias("statuses"))
    return rounded(narrowed(out).join(seen, "kind"), 6, "mean_accuracy").select(
        "kind", "blocks", "mean_accuracy", "sum_makespan", "sum_violations", "max_backlog", "statuses", F.col("p95").alias("p95_freshness"), F.col("p99").alias("p99_freshness")
    )


@query(
    "qa_result_diagnostics",
    """WITH x AS (SELECT d.lang, quality=1 AS c, doc_id%6<>0 AS r, doc_id%7<>0 AS j, contains(d.text,'the') AND contains(d.text,'and') AS q, least(doc_id%9+1, doc_id%5+2) AS g, CASE WHEN doc_id%2=0 THEN 'A' ELSE 'B' END AS method FROM labels JOIN documents d USING (doc_id)),
 y AS (SELECT *, lang AS h FROM x UNION ALL SELECT *, NULL FROM x)
 SELECT method, h AS lang, count(*) AS question_count, count(*) FILTER (c AND r AND j) AS correct_count, count(*) FILTER (NOT r) AS reader_invalid, count(*) FILTER (r AND NOT j) AS judge_invalid, round(CAST(count(*) FILTER (c AND r AND j) AS DOUBLE)/count(*),6) AS primary_accuracy,
 round(CASE WHEN count(*) FILTER (r AND j)>0 THEN CAST(count(*) FILTER (c AND r AND j) AS DOUBLE)/count(*) FILTER (r AND j) END,6) AS valid_only_accuracy, count(*) FILTER (q) AS quotes_in_context, min(g) AS best_gold_rank FROM y GROUP BY ALL""",
)
def _(spark, sf):
    d = F.col("doc_id")
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    rows = table(spark, sf, "labels").join(docs, "doc_id").select(
        F.when(d % 2 == 0, "A").otherwise("B").alias("method"),
        "lang",
        (F.col("quality") == 1).alias("correct"),
        (d % 6 != 0).alias("reader_valid"),
        (d % 7 != 0).alias("judge_valid"),
        F.array(F.lit("the"), F.lit("and")).alias("quotes"),
        F.col("text").alias("context"),
        F.array(d % 9 + 1, d % 5 + 2).alias("gold_ranks"),
    )
    out = ru.qa_result_diagnostics(rows, "method", "lang", "correct", "reader_valid", "judge_valid", "quotes", "context", "gold_ranks")
    return rounded(out, 6, "primary_accuracy", "valid_only_accuracy")


@query(
    "retry_trajectory_summary",
    """WITH n AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn)-1 AS r, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM conversations),
 a AS (SELECT conv_id, r//2 AS t, count(*) AS sz, bool_and(turn % 2 = r % 2) AS ex, coalesce(bool_and(CASE WHEN r%2=0 THEN coalesce(starts_with(nx, text), false) END), true) AS gr, bool_and(length(text) >= 40) AS fu, string_agg(text, chr(31) ORDER BY r) AS sg FROM n GROUP BY ALL)
 SELECT conv_id, CAST(sum(sz) AS BIGINT) AS record_count, count(*) FILTER (sz=2) AS attempts, bool_and(sz=2 AND ex) AS expected_sequence, count(*) FILTER (sz=2 AND gr) AS prefix_of_retry_count, bool_and(fu) AS all_saturated, count(DISTINCT sg) AS distinct_attempts FROM a GROUP BY 1""",
)
def _(spark, sf):
    rows = turns(spark, sf).withColumn("budget", (F.col("turn") % 2).cast("int"))
    return ru.retry_trajectory_summary(rows, ["conv_id"], "turn", "budget", "text", [0, 1], F.length("text") >= 40)


BROKEN_SQL = """pb AS (SELECT stream, seq, event_id, publish_ns FROM ev WHERE event_id % 17 <> 0 UNION ALL SELECT stream, seq, event_id, publish_ns FROM ev WHERE event_id % 23 = 0),
 tn AS (SELECT stream, count(*) FILTER (b > seq) AS turned FROM (SELECT stream, seq, lag(seq) OVER (PARTITION BY stream ORDER BY publish_ns, seq) AS b FROM pb) GROUP BY 1), pp AS (SELECT e.stream, e.seq, count(b.seq) AS n FROM ev e LEFT JOIN pb b ON e.stream=b.stream AND e.seq=b.seq GROUP BY ALL),
 q AS (SELECT stream, count(*) FILTER (n=0) AS lost, CAST(sum(greatest(n-1,0)) AS BIGINT) AS duplicate, coalesce(max(turned),0) AS turned FROM pp LEFT JOIN tn USING (stream) GROUP BY 1),
 en AS (SELECT DISTINCT stream AS home, kind || '-' || stream AS node FROM ev WHERE stream % 9 <> 0 OR kind <> 'error'),
 ed AS (SELECT stream, kind || '-' || CASE WHEN event_id % 43 = 0 THEN stream + 1 ELSE stream END AS source, kind || '-' || stream AS target, arrival_ns AS va, CASE WHEN event_id % 53 = 0 THEN arrival_ns - 1 END AS ia, CASE WHEN event_id % 47 = 0 THEN event_id + 1 ELSE event_id END AS pv FROM ev),
 gp AS (SELECT stream, count(*) FILTER (home IS NULL) AS endpoint_missing, count(*) FILTER (home <> stream) AS endpoint_escape FROM (SELECT stream, source AS node FROM ed UNION ALL SELECT stream, target FROM ed) LEFT JOIN en USING (node) GROUP BY 1),
 gv AS (SELECT ed.stream, count(*) FILTER (x.stream IS NULL) AS provenance_dangling, count(*) FILTER (x.stream <> ed.stream) AS provenance_cross_namespace FROM ed LEFT JOIN (SELECT DISTINCT event_id, stream FROM pb) x ON x.event_id = ed.pv GROUP BY 1),
 gc AS (SELECT * FROM gp JOIN gv USING (stream) JOIN (SELECT stream, count(*) FILTER (ia < va) AS validity_reversed FROM ed GROUP BY 1) USING (stream))"""


def broken_publication(spark, sf):
    """Expected and published rows of every stream, some lost, some twice, and the integrity counts of the graph they make."""
    e, s = F.col("event_id"), F.col("stream")
    events = sequenced(spark, sf)
    rows = events.select("stream", "seq", "event_id", "publish_ns")
    published = rows.filter(e % 17 != 0).unionByName(rows.filter(e % 23 == 0))
    node = lambda stream: F.concat("kind", F.lit("-"), stream)
    entities = events.filter((s % 9 != 0) | (F.col("kind") != "error")).select("stream", node(s).alias("node")).distinct()
    edges = events.select("stream", e.alias("edge_id"), node(F.when(e % 43 == 0, s + 1).otherwise(s)).alias("source"), node(s).alias("target"), F.col("arrival_ns").alias("valid_at"), F.when(e % 53 == 0, F.col("arrival_ns") - 1).alias("invalid_at"))
    proof = edges.select("stream", "edge_id", F.when(F.col("edge_id") % 47 == 0, F.col("edge_id") + 1).otherwise(F.col("edge_id")).alias("episode_id"))
    episodes = published.select("stream", F.col("seq").alias("name"), F.col("event_id").alias("episode_id"))
    counts = sn.graph_integrity_counts(rows.select("stream", F.col("seq").alias("name")), episodes, entities, edges, proof, "stream")
    # lost and duplicate publications are counted by themselves
    return rows, published, counts.drop("lost_episodes", "duplicate_episodes", "unexpected_episodes")


@query(
    "direct_violations",
    f"""WITH {EV}, {BROKEN_SQL}, v AS (SELECT stream, count(*) FILTER (event_id % 29 = 0) AS visibility, count(*) FILTER (event_id % 31 = 0) AS temporal FROM ev GROUP BY 1),
 w AS (SELECT stream, lost, duplicate, CAST(CASE WHEN lost+duplicate+turned>0 THEN 1 ELSE 0 END AS BIGINT) AS order_violation, visibility, temporal, endpoint_missing, endpoint_escape, provenance_dangling, provenance_cross_namespace, validity_reversed FROM q JOIN v USING (stream) JOIN gc USING (stream))
 SELECT *, lost+duplicate+order_violation+visibility+temporal+endpoint_missing+endpoint_escape+provenance_dangling+provenance_cross_namespace+validity_reversed AS total,
 CAST(CAST(lost>0 AS INT)+CAST(duplicate>0 AS INT)+CAST(order_violation>0 AS INT)+CAST(visibility>0 AS INT)+CAST(temporal>0 AS INT)+CAST(endpoint_missing>0 AS INT)+CAST(endpoint_escape>0 AS INT)+CAST(provenance_dangling>0 AS INT)+CAST(provenance_cross_namespace>0 AS INT)+CAST(validity_reversed>0 AS INT) AS INT) AS violated_categories FROM w""",
)
def _(spark, sf):
    e = F.col("event_id")
    rows, published, graph = broken_publication(spark, sf)
    return ru.direct_violations(rows, published, ["stream"], "seq", ["publish_ns"], {"visibility": e % 29 == 0, "temporal": e % 31 == 0}, graph=graph)
