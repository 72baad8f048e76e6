"""Queries that end in a verdict per group."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import gates as gt
from tidemark.operators import rollups as ru
from tidemark.plans.inputs import EV, QA, RUNS, judged, runs
from tidemark.plans.registry import query
from tidemark.plans.rollup_queries import BROKEN_SQL, FUNNEL_SQL, OBS, broken_publication, funnel
from tidemark.plans.statistic_queries import rounded


@query(
    "go_no_go",
    f"""WITH {RUNS}, m AS (SELECT question AS q, count(*) FILTER (status='P') AS pending, count(*) AS n, CAST(sum(CASE WHEN method='1' THEN metric ELSE 0 END) AS DOUBLE) AS b, CAST(sum(CASE WHEN method='2' THEN metric ELSE 0 END) AS DOUBLE) AS c FROM runs GROUP BY 1),
 s AS (SELECT *, coalesce(CASE WHEN c <> 0 THEN b/c END, 0) AS speedup FROM m),
 r AS (SELECT q, CASE WHEN pending > 6 THEN 'runs_pending' WHEN q % 29 = 2 THEN 'hard_inconclusive' WHEN n < 7 THEN 'too_few_instances' WHEN q % 31 = 3 THEN 'parse_success_low' WHEN q % 23 = 4 THEN 'failed_runs_of_a_method' WHEN q % 7 = 1 THEN 'failed_runs'
  WHEN q % 37 = 5 THEN 'too_few_correctness_runs' WHEN q % 11 = 0 THEN 'not_exactly_once' WHEN q % 41 = 6 THEN 'unexpected_prompts' WHEN q % 43 = 7 THEN 'graph_parity' WHEN speedup < 1.2 THEN 'speedup_below_floor'
  WHEN speedup >= 1.5 AND q % 5 <> 0 AND q % 13 <> 0 AND q % 3 <> 0 AND q % 17 <> 0 AND q % 19 <> 0 AND q % 47 <> 0 THEN 'all_thresholds_met' ELSE 'threshold_missed' END AS reason FROM s)
 SELECT q AS question, CASE WHEN reason IN ('runs_pending','hard_inconclusive','too_few_instances','parse_success_low','failed_runs_of_a_method','failed_runs','too_few_correctness_runs') THEN 'INCONCLUSIVE' WHEN reason = 'all_thresholds_met' THEN 'GO' ELSE 'NO-GO' END AS verdict, reason FROM r""",
)
def _(spark, sf):
    q = F.col("question")
    of = lambda m: F.sum(F.when(F.col("method") == m, F.col("metric")).otherwise(0)).cast("double")
    metrics = runs(spark, sf).groupBy("question").agg(F.count_if(F.col("status") == "P").alias("pending"), F.count(F.lit(1)).alias("completed_instances"), of("1").alias("b"), of("2").alias("c")).withColumns(
        {
            "pending_runs": F.when(F.col("pending") > 6, F.col("pending")).otherwise(0),
            "hard_reasons": (q % 29 == 2).cast("int"),
            "parse_success_rate": F.when(q % 31 == 3, 0.99).otherwise(1.0),
            "worst_method_failed_rate": F.when(q % 23 == 4, 0.2).otherwise(0.01),
            "failed_run_rate": F.when(q % 7 == 1, 0.2).otherwise(0.0),
            "correctness_runs": F.when(q % 37 == 5, 6).otherwise(8),
            "exactly_once": q % 11 != 0,
            "unexpected_prompts": (q % 41 == 6).cast("int"),
            "parity_count": F.when(q % 43 == 7, 7).otherwise(8),
            "speedup": ru.ratio(F.col("b"), F.col("c")),
            "p95_reduction": F.when(q % 5 == 0, 0.2).otherwise(0.4),
            "speedup_ci_low": F.when(q % 13 == 0, 0.9).otherwise(1.1),
            "recall_drop_pp": F.when(q % 3 == 0, 2.0).otherwise(0.5),
            "token_growth": F.when(q % 17 == 0, 0.06).otherwise(0.01),
            "order_violation": q % 19 == 0,
            "divergences": F.when(q % 47 == 0, 0).otherwise(1),
        }
    )
    return gt.rule_gate(metrics, gt.GO_NO_GO, gt.GO_NO_GO_DEFAULT).select("question", "verdict", "reason")


@query(
    "semantic_quality_gate",
    f"""WITH {QA}, c AS (SELECT DISTINCT method, question_type, CASE WHEN method='B' AND length(question_type)=4 AND right(question_type,1) IN ('3','7') THEN 'UNSAFE_UPDATE' WHEN question_type = 'src1' THEN 'NOT_OBSERVABLE' ELSE 'PASS' END AS status FROM qa),
 a AS (SELECT method, question_type, count(*) AS qa_count, CAST(count(*) FILTER (correct) AS DOUBLE)/count(*) AS acc FROM qa GROUP BY ALL), d AS (SELECT method, CASE WHEN bool_or(status='UNSAFE_UPDATE') THEN 'STOP_UNSAFE_UPDATE' WHEN bool_or(status='NOT_OBSERVABLE') THEN 'STOP_OBSERVABILITY' ELSE 'PASS' END AS decision, bool_and(status='PASS') AS quality_eligible FROM c GROUP BY 1)
 SELECT method, question_type, status, qa_count, round(acc,6) AS raw_accuracy, round(CASE WHEN status='PASS' THEN acc END,6) AS eligible_accuracy, decision, quality_eligible FROM c JOIN a USING (method, question_type) JOIN d USING (method)""",
)
def _(spark, sf):
    rows = judged(spark, sf)
    built = rows.select("method", "question_type").distinct()
    t = F.col("question_type")
    unsafe = (F.col("method") == "B") & (F.length(t) == 4) & F.substring(t, -1, 1).isin("3", "7")
    gate = gt.semantic_quality_gate(built, rows, ["method", "question_type"], unsafe, t != "src1", "correct")
    return rounded(gate, 6, "raw_accuracy", "eligible_accuracy").join(gt.semantic_decision(gate, ["method"]), "method")


@query(
    "replay_gate",
    f"""WITH {OBS}, f AS ({FUNNEL_SQL}) SELECT stream, CASE WHEN low_conflict=0 THEN 'STOP_CONFLICT_AWARE' WHEN stream % 10 = 9 THEN 'STOP_CONFLICT_AWARE' WHEN NOT coalesce(conflict_complete AND semantic_complete,false) THEN 'STOP_PREDICTOR' WHEN stream % 6 = 5 OR low_hit_rate IS NULL OR high_hit_rate IS NULL OR low_hit_rate <= high_hit_rate THEN 'STOP_PREDICTOR' WHEN stream % 8 = 7 OR after_resource = 0 OR NOT coalesce(resource_complete,false) THEN 'RESOURCE_POLICY_LIMIT' WHEN would_launch = 0 OR NOT coalesce(value_complete,false) THEN 'RESOURCE_POLICY_LIMIT' ELSE 'GO' END AS verdict,
 CASE WHEN low_conflict=0 THEN 'low_conflict_opportunities_zero' WHEN stream % 10 = 9 THEN 'exact_validation_missing' WHEN NOT coalesce(conflict_complete AND semantic_complete,false) THEN 'provenance_incomplete' WHEN stream % 6 = 5 OR low_hit_rate IS NULL OR high_hit_rate IS NULL OR low_hit_rate <= high_hit_rate THEN 'not_selective' WHEN stream % 8 = 7 OR after_resource = 0 OR NOT coalesce(resource_complete,false) THEN 'resource_gate_not_proven' WHEN would_launch = 0 OR NOT coalesce(value_complete,false) THEN 'would_launch_zero' ELSE 'all_gates_passed' END AS reason FROM f""",
)
def _(spark, sf):
    s = F.col("stream")
    metrics = rounded(funnel(spark, sf), 6, "low_hit_rate", "high_hit_rate").withColumns({"exact_validation": s % 10 != 9, "nonstarving": s % 8 != 7, "selectivity_complete": s % 6 != 5})
    return gt.rule_gate(metrics, gt.REPLAY, gt.REPLAY_DEFAULT).select("stream", "verdict", "reason")


@query(
    "capacity_signal_class",
    f"""WITH {EV}, f AS (SELECT stream, stream % 9 <> 0 AS q, max(cents) > 25000 AS c, count(*) FILTER (kind='error') > 14 AS d FROM ev GROUP BY 1)
 SELECT stream, CASE WHEN NOT q THEN 'BLOCKED_QUALITY_PROTOCOL' WHEN c AND d THEN 'CAPACITY_SIGNAL_WITH_COUNTEREXAMPLE' WHEN c THEN 'CAPACITY_SIGNAL_ONLY' WHEN d THEN 'COUNTEREXAMPLE_ONLY' ELSE 'NO_SIGNAL' END AS verdict, CASE WHEN NOT q THEN 'NO_METHOD_SELECTED' WHEN c AND d THEN 'CANDIDATE' WHEN c THEN 'NO_METHOD_SELECTED' WHEN d THEN 'STOP_OR_REFRAME' ELSE 'NO_METHOD_SELECTED' END AS reason FROM f""",
)
def _(spark, sf):
    from tidemark.plans.inputs import lifecycle

    flags = lifecycle(spark, sf).groupBy("stream").agg((F.max("cents") > 25_000).alias("capacity_signal"), (F.count_if(F.col("kind") == "error") > 14).alias("counterexample")).withColumn("quality_usable", F.col("stream") % 9 != 0)
    return gt.rule_gate(flags, gt.CAPACITY, gt.CAPACITY_DEFAULT).select("stream", "verdict", "reason")


@query(
    "quality_freeze",
    f"""WITH {QA}, m AS (SELECT method, question_type, context, count(*) AS n, count(*) FILTER (judge_valid) AS v, count(*) FILTER (correct) AS k FROM qa GROUP BY ALL)
 SELECT method, question_type, context, CASE WHEN v < n THEN 'BLOCK_INVALID' WHEN k >= 2 THEN 'FREEZE' ELSE 'STOP_LOW_SIGNAL' END AS verdict, CASE WHEN v < n THEN 'invalid_judge_rows' WHEN k >= 2 THEN 'enough_correct' ELSE 'too_few_correct' END AS reason FROM m""",
)
def _(spark, sf):
    counts = judged(spark, sf).groupBy("method", "question_type", "context").agg(F.count(F.lit(1)).alias("question_count"), F.count_if("judge_valid").alias("valid_count"), F.count_if(F.coalesce("correct", F.lit(False))).alias("correct_count"), F.lit(2).alias("needed"))
    return gt.rule_gate(counts, gt.QUALITY_FREEZE, gt.QUALITY_FREEZE_DEFAULT).select("method", "question_type", "context", "verdict", "reason")


@query(
    "invariant_report",
    f"""WITH {EV}, {BROKEN_SQL}, v AS (SELECT stream, count(*) FILTER (event_id % 29 = 0) AS temporal, count(*) FILTER (event_id % 31 = 0) AS service FROM ev GROUP BY 1),
 w AS (SELECT stream, lost, duplicate, CAST(CASE WHEN lost+duplicate+turned>0 THEN 1 ELSE 0 END AS BIGINT) AS order_violation, temporal, service, endpoint_missing, endpoint_escape, provenance_dangling, provenance_cross_namespace, validity_reversed FROM q JOIN v USING (stream) JOIN gc USING (stream))
 SELECT *, CAST(lost>0 AS INT)+CAST(duplicate>0 AS INT)+CAST(order_violation>0 AS INT)+CAST(temporal>0 AS INT)+CAST(service>0 AS INT)+CAST(endpoint_missing>0 AS INT)+CAST(endpoint_escape>0 AS INT)+CAST(provenance_dangling>0 AS INT)+CAST(provenance_cross_namespace>0 AS INT)+CAST(validity_reversed>0 AS INT) AS direct_violation_kinds,
 CAST(stream % 4 = 0 AS INT)+CAST(stream % 6 = 0 AS INT) AS confounded_kinds, stream % 4 = 0 AS graph_mismatch, stream % 6 = 0 AS retrieval_mismatch FROM w""",
)
def _(spark, sf):
    e, s = F.col("event_id"), F.col("stream")
    rows, published, graph = broken_publication(spark, sf)
    kinds = ["lost", "duplicate", "order_violation", "temporal", "service", *[c for c in graph.columns if c != "stream"]]
    counts = ru.direct_violations(rows, published, ["stream"], "seq", ["publish_ns"], {"temporal": e % 29 == 0, "service": e % 31 == 0}, graph=graph).drop("total", "violated_categories")
    return gt.invariant_report(counts, kinds, {"graph_mismatch": s % 4 == 0, "retrieval_mismatch": s % 6 == 0})
