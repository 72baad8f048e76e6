"""Decision tables: ordered rules over one metrics row per group, evaluated for all groups at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """The first rule whose condition (SQL over the metrics row) holds gives verdict and reason."""

    when: str
    verdict: str
    reason: str


def rule_gate(metrics: DataFrame, rules: Sequence[Rule], otherwise: tuple[str, str], *, verdict: str = "verdict", reason: str = "reason") -> DataFrame:
    """A condition that is NULL does not hold. ``otherwise`` is the verdict and reason when no rule fires."""
    v, r = F.lit(otherwise[0]), F.lit(otherwise[1])
    for rule in reversed(rules):
        holds = F.coalesce(F.expr(rule.when), F.lit(False))
        v, r = F.when(holds, rule.verdict).otherwise(v), F.when(holds, rule.reason).otherwise(r)
    return metrics.withColumns({verdict: v, reason: r})


# Verdicts, reasons and thresholds of the gates below.
GO_NO_GO = [
    Rule("pending_runs > 0", "INCONCLUSIVE", "runs_pending"),
    Rule("hard_reasons > 0", "INCONCLUSIVE", "hard_inconclusive"),
    Rule("completed_instances < 7", "INCONCLUSIVE", "too_few_instances"),
    Rule("parse_success_rate < 0.995", "INCONCLUSIVE", "parse_success_low"),
    Rule("worst_method_failed_rate > 0.05", "INCONCLUSIVE", "failed_runs_of_a_method"),
    Rule("failed_run_rate > 0.05", "INCONCLUSIVE", "failed_runs"),
    Rule("correctness_runs < 8", "INCONCLUSIVE", "too_few_correctness_runs"),
    Rule("correctness_runs >= 8 AND NOT coalesce(exactly_once, false)", "NO-GO", "not_exactly_once"),
    Rule("correctness_runs >= 8 AND unexpected_prompts > 0", "NO-GO", "unexpected_prompts"),
    Rule("coalesce(parity_count, 0) < 8", "NO-GO", "graph_parity"),
    Rule("coalesce(speedup, 0) < 1.2", "NO-GO", "speedup_below_floor"),
    Rule(
        "speedup >= 1.5 AND p95_reduction >= 0.30 AND speedup_ci_low > 1.0 AND parity_count = 8 AND recall_drop_pp <= 1.0 AND token_growth <= 0.05 AND NOT order_violation AND divergences >= 1",
        "GO",
        "all_thresholds_met",
    ),
]
GO_NO_GO_DEFAULT = ("NO-GO", "threshold_missed")

REPLAY = [
    Rule("low_conflict = 0", "STOP_CONFLICT_AWARE", "low_conflict_opportunities_zero"),
    Rule("NOT exact_validation", "STOP_CONFLICT_AWARE", "exact_validation_missing"),
    Rule("NOT coalesce(conflict_complete AND semantic_complete, false)", "STOP_PREDICTOR", "provenance_incomplete"),
    Rule("NOT coalesce(selectivity_complete, false) OR low_hit_rate IS NULL OR high_hit_rate IS NULL OR low_hit_rate <= high_hit_rate", "STOP_PREDICTOR", "not_selective"),
    Rule("NOT nonstarving OR after_resource = 0 OR NOT coalesce(resource_complete, false)", "RESOURCE_POLICY_LIMIT", "resource_gate_not_proven"),
    Rule("would_launch = 0 OR NOT coalesce(value_complete, false)", "RESOURCE_POLICY_LIMIT", "would_launch_zero"),
]
REPLAY_DEFAULT = ("GO", "all_gates_passed")

CAPACITY = [
    Rule("NOT quality_usable", "BLOCKED_QUALITY_PROTOCOL", "NO_METHOD_SELECTED"),
    Rule("capacity_signal AND counterexample", "CAPACITY_SIGNAL_WITH_COUNTEREXAMPLE", "CANDIDATE"),
    Rule("capacity_signal", "CAPACITY_SIGNAL_ONLY", "NO_METHOD_SELECTED"),
    Rule("counterexample", "COUNTEREXAMPLE_ONLY", "STOP_OR_REFRAME"),
]
CAPACITY_DEFAULT = ("NO_SIGNAL", "NO_METHOD_SELECTED")

QUALITY_FREEZE = [Rule("valid_count < question_count", "BLOCK_INVALID", "invalid_judge_rows"), Rule("correct_count >= needed", "FREEZE", "enough_correct")]
QUALITY_FREEZE_DEFAULT = ("STOP_LOW_SIGNAL", "too_few_correct")


def semantic_quality_gate(construction: DataFrame, qa: DataFrame, keys: Sequence[str], unsafe: Column, evidenced: Column, correct: str) -> DataFrame:
    """Answer quality counts only where the built state is shown safe: status per group and the accuracy kept for diagnosis."""
    status = F.when(unsafe, "UNSAFE_UPDATE").when(evidenced, "PASS").otherwise("NOT_OBSERVABLE")
    accuracy = qa.groupBy(*keys).agg(F.count(F.lit(1)).alias("qa_count"), F.avg(F.coalesce(F.col(correct), F.lit(False)).cast("double")).alias("raw_accuracy"))
    rows = construction.select(*keys, status.alias("status")).join(accuracy, list(keys), "left")
    return rows.withColumn("eligible_accuracy", F.when(F.col("status") == "PASS", F.col("raw_accuracy")))


def semantic_decision(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One decision per run over its groups: any unsafe group stops it, any unproven one leaves it unobservable."""
    any_ = lambda s: F.bool_or(F.col("status") == s)
    return rows.groupBy(*keys).agg(
        F.when(any_("UNSAFE_UPDATE"), "STOP_UNSAFE_UPDATE").when(any_("NOT_OBSERVABLE"), "STOP_OBSERVABILITY").otherwise("PASS").alias("decision"), F.bool_and(F.col("status") == "PASS").alias("quality_eligible")
    )


def invariant_report(counts: DataFrame, direct: Sequence[str], confounded: Mapping[str, Column]) -> DataFrame:
    """How many kinds of direct violation a row shows, and how many signs that only confounded evidence explains."""
    hit = F.lit(0)
    for c in direct:
        hit = hit + (F.col(c) > 0).cast("int")
    soft = F.lit(0)
    for c in confounded.values():
        soft = soft + F.coalesce(c, F.lit(False)).cast("int")
    return counts.withColumns({"direct_violation_kinds": hit, "confounded_kinds": soft, **{n: F.coalesce(c, F.lit(False)) for n, c in confounded.items()}})
