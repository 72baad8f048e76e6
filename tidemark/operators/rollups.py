"""Tables per run, episode, phase, history, block and method."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.digests import multiset_digest
from tidemark.functions.measures import amdahl, ratio
from tidemark.operators.intervals import active_levels, clip, interval_union
from tidemark.operators.ordered import Running, largest_group, ordered_scan
from tidemark.operators.quantiles import LINEAR, exact_quantiles
from tidemark.operators.statistics import distribution_summary

SECOND = 1_000_000_000


def _n() -> Column:
    return F.count(F.lit(1))


def _true(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


def _sum_if(cond: Column, value: Column) -> Column:
    return F.sum(F.when(cond, value).otherwise(F.lit(0)))


def episode_run_summary(df: DataFrame, keys: Sequence[str], arrival: str, publish: str, latency: str) -> DataFrame:
    spans = df.groupBy(*keys).agg((F.max(publish) - F.min(arrival)).alias("makespan"), (F.max(publish) - F.max(arrival)).alias("drain"), _n().alias("episode_count"))
    return spans.join(exact_quantiles(df, keys, latency, {"p50": 0.5, "p95": 0.95, "p99": 0.99}, method=LINEAR), list(keys))


def block_timing(df: DataFrame, keys: Sequence[str], submit: str, durable: str, seal: str) -> DataFrame:
    """Makespan, drain tail and sealing latency of a block, and whether its four instants are in order."""
    marks = df.groupBy(*keys).agg(F.min(submit).alias("_t0"), F.max(submit).alias("_t1"), F.max(durable).alias("_t2"), F.max(seal).alias("_t3"))
    t0, t1, t2, t3 = (F.col(f"_t{i}") for i in range(4))
    return marks.select(
        *keys, (t2 - t0).alias("build_makespan_ns"), (t2 - t1).alias("drain_tail_ns"), (t3 - t2).alias("validation_seal_latency_ns"), ((t0 <= t1) & (t1 <= t2) & (t2 <= t3)).alias("in_order")
    )


def block_outcome_metrics(df: DataFrame, keys: Sequence[str], status: str, arrival: str, start: str, publish: str, terminal: str) -> DataFrame:
    """Outcome counts; makespan runs from the first service to the last end of anything that started."""
    s = F.col(status)
    started = F.col(start).isNotNull() & F.col(terminal).isNotNull()
    published = s == "PUBLISHED"
    done = F.greatest(F.col(terminal), F.when(published, F.col(publish)))
    sums = df.groupBy(*keys).agg(
        _n().alias("expected"),
        F.count_if(published).alias("published"),
        F.count_if(s == "FAILED").alias("failed"),
        F.count_if(s == "CENSORED").alias("censored"),
        (F.max(F.when(started, done)) - F.min(F.when(started, F.col(start)))).alias("makespan_ns"),
    )
    fresh = exact_quantiles(df.filter(published).withColumn("_f", F.col(publish) - F.col(arrival)), keys, "_f", {"p95_freshness_ns": 0.95})
    return sums.join(fresh, list(keys), "left").withColumn("goodput_per_s", ratio(F.col("published") * float(SECOND), F.col("makespan_ns")))


def aligned_performance(df: DataFrame, keys: Sequence[str], arrival: str, start: str, publish: str, *, hot: int | None = None) -> DataFrame:
    sums = df.groupBy(*keys).agg(_n().alias("episode_count"), (F.max(publish) - F.min(arrival)).alias("makespan_ns"))
    fresh = exact_quantiles(df.withColumn("_f", F.col(publish) - F.col(arrival)), keys, "_f", {"p95_freshness_ns": 0.95, "p99_freshness_ns": 0.99}, hot=hot)
    peak = lambda end, out: active_levels(df, keys, arrival, end, hot=hot).groupBy(*keys).agg(F.max("active").alias(out))
    return (
        sums.join(fresh, list(keys))
        .join(peak(publish, "max_outstanding"), list(keys), "left")
        .join(peak(start, "max_waiting"), list(keys), "left")
        .fillna(0, ["max_outstanding", "max_waiting"])
        .withColumn("goodput_per_s", ratio(F.col("episode_count") * float(SECOND), F.col("makespan_ns")))
    )


def history_metrics(df: DataFrame, keys: Sequence[str], arrival: str, start: str, publish: str, terminal: str, depth: str, work: Mapping[str, Column], *, serial: bool = False, hot: int | None = None) -> DataFrame:
    """One row per history and latency kind with its distribution, joined to the history's totals."""
    kinds = {"queue_delay": (start, arrival), "service": (publish, start), "freshness": (publish, arrival), "terminal": (terminal, arrival)}
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), (F.col(b) - F.col(a)).alias("ns")) for n, (b, a) in kinds.items()])).alias("_m"))
    tails = distribution_summary(long.select(*keys, "_m.*"), [*keys, "metric"], "ns", hot=hot)
    sums = df.groupBy(*keys).agg(
        _n().alias("episode_count"),
        (F.max(terminal) - F.min(arrival)).alias("makespan_ns"),
        (F.lit(None).cast("long") if serial else F.max(depth)).alias("max_backlog"),
        *[F.sum(c).alias(n) for n, c in work.items()],
    )
    status = F.lit("NOT_APPLICABLE_SERIAL_BASELINE" if serial else "OBSERVED")
    sums = sums.withColumns({"goodput_per_s": ratio(F.col("episode_count") * float(SECOND), F.col("makespan_ns")), "max_backlog_status": status})
    return tails.join(sums, list(keys))


def phase_metrics(df: DataFrame, keys: Sequence[str], phase: str, start: str, end: str, counters: Sequence[str]) -> DataFrame:
    """Union time per phase (nested spans are never added up), span count and summed counters."""
    by = [*keys, phase]
    # counts and sums ride along with the starts whose union is taken, so the spans are grouped once
    starts = df.groupBy(*by, start).agg(F.max(F.when(F.col(end) > F.col(start), F.col(end))).alias("_e"), _n().alias("span_count"), *[F.sum(c).alias(c) for c in counters])
    seen = ordered_scan(starts, by, [start], running={"_seen": Running("max", F.col("_e"), False)})
    fresh = F.greatest(F.lit(0), F.col("_e") - F.greatest(F.col(start), F.col("_seen")))
    return seen.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("span_count", *counters)], F.sum(fresh).alias("duration_ns"))


def phase_occupancy(df: DataFrame, roots: DataFrame, keys: Sequence[str], phase: str, start: str, end: str) -> DataFrame:
    """Share of the root's time during which each phase was active."""
    whole = interval_union(roots, keys, start, end, "root_ns", hot=1)
    rows = phase_metrics(df, keys, phase, start, end, []).join(whole, list(keys), "left").fillna(0, ["root_ns"])
    return rows.withColumn("occupancy_fraction", F.coalesce(ratio(F.col("duration_ns"), F.col("root_ns")), F.lit(0.0)))


def work_counters(df: DataFrame, keys: Sequence[str], counts: Mapping[str, Column], sums: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """Conditional counts and sums in one pass."""
    return df.groupBy(*keys).agg(*[_true(c).alias(n) for n, c in counts.items()], *[_sum_if(c, v).alias(n) for n, (c, v) in sums.items()])


def sum_counter_maps(df: DataFrame, keys: Sequence[str], counters: str, name: str = "counter", out: str = "total") -> DataFrame:
    """Merge maps of counts: one row per key and counter."""
    return df.select(*keys, F.explode(counters).alias(name, "_v")).groupBy(*keys, name).agg(F.sum("_v").alias(out))


def grouped_profile(df: DataFrame, dimensions: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """One table over several single-column groupings and the grand total: ``dimension, member`` and the aggregates.

    The rows are read once and combined map-side; ``member`` is NULL for the total.
    """
    at = {d: F.lit(i) for i, d in enumerate(dimensions)}
    member = F.explode(F.array(F.struct(F.lit("ALL").alias("dimension"), F.lit(None).cast("string").alias("member")), *[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("member")) for d in at]))
    return df.withColumn("_g", member).groupBy(F.col("_g.dimension").alias("dimension"), F.col("_g.member").alias("member")).agg(*aggs)


def reconcile_profile(profile: DataFrame, totals: Sequence[str]) -> DataFrame:
    """Per dimension: do its members add up to the grand total."""
    whole = profile.filter("dimension = 'ALL'").select(F.lit(1).alias("_k"), *[F.col(c).alias(f"_all_{c}") for c in totals])
    parts = profile.groupBy("dimension").agg(F.lit(1).alias("_k"), *[F.sum(c).alias(c) for c in totals])
    same = [F.col(c) == F.col(f"_all_{c}") for c in totals]
    check = same[0]
    for s in same[1:]:
        check = check & s
    return parts.join(whole, "_k").select("dimension", *totals, check.alias("reconciled"))


def work_delta(base: DataFrame, candidate: DataFrame, operator: str, calls: str, tokens: str, families: Mapping[str, str]) -> DataFrame:
    """Per operator: change in calls and tokens and what kind of change that is. Unchanged operators drop out."""
    b = base.select(operator, F.col(calls).alias("_bc"), F.col(tokens).alias("_bt"))
    c = candidate.select(operator, F.col(calls).alias("_cc"), F.col(tokens).alias("_ct"))
    zero = lambda n: F.coalesce(F.col(n), F.lit(0))
    rows = b.join(c, operator, "full_outer").select(operator, (zero("_cc") - zero("_bc")).alias("call_delta"), (zero("_ct") - zero("_bt")).alias("token_delta"))
    family = F.lit("state_divergence")
    for member, name in families.items():
        family = F.when(F.col(operator) == member, name).otherwise(family)
    return rows.filter("call_delta <> 0 OR token_delta <> 0").withColumn("category", F.when(F.col("call_delta") == 0, "UNKNOWN").otherwise(family))


def against_base(per_method: DataFrame, method: str, base: str, ratios: Mapping[str, tuple[str, bool]]) -> DataFrame:
    """Ratios of each method's row to the base method's; ``True`` inverts (base / own), as for speedups.

    The input has one row per method, so the base row is spread with a window over that small table.
    """
    every = Window.partitionBy(F.lit(0))
    out = {}
    for name, (column, inverted) in ratios.items():
        of_base = F.max(F.when(F.col(method) == base, F.col(column))).over(every)
        out[name] = ratio(of_base, F.col(column)) if inverted else ratio(F.col(column), of_base)
    return per_method.withColumns(out)


def quality_main_table(df: DataFrame, method: str, metrics: Sequence[str], correct: str, valid: str) -> DataFrame:
    """Mean ranking metrics and accuracy twice: invalid verdicts counted wrong, and left out."""
    right = _true(F.col(correct) & F.col(valid))
    return df.groupBy(method).agg(
        _n().alias("qa_n"),
        *[F.avg(m).alias(m) for m in metrics],
        ratio(right, _n()).alias("accuracy_invalid_wrong"),
        _true(~F.col(valid)).alias("invalid"),
        ratio(right, _true(F.col(valid))).alias("valid_only_accuracy"),
    )


def method_summary(df: DataFrame, method: str, breakdowns: Sequence[str], correct: str, valid: str, failure: str, metrics: Sequence[str], intervals: DataFrame) -> DataFrame:
    """Per method, and per method and member of each breakdown: counts, accuracy, means of ``metrics`` and failures by class.

    Invalid rows are left out of the accuracy and counted by ``failure`` (null: ``unknown``) as ``class:n`` in order; a metric's
    mean is over the rows that have it. ``intervals(method, ci_low, ci_high)`` goes with a method's own row. Rows are first
    counted per method, breakdowns and failure class, then over grouping sets; classes are few.
    """
    v = F.coalesce(F.col(valid), F.lit(False))
    broken = F.when(~v, F.coalesce(F.col(failure), F.lit("unknown"))).alias("_f")
    named = [F.coalesce(F.col(b).cast("string"), F.lit("unknown")).alias(b) for b in breakdowns]
    sums = {"qa_count": _n(), "valid_count": _true(v), "correct_count": _true(F.col(correct) & v)}
    sums |= {f"_sum_{m}": F.sum(m) for m in metrics} | {f"_n_{m}": F.count(m) for m in metrics}
    small = df.select(method, *named, broken, v.alias(valid), correct, *metrics).groupBy(method, *breakdowns, "_f").agg(*[c.alias(n) for n, c in sums.items()])
    sets = [[method, "_f"], *[[method, b, "_f"] for b in breakdowns]]
    rows = small.groupingSets(sets, method, *breakdowns, "_f").agg(F.grouping_id().alias("_set"), *[F.sum(n).alias(n) for n in sums])
    # the bits of a set tell which breakdown it has: method and class are in all, so only the columns between them differ
    width = len(breakdowns)
    dimension, member = F.lit("ALL"), F.lit(None).cast("string")
    for i, b in enumerate(breakdowns):
        there = F.col("_set").bitwiseAND(1 << (width - i)) == 0
        dimension, member = F.when(there, b).otherwise(dimension), F.when(there, F.col(b)).otherwise(member)
    rows = rows.withColumns({"dimension": dimension, "member": member})
    classes = F.array_sort(F.collect_list(F.when(F.col("_f").isNotNull(), F.struct("_f", "qa_count"))))
    shown = F.array_join(F.transform(classes, lambda x: F.concat(x["_f"], F.lit(":"), x["qa_count"])), ",")
    total = rows.groupBy(method, "dimension", "member").agg(*[F.sum(n).alias(n) for n in sums], shown.alias("failures"))
    means = [ratio(F.col(f"_sum_{m}"), F.col(f"_n_{m}")).alias(f"mean_{m}") for m in metrics]
    total = total.join(intervals.select(method, F.lit("ALL").alias("dimension"), "ci_low", "ci_high"), [method, "dimension"], "left")
    return total.select(method, "dimension", "member", "qa_count", "valid_count", (F.col("qa_count") - F.col("valid_count")).alias("invalid_count"), "correct_count", ratio(F.col("correct_count"), F.col("valid_count")).alias("qa_accuracy"), *means, "failures", "ci_low", "ci_high")


def paired_disagreements(df: DataFrame, keys: Sequence[str], item: str, method: str, left: str, right: str, correct: str, valid: str, group: Sequence[str] = ()) -> DataFrame:
    """Category counts over items judged for both methods, invalid counts per side and the accuracy difference."""
    side = lambda m, c: F.bool_or(F.when(F.col(method) == m, F.coalesce(F.col(c), F.lit(False))))
    pairs = df.groupBy(*group, *keys, item).agg(side(left, valid).alias("lv"), side(right, valid).alias("rv"), side(left, correct).alias("lc"), side(right, correct).alias("rc"))
    lv, rv, lc, rc = (F.coalesce(F.col(c), F.lit(False)) for c in ("lv", "rv", "lc", "rc"))
    both = lv & rv
    acc = lambda c, v: ratio(F.count_if(c & v), F.count_if(v))
    return pairs.groupBy(*group).agg(
        _n().alias("qa_count"),
        F.count_if(both & lc & rc).alias("both_correct"),
        F.count_if(both & lc & ~rc).alias("left_only_correct"),
        F.count_if(both & ~lc & rc).alias("right_only_correct"),
        F.count_if(both & ~lc & ~rc).alias("both_wrong"),
        F.count_if(~lv).alias("invalid_left"),
        F.count_if(~rv).alias("invalid_right"),
        (acc(rc, rv) - acc(lc, lv)).alias("delta_accuracy"),
    )


def judge_outcomes(df: DataFrame, keys: Sequence[str], correct: str, valid: str) -> DataFrame:
    v, right = _true(F.col(valid)), _true(F.col(correct) & F.col(valid))
    return df.groupBy(*keys).agg(
        _n().alias("total_attempted"),
        v.alias("valid_denominator"),
        right.alias("correct_count"),
        (v - right).alias("incorrect_count"),
        (_n() - v).alias("invalid_count"),
        ratio(right, v).alias("qa_accuracy"),
        ((_n() == v) & (v > 0)).alias("headline_eligible"),
    )


def macro_micro_accuracy(df: DataFrame, method: str, correct: str, valid: str, coverage: str) -> DataFrame:
    """Accuracy over valid rows and mean coverage over all rows, per method and overall (method NULL)."""
    v = _true(F.col(valid))
    return df.rollup(method).agg(
        _n().alias("question_count"), v.alias("valid_judge_count"), (_n() - v).alias("invalid_judge_count"), ratio(_true(F.col(correct) & F.col(valid)), v).alias("qa_accuracy"), F.avg(coverage).alias("coverage_macro")
    )


def opportunity_bounds(roots: DataFrame, spans: DataFrame, keys: Sequence[str], start: str, end: str, sure: Column, possible: Column, workers: Sequence[int] = (2, 4, 8)) -> DataFrame:
    """Lower and upper parallel share of each root from unions of its clipped spans, with speedup bounds."""
    frame = roots.select(*keys, F.col(start).alias("_lo"), F.col(end).alias("_hi"))
    inside = clip(spans.join(frame, list(keys)), start, end, F.col("_lo"), F.col("_hi"))
    hot = largest_group(spans, keys)
    low = interval_union(inside.filter(sure), keys, start, end, "lower_ns", hot=hot)
    high = interval_union(inside.filter(sure | possible), keys, start, end, "upper_ns", hot=hot)
    rows = (
        frame.select(*keys, (F.col("_hi") - F.col("_lo")).alias("total_ns"))
        .filter("total_ns > 0")
        .join(low, list(keys), "left")
        .join(high, list(keys), "left")
        .fillna(0, ["lower_ns", "upper_ns"])
        .withColumns({"p_low": ratio(F.col("lower_ns"), F.col("total_ns")), "p_high": ratio(F.col("upper_ns"), F.col("total_ns"))})
    )
    return rows.withColumns({f"speedup_{side}_{w}": amdahl(F.col(f"p_{side}"), w) for w in workers for side in ("low", "high")})


def dependency_class_time(roots: DataFrame, spans: DataFrame, rules: DataFrame, keys: Sequence[str], phase: str, start: str, end: str, rest: str = "unknown") -> DataFrame:
    """Union time per dependency class inside each root; what no span covers counts as ``rest``.

    ``rules`` maps a phase to its class and is a short fixed table.
    """
    frame = roots.select(*keys, F.col(start).alias("_lo"), F.col(end).alias("_hi")).filter("_hi > _lo")
    classed = clip(spans.join(rules, phase).join(frame, list(keys)), start, end, F.col("_lo"), F.col("_hi"))
    hot = largest_group(spans, keys)
    # every span counts for its class and, under the class NULL, for the cover of all; one union gives both
    both = classed.select(*keys, start, end, F.explode(F.array(F.col("dependency_class"), F.lit(None).cast("string"))).alias("dependency_class"))
    spent = interval_union(both, [*keys, "dependency_class"], start, end, "_t", hot=hot)
    parts = spent.unionByName(frame.select(*keys, F.lit(rest).alias("dependency_class"), (F.col("_hi") - F.col("_lo")).alias("_t")))
    # the rest is the root less what all spans cover
    named = parts.select(*keys, F.coalesce("dependency_class", F.lit(rest)).alias("dependency_class"), F.when(F.col("dependency_class").isNull(), -F.col("_t")).otherwise(F.col("_t")).alias("_t"))
    return named.groupBy(*keys, "dependency_class").agg(F.sum("_t").alias("time_ns"))


def opportunity_funnel(df: DataFrame, keys: Sequence[str], chance: str, conflict: str, mode: str, resource: str, value: str, outcome: str, proofs: Mapping[str, str]) -> DataFrame:
    """Nested filters in one aggregate: opportunities, low conflict, model needed, resources, value; hit rate of each class.

    ``proofs`` names the proof column of each stage (conflict, semantic, resource, value, outcome); a stage is complete
    when every row that reaches it has its proof.
    """
    o = F.coalesce(F.col(chance), F.lit(False))
    low = o & (F.col(conflict) == "LOW_CONFLICT")
    high = o & (F.col(conflict) == "HIGH_CONFLICT")
    low_model = low & (F.col(mode) == "LLM")
    admitted = low_model & F.coalesce(F.col(resource), F.lit(False))
    launch = admitted & F.coalesce(F.col(value), F.lit(False))
    hit, miss = F.col(outcome) == "HIT", F.col(outcome) == "MISS"
    rate = lambda c: ratio(F.count_if(c & hit), F.count_if(c & (hit | miss)))
    return df.groupBy(*keys).agg(
        F.count_if(o).alias("opportunities"),
        F.count_if(low).alias("low_conflict"),
        F.count_if(high).alias("high_conflict"),
        F.count_if(o & (F.col(conflict) == "UNKNOWN")).alias("unknown_conflict"),
        F.count_if(o & (F.col(mode) == "LLM")).alias("model_required"),
        F.count_if(low_model).alias("after_model_filter"),
        F.count_if(admitted).alias("after_resource"),
        F.count_if(launch).alias("would_launch"),
        rate(low).alias("low_hit_rate"),
        rate(high).alias("high_hit_rate"),
        F.bool_and(F.when(o, F.col(proofs["conflict"]).isNotNull())).alias("conflict_complete"),
        F.bool_and(F.when(o, F.col(proofs["semantic"]).isNotNull())).alias("semantic_complete"),
        F.bool_and(F.when(low_model, F.col(proofs["resource"]).isNotNull())).alias("resource_complete"),
        F.bool_and(F.when(admitted, F.col(proofs["value"]).isNotNull())).alias("value_complete"),
        F.bool_and(F.when(low | high, F.col(outcome).isNotNull() & F.col(proofs["outcome"]).isNotNull())).alias("selectivity_complete"),
    )


@dataclass(frozen=True)
class ReuseThresholds:
    """Least shares of early, stable and hit operators, and least net value, for a go."""

    early: float = 0.05
    stable: float = 0.5
    hit: float = 0.1
    net_ns: int = 1


def validated_reuse_summary(
    df: DataFrame,
    kind: str,
    shadow: str,
    exact: str,
    shadow_digest: str,
    exact_digest: str,
    service: str,
    capture_cost: str,
    check_cost: str,
    *,
    ready: str,
    early: str,
    side_effects: Sequence[str],
    gates: Column,
    thresholds: ReuseThresholds = ReuseThresholds(),
) -> DataFrame:
    """Stable, unstable, opaque, hit and miss counts by kind (and in total, kind NULL), hideable and net service time, and a verdict.

    ``ready`` says whether an operator was known to be ready, ``early`` whether before its artifact was; ``side_effects`` are
    counts that must be 0 and ``gates`` a condition that must hold for every row. ``status`` and ``reason`` follow the first
    rule that fails: instrumentation, early share, stable share of the attempts, hit rate, net value.
    """
    tried = F.col(shadow).isNotNull()
    stable = tried & (F.col(shadow) == "STABLE")
    again = stable & F.col(exact).isNotNull()
    both = again & (F.col(exact) == "STABLE") & F.col(shadow_digest).isNotNull() & F.col(exact_digest).isNotNull()
    hit, miss = both & (F.col(shadow_digest) == F.col(exact_digest)), both & (F.col(shadow_digest) != F.col(exact_digest))
    unstable = (tried & (F.col(shadow) == "UNSTABLE")) | (again & (F.col(exact) == "UNSTABLE"))
    opaque = tried & ~stable & (F.col(shadow) != "UNSTABLE") | (stable & ~again) | (again & ~both & (F.col(exact) != "UNSTABLE"))
    t = _true
    unsafe = ~F.coalesce(gates, F.lit(False))
    for c in side_effects:
        unsafe = unsafe | (F.coalesce(F.col(c), F.lit(1)) > 0)
    rows = df.rollup(kind).agg(
        t(tried).alias("attempts"),
        t(stable).alias("stable"),
        t(unstable).alias("unstable"),
        t(opaque).alias("opaque"),
        t(hit).alias("hits"),
        t(miss).alias("misses"),
        t(F.col(ready)).alias("locally_ready"),
        t(F.col(ready) & F.col(early)).alias("ready_early"),
        t(unsafe).alias("unsafe_rows"),
        _sum_if(F.coalesce(hit, F.lit(False)), F.col(service)).alias("hideable_ns"),
        F.sum(F.col(capture_cost) + F.col(check_cost)).alias("cost_ns"),
    )
    rows = rows.withColumns({"hit_rate": ratio(F.col("hits"), F.col("hits") + F.col("misses")), "net_ns": F.col("hideable_ns") - F.col("cost_ns")})
    rules = [
        (F.col("unsafe_rows") > 0, "STOP_INSTRUMENTATION_FAILURE", "OFFLINE_OR_CAPTURE_CORRECTNESS_GATE_FAILED"),
        (F.col("ready_early") < thresholds.early * F.greatest(F.col("locally_ready"), F.lit(1)), "STOP_MEG_NO_FINER_GRAINED_WINDOW", "LOCAL_READINESS_NOT_MATERIALLY_EARLIER"),
        ((F.col("attempts") == 0) & F.lit(thresholds.stable > 0) | (F.col("stable") < thresholds.stable * F.col("attempts")), "STOP_READVIEW_UNSTABLE", "STABLE_READVIEW_FRACTION_BELOW_THRESHOLD"),
        (F.col("hit_rate").isNull() | (F.col("hit_rate") < thresholds.hit), "STOP_VALIDATED_CONTINUATION_LOW_STABILITY", "VALIDATION_HIT_FRACTION_BELOW_THRESHOLD"),
        (F.coalesce(F.col("net_ns"), F.lit(0)) < thresholds.net_ns, "STOP_VALIDATED_CONTINUATION_LOW_STABILITY", "NON_POSITIVE_SHADOW_UPPER_BOUND_VALUE"),
    ]
    status, reason = F.lit("GO_VALIDATED_SEMANTIC_CONTINUATION"), F.lit("ALL_VALIDATED_CONTINUATION_GATES_PASSED")
    for fails, verdict, why in reversed(rules):
        status, reason = F.when(fails, verdict).otherwise(status), F.when(fails, why).otherwise(reason)
    return rows.withColumns({"status": status, "reason": reason}).drop("unsafe_rows")


def hideable_service(df: DataFrame, keys: Sequence[str], dependency: str, prepared: str, probe_done: str, published: str, matches: str, service: str) -> DataFrame:
    """Service time that fits between a finished probe and the predecessor's publication, over legal early rows."""
    early = F.col(prepared) < F.col(published)
    probed = early & F.coalesce(F.col(probe_done) < F.col(published), F.lit(False))
    unknown, free = F.col(dependency) == "UNKNOWN", F.col(dependency) == "DISJOINT"
    hit = probed & unknown & F.col(matches)
    gain = F.when(probed & (free | hit), F.least(F.col(service), F.col(published) - F.col(probe_done))).otherwise(0)
    counts = df.groupBy(*keys).agg(
        _n().alias("pairs"),
        _true(early).alias("prepared_early"),
        _true(probed).alias("probe_early"),
        _true(free).alias("disjoint"),
        _true(unknown).alias("unknown"),
        _true(hit).alias("validation_hits"),
        _true(probed & unknown & ~F.col(matches)).alias("validation_misses"),
        _true(gain > 0).alias("hideable_count"),
        F.sum(F.greatest(gain, F.lit(0))).alias("hideable_ns"),
    )
    verdict = (
        F.when(F.col("probe_early") == 0, "STOP_NO_LEGAL_WINDOW")
        .when(F.col("disjoint") + F.col("validation_hits") == 0, "STOP_DEPENDENCY_BOUNDARY")
        .when(F.col("hideable_ns") <= 0, "STOP_NO_HIDEABLE_SERVICE")
        .otherwise("GO")
    )
    return counts.withColumn("decision", verdict)


def speculation_value(df: DataFrame, keys: Sequence[str], reuse: str, parity: str, exact: str, speculative: str, overhead: str, overlap_ns: int | None) -> DataFrame:
    """Avoided exact service minus speculative and validation work, and what follows from it.

    Without the parity of every row, a validation overhead of at least 0 of every row and ``overlap_ns``, the decision is
    DATA_INSUFFICIENT, ``correctness_gate`` NOT_MEASURED, ``missing_fields`` names what is absent, and what rests on it is
    NULL. Parity that fails anywhere is UNSAFE, and the net saving NULL.
    """
    gaps = {"overlap_exposed_ns": F.lit(overlap_ns is None), "state_parity": F.count_if(F.col(parity).isNull()) > 0, "validation_overhead_ns": F.count_if(~F.coalesce(F.col(overhead) >= 0, F.lit(False))) > 0}
    missing = F.concat_ws(",", *[F.when(gap, name) for name, gap in gaps.items()])
    rows = df.groupBy(*keys).agg(
        _n().alias("eligible_count"),
        _true(F.col(reuse)).alias("reuse_count"),
        F.sum(exact).alias("exact_ns"),
        F.sum(speculative).alias("speculative_ns"),
        F.sum(overhead).alias("validation_ns"),
        _sum_if(F.col(reuse), F.col(exact)).alias("avoided_ns"),
        F.coalesce(F.bool_and(parity), F.lit(False)).alias("_parity"),
        missing.alias("missing_fields"),
    )
    known = F.col("missing_fields") == ""
    net = F.col("avoided_ns") - F.col("speculative_ns") - F.col("validation_ns")
    whole = F.col("reuse_count") == F.col("eligible_count")
    verdict = (
        F.when(~known, "DATA_INSUFFICIENT")
        .when(~F.col("_parity"), "UNSAFE")
        .when((net > 0) & whole & F.lit(overlap_ns == 0), "POTENTIAL_BUT_NO_OVERLAP")
        .when(net > 0, "POTENTIAL_SUPPORTED")
        .otherwise("LOW_POTENTIAL")
    )
    gate = F.when(~known, "NOT_MEASURED").when(F.col("_parity"), "PASS").otherwise("FAIL")
    out = {"reuse_rate": F.when(known, ratio(F.col("avoided_ns"), F.col("exact_ns"))), "net_saved_ns": F.when(known & F.col("_parity"), net), "decision": verdict, "correctness_gate": gate}
    return rows.withColumns(out).withColumn("validation_ns", F.when(known, F.col("validation_ns"))).drop("_parity")


def event_counts(df: DataFrame, keys: Sequence[str], event: str, hit: str, miss: str) -> DataFrame:
    h, m = F.count_if(F.col(event) == hit), F.count_if(F.col(event) == miss)
    return df.groupBy(*keys).agg(_n().alias("event_count"), F.countDistinct(event).alias("event_types"), h.alias("hits"), m.alias("misses"), ratio(h, h + m).alias("hit_rate"))


def direct_evidence_counts(df: DataFrame, evidence_id: str, observation: str, payload: Sequence[str]) -> DataFrame:
    """Distinct evidence ids per observation; an id seen with two payloads is a conflict, not evidence."""
    digest = F.sha2(F.to_json(F.struct(*payload)), 256)
    ids = df.groupBy(evidence_id).agg(F.min(observation).alias(observation), (F.min(digest) != F.max(digest)).alias("_conflict"))
    return ids.groupBy(observation).agg(F.count_if(~F.col("_conflict")).alias("evidence_count"), F.count_if("_conflict").alias("conflicting_ids"))


def failed_run_rates(plan: DataFrame, statuses: DataFrame, run: str, method: str, status: str, failed: str = "failed") -> DataFrame:
    rows = plan.select(run, method).join(statuses.select(run, status), run, "left")
    bad = _true(F.col(status) == failed)
    return rows.groupBy(method).agg(_n().alias("planned"), bad.alias("failed_count"), ratio(bad, _n()).alias("failed_rate"))


def workload_complexity(df: DataFrame, history: str, turn_text: str) -> DataFrame:
    """Turns, characters and whitespace-separated tokens per history and in total (history NULL)."""
    words = F.size(F.filter(F.split(F.col(turn_text), r"\s+"), lambda w: w != ""))
    return df.rollup(history).agg(_n().alias("turns"), F.sum(F.length(turn_text)).alias("characters"), F.sum(words).alias("tokens"))


def telemetry_reduce(df: DataFrame, keys: Sequence[str], ts: str, counters: Sequence[str], *, gauges: Sequence[str] = (), hit_rate: tuple[str, str] | None = None, tie: Sequence[str] = (), hot: int | None = None) -> DataFrame:
    """Counter deltas from the first to the last scrape, how often each fell (a reset), and rates per second; summaries of gauges.

    A counter that was reset has no delta and no rate, and its status says so. ``hit_rate`` names the counters of hits and
    of lookups whose deltas give the ratio. A gauge holds from its scrape to the next: its mean and its share of time above
    zero are weighted by that (a key without duration: plain mean, last scrape), its 95th percentile is over the scrapes.
    A gauge that some scrape lacks is INCOMPLETE and has no summary.
    """
    lag = {f"_prev_{c}": c for c in counters}
    seen = ordered_scan(df, keys, [ts, *tie], lag=lag, lead={"_next": ts}, hot=hot).withColumn("_for", F.coalesce(F.col("_next") - F.col(ts), F.lit(0)))
    at = F.struct(ts, *tie)
    aggs = [_n().alias("sample_count"), ((F.max(ts) - F.min(ts)) / SECOND).alias("duration_s"), F.sum("_for").alias("_time")]
    for c in counters:
        aggs.append((F.max_by(c, at) - F.min_by(c, at)).alias(f"{c}_delta"))
        aggs.append(F.count_if(F.col(c) < F.col(f"_prev_{c}")).alias(f"{c}_resets"))
    for g in gauges:
        aggs += [F.count(g).alias(f"_{g}_n"), F.avg(g).alias(f"_{g}_avg"), F.sum(F.col(g) * F.col("_for")).alias(f"_{g}_area"), _sum_if(F.col(g) > 0, F.col("_for")).alias(f"_{g}_over"), F.max_by(g, at).alias(f"_{g}_last"), F.max(g).alias(f"{g}_max")]
    rows = seen.groupBy(*keys).agg(*aggs)
    fell = {c: F.col(f"{c}_resets") > 0 for c in counters}
    rows = rows.withColumns({f"{c}_status": F.when(fell[c], "RESET").otherwise("OK") for c in counters} | {f"{c}_delta": F.when(~fell[c], F.col(f"{c}_delta")) for c in counters})
    rows = rows.withColumns({f"{c}_per_s": ratio(F.col(f"{c}_delta"), F.col("duration_s")) for c in counters})
    if hit_rate is not None:
        rows = rows.withColumn("hit_rate", ratio(F.col(f"{hit_rate[0]}_delta"), F.col(f"{hit_rate[1]}_delta")))
    for g in gauges:
        whole, timed = F.col(f"_{g}_n") == F.col("sample_count"), F.col("_time") > 0
        mean = F.when(timed, F.col(f"_{g}_area") / F.col("_time")).otherwise(F.col(f"_{g}_avg"))
        above = F.when(timed, F.col(f"_{g}_over") / F.col("_time")).otherwise((F.col(f"_{g}_last") > 0).cast("double"))
        tails = exact_quantiles(df, keys, g, {f"{g}_p95": 0.95}, hot=hot)
        rows = rows.join(tails, list(keys), "left").withColumns({f"{g}_mean": F.when(whole, mean), f"{g}_above_zero": F.when(whole, above), f"{g}_max": F.when(whole, F.col(f"{g}_max")), f"{g}_p95": F.when(whole, F.col(f"{g}_p95")), f"{g}_status": F.when(whole, "OK").otherwise("INCOMPLETE")})
    return rows.drop("_time", *[f"_{g}_{x}" for g in gauges for x in ("n", "avg", "area", "over", "last")])


def sampler_coverage(df: DataFrame, keys: Sequence[str], ts: str, period_ns: int, available: Mapping[str, Column], *, hot: int | None = None) -> DataFrame:
    """Expected against actual samples in each key's window, gaps between samples and coverage per source."""
    distinct = df.groupBy(*keys, ts).agg(*[F.bool_or(c).alias(n) for n, c in available.items()])
    gaps = ordered_scan(distinct, keys, [ts], lag={"_prev": ts}, hot=hot).withColumn("_gap", F.col(ts) - F.col("_prev"))
    tails = exact_quantiles(gaps, keys, "_gap", {"gap_p50_ns": 0.5, "gap_p95_ns": 0.95}, extra=[F.max("_gap").alias("gap_max_ns")], hot=hot)
    n = _n()
    sums = distinct.groupBy(*keys).agg(
        n.alias("actual_samples"),
        (F.call_function("div", F.max(ts) - F.min(ts), F.lit(period_ns)) + 1).alias("expected_samples"),
        *[ratio(_true(F.col(c)), n).alias(f"{c}_coverage") for c in available],
    )
    share = F.least(F.lit(1.0), ratio(F.col("actual_samples"), F.col("expected_samples")))
    return sums.withColumn("coverage", share).join(tails, list(keys), "left")


def retrieval_parity_summary(df: DataFrame, keys: Sequence[str], question: str, metrics: Sequence[str]) -> DataFrame:
    aggs = [f(m).alias(f"{n}_{m}") for m in metrics for n, f in (("mean", F.avg), ("min", F.min))]
    return df.groupBy(*keys).agg(_n().alias("comparisons"), F.countDistinct(question).alias("instances"), *aggs)


def vector_bag_compare(a: DataFrame, b: DataFrame, keys: Sequence[str], digest: str) -> DataFrame:
    """Two multisets of vector hashes: totals, distinct, shared and one-sided hashes, and whether they are equal."""
    side = lambda df, n: df.select(*keys, digest).withColumn("_s", F.lit(n))
    bags = side(a, "a").unionByName(side(b, "b")).groupBy(*keys, digest).agg(F.count_if(F.col("_s") == "a").alias("_a"), F.count_if(F.col("_s") == "b").alias("_b"))
    ca, cb = F.col("_a"), F.col("_b")
    return bags.groupBy(*keys).agg(
        F.sum(ca).alias("total_a"),
        F.sum(cb).alias("total_b"),
        F.count_if(ca > 0).alias("distinct_a"),
        F.count_if(cb > 0).alias("distinct_b"),
        F.count_if((ca > 0) & (cb > 0)).alias("shared"),
        F.count_if((ca > 0) & (cb == 0)).alias("only_a"),
        F.count_if((ca == 0) & (cb > 0)).alias("only_b"),
        F.bool_and(ca == cb).alias("bag_equal"),
    )


def _multiplicities(groups: DataFrame, partition: Sequence[str], out: str) -> DataFrame:
    """Per partition how many groups have each multiplicity, as ``1x5 2x3``: its length is that of the distinct multiplicities."""
    counts = groups.groupBy(*partition, "_m").agg(_n().alias("_k"))
    shown = F.transform(F.array_sort(F.collect_list(F.struct("_m", "_k"))), lambda x: F.concat(x["_m"], F.lit("x"), x["_k"]))
    return counts.groupBy(*partition).agg(F.array_join(shown, " ").alias(out), F.sum("_k").alias(f"_{out}_groups"), F.sum(F.when(F.col("_m") > 1, F.col("_k")).otherwise(0)).alias(f"_{out}_many"), F.max("_m").alias(f"_{out}_max"), F.sum(F.col("_m") * F.col("_k")).alias(f"_{out}_rows"))


def candidate_partition_diagnosis(partitions: DataFrame, candidates: DataFrame, partition: Sequence[str], identity: str, fact: str) -> DataFrame:
    """EMPTY, UNIQUE or AMBIGUOUS per row of ``partitions``: how many of its candidates share one identity or one fact.

    ``identity_multiplicity`` and ``fact_multiplicity`` say how many groups have how many members; an empty partition has
    zeros and empty texts.
    """
    level = lambda c: candidates.groupBy(*partition, c).agg(_n().alias("_m"))
    ids = _multiplicities(level(identity), partition, "identity_multiplicity")
    facts = _multiplicities(level(fact), partition, "fact_multiplicity")
    rows = partitions.select(*partition).distinct().join(ids, list(partition), "left").join(facts, list(partition), "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    kind = F.when(number("_identity_multiplicity_rows") == 0, "EMPTY").when(number("_identity_multiplicity_many") > 0, "AMBIGUOUS").otherwise("UNIQUE")
    return rows.select(
        *partition,
        number("_identity_multiplicity_rows").alias("candidates"),
        number("_identity_multiplicity_groups").alias("identities"),
        number("_identity_multiplicity_many").alias("ambiguous_groups"),
        number("_identity_multiplicity_max").alias("max_multiplicity"),
        text("identity_multiplicity"),
        number("_fact_multiplicity_groups").alias("facts"),
        number("_fact_multiplicity_many").alias("duplicate_fact_groups"),
        text("fact_multiplicity"),
        kind.alias("classification"),
    )


def pooled_method_table(blocks: DataFrame, samples: DataFrame, method: str, means: Sequence[str], sums: Sequence[str], maxima: Sequence[str], sample: str, makespan: str, *, hot: int | None = None) -> DataFrame:
    """Macro means, sums and maxima over block rows with tails pooled over all samples of the method.

    Sums are exact decimals: nanoseconds of many blocks pass 64 bits.
    """
    table = blocks.groupBy(method).agg(
        _n().alias("blocks"),
        *[F.avg(c).alias(f"mean_{c}") for c in means],
        *[F.sum(F.col(c).cast("decimal(20,0)")).alias(f"sum_{c}") for c in sums],
        *[F.max(c).alias(f"max_{c}") for c in maxima],
    )
    tails = exact_quantiles(samples, [method], sample, {"p50": 0.5, "p95": 0.95, "p99": 0.99}, extra=[F.sum("_copies").alias("episodes")], hot=hot)
    return table.join(tails, method).withColumn("goodput_per_s", ratio(F.col("episodes") * float(SECOND), F.col(f"sum_{makespan}")))


def counter_deltas(df: DataFrame, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``after - before`` per counter, NULL when either was not observed."""
    return df.withColumns({n: F.col(after) - F.col(before) for n, (before, after) in pairs.items()})


def request_service_summary(requests: DataFrame, keys: Sequence[str], kinds: Sequence[str], kind: str, tokens: str, start: str, terminal: str) -> DataFrame:
    """Submitted requests by kind, their tokens, and service tails over the complete ones."""
    sums = requests.groupBy(*keys).agg(_n().alias("submitted"), *[F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds], F.sum(tokens).alias("token_total"))
    done = requests.withColumn("_d", F.col(terminal) - F.col(start))
    tails = exact_quantiles(done, keys, "_d", {"p50_ns": 0.5, "p95_ns": 0.95}, method=LINEAR, extra=[F.sum("_copies").alias("complete")])
    return sums.join(tails, list(keys), "left")


def qa_result_diagnostics(df: DataFrame, method: str, history: str, correct: str, reader_valid: str, judge_valid: str, quotes: str, context: str, gold_ranks: str) -> DataFrame:
    """Counts per method and per method and history, with quotes found in the context and the best gold rank."""
    found = F.forall(F.col(quotes), lambda q: F.contains(F.col(context), q))
    rows = df.select(
        method, history, F.col(correct).alias("_c"), F.col(reader_valid).alias("_r"), F.col(judge_valid).alias("_j"), found.alias("_q"), F.array_min(gold_ranks).alias("_g")
    )
    ok = F.col("_r") & F.col("_j")
    return rows.withColumn(history, F.explode(F.array(F.lit(None).cast("string"), F.col(history).cast("string")))).groupBy(method, history).agg(
        _n().alias("question_count"),
        _true(F.col("_c") & ok).alias("correct_count"),
        _true(~F.col("_r")).alias("reader_invalid"),
        _true(F.col("_r") & ~F.col("_j")).alias("judge_invalid"),
        ratio(_true(F.col("_c") & ok), _n()).alias("primary_accuracy"),
        ratio(_true(F.col("_c") & ok), _true(ok)).alias("valid_only_accuracy"),
        _true(F.col("_q")).alias("quotes_in_context"),
        F.min("_g").alias("best_gold_rank"),
    )


def retry_trajectory_summary(df: DataFrame, keys: Sequence[str], position: str, budget: str, response: str, budgets: Sequence[int], saturated: Column, *, hot: int | None = None) -> DataFrame:
    """Attempts are runs of ``len(budgets)`` records in order: expected budgets, prefixes growing, all saturated."""
    k = len(budgets)
    seen = ordered_scan(df, keys, [position], rank="_r", lead={"_next": response}, hot=hot).withColumns({"_try": F.floor((F.col("_r") - 1) / k), "_slot": (F.col("_r") - 1) % k})
    wanted = F.array(*[F.lit(b) for b in budgets])
    grows = F.when(F.col("_slot") < k - 1, F.coalesce(F.startswith(F.col("_next"), F.col(response)), F.lit(False)))
    attempts = seen.groupBy(*keys, "_try").agg(
        _n().alias("_size"),
        F.bool_and(F.col(budget) == F.get(wanted, F.col("_slot").cast("int"))).alias("_as_expected"),
        F.coalesce(F.bool_and(grows), F.lit(True)).alias("_grows"),
        F.bool_and(saturated).alias("_full"),
        multiset_digest(F.concat_ws("|", F.col("_slot").cast("string"), response)).alias("_sig"),
    )
    whole = F.col("_size") == k
    return attempts.groupBy(*keys).agg(
        F.sum("_size").alias("record_count"),
        F.count_if(whole).alias("attempts"),
        F.bool_and(whole & F.col("_as_expected")).alias("expected_sequence"),
        F.count_if(whole & F.col("_grows")).alias("prefix_of_retry_count"),
        F.bool_and("_full").alias("all_saturated"),
        F.countDistinct("_sig").alias("distinct_attempts"),
    )


def direct_violations(expected: DataFrame, published: DataFrame, keys: Sequence[str], seq: str, order: Sequence[str], flags: Mapping[str, Column], *, graph: DataFrame | None = None) -> DataFrame:
    """Lost, duplicate, unexpected and out-of-order publications plus flagged rows; totals and categories violated.

    Publication order is broken as soon as the rows, read by ``order`` (when they were published), are not exactly the
    expected sequence. ``graph`` may bring further counts per key, as :func:`graph_integrity_counts` makes them.
    """
    by = [*keys, seq]
    side = lambda df, n: df.select(*by).withColumn("_s", F.lit(n))
    seen = side(expected, "e").unionByName(side(published, "p")).groupBy(*by).agg(F.count_if(F.col("_s") == "e").alias("_e"), F.count_if(F.col("_s") == "p").alias("_p"))
    e, p = F.col("_e") > 0, F.col("_p")
    counts = seen.groupBy(*keys).agg(
        F.count_if(e & (p == 0)).alias("lost"), F.sum(F.when(e, F.greatest(p - 1, F.lit(0))).otherwise(p)).alias("duplicate")
    )
    steps = ordered_scan(published.select(*dict.fromkeys([*by, *order])), keys, [*order, seq], lag={"_before": seq})
    turned = steps.groupBy(*keys).agg(F.count_if(F.col("_before") > F.col(seq)).alias("_turned"))
    broken = F.col("lost") + F.col("duplicate") + F.coalesce("_turned", F.lit(0)) > 0
    counts = counts.join(turned, list(keys), "left").withColumn("order_violation", F.when(broken, 1).otherwise(0).cast("long")).drop("_turned")
    marked = expected.groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in flags.items()])
    names = ["lost", "duplicate", "order_violation", *flags, *([c for c in graph.columns if c not in keys] if graph is not None else [])]
    cols = [F.coalesce(F.col(n), F.lit(0)) for n in names]
    total, hit = cols[0], (cols[0] > 0).cast("int")
    for c in cols[1:]:
        total, hit = total + c, hit + (c > 0).cast("int")
    rows = counts.join(marked, list(keys), "left")
    rows = rows if graph is None else rows.join(graph, list(keys), "left")
    return rows.withColumns({"total": total, "violated_categories": hit})
