"""Concurrency, backlog, state-time, ordering and neighbour operators over timed rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.intervals import active_levels, interval_changes, interval_union, merge_intervals
from tidemark.operators.ordered import Running, largest_group, ordered_scan, sweep
from tidemark.operators.quantiles import LINEAR, NEAREST, exact_quantiles


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient as a double, NULL where the bottom is zero or missing."""
    return F.when(bottom != 0, top.cast("double") / bottom.cast("double"))


def concurrency_time(df: DataFrame, keys: Sequence[str], start: str, end: str, *, hot: int | None = None) -> DataFrame:
    """Time spent at each positive number of open intervals."""
    levels = active_levels(df, keys, start, end, hot=hot).filter("active > 0")
    return levels.groupBy(*keys, "active").agg(F.sum(F.col("next_ts") - F.col("ts")).alias("time_ns"))


def concurrency_sweep(df: DataFrame, keys: Sequence[str], start: str, end: str, *, hot: int | None = None) -> DataFrame:
    """Union, integral, mean, peak and overlap share of the open intervals per key."""
    t, a = F.col("time_ns"), F.col("active")
    union, integral = F.sum(t), F.sum(a * t)
    return concurrency_time(df, keys, start, end, hot=hot).groupBy(*keys).agg(
        integral.alias("inclusive_sum_ns"),
        union.alias("interval_union_ns"),
        ratio(integral, union).alias("active_mean"),
        F.max(a).alias("active_max"),
        ratio(F.sum(F.when(a > 1, t).otherwise(0)), union).alias("overlap_wall_fraction"),
    )


def width_profile(
    df: DataFrame, keys: Sequence[str], start: str, end: str, thresholds: Sequence[int], *, window: DataFrame | None = None, hot: int | None = None
) -> DataFrame:
    """Peak and mean width over an observation window and the time at each threshold or above.

    ``window`` gives ``keys, obs_start, obs_end``; without it each key is observed from its first start to its last end.
    """
    if window is None:
        window = df.groupBy(*keys).agg(F.min(start).alias("obs_start"), F.max(end).alias("obs_end"))
    spent = concurrency_time(df, keys, start, end, hot=hot)
    t, a = F.col("time_ns"), F.col("active")
    aggs = [F.max(a).alias("peak_width"), F.sum(a * t).alias("_area")]
    aggs += [F.sum(F.when(a >= k, t).otherwise(0)).alias(f"_ge{k}") for k in thresholds]
    span = F.col("obs_end") - F.col("obs_start")
    one = F.lit(0).alias("_one")
    per_key = spent.groupBy(*keys, one).agg(*aggs).join(window.withColumn("_one", F.lit(0)), [*keys, "_one"])
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("threshold"), F.col(f"_ge{k}").alias("duration_ns")) for k in thresholds]))
    return per_key.select(*keys, "peak_width", ratio(F.col("_area"), span).alias("mean_width"), span.alias("window_ns"), levels.alias("_t")).select(
        *keys, "peak_width", "mean_width", "_t.threshold", "_t.duration_ns", ratio(F.col("_t.duration_ns"), F.col("window_ns")).alias("time_fraction")
    )


def width_by_type(df: DataFrame, keys: Sequence[str], kind: str, start: str, end: str, thresholds: Sequence[int], *, hot: int | None = None) -> DataFrame:
    """Width over all rows (kind NULL) and per kind, from one pass of change rows per grouping."""
    both = F.explode(F.array(F.lit(None).cast("string"), F.col(kind)))
    doubled = df.withColumn(kind, both).withColumn("_k", F.coalesce(F.col(kind), F.lit("")))
    profile = concurrency_time(doubled, [*keys, "_k"], start, end, hot=hot)
    t, a = F.col("time_ns"), F.col("active")
    return profile.groupBy(*keys, "_k").agg(
        F.max(a).alias("peak_width"), *[F.sum(F.when(a >= k, t).otherwise(0)).alias(f"time_ge_{k}_ns") for k in thresholds]
    ).withColumn(kind, F.when(F.col("_k") != "", F.col("_k"))).drop("_k")


def gauge_time_weighted(df: DataFrame, keys: Sequence[str], ts: str, value: str, *, tie: Sequence[str] = (), hot: int | None = None) -> DataFrame:
    """Each reading holds until the next one; with no elapsed time the plain mean is used."""
    held = ordered_scan(df, keys, [ts, *tie], lead={"_until": ts}, hot=hot).withColumn("_dt", F.coalesce(F.col("_until") - F.col(ts), F.lit(0)))
    v, dt = F.col(value), F.col("_dt")
    totals = held.groupBy(*keys).agg(
        F.sum(dt).alias("_total"),
        F.sum(v * dt).alias("_area"),
        F.avg(v).alias("_plain"),
        F.max(v).alias("max_value"),
        F.sum(F.when(v > 0, dt).otherwise(0)).alias("_above"),
        F.max_by(v, F.struct(F.col(ts), *[F.col(c) for c in tie])).alias("_final"),
    )
    p95 = exact_quantiles(df, keys, value, {"p95": 0.95}, hot=hot)
    still = F.col("_total") <= 0
    return totals.join(p95, list(keys)).select(
        *keys,
        F.when(still, F.col("_plain")).otherwise(ratio(F.col("_area"), F.col("_total"))).alias("mean_value"),
        "p95",
        "max_value",
        F.when(still, (F.col("_final") > 0).cast("double")).otherwise(ratio(F.col("_above"), F.col("_total"))).alias("above_zero_fraction"),
    )


def time_weighted_quantile(levels: DataFrame, keys: Sequence[str], level: str, duration: str, quantiles: Mapping[str, float], *, hot: int | None = None) -> DataFrame:
    """Smallest level whose cumulative time, from the lowest level up, reaches the share ``q`` of all time."""
    spent = levels.groupBy(*keys, level).agg(F.sum(duration).alias("_t"))
    cum = ordered_scan(spent, keys, [level], running={"_c": Running("sum", F.col("_t"))}, total={"_all": Running("sum", F.col("_t"))}, hot=hot)
    picks = [F.min(F.when(F.col("_c") >= F.col("_all") * F.lit(float(q)), F.col(level))).alias(n) for n, q in quantiles.items()]
    return cum.groupBy(*keys).agg(*picks, F.max(level).alias("max_level"), F.sum("_t").alias("window_ns"))


def waiting_depth_levels(df: DataFrame, keys: Sequence[str], submitted: str, started: str, terminal: str, *, hot: int | None = None) -> DataFrame:
    """Submitted-but-not-started count over the window from first submission to last end, zero stretches included."""
    waits = interval_changes(df, keys, submitted, started)
    bounds = df.groupBy(*keys).agg(F.min(submitted).alias("_lo"), F.max(terminal).alias("_hi"))
    edges = bounds.select(*keys, F.explode(F.array("_lo", "_hi")).alias("ts"), F.lit(0).alias("step"))
    levels = sweep(waits.unionByName(edges), keys, "ts", {"depth": "step"}, hot=None if hot is None else 2 * hot + 2)
    return levels.filter(F.col("next_ts").isNotNull()).select(*keys, "depth", (F.col("next_ts") - F.col("ts")).alias("time_ns"))


def backlog_series(df: DataFrame, keys: Sequence[str], arrival: str, publish: str, *, hot: int | None = None) -> DataFrame:
    """Arrived-but-not-published count after each step; at one instant all arrivals are applied before publications.

    Rows: ``keys, ts, step (0 arrivals, 1 publications), backlog, until``. Area accrues on ``[ts, until)``.
    """
    steps = F.explode(
        F.array(
            F.struct(F.col(arrival).alias("ts"), F.lit(0).alias("step"), F.lit(1).alias("d")),
            F.struct(F.col(publish).alias("ts"), F.lit(1).alias("step"), F.lit(-1).alias("d")),
        )
    )
    moved = df.select(*keys, steps.alias("_s")).select(*keys, "_s.ts", "_s.step", "_s.d").groupBy(*keys, "ts", "step").agg(F.sum("d").alias("_d"))
    return ordered_scan(
        moved, keys, ["ts", "step"], lead={"until": "ts"}, running={"backlog": Running("sum", F.col("_d"))}, hot=None if hot is None else 2 * hot
    ).drop("_d")


def backlog_summary(df: DataFrame, keys: Sequence[str], arrival: str, publish: str, *, hot: int | None = None) -> DataFrame:
    series = backlog_series(df, keys, arrival, publish, hot=hot)
    when = F.struct("ts", "step")
    return series.groupBy(*keys).agg(
        F.sum(F.col("backlog") * (F.coalesce("until", "ts") - F.col("ts"))).alias("backlog_auc"),
        F.max("backlog").alias("maximum_backlog"),
        F.max_by("backlog", F.when(F.col("step") == 0, F.col("ts"))).alias("backlog_at_final_arrival"),
        F.max_by("backlog", when).alias("final_backlog"),
    )


def queue_area(df: DataFrame, keys: Sequence[str], ts: str, depth: str, *, tie: Sequence[str] = (), serial: bool = False, hot: int | None = None) -> DataFrame:
    """Integral of queue depth. A serial run has no queue: its peak is NULL and the status says why."""
    held = ordered_scan(df, keys, [ts, *tie], lead={"_until": ts}, hot=hot).withColumn("_dt", F.coalesce(F.col("_until") - F.col(ts), F.lit(0)))
    p95 = exact_quantiles(df, keys, depth, {"p95_backlog": 0.95}, hot=hot)
    area, total = F.col("queue_area"), F.col("observation_ns")
    sums = held.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_count"), F.sum(F.col(depth) * F.col("_dt")).alias("queue_area"), F.sum("_dt").alias("observation_ns"), F.max(depth).alias("_max")
    )
    return sums.join(p95, list(keys)).select(
        *keys,
        F.lit("NOT_APPLICABLE_SERIAL_BASELINE" if serial else "OBSERVED").alias("status"),
        "sample_count",
        "queue_area",
        "observation_ns",
        F.coalesce(ratio(area, total), F.lit(0.0)).alias("mean_backlog"),
        "p95_backlog",
        (F.lit(None).cast("long") if serial else F.col("_max")).alias("max_backlog"),
    )


def state_intervals(df: DataFrame, keys: Sequence[str], ts: str, *, tie: Sequence[str] = (), end: Column | None = None, hot: int | None = None) -> DataFrame:
    """State rows with ``dt``: how long each holds until the next row, or until ``end`` for the last."""
    held = ordered_scan(df, keys, [ts, *tie], lead={"until": ts}, hot=hot)
    until = F.coalesce(F.col("until"), end) if end is not None else F.col("until")
    return held.withColumn("until", until).withColumn("dt", F.coalesce(F.col("until") - F.col(ts), F.lit(0)))


def state_time_histogram(df: DataFrame, keys: Sequence[str], ts: str, field: str, *, tie: Sequence[str] = (), hot: int | None = None) -> DataFrame:
    held = state_intervals(df, keys, ts, tie=tie, hot=hot).filter("dt > 0")
    return held.groupBy(*keys, field).agg(F.sum("dt").alias("time_ns"))


def time_where(df: DataFrame, keys: Sequence[str], ts: str, predicates: Mapping[str, Column], maxima: Sequence[str] = (), *, tie: Sequence[str] = (), hot: int | None = None) -> DataFrame:
    """Time during which each predicate held, the observation window and the maxima of some counters."""
    held = state_intervals(df, keys, ts, tie=tie, hot=hot)
    return held.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("snapshot_count"),
        (F.max(ts) - F.min(ts)).alias("window_ns"),
        *[F.sum(F.when(p, F.col("dt")).otherwise(0)).alias(n) for n, p in predicates.items()],
        *[F.max(c).alias(f"max_{c}") for c in maxima],
    )


def phase_overlap_bound(phase_time: DataFrame, keys: Sequence[str], phase: str, time: str, window: str, *, idle: str, first: str, second: str) -> DataFrame:
    """Least possible window if two phases overlapped perfectly: idle time plus the longer of the two."""
    held = lambda name: F.sum(F.when(F.col(phase) == name, F.col(time)).otherwise(0))
    rows = phase_time.groupBy(*keys).agg(F.max(window).alias("window_ns"), held(idle).alias("idle_ns"), held(first).alias("first_ns"), held(second).alias("second_ns"))
    bound = F.col("idle_ns") + F.greatest("first_ns", "second_ns")
    return rows.withColumns(
        {
            "lower_bound_ns": bound,
            "speedup_upper_bound": ratio(F.col("window_ns"), bound),
            "verdict": F.when(F.col("second_ns") > F.col("first_ns"), "SECOND_PHASE_LONGER")
            .when(F.col("second_ns") > 0, "SECOND_PHASE_NOT_LONGER")
            .otherwise("SECOND_PHASE_NOT_OBSERVABLE"),
        }
    )


def request_lifecycle(events: DataFrame, request: str, event: str, ts: str, identity: Sequence[str], *, submitted: str, started: str, terminal: str) -> DataFrame:
    """One row per request from its three events, with a status that names duplicates, drift and bad order."""
    at = lambda e: F.min(F.when(F.col(event) == e, F.col(ts)))
    many = lambda e: F.count_if(F.col(event) == e) > 1
    rows = events.groupBy(request).agg(
        *[F.max(c).alias(c) for c in identity],
        *[(F.max(c) != F.min(c)).alias(f"_drift_{c}") for c in identity],
        at(submitted).alias("submitted_ns"),
        at(started).alias("start_ns"),
        at(terminal).alias("terminal_ns"),
        (many(submitted) | many(started) | many(terminal)).alias("_many"),
    )
    drift = F.greatest(*[F.coalesce(F.col(f"_drift_{c}"), F.lit(False)) for c in identity], F.lit(False))
    status = (
        F.when(F.col("_many"), "DUPLICATE_EVENT")
        .when(drift, "IDENTITY_DRIFT")
        .when(F.col("submitted_ns").isNull(), "NOT_SUBMITTED")
        .when(F.col("start_ns") < F.col("submitted_ns"), "START_BEFORE_SUBMIT")
        .when(F.col("terminal_ns") < F.col("start_ns"), "END_BEFORE_START")
        .when(F.col("start_ns").isNull() | F.col("terminal_ns").isNull(), "INCOMPLETE")
        .otherwise("COMPLETE")
    )
    return rows.select(request, *identity, "submitted_ns", "start_ns", "terminal_ns", status.alias("request_status"))


def waiting_under_capacity(df: DataFrame, keys: Sequence[str], submitted: str, started: str, terminal: str, capacity: int, *, hot: int | None = None) -> DataFrame:
    """Time with something waiting while fewer than ``capacity`` were in service."""
    waits = interval_changes(df, keys, submitted, started).withColumns({"_p": F.col("step"), "_a": F.lit(0)})
    runs = interval_changes(df, keys, started, terminal).withColumns({"_p": F.lit(0), "_a": F.col("step")})
    levels = sweep(waits.unionByName(runs), keys, "ts", {"pending": "_p", "active": "_a"}, hot=None if hot is None else 3 * hot)
    dt = F.coalesce(F.col("next_ts") - F.col("ts"), F.lit(0))
    idle = (F.col("pending") > 0) & (F.col("active") < capacity)
    return levels.groupBy(*keys).agg(F.sum(F.col("pending") * dt).alias("wait_sum_ns"), F.sum(F.when(idle, dt).otherwise(0)).alias("under_capacity_ns"))


def wait_summary(df: DataFrame, kind: str, wait: Column, *, hot: int | None = None) -> DataFrame:
    """Count, mean, interpolated p50 and p95 and maximum of a wait, overall (kind ALL) and by kind."""
    rows = df.select(F.explode(F.array(F.lit("ALL"), F.col(kind))).alias(kind), wait.alias("_w"))
    c = F.col("_copies")
    return exact_quantiles(
        rows,
        [kind],
        "_w",
        {"p50": 0.5, "p95": 0.95},
        method=LINEAR,
        extra=[F.sum(c).alias("n"), F.sum(F.col("_w") * c).alias("total"), F.max("_w").alias("max_wait")],
        hot=hot,
    ).withColumn("mean_wait", ratio(F.col("total"), F.col("n")))


def ordering_summary(df: DataFrame, keys: Sequence[str], source: str, observed: Sequence[str], *, hot: int | None = None) -> DataFrame:
    """Inversions, their density, Kendall tau and largest displacement of the observed order per key.

    ``source`` is the 0-based rank in source order. Inversions are counted bit by bit: two rows are out of order at the
    highest bit in which their source ranks differ, so one running count per (key, bit, prefix) finds them all, in
    n log n rows and without pairing.
    """
    hot = largest_group(df, keys) if hot is None else hot
    seen = ordered_scan(df, keys, list(observed), rank="_o", hot=hot).withColumn("_o", F.col("_o") - 1)
    bits = max(1, hot.bit_length())
    s = F.col(source).cast("long")
    level = F.explode(F.array(*[F.struct(F.lit(b).alias("b"), F.lit(1 << b).cast("long").alias("w")) for b in range(bits)]))
    tree = seen.select(*keys, "_o", s.alias("_s"), level.alias("_l")).select(
        *keys, "_o", F.col("_l.b").alias("_b"), F.floor(F.col("_s") / (F.col("_l.w") * 2)).alias("_prefix"), (F.floor(F.col("_s") / F.col("_l.w")) % 2).alias("_bit")
    )
    ones = ordered_scan(tree, [*keys, "_b", "_prefix"], ["_o"], running={"_before": Running("sum", F.col("_bit"))}, hot=hot)
    inverted = ones.filter("_bit = 0").groupBy(*keys).agg(F.sum("_before").alias("inversion_count"))
    moved = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(s - F.col("_o"))).alias("max_displacement"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    inv = F.coalesce("inversion_count", F.lit(0))
    return moved.join(inverted, list(keys), "left").select(
        *keys,
        "n",
        inv.cast("long").alias("inversion_count"),
        F.when(pairs > 0, inv / pairs).otherwise(0.0).alias("inversion_density"),
        F.when(pairs > 0, 1 - 2.0 * inv / pairs).otherwise(1.0).alias("kendall_tau"),
        "max_displacement",
    )


def hot_keys_recent(df: DataFrame, keys: Sequence[str], seq: str, item: str, window: int, threshold: int, *, hot: int | None = None) -> DataFrame:
    """Rows whose item occurred at least ``threshold`` times in the last ``window`` rows, itself included.

    That holds when the occurrence ``threshold - 1`` steps back is recent enough; it is fetched by rank.
    """
    ranked = ordered_scan(df.select(*keys, seq, item), [*keys, item], [seq], rank="_r", hot=hot)
    back = ranked.select(*keys, item, (F.col("_r") + threshold - 1).alias("_r"), F.col(seq).alias("_back"))
    return ranked.join(back, [*keys, item, "_r"]).filter(F.col("_back") > F.col(seq) - window).select(*keys, seq, item)


def previous_window(df: DataFrame, keys: Sequence[str], seq: str, time: str, k: int, *, hot: int | None = None) -> DataFrame:
    """For every row the ``k`` latest rows with a lower sequence and a time not after its own.

    Rows: ``keys, seq, prev_seq, prev_time, slot`` with slot 1 the oldest. A row precedes another in sequence at the
    highest bit in which the two differ, so within each (key, bit, prefix) the rows with bit 0 are numbered by time and
    a row with bit 1 fetches the last ``k`` by number. No pair beyond ``k`` per bit is formed.
    """
    hot = largest_group(df, keys) if hot is None else hot
    dense = ordered_scan(df.select(*keys, seq, time), keys, [seq], rank="_s", hot=hot).withColumn("_s", F.col("_s") - 1)
    level = F.explode(F.array(*[F.struct(F.lit(b).alias("b"), F.lit(1 << b).cast("long").alias("w")) for b in range(max(1, hot.bit_length()))]))
    node = [*keys, "_b", "_prefix"]
    tree = dense.withColumn("_l", level).select(
        *keys, seq, time, F.col("_l.b").alias("_b"), F.floor(F.col("_s") / (F.col("_l.w") * 2)).alias("_prefix"), (F.floor(F.col("_s") / F.col("_l.w")) % 2).alias("_bit"), (-F.col("_s")).alias("_back")
    )
    ranked = ordered_scan(tree, node, [time, "_bit", "_back"], running={"_zeros": Running("sum", 1 - F.col("_bit"))}, hot=hot)
    zeros = ranked.filter("_bit = 0").select(*node, F.col("_zeros").alias("_want"), F.col(seq).alias("prev_seq"), F.col(time).alias("prev_time"))
    asks = ranked.filter("_bit = 1").select(*node, seq, F.explode(F.array(*[F.col("_zeros") - i for i in range(k)])).alias("_want")).filter("_want > 0")
    found = asks.join(zeros, [*node, "_want"]).groupBy(*keys, seq).agg(
        F.collect_list(F.struct((-F.col("prev_time")).alias("t"), F.col("prev_seq").alias("s"))).alias("_all")
    )
    best = F.reverse(F.slice(F.array_sort("_all"), 1, k))
    return found.select(*keys, seq, F.posexplode(best).alias("_p", "_v")).select(
        *keys, seq, (F.col("_p") + 1).alias("slot"), F.col("_v.s").alias("prev_seq"), (-F.col("_v.t")).alias("prev_time")
    )


def first_divergence(left: DataFrame, right: DataFrame, keys: Sequence[str], stage: str, signature: str, order: Mapping[str, int]) -> DataFrame:
    """Earliest stage, in the registered order, whose signature differs; a stage seen on one side only also differs."""
    place = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    a = left.select(*keys, stage, F.col(signature).alias("_a"))
    b = right.select(*keys, stage, F.col(signature).alias("_b"))
    both = a.join(b, [*keys, stage], "full_outer").withColumn("_at", place[F.col(stage)])
    differs = ~F.col("_a").eqNullSafe(F.col("_b"))
    return both.groupBy(*keys).agg(
        F.min_by(stage, F.when(differs, F.col("_at"))).alias("first_stage"),
        F.count_if(differs).alias("differing_stages"),
        (F.bool_and(F.col("_a").isNotNull() & F.col("_b").isNotNull())).alias("comparable"),
    )


def cross_worker_overlap(df: DataFrame, keys: Sequence[str], worker: str, start: str, end: str, *, hot: int | None = None) -> DataFrame:
    """Whether windows of different workers overlap, and for how long: each worker counts once at any instant."""
    merged = merge_intervals(df, [*keys, worker], start, end, hot=hot)
    levels = active_levels(merged, keys, start, end, hot=hot)
    return levels.groupBy(*keys).agg(
        (F.max("active") > 1).alias("overlaps"), F.sum(F.when(F.col("active") > 1, F.col("next_ts") - F.col("ts")).otherwise(0)).alias("overlap_ns")
    )


def task_records(lifecycle: DataFrame, keys: Sequence[str], stages: Sequence[tuple[str, str, str, str]], requests: DataFrame | None = None) -> DataFrame:
    """Lifecycle rows to one row per stage with ready wait and service time.

    ``stages`` holds ``(operator, ready column, start column, end column)``. ``requests`` (``keys, operator, start_ns,
    terminal_ns, tokens``) adds the number of calls, their tokens and the union of their time.
    """
    rows = F.explode(
        F.array(*[F.struct(F.lit(o).alias("operator"), F.col(r).alias("ready_at"), F.col(s).alias("started_at"), F.col(e).alias("ended_at")) for o, r, s, e in stages])
    )
    tasks = lifecycle.select(*keys, rows.alias("_t")).select(*keys, "_t.*").withColumns(
        {"ready_wait_ns": F.col("started_at") - F.col("ready_at"), "service_ns": F.col("ended_at") - F.col("started_at")}
    )
    if requests is None:
        return tasks
    by = [*keys, "operator"]
    busy = interval_union(requests, by, "start_ns", "terminal_ns", "request_ns")
    counts = requests.groupBy(*by).agg(F.count(F.lit(1)).alias("request_count"), F.sum("tokens").alias("request_tokens"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("request_ns", "request_count", "request_tokens")}
    return tasks.join(counts, by, "left").join(busy, by, "left").withColumns(zero)
