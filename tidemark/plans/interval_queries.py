"""Queries over intervals and time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.digests import multiset_digest
from tidemark.functions.measures import round_double
from tidemark.operators import intervals as iv
from tidemark.operators import timeseries as ts
from tidemark.operators.ordered import largest_group
from tidemark.plans.inputs import EV, LINES, ROOTS, SAMPLES, lifecycle, line_spans, root_spans, samples, sequenced, table
from tidemark.plans.registry import query


def sweep_sql(name: str, src: str, keys: str, start: str, end: str) -> str:
    return f"""{name}_d AS (SELECT {keys}, t, sum(d) AS d FROM (
  SELECT {keys}, {start} AS t, 1 AS d FROM {src} WHERE {end} > {start} UNION ALL SELECT {keys}, {end}, -1 FROM {src} WHERE {end} > {start}) GROUP BY ALL),
{name} AS (SELECT {keys}, t AS ts, lead(t) OVER w AS next_ts, CAST(sum(d) OVER w AS BIGINT) AS active FROM {name}_d WINDOW w AS (PARTITION BY {keys} ORDER BY t))"""


def islands_sql(name: str, src: str, keys: str, start: str, end: str) -> str:
    return f"""{name}_f AS (SELECT {keys}, {start} AS s, {end} AS e, max({end}) OVER (PARTITION BY {keys} ORDER BY {start}, {end} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
  FROM {src} WHERE {end} > {start}),
{name}_g AS (SELECT *, sum(CASE WHEN seen IS NULL OR s > seen THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM {name}_f),
{name} AS (SELECT {keys}, g, min(s) AS s, max(e) AS e FROM {name}_g GROUP BY ALL)"""


def _hot(df):
    return largest_group(df, ["stream"])


STREAM_ISLANDS = islands_sql("isl", "ev", "stream", "arrival_ns", "publish_ns")
STREAM_SWEEP = sweep_sql("sw", "ev", "stream", "arrival_ns", "publish_ns")


@query("interval_union", f"WITH {EV}, {STREAM_ISLANDS} SELECT stream, CAST(sum(e-s) AS BIGINT) AS union_ns FROM isl GROUP BY 1")
def _(spark, sf):
    return iv.interval_union(lifecycle(spark, sf), ["stream"], "arrival_ns", "publish_ns", "union_ns")


@query("merge_intervals", f"WITH {EV}, {STREAM_ISLANDS} SELECT stream, s AS start_ns, e AS end_ns FROM isl")
def _(spark, sf):
    return iv.merge_intervals(lifecycle(spark, sf), ["stream"], "arrival_ns", "publish_ns").select(
        "stream", F.col("arrival_ns").alias("start_ns"), F.col("publish_ns").alias("end_ns")
    )


@query(
    "exclusive_duration",
    f"""WITH {LINES}, {ROOTS}, cl AS (SELECT l.trace, greatest(l.start_ns, r.start_ns) AS a, least(l.end_ns, r.end_ns) AS b FROM lines l JOIN roots r USING (trace)),
 {islands_sql("isl", "cl", "trace", "a", "b")}, cov AS (SELECT trace, sum(e-s) AS c FROM isl GROUP BY 1)
 SELECT trace, 'root' AS span_id, CAST(end_ns - start_ns - coalesce(c,0) AS BIGINT) AS exclusive FROM roots LEFT JOIN cov USING (trace)
 UNION ALL SELECT trace, span_id, end_ns - start_ns FROM lines""",
)
def _(spark, sf):
    roots = root_spans(spark, sf).withColumns({"span_id": F.lit("root"), "parent_id": F.lit(None).cast("string")})
    lines = line_spans(spark, sf).withColumn("parent_id", F.lit("root"))
    cols = ["trace", "span_id", "parent_id", "start_ns", "end_ns"]
    spans = roots.select(cols).unionByName(lines.select(cols))
    return iv.exclusive_duration(spans, ["trace"], "span_id", "parent_id", "start_ns", "end_ns")


@query(
    "concurrency_sweep",
    f"""WITH {EV}, {STREAM_SWEEP} SELECT stream, CAST(sum(active*(next_ts-ts)) AS BIGINT) AS inclusive_sum_ns, CAST(sum(next_ts-ts) AS BIGINT) AS interval_union_ns,
 round(CAST(sum(active*(next_ts-ts)) AS DOUBLE)/sum(next_ts-ts),6) AS active_mean, max(active) AS active_max,
 round(CAST(coalesce(sum(next_ts-ts) FILTER (active>1),0) AS DOUBLE)/sum(next_ts-ts),6) AS overlap_wall_fraction FROM sw WHERE active > 0 GROUP BY 1""",
)
def _(spark, sf):
    out = ts.concurrency_sweep(lifecycle(spark, sf), ["stream"], "arrival_ns", "publish_ns")
    return out.withColumns({c: round_double(F.col(c), 6) for c in ("active_mean", "overlap_wall_fraction")})


WIDTHS = (1, 2, 4, 8, 16)


@query(
    "width_profile",
    f"""WITH {EV}, {sweep_sql("sw", "ev", "kind", "arrival_ns", "publish_ns")}, ob AS (SELECT kind, max(publish_ns)-min(arrival_ns) AS win FROM ev GROUP BY 1)
 SELECT kind, (SELECT max(active) FROM sw s2 WHERE s2.kind = sw.kind) AS peak_width, threshold,
 CAST(sum(CASE WHEN active >= threshold THEN next_ts-ts ELSE 0 END) AS BIGINT) AS duration_ns,
 round(CAST(sum(active*(next_ts-ts)) AS DOUBLE)/max(win),6) AS mean_width,
 round(CAST(sum(CASE WHEN active >= threshold THEN next_ts-ts ELSE 0 END) AS DOUBLE)/max(win),6) AS time_fraction
 FROM sw JOIN ob USING (kind), (SELECT unnest([1,2,4,8,16]) AS threshold) WHERE active > 0 GROUP BY kind, threshold""",
)
def _(spark, sf):
    out = ts.width_profile(lifecycle(spark, sf), ["kind"], "arrival_ns", "publish_ns", WIDTHS)
    return out.withColumns({c: round_double(F.col(c), 6) for c in ("mean_width", "time_fraction")})


@query(
    "width_by_type",
    f"""WITH {EV}, e2 AS (SELECT *, kind AS k FROM ev UNION ALL SELECT *, '' FROM ev), {sweep_sql("sw", "e2", "k", "arrival_ns", "start_ns")}
 SELECT nullif(k,'') AS kind, max(active) AS peak_width, """
    + ", ".join(f"CAST(sum(CASE WHEN active>={k} THEN next_ts-ts ELSE 0 END) AS BIGINT) AS time_ge_{k}_ns" for k in (2, 4, 8))
    + " FROM sw WHERE active > 0 GROUP BY 1",
)
def _(spark, sf):
    return ts.width_by_type(lifecycle(spark, sf), [], "kind", "arrival_ns", "start_ns", (2, 4, 8))


HELD = f"""{EV}, {SAMPLES}, held AS (SELECT *, coalesce(lead(ts) OVER (PARTITION BY kind ORDER BY ts, event_id) - ts, 0) AS dt FROM smp)"""


@query(
    "gauge_time_weighted",
    f"""WITH {HELD} SELECT kind, round(CAST(sum(depth*dt) AS DOUBLE)/sum(dt),6) AS mean_value, quantile_disc(depth,0.95) AS p95, max(depth) AS max_value,
 round(CAST(sum(CASE WHEN depth>0 THEN dt ELSE 0 END) AS DOUBLE)/sum(dt),6) AS above_zero_fraction FROM held GROUP BY 1""",
)
def _(spark, sf):
    out = ts.gauge_time_weighted(samples(spark, sf), ["kind"], "ts", "depth", tie=["event_id"])
    return out.withColumns({c: round_double(F.col(c), 6) for c in ("mean_value", "above_zero_fraction")})


@query(
    "time_weighted_quantile",
    f"""WITH {EV}, mv AS (SELECT kind, arrival_ns AS t, 1 AS d FROM ev WHERE start_ns > arrival_ns UNION ALL SELECT kind, start_ns, -1 FROM ev WHERE start_ns > arrival_ns
   UNION ALL SELECT kind, min(arrival_ns), 0 FROM ev GROUP BY 1 UNION ALL SELECT kind, max(publish_ns), 0 FROM ev GROUP BY 1),
 n AS (SELECT kind, t, sum(d) AS d FROM mv GROUP BY ALL), lv AS (SELECT kind, sum(d) OVER w AS depth, lead(t) OVER w - t AS dt FROM n WINDOW w AS (PARTITION BY kind ORDER BY t)),
 sp AS (SELECT kind, depth, sum(dt) AS t FROM lv WHERE dt IS NOT NULL GROUP BY ALL),
 cu AS (SELECT kind, depth, t, sum(t) OVER (PARTITION BY kind ORDER BY depth) AS c, sum(t) OVER (PARTITION BY kind) AS al FROM sp)
 SELECT kind, CAST(min(depth) FILTER (c >= al*CAST(0.5 AS DOUBLE)) AS BIGINT) AS p50, CAST(min(depth) FILTER (c >= al*CAST(0.95 AS DOUBLE)) AS BIGINT) AS p95, CAST(max(depth) AS BIGINT) AS max_level, CAST(sum(t) AS BIGINT) AS window_ns FROM cu GROUP BY 1""",
)
def _(spark, sf):
    levels = ts.waiting_depth_levels(lifecycle(spark, sf), ["kind"], "arrival_ns", "start_ns", "publish_ns")
    return ts.time_weighted_quantile(levels, ["kind"], "depth", "time_ns", {"p50": 0.5, "p95": 0.95})


BACKLOG = """mv AS (SELECT stream, arrival_ns AS t, 0 AS st, 1 AS d FROM ev UNION ALL SELECT stream, publish_ns, 1, -1 FROM ev),
 nt AS (SELECT stream, t, st, sum(d) AS d FROM mv GROUP BY ALL),
 bl AS (SELECT stream, t, st, CAST(sum(d) OVER w AS BIGINT) AS backlog, lead(t) OVER w AS until FROM nt WINDOW w AS (PARTITION BY stream ORDER BY t, st))"""


@query("backlog_series", f"WITH {EV}, {BACKLOG} SELECT stream, t AS ts, st AS step, backlog, until FROM bl")
def _(spark, sf):
    return ts.backlog_series(lifecycle(spark, sf), ["stream"], "arrival_ns", "publish_ns")


@query(
    "backlog_summary",
    f"""WITH {EV}, {BACKLOG} SELECT stream, CAST(sum(backlog*(coalesce(until,t)-t)) AS BIGINT) AS backlog_auc, max(backlog) AS maximum_backlog,
 arg_max(backlog, t) FILTER (st=0) AS backlog_at_final_arrival, arg_max(backlog, t*2+st) AS final_backlog FROM bl GROUP BY 1""",
)
def _(spark, sf):
    return ts.backlog_summary(lifecycle(spark, sf), ["stream"], "arrival_ns", "publish_ns")


@query(
    "queue_area",
    f"""WITH {HELD} SELECT kind, 'OBSERVED' AS status, count(*) AS sample_count, CAST(sum(depth*dt) AS BIGINT) AS queue_area, CAST(sum(dt) AS BIGINT) AS observation_ns,
 round(CAST(sum(depth*dt) AS DOUBLE)/sum(dt),6) AS mean_backlog, quantile_disc(depth,0.95) AS p95_backlog, max(depth) AS max_backlog FROM held GROUP BY 1""",
)
def _(spark, sf):
    out = ts.queue_area(samples(spark, sf), ["kind"], "ts", "depth", tie=["event_id"])
    return out.withColumn("mean_backlog", round_double(F.col("mean_backlog"), 6))


@query("state_time_histogram", f"WITH {HELD} SELECT kind, depth, CAST(sum(dt) AS BIGINT) AS time_ns FROM held WHERE dt > 0 GROUP BY ALL")
def _(spark, sf):
    return ts.state_time_histogram(samples(spark, sf), ["kind"], "ts", "depth", tie=["event_id"])


SCHED = """sc AS (SELECT stream, event_id, arrival_ns AS ts, kind AS phase, CASE WHEN cents % 2 = 0 THEN 'PREDECESSOR' ELSE 'NONE' END AS wait_reason, cents % 5 AS ready, cents % 3 AS active, cents % 4 AS beyond,
  coalesce(lead(arrival_ns) OVER (PARTITION BY stream ORDER BY arrival_ns, event_id) - arrival_ns, 0) AS dt FROM ev)"""


def _scheduler(spark, sf):
    c = F.col("cents")
    return lifecycle(spark, sf).select(
        "stream",
        "event_id",
        F.col("arrival_ns").alias("ts"),
        F.col("kind").alias("phase"),
        F.when(c % 2 == 0, "PREDECESSOR").otherwise("NONE").alias("wait_reason"),
        (c % 5).alias("ready"),
        (c % 3).alias("active"),
        (c % 4).alias("beyond"),
        (c % 7).alias("waiting"),
    )


@query(
    "scheduler_state_summary",
    f"""WITH {EV}, {SCHED} SELECT stream, count(*) AS snapshot_count, max(ts)-min(ts) AS window_ns, CAST(sum(CASE WHEN ready>0 THEN dt ELSE 0 END) AS BIGINT) AS ready_ns,
 CAST(sum(CASE WHEN ready>0 AND active<2 THEN dt ELSE 0 END) AS BIGINT) AS ready_and_free_ns, CAST(sum(CASE WHEN ready=0 AND active<2 AND beyond>0 THEN dt ELSE 0 END) AS BIGINT) AS window_limited_ns,
 CAST(sum(CASE WHEN beyond>0 THEN dt ELSE 0 END) AS BIGINT) AS beyond_ns, CAST(sum(CASE WHEN phase='click' THEN dt ELSE 0 END) AS BIGINT) AS click_phase_ns,
 CAST(sum(CASE WHEN wait_reason='PREDECESSOR' THEN dt ELSE 0 END) AS BIGINT) AS predecessor_wait_ns, max(ready) AS max_ready, max(active) AS max_active, max(beyond) AS max_beyond FROM sc GROUP BY 1""",
)
def _(spark, sf):
    ready, active, beyond = F.col("ready"), F.col("active"), F.col("beyond")
    return ts.time_where(
        _scheduler(spark, sf),
        ["stream"],
        "ts",
        {
            "ready_ns": ready > 0,
            "ready_and_free_ns": (ready > 0) & (active < 2),
            "window_limited_ns": (ready == 0) & (active < 2) & (beyond > 0),
            "beyond_ns": beyond > 0,
            "click_phase_ns": F.col("phase") == "click",
            "predecessor_wait_ns": F.col("wait_reason") == "PREDECESSOR",
        },
        ["ready", "active", "beyond"],
        tie=["event_id"],
    )


@query(
    "admission_state_summary",
    f"""WITH {EV}, sc AS (SELECT kind, event_id, arrival_ns AS ts, cents % 3 AS active, cents % 7 AS waiting,
  coalesce(lead(arrival_ns) OVER (PARTITION BY kind ORDER BY arrival_ns, event_id) - arrival_ns, 0) AS dt FROM ev)
 SELECT kind, count(*) AS snapshot_count, max(ts)-min(ts) AS window_ns, CAST(sum(CASE WHEN active<2 AND waiting>0 THEN dt ELSE 0 END) AS BIGINT) AS under_capacity_with_waiter_ns,
 CAST(sum(CASE WHEN active>0 AND active<2 AND waiting=0 THEN dt ELSE 0 END) AS BIGINT) AS under_capacity_without_waiter_ns, max(active) AS max_active, max(waiting) AS max_waiting, count(*) FILTER (active > 2) AS over_limit_rows FROM sc GROUP BY 1""",
)
def _(spark, sf):
    limit, rows = 2, _scheduler(spark, sf).withColumnRenamed("phase", "kind")
    active, waiting = F.col("active"), F.col("waiting")
    spent = ts.time_where(
        rows,
        ["kind"],
        "ts",
        {
            "under_capacity_with_waiter_ns": (active < limit) & (waiting > 0),
            "under_capacity_without_waiter_ns": (active > 0) & (active < limit) & (waiting == 0),
        },
        ["active", "waiting"],
        tie=["event_id"],
    )
    return spent.join(rows.groupBy("kind").agg(F.count_if(active > limit).alias("over_limit_rows")), "kind")


PHASES = f"""{EV}, ob AS (SELECT stream, max(publish_ns) AS fin, max(publish_ns)-min(arrival_ns) AS win FROM ev GROUP BY 1),
 ph AS (SELECT stream, kind, coalesce(lead(arrival_ns) OVER (PARTITION BY stream ORDER BY arrival_ns, event_id), fin) - arrival_ns AS dt, win FROM ev JOIN ob USING (stream))"""


def _phase_time(spark, sf):
    rows = lifecycle(spark, sf)
    seen = rows.groupBy("stream").agg(F.max("publish_ns").alias("fin"), (F.max("publish_ns") - F.min("arrival_ns")).alias("win"))
    held = ts.state_intervals(rows.select("stream", "kind", "arrival_ns", "event_id"), ["stream"], "arrival_ns", tie=["event_id"])
    held = held.join(seen, "stream").withColumn("dt", F.coalesce("until", "fin") - F.col("arrival_ns"))
    return held.groupBy("stream", "kind").agg(F.sum("dt").alias("time_ns"), F.max("win").alias("window_ns"))


@query("phase_intervals", f"WITH {PHASES} SELECT stream, kind, CAST(sum(dt) AS BIGINT) AS time_ns, max(win) AS window_ns FROM ph GROUP BY ALL")
def _(spark, sf):
    return _phase_time(spark, sf)


@query(
    "phase_overlap_bound",
    f"""WITH {PHASES}, pt AS (SELECT stream, max(win) AS window_ns, CAST(coalesce(sum(dt) FILTER (kind='error'),0) AS BIGINT) AS idle_ns, CAST(coalesce(sum(dt) FILTER (kind='click'),0) AS BIGINT) AS first_ns,
  CAST(coalesce(sum(dt) FILTER (kind='view'),0) AS BIGINT) AS second_ns FROM ph GROUP BY 1)
 SELECT *, idle_ns + greatest(first_ns, second_ns) AS lower_bound_ns, round(CASE WHEN idle_ns + greatest(first_ns, second_ns) > 0 THEN CAST(window_ns AS DOUBLE)/(idle_ns + greatest(first_ns, second_ns)) END,6) AS speedup_upper_bound,
 CASE WHEN second_ns > first_ns THEN 'SECOND_PHASE_LONGER' WHEN second_ns > 0 THEN 'SECOND_PHASE_NOT_LONGER' ELSE 'SECOND_PHASE_NOT_OBSERVABLE' END AS verdict FROM pt""",
)
def _(spark, sf):
    out = ts.phase_overlap_bound(_phase_time(spark, sf), ["stream"], "kind", "time_ns", "window_ns", idle="error", first="click", second="view")
    return out.withColumn("speedup_upper_bound", round_double(F.col("speedup_upper_bound"), 6))


def request_events(spark, sf):
    """Three events per request; every ninth request never ends, so incomplete rows exist."""
    steps = F.explode(
        F.array(
            F.struct(F.lit("submitted").alias("event_type"), F.col("arrival_ns").alias("timestamp_ns")),
            F.struct(F.lit("start").alias("event_type"), F.col("start_ns").alias("timestamp_ns")),
            F.struct(F.lit("terminal").alias("event_type"), F.when(F.col("event_id") % 9 != 0, F.col("publish_ns")).alias("timestamp_ns")),
        )
    )
    rows = lifecycle(spark, sf).select(F.col("event_id").alias("request_id"), F.col("kind").alias("request_kind"), "stream", "cents", steps.alias("_e"))
    return rows.select("request_id", "request_kind", "stream", "cents", "_e.*").filter(F.col("timestamp_ns").isNotNull())


def requests(spark, sf):
    return ts.request_lifecycle(
        request_events(spark, sf), "request_id", "event_type", "timestamp_ns", ["request_kind", "stream", "cents"], submitted="submitted", started="start", terminal="terminal"
    )


REQ = f"""{EV}, req AS (SELECT event_id AS request_id, kind AS request_kind, stream, cents, arrival_ns AS submitted_ns, start_ns, CASE WHEN event_id % 9 <> 0 THEN publish_ns END AS terminal_ns,
 CASE WHEN event_id % 9 <> 0 THEN 'COMPLETE' ELSE 'INCOMPLETE' END AS request_status FROM ev)"""


@query("request_lifecycle", f"WITH {REQ} SELECT * FROM req")
def _(spark, sf):
    return requests(spark, sf)


@query(
    "waiting_under_capacity",
    f"""WITH {REQ}, cp AS (SELECT * FROM req WHERE terminal_ns IS NOT NULL),
 mv AS (SELECT request_kind, submitted_ns AS t, 1 AS p, 0 AS a FROM cp WHERE start_ns>submitted_ns UNION ALL SELECT request_kind, start_ns, -1, 0 FROM cp WHERE start_ns>submitted_ns
  UNION ALL SELECT request_kind, start_ns, 0, 1 FROM cp WHERE terminal_ns>start_ns UNION ALL SELECT request_kind, terminal_ns, 0, -1 FROM cp WHERE terminal_ns>start_ns),
 n AS (SELECT request_kind, t, sum(p) AS p, sum(a) AS a FROM mv GROUP BY ALL),
 lv AS (SELECT request_kind, sum(p) OVER w AS pending, sum(a) OVER w AS active, coalesce(lead(t) OVER w - t, 0) AS dt FROM n WINDOW w AS (PARTITION BY request_kind ORDER BY t))
 SELECT request_kind, CAST(sum(pending*dt) AS BIGINT) AS wait_sum_ns, CAST(sum(CASE WHEN pending>0 AND active<3 THEN dt ELSE 0 END) AS BIGINT) AS under_capacity_ns FROM lv GROUP BY 1""",
)
def _(spark, sf):
    done = requests(spark, sf).filter("request_status = 'COMPLETE'")
    return ts.waiting_under_capacity(done, ["request_kind"], "submitted_ns", "start_ns", "terminal_ns", 3)


def _wait_sql(src: str, kind: str, wait: str) -> str:
    return f"""SELECT kind, count(*) AS n, CAST(sum(w) AS BIGINT) AS total, max(w) AS max_wait, round(CAST(sum(w) AS DOUBLE)/count(*),3) AS mean_wait,
 round(quantile_cont(w,0.5),3) AS p50, round(quantile_cont(w,0.95),3) AS p95 FROM (SELECT {kind} AS kind, {wait} AS w FROM {src} UNION ALL SELECT 'ALL', {wait} FROM {src}) GROUP BY 1"""


def _wait_round(df):
    return df.withColumns({c: round_double(F.col(c), 3) for c in ("mean_wait", "p50", "p95")})


@query("wait_summary", f"WITH {EV} " + _wait_sql("ev", "kind", "(start_ns-arrival_ns)//1000000"))
def _(spark, sf):
    return _wait_round(ts.wait_summary(lifecycle(spark, sf), "kind", F.floor((F.col("start_ns") - F.col("arrival_ns")) / 1_000_000)))


TASKS = f"""{EV}, tk AS (SELECT event_id, 'COMPILE' AS operator, arrival_ns AS ready_at, arrival_ns + cents*100000000 AS started_at, start_ns AS ended_at, cents FROM ev
 UNION ALL SELECT event_id, 'BIND', start_ns, start_ns + cents*50000000, publish_ns, cents FROM ev)"""


def tasks(spark, sf):
    c = F.col("cents")
    rows = lifecycle(spark, sf).withColumns({"compile_start": F.col("arrival_ns") + c * 100_000_000, "bind_start": F.col("start_ns") + c * 50_000_000})
    calls = rows.select(
        "event_id", F.lit("BIND").alias("operator"), F.col("bind_start").alias("start_ns"), F.col("publish_ns").alias("terminal_ns"), c.alias("tokens")
    )
    stages = [("COMPILE", "arrival_ns", "compile_start", "start_ns"), ("BIND", "start_ns", "bind_start", "publish_ns")]
    return ts.task_records(rows, ["event_id"], stages, calls)


@query(
    "task_records",
    f"""WITH {TASKS} SELECT event_id, operator, ready_at, started_at, ended_at, started_at-ready_at AS ready_wait_ns, ended_at-started_at AS service_ns,
 CAST(CASE WHEN operator='BIND' THEN 1 ELSE 0 END AS BIGINT) AS request_count, CASE WHEN operator='BIND' THEN cents ELSE 0 END AS request_tokens, CASE WHEN operator='BIND' THEN ended_at-started_at ELSE 0 END AS request_ns FROM tk""",
)
def _(spark, sf):
    return tasks(spark, sf)


@query("task_wait_summary", f"WITH {TASKS} " + _wait_sql("tk", "operator", "(started_at-ready_at)//1000000"))
def _(spark, sf):
    rows = tasks(spark, sf).withColumnRenamed("operator", "kind")
    return _wait_round(ts.wait_summary(rows, "kind", F.floor(F.col("ready_wait_ns") / 1_000_000)))


@query(
    "episode_latencies",
    f"""WITH {EV} SELECT event_id, start_ns-arrival_ns AS submit_to_start_ns, publish_ns-start_ns AS service_ns, publish_ns-arrival_ns AS submit_to_durable_ns,
 start_ns+cents*250000000-arrival_ns AS submit_to_return_ns, publish_ns-(start_ns+cents*250000000) AS return_to_durable_ns, greatest(0, (start_ns+cents*250000000)-publish_ns) AS stale_window_ns FROM ev""",
)
def _(spark, sf):
    back = F.col("start_ns") + F.col("cents") * 250_000_000
    a, s, p = F.col("arrival_ns"), F.col("start_ns"), F.col("publish_ns")
    return lifecycle(spark, sf).select(
        "event_id",
        (s - a).alias("submit_to_start_ns"),
        (p - s).alias("service_ns"),
        (p - a).alias("submit_to_durable_ns"),
        (back - a).alias("submit_to_return_ns"),
        (p - back).alias("return_to_durable_ns"),
        F.greatest(F.lit(0), back - p).alias("stale_window_ns"),
    )


@query(
    "ordering_summary",
    f"""WITH {EV}, o AS (SELECT stream, seq, row_number() OVER (PARTITION BY stream ORDER BY publish_ns, event_id) - 1 AS ob FROM ev),
 n AS (SELECT stream, count(*) AS n, max(abs(seq-ob)) AS max_displacement FROM o GROUP BY 1),
 i AS (SELECT a.stream, count(*) AS inv FROM o a JOIN o b ON a.stream=b.stream AND a.ob<b.ob AND a.seq>b.seq GROUP BY 1)
 SELECT stream, n, coalesce(inv,0) AS inversion_count, round(CASE WHEN n>1 THEN coalesce(inv,0)/(n*(n-1)/2.0) ELSE 0 END,6) AS inversion_density,
 round(CASE WHEN n>1 THEN 1-2.0*coalesce(inv,0)/(n*(n-1)/2.0) ELSE 1 END,6) AS kendall_tau, max_displacement FROM n LEFT JOIN i USING (stream)""",
)
def _(spark, sf):
    out = ts.ordering_summary(sequenced(spark, sf), ["stream"], "seq", ["publish_ns", "event_id"])
    return out.withColumns({c: round_double(F.col(c), 6) for c in ("inversion_density", "kendall_tau")})


@query(
    "hot_keys_recent",
    f"""WITH {EV} SELECT stream, seq, kind FROM (SELECT a.stream, a.seq, a.kind, count(*) AS c FROM ev a JOIN ev b ON a.stream=b.stream AND a.kind=b.kind AND b.seq<=a.seq AND b.seq>a.seq-8 GROUP BY ALL) WHERE c >= 3""",
)
def _(spark, sf):
    return ts.hot_keys_recent(sequenced(spark, sf), ["stream"], "seq", "kind", 8, 3)


@query(
    "previous_window",
    f"""WITH {EV}, o AS (SELECT stream, arrival_ns, row_number() OVER (PARTITION BY stream ORDER BY publish_ns, event_id) AS pos FROM ev),
 r AS (SELECT a.stream, a.pos, b.pos AS prev_seq, b.arrival_ns AS prev_time, row_number() OVER (PARTITION BY a.stream, a.pos ORDER BY b.arrival_ns DESC, b.pos) AS rn
  FROM o a JOIN o b ON a.stream=b.stream AND b.pos<a.pos AND b.arrival_ns<=a.arrival_ns),
 k AS (SELECT *, count(*) OVER (PARTITION BY stream, pos) AS c FROM r WHERE rn <= 3) SELECT stream, pos, prev_seq, prev_time, CAST(c-rn+1 AS INTEGER) AS slot FROM k""",
)
def _(spark, sf):
    from tidemark.operators.ordered import ordered_scan

    rows = ordered_scan(lifecycle(spark, sf), ["stream"], ["publish_ns", "event_id"], rank="pos")
    return ts.previous_window(rows, ["stream"], "pos", "arrival_ns", 3)


@query(
    "first_divergence",
    """WITH s AS (SELECT l_linestatus AS side, l_partkey AS source, l_returnflag AS stage, string_agg(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), ',' ORDER BY l_quantity) AS sig FROM lineitem GROUP BY ALL),
 j AS (SELECT coalesce(a.source,b.source) AS source, coalesce(a.stage,b.stage) AS stage, a.sig IS DISTINCT FROM b.sig AS dif, a.sig IS NOT NULL AND b.sig IS NOT NULL AS cmp
  FROM (SELECT * FROM s WHERE side='O') a FULL JOIN (SELECT * FROM s WHERE side='F') b ON a.source=b.source AND a.stage=b.stage)
 SELECT source, arg_min(stage, CASE stage WHEN 'R' THEN 1 WHEN 'N' THEN 2 ELSE 3 END) FILTER (dif) AS first_stage, count(*) FILTER (dif) AS differing_stages, bool_and(cmp) AS comparable FROM j GROUP BY 1""",
)
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("side"), F.col("l_partkey").alias("source"), F.col("l_returnflag").alias("stage"), F.col("l_quantity").cast("long").cast("string").alias("q")
    )
    signed = rows.groupBy("side", "source", "stage").agg(multiset_digest(F.col("q")).alias("sig"))
    a, b = signed.filter("side = 'O'"), signed.filter("side = 'F'")
    return ts.first_divergence(a, b, ["source"], "stage", "sig", {"R": 1, "N": 2, "A": 3})


@query(
    "cross_worker_overlap",
    f"""WITH {EV}, {islands_sql("isl", "ev", "stream, kind", "arrival_ns", "publish_ns")}, {sweep_sql("sw", "isl", "stream", "s", "e")}
 SELECT stream, max(active) > 1 AS overlaps, CAST(coalesce(sum(CASE WHEN active>1 THEN next_ts-ts ELSE 0 END),0) AS BIGINT) AS overlap_ns FROM sw GROUP BY 1""",
)
def _(spark, sf):
    return ts.cross_worker_overlap(lifecycle(spark, sf), ["stream"], "kind", "arrival_ns", "publish_ns")
