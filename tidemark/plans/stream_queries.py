"""Queries that run as streams over the given tables until everything available is processed."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import retrieval as rt
from tidemark.operators.ordered import ordered_scan
from tidemark.plans.inputs import EV, lifecycle, sequenced, table, turns, whole
from tidemark.plans.registry import query
from tidemark.plans.statistic_queries import rounded
from tidemark.session import fresh_path
from tidemark.sources.records import verify_sealed_lines
from tidemark.streaming import operators as so
from tidemark.streaming.runs import append_to_end, rocksdb_state, run_available, update_to_end


def streamed(spark, sf):
    """The events table as a stream."""
    schema = table(spark, sf, "events").schema
    # A pattern reads the table whether it is one file or a folder of files.
    return spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def staged(spark, rows, label: str) -> str:
    """A derived table written for streaming from the shared folder."""
    path = fresh_path(spark, label)
    rows.write.parquet(path)
    return path


#: Rows of one key of a stream that deals its streams into buckets.
BUCKET_ROWS = 20_000


def buckets_for(rows) -> int:
    """Keys for staged rows: more rows mean more keys, not larger ones."""
    return rows.count() // BUCKET_ROWS + 8


def with_cents(df):
    return df.withColumn("cents", F.round(F.col("value") * 100).cast("long"))


def heartbeat_of(spark, rows):
    """One row like those of ``rows`` but a century later: the latest row with its time moved."""
    return rows.orderBy(F.col("ts").desc()).limit(1).withColumns({"ts": F.expr("ts + INTERVAL 100 YEARS"), rows.columns[0]: F.lit(-1).cast(rows.schema[0].dataType)})


@query(
    "append_sealed_stream",
    f"""WITH {EV}, s AS (SELECT kind AS producer, row_number() OVER (PARTITION BY kind ORDER BY arrival_ns, event_id) - 1 AS q, event_id FROM ev), k AS (SELECT *, lag(q) OVER (PARTITION BY producer ORDER BY q) AS p FROM s WHERE event_id % 113 <> 9)
 SELECT producer, CASE WHEN q <> coalesce(p + 1, 0) THEN 'SEQUENCE_GAP' ELSE 'OK' END AS seal_status, count(*) AS n FROM k GROUP BY ALL""",
)
def _(spark, sf):
    # Every producer numbers its own rows; some never reach the stream and leave gaps.
    numbered = ordered_scan(lifecycle(spark, sf), ["kind"], ["arrival_ns", "event_id"], rank="_r").filter(F.col("event_id") % 113 != 9).select("kind", (F.col("_r") - 1).alias("q"), "arrival_ns")
    path = staged(spark, numbered, "sealed-in")
    out, checkpoint = fresh_path(spark, "sealed-out"), fresh_path(spark, "sealed-checkpoint")
    fields = {"producer": F.col("kind"), "event_sequence": F.col("q"), "timestamp_ns": F.col("arrival_ns")}
    run_available(so.sealed_lines(spark.readStream.schema(numbered.schema).parquet(path), "trace.v1", fields), out, checkpoint, fmt="text")
    schema = T.StructType([T.StructField("producer", T.StringType()), T.StructField("event_sequence", T.LongType()), T.StructField("timestamp_ns", T.LongType())])
    checked = verify_sealed_lines(spark.read.text(out), "trace.v1", schema, "producer", "event_sequence", "timestamp_ns")
    return checked.groupBy("producer", "seal_status").agg(F.count(F.lit(1)).alias("n"))


LIFE = ("ARRIVAL", "ENQUEUED", "SERVICE_STARTED", "PUBLICATION_DURABLE")


def life_events(rows):
    """Four events per source; every fifteenth source never publishes."""
    us = F.unix_micros("ts")
    at = lambda name, t: F.struct(F.lit(name).alias("event"), t.alias("at_us"))
    steps = F.array_compact(
        F.array(
            at(LIFE[0], us), at(LIFE[1], us + 10), at(LIFE[2], us + F.col("cents") * 500_000), F.when(F.col("event_id") % 15 != 4, at(LIFE[3], us + F.col("cents") * 1_000_000))
        )
    )
    return rows.select("event_id", "user_id", "ts", F.explode(steps).alias("e")).select("event_id", "user_id", "e.event", "e.at_us", F.timestamp_micros("e.at_us").alias("at"))


@query(
    "lifecycle_assembly",
    """WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS us, CAST(round(value*100) AS BIGINT) AS c FROM events) SELECT event_id, user_id, us AS arrival, us+10 AS enqueued, us+c*500000 AS service_started, CASE WHEN event_id % 15 <> 4 THEN us+c*1000000 END AS publication_durable,
 CASE WHEN event_id % 15 <> 4 THEN 'COMPLETE' ELSE 'CENSORED' END AS status FROM e""",
)
def _(spark, sf):
    rows = with_cents(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))).select("event_id", "user_id", "ts", "cents")
    path = staged(spark, rows, "life")
    build = lambda s: so.lifecycle_assembly(life_events(s), ["event_id", "user_id"], "event", "at_us", "at", LIFE, delay="1 hour", timeout="1 day")
    return append_to_end(spark, path, rows.schema, build, heartbeat_of(spark, rows), "life").filter("event_id >= 0")


RELEASE = f"""{EV}, ar AS (SELECT stream, seq FROM ev WHERE event_id % 97 <> 5 OR stream % 3 = 0),
 rk AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY seq) - 1 AS rn, lag(seq, 1, -1) OVER (PARTITION BY stream ORDER BY seq) AS before FROM ar)"""
SLICE = 1 << 16


@query(
    "source_ordered_release",
    f"""WITH {RELEASE} SELECT stream, seq, seq AS last_seq, CASE WHEN seq = rn THEN 'RELEASED' ELSE 'HELD' END AS release_status, CASE WHEN seq = rn THEN seq ELSE -1 END AS release_order FROM rk
 UNION ALL SELECT stream, seq, seq, 'DUPLICATE', -1 FROM ev WHERE event_id % 23 = 0 AND (event_id % 97 <> 5 OR stream % 3 = 0)
 UNION ALL SELECT stream, before + 1, seq - 1, 'MISSING', -1 FROM rk WHERE seq > before + 1""",
)
def _(spark, sf):
    e = F.col("event_id")
    rows = sequenced(spark, sf).select("stream", "seq", "event_id", "publish_ns").filter((e % 97 != 5) | (F.col("stream") % 3 == 0))
    twice = rows.unionByName(rows.filter(e % 23 == 0).withColumn("publish_ns", F.col("publish_ns") + 1000))
    twice = twice.select("stream", "seq", F.timestamp_micros(whole(F.col("publish_ns"), 1000)).alias("ts"))
    arrivals = released_arrivals(spark, twice, SLICE)
    return so.ordered_release(arrivals, "stream", "seq")


def released_arrivals(spark, rows, slice_rows: int):
    """What has come and what is missing of staged rows (stream, seq, ts), by the two streams one after the other."""
    path = staged(spark, rows, "release")
    settle = {"slice_rows": slice_rows, "delay": "1 hour", "timeout_ms": 3_600_000}
    with rocksdb_state(spark):
        arrivals = append_to_end(spark, path, rows.schema, lambda s: so.source_arrivals(s, "stream", "seq", "ts", **settle), heartbeat_of(spark, rows), "release").filter("stream >= 0")
        edges = arrivals.filter("arrival = 'EDGE'")
        beat = edges.orderBy(F.col("at_us").desc()).limit(1).withColumns({"at_us": F.col("at_us") + 100 * 366 * 86_400_000_000, "stream": F.lit(-1).cast("long")})
        between = append_to_end(spark, staged(spark, edges, "edges"), edges.schema, lambda s: so.border_gaps(s, "stream", "seq", **settle), beat, "borders")
    return arrivals.unionByName(between.filter("stream >= 0"))


FRONTIER_SQL = f"""WITH {EV}, s AS (SELECT stream, seq, event_id, publish_ns, unnest(['INTENT','PREPARE','PREPARED','BIND','COMMIT','PUBLISHED']) AS state, unnest([1,2,3,4,5,6]) AS k FROM ev),
 l AS (SELECT stream, seq, publish_ns//1000*10 + k AS t, state, k FROM s WHERE NOT (event_id % 29 = 3 AND k = 3)),
 a AS (SELECT *, lag(k) OVER (PARTITION BY stream, seq ORDER BY t) AS f, coalesce(sum(CASE WHEN k=6 THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS pb FROM l),
 g AS (SELECT stream, seq, state, CASE WHEN k <> coalesce(f,0)+1 THEN 'INVALID_TRANSITION' WHEN k IN (4,6) AND pb <> seq THEN 'NOT_AT_FRONTIER' END AS finding FROM a) SELECT * FROM g WHERE finding IS NOT NULL"""


def state_log(spark, sf):
    """Six states of every source; some sources skip one."""
    steps = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(i).cast("long").alias("k")) for i, s in enumerate(so.STATES) if i])
    log = sequenced(spark, sf).select("stream", "seq", "event_id", "publish_ns", F.explode(steps).alias("s")).select("stream", "seq", "event_id", (whole(F.col("publish_ns"), 1000) * 10 + F.col("s.k")).alias("t"), "s.state", "s.k")
    return log.filter(~((F.col("event_id") % 29 == 3) & (F.col("k") == 3))).select("stream", "seq", "t", "state")


@query("frontier_state_check", FRONTIER_SQL)
def _(spark, sf):
    return so.frontier_state_check(state_log(spark, sf), ["stream"], "seq", "state", ["t"])


@query("frontier_state_stream", FRONTIER_SQL)
def _(spark, sf):
    log = state_log(spark, sf).withColumn("ts", F.timestamp_micros(whole(F.col("t"), 10)))
    return streamed_findings(spark, log)


def streamed_findings(spark, log):
    """Findings over staged rows (stream, seq, t, state, ts), by the two streams one after the other."""
    names = ("stream", "seq", "state", "t")
    with rocksdb_state(spark):
        path = staged(spark, log, "states")
        there = spark.read.schema(log.schema).parquet(path)
        buckets = buckets_for(there)
        steps = append_to_end(spark, path, log.schema, lambda s: so.state_transitions(s, *names, "ts", delay="1 hour", buckets=buckets), heartbeat_of(spark, there), "states").filter("stream >= 0")
        late = steps.orderBy(F.col("at_us").desc()).limit(1).withColumns({"at_us": F.col("at_us") + 100 * 366 * 86_400_000_000, "stream": F.lit(-1).cast("long"), "state": F.lit("BIND"), "finding": F.lit(None).cast("string")})
        off = append_to_end(spark, staged(spark, steps, "steps"), steps.schema, lambda s: so.frontier_publications(s, *names, delay="1 hour", buckets=buckets), late, "frontier")
    out = ["stream", "seq", "state", "finding"]
    return steps.filter("finding IS NOT NULL").select(*out).unionByName(off.filter("stream >= 0").select(*out))


@query(
    "telemetry_windows",
    """WITH e AS (SELECT event_type, ts, epoch_us(ts) AS us, CAST(round(value*100) AS BIGINT) AS c FROM events), w AS (SELECT (us // 3600000000) * 3600000000 AS window_start_us, event_type, count(*) AS samples, round(least(1.0, count(*)/4.0::DOUBLE),6) AS coverage, round(CAST(sum(c) AS DOUBLE)/count(*),6) AS gauge_mean, max(c) AS gauge_max, max(us)-min(us) AS span_us FROM e GROUP BY ALL),
 d AS (SELECT event_type, us, us - lag(us) OVER (PARTITION BY event_type ORDER BY us) AS gap FROM (SELECT DISTINCT event_type, us FROM e)),
 g AS (SELECT event_type, (us // 3600000000) * 3600000000 AS window_start_us, count(gap) AS gaps, list_sort(list(gap) FILTER (gap IS NOT NULL)) AS l FROM d GROUP BY ALL)
 SELECT w.*, gaps, l[CAST(ceil(0.5 * gaps) AS BIGINT)] AS gap_p50_us, l[CAST(ceil(0.95 * gaps) AS BIGINT)] AS gap_p95_us, l[gaps] AS gap_max_us FROM w JOIN g USING (event_type, window_start_us)""",
)
def _(spark, sf):
    rows = with_cents(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))).select("event_id", "event_type", "ts", "cents")
    path = staged(spark, rows, "telemetry")
    build = lambda s: so.telemetry_windows(s, ["event_type"], "ts", "cents", delay="1 hour", window="1 hour", expected=4)
    out = append_to_end(spark, path, rows.schema, build, heartbeat_of(spark, rows), "telemetry")
    closed = out.select("event_type", "window_start_us", "times_us")
    beat = closed.orderBy(F.col("window_start_us").desc()).limit(1).withColumns({"window_start_us": F.col("window_start_us") + 100 * 366 * 86_400_000_000, "event_type": F.lit("")})
    with rocksdb_state(spark):
        gaps = append_to_end(spark, staged(spark, closed, "windows"), closed.schema, lambda s: so.window_gaps(s, ["event_type"], delay="1 hour"), beat, "gaps")
    return rounded(out.drop("times_us").join(gaps.filter("event_type <> ''"), ["event_type", "window_start_us"]), 6, "coverage", "gauge_mean")


@query("recent_hot_keys", f"WITH {EV} SELECT stream, seq, kind FROM (SELECT a.stream, a.seq, a.kind, count(*) AS c FROM ev a JOIN ev b ON a.stream=b.stream AND a.kind=b.kind AND b.seq<=a.seq AND b.seq>a.seq-8 GROUP BY ALL) WHERE c >= 3")
def _(spark, sf):
    rows = sequenced(spark, sf).select("stream", "kind", "seq", F.timestamp_micros(whole(F.col("arrival_ns"), 1000)).alias("ts"))
    path = staged(spark, rows, "hot")
    there = spark.read.schema(rows.schema).parquet(path)
    buckets = buckets_for(there)
    build = lambda s: so.recent_hot_keys(s, "stream", "kind", "seq", "ts", window=8, threshold=3, delay="1 hour", buckets=buckets)
    return append_to_end(spark, path, rows.schema, build, heartbeat_of(spark, there), "hot").filter("stream >= 0")


WORDS = """w AS (SELECT conv_id*1000+turn AS id, string_split(lower(regexp_replace(text, '[^A-Za-z ]', '', 'g')), ' ') AS l FROM conversations), p AS (SELECT id, unnest(range(len(l))) AS pos, l FROM w), q AS (SELECT id, pos, array_to_string(l[1:pos+1], '|') AS px FROM p)"""


def word_blocks(spark, sf):
    words = F.split(F.lower(F.regexp_replace("text", "[^A-Za-z ]", "")), " ")
    return turns(spark, sf).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), words.alias("blocks"))


def prefixes(spark, sf):
    return rt.chained_prefixes(word_blocks(spark, sf), "id", F.col("blocks"))


@query(
    "latest_provider_index",
    f"""WITH {WORDS}, m AS (SELECT id, pos, max(id) OVER (PARTITION BY px ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pv FROM q) SELECT id, CAST(coalesce(max(pos) FILTER (pv IS NOT NULL) + 1, 0) * 4 AS BIGINT) AS matched, coalesce(arg_max(pv, pos) FILTER (pv IS NOT NULL), 0) AS recency FROM m GROUP BY 1""",
)
def _(spark, sf):
    return so.provider_affinity(word_blocks(spark, sf), "id", F.col("blocks"), 4)


@query(
    "provider_index_stream",
    f"""WITH {WORDS}, m AS (SELECT px, max(id) AS provider FROM q GROUP BY 1) SELECT provider, count(*) AS prefixes FROM m GROUP BY 1""",
)
def _(spark, sf):
    rows = prefixes(spark, sf)
    path = staged(spark, rows, "providers")
    log = update_to_end(so.provider_index(spark.readStream.schema(rows.schema).parquet(path), "prefix_hash", "id"), "providers")
    return so.latest_of(log, ["prefix_hash"], ["provider"]).groupBy("provider").agg(F.count(F.lit(1)).alias("prefixes"))


@query("exactly_once_dedup", "SELECT event_id, user_id, event_type, CASE WHEN event_id % 3 = 0 THEN 1::BIGINT ELSE 0 END AS dropped FROM events")
def _(spark, sf):
    rows = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "user_id", "event_type", "ts")
    path = staged(spark, rows.unionByName(rows.filter("event_id % 3 = 0")), "dedup")
    out, checkpoint = fresh_path(spark, "dedup-out"), fresh_path(spark, "dedup-checkpoint")
    stream = so.exactly_once(spark.readStream.schema(rows.schema).parquet(path), ["event_id"], "ts", delay="1 hour").drop("ts")
    run_available(stream, out, checkpoint)
    seen = append_to_end(spark, path, rows.schema, lambda s: so.copies(s, ["event_id"], "ts", delay="1 hour"), heartbeat_of(spark, rows), "copies")
    return spark.read.schema(stream.schema).parquet(out).join(seen, "event_id").withColumn("dropped", F.col("copies") - 1).drop("copies")


@query(
    "idle_sessions",
    """WITH e AS (SELECT user_id, epoch_us(ts) AS us FROM events), g AS (SELECT *, CASE WHEN lag(us) OVER w IS NULL OR us >= lag(us) OVER w + 21600000000 THEN 1 ELSE 0 END AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us)), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY us) AS k FROM g)
 SELECT user_id, min(us) AS session_start_us, max(us) + 21600000000 AS session_end_us, count(*) AS events FROM s GROUP BY user_id, k""",
)
def _(spark, sf):
    rows = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "user_id", "ts")
    path = staged(spark, rows, "sessions")
    build = lambda s: so.idle_sessions(s, ["user_id"], "ts", delay="1 hour", gap="6 hours")
    return append_to_end(spark, path, rows.schema, build, heartbeat_of(spark, rows), "sessions")


@query("run_progress", "SELECT user_id AS run, event_type AS state, count(*) AS rows FROM events GROUP BY ALL")
def _(spark, sf):
    journal = streamed(spark, sf).select(F.col("user_id").alias("run"), F.col("event_type").alias("state"))
    log = update_to_end(so.run_progress(journal, "run", "state"), "progress")
    return so.latest_of(log, ["run", "state"], ["rows"])
