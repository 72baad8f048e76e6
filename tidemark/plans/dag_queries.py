"""Queries over graphs of operators, spans and entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.measures import round_double
from tidemark.operators import dag
from tidemark.operators.ordered import ordered_scan
from tidemark.plans.inputs import EV, LINES, ROOTS, line_spans, root_spans, sequenced, table, turns
from tidemark.plans.interval_queries import islands_sql
from tidemark.plans.registry import query


def forest(spark, sf):
    """Child-parent rows order -> customer -> nation -> region, as one graph."""
    one = F.lit(0).alias("graph")
    orders = table(spark, sf, "orders").select(one, F.concat(F.lit("o"), "o_orderkey").alias("child"), F.concat(F.lit("c"), "o_custkey").alias("parent"))
    customers = table(spark, sf, "customer").select(one, F.concat(F.lit("c"), "c_custkey").alias("child"), F.concat(F.lit("n"), "c_nationkey").alias("parent"))
    nations = table(spark, sf, "nation").select(one, F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    return orders.unionByName(customers).unionByName(nations)


FOREST = "fo AS (SELECT o_orderkey AS o, 'c' || o_custkey AS c, 'n' || c_nationkey AS n, 'r' || n_regionkey AS r FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey)"


@query(
    "ancestors_of",
    f"WITH {FOREST}, a AS (SELECT 'o' || o AS start, c AS node, 1 AS distance FROM fo UNION ALL SELECT 'o' || o, n, 2 FROM fo UNION ALL SELECT 'o' || o, r, 3 FROM fo) SELECT start, node, distance FROM a WHERE node IS NOT NULL",
)
def _(spark, sf):
    starts = table(spark, sf, "orders").select(F.lit(0).alias("graph"), F.concat(F.lit("o"), "o_orderkey").alias("start"))
    return dag.reach(starts, forest(spark, sf), "graph", "start", "child", "parent").select("start", "node", "distance")


@query(
    "descendants_of",
    """WITH n AS (SELECT 'r' || n_regionkey AS start, n_nationkey FROM nation), c AS (SELECT start, c_custkey FROM n JOIN customer ON c_nationkey = n_nationkey), o AS (SELECT start, o_orderkey FROM c JOIN orders ON o_custkey = c_custkey)
 SELECT start, (SELECT count(*) FROM n x WHERE x.start = s.start) + (SELECT count(*) FROM c x WHERE x.start = s.start) + (SELECT count(*) FROM o x WHERE x.start = s.start) AS reached, (SELECT count(*) FROM c x WHERE x.start = s.start) AS blocked_customers, (SELECT count(*) FROM o x WHERE x.start = s.start) AS unlocked_orders FROM (SELECT DISTINCT start FROM n) s""",
)
def _(spark, sf):
    starts = table(spark, sf, "region").select(F.lit(0).alias("graph"), F.concat(F.lit("r"), "r_regionkey").alias("start"))
    reached = dag.reach(starts, forest(spark, sf), "graph", "start", "parent", "child")
    kinds = {"blocked_customers": F.startswith("node", F.lit("c")), "unlocked_orders": F.startswith("node", F.lit("o"))}
    return dag.reach_counts(reached, "graph", "start", kinds).drop("graph")


def turn_graph(spark, sf, cyclic: bool = False):
    """Every conversation as a graph: a turn leads to the next and sometimes to the one after it; the last is the sink."""
    t = F.col("turn")
    rows = ordered_scan(turns(spark, sf).select("conv_id", "turn", "role", F.length("text").cast("long").alias("service")), ["conv_id"], ["turn"], lead={"next": "turn"})
    nodes = rows.select("conv_id", "turn", "role", "service", (t * 100).cast("long").alias("ready"), F.col("next").isNull().alias("sink"))
    hop = rows.filter(F.col("next").isNotNull()).select("conv_id", F.col("turn").alias("src"), F.col("next").alias("dst"))
    far = hop.join(hop.select("conv_id", F.col("src").alias("dst"), F.col("dst").alias("far")), ["conv_id", "dst"]).filter((F.col("conv_id") + F.col("src")) % 3 == 0)
    edges = hop.unionByName(far.select("conv_id", "src", F.col("far").alias("dst")))
    if cyclic:
        edges = edges.unionByName(hop.filter((F.col("conv_id") % 10 == 3) & (F.col("src") == 1)).select("conv_id", F.col("dst").alias("src"), F.col("src").alias("dst")))
    return nodes, edges


TURNS = """nd AS (SELECT conv_id, turn, role, length(text) AS svc, turn*100 AS ready, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nx, lead(turn, 2) OVER (PARTITION BY conv_id ORDER BY turn) AS nx2 FROM conversations),
 ed AS (SELECT conv_id, turn AS src, nx AS dst FROM nd WHERE nx IS NOT NULL UNION ALL SELECT conv_id, turn, nx2 FROM nd WHERE nx2 IS NOT NULL AND (conv_id + turn) % 3 = 0)"""
PATHS = f"""{TURNS}, lv AS (SELECT conv_id, turn, 0 AS d FROM nd UNION SELECT lv.conv_id, dst, d + 1 FROM lv JOIN ed ON ed.conv_id=lv.conv_id AND src=turn),
 fi AS (SELECT conv_id, turn, ready + svc AS f FROM nd UNION SELECT fi.conv_id, dst, f + n.svc FROM fi JOIN ed ON ed.conv_id=fi.conv_id AND src=fi.turn JOIN nd n ON n.conv_id=fi.conv_id AND n.turn=dst),
 pf AS (SELECT conv_id, turn, svc AS f FROM nd UNION SELECT pf.conv_id, dst, f + n.svc FROM pf JOIN ed ON ed.conv_id=pf.conv_id AND src=pf.turn JOIN nd n ON n.conv_id=pf.conv_id AND n.turn=dst),
 re AS (SELECT conv_id, turn, svc AS f FROM nd UNION SELECT re.conv_id, src, f + n.svc FROM re JOIN ed ON ed.conv_id=re.conv_id AND dst=re.turn JOIN nd n ON n.conv_id=re.conv_id AND n.turn=src),
 v AS (SELECT nd.*, (SELECT max(d) FROM lv WHERE lv.conv_id=nd.conv_id AND lv.turn=nd.turn) AS level, (SELECT max(f) FROM fi WHERE fi.conv_id=nd.conv_id AND fi.turn=nd.turn) AS fin, (SELECT max(f) FROM pf WHERE pf.conv_id=nd.conv_id AND pf.turn=nd.turn) AS pre, (SELECT max(f) FROM re WHERE re.conv_id=nd.conv_id AND re.turn=nd.turn) AS rem FROM nd)"""


@query(
    "topological_levels",
    f"WITH RECURSIVE {PATHS}, cy AS (SELECT conv_id FROM nd WHERE turn = 1 AND nx IS NOT NULL AND conv_id % 10 = 3) SELECT v.conv_id, turn, CASE WHEN cy.conv_id IS NOT NULL AND turn >= 1 THEN NULL ELSE level END AS level FROM v LEFT JOIN cy USING (conv_id)",
)
def _(spark, sf):
    nodes, edges = turn_graph(spark, sf, cyclic=True)
    return dag.longest_paths(nodes, edges, "conv_id", "turn", "src", "dst", "service", {}).select("conv_id", "turn", "level")


@query("longest_remaining_path", f"WITH RECURSIVE {PATHS} SELECT conv_id, turn, rem AS remaining FROM v")
def _(spark, sf):
    nodes, edges = turn_graph(spark, sf)
    return dag.longest_paths(nodes, edges, "conv_id", "turn", "dst", "src", "service", {"remaining": F.lit(0)}).select("conv_id", "turn", "remaining")


@query(
    "critical_path_slack",
    f"""WITH RECURSIVE {PATHS}, s AS (SELECT conv_id, max(fin) FILTER (nx IS NULL) AS sf FROM v GROUP BY 1)
 SELECT conv_id, turn, CAST(level AS INTEGER) AS level, fin-svc AS earliest_start, fin AS earliest_finish, sf-rem AS latest_start, sf-rem-(fin-svc) AS slack, rem AS remaining, sf-rem = fin-svc AS on_critical_path, sf AS sink_finish FROM v JOIN s USING (conv_id)""",
)
def _(spark, sf):
    nodes, edges = turn_graph(spark, sf)
    return dag.critical_path_slack(nodes, edges, "conv_id", "turn", "src", "dst", "service", F.col("ready"), "sink")


@query(
    "critical_path_members",
    f"WITH RECURSIVE {PATHS} SELECT conv_id, turn, pre AS prefix, rem AS suffix, pre+rem-svc AS through, pre+rem-svc = max(pre+rem-svc) OVER (PARTITION BY conv_id) AS member FROM v",
)
def _(spark, sf):
    nodes, edges = turn_graph(spark, sf)
    return dag.critical_path_members(nodes, edges, "conv_id", "turn", "src", "dst", "service").select("conv_id", "turn", "prefix", "suffix", "through", "member")


LINE_ID = "span_id || '-' || quantity || '-' || price || '-' || status || phase || start_ns"


@query(
    "span_tree_critical_path",
    f"""WITH {LINES}, {ROOTS}, ls AS (SELECT trace, {LINE_ID} AS id, start_ns, end_ns FROM lines), cl AS (SELECT l.trace, l.id, l.end_ns-l.start_ns AS len, greatest(l.start_ns, r.start_ns) AS a, least(l.end_ns, r.end_ns) AS b FROM ls l JOIN roots r USING (trace)),
 k AS (SELECT * FROM cl WHERE a < b), {islands_sql("isl", "k", "trace", "a", "b")}, cov AS (SELECT trace, sum(e-s) AS c FROM isl GROUP BY 1),
 s AS (SELECT *, max(b) OVER (PARTITION BY trace ORDER BY a, b, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM k), g AS (SELECT *, sum(CASE WHEN seen IS NULL OR a >= seen THEN 1 ELSE 0 END) OVER (PARTITION BY trace ORDER BY a, b, id ROWS UNBOUNDED PRECEDING) AS cid FROM s),
 m AS (SELECT trace, sum(x) AS kids FROM (SELECT trace, cid, max(len) AS x FROM g GROUP BY ALL) GROUP BY 1)
 SELECT trace, 'root' AS span_id, 0 AS depth, CAST(end_ns-start_ns-coalesce(c,0) AS BIGINT) AS exclusive, CAST(end_ns-start_ns-coalesce(c,0)+coalesce(kids,0) AS BIGINT) AS critical_path, 'OK' AS span_status FROM roots LEFT JOIN cov USING (trace) LEFT JOIN m USING (trace) WHERE trace % 16 <> 5
 UNION ALL SELECT trace, id, CASE WHEN trace % 16 = 5 THEN 0 ELSE 1 END, end_ns-start_ns, end_ns-start_ns, CASE WHEN trace % 16 = 5 THEN 'ORPHAN' ELSE 'OK' END FROM ls
 UNION ALL SELECT trace, 'loop' || g, NULL, 0, NULL, 'CYCLE' FROM roots, (SELECT unnest([1, 2]) AS g) WHERE trace % 16 = 7""",
)
def _(spark, sf):
    roots = root_spans(spark, sf).select("trace", F.lit("root").alias("span_id"), F.lit(None).cast("string").alias("parent_id"), "start_ns", "end_ns")
    name = F.concat_ws("-", "span_id", "quantity", "price", F.concat("status", "phase", "start_ns"))
    lines = line_spans(spark, sf).select("trace", name.alias("span_id"), F.lit("root").alias("parent_id"), "start_ns", "end_ns")
    # Some traces have lost their root, others hold two spans that name each other as parent.
    at = lambda own, up: F.struct(F.lit(own).alias("span_id"), F.lit(up).alias("parent_id"))
    loops = roots.filter("trace % 16 = 7").select("trace", F.explode(F.array(at("loop1", "loop2"), at("loop2", "loop1"))).alias("l")).select("trace", "l.span_id", "l.parent_id", F.lit(0).cast("long").alias("start_ns"), F.lit(5).cast("long").alias("end_ns"))
    spans = roots.filter("trace % 16 <> 5").unionByName(lines).unionByName(loops)
    return dag.span_tree_critical_path(spans, ["trace"], "span_id", "parent_id", "start_ns", "end_ns")


@query(
    "source_path_bounds",
    f"""WITH RECURSIVE {PATHS}, a AS (SELECT conv_id, min(ready) AS arrival, max(fin) AS earliest_publication, max(ready*3+svc) AS observed_publication, count(*) FILTER (role='assistant') AS requests, CAST(sum(CASE WHEN role='assistant' THEN svc ELSE 0 END) AS BIGINT) AS work FROM v GROUP BY 1)
 SELECT *, greatest(0, earliest_publication-arrival) AS critical_path, CAST(ceil(work/2.0) AS BIGINT) AS resource_bound, greatest(earliest_publication-arrival, CAST(ceil(work/2.0) AS BIGINT)) AS combined_bound, observed_publication-arrival AS latency FROM a""",
)
def _(spark, sf):
    nodes, edges = turn_graph(spark, sf)
    finished = dag.longest_paths(nodes, edges, "conv_id", "turn", "src", "dst", "service", {"finish": F.col("ready")})
    rows = finished.withColumn("published", F.col("ready") * 3 + F.col("service"))
    return dag.source_path_bounds(rows, "conv_id", "service", F.col("role") == "assistant", "ready", "published", 2)


@query(
    "readiness_audit",
    f"""WITH {EV}, o AS (SELECT stream, kind, event_id, arrival_ns AS available, CASE WHEN event_id % 30 <> 0 THEN publish_ns END AS prepared, lag(publish_ns) OVER (PARTITION BY stream ORDER BY seq) AS predecessor, lag(start_ns) OVER (PARTITION BY stream ORDER BY seq) AS dep FROM ev),
 r AS (SELECT *, prepared IS NOT NULL AND predecessor IS NOT NULL AND NOT (event_id % 25 = 1) AS known, greatest(available, coalesce(CASE WHEN event_id % 25 <> 1 THEN dep END, available)) AS ready_at FROM o), x AS (SELECT *, prepared - ready_at AS adv FROM r)
 SELECT kind, count(*) AS operators, count(*) FILTER (known) AS locally_ready, count(*) FILTER (NOT known) AS unknown, count(*) FILTER (known AND ready_at < prepared) AS ready_before_prepared, count(*) FILTER (known AND ready_at < predecessor) AS ready_before_predecessor,
 round(quantile_cont(adv,0.5) FILTER (known AND adv>0)/1e6,3) AS advance_p50, round(quantile_cont(adv,0.95) FILTER (known AND adv>0)/1e6,3) AS advance_p95, max(adv) FILTER (known AND adv>0) AS advance_max FROM x GROUP BY 1""",
)
def _(spark, sf):
    e = F.col("event_id")
    rows = ordered_scan(sequenced(spark, sf), ["stream"], ["seq"], lag={"predecessor": "publish_ns", "dep": "start_ns"})
    operators = rows.select("kind", "event_id", F.col("arrival_ns").alias("available"), F.when(e % 30 != 0, F.col("publish_ns")).alias("prepared"), "predecessor")
    deps = rows.select("event_id", F.when(e % 25 != 1, F.coalesce("dep", "arrival_ns")).alias("satisfied"))
    out = dag.readiness_audit(dag.readiness(operators, deps, "event_id", "available", "prepared", "predecessor", "satisfied"), ["kind"])
    return out.withColumns({c: round_double(F.col(c) / 1e6, 3) for c in ("advance_p50", "advance_p95")})
