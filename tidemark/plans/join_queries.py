"""Queries over pairings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.digests import row_hash
from tidemark.operators import intervals as iv
from tidemark.operators import pairing as pr
from tidemark.operators.ordered import ordered_scan
from tidemark.plans.inputs import EV, LINES, lifecycle, line_spans, sequenced, table, turns, whole
from tidemark.plans.interval_queries import islands_sql
from tidemark.plans.registry import query
from tidemark.session import cut_lineage

PLAN = """pl AS (SELECT o_custkey AS question, CASE WHEN o_orderkey % 2 = 0 THEN 'correctness' ELSE 'performance' END AS lane, 'M' || (o_orderkey % 3) AS method, CASE WHEN o_orderkey % 10 = 0 THEN 'capture' ELSE 'replay' END AS mode, o_orderkey % 7 AS repeat, o_orderkey AS run_id FROM orders)"""


@query(
    "pair_runs",
    f"""WITH {PLAN} SELECT c.question, c.lane, c.method, c.repeat, c.run_id AS candidate_run, r.run_id AS reference_run FROM pl c JOIN pl r ON c.question=r.question AND r.lane='correctness' AND r.mode='capture' WHERE c.lane='correctness' AND c.method='M2' AND c.mode<>'capture'
 UNION ALL SELECT c.question, c.lane, c.method, c.repeat, c.run_id, r.run_id FROM pl c JOIN pl r ON c.question=r.question AND c.repeat=r.repeat AND r.lane='performance' AND r.method='M0' WHERE c.lane='performance' AND c.method IN ('M1','M2')""",
)
def _(spark, sf):
    k = F.col("o_orderkey")
    plan = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("question"),
        F.when(k % 2 == 0, "correctness").otherwise("performance").alias("lane"),
        F.concat(F.lit("M"), k % 3).alias("method"),
        F.when(k % 10 == 0, "capture").otherwise("replay").alias("mode"),
        (k % 7).alias("repeat"),
        k.alias("run_id"),
    )
    return pr.pair_runs(plan, "question", "lane", "method", "mode", "repeat", "run_id", base="M0", candidates=["M1", "M2"], checked="M2")


@query(
    "full_outer_inventory",
    f"""WITH {LINES}, l AS (SELECT trace, phase, count(*) AS n FROM lines WHERE status='O' GROUP BY ALL), r AS (SELECT trace, phase, count(*) AS n FROM lines WHERE status='F' GROUP BY ALL),
 j AS (SELECT trace, phase, coalesce(l.n,0) AS left_count, coalesce(r.n,0) AS right_count FROM l FULL JOIN r USING (trace, phase))
 SELECT *, CASE WHEN left_count=0 THEN 'RIGHT_ONLY' WHEN right_count=0 THEN 'LEFT_ONLY' ELSE 'DUPLICATE' END AS reason FROM j WHERE left_count<>1 OR right_count<>1""",
)
def _(spark, sf):
    rows = line_spans(spark, sf)
    return pr.full_outer_inventory(rows.filter("status = 'O'"), rows.filter("status = 'F'"), ["trace", "phase"])


@query(
    "dataset_parity",
    """WITH r AS (SELECT doc_id, lang, CASE WHEN doc_id % 50 = 1 THEN text || '!' ELSE text END AS text, CASE WHEN doc_id % 60 = 2 THEN NULL ELSE source END AS source FROM documents WHERE doc_id % 70 <> 3)
 SELECT d.doc_id, CASE WHEN d.doc_id % 80 = 4 THEN 'duplicate_record' WHEN r.doc_id IS NULL THEN 'missing_record' WHEN r.source IS NULL THEN 'missing_required_fields' WHEN r.text <> d.text THEN 'field_or_hash_mismatch' END AS reason
 FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id WHERE d.doc_id % 80 = 4 OR r.doc_id IS NULL OR r.source IS NULL OR r.text <> d.text""",
)
def _(spark, sf):
    d = F.col("doc_id")
    left = table(spark, sf, "documents").select("doc_id", "lang", "text", "source")
    right = left.filter(d % 70 != 3).withColumns({"text": F.when(d % 50 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")), "source": F.when(d % 60 != 2, F.col("source"))})
    return pr.dataset_parity(left.unionByName(left.filter(d % 80 == 4)), right, "doc_id", ["source"], ["lang", "text"])


@query(
    "projection_parity",
    """WITH p AS (SELECT doc_id, CASE WHEN doc_id % 30 = 1 THEN n_chars + 1 ELSE n_chars END AS n_chars, CASE WHEN doc_id % 40 = 2 THEN 'zz' ELSE sha256(text) END AS hash FROM documents WHERE doc_id % 25 <> 3),
 r AS (SELECT d.doc_id, unnest(list_filter([CASE WHEN p.doc_id IS NULL THEN 'projection_missing' END, CASE WHEN p.n_chars <> d.n_chars THEN 'length_mismatch' END, CASE WHEN p.hash = 'zz' THEN 'hash_format' END, CASE WHEN p.hash <> sha256(d.text) THEN 'hash_mismatch' END], lambda x: x IS NOT NULL)) AS reason FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id)
 SELECT * FROM r""",
)
def _(spark, sf):
    d = F.col("doc_id")
    source = table(spark, sf, "documents").select("doc_id", "n_chars", F.sha2("text", 256).alias("hash"))
    projection = source.filter(d % 25 != 3).withColumns({"n_chars": F.col("n_chars") + (d % 30 == 1).cast("long"), "hash": F.when(d % 40 == 2, "zz").otherwise(F.col("hash"))})
    checks = {"length_mismatch": F.col("n_chars") != F.col("p_n_chars"), "hash_format": ~F.col("p_hash").rlike("^[0-9a-f]{64}$"), "hash_mismatch": F.col("hash") != F.col("p_hash")}
    return pr.projection_parity(source, projection, "doc_id", checks)


@query(
    "map_rank_to_session",
    """WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS rank, 'e' || conv_id || '-' || turn AS name, md5(text) AS h FROM conversations),
 m AS (SELECT 'e' || conv_id || '-' || turn AS name, CASE WHEN turn % 5 = 4 THEN 'x' ELSE md5(text) END AS fh, conv_id || '/' || (turn//2) AS session_id FROM conversations WHERE turn % 7 <> 6),
 j AS (SELECT r.conv_id, r.rank, r.name, m.session_id, r.h, m.fh, min(r.rank) OVER (PARTITION BY r.conv_id, m.session_id) AS f FROM r LEFT JOIN m USING (name) WHERE rank <= 5)
 SELECT conv_id, rank, name, session_id, CASE WHEN session_id IS NULL THEN 'FOREIGN' WHEN h <> fh THEN 'HASH_MISMATCH' WHEN rank > f THEN 'DUPLICATE_SESSION' ELSE 'OK' END AS map_status FROM j""",
)
def _(spark, sf):
    t = F.col("turn")
    rows = turns(spark, sf).select("conv_id", "turn", F.concat(F.lit("e"), "conv_id", F.lit("-"), "turn").alias("name"), F.md5("text").alias("h"), (-F.length("text")).alias("neg"))
    ranked = ordered_scan(rows, ["conv_id"], ["neg", "turn"], rank="rank")
    mapping = rows.filter(t % 7 != 6).select("name", F.when(t % 5 == 4, "x").otherwise(F.col("h")).alias("h"), F.concat_ws("/", "conv_id", F.floor(t / 2)).alias("session"))
    return pr.map_rank_to_session(ranked, mapping, "conv_id", "rank", "name", "h", "session", 5)


@query(
    "resolve_provenance",
    """WITH a AS (SELECT o_orderkey, unnest([o_custkey, o_custkey + 1, o_custkey * 3]) AS c FROM orders), j AS (SELECT a.o_orderkey, c_mktsegment AS v, c_custkey IS NULL AS miss FROM a LEFT JOIN customer ON c = c_custkey)
 SELECT o_orderkey, coalesce(string_agg(DISTINCT v, ',' ORDER BY v), '') AS segments, count(*) FILTER (miss) AS unresolved FROM j GROUP BY 1""",
)
def _(spark, sf):
    c = F.col("o_custkey")
    rows = table(spark, sf, "orders").select("o_orderkey", F.array(c, c + 1, c * 3).alias("ids"))
    lookup = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment")
    out = pr.resolve_provenance(rows, "o_orderkey", "ids", lookup, "id", "c_mktsegment")
    return out.select("o_orderkey", F.array_join("resolved", ",").alias("segments"), "unresolved")


@query(
    "exact_lookup_join",
    """WITH g AS (SELECT l_orderkey + (l_linenumber - 1) * (l_orderkey % 3) * 1000000000 AS k, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS f FROM lineitem GROUP BY 1), a AS (SELECT o_orderkey + CASE WHEN o_orderkey % 7 = 3 THEN 500000000 ELSE 0 END AS k FROM orders)
 SELECT k, CASE WHEN a.k IS NULL THEN 'UNREQUESTED' WHEN n IS NULL THEN 'MISSING' WHEN f > 0 THEN 'FOREIGN_NAMESPACE' WHEN n > 1 THEN 'DUPLICATE' ELSE 'OK' END AS lookup_status FROM a FULL JOIN g USING (k)""",
)
def _(spark, sf):
    # Some orders are asked for under a name nobody has, and lines of two orders in three answer to names of their own.
    order = F.col("l_orderkey")
    asked = table(spark, sf, "orders").select((F.col("o_orderkey") + F.when(F.col("o_orderkey") % 7 == 3, 500_000_000).otherwise(0)).alias("k"))
    back = table(spark, sf, "lineitem").select((order + (F.col("l_linenumber") - 1) * (order % 3) * 1_000_000_000).alias("k"), F.when(F.col("l_returnflag") == "R", "other").otherwise("own").alias("ns"))
    return pr.exact_lookup(asked, back, "k", "ns", "own")


@query(
    "intersection_union",
    f"""WITH {EV}, lf AS (SELECT * FROM ev WHERE kind IN ('click','view')), rt AS (SELECT * FROM ev WHERE kind NOT IN ('click','view')), {islands_sql("li", "lf", "stream", "arrival_ns", "publish_ns")}, {islands_sql("ri", "rt", "stream", "arrival_ns", "publish_ns")},
 x AS (SELECT li.stream, sum(least(li.e,ri.e)-greatest(li.s,ri.s)) AS t FROM li JOIN ri ON li.stream=ri.stream AND li.s<ri.e AND ri.s<li.e GROUP BY 1)
 SELECT DISTINCT ev.stream, CAST(coalesce(t,0) AS BIGINT) AS both_len FROM ev LEFT JOIN x USING (stream)""",
)
def _(spark, sf):
    rows = lifecycle(spark, sf)
    return iv.both_active_time(rows.filter(F.col("kind").isin("click", "view")), rows.filter(~F.col("kind").isin("click", "view")), ["stream"], "arrival_ns", "publish_ns")


@query(
    "multiset_pairing",
    f"""WITH {LINES}, n AS (SELECT trace, phase, status, price, quantity, row_number() OVER (PARTITION BY trace, phase, status ORDER BY price, quantity, span_id) AS o FROM lines),
 j AS (SELECT coalesce(a.phase,b.phase) AS phase, a.price AS ap, b.price AS bp, a.quantity AS aq, b.quantity AS bq FROM (SELECT * FROM n WHERE status='O') a FULL JOIN (SELECT * FROM n WHERE status='F') b ON a.trace=b.trace AND a.phase=b.phase AND a.o=b.o)
 SELECT phase, count(*) AS slots, count(*) FILTER (ap IS NOT NULL AND bp IS NOT NULL) AS paired, count(*) FILTER (aq = bq) AS digest_equal, max(abs(ap-bp)) AS max_norm_delta FROM j GROUP BY 1""",
)
def _(spark, sf):
    rows = line_spans(spark, sf).withColumn("digest", row_hash(F.col("quantity")))
    pairs = pr.multiset_pairing(rows.filter("status = 'O'"), rows.filter("status = 'F'"), ["trace", "phase"], ["price", "quantity", "span_id"], "digest", "price")
    return pairs.groupBy("phase").agg(F.count(F.lit(1)).alias("slots"), F.count_if("paired").alias("paired"), F.count_if("digest_equal").alias("digest_equal"), F.max("norm_delta").alias("max_norm_delta"))


OPS = """op AS (SELECT stream, kind, seq, arrival_ns, cents % 6 AS new_value, lag(cents % 6) OVER (PARTITION BY stream, kind ORDER BY seq) AS old_value, arrival_ns // 86400000000000 AS segment FROM ev)"""


def operations(spark, sf):
    """Operation log per (stream, kind): each event changes the value its predecessor set; the segment is the day."""
    rows = sequenced(spark, sf).withColumn("new_value", F.col("cents") % 6)
    rows = ordered_scan(rows, ["stream", "kind"], ["seq"], lag={"old_value": "new_value"})
    return rows.select("stream", "kind", "seq", "arrival_ns", "old_value", "new_value", whole(F.col("arrival_ns"), 86_400_000_000_000).alias("segment"))


@query(
    "value_chain_pairs",
    f"""WITH {EV}, {OPS}, l AS (SELECT * FROM op WHERE old_value IS NOT NULL AND old_value <> new_value)
 SELECT a.stream, a.kind, a.seq AS first, b.seq AS second, b.old_value AS via_value, a.segment AS first_segment, b.segment AS second_segment
 FROM l a JOIN l b ON a.stream = b.stream AND a.kind = b.kind AND a.new_value = b.old_value AND a.seq < b.seq WHERE a.segment <> b.segment AND a.old_value <> b.new_value""",
)
def _(spark, sf):
    return pr.value_chain_pairs(operations(spark, sf), ["stream", "kind"], "seq", "old_value", "new_value", "segment")


@query(
    "value_chain_counts",
    f"""WITH {EV}, {OPS}, l AS (SELECT * FROM op WHERE old_value IS NOT NULL AND old_value <> new_value)
 SELECT b.stream, b.kind, b.seq, b.old_value AS via_value, b.segment, count(a.seq) FILTER (a.segment <> b.segment AND a.old_value <> b.new_value) AS pair_count, max(a.seq) AS same_value_pos, arg_max(a.segment, a.seq) AS same_value_segment
 FROM l b LEFT JOIN l a ON a.stream=b.stream AND a.kind=b.kind AND a.new_value=b.old_value AND a.seq<b.seq GROUP BY ALL""",
)
def _(spark, sf):
    return pr.value_chains(operations(spark, sf), ["stream", "kind"], "seq", "old_value", "new_value", "segment")


@query(
    "segment_overlap_semi",
    f"""WITH {EV}, {OPS}, t AS (SELECT DISTINCT stream, segment FROM op WHERE old_value IS NOT NULL AND new_value = 5), q AS (SELECT stream, event_id, unnest([arrival_ns//86400000000000, arrival_ns//86400000000000 + 1]) AS segment FROM ev)
 SELECT q.stream, event_id, count(DISTINCT q.segment) AS shared_segments FROM q JOIN t USING (stream, segment) GROUP BY ALL""",
)
def _(spark, sf):
    day = whole(F.col("arrival_ns"), 86_400_000_000_000)
    questions = lifecycle(spark, sf).select("stream", "event_id", F.array(day, day + 1).alias("segments"))
    moves = operations(spark, sf).filter("old_value IS NOT NULL AND new_value = 5")
    return pr.segment_overlap_semi(questions, ["stream", "event_id"], "segments", moves, ["stream"], "segment")


@query(
    "predecessor_lead",
    f"""WITH {EV}, p AS (SELECT stream, seq, lag(publish_ns) OVER (PARTITION BY stream ORDER BY seq) - start_ns AS lead_ns FROM ev) SELECT *, coalesce(lead_ns > 0, false) AS opportunity FROM p""",
)
def _(spark, sf):
    return pr.predecessor_lead(sequenced(spark, sf), ["stream"], "seq", "start_ns", "publish_ns")


@query(
    "choice_set_at_start",
    f"""WITH {EV} SELECT a.stream, a.event_id, count(*) AS width, bool_or(b.cents > a.cents AND b.start_ns > a.start_ns) AS heavier_waited
 FROM ev a JOIN ev b ON a.stream=b.stream AND b.arrival_ns <= a.start_ns AND (b.start_ns > a.start_ns OR (b.start_ns = a.start_ns AND b.event_id >= a.event_id)) GROUP BY ALL""",
)
def _(spark, sf):
    return pr.choice_set_at_start(lifecycle(spark, sf), ["stream"], "event_id", "arrival_ns", "start_ns", "cents")


BRANDS = """un AS (SELECT o_orderkey AS unit, o_custkey AS ns, lag(o_orderkey) OVER (PARTITION BY o_custkey % 100 ORDER BY o_orderdate, o_orderkey) AS frontier, lag(o_custkey) OVER (PARTITION BY o_custkey % 100 ORDER BY o_orderdate, o_orderkey) AS fns FROM orders),
 nm AS (SELECT DISTINCT l_orderkey AS unit, p_brand AS name FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def unit_pairs(spark, sf):
    """Each order with the one before it in its group of customers."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("unit"), F.col("o_custkey").alias("candidate_ns"), (F.col("o_custkey") % 100).alias("g"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("at"))
    rows = ordered_scan(orders, ["g"], ["at", "unit"], lag={"frontier": "unit", "frontier_ns": "candidate_ns"})
    return rows.filter(F.col("frontier").isNotNull()).select("frontier", F.col("unit").alias("candidate"), "frontier_ns", "candidate_ns")


WINDOW, HOT_FROM = 12, 3


@query(
    "conflict_pairs",
    f"""WITH {BRANDS}, pb AS (SELECT o_orderkey AS unit, o_custkey % 100 AS g, row_number() OVER (PARTITION BY o_custkey % 100 ORDER BY o_orderdate, o_orderkey) AS place FROM orders),
 pr AS (SELECT frontier, unit AS candidate, CASE WHEN frontier % 31 <> 0 THEN fns % 3 END AS fn, ns % 3 AS cn, unit % 20 <> 0 AS complete FROM un WHERE frontier IS NOT NULL),
 xi AS (SELECT DISTINCT l_orderkey AS unit, l_suppkey // 4 AS item FROM lineitem WHERE l_orderkey % 7 <> 0),
 sn AS (SELECT frontier, candidate, count(*) AS n FROM pr JOIN nm a ON a.unit = frontier JOIN nm b ON b.unit = candidate AND a.name = b.name GROUP BY ALL),
 si AS (SELECT frontier, candidate, count(*) AS n FROM pr JOIN xi a ON a.unit = frontier JOIN xi b ON b.unit = candidate AND a.item = b.item GROUP BY ALL),
 al AS (SELECT unit, 'n' || name AS item FROM nm UNION ALL SELECT unit, 'i' || item FROM xi),
 hi AS (SELECT candidate, al.item FROM pr JOIN pb c ON c.unit = candidate JOIN al ON al.unit = candidate JOIN pb p ON p.g = c.g AND p.place < c.place AND p.place >= c.place - {WINDOW} JOIN al o ON o.unit = p.unit AND o.item = al.item GROUP BY ALL HAVING count(*) >= {HOT_FROM}),
 ho AS (SELECT candidate, count(*) AS n FROM hi GROUP BY 1),
 j AS (SELECT pr.*, coalesce(sn.n, 0) AS a, coalesce(si.n, 0) AS b, coalesce(ho.n, 0) AS h FROM pr LEFT JOIN sn USING (frontier, candidate) LEFT JOIN si USING (frontier, candidate) LEFT JOIN ho USING (candidate)),
 r AS (SELECT *, CASE WHEN NOT complete THEN 'INCOMPLETE_SIGNAL' WHEN fn IS NULL OR cn IS NULL THEN 'NAMESPACE_UNKNOWN' WHEN fn <> cn THEN 'NAMESPACE_ISOLATED' WHEN a > 0 THEN 'DIRECT_ENTITY_OVERLAP' WHEN b > 0 THEN 'EXISTING_CANDIDATE_ID_OVERLAP' WHEN h > 0 THEN 'RECENT_HOT_ENTITY' ELSE 'KNOWN_DISJOINT' END AS reason FROM j)
 SELECT frontier, candidate, CASE WHEN reason = 'DIRECT_ENTITY_OVERLAP' THEN a ELSE 0 END AS shared_names, CASE WHEN reason = 'EXISTING_CANDIDATE_ID_OVERLAP' THEN b ELSE 0 END AS shared_ids, CASE WHEN reason = 'RECENT_HOT_ENTITY' THEN h ELSE 0 END AS hot_items,
 CASE reason WHEN 'INCOMPLETE_SIGNAL' THEN 'UNKNOWN' WHEN 'NAMESPACE_UNKNOWN' THEN 'UNKNOWN' WHEN 'NAMESPACE_ISOLATED' THEN 'LOW_CONFLICT' WHEN 'KNOWN_DISJOINT' THEN 'LOW_CONFLICT' ELSE 'HIGH_CONFLICT' END AS conflict_class, reason FROM r""",
)
def _(spark, sf):
    pairs = unit_pairs(spark, sf).select("frontier", "candidate", F.when(F.col("frontier") % 31 != 0, F.col("frontier_ns") % 3).alias("frontier_ns"), (F.col("candidate_ns") % 3).alias("candidate_ns"), (F.col("candidate") % 20 != 0).alias("complete"))
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat(F.lit("n"), "p_brand").alias("item"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("unit"), "l_partkey", "l_suppkey")
    names = lines.join(parts, "l_partkey").select("unit", "item").distinct()
    ids = lines.filter("unit % 7 <> 0").select("unit", F.concat(F.lit("i"), F.call_function("div", F.col("l_suppkey"), F.lit(4))).alias("item")).distinct()
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("unit"), (F.col("o_custkey") % 100).alias("g"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("at"))
    placed = ordered_scan(orders, ["g"], ["at", "unit"], rank="place").select("unit", "g", "place")
    items = cut_lineage(placed.join(names.unionByName(ids), "unit"), "items")
    names, ids = (items.filter(F.startswith("item", F.lit(kind))).select("unit", "item") for kind in ("n", "i"))
    # a unit is judged when all before it in its group are published
    asked = items.withColumn("place", F.col("place") - 1).withColumnRenamed("unit", "candidate")
    hot = pr.recent_hot_items(items, asked, "g", "place", ["item"], "candidate", window=WINDOW, threshold=HOT_FROM)
    return pr.conflict_pairs(pairs, names, ids, hot, "unit", "frontier", "candidate", "item")


@query(
    "scope_conflict_pairs",
    f"""WITH {BRANDS}, pr AS (SELECT frontier, unit AS candidate, fns % 5 = ns % 5 AS same, unit % 20 <> 0 AS complete FROM un WHERE frontier IS NOT NULL),
 sc AS (SELECT l_orderkey AS unit, l_suppkey AS item, bool_or(l_linestatus='O') AS w FROM lineitem GROUP BY ALL),
 h AS (SELECT frontier, candidate, bool_or(a.w OR b.w) AS hit FROM pr JOIN sc a ON a.unit=frontier JOIN sc b ON b.unit=candidate AND a.item=b.item WHERE same GROUP BY ALL)
 SELECT frontier, candidate, CASE WHEN NOT same THEN 'NON_CONFLICTING' WHEN hit THEN 'CONFLICTING' WHEN NOT complete THEN 'UNKNOWN' ELSE 'NON_CONFLICTING' END AS conflict_class FROM pr LEFT JOIN h USING (frontier, candidate)""",
)
def _(spark, sf):
    pairs = unit_pairs(spark, sf).select("frontier", "candidate", (F.col("frontier_ns") % 5 == F.col("candidate_ns") % 5).alias("same_namespace"), (F.col("candidate") % 20 != 0).alias("complete"))
    scopes = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("unit"), F.col("l_suppkey").alias("item"), F.when(F.col("l_linestatus") == "O", "write").otherwise("read").alias("effect"))
    return pr.scope_conflict_pairs(pairs, scopes, "unit", "frontier", "candidate", "item", "effect")


@query(
    "attach_paired_diffs",
    f"""WITH {LINES}, k AS (SELECT trace, phase, quantity, count(*) FILTER (status='O') > 0 AS a, count(*) FILTER (status='F') > 0 AS b FROM lines GROUP BY ALL), d AS (SELECT trace, count(*) FILTER (a<>b) AS edge_key_diff, 0::BIGINT AS other FROM k GROUP BY 1),
 m AS (SELECT trace, status AS method, CAST(sum(price) AS BIGINT) AS makespan FROM lines GROUP BY ALL) SELECT trace, method, makespan, edge_key_diff, edge_key_diff = 0 AS canonical_exact_match FROM m JOIN d USING (trace)""",
)
def _(spark, sf):
    from tidemark.operators.snapshots import symmetric_difference

    rows = line_spans(spark, sf)
    diffs = symmetric_difference(rows.filter("status = 'O'"), rows.filter("status = 'F'"), ["phase", "quantity"], ["trace"], "edge_key_diff")
    blocks = rows.groupBy("trace", F.col("status").alias("method")).agg(F.sum("price").alias("makespan"))
    return pr.attach_paired_diffs(blocks, diffs, "trace", ["edge_key_diff"])


#: Rows that a task numbers and counts.
OBSERVED_ROWS = 500_000


@query(
    "observability_rows_by_source",
    f"""WITH {EV}, q AS (SELECT stream, seq FROM ev WHERE event_id % 33 <> 0 UNION ALL SELECT stream, seq FROM ev WHERE event_id % 44 = 0), g AS (SELECT stream, seq FROM ev), s AS (SELECT stream, seq FROM ev WHERE cents % 2 = 0),
 u AS (SELECT *, 'q' AS t FROM q UNION ALL SELECT *, 'g' FROM g UNION ALL SELECT *, 's' FROM s UNION ALL SELECT *, 's' FROM s)
 SELECT stream, seq, count(*) FILTER (t='q') AS queue_rows, count(*) FILTER (t='g') AS graph_work_rows, count(*) FILTER (t='s') AS span_rows, count(*) FILTER (t='q') = 1 AND count(*) FILTER (t='g') = 1 AS joined_exactly_once FROM u GROUP BY ALL""",
)
def _(spark, sf):
    e, one = F.col("event_id"), lambda c: c.cast("int")
    queue = one(e % 33 != 0) + one(e % 44 == 0)
    rows = sequenced(spark, sf, share=OBSERVED_ROWS)
    return pr.observability_by_source(rows, {"queue": queue, "graph_work": F.lit(1)}, {"span": one(F.col("cents") % 2 == 0) * 2}, ["stream", "seq"])


@query(
    "read_before_durable",
    f"""WITH {EV}, d AS (SELECT stream, seq, seq - 1 - cents % 3 AS pre FROM ev WHERE seq - 1 - cents % 3 >= 0),
 f AS (SELECT a.stream, a.seq, coalesce(max(b.seq), -1) AS durable_frontier FROM ev a LEFT JOIN ev b ON a.stream=b.stream AND b.publish_ns <= a.start_ns GROUP BY ALL),
 o AS (SELECT a.stream, count(*) AS overlap_pairs FROM ev a JOIN ev b ON a.stream=b.stream AND a.seq<b.seq AND a.start_ns<b.publish_ns GROUP BY 1),
 u AS (SELECT stream, coalesce(bool_or(p > seq), false) AS unordered FROM (SELECT stream, seq, lag(seq) OVER (PARTITION BY stream ORDER BY start_ns, seq) AS p FROM ev) GROUP BY 1)
 SELECT d.stream, d.seq, d.pre AS predecessor, e.start_ns AS first_read, p.publish_ns AS predecessor_published, durable_frontier, coalesce(e.start_ns < p.publish_ns, false) AS read_before_durable, overlap_pairs, unordered
 FROM d JOIN ev e ON d.stream=e.stream AND d.seq=e.seq LEFT JOIN ev p ON d.stream=p.stream AND d.pre=p.seq JOIN f ON f.stream=d.stream AND f.seq=d.seq JOIN o ON o.stream=d.stream JOIN u ON u.stream=d.stream""",
)
def _(spark, sf):
    rows = sequenced(spark, sf)
    need = rows.select("stream", "seq", (F.col("seq") - 1 - F.col("cents") % 3).alias("predecessor")).filter("predecessor >= 0")
    out = pr.read_before_durable(rows, need, ["stream"], "seq", "predecessor", "start_ns", "publish_ns")
    overlaps = pr.started_before_later_end(rows, ["stream"], "seq", "start_ns", "publish_ns")
    return out.join(overlaps, "stream").join(pr.unordered_admission(rows, ["stream"], "seq", "start_ns"), "stream")


@query(
    "transition_to_sequence",
    f"""WITH {EV}, {OPS}, l AS (SELECT * FROM op WHERE old_value IS NOT NULL AND old_value <> new_value),
 c AS (SELECT b.stream, b.kind, b.seq, b.segment AS new_segment, arg_max(a.segment, a.seq) AS old_segment FROM l b JOIN l a ON a.stream=b.stream AND a.kind=b.kind AND a.new_value=b.old_value AND a.seq<b.seq GROUP BY ALL), s AS (SELECT stream, segment, dense_rank() OVER (PARTITION BY stream ORDER BY segment) - 1 AS q FROM (SELECT DISTINCT stream, segment FROM op WHERE segment % 7 <> 0))
 SELECT c.stream, c.kind, c.seq, o.q AS old_sequence, n.q AS new_sequence FROM c JOIN s o ON c.stream=o.stream AND c.old_segment=o.segment JOIN s n ON c.stream=n.stream AND c.new_segment=n.segment""",
)
def _(spark, sf):
    ops = operations(spark, sf)
    chains = pr.value_chains(ops, ["stream", "kind"], "seq", "old_value", "new_value", "segment").filter("same_value_pos IS NOT NULL")
    chains = chains.withColumnsRenamed({"segment": "new_segment", "same_value_segment": "old_segment"})
    days = ordered_scan(ops.filter(F.col("segment") % 7 != 0).select("stream", "segment").distinct(), ["stream"], ["segment"], rank="q").withColumn("q", F.col("q") - 1)
    return pr.transition_to_sequence(chains, days, ["stream"], "segment", "old_segment", "new_segment", "q").select("stream", "kind", "seq", "old_sequence", "new_sequence")
