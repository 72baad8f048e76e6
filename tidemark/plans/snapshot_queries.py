"""Queries over graph snapshots and the state of facts over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.digests import framed_sql, multiset_digest_sql, row_hash_sql
from tidemark.operators import snapshots as sn
from tidemark.operators import temporal as tm
from tidemark.operators.ordered import ordered_scan
from tidemark.plans.inputs import EV, lifecycle, nanos, sequenced, table
from tidemark.plans.join_queries import OPS, operations
from tidemark.plans.registry import query
from tidemark.plans.statistic_queries import rounded

GRAPH = """gr AS (SELECT l_linestatus AS side, l_returnflag AS phase, l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS quantity, epoch_us(l_shipdate)*1000 AS ship_ns FROM lineitem)"""


def graph_rows(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("side"), F.col("l_returnflag").alias("phase"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("quantity"), nanos("l_shipdate").alias("ship_ns")
    )


def sides(spark, sf):
    rows = graph_rows(spark, sf)
    return rows.filter("side = 'O'"), rows.filter("side = 'F'")


def diff_sql(columns: str) -> str:
    return f"SELECT phase, count(*) FILTER (a<>b) AS n, count(*) FILTER (a AND b) AS m, count(*) FILTER (a) AS l, count(*) FILTER (b) AS r FROM (SELECT phase, {columns}, bool_or(side='O') AS a, bool_or(side='F') AS b FROM gr GROUP BY ALL) GROUP BY 1"


@query("symmetric_difference_count", f"WITH {GRAPH} SELECT phase, n AS difference FROM ({diff_sql('l_suppkey, quantity')})")
def _(spark, sf):
    a, b = sides(spark, sf)
    return sn.symmetric_difference(a, b, ["l_suppkey", "quantity"], ["phase"])


@query(
    "canonical_diff",
    f"""WITH {GRAPH}, a AS ({diff_sql('l_suppkey')}), b AS ({diff_sql('l_suppkey, l_partkey')}), c AS ({diff_sql('l_suppkey, quantity')}), d AS ({diff_sql('l_suppkey, ship_ns')}), e AS ({diff_sql('l_orderkey')})
 SELECT phase, a.n AS entity_key, b.n AS edge_key, c.n AS attribute, d.n AS temporal, e.n AS source_link, CAST(a.n+b.n+c.n+d.n+e.n AS BIGINT) AS total_diff, a.n+b.n+c.n+d.n+e.n = 0 AS exact_match FROM a JOIN b USING (phase) JOIN c USING (phase) JOIN d USING (phase) JOIN e USING (phase)""",
)
def _(spark, sf):
    a, b = sides(spark, sf)
    parts = {"entity_key": ["l_suppkey"], "edge_key": ["l_suppkey", "l_partkey"], "attribute": ["l_suppkey", "quantity"], "temporal": ["l_suppkey", "ship_ns"], "source_link": ["l_orderkey"]}
    return sn.canonical_diff({"rows": a}, {"rows": b}, {n: ("rows", c) for n, c in parts.items()}, ["phase"])


@query(
    "graph_compare",
    f"""WITH {GRAPH}, t AS (SELECT phase, count(*) FILTER (side='O') = count(*) FILTER (side='F') AS cm FROM gr GROUP BY 1), p AS (SELECT 'entities' AS part, * FROM ({diff_sql('l_suppkey')}) UNION ALL SELECT 'edges', * FROM ({diff_sql('l_suppkey, l_partkey, quantity')}) UNION ALL SELECT 'episodes', * FROM ({diff_sql('l_orderkey')}))
 SELECT phase, part, m AS matched, l AS left_size, r AS right_size, cm AS count_matches, n = 0 AS exact_match, round(CAST(m AS DOUBLE)/r,6) AS precision, round(CAST(m AS DOUBLE)/l,6) AS recall, round(CASE WHEN m > 0 THEN 2.0*m/(l+r) ELSE 0 END,6) AS f1 FROM p JOIN t USING (phase)""",
)
def _(spark, sf):
    a, b = sides(spark, sf)
    columns = {"entities": ["l_suppkey"], "edges": ["l_suppkey", "l_partkey", "quantity"], "episodes": ["l_orderkey"]}
    tables = lambda d: {n: d for n in columns}
    return rounded(sn.graph_compare(tables(a), tables(b), columns, ["phase"]), 6, "precision", "recall", "f1")


@query(
    "graph_hash",
    f"""WITH {GRAPH}, u AS (SELECT side, {framed_sql("'edges'", 'l_suppkey', 'l_partkey', 'quantity')} AS v FROM gr UNION ALL SELECT side, {framed_sql("'episodes'", 'l_orderkey')} FROM gr) SELECT side, count(*) AS rows, {multiset_digest_sql('v')} AS graph_hash FROM u GROUP BY 1""",
)
def _(spark, sf):
    rows = graph_rows(spark, sf)
    return sn.graph_hash({"edges": rows, "episodes": rows}, {"edges": ["l_suppkey", "l_partkey", "quantity"], "episodes": ["l_orderkey"]}, ["side"])


@query(
    "graph_integrity_counts",
    """WITH o AS (SELECT o_orderkey AS k, o_custkey % 5 AS ns, o_custkey, o_orderdate FROM orders), ex AS (SELECT ns, k AS name FROM o), ep AS (SELECT ns, k AS name, k AS episode_id FROM o WHERE k % 31 <> 0 UNION ALL SELECT ns, k, k FROM o WHERE k % 37 = 0 UNION ALL SELECT ns, k + 10000000, k + 10000000 FROM o WHERE k % 41 = 0),
 en AS (SELECT 'c' || c_custkey AS node, c_custkey % 5 AS home FROM customer UNION ALL SELECT 's' || s_suppkey || '-' || g, g FROM supplier, (SELECT unnest(range(5)) AS g) WHERE s_suppkey % 17 <> 0),
 ed AS (SELECT o.ns, 'c' || CASE WHEN k % 43 = 0 THEN o_custkey + 1 ELSE o_custkey END AS source, 's' || l_suppkey || '-' || o.ns AS target, o_orderdate AS va, l_shipdate AS ia, CASE WHEN k % 47 = 0 THEN k + 1 ELSE k END AS pv FROM lineitem JOIN o ON l_orderkey = k),
 c AS (SELECT ns, count(*) FILTER (e AND n=0) AS lost_episodes, CAST(sum(CASE WHEN e THEN greatest(n-1,0) ELSE 0 END) AS BIGINT) AS duplicate_episodes, count(*) FILTER (NOT e) AS unexpected_episodes FROM (SELECT coalesce(ex.ns, ep.ns) AS ns, coalesce(ex.name, ep.name) AS name, bool_or(ex.name IS NOT NULL) AS e, count(ep.name) AS n FROM ex FULL JOIN ep ON ex.ns=ep.ns AND ex.name=ep.name GROUP BY ALL) GROUP BY 1),
 p AS (SELECT ns, count(*) FILTER (home IS NULL) AS endpoint_missing, count(*) FILTER (home <> ns) AS endpoint_escape FROM (SELECT ns, source AS node FROM ed UNION ALL SELECT ns, target FROM ed) LEFT JOIN en USING (node) GROUP BY 1),
 v AS (SELECT ed.ns, count(*) FILTER (x.ns IS NULL) AS provenance_dangling, count(*) FILTER (x.ns <> ed.ns) AS provenance_cross_namespace FROM ed LEFT JOIN (SELECT DISTINCT episode_id, ns FROM ep) x ON x.episode_id = ed.pv GROUP BY 1), r AS (SELECT ns, count(*) FILTER (ia < va) AS validity_reversed FROM ed GROUP BY 1)
 SELECT c.*, endpoint_missing, endpoint_escape, provenance_dangling, provenance_cross_namespace, validity_reversed FROM c JOIN p USING (ns) JOIN v USING (ns) JOIN r USING (ns)""",
)
def _(spark, sf):
    k = F.col("k")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 5).alias("ns"), "o_custkey", F.col("o_orderdate").alias("valid_at"))
    named = orders.select("ns", k.alias("name"), k.alias("episode_id"))
    odd = named.filter(F.col("name") % 41 == 0).select("ns", (F.col("name") + 10_000_000).alias("name"), (F.col("name") + 10_000_000).alias("episode_id"))
    episodes = named.filter(F.col("name") % 31 != 0).unionByName(named.filter(F.col("name") % 37 == 0)).unionByName(odd)
    customers = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), (F.col("c_custkey") % 5).cast("long").alias("ns"))
    spread = F.explode(F.array(*[F.lit(g).cast("long") for g in range(5)]))
    suppliers = table(spark, sf, "supplier").filter(F.col("s_suppkey") % 17 != 0).select("s_suppkey", spread.alias("ns")).select(F.concat(F.lit("s"), "s_suppkey", F.lit("-"), "ns").alias("node"), "ns")
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), "l_suppkey", F.col("l_shipdate").alias("invalid_at"))
    edges = lines.join(orders, "k").select(
        "ns", F.col("k").alias("edge_id"), F.concat(F.lit("c"), F.when(k % 43 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))).alias("source"), F.concat(F.lit("s"), "l_suppkey", F.lit("-"), "ns").alias("target"), "valid_at", "invalid_at"
    )
    proof = edges.select("ns", "edge_id", F.when(F.col("edge_id") % 47 == 0, F.col("edge_id") + 1).otherwise(F.col("edge_id")).alias("episode_id"))
    return sn.graph_integrity_counts(named.select("ns", "name"), episodes, customers.unionByName(suppliers), edges, proof, "ns")


@query(
    "semantic_diff",
    f"""WITH {GRAPH}, k AS (SELECT phase, l_suppkey, l_partkey, bool_or(side='O') AS a, bool_or(side='F') AS b FROM gr GROUP BY ALL), c AS (SELECT phase, CASE WHEN NOT a THEN 'added' ELSE 'removed' END AS change, l_suppkey, l_partkey FROM k WHERE a<>b),
 r AS (SELECT *, count(*) OVER (PARTITION BY phase, change) AS changes, row_number() OVER (PARTITION BY phase, change ORDER BY l_suppkey, l_partkey) AS example FROM c) SELECT phase, change, changes, example, l_suppkey, l_partkey FROM r WHERE example <= 5""",
)
def _(spark, sf):
    a, b = sides(spark, sf)
    return sn.semantic_diff(a, b, ["l_suppkey", "l_partkey"], ["l_suppkey", "l_partkey"], 5, ["phase"])


@query(
    "fingerprint_records",
    f"""WITH {EV}, r AS (SELECT stream, {row_hash_sql('cents', 'kind')} AS h, row_number() OVER (PARTITION BY stream ORDER BY publish_ns, event_id) AS p FROM ev)
 SELECT stream, count(*) AS records, {multiset_digest_sql('h')} AS membership_digest, {multiset_digest_sql("concat_ws('|', p, h)")} AS ordered_digest FROM r GROUP BY 1""",
)
def _(spark, sf):
    return sn.fingerprint_records(lifecycle(spark, sf), ["stream"], ["publish_ns", "event_id"], ["kind", "cents"])


@query(
    "union_streams",
    f"""WITH {EV}, u AS (SELECT 'arrivals' AS producer, stream, arrival_ns AS ts, cents, NULL AS kind FROM ev UNION ALL SELECT 'publications', stream, publish_ns, NULL, kind FROM ev)
 SELECT stream, ts, producer, cents, kind, row_number() OVER (PARTITION BY stream ORDER BY ts, producer, coalesce(cents,-1), coalesce(kind,'')) AS position FROM u""",
)
def _(spark, sf):
    rows = lifecycle(spark, sf)
    a = rows.select(F.lit("arrivals").alias("producer"), "stream", F.col("arrival_ns").alias("ts"), "cents")
    b = rows.select(F.lit("publications").alias("producer"), "stream", F.col("publish_ns").alias("ts"), "kind")
    return sn.union_streams([a, b], ["stream"], ["ts", "producer", "cents", "kind"])


@query(
    "multiset_coverage",
    f"""WITH {GRAPH}, m AS (SELECT phase, l_suppkey, quantity, count(*) FILTER (side='O') AS e, count(*) FILTER (side='F') AS o FROM gr GROUP BY ALL)
 SELECT phase, CAST(sum(e) AS BIGINT) AS expected_copies, CAST(sum(o) AS BIGINT) AS observed_copies, CAST(sum(greatest(0,e-o)) AS BIGINT) AS lost, CAST(sum(CASE WHEN e>0 THEN greatest(0,o-e) ELSE 0 END) AS BIGINT) AS duplicate, CAST(sum(CASE WHEN e=0 THEN o ELSE 0 END) AS BIGINT) AS unexpected FROM m GROUP BY 1""",
)
def _(spark, sf):
    a, b = sides(spark, sf)
    return sn.multiset_coverage(a, b, ["phase"], ["l_suppkey", "quantity"])


@query(
    "run_equivalence",
    f"""WITH {EV}, a AS (SELECT stream, seq, cents, kind, CAST(arrival_ns AS VARCHAR) AS ats FROM ev), b AS (SELECT stream, seq, CASE WHEN stream % 9 = 1 AND seq = 3 THEN cents + 1 ELSE cents END AS cents, CASE WHEN stream % 11 = 2 AND seq = 0 THEN 'zz' ELSE kind END AS kind, ats, CASE WHEN stream % 13 = 3 AND seq < 2 THEN 1 ELSE 0 END AS writes FROM a)
 SELECT a.stream, 'cents' AS field, 'FIELD_DIFFERS' AS finding, 1::BIGINT AS n FROM a JOIN b USING (stream, seq) GROUP BY 1 HAVING bool_or(a.cents<>b.cents) UNION ALL SELECT a.stream, 'kind', 'FIELD_DIFFERS', 1 FROM a JOIN b USING (stream, seq) GROUP BY 1 HAVING bool_or(a.kind<>b.kind)
 UNION ALL SELECT stream, 'writes', 'FORBIDDEN_EFFECT', CAST(sum(writes) AS BIGINT) FROM b GROUP BY 1 HAVING sum(writes) > 0""",
)
def _(spark, sf):
    s, q = F.col("stream"), F.col("seq")
    base = sequenced(spark, sf).select("stream", "seq", "cents", "kind", "arrival_ns")
    other = base.withColumns(
        {"cents": F.when((s % 9 == 1) & (q == 3), F.col("cents") + 1).otherwise(F.col("cents")), "kind": F.when((s % 11 == 2) & (q == 0), "zz").otherwise(F.col("kind")), "writes": F.when((s % 13 == 3) & (q < 2), 1).otherwise(0)}
    )
    return sn.run_equivalence(base, other, ["stream"], ["seq"], ["cents", "kind", "arrival_ns"], ["writes"])


@query(
    "candidate_list_diff",
    """WITH a AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS p FROM documents), b AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars + doc_id % 700 DESC, doc_id) AS p FROM documents WHERE doc_id % 53 <> 7 OR source = 'src1'),
 x AS (SELECT * FROM a), y AS (SELECT * FROM b), s AS (SELECT source, count(x.p) AS requested_size, count(y.p) AS expected_size, count(*) FILTER (x.doc_id IS DISTINCT FROM y.doc_id) AS substitutions FROM x FULL JOIN y USING (source, p) GROUP BY 1),
 c AS (SELECT source, x.p AS pa, y.p AS pb FROM x JOIN y USING (source, doc_id)), o AS (SELECT source, bool_or(l > pb) AS f FROM (SELECT source, pb, lag(pb) OVER (PARTITION BY source ORDER BY pa) AS l FROM c) GROUP BY 1), n AS (SELECT source, count(*) AS common FROM c GROUP BY 1)
 SELECT source, requested_size, expected_size, substitutions, common < requested_size OR common < expected_size AS membership_changed, coalesce(common,0) AS common, coalesce(f,false) AS common_order_changed, NOT (common < requested_size OR common < expected_size) AND substitutions > 0 AS order_changed FROM s LEFT JOIN o USING (source) LEFT JOIN n USING (source)""",
)
def _(spark, sf):
    from tidemark.plans.retrieval_queries import ranked_docs

    a, b, _g = ranked_docs(spark, sf)
    # The second run lacks some documents of most sources, so its later ranks move up.
    left = ordered_scan(b.filter("doc_id % 53 <> 7 OR source = 'src1'").drop("rank").join(a.select("source", "doc_id", F.col("rank").alias("_old")), ["source", "doc_id"]).join(b.select("source", "doc_id", F.col("rank").alias("_r")), ["source", "doc_id"]), ["source"], ["_r"], rank="rank")
    return sn.candidate_list_diff(a, left.select("source", "doc_id", "rank"), ["source"], "rank", "doc_id")


FACTS = """fx AS (SELECT o_custkey AS question, l_suppkey % 10 AS target, l_returnflag AS relation, CASE WHEN l_linenumber % 2 = 0 THEN 'Q  ' ELSE 'q ' END || (CAST(l_quantity AS BIGINT) % 3) AS fact, CASE WHEN l_linenumber <> 4 THEN epoch_us(o_orderdate)*1000 END AS valid_at, CASE WHEN l_linestatus='F' THEN epoch_us(l_shipdate)*1000 END AS invalid_at,
 epoch_us(o_orderdate)*1000 AS reference_time, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rank FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 fs AS (SELECT *, lower(regexp_replace(fact, '\\s+', ' ', 'g')) AS norm, CASE WHEN coalesce(invalid_at <= 900000000000000000, false) THEN 'stale' WHEN coalesce(valid_at > 900000000000000000, false) OR (valid_at IS NULL AND reference_time > 900000000000000000) THEN 'future' ELSE 'active' END AS status FROM fx)"""
AT_NS = 900_000_000_000_000_000


def facts(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("question"), nanos("o_orderdate").alias("reference_time"))
    rows = table(spark, sf, "lineitem").join(orders, "l_orderkey").select(
        "question",
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
        (F.col("l_suppkey") % 10).alias("target"),
        F.col("l_returnflag").alias("relation"),
        F.concat(F.when(F.col("l_linenumber") % 2 == 0, "Q  ").otherwise("q "), F.col("l_quantity").cast("long") % 3).alias("fact"),
        F.when(F.col("l_linenumber") != 4, F.col("reference_time")).alias("valid_at"),
        F.when(F.col("l_linestatus") == "F", nanos("l_shipdate")).alias("invalid_at"),
        "reference_time",
    )
    ranked = ordered_scan(rows, ["question"], ["reference_time", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], rank="rank")
    status = tm.temporal_status(F.lit(AT_NS), F.col("valid_at"), F.col("invalid_at"), F.lit(None).cast("long"), F.col("reference_time"))
    return ranked.withColumn("status", status)


@query("temporal_status", f"WITH {FACTS} SELECT question, rank, status FROM fs")
def _(spark, sf):
    return facts(spark, sf).select("question", "rank", "status")


@query("conflicting_groups", f"WITH {FACTS} SELECT question, target, relation, count(DISTINCT norm) AS distinct_facts, count(*) AS facts FROM fs GROUP BY ALL HAVING count(DISTINCT norm) > 1")
def _(spark, sf):
    return tm.conflicting_groups(facts(spark, sf), ["question", "target", "relation"], "fact")


@query(
    "latest_valid_fact",
    f"""WITH {FACTS}, c AS (SELECT question, target, relation FROM fs GROUP BY ALL HAVING count(DISTINCT norm) > 1), m AS (SELECT fs.* FROM fs JOIN c USING (question, target, relation)),
 l AS (SELECT question, target, relation, rank AS latest_rank FROM (SELECT *, row_number() OVER (PARTITION BY question, target, relation ORDER BY coalesce(valid_at, reference_time) DESC, rank) AS k FROM m WHERE status='active') WHERE k = 1)
 SELECT m.question, m.target, m.relation, latest_rank, count(*) FILTER (status='stale' AND rank < latest_rank) AS stale_before_latest FROM m JOIN l USING (question, target, relation) GROUP BY ALL""",
)
def _(spark, sf):
    return tm.latest_valid_fact(facts(spark, sf), ["question", "target", "relation"], "fact", "status", "rank", "valid_at", "reference_time")


STATES = f"""{EV}, {OPS}, lt AS (SELECT stream, arg_max(new_value, seq) AS latest_value FROM op GROUP BY 1), sv AS (SELECT DISTINCT stream, new_value AS stale_value FROM op JOIN lt USING (stream) WHERE new_value <> latest_value)"""


@query("latest_and_stale_values", f"WITH {EV}, {OPS}, lt AS (SELECT stream, arg_max(new_value, seq) AS latest_value FROM op GROUP BY 1) SELECT DISTINCT stream, latest_value, new_value AS stale_value FROM op JOIN lt USING (stream) WHERE new_value <> latest_value")
def _(spark, sf):
    latest, stale = tm.latest_and_stale_values(operations(spark, sf), ["stream"], ["seq"], "new_value")
    return latest.join(stale, "stream")


@query(
    "inspect_current_state",
    f"""WITH {STATES}, e AS (SELECT stream, event_id, kind, cents % 2 AS rel, 'Set VAL' || (cents % 6) || ' from val' || (cents % 5) || '.' AS text, arrival_ns <= 1704800000000000000 AND NOT (event_id % 3 = 0 AND publish_ns <= 1704800000000000000) AS act FROM ev),
 j AS (SELECT e.*, contains(lower(text), 'val' || latest_value) AS cur, latest_value FROM e JOIN lt USING (stream)), g AS (SELECT DISTINCT stream, kind, rel FROM j WHERE cur AND act),
 x AS (SELECT j.stream, j.event_id, j.cur, s.stale_value FROM j JOIN g USING (stream, kind, rel) JOIN sv s ON s.stream=j.stream WHERE act AND contains(lower(text), 'val' || s.stale_value)),
 c AS (SELECT stream, count(*) FILTER (NOT cur) AS stale_active, count(*) FILTER (cur) AS transition_mentions FROM x GROUP BY 1), n AS (SELECT stream, count(*) FILTER (cur AND act) AS current_active, count(*) FILTER (cur AND NOT act) AS current_inactive FROM j GROUP BY 1)
 SELECT lt.stream, coalesce(current_active,0) AS current_active, coalesce(current_inactive,0) AS current_inactive, coalesce(stale_active,0) AS stale_active, coalesce(transition_mentions,0) AS transition_mentions,
 CASE WHEN coalesce(current_active,0)=0 THEN 'FAIL' WHEN coalesce(stale_active,0)>0 THEN 'AMBIGUOUS' ELSE 'PASS' END AS status FROM lt LEFT JOIN n USING (stream) LEFT JOIN c USING (stream)""",
)
def _(spark, sf):
    return current_states(spark, sf)


def current_states(spark, sf):
    latest, stale = tm.latest_and_stale_values(operations(spark, sf), ["stream"], ["seq"], "new_value")
    samples = latest.select("stream", F.concat(F.lit("Val"), "latest_value").alias("expected"))
    old = stale.select("stream", F.concat(F.lit("val"), "stale_value").alias("stale_value"))
    c = F.col("cents")
    edges = lifecycle(spark, sf).select(
        "stream",
        F.col("event_id").alias("edge_id"),
        F.col("kind").alias("source_key"),
        (c % 2).cast("string").alias("relation"),
        F.concat(F.lit("Set VAL"), c % 6, F.lit(" from val"), c % 5, F.lit(".")).alias("text"),
        F.col("arrival_ns").alias("valid_at"),
        F.when(F.col("event_id") % 3 == 0, F.col("publish_ns")).alias("invalid_at"),
        F.lit(None).cast("long").alias("expired_at"),
    )
    return tm.inspect_current_state(samples, old, edges, "stream", F.lit(1_704_800_000_000_000_000))


@query(
    "chain_length_stats",
    f"""WITH {EV}, {OPS}, a AS (SELECT stream, count(*) AS targets, max(m) AS max_mutations, CAST(sum(m) AS BIGINT) AS mutations FROM (SELECT stream, kind, count(*) FILTER (old_value <> new_value) AS m FROM op GROUP BY ALL) GROUP BY 1),
 b AS (SELECT stream, count(*) AS chains, max(c) AS max_chain_length FROM (SELECT stream, new_value, count(*) AS c FROM op WHERE seq % 4 <> 0 GROUP BY ALL) GROUP BY 1), d AS (SELECT stream, count(DISTINCT segment) AS mutating_segments FROM op WHERE old_value <> new_value GROUP BY 1)
 SELECT stream, targets, max_mutations, mutations, chains, max_chain_length, mutating_segments FROM a JOIN b USING (stream) JOIN d USING (stream)""",
)
def _(spark, sf):
    mutated = F.coalesce(F.col("old_value") != F.col("new_value"), F.lit(False))
    return tm.chain_length_stats(operations(spark, sf), ["stream"], "kind", "new_value", "segment", mutated, F.col("seq") % 4 != 0)


@query(
    "state_pair_matrix",
    f"""WITH {EV}, s AS (SELECT stream, CASE WHEN max(cents) FILTER (event_id % 2 = 0) > 30000 THEN 'PASS' WHEN max(cents) FILTER (event_id % 2 = 0) IS NOT NULL THEN 'FAIL' END AS l, CASE WHEN max(cents) FILTER (event_id % 2 = 1) > 33000 THEN 'PASS' WHEN max(cents) FILTER (event_id % 2 = 1) IS NOT NULL THEN 'FAIL' END AS r FROM ev GROUP BY 1)
 SELECT l AS left_state, r AS right_state, count(*) AS samples, min(stream) AS first_sample, l <> r AS diverges FROM s WHERE l IS NOT NULL AND r IS NOT NULL GROUP BY ALL""",
)
def _(spark, sf):
    method = F.when(F.col("event_id") % 2 == 0, "B0").otherwise("B1")
    states = lifecycle(spark, sf).groupBy("stream", method.alias("method")).agg(F.max("cents").alias("top"))
    status = F.when(F.col("top") > F.when(F.col("method") == "B0", 30_000).otherwise(33_000), "PASS").otherwise("FAIL")
    return tm.state_pair_matrix(states.withColumn("status", status), "stream", "method", "status", "B0", "B1")
