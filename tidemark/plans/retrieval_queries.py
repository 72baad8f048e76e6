"""Queries over retrieval and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import retrieval as rt
from tidemark.operators.ordered import largest_group, ordered_scan
from tidemark.plans.inputs import EV, RUNS, lifecycle, runs, table, turns
from tidemark.plans.registry import query
from tidemark.plans.statistic_queries import rounded

VECTORS = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT label, arg_min(e, vec_id) AS qe FROM v GROUP BY 1),
 s AS (SELECT label, vec_id, round((1 + list_inner_product(e, qe) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(qe, qe)))) / 2, 9) AS score FROM v JOIN q USING (label))"""


def prototypes(spark, sf):
    """One query vector per label: that of its first row."""
    return table(spark, sf, "embeddings").groupBy("label").agg(F.min("vec_id").alias("query_id"), F.min_by("embedding", "vec_id").alias("embedding"))


def _cosine_sql(tie: str, threshold: float) -> str:
    return f"""WITH {VECTORS} SELECT label, vec_id, round(score,6) AS score, row_number() OVER (PARTITION BY label ORDER BY score DESC, {tie}) AS rank, row_number() OVER (PARTITION BY label ORDER BY score DESC, {tie}) <= 10 AS selected FROM s WHERE score > {threshold}"""


@query("cosine_topk_nodes", _cosine_sql("vec_id", 0.6))
def _(spark, sf):
    items = table(spark, sf, "embeddings")
    return rounded(rt.cosine_topk(items, prototypes(spark, sf), ["label"], "query_id", "embedding", ["vec_id"]), 6, "score").select("label", "vec_id", "score", "rank", "selected")


@query("cosine_topk_edges", _cosine_sql("md5(CAST(vec_id AS VARCHAR)), vec_id", 0.55))
def _(spark, sf):
    items = table(spark, sf, "embeddings").withColumn("fact", F.md5(F.col("vec_id").cast("string")))
    out = rt.cosine_topk(items, prototypes(spark, sf), ["label"], "query_id", "embedding", ["fact", "vec_id"], min_score=0.55)
    return rounded(out, 6, "score").select("label", "vec_id", "score", "rank", "selected")


BM25 = """ut AS (SELECT conv_id, turn, text FROM conversations WHERE role='user'), qs AS (SELECT conv_id, arg_max(text, turn) AS qt FROM conversations GROUP BY 1),
 w AS (SELECT conv_id, turn, unnest(string_split(text,' ')) AS t FROM ut), tf AS (SELECT conv_id, turn, t, count(*) AS tf FROM w GROUP BY ALL), dl AS (SELECT conv_id, turn, len(string_split(text,' ')) AS dl FROM ut),
 st AS (SELECT conv_id, count(*) AS n, CAST(sum(dl) AS DOUBLE)/count(*) AS av FROM dl GROUP BY 1), df AS (SELECT conv_id, t, count(*) AS df FROM tf GROUP BY ALL),
 idf AS (SELECT conv_id, t, ln(n-df+0.5)-ln(df+0.5) AS idf, av FROM df JOIN st USING (conv_id)), mi AS (SELECT conv_id, avg(idf) AS m FROM idf GROUP BY 1),
 qt AS (SELECT conv_id, t, count(*) AS q FROM (SELECT conv_id, unnest(string_split(qt,' ')) AS t FROM qs) GROUP BY ALL),
 sc AS (SELECT tf.conv_id, tf.turn, round(sum(q * CASE WHEN idf<0 THEN 0.25*m ELSE idf END * tf*2.5/(tf+1.5*(1-0.75+0.75*dl/av))),9) AS score FROM tf JOIN qt USING (conv_id, t) JOIN idf USING (conv_id, t) JOIN mi USING (conv_id) JOIN dl USING (conv_id, turn) GROUP BY ALL),
 bm AS (SELECT conv_id, turn, coalesce(score,0) AS score, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(score,0) DESC, turn) AS rank FROM ut LEFT JOIN sc USING (conv_id, turn))"""


def bm25(spark, sf):
    all_turns = turns(spark, sf)
    questions = all_turns.groupBy("conv_id").agg(F.max_by("text", "turn").alias("question"))
    return rt.bm25_topk(all_turns.filter("role = 'user'").select("conv_id", "turn", "text"), questions, ["conv_id"], "turn", "text", "question")


@query(
    "bm25_topk",
    f"""WITH {BM25}, nx AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text FROM conversations)
 SELECT conv_id, turn, round(score,6) AS score, rank, nx.text, next_text FROM bm JOIN nx USING (conv_id, turn) WHERE rank <= 10""",
)
def _(spark, sf):
    return rounded(rt.expand_with_next_turn(bm25(spark, sf), turns(spark, sf), ["conv_id"], "turn", "text"), 6, "score")


FUSED = """rc AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank FROM ut), al AS (SELECT conv_id, turn, 1.0::DOUBLE/rank AS s FROM bm WHERE rank <= 10 UNION ALL SELECT conv_id, turn, 1.0::DOUBLE/rank FROM rc),
 fs AS (SELECT conv_id, turn, round(sum(s),9) AS score FROM al GROUP BY ALL), fr AS (SELECT conv_id, turn, score, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS rank FROM fs)"""


def fused(spark, sf):
    recent = turns(spark, sf).filter("role = 'user'").select("conv_id", "turn", (-F.col("turn")).alias("_b"))
    recent = ordered_scan(recent, ["conv_id"], ["_b"], rank="rank")
    longest = largest_group(turns(spark, sf), ["conv_id"])
    return rt.rrf_fusion([bm25(spark, sf), recent], ["conv_id"], "turn", "rank", hot=10 + longest)


@query("rrf_fusion", f"WITH {BM25}, {FUSED} SELECT conv_id, turn, round(score,6) AS score, rank FROM fr WHERE rank <= 10")
def _(spark, sf):
    return rounded(fused(spark, sf), 6, "score")


@query(
    "retrieval_bundle",
    f"""WITH {BM25}, {FUSED}, pv AS (SELECT conv_id * 1000 + turn AS item, CASE WHEN turn % 7 = 6 THEN conv_id + 1 ELSE conv_id END AS ns, conv_id || '/' || (turn//2) AS session_id FROM conversations WHERE turn % 5 <> 4)
 SELECT conv_id, rank, conv_id*1000+turn AS item, session_id, CASE WHEN ns IS NULL THEN 'PROVENANCE_MISSING' WHEN ns <> conv_id THEN 'NAMESPACE_ESCAPE' ELSE 'OK' END AS bundle_status FROM fr LEFT JOIN pv ON item = conv_id*1000+turn WHERE rank <= 10""",
)
def _(spark, sf):
    t = F.col("turn")
    item = F.col("conv_id") * 1000 + t
    proof = turns(spark, sf).filter(t % 5 != 4).select(item.alias("item"), F.when(t % 7 == 6, F.col("conv_id") + 1).otherwise(F.col("conv_id")).alias("ns"), F.concat_ws("/", "conv_id", F.floor(t / 2)).alias("session"))
    return rt.retrieval_bundle(fused(spark, sf).withColumn("item", item), proof, ["conv_id"], "item", "ns", "session")


@query(
    "stable_node_order",
    """SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY lower(nm), nm, lb, lower(p_type), p_type, ats) AS place FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS nm, CASE WHEN lower('X' || p_size) < 'b' THEN '["X' || p_size || '","b"]' ELSE '["b","X' || p_size || '"]' END AS lb, '{"k":' || p_partkey || '}' AS ats FROM part)""",
)
def _(spark, sf):
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select(
        "p_partkey", "p_brand", F.when(k % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"), F.array(F.lit("b"), F.concat(F.lit("X"), "p_size")).alias("labels"), F.col("p_type").alias("summary"), F.format_string('{"k":%d}', k).alias("attributes")
    )
    return rt.stable_order(rows, ["p_brand"], rt.stable_node_keys("name", "labels", "summary", "attributes")).select("p_partkey", "p_brand", "place")


@query(
    "stable_edge_order",
    f"""WITH {EV} SELECT event_id, stream, row_number() OVER (PARTITION BY stream ORDER BY lower(f), f, lower(kind), kind, CAST(arrival_ns AS VARCHAR), '') AS place FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN upper(kind) ELSE kind END AS f FROM ev)""",
)
def _(spark, sf):
    rows = lifecycle(spark, sf).withColumns({"fact": F.when(F.col("event_id") % 2 == 0, F.upper("kind")).otherwise(F.col("kind")), "none": F.lit(None).cast("string")})
    return rt.stable_order(rows, ["stream"], rt.stable_edge_keys("fact", "kind", "arrival_ns", "none")).select("event_id", "stream", "place")


WORDS_SQL = "[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]"
BAGS = f"""bag AS (SELECT id, t, count(*) AS c FROM (SELECT conv_id*1000+turn AS id, unnest(regexp_extract_all(lower(text), '{WORDS_SQL}')) AS t FROM conversations) GROUP BY ALL), sz AS (SELECT id, sum(c) AS n FROM bag GROUP BY 1)"""


@query(
    "token_dice",
    f"""WITH {BAGS}, pr AS (SELECT conv_id*1000+turn AS a, conv_id*1000+lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations), cm AS (SELECT a, b, sum(least(x.c, y.c)) AS m FROM pr JOIN bag x ON x.id=a JOIN bag y ON y.id=b AND x.t=y.t GROUP BY ALL)
 SELECT pr.a, pr.b, round(CASE WHEN coalesce(s1.n,0)+coalesce(s2.n,0)=0 THEN 1.0 ELSE 2.0*coalesce(m,0)/(coalesce(s1.n,0)+coalesce(s2.n,0)) END,6) AS dice FROM pr LEFT JOIN cm ON cm.a=pr.a AND cm.b=pr.b LEFT JOIN sz s1 ON s1.id=pr.a LEFT JOIN sz s2 ON s2.id=pr.b WHERE pr.b IS NOT NULL""",
)
def _(spark, sf):
    texts = turns(spark, sf).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn", "text")
    pairs = ordered_scan(texts.select(F.col("id").alias("a"), "conv_id", "turn"), ["conv_id"], ["turn"], lead={"b": "a"}).filter(F.col("b").isNotNull()).select("a", "b")
    return rounded(rt.token_dice(pairs, texts, "a", "b", "id", "text"), 6, "dice")


@query(
    "nearest_prompt_dice",
    f"""WITH {BAGS}, p AS (SELECT conv_id*1000+turn AS id, role, 'n' || (conv_id % 3) AS nm, 'c' || (turn // 2 % 2) AS cp, length(text) AS ln, md5(text || conv_id || turn) AS h FROM conversations),
 x AS (SELECT r.id AS rid, c.id AS cid, CAST(r.nm=c.nm AS INT) AS name_match, CAST(r.cp=c.cp AS INT) AS component_match, abs(r.ln-c.ln) AS length_gap, c.h FROM p r, p c WHERE r.role='assistant' AND c.role='user'),
 s AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY name_match DESC, component_match DESC, length_gap, h) AS rn FROM x), sh AS (SELECT * FROM s WHERE rn <= 16),
 cm AS (SELECT rid, cid, sum(least(a.c,b.c)) AS m FROM sh JOIN bag a ON a.id=rid JOIN bag b ON b.id=cid AND a.t=b.t GROUP BY ALL),
 d AS (SELECT sh.*, round(CASE WHEN coalesce(s1.n,0)+coalesce(s2.n,0)=0 THEN 1.0 ELSE 2.0*coalesce(m,0)/(coalesce(s1.n,0)+coalesce(s2.n,0)) END,9) AS dice FROM sh LEFT JOIN cm USING (rid, cid) LEFT JOIN sz s1 ON s1.id=rid LEFT JOIN sz s2 ON s2.id=cid),
 b AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY name_match DESC, component_match DESC, dice DESC, length_gap, h DESC) AS k FROM d) SELECT rid AS id, cid AS nearest, name_match, component_match, length_gap, round(dice,6) AS dice FROM b WHERE k=1""",
)
def _(spark, sf):
    rows = turns(spark, sf).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", F.concat(F.lit("n"), F.col("conv_id") % 3).alias("name"), F.concat(F.lit("c"), F.floor(F.col("turn") / 2) % 2).alias("component"), "text", F.md5(F.concat("text", "conv_id", "turn")).alias("hash")
    )
    out = rt.nearest_prompt(rows.filter("role = 'assistant'"), rows.filter("role = 'user'"), row_id="id", name="name", component="component", text="text", digest="hash")
    return rounded(out, 6, "dice")


RANKED = """ra AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents), rb AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars + doc_id % 700 DESC, doc_id) AS rank FROM documents),
 gd AS (SELECT source, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality=1 AND source <> 'src3')"""


def ranked_docs(spark, sf):
    """Two rankings of every source's documents and the gold documents of most sources."""
    docs = table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    a = ordered_scan(docs.withColumn("_n", -F.col("n_chars")), ["source"], ["_n", "doc_id"], rank="rank").select("source", "doc_id", "rank")
    b = ordered_scan(docs.withColumn("_n", -(F.col("n_chars") + F.col("doc_id") % 700)), ["source"], ["_n", "doc_id"], rank="rank").select("source", "doc_id", "rank")
    good = table(spark, sf, "labels").filter("quality = 1").select("doc_id")
    gold = docs.select("source", "doc_id").join(good, "doc_id", "left_semi").filter("source <> 'src3'")
    return a, b, gold


def asked_names(spark, sf):
    """Every source and every language, as names of queries."""
    docs = table(spark, sf, "documents")
    return docs.select("source").unionByName(docs.select(F.col("lang").alias("source"))).distinct()


@query(
    "evidence_recall_at_k",
    f"""WITH {RANKED}, g AS (SELECT gd.source, count(*) AS n, count(*) FILTER (rank <= 10) AS h FROM gd JOIN ra USING (source, doc_id) GROUP BY 1) SELECT DISTINCT ra.source, round(coalesce(CAST(h AS DOUBLE)/n, 1.0),6) AS recall_at_10 FROM ra LEFT JOIN g USING (source)""",
)
def _(spark, sf):
    a, _b, gold = ranked_docs(spark, sf)
    return rounded(rt.evidence_recall(a, gold, "source", "doc_id", 10), 6, "recall_at_10")


@query(
    "jaccard_overlap",
    f"""WITH {RANKED} SELECT source, round(CAST(count(*) FILTER (a AND b) AS DOUBLE)/count(*),6) AS jaccard FROM (SELECT source, doc_id, bool_or(s=1) AS a, bool_or(s=2) AS b FROM (SELECT source, doc_id, 1 AS s FROM ra UNION ALL SELECT source, doc_id, 2 FROM gd) GROUP BY ALL) GROUP BY 1
 UNION ALL SELECT DISTINCT lang, 1.0::DOUBLE FROM documents""",
)
def _(spark, sf):
    # Languages are asked too and name nothing on either side.
    a, _b, gold = ranked_docs(spark, sf)
    return rounded(rt.jaccard_overlap(a, gold, ["source"], "doc_id", asked_names(spark, sf)), 6, "jaccard")


@query(
    "rank_biased_overlap",
    f"""WITH {RANKED}, m AS (SELECT ra.source, greatest(ra.rank, rb.rank) AS d, count(*) AS n FROM ra JOIN rb USING (source, doc_id) GROUP BY ALL), d AS (SELECT ra.source, ra.rank AS d, coalesce(n,0) AS n FROM ra LEFT JOIN m ON m.source=ra.source AND m.d=ra.rank),
 o AS (SELECT source, d, CAST(sum(n) OVER (PARTITION BY source ORDER BY d) AS DOUBLE)/d AS ag FROM d) SELECT source, round((1-0.9::DOUBLE)*sum(pow(0.9::DOUBLE, d-1)*ag) + pow(0.9::DOUBLE, max(d))*arg_max(ag, d),6) AS rbo, max(d) AS depth FROM o GROUP BY 1 UNION ALL SELECT DISTINCT lang, 1.0::DOUBLE, 0 FROM documents""",
)
def _(spark, sf):
    a, b, _g = ranked_docs(spark, sf)
    return rounded(rt.rank_biased_overlap(a, b, ["source"], "doc_id", queries=asked_names(spark, sf)), 6, "rbo")


@query(
    "session_ranking_metrics",
    f"""WITH {RANKED}, g AS (SELECT gd.source, ra.rank FROM gd JOIN ra USING (source, doc_id)), s AS (SELECT source, count(*) AS gold_size, min(rank) AS best_rank, sum(CASE WHEN rank<=10 THEN 1/log2(rank+1) ELSE 0 END) AS dcg, """
    + ", ".join(f"count(*) FILTER (rank<={k}) AS h{k}" for k in (1, 3, 5, 10))
    + """ FROM g GROUP BY 1)
 SELECT source, gold_size, best_rank, """
    + ", ".join(f"round(CAST(h{k} AS DOUBLE)/gold_size,6) AS recall_at_{k}" for k in (1, 3, 5, 10))
    + """, round(1.0::DOUBLE/best_rank,6) AS mrr, round(dcg/(SELECT sum(1/log2(r+1)) FROM range(1, 11) t(r) WHERE r <= gold_size),6) AS ndcg_at_10 FROM s""",
)
def _(spark, sf):
    a, _b, gold = ranked_docs(spark, sf)
    out = rt.session_ranking_metrics(a, gold, "source", "doc_id")
    return rounded(out, 6, *[c for c in out.columns if c.startswith(("recall", "mrr", "ndcg"))])


PROV = f"""{RANKED}, fa AS (SELECT source, rank, unnest([doc_id, doc_id + 20]) AS s FROM ra WHERE rank <= 20)"""


@query(
    "edge_provenance_metrics",
    f"""WITH {PROV}, hit AS (SELECT fa.source, fa.rank, bool_or(gd.doc_id IS NOT NULL) AS h FROM fa LEFT JOIN gd ON gd.source=fa.source AND gd.doc_id=fa.s GROUP BY ALL), cv AS (SELECT fa.source, fa.s, min(fa.rank) AS f FROM fa JOIN gd ON gd.source=fa.source AND gd.doc_id=fa.s GROUP BY ALL),
 n AS (SELECT source, count(*) AS g FROM gd GROUP BY 1), p AS (SELECT source, """
    + ", ".join(f"CAST(count(*) FILTER (rank<={k} AND h) AS DOUBLE)/count(*) FILTER (rank<={k}) AS p{k}" for k in (1, 3, 5, 10, 20))
    + " FROM hit GROUP BY 1), c AS (SELECT source, "
    + ", ".join(f"count(*) FILTER (f<={k}) AS c{k}" for k in (1, 3, 5, 10, 20))
    + " FROM cv GROUP BY 1) SELECT n.source, "
    + ", ".join(f"round(coalesce(p{k},0),6) AS precision_at_{k}, round(CAST(coalesce(c{k},0) AS DOUBLE)/g,6) AS coverage_at_{k}" for k in (1, 3, 5, 10, 20))
    + " FROM n LEFT JOIN p USING (source) LEFT JOIN c USING (source)",
)
def _(spark, sf):
    a, _b, gold = ranked_docs(spark, sf)
    facts = a.select("source", "rank", F.array("doc_id", F.col("doc_id") + 20).alias("sources"))
    out = rt.edge_provenance_metrics(facts, gold, "source", "rank", "sources", "doc_id")
    return rounded(out, 6, *out.columns[1:])


CONTEXT = f"""{BM25}, fc AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY length(text), turn) AS rank, turn, text FROM conversations),
 ev AS (SELECT conv_id, 'graph_fact' AS evidence_type, 0 AS k, rank, text AS raw, CASE WHEN turn % 3 = 0 THEN NULL ELSE turn * 60 END AS ts_us, 'f' || turn AS source_id FROM fc
  UNION ALL SELECT bm.conv_id, 'source_local_round', 1, bm.rank, c.text, bm.turn * 60 + 30, 's' || bm.turn FROM bm JOIN conversations c ON c.conv_id=bm.conv_id AND c.turn=bm.turn),
 de AS (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(trim(regexp_replace(raw, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) ORDER BY k, rank) AS rn FROM ev),
 ct AS (SELECT conv_id, evidence_type, rank, raw AS raw_evidence, ts_us, source_id, row_number() OVER (PARTITION BY conv_id ORDER BY ts_us NULLS LAST, evidence_type, rank, source_id) AS position FROM de WHERE rn = 1)"""


@query(
    "context_pack",
    f"""WITH {CONTEXT} SELECT conv_id, CAST(to_json(list({{'position': position, 'evidence_type': evidence_type, 'rank': rank, 'raw_evidence': raw_evidence, 'ts_us': CAST(ts_us AS BIGINT), 'source_id': source_id}} ORDER BY position)) AS VARCHAR) AS context_json, count(*) AS evidence_count FROM ct GROUP BY 1""",
)
def _(spark, sf):
    all_turns = turns(spark, sf).withColumn("_len", F.length("text"))
    t = F.col("turn")
    facts = ordered_scan(all_turns, ["conv_id"], ["_len", "turn"], rank="rank").select("conv_id", "rank", F.col("text").alias("raw_evidence"), F.when(t % 3 != 0, t * 60).cast("long").alias("ts_us"), F.concat(F.lit("f"), t).alias("source_id"))
    rounds = bm25(spark, sf).join(turns(spark, sf).select("conv_id", "turn", "text"), ["conv_id", "turn"]).select("conv_id", "rank", F.col("text").alias("raw_evidence"), (t * 60 + 30).cast("long").alias("ts_us"), F.concat(F.lit("s"), t).alias("source_id"))
    return rt.context_pack(rt.context_rows(facts, rounds, ["conv_id"]), ["conv_id"])


@query(
    "render_temporal_context",
    f"""WITH fc AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY length(text), turn) AS rank, turn, text, role FROM conversations)
 SELECT conv_id, '{rt.CONTEXT_HEAD}' || string_agg('  - [rank ' || rank || '] ' || text || ' (valid_at=' || coalesce(CASE WHEN turn % 2 = 0 THEN CAST(turn AS VARCHAR) END, 'unknown') || '; invalid_at=present; expired_at=not-expired; reference_time=' || turn || ')', chr(10) ORDER BY rank)
  || '{rt.CONTEXT_MIDDLE}' || string_agg('  - [rank ' || rank || '] ' || role || ': t' || turn, chr(10) ORDER BY rank) || '{rt.CONTEXT_TAIL}' AS context FROM fc GROUP BY 1""",
)
def _(spark, sf):
    rows = ordered_scan(turns(spark, sf).withColumn("_len", F.length("text")), ["conv_id"], ["_len", "turn"], rank="rank")
    none = F.lit(None).cast("string")
    facts = rows.select("conv_id", "rank", F.col("text").alias("fact"), F.when(F.col("turn") % 2 == 0, F.col("turn")).alias("valid_at"), none.alias("invalid_at"), none.alias("expired_at"), F.col("turn").alias("reference_time"))
    entities = rows.select("conv_id", "rank", F.col("role").alias("name"), F.concat(F.lit("t"), "turn").alias("summary"))
    return rt.render_temporal_context(facts, entities, ["conv_id"])


@query(
    "query_event_compare",
    f"""WITH {RANKED}, a AS (SELECT source, rank % 7 AS input, doc_id, rank FROM ra), b AS (SELECT source, rank % 7 AS input, doc_id, rank FROM rb WHERE rank % 7 <> 5 OR source <> 'src1'),
 u AS (SELECT *, 1 AS s FROM a UNION ALL SELECT *, 2 FROM b), m AS (SELECT source, input, doc_id, count(*) FILTER (s=1) AS x, count(*) FILTER (s=2) AS y FROM u GROUP BY ALL), o AS (SELECT source, input, doc_id, rank, count(*) FILTER (s=1) AS x, count(*) FILTER (s=2) AS y FROM u GROUP BY ALL)
 SELECT source, input, p AS paired, q AS membership_equal, r AS order_equal FROM (SELECT source, input, sum(x)>0 AND sum(y)>0 AS p, bool_and(x=y) AS q FROM m GROUP BY ALL) JOIN (SELECT source, input, bool_and(x=y) AS r FROM o GROUP BY ALL) USING (source, input)""",
)
def _(spark, sf):
    a, b, _g = ranked_docs(spark, sf)
    key = (F.col("rank") % 7).alias("input")
    left = a.select("source", key, "doc_id", "rank")
    right = b.select("source", key, "doc_id", "rank").filter("input <> 5 OR source <> 'src1'")
    return rt.query_event_compare(left, right, ["source", "input"], "doc_id", "rank")


@query(
    "prefix_match_length",
    """WITH w AS (SELECT conv_id*1000+turn AS id, conv_id, turn, string_split(lower(regexp_replace(text, '[^A-Za-z ]', '', 'g')), ' ') AS l FROM conversations), n AS (SELECT id, turn, l, lead(l) OVER w2 AS l2, lead(id) OVER w2 AS id2 FROM w WINDOW w2 AS (PARTITION BY conv_id ORDER BY turn)),
 c AS (SELECT id, id2, l, l2, list_filter(range(1, CAST(least(len(l), len(l2)) AS BIGINT) + 1), lambda i: l[i] <> l2[i]) AS d FROM n WHERE id2 IS NOT NULL) SELECT id AS a, id2 AS b, CAST(CASE WHEN len(d)=0 THEN least(len(l), len(l2)) ELSE d[1]-1 END * 4 AS BIGINT) AS matched FROM c""",
)
def _(spark, sf):
    words = F.split(F.lower(F.regexp_replace("text", "[^A-Za-z ]", "")), " ")
    rows = turns(spark, sf).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn", words.alias("blocks"))
    pairs = ordered_scan(rows.select(F.col("id").alias("a"), "conv_id", "turn"), ["conv_id"], ["turn"], lead={"b": "a"}).filter(F.col("b").isNotNull()).select("a", "b")
    return rt.prefix_match_length(pairs, rows, "id", "blocks", "a", "b", 4)


SETTINGS = f"""{RUNS}, bl AS (SELECT method, question % 4 AS c, question % 25 AS block, CAST(count(*) AS DOUBLE) / 7 AS goodput, max(metric) AS p95, count(*) FILTER (status='P') AS violations, NOT (count(*) FILTER (status='P') >= 4 AND count(*) FILTER (status='P') * 2 > count(*)) AS qualified, CASE WHEN count(*) FILTER (status='P') >= 4 AND count(*) FILTER (status='P') * 2 > count(*) THEN 'violations' WHEN max(metric) > 49900000 THEN 'slow' END AS reason FROM runs GROUP BY ALL),
 st AS (SELECT method, c AS concurrency, count(*) AS block_count, CAST(sum(violations) AS BIGINT) AS violations, bool_and(qualified) AS qualified, coalesce(string_agg(DISTINCT reason, ',' ORDER BY reason), '') AS reasons, median(goodput) AS median_goodput, CAST(median(p95) AS DOUBLE) AS median_p95 FROM bl GROUP BY ALL)"""


def settings(spark, sf):
    pending = F.count_if(F.col("status") == "P")
    over = (pending >= 4) & (pending * 2 > F.count(F.lit(1)))
    blocks = runs(spark, sf).groupBy("method", (F.col("question") % 4).alias("concurrency"), (F.col("question") % 25).alias("block")).agg(
        (F.count(F.lit(1)).cast("double") / 7).alias("goodput"), F.max("metric").alias("p95"), pending.alias("violations"), (~over).alias("qualified"), F.when(over, "violations").when(F.max("metric") > 49_900_000, "slow").alias("reason")
    )
    return rt.setting_candidates(blocks, ["method", "concurrency"], "goodput", "p95", "violations", "qualified", "reason")


@query("setting_candidates", f"WITH {SETTINGS} SELECT method, concurrency, block_count, violations, qualified, reasons, round(median_goodput,6) AS median_goodput, round(median_p95,3) AS median_p95 FROM st")
def _(spark, sf):
    return rounded(rounded(settings(spark, sf), 6, "median_goodput"), 3, "median_p95")


@query(
    "select_best_setting",
    f"WITH {SETTINGS}, r AS (SELECT method, concurrency, median_goodput, row_number() OVER (PARTITION BY method ORDER BY median_goodput DESC, concurrency) AS k FROM st WHERE qualified) SELECT method, concurrency, round(median_goodput,6) AS median_goodput FROM r WHERE k = 1",
)
def _(spark, sf):
    return rounded(rt.select_best_setting(settings(spark, sf), "method", "concurrency", "median_goodput"), 6, "median_goodput")


HAZARD = f"""{EV}, s AS (SELECT stream, CASE WHEN stream % 3 = 0 THEN 'TrajectoryOps' ELSE 'Update' END AS kind, count(DISTINCT cents % 50) AS mutations, max(cents % 9) AS chain, count(*) AS sources, count(*) FILTER (cents % 7 = 0) AS checkpoints FROM ev GROUP BY 1),
 h AS (SELECT *, mutations*100 + chain*20 + checkpoints*3 + least(sources,5) AS hazard_score, CASE WHEN mutations < 35 THEN 'MUTATIONS' ELSE '' END AS failed_checks, mutations >= 35 AS eligible FROM s)"""


def hazards(spark, sf):
    c = F.col("cents")
    samples = lifecycle(spark, sf).groupBy("stream").agg(F.countDistinct(c % 50).alias("mutations"), F.max(c % 9).alias("chain"), F.count(F.lit(1)).alias("sources"), F.count_if(c % 7 == 0).alias("checkpoints"))
    samples = samples.withColumn("kind", F.when(F.col("stream") % 3 == 0, "TrajectoryOps").otherwise("Update"))
    return rt.hazard_rank(samples, {"mutations": 100, "chain": 20, "checkpoints": 3, "sources": 1}, {"sources": 5}, {"MUTATIONS": F.col("mutations") >= 35}, "stream")


@query("hazard_rank", f"WITH {HAZARD} SELECT stream, kind, mutations, chain, sources, checkpoints, hazard_score, failed_checks, eligible, row_number() OVER (ORDER BY hazard_score DESC, stream) AS place FROM h")
def _(spark, sf):
    return hazards(spark, sf)


@query(
    "quota_topk_by_type",
    f"""WITH {HAZARD}, r AS (SELECT kind, stream, hazard_score, row_number() OVER (PARTITION BY kind ORDER BY hazard_score DESC, stream) AS place, count(*) OVER (PARTITION BY kind) AS n, CASE kind WHEN 'Update' THEN 18 ELSE 6 END AS quota FROM h WHERE eligible) SELECT kind, stream, hazard_score, place, CAST(quota AS INTEGER) AS quota, n >= quota AS quota_met FROM r WHERE place <= quota""",
)
def _(spark, sf):
    quotas = spark.createDataFrame([("Update", 18), ("TrajectoryOps", 6)], "kind string, quota int")
    rows = hazards(spark, sf).filter("eligible").select("kind", "stream", "hazard_score")
    return rt.quota_topk_by_type(rows, "kind", "hazard_score", "stream", quotas)
