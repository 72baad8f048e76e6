"""The queries over the given tables. Each gets its rows through its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.llm.licenses import twin_sql
from tidemark.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(prepare(spark), sf_dir)
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


@query("op5_simhash_near_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.simhash import hex16, near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


@query("op6_byte_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.bpe import round_trip_digests

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return round_trip_digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, keep=["doc_id"])


WS = r"[^\x20\x09-\x0D]+"
MIX_SQL = f"""WITH s AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '{WS}')) END AS size FROM documents),
g AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY 1),
w AS (SELECT *, 1.0::DOUBLE + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, 3.0::DOUBLE * source_size AS lim FROM g),
lv AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
   - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
   / sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT *, least(lim, max(level) OVER () * weight) AS target FROM lv),
q AS (SELECT *, least(CAST(round(target) AS BIGINT), 3 * source_size) AS quota FROM t),
st AS (SELECT s.*, q.source_size, q.target, q.quota, CAST(sum(size) OVER (PARTITION BY s.source
   ORDER BY md5('mix-1:' || CAST(doc_id AS VARCHAR)), doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e
   FROM s JOIN q ON s.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE
  (quota // source_size) * size + greatest(0, least(e, quota % source_size) - (e - size)) END AS taken FROM st"""


@query("op8_source_mix", MIX_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    grammar = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    rows = toxicity.score(docs, grammar, keep=["doc_id"])
    return rows.select("doc_id", F.coalesce(toxicity.held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op10_order_minhash")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.order_minhash import with_next_edits

    return with_next_edits(table(spark, sf_dir, "documents"))


ROWS_SQL = "SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'"
ESC = lambda c: rf"regexp_replace(replace({c}, '\', '\\'), '([<\[])(/?(?:s>|INST\]))', '\1\\\2', 'g')"
CHAT_SQL = rf"""WITH r AS ({ROWS_SQL}),
o AS (SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS said,
 length({ESC('role')}) + length({ESC('text')}) + 9 + CASE WHEN role = 'assistant' THEN 4 ELSE 7 END AS chars FROM r)
SELECT conv_id, count(*) AS n_turns,
 sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(sum(length(said)) AS BIGINT) AS loss_chars, sha256(string_agg(said, '' ORDER BY turn, role, text)) AS loss_sha256,
 CAST(sum(chars) AS BIGINT) AS formatted_chars FROM o GROUP BY conv_id"""


@query("op1_chat_formatting", CHAT_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a tree with one branch: each row answers the one before it by turn (null last), role and text."""
    from tidemark.llm import chat

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = rows.unionByName(planted)
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    rows = rows.withColumn("message", F.row_number().over(order)).withColumn("parent", F.when(F.col("message") > 1, F.col("message") - 1))
    said = chat.conversations(rows, tree="conv_id", score=None, branches=1)
    said = said.withColumn("_turns", chat.turns_of(F.col("formatted"))).withColumn("_loss", F.array_join(chat.loss_texts(F.col("formatted"), F.col("loss_spans")), ""))
    read = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return said.select(
        F.col("tree").alias("conv_id"),
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(read, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


TOPK_SQL = """WITH v AS (SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
 FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM p)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 20"""


@query("op2_exact_topk", TOPK_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.topk import exact_topk

    rows = table(spark, sf_dir, "embeddings")
    return exact_topk(rows, F.col("vec_id") % 20 == 0, k=20)


@query("op3_license_scan", twin_sql())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


# Dated lists made from the URLs themselves: the digest of a host, domain or first path step says which list has it, since and until when.
FIRST_DAY, DAYS = 1_704_067_200, 366
URL_SQL = r"""WITH p AS (SELECT page_id, url, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) AS host,
  regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path,
  1704067200 + (page_id * 37 % 366) * 86400 + 43200 AS ft FROM pages),
v AS (SELECT DISTINCT 'host' AS kind, host AS value FROM p WHERE host <> ''
  UNION SELECT DISTINCT 'domain', regexp_extract(host, '([^.]+\.[^.]+)$', 1) FROM p WHERE regexp_extract(host, '([^.]+\.[^.]+)$', 1) <> ''
  UNION SELECT DISTINCT 'prefix', host || '/' || regexp_extract(path, '^/+([^/]+)', 1) FROM p WHERE host <> '' AND regexp_extract(path, '^/+([^/]+)', 1) <> ''),
h AS (SELECT *, CAST('0x' || substr(md5(kind || ':' || value), 1, 6) AS BIGINT) AS x FROM v),
i AS (SELECT kind, value, CASE WHEN x % 3 = 0 THEN 'trusted' WHEN x % 3 = 1 THEN 'spam' ELSE 'malware' END AS list, x % 3 = 0 AS allow,
  1704067200 + (x // 16 % 366) * 86400 AS f, 1704067200 + (x // 16 % 366 + 20 + x // 8192 % 200) * 86400 AS u FROM h WHERE x % 16 < 9),
i2 AS (SELECT * FROM i UNION ALL SELECT kind, value, list, allow, u + 30 * 86400, NULL FROM i),
m AS (SELECT page_id, url, ft, kind, value, list, allow FROM p JOIN i2 ON ft >= f AND (u IS NULL OR ft < u) AND host <> '' AND
  CASE kind WHEN 'host' THEN host = value WHEN 'domain' THEN host = value OR ends_with(host, '.' || value)
   ELSE starts_with(rtrim(host || regexp_replace(path, '/+', '/', 'g'), '/') || '/', value || '/') END),
g AS (SELECT page_id, url, ft, count(*) AS n, string_agg(list || ':' || kind || ':' || value, ' ' ORDER BY r, -length(value), deny, list, value) AS matched,
  first(deny ORDER BY r, -length(value), deny, list, value) AS blocked
  FROM (SELECT *, NOT allow AS deny, CASE kind WHEN 'prefix' THEN 0 WHEN 'host' THEN 1 ELSE 2 END AS r FROM m) GROUP BY 1, 2, 3)
SELECT p.page_id, p.url, p.ft AS fetched_at, CASE WHEN n IS NULL THEN 'unlisted' WHEN blocked THEN 'blocked' ELSE 'allowed' END AS verdict,
 coalesce(n, 0) AS n_active, coalesce(matched, '') AS matched FROM p LEFT JOIN g USING (page_id, url, ft)"""


@query("op7_url_filters", URL_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import url_filters as U

    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url")
    captures = pages.withColumn("at", FIRST_DAY + (F.col("id") * 37 % DAYS) * 86_400 + 43_200)
    host, path = U.host_of(F.col("url")), F.regexp_extract(F.coalesce("url", F.lit("")), U.PATH, 1)
    step, domain = F.regexp_extract(path, "^/+([^/]+)", 1), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    named = lambda kind, value, given: F.when(given, F.struct(F.lit(kind).alias("kind"), value.alias("value")))
    values = F.array(named("host", host, host != ""), named("domain", domain, domain != ""), named("prefix", F.concat(host, F.lit("/"), step), (host != "") & (step != "")))
    listed = pages.select(F.explode(values).alias("v")).filter("v IS NOT NULL").select("v.kind", "v.value").distinct()
    x = F.conv(F.substring(F.md5(F.concat_ws(":", "kind", "value")), 1, 6), 16, 10).cast("long")
    listed = listed.withColumn("x", x).filter("x % 16 < 9")
    kind = F.col("x") % 3
    since, until = F.expr("x div 16 % 366"), F.expr("x div 16 % 366 + 20 + x div 8192 % 200")
    event = lambda action, day: F.struct(F.lit(action).alias("action"), (FIRST_DAY + day * 86_400).alias("at"))
    events = listed.select("kind", "value", F.when(kind == 0, "trusted").when(kind == 1, "spam").otherwise("malware").alias("list"), (kind == 0).alias("allow"), F.explode(F.array(event("add", since), event("remove", until), event("add", until + 30))).alias("e"))
    intervals = U.validity_intervals(events.select("list", "kind", "value", "allow", "e.action", "e.at"))
    return U.evaluate(captures, intervals).withColumnsRenamed({"id": "page_id", "at": "fetched_at"})


@query("op4_html_extraction")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.html_blocks import extract

    pages = extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return pages.withColumn("n_chars", F.length("text").cast("long"))


@query("op13_token_counts")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.token_counts import count_tokens, read_model

    return count_tokens(table(spark, sf_dir, "documents"), read_model(public_tokenizers.path("piece_bpe_32k.model")), keep=["doc_id"])


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, by checksum of the id, get a periodic tail first; a null id has no checksum."""
    from tidemark.llm.periodic_runs import periodic_runs

    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (h % 10 == 0).alias("_tailed"), F.floor(h / 10).cast("long").alias("_g"))
    docs = docs.withColumn("_w", F.when(F.col("_tailed"), words)).withColumn("_n", F.size("_w")).withColumn("_a", F.expr("IF(_n > 0, _g % _n, 0)")).withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    tailed = F.expr("array_join(transform(_w, (w, i) -> IF(i < _a, w, _w[int(_a + (i - _a) % _p)])), ' ')")
    docs = docs.select("doc_id", F.when(F.col("_tailed") & (F.col("_n") > 0), tailed).otherwise(F.col("text")).alias("text"))
    found = periodic_runs(docs, keep=["doc_id"])
    listed = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "strongest.start",
        "strongest.length",
        "strongest.period",
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


PHRASE_SQL = r"""WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
u AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS u FROM t),
p AS (SELECT lang, regexp_extract_all(u, '[^\x20\x09]+') AS w FROM u),
g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
 FROM (SELECT lang, w, k, unnest(range(1, CAST(len(w) AS BIGINT) - k + 2)) AS i FROM p CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, f AS a FROM f WHERE k > 1 AND f >= 100),
s AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c AS q WHERE q.lang = c.lang AND q.k > c.k
 AND contains(' ' || q.phrase || ' ', ' ' || c.phrase || ' ') AND 100 * q.a >= 100 * c.a)),
d AS (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM s),
x AS (SELECT d.lang, d.phrase, d.a, d.cut, l.f AS l, r.f AS r, n.n, CAST((1000::HUGEINT * d.a * n.n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
 FROM d JOIN f AS l ON l.lang = d.lang AND l.phrase = array_to_string(w[1 : cut], ' ')
 JOIN f AS r ON r.lang = d.lang AND r.phrase = array_to_string(w[cut + 1 : d.k], ' ') JOIN n ON n.lang = d.lang),
y AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM y WHERE o = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM z WHERE rank <= 2000"""


@query("op12_phrase_collocations", PHRASE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))
