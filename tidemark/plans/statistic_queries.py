"""Queries over distributions, agreement and resampled intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.digests import draw_index_sql
from tidemark.functions.measures import round_double
from tidemark.operators import statistics as st
from tidemark.operators.quantiles import LINEAR, exact_quantiles
from tidemark.plans.inputs import EV, LINES, QA, RUNS, judged, lifecycle, line_spans, runs, table
from tidemark.plans.registry import query


def rounded(df, places: int, *columns: str):
    kinds = dict(df.dtypes)
    return df.withColumns({c: round_double(F.col(c), places) if kinds[c] == "double" else F.round(c, places) for c in columns})


@query("percentile_linear", f"WITH {RUNS} SELECT method, round(quantile_cont(metric,0.5),3) AS p50, round(quantile_cont(metric,0.95),3) AS p95, round(quantile_cont(metric,0.99),3) AS p99 FROM runs GROUP BY 1")
def _(spark, sf):
    out = exact_quantiles(runs(spark, sf), ["method"], "metric", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, method=LINEAR)
    return rounded(out, 3, "p50", "p95", "p99")


@query("percentile_nearest_rank", f"WITH {RUNS} SELECT method, quantile_disc(metric,0.5) AS p50, quantile_disc(metric,0.95) AS p95, quantile_disc(metric,0.99) AS p99 FROM runs GROUP BY 1")
def _(spark, sf):
    return exact_quantiles(runs(spark, sf), ["method"], "metric", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("median_exact", f"WITH {RUNS} SELECT question, median(metric) AS median FROM runs GROUP BY 1")
def _(spark, sf):
    return st.median_exact(runs(spark, sf), ["question"], "metric")


@query("geometric_mean", f"WITH {EV} SELECT stream, round(exp(avg(ln(cents)) FILTER (cents > 0)),4) AS geometric_mean FROM ev GROUP BY 1")
def _(spark, sf):
    return lifecycle(spark, sf).groupBy("stream").agg(round_double(st.geometric_mean(F.col("cents")), 4).alias("geometric_mean"))


def dist_sql(keys: str, src: str, value: str) -> str:
    return f"""SELECT {keys}, count(*) AS n, CAST(sum({value}) AS BIGINT) AS total, max({value}) AS max_value, quantile_disc({value},0.5) AS p50, quantile_disc({value},0.9) AS p90,
 quantile_disc({value},0.95) AS p95, quantile_disc({value},0.99) AS p99, round(CAST(sum({value}) AS DOUBLE)/count(*),4) AS mean,
 round(stddev_pop({value}),4) AS stdev_pop, round(CASE WHEN quantile_disc({value},0.5)>0 THEN CAST(quantile_disc({value},0.99) AS DOUBLE)/quantile_disc({value},0.5) END,6) AS tail_amplification FROM {src} GROUP BY ALL"""


def dist_rounded(df):
    return rounded(rounded(df, 4, "mean", "stdev_pop"), 6, "tail_amplification")


@query("distribution_summary", f"WITH {EV} " + dist_sql("kind", "ev", "cents"))
def _(spark, sf):
    return dist_rounded(st.distribution_summary(lifecycle(spark, sf), ["kind"], "cents"))


@query(
    "duration_stats",
    f"""WITH {EV} SELECT kind, count(*) AS n, round(quantile_disc(publish_ns-arrival_ns,0.5)/1e9,9) AS p50_s, round(quantile_disc(publish_ns-arrival_ns,0.95)/1e9,9) AS p95_s,
 round(quantile_disc(publish_ns-arrival_ns,0.99)/1e9,9) AS p99_s, round(CAST(sum(publish_ns-arrival_ns) AS DOUBLE)/1e9,9) AS total_s, round(max(publish_ns-arrival_ns)/1e9,9) AS max_s FROM ev GROUP BY 1""",
)
def _(spark, sf):
    rows = lifecycle(spark, sf).select("kind", (F.col("publish_ns") - F.col("arrival_ns")).alias("d"))
    return st.duration_stats(rows, ["kind"], "d")


@query(
    "confusion_and_kappa",
    """WITH x AS (SELECT d.lang, quality=1 AS h, toxic=0 AS p FROM labels JOIN documents d USING (doc_id)), c AS (SELECT lang, count(*) FILTER (h AND p) AS tp, count(*) FILTER (NOT h AND NOT p) AS tn,
 count(*) FILTER (NOT h AND p) AS fp, count(*) FILTER (h AND NOT p) AS fn FROM x GROUP BY 1),
 e AS (SELECT *, CAST(tp+tn+fp+fn AS DOUBLE) AS n, CAST(tp+tn AS DOUBLE)/(tp+tn+fp+fn) AS o, (CAST(tp+fn AS DOUBLE)/(tp+tn+fp+fn))*(CAST(tp+fp AS DOUBLE)/(tp+tn+fp+fn)) + (1-CAST(tp+fn AS DOUBLE)/(tp+tn+fp+fn))*(1-CAST(tp+fp AS DOUBLE)/(tp+tn+fp+fn)) AS ch FROM c)
 SELECT lang, tp, tn, fp, fn, round(o,6) AS observed_agreement, round(CASE WHEN abs(ch-1)<=1e-9 THEN CASE WHEN abs(o-1)<=1e-9 THEN 1.0 ELSE 0.0 END ELSE (o-ch)/(1-ch) END,6) AS kappa FROM e""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    rows = table(spark, sf, "labels").join(docs, "doc_id").select("lang", (F.col("quality") == 1).alias("human"), (F.col("toxic") == 0).alias("predicted"))
    return rounded(st.confusion_and_kappa(rows, ["lang"], "human", "predicted"), 6, "observed_agreement", "kappa")


@query(
    "judge_agreement",
    """WITH x AS (SELECT CASE WHEN doc_id%11=0 THEN 'INVALID_OUTPUT' WHEN doc_id%13=0 THEN 'SERVICE_ERROR' ELSE 'SUCCESS' END AS st, quality=1 AS h, toxic=0 AS p, doc_id%3 AS shard FROM labels),
 c AS (SELECT shard, count(*) AS terminal_items, count(*) FILTER (st='SUCCESS') AS eligible_items, count(*) FILTER (st='INVALID_OUTPUT') AS invalid_output, count(*) FILTER (st='SERVICE_ERROR') AS service_error,
  count(*) FILTER (st='SUCCESS' AND h AND p) AS tp, count(*) FILTER (st='SUCCESS' AND NOT h AND NOT p) AS tn, count(*) FILTER (st='SUCCESS' AND NOT h AND p) AS fp, count(*) FILTER (st='SUCCESS' AND h AND NOT p) AS fn FROM x GROUP BY 1),
 e AS (SELECT *, CAST(tp+tn AS DOUBLE)/(tp+tn+fp+fn) AS o, (CAST(tp+fn AS DOUBLE)/(tp+tn+fp+fn))*(CAST(tp+fp AS DOUBLE)/(tp+tn+fp+fn)) + (1-CAST(tp+fn AS DOUBLE)/(tp+tn+fp+fn))*(1-CAST(tp+fp AS DOUBLE)/(tp+tn+fp+fn)) AS ch FROM c)
 SELECT shard, terminal_items, eligible_items, invalid_output, service_error, tp, tn, fp, fn, round(o,6) AS observed_agreement, round((o-ch)/(1-ch),6) AS kappa FROM e""",
)
def _(spark, sf):
    d = F.col("doc_id")
    labels = table(spark, sf, "labels")
    status = F.when(d % 11 == 0, "INVALID_OUTPUT").when(d % 13 == 0, "SERVICE_ERROR").otherwise("SUCCESS")
    results = labels.select("doc_id", (d % 3).alias("shard"), status.alias("status"), (F.col("toxic") == 0).alias("predicted"))
    human = labels.select("doc_id", (F.col("quality") == 1).alias("human"))
    return rounded(st.judge_agreement(results, human, ["shard"], "doc_id", "status", "human", "predicted"), 6, "observed_agreement", "kappa")


@query(
    "wilson_interval",
    f"""WITH {QA}, c AS (SELECT method, context, count(*) FILTER (judge_valid) AS n, count(*) FILTER (correct) AS k FROM qa GROUP BY ALL), z AS (SELECT *, 1.959963984540054::DOUBLE AS z, CAST(k AS DOUBLE)/n AS p FROM c)
 SELECT method, context, n, k, round(((p+z*z/(2.0*n)) - z*sqrt(p*(1-p)/n+z*z/(4.0*n*n)))/(1+z*z/n),6) AS wilson_low, round(((p+z*z/(2.0*n)) + z*sqrt(p*(1-p)/n+z*z/(4.0*n*n)))/(1+z*z/n),6) AS wilson_high FROM z""",
)
def _(spark, sf):
    counts = judged(spark, sf).groupBy("method", "context").agg(F.count_if("judge_valid").alias("n"), F.count_if(F.coalesce("correct", F.lit(False))).alias("k"))
    return rounded(st.wilson_interval(counts, "k", "n"), 6, "wilson_low", "wilson_high")


SPEEDUPS = """sp AS (SELECT question, CAST(sum(metric) FILTER (method='1') AS DOUBLE)/count(*) FILTER (method='1') AS baseline, CAST(sum(metric) FILTER (method='2') AS DOUBLE)/count(*) FILTER (method='2') AS candidate
 FROM runs WHERE method IN ('1','2') GROUP BY 1 HAVING count(*) FILTER (method='1') > 0 AND count(*) FILTER (method='2') > 0),
 pr AS (SELECT question, baseline, candidate, CASE WHEN candidate > 0 THEN baseline/candidate ELSE 'inf'::DOUBLE END AS speedup FROM sp)"""


def speedups(spark, sf):
    return st.paired_speedups(runs(spark, sf), "question", "method", "metric", "1", "2")


@query("paired_speedups", f"WITH {RUNS}, {SPEEDUPS} SELECT question, round(baseline,4) AS baseline, round(candidate,4) AS candidate, round(speedup,6) AS speedup FROM pr")
def _(spark, sf):
    return rounded(rounded(speedups(spark, sf), 4, "baseline", "candidate"), 6, "speedup")


SAMPLES_GEO, SEED = 10_000, 20260806


@query(
    "bootstrap_ci_geomean",
    f"""WITH {RUNS}, {SPEEDUPS}, u AS (SELECT ln(speedup) AS l, row_number() OVER (ORDER BY question)-1 AS i, count(*) OVER () AS n FROM pr),
 dr AS (SELECT b, {draw_index_sql(SEED, "n", "b", "i")} AS i FROM u, (SELECT unnest(range({SAMPLES_GEO})) AS b)),
 g AS (SELECT b, exp(avg(l)) AS g FROM dr JOIN u USING (i) GROUP BY 1), r AS (SELECT g, row_number() OVER (ORDER BY g, b)-1 AS r, count(*) OVER () AS m FROM g)
 SELECT CAST(max(m) AS BIGINT) AS estimates, round(max(g) FILTER (r = floor(0.025*(m-1))),6) AS ci_low, round(max(g) FILTER (r = floor(0.975*(m-1))),6) AS ci_high FROM r""",
)
def _(spark, sf):
    out = st.bootstrap_ci_geomean(speedups(spark, sf), "question", "speedup", samples=SAMPLES_GEO, seed=SEED)
    return rounded(out, 6, "ci_low", "ci_high")


SAMPLES_CLUSTER = 2_000


def cluster_sql(per: str, estimate: str, by: str = "") -> str:
    """CTEs down to ``ci``, the interval per ``by`` (a column and a comma, or nothing)."""
    within = f"PARTITION BY {by.rstrip(', ')}" if by else ""
    key = f"u.{by.rstrip(', ')} = dr.{by.rstrip(', ')} AND " if by else ""
    return f"""per AS ({per}), u AS (SELECT *, row_number() OVER ({within} ORDER BY CAST(('0x'||substr(md5(c),1,12)) AS BIGINT), c)-1 AS i, count(*) OVER ({within}) AS n FROM per),
 dr AS (SELECT {by}b, {draw_index_sql(SEED, "n", "b", "i")} AS i FROM u, (SELECT unnest(range({SAMPLES_CLUSTER})) AS b)),
 e AS (SELECT {by and "dr." + by}dr.b, {estimate} AS e FROM dr JOIN u ON {key}u.i = dr.i GROUP BY ALL), r AS (SELECT {by}e, row_number() OVER ({within} ORDER BY e, b)-1 AS r, count(*) OVER ({within}) AS m FROM e WHERE e IS NOT NULL),
 ci AS (SELECT {by}CAST(max(m) AS BIGINT) AS estimates, round(max(e) FILTER (r = floor(0.025*(m-1))),6) AS ci_low, round(max(e) FILTER (r = floor(0.975*(m-1))),6) AS ci_high FROM r GROUP BY ALL)"""


ACCURACY = "CASE WHEN sum(v)>0 THEN CAST(sum(k) AS DOUBLE)/sum(v) END"


@query(
    "cluster_bootstrap_accuracy",
    f"WITH {QA}, " + cluster_sql("SELECT method, question_type AS c, count(*) FILTER (correct) AS k, count(*) FILTER (judge_valid) AS v FROM qa GROUP BY ALL", ACCURACY, "method, ") + " SELECT * FROM ci",
)
def _(spark, sf):
    rows = judged(spark, sf).select("method", "question_type", F.col("correct").cast("long").alias("k"), F.col("judge_valid").cast("long").alias("v"))
    return rounded(st.cluster_bootstrap(rows, "question_type", ["k", "v"], st.ratio(F.col("k"), F.col("v")), samples=SAMPLES_CLUSTER, seed=SEED, by=["method"]), 6, "ci_low", "ci_high")


@query(
    "cluster_bootstrap_delta",
    f"WITH {QA}, "
    + cluster_sql(
        "SELECT question_type AS c, count(*) FILTER (method='A' AND correct) AS ka, count(*) FILTER (method='A' AND judge_valid) AS va, count(*) FILTER (method='B' AND correct) AS kb, count(*) FILTER (method='B' AND judge_valid) AS vb FROM qa GROUP BY 1",
        "CASE WHEN sum(va)>0 AND sum(vb)>0 THEN CAST(sum(kb) AS DOUBLE)/sum(vb) - CAST(sum(ka) AS DOUBLE)/sum(va) END",
    )
    + " SELECT * FROM ci",
)
def _(spark, sf):
    a, right, valid = F.col("method") == "A", F.coalesce(F.col("correct"), F.lit(False)), F.col("judge_valid")
    parts = {"ka": a & right, "va": a & valid, "kb": ~a & right, "vb": ~a & valid}
    rows = judged(spark, sf).select("question_type", *[c.cast("long").alias(n) for n, c in parts.items()])
    delta = st.ratio(F.col("kb"), F.col("vb")) - st.ratio(F.col("ka"), F.col("va"))
    return rounded(st.cluster_bootstrap(rows, "question_type", list(parts), delta, samples=SAMPLES_CLUSTER, seed=SEED), 6, "ci_low", "ci_high")


@query(
    "paired_history_summary",
    f"""WITH {RUNS}, {SPEEDUPS} SELECT question % 10 AS block, round(CASE WHEN min(speedup)>0 THEN exp(avg(ln(speedup))) END,6) AS geometric_mean, round(min(speedup),6) AS min_value, round(max(speedup),6) AS max_value,
 CASE WHEN min(speedup)>0 THEN 'DEFINED' ELSE 'NOT_DEFINED_NON_POSITIVE_VALUES' END AS geometric_mean_status, round(median(speedup),6) AS median FROM pr GROUP BY 1""",
)
def _(spark, sf):
    rows = speedups(spark, sf).withColumn("block", F.col("question") % 10)
    return rounded(st.paired_history_summary(rows, ["block"], "speedup"), 6, "geometric_mean", "min_value", "max_value", "median")


@query(
    "prf_sets",
    f"""WITH {LINES}, l AS (SELECT DISTINCT phase, trace FROM lines WHERE status='O'), r AS (SELECT DISTINCT phase, trace FROM lines WHERE status='F'),
 c AS (SELECT coalesce(l.phase,r.phase) AS phase, count(*) FILTER (l.trace IS NOT NULL AND r.trace IS NOT NULL) AS matched, count(l.trace) AS left_size, count(r.trace) AS right_size FROM l FULL JOIN r ON l.phase=r.phase AND l.trace=r.trace GROUP BY 1)
 SELECT *, round(CAST(matched AS DOUBLE)/right_size,6) AS precision, round(CAST(matched AS DOUBLE)/left_size,6) AS recall, round(2.0*matched/(left_size+right_size),6) AS f1 FROM c""",
)
def _(spark, sf):
    rows = line_spans(spark, sf)
    return rounded(st.prf_sets(rows.filter("status = 'O'"), rows.filter("status = 'F'"), ["trace"], ["phase"]), 6, "precision", "recall", "f1")


@query(
    "paired_overhead_class",
    f"""WITH {RUNS}, {SPEEDUPS}, m AS (SELECT question % 10 AS block, median((candidate-baseline)/baseline) AS m FROM pr GROUP BY 1)
 SELECT block, round(m,6) AS median_overhead, CASE WHEN m<=0.02 THEN 'clean_pass' WHEN m<=0.05 THEN 'warning_continue' ELSE 'block_and_repair' END AS overhead_class FROM m""",
)
def _(spark, sf):
    rows = speedups(spark, sf).withColumn("block", F.col("question") % 10)
    return rounded(st.overhead_class(rows, ["block"], "baseline", "candidate"), 6, "median_overhead")


@query(
    "relabel_agreement",
    """WITH x AS (SELECT d.lang, doc_id % 6 <> 0 AS v, toxic=0 AS l, quality=1 AS o FROM labels JOIN documents d USING (doc_id))
 SELECT lang, count(*) AS question_count, count(*) FILTER (v) AS valid_count, count(*) FILTER (v AND l) AS correct_count, round(CAST(count(*) FILTER (v AND l) AS DOUBLE)/count(*) FILTER (v),6) AS accuracy,
 count(*) FILTER (v AND l=o) AS agreement_count, round(CAST(count(*) FILTER (v AND l=o) AS DOUBLE)/count(*) FILTER (v),6) AS agreement_rate FROM x GROUP BY 1""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    rows = table(spark, sf, "labels").join(docs, "doc_id").select("lang", (F.col("doc_id") % 6 != 0).alias("valid"), (F.col("toxic") == 0).alias("label"), (F.col("quality") == 1).alias("original"))
    return rounded(st.relabel_agreement(rows, ["lang"], "valid", "label", "original"), 6, "accuracy", "agreement_rate")
