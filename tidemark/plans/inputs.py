"""Adapters that shape the driver tables into the inputs of the operators, each with its SQL twin.

The Spark functions take ``(spark, sf_dir)``; the ``*_SQL`` strings are CTE bodies over the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ordered import ordered_scan

DAY_NS = 86_400_000_000_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def nanos(column: str):
    """Zone-free timestamp to epoch nanoseconds."""
    return F.unix_micros(F.col(column).cast("timestamp")) * 1000


def whole(column, unit: int):
    """Integer quotient of a non-negative long. ``/`` would go through a double, which nanoseconds do not fit."""
    return F.call_function("div", column, F.lit(unit))


# --- lifecycles: one row per event; the wait is the first half of the time to publication ---


def lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    cents = F.round(F.col("value") * 100).cast("long")
    return (
        table(spark, sf, "events")
        .select("user_id", "event_id", "event_type", nanos("ts").alias("arrival_ns"), cents.alias("cents"))
        .select(
            F.col("user_id").alias("stream"),
            "event_id",
            F.col("event_type").alias("kind"),
            "cents",
            "arrival_ns",
            (F.col("arrival_ns") + F.col("cents") * 500_000_000).alias("start_ns"),
            (F.col("arrival_ns") + F.col("cents") * 1_000_000_000).alias("publish_ns"),
        )
    )


EV = """ev0 AS (SELECT user_id AS stream, event_id, event_type AS kind, CAST(round(value*100) AS BIGINT) AS cents,
 epoch_us(ts)*1000 AS arrival_ns FROM events),
ev AS (SELECT *, arrival_ns + cents*500000000 AS start_ns, arrival_ns + cents*1000000000 AS publish_ns,
 row_number() OVER (PARTITION BY stream ORDER BY arrival_ns, event_id) - 1 AS seq FROM ev0)"""


def sequenced(spark: SparkSession, sf: str, *, share: int | None = None) -> DataFrame:
    """Lifecycle rows numbered from 0 per stream in arrival order, about ``share`` rows to a task where that is given."""
    rows = ordered_scan(lifecycle(spark, sf), ["stream"], ["arrival_ns", "event_id"], rank="seq", share=share)
    return rows.withColumn("seq", F.col("seq") - 1)


# --- spans: every order is a trace with one root; its lines are the children ---


def line_spans(spark: SparkSession, sf: str) -> DataFrame:
    days = F.col("l_quantity").cast("long")
    start = nanos("l_shipdate")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("trace"),
        F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("span_id"),
        F.col("l_returnflag").alias("phase"),
        F.col("l_linestatus").alias("status"),
        start.alias("start_ns"),
        (start + days * DAY_NS).alias("end_ns"),
        days.alias("quantity"),
        F.round("l_extendedprice").cast("long").alias("price"),
    )


LINES = f"""lines AS (SELECT l_orderkey AS trace, concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS span_id,
 l_returnflag AS phase, l_linestatus AS status, epoch_us(l_shipdate)*1000 AS start_ns,
 epoch_us(l_shipdate)*1000 + CAST(l_quantity AS BIGINT)*{DAY_NS} AS end_ns,
 CAST(l_quantity AS BIGINT) AS quantity, CAST(round(l_extendedprice) AS BIGINT) AS price FROM lineitem)"""


def root_spans(spark: SparkSession, sf: str) -> DataFrame:
    """One root per order that has lines: from the order date to the last end (never before its own start)."""
    ends = line_spans(spark, sf).groupBy("trace").agg(F.max("end_ns").alias("_end"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("trace"), nanos("o_orderdate").alias("start_ns"))
    return orders.join(ends, "trace").select("trace", "start_ns", F.greatest("_end", "start_ns").alias("end_ns"))


ROOTS = """roots AS (SELECT o_orderkey AS trace, epoch_us(o_orderdate)*1000 AS start_ns,
 greatest(m, epoch_us(o_orderdate)*1000) AS end_ns
 FROM orders JOIN (SELECT trace, max(end_ns) AS m FROM lines GROUP BY 1) ON trace = o_orderkey)"""


# --- runs: question = customer, method = priority, metric = order value ---


def runs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("question"),
        F.substring("o_orderpriority", 1, 1).alias("method"),
        F.col("o_orderkey").alias("run_id"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("metric"),
        F.col("o_orderstatus").alias("status"),
        nanos("o_orderdate").alias("at_ns"),
    )


RUNS = """runs AS (SELECT o_custkey AS question, substring(o_orderpriority,1,1) AS method, o_orderkey AS run_id,
 CAST(round(o_totalprice*100) AS BIGINT) AS metric, o_orderstatus AS status, epoch_us(o_orderdate)*1000 AS at_ns FROM orders)"""


# --- judged answers: every labelled document is answered by two methods ---


def judged(spark: SparkSession, sf: str) -> DataFrame:
    """Paired rows: method A is right where the document is good, method B where it is not toxic."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = table(spark, sf, "labels").join(docs, "doc_id")
    answer = F.explode(
        F.array(
            F.struct(F.lit("A").alias("method"), (F.col("quality") == 1).alias("said"), (F.col("doc_id") % 7 != 0).alias("judge_valid")),
            F.struct(F.lit("B").alias("method"), (F.col("toxic") == 0).alias("said"), (F.col("doc_id") % 5 != 0).alias("judge_valid")),
        )
    )
    return rows.select("doc_id", "lang", "source", "n_chars", answer.alias("_a")).select(
        F.col("_a.method").alias("method"),
        F.col("lang").alias("context"),
        F.col("doc_id").alias("item"),
        F.col("source").alias("question_type"),
        F.col("_a.judge_valid").alias("judge_valid"),
        F.when(F.col("_a.judge_valid"), F.col("_a.said")).alias("correct"),
        F.col("n_chars"),
    )


QA = """lab AS (SELECT l.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM labels l JOIN documents d USING (doc_id)),
qa AS (SELECT 'A' AS method, lang AS context, doc_id AS item, source AS question_type, doc_id % 7 <> 0 AS judge_valid,
 CASE WHEN doc_id % 7 <> 0 THEN quality = 1 END AS correct, n_chars FROM lab
 UNION ALL SELECT 'B', lang, doc_id, source, doc_id % 5 <> 0, CASE WHEN doc_id % 5 <> 0 THEN toxic = 0 END, n_chars FROM lab)"""


# --- state samples: one gauge reading per event, per kind ---


def samples(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle(spark, sf).select("kind", "event_id", F.col("arrival_ns").alias("ts"), "stream", "cents", (F.col("cents") % 8).alias("depth"))


SAMPLES = "smp AS (SELECT kind, event_id, arrival_ns AS ts, stream, cents, cents % 8 AS depth FROM ev)"


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations")
