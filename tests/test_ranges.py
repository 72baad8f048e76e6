"""Hot keys: with a tiny task limit every ordered scan is cut into ranges and must give the same rows."""

import pytest
from pyspark.sql import functions as F

from tests.oracle import compare, connect
from tidemark.operators.ordered import ROWS_PER_TASK_CONF, Running, measure, ordered_scan, with_ranges
from tidemark.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES = registry.load_all()
PICKS = ["interval_union", "merge_intervals", "concurrency_sweep", "backlog_series", "ordering_summary", "previous_window", "percentile_nearest_rank", "union_streams", "bm25_topk", "value_chain_pairs"]


@pytest.fixture
def tiny_tasks(spark):
    spark.conf.set(ROWS_PER_TASK_CONF, "30")
    yield
    spark.conf.unset(ROWS_PER_TASK_CONF)


@pytest.mark.parametrize("name", PICKS)
def test_cut_into_ranges_gives_the_same(spark, tiny_tasks, name):
    assert compare(spark, connect(SF), SF, name, QUERIES[name]) == ""


def test_one_key_with_most_rows(spark):
    # A third and more of all rows belong to key 0.
    rows = spark.range(3000).select(F.when(F.col("id") % 3 != 2, 0).otherwise(F.col("id") % 50).alias("k"), (F.col("id") * 7919 % 3001).alias("t"), (F.col("id") % 11).alias("v"))
    args = dict(lag={"p": "v"}, lead={"n": "v"}, rank="r", running={"s": Running("sum", F.col("v")), "m": Running("max", F.col("v"), False)}, total={"a": Running("sum", F.col("v"))})
    whole = ordered_scan(rows, ["k"], ["t"], **args, hot=1).collect()
    spark.conf.set(ROWS_PER_TASK_CONF, "100")
    try:
        cut = ordered_scan(rows, ["k"], ["t"], **args).collect()
        order = ordered_scan(rows, [], ["t"], rank="r").collect()
    finally:
        spark.conf.unset(ROWS_PER_TASK_CONF)
    assert sorted(map(tuple, whole), key=str) == sorted(map(tuple, cut), key=str)
    assert [r.r for r in sorted(order, key=lambda r: r.t)] == list(range(1, 3001))


def test_one_value_in_all_rows_is_split(spark):
    rows = spark.range(5000).select(F.lit(0).alias("head"), F.col("id").alias("x"))
    sizes = {r["_range"]: r["count"] for r in with_ranges(rows, ["head", "x"], 10).groupBy("_range").count().collect()}
    assert len(sizes) == 10 and max(sizes.values()) < 1500
    firsts = with_ranges(rows, ["head", "x"], 10).groupBy("_range").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("_range").collect()
    assert all(a.hi < b.lo for a, b in zip(firsts, firsts[1:]))


def test_one_job_measures_a_scan(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), "id").repartition(3)
    assert measure(rows, ["k"]) == (1000, 334) and measure(rows, []) == (1000, 1000)


def test_keys_are_dealt_by_rows(spark):
    """Narrow rows of many keys: a task takes a share of the rows, however few bytes they are."""
    rows = spark.range(9000).select((F.col("id") % 300).alias("k"), "id")
    plain, shared = (ordered_scan(rows, ["k"], ["id"], rank="n", share=share) for share in (None, 1000))
    assert shared.rdd.getNumPartitions() == 9 and max(shared.groupBy(F.spark_partition_id()).count().toPandas()["count"]) < 2500
    assert sorted(map(tuple, shared.collect())) == sorted(map(tuple, plain.collect()))
