"""The registered queries: against SQL where there is some, and all of them on empty tables."""

import pytest

import corpus_pipeline
from tests.oracle import TABLES, compare, connect
from tidemark.llm import queries
from tidemark.plans.registry import Query

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    assert compare(spark, connect(SF), SF, name, Query(queries.QUERIES[name], queries.SQL[name])) == ""


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    """All tables without rows."""
    root = tmp_path_factory.mktemp("empty")
    for t in TABLES:
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{root}/{t}.parquet")
    return str(root)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, nothing, name):
    rows = queries.QUERIES[name](spark, nothing).collect()
    assert [r.conv_id for r in rows] == [-7] if name.startswith("op1_") else rows == []


def test_pipeline_on_empty_documents(spark, nothing):
    assert corpus_pipeline.run(spark, nothing).collect() == []


def test_some_rows_are_hit(spark):
    assert {r.verdict for r in queries.QUERIES["op7_url_filters"](spark, SF).collect()} >= {"blocked", "allowed"}
    found = {r.licenses for r in queries.QUERIES["op3_license_scan"](spark, "/root/testdata/sf0.01").collect()}
    assert {"MIT", "Apache-2.0", "GPL-3.0", "CC-BY-NC-4.0", "All-rights-reserved"} <= found
