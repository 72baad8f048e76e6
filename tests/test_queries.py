"""Every registered query against its DuckDB twin on the smallest data."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect
from tidemark.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = registry.load_all()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_twin(spark, con, name):
    assert compare(spark, con, SF, name, QUERIES[name]) == ""


def test_every_query_has_a_twin():
    assert set(QUERIES) <= set(entry.queries())
    assert all(q.sql is not None for q in QUERIES.values())
    assert set(QUERIES) <= set(entry.oracle_sql())


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(r.busy_ns > 0 and r.active_max >= 1 for r in rows)
