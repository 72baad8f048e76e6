"""Where every named query and its DuckDB twin are registered."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import prepare

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: QueryFn
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register ``name``; without ``sql`` the query is checked by tests on small fixtures instead."""

    def add(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        run = lambda spark, sf_dir: fn(prepare(spark), sf_dir)
        run.__module__ = fn.__module__
        QUERIES[name] = Query(run, sql)
        return fn

    return add


def load_all(modules: list[str] | None = None) -> dict[str, Query]:
    import importlib

    for module in modules or MODULES:
        importlib.import_module(f"tidemark.plans.{module}")
    return QUERIES


MODULES = [
    "interval_queries",
    "statistic_queries",
    "rollup_queries",
    "record_queries",
    "join_queries",
    "retrieval_queries",
    "snapshot_queries",
    "dag_queries",
    "gate_queries",
    "stream_queries",
]
