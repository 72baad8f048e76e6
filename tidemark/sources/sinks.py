"""Writers for metric tables, CSV tables and run manifests. Every writer leaves the work spread over the tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parquet_metrics(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_csv_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Headed CSV parts; the parts are not merged, so a table of any size keeps its parallelism."""
    df.write.mode(mode).option("header", True).csv(path)


def run_manifest(plan: DataFrame, statuses: DataFrame, run: str, status: str) -> DataFrame:
    """The plan with each run's status, MISSING where none was reported."""
    return plan.join(statuses.select(run, status), run, "left").withColumn(status, F.coalesce(F.col(status), F.lit("MISSING")))


def write_run_manifest(plan: DataFrame, statuses: DataFrame, run: str, status: str, path: str) -> None:
    run_manifest(plan, statuses, run, status).write.parquet(path)
