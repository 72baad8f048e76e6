"""Running a streaming query to the end of what its source holds now."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import fresh_path


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which operators with several state variables and timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def run_available(stream: DataFrame, path: str, checkpoint: str, *, fmt: str = "parquet", mode: str = "append") -> None:
    """Process everything available and stop; a second call with the same checkpoint goes on where this one ended."""
    stream.writeStream.format(fmt).outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def append_to_end(spark: SparkSession, source: str, schema, build: Callable[[DataFrame], DataFrame], heartbeat: DataFrame, label: str) -> DataFrame:
    """Run ``build`` over the files of ``source`` in append mode and return all rows it emits.

    Append mode holds rows back until the watermark passes them. So after the data a heartbeat (rows of the same schema
    with a far later time) is added and the query continued; the caller drops the heartbeat's own rows, if any.
    """
    out, checkpoint = fresh_path(spark, f"{label}-out"), fresh_path(spark, f"{label}-checkpoint")
    read = lambda: build(spark.readStream.schema(schema).parquet(source))
    run_available(read(), out, checkpoint)
    heartbeat.write.mode("append").parquet(source)
    run_available(read(), out, checkpoint)
    return spark.read.schema(read().schema).parquet(out)


def update_to_end(stream: DataFrame, label: str) -> DataFrame:
    """Run an update-mode query and return its change log with a ``batch_id``; the latest change of a key is its value."""
    spark = stream.sparkSession
    out, checkpoint = fresh_path(spark, f"{label}-log"), fresh_path(spark, f"{label}-checkpoint")

    def write(batch: DataFrame, batch_id: int) -> None:
        # A repeated batch replaces its own folder, so a retry cannot write twice.
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)
