"""What the operators of this folder share: table access, Arrow row maps and components of a link table."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.session import cut_lineage

#: Rows of one Arrow batch. Texts may be long, so this bounds what a Python worker holds at a time.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def text_batches(spark: SparkSession) -> SparkSession:
    """Ready for Python tasks that read whole texts: small Arrow batches, and this package sent to the executors once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        home = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark_code.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(home.rglob("*.py")):
                out.write(path, path.relative_to(home.parent))
        context.addPyFile(str(archive))
        _SHIPPED.add(context.applicationId)
    return spark


Worker = Callable[[list], dict[str, Sequence]]


def map_column(df: DataFrame, column: str, fields: Sequence[T.StructField], make: Callable[[], Worker], keep: Sequence[str] | None = None) -> DataFrame:
    """Append columns computed from one column, a batch at a time.

    ``make`` runs once per task and returns a function from the values of ``column`` to the new columns. ``keep`` names the
    input columns that stay (all by default). A kept column with the name of a new one gives way to it.
    """
    new = [f.name for f in fields]
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    schema = T.StructType([df.schema[c] for c in kept] + list(fields))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            found = work(batch.column(batch.schema.get_field_index(column)).to_pylist())
            arrays = [batch.column(batch.schema.get_field_index(c)).cast(arrow.field(c).type) for c in kept]
            arrays += [found[n] if isinstance(found[n], pa.Array) else pa.array(found[n], arrow.field(n).type) for n in new]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    text_batches(df.sparkSession)
    return df.select(*dict.fromkeys([*kept, column])).mapInArrow(run, schema)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back."""
    return cut_lineage(df, f"llm-{label}")


def written_counting(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    seen = Observation()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("n")), label)
    return out, int(seen.get["n"] or 0)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, label)`` for every node of an undirected link table; the label is the smallest node reachable.

    Each round hooks every node to its smallest neighbour, follows those pointers by doubling until they rest, and contracts
    the links to the roots. A node on its own never appears in ``links`` and gets no row. Rounds are cut by written tables, so
    that an executor lost later costs one round. Nothing but row counts reaches the driver.
    """
    spark = links.sparkSession
    node_type = links.schema[a].dataType
    labels = None
    edges = links.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y")
    edges = edges.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    edges, left = written_counting(edges, "links")
    while left:
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        parent = both.groupBy("x").agg(F.min("y").alias("p")).select(F.col("x").alias("node"), F.least("x", "p").alias("p"))
        parent, moving = written_counting(parent, "parents")
        while moving:
            up = parent.select(F.col("node").alias("p"), F.col("p").alias("q"))
            jumped = parent.join(up, "p").select("node", F.col("q").alias("p"), (F.col("q") != F.col("p")).cast("long").alias("moved"))
            seen = Observation()
            parent = written(jumped.observe(seen, F.sum("moved").alias("n")).select("node", "p"), "parents")
            moving = int(seen.get["n"] or 0)
        if labels is None:
            labels = parent.select("node", F.col("p").alias("label"))
        else:
            step = parent.select(F.col("node").alias("label"), F.col("p").alias("next"))
            labels = labels.join(step, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
        x = parent.select(F.col("node").alias("x"), F.col("p").alias("rx"))
        y = parent.select(F.col("node").alias("y"), F.col("p").alias("ry"))
        roots = edges.join(x, "x").join(y, "y").filter("rx <> ry")
        roots = roots.select(F.least("rx", "ry").alias("x"), F.greatest("rx", "ry").alias("y")).distinct()
        edges, left = written_counting(roots, "links")
    if labels is None:
        return spark.createDataFrame([], T.StructType([T.StructField("node", node_type), T.StructField("label", node_type)]))
    return written(labels, "components")
