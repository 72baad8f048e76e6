"""Ordered scans per key that stay parallel when one key holds a large share of the rows.

Everything that needs "the row before", a running total or a rank goes through :func:`ordered_scan`. It first measures
the largest key (a count with map-side combine). If that fits one task it is an ordinary window. If not, the order is cut
into ranges of about equal row counts over all its columns, each (key, range) is scanned on its own, one summary row per
(key, range) is scanned over the ranges, and its carry is joined back. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

ROWS_PER_TASK = 2_000_000
ROWS_PER_TASK_CONF = "spark.tidemark.rowsPerTask"


@dataclass(frozen=True)
class Running:
    """A running aggregate: ``how`` is sum, max or min; ``inclusive`` says whether the current row counts."""

    how: str
    expr: Column
    inclusive: bool = True


def rows_per_task(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(ROWS_PER_TASK_CONF, str(ROWS_PER_TASK)))


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the most frequent key combination; the count is combined map-side before it shuffles."""
    if not keys:
        return df.count()
    top = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
    return int(top or 0)


def group_bound(df: DataFrame, keys: Sequence[str], buckets: int = 16_384) -> int:
    """At least the rows of the most frequent key combination: keys are counted by hash, so a task sends ``buckets`` rows at most."""
    top = df.groupBy(F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("_b")).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
    return int(top or 0)


def measure(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Rows in all, and of the most frequent key combination: one job, combined map-side."""
    if not keys:
        rows = df.count()
        return rows, rows
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.sum("_n"), F.max("_n")).first()
    return int(n[0] or 0), int(n[1] or 0)


def with_ranges(df: DataFrame, order: Sequence[str], ranges: int) -> DataFrame:
    """``df`` written once with ``_range``, the number of a range of about equal rows in the order of all ``order`` columns.

    Spark's range partitioner samples the whole order, so a value that fills many ranges is cut by the columns after it.
    The rows are written because the numbers are read twice and must not be drawn twice.
    """
    return cut_lineage(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def _agg(how: str, column: Column) -> Column:
    return {"sum": F.sum, "max": F.max, "min": F.min}[how](column)


def _merge(how: str, carried: Column, local: Column) -> Column:
    if how == "sum":
        return F.when(carried.isNull(), local).when(local.isNull(), carried).otherwise(carried + local)
    return F.greatest(carried, local) if how == "max" else F.least(carried, local)


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    lag: Mapping[str, Column | str] | None = None,
    lead: Mapping[str, Column | str] | None = None,
    rank: str | None = None,
    running: Mapping[str, Running] | None = None,
    total: Mapping[str, Running] | None = None,
    hot: int | None = None,
    share: int | None = None,
) -> DataFrame:
    """Add columns that depend on the order of rows within ``keys``.

    ``order`` names columns that give a total order, all ascending. ``lag``/``lead`` take the
    neighbouring row's value, ``rank`` is the 1-based row number, ``running`` and ``total`` are aggregates over the
    prefix and over the whole key. ``hot`` is the size of the largest key when the caller knows a bound for it. With ``share``
    the keys are dealt to tasks of about that many rows; otherwise Spark chooses the tasks by bytes, which for narrow rows
    may be millions of rows, and what follows in the same task holds as many.
    """
    keys, order = list(keys), list(order)
    lag = {k: F.col(v) if isinstance(v, str) else v for k, v in (lag or {}).items()}
    lead = {k: F.col(v) if isinstance(v, str) else v for k, v in (lead or {}).items()}
    running, total = dict(running or {}), dict(total or {})
    rows = None
    if hot is None:
        rows, hot = measure(df, keys)
    limit = rows_per_task(df)
    if share and keys and hot <= limit:
        rows = df.count() if rows is None else rows
        if rows > share:
            df = df.repartition(max(-(-rows // share), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)
    if hot <= limit:
        return _plain_scan(df, keys, order, lag, lead, rank, running, total)
    rows = df.count() if rows is None else rows
    return _ranged_scan(df, keys, order, lag, lead, rank, running, total, -(-rows // limit) * 2)


def _plain_scan(df, keys, order, lag, lead, rank, running, total) -> DataFrame:
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    seq = by.orderBy(*order)
    upto, before = seq.rowsBetween(Window.unboundedPreceding, 0), seq.rowsBetween(Window.unboundedPreceding, -1)
    cols = {name: F.lag(c).over(seq) for name, c in lag.items()}
    cols |= {name: F.lead(c).over(seq) for name, c in lead.items()}
    if rank:
        cols[rank] = F.row_number().over(seq).cast("long")
    cols |= {n: _agg(r.how, r.expr).over(upto if r.inclusive else before) for n, r in running.items()}
    cols |= {n: _agg(r.how, r.expr).over(by) for n, r in total.items()}
    return df.withColumns(cols)


def _ranged_scan(df, keys, order, lag, lead, rank, running, total, ranges) -> DataFrame:
    part = [*keys, "_range"]
    cut = with_ranges(df, order, ranges)
    seq = Window.partitionBy(*part).orderBy(*order)
    upto, before = seq.rowsBetween(Window.unboundedPreceding, 0), seq.rowsBetween(Window.unboundedPreceding, -1)
    position = F.struct(*order)

    aggs = [F.count(F.lit(1)).alias("_rows")]
    if lag:
        aggs.append(F.max_by(F.struct(*[c.alias(n) for n, c in lag.items()]), position).alias("_last"))
    if lead:
        aggs.append(F.min_by(F.struct(*[c.alias(n) for n, c in lead.items()]), position).alias("_first"))
    aggs += [_agg(r.how, r.expr).alias(f"_run_{n}") for n, r in running.items()]
    aggs += [_agg(r.how, r.expr).alias(f"_tot_{n}") for n, r in total.items()]
    summary = cut.groupBy(*part).agg(*aggs)

    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    across = by.orderBy("_range")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    carry = [F.col(k).alias(f"_k_{k}") for k in part]
    carry += [F.col("_rows").alias("_c_rows"), F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_c_before")]
    if lag:
        carry.append(F.lag("_last").over(across).alias("_c_last"))
    if lead:
        carry.append(F.lead("_first").over(across).alias("_c_first"))
    carry += [_agg(r.how, F.col(f"_run_{n}")).over(earlier).alias(f"_c_run_{n}") for n, r in running.items()]
    carry += [_agg(r.how, F.col(f"_tot_{n}")).over(by).alias(f"_c_tot_{n}") for n, r in total.items()]
    carried = summary.select(*carry)

    local = {"_rn": F.row_number().over(seq)}
    local |= {f"_l_{n}": F.lag(c).over(seq) for n, c in lag.items()}
    local |= {f"_d_{n}": F.lead(c).over(seq) for n, c in lead.items()}
    local |= {f"_r_{n}": _agg(r.how, r.expr).over(upto if r.inclusive else before) for n, r in running.items()}
    scanned = cut.withColumns(local)
    condition = None
    for k in part:
        same = scanned[k].eqNullSafe(carried[f"_k_{k}"])
        condition = same if condition is None else condition & same
    joined = scanned.join(carried, condition, "inner")

    out = {n: F.when(F.col("_rn") == 1, F.col(f"_c_last.{n}")).otherwise(F.col(f"_l_{n}")) for n in lag}
    out |= {n: F.when(F.col("_rn") == F.col("_c_rows"), F.col(f"_c_first.{n}")).otherwise(F.col(f"_d_{n}")) for n in lead}
    if rank:
        out[rank] = (F.col("_rn") + F.col("_c_before")).cast("long")
    out |= {n: _merge(r.how, F.col(f"_c_run_{n}"), F.col(f"_r_{n}")) for n, r in running.items()}
    out |= {n: F.col(f"_c_tot_{n}") for n in total}
    return joined.withColumns(out).select(*df.columns, *out)


def sweep(
    changes: DataFrame,
    keys: Sequence[str],
    ts: str,
    deltas: Mapping[str, str],
    *,
    until: str = "next_ts",
    hot: int | None = None,
) -> DataFrame:
    """Step function from change rows: changes at one instant are netted, then summed over time.

    ``deltas`` maps the output level to the change column. Each output row holds on ``[ts, until)``; the last has NULL.
    """
    netted = changes.groupBy(*keys, ts).agg(*[F.sum(d).alias(f"_delta_{n}") for n, d in deltas.items()])
    levels = ordered_scan(
        netted,
        keys,
        [ts],
        lead={until: ts},
        running={n: Running("sum", F.col(f"_delta_{n}")) for n in deltas},
        hot=hot,
    )
    return levels.select(*keys, ts, until, *deltas)
