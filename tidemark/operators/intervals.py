"""Unions, merges and exclusive time of half-open intervals ``[start, end)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import Running, largest_group, ordered_scan, sweep


def longest_per_start(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Zero-length rows vanish; of the rows that start together only the longest can matter for a union."""
    return df.filter(F.col(end) > F.col(start)).groupBy(*keys, start).agg(F.max(end).alias(end))


def interval_union(
    df: DataFrame, keys: Sequence[str], start: str, end: str, out: str = "union_len", *, hot: int | None = None
) -> DataFrame:
    """Length of the union per key: each interval adds what reaches past every earlier one."""
    longest = longest_per_start(df, keys, start, end)
    seen = ordered_scan(longest, keys, [start], running={"_seen": Running("max", F.col(end), False)}, hot=hot)
    fresh = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), F.col("_seen")))
    return seen.groupBy(*keys).agg(F.sum(fresh).alias(out))


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str, *, hot: int | None = None) -> DataFrame:
    """The merged intervals. A row opens a new one when it starts after every earlier end; touching rows merge.

    The row that opens the next interval already carries this one's end, so no second pass over all rows is needed.
    """
    longest = longest_per_start(df, keys, start, end)
    seen = ordered_scan(
        longest,
        keys,
        [start],
        running={"_seen": Running("max", F.col(end), False)},
        total={"_last": Running("max", F.col(end))},
        hot=hot,
    )
    openers = seen.filter(F.col("_seen").isNull() | (F.col(start) > F.col("_seen")))
    closed = ordered_scan(openers, keys, [start], lead={"_close": "_seen"}, hot=hot)
    return closed.select(*keys, start, F.coalesce("_close", "_last").alias(end))


def clip(df: DataFrame, start: str, end: str, lo, hi) -> DataFrame:
    """Cut intervals to a window; what lies outside becomes zero-length and drops out of unions."""
    return df.withColumn(start, F.greatest(F.col(start), lo)).withColumn(end, F.least(F.col(end), hi))


def exclusive_duration(
    spans: DataFrame,
    keys: Sequence[str],
    span_id: str,
    parent_id: str,
    start: str,
    end: str,
    out: str = "exclusive",
) -> DataFrame:
    """Own time of each span: its length minus the union of its direct children cut to it."""
    keys = list(keys)
    parents = spans.select(*keys, F.col(span_id), F.col(start).alias("_ps"), F.col(end).alias("_pe"))
    children = (
        spans.filter(F.col(parent_id).isNotNull())
        .select(*keys, F.col(parent_id).alias(span_id), start, end)
        .join(parents, [*keys, span_id])
    )
    # Children per parent are counted on the spans themselves, before the join that cuts them.
    hot = largest_group(spans.filter(F.col(parent_id).isNotNull()), [*keys, parent_id])
    covered = interval_union(clip(children, start, end, F.col("_ps"), F.col("_pe")), [*keys, span_id], start, end, "_cov", hot=hot)
    return parents.join(covered, [*keys, span_id], "left").select(
        *keys, span_id, (F.col("_pe") - F.col("_ps") - F.coalesce("_cov", F.lit(0))).alias(out)
    )


def interval_changes(df: DataFrame, keys: Sequence[str], start: str, end: str, ts: str = "ts") -> DataFrame:
    """+1 at every start and -1 at every end, as rows ready for a sweep."""
    moves = F.explode(F.array(F.struct(F.col(start).alias(ts), F.lit(1).alias("step")), F.struct(F.col(end).alias(ts), F.lit(-1).alias("step"))))
    return df.filter(F.col(end) > F.col(start)).select(*keys, moves.alias("_m")).select(*keys, f"_m.{ts}", "_m.step")


def active_levels(df: DataFrame, keys: Sequence[str], start: str, end: str, *, hot: int | None = None) -> DataFrame:
    """How many intervals are open on each stretch: ``keys, ts, next_ts, active``."""
    bound = None if hot is None else 2 * hot
    return sweep(interval_changes(df, keys, start, end), keys, "ts", {"active": "step"}, hot=bound)


def both_active_time(
    left: DataFrame, right: DataFrame, keys: Sequence[str], start: str, end: str, out: str = "both_len"
) -> DataFrame:
    """Time covered by some left and some right interval at once.

    That is the union of all pairwise intersections, found in one sweep instead of an overlap join.
    """
    l = interval_changes(left, keys, start, end).withColumns({"_l": F.col("step"), "_r": F.lit(0)})
    r = interval_changes(right, keys, start, end).withColumns({"_l": F.lit(0), "_r": F.col("step")})
    levels = sweep(l.unionByName(r), keys, "ts", {"n_left": "_l", "n_right": "_r"})
    met = (F.col("n_left") > 0) & (F.col("n_right") > 0)
    return levels.groupBy(*keys).agg(F.sum(F.when(met, F.col("next_ts") - F.col("ts")).otherwise(0)).alias(out))
