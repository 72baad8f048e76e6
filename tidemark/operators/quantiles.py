"""Exact order statistics per group without holding a group in one task.

Equal values are counted map-side, the running count over the distinct values comes from the ordered scan, and each
quantile is picked by rank with an ordinary aggregate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import Running, ordered_scan

NEAREST = "nearest"
LINEAR = "linear"


def _q(q: float) -> Column:
    return F.lit(float(q))


def nearest_position(q: float, n: Column) -> Column:
    """1-based position of the nearest-rank quantile: ``max(1, ceil(q * n))``, never past ``n``."""
    return F.least(F.greatest(F.lit(1), F.ceil(_q(q) * n)), n)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: Mapping[str, float],
    *,
    method: str = NEAREST,
    extra: Sequence[Column] = (),
    hot: int | None = None,
) -> DataFrame:
    """One row per key with the named quantiles of ``value``; NULL values are left out.

    ``extra`` aggregates see the columns ``value`` and ``_copies`` (rows holding that value).
    """
    keys = list(keys)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_copies"))
    ranked = ordered_scan(
        counted,
        keys,
        [value],
        running={"_upto": Running("sum", F.col("_copies"))},
        total={"_n": Running("sum", F.col("_copies"))},
        hot=hot,
    )
    below = F.col("_upto") - F.col("_copies")
    n = F.col("_n")
    picks = []
    for name, q in quantiles.items():
        if method == NEAREST:
            at = nearest_position(q, n)
            picks.append(F.max(F.when((F.col("_upto") >= at) & (below < at), F.col(value))).alias(name))
        else:
            spot = _q(q) * (n - 1)
            lo, hi = F.floor(spot), F.ceil(spot)
            v_lo = F.max(F.when((F.col("_upto") > lo) & (below <= lo), F.col(value)))
            v_hi = F.max(F.when((F.col("_upto") > hi) & (below <= hi), F.col(value)))
            frac = F.max(spot - lo)
            picks.append((v_lo + (v_hi - v_lo) * frac).cast("double").alias(name))
    return ranked.groupBy(*keys).agg(*picks, *extra)
