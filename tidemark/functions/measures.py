"""Closed-form measures as column expressions over already aggregated columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the two-sided 95 % normal quantile.
Z95 = 1.959963984540054


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient as a double, NULL where the bottom is zero or missing."""
    return F.when(bottom != 0, top.cast("double") / bottom.cast("double"))


def round_double(value: Column, places: int) -> Column:
    """A double rounded half away from zero after scaling, all in doubles, as SQL engines do.

    ``F.round`` rounds the shortest decimal instead: 41/640 at six places is 0.064063 there, but scaled it lies below the half.
    """
    scale = 10.0**places
    return F.round(value.cast("double") * scale, 0) / scale


def wilson_bounds(successes: Column, total: Column, z: float = Z95) -> tuple[Column, Column]:
    """Score interval of a binomial share; NULL without trials."""
    n = total.cast("double")
    p = successes / n
    scale = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / scale
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    seen = total > 0
    return F.when(seen, mid - half), F.when(seen, mid + half)


def cohen_kappa(tp: Column, tn: Column, fp: Column, fn: Column) -> Column:
    """Chance-corrected agreement; 0 without rows, and 1 or 0 where both sides are constant."""
    n = (tp + tn + fp + fn).cast("double")
    seen = (tp + tn) / n
    yes_a, yes_b = (tp + fn) / n, (tp + fp) / n
    chance = yes_a * yes_b + (1 - yes_a) * (1 - yes_b)
    constant = F.abs(chance - 1) <= 1e-9
    return F.when(n == 0, 0.0).when(constant, F.when(F.abs(seen - 1) <= 1e-9, 1.0).otherwise(0.0)).otherwise((seen - chance) / (1 - chance))


def precision_recall_f1(hits: Column, left: Column, right: Column) -> dict[str, Column]:
    """Of ``right`` predicted and ``left`` wanted keys; 1/1/1 when both sets are empty."""
    empty = (left == 0) & (right == 0)
    p = F.coalesce(ratio(hits, right), F.lit(0.0))
    r = F.coalesce(ratio(hits, left), F.lit(0.0))
    f1 = F.coalesce(ratio(2 * p * r, p + r), F.lit(0.0))
    return {n: F.when(empty, 1.0).otherwise(c) for n, c in (("precision", p), ("recall", r), ("f1", f1))}


def amdahl(share: Column, workers: int) -> Column:
    """Speedup bound when ``share`` of the time runs on ``workers``."""
    return 1 / ((1 - share) + share / workers)
