"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def cosine_score(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """Cosine mapped to [0, 1]; NULL for vectors of other length, empty ones and zero vectors."""
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm_a > 0) & (norm_b > 0)
    return F.when(fits, (1 + dot(a, b) / (norm_a * norm_b)) / 2)


def prefix_number(text: Column) -> Column:
    """The first seven UTF-8 bytes as a number: grows with the string, so ranges of strings can be cut."""
    head = F.hex(F.substring(F.encode(F.coalesce(text, F.lit("")), "utf-8"), 1, 7))
    return F.conv(F.rpad(head, 14, "0"), 16, 10).cast("long")
