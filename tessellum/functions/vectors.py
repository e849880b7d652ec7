"""Vectors as arrays: cosine similarity in double precision, padding for storage.  No Python runs here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STORED = 2000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def cosine(a: Column, b: Column, b_norm: float | None = None) -> Column:
    """a . b / (|a| |b|) of arrays of doubles; NaN where a length is 0, null for unlike lengths."""
    size = norm(a) * (norm(b) if b_norm is None else F.lit(b_norm))
    value = F.when(size == 0, F.lit(float("nan"))).otherwise(F.try_divide(dot(a, b), size))
    return F.when(F.size(a) == F.size(b), value)


def cosine_distance(a: Column, b: Column, b_norm: float | None = None) -> Column:
    return 1 - cosine(a, b, b_norm)


def padded(v: Column, size: int = STORED) -> Column:
    """v with zeros behind it; longer vectors are an error."""
    wide = F.concat(v, F.array_repeat(F.lit(0).cast("float"), F.greatest(F.lit(size) - F.size(v), F.lit(0))))
    return F.when(F.size(v) > size, F.raise_error(F.format_string(f"a vector of %d dimensions is beyond the {size} that are stored", F.size(v)))).otherwise(wide)
