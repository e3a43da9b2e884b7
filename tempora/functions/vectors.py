"""Vectors and signals as expressions over arrays; float arrays are computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where either vector is zero, so that no NaN can win a ranking."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def l2_normalize(v: Column) -> Column:
    # The norm is bound by a lambda of its own, or it would be computed for each element.
    scaled = F.transform(F.array(norm(v)), lambda n: F.transform(doubles(v), lambda x: F.when(n > 0, x / n).otherwise(0.0)))
    return F.get(scaled, F.lit(0))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(v: Column) -> Column:
    top = F.array_max(doubles(v))
    e = F.transform(doubles(v), lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / total(e))


def rms(v: Column, floor: float = 1e-12) -> Column:
    return F.sqrt(dot(v, v) / F.size(v) + floor)


def peak_normalize(v: Column) -> Column:
    peak = F.array_max(F.transform(doubles(v), F.abs))
    return F.transform(doubles(v), lambda x: F.when(peak > 0, x / peak).otherwise(x))


def residual(raw: Column, clean: Column) -> Column:
    """What is left of raw once clean is taken away, on their common length and within [-1, 1]."""
    n = F.least(F.size(raw), F.size(clean))
    return F.zip_with(F.slice(doubles(raw), 1, n), F.slice(doubles(clean), 1, n), lambda x, y: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x - y)))
