"""Columns over array<float> vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column | str) -> Column:
    """V1. v / max(|v|, 1e-12). Vector and norm are bound once: inside a lambda they would be computed for each entry."""
    once = F.transform(F.array(_d(v)), lambda x: F.struct(x.alias("v"), F.greatest(F.sqrt(dot(x, x)), F.lit(1e-12)).alias("n")))
    return F.transform(once, lambda s: F.transform(s["v"], lambda x: x / s["n"]))[0]


def cosine(a: Column | str, b: Column | str) -> Column:
    """V2."""
    return dot(a, b) / (F.greatest(F.sqrt(dot(a, a)), F.lit(1e-12)) * F.greatest(F.sqrt(dot(b, b)), F.lit(1e-12)))


def combine(a: Column | str, b: Column | str) -> Column:
    """V3. Both normalised, joined, normalised."""
    return l2_normalize(F.concat(l2_normalize(a), l2_normalize(b)))


def mean_pool(vectors: Column | str, mask: Column | str) -> Column:
    """V4. Mean of the vectors (array of arrays) whose mask is 1; the mask's sum counts as 1 at least."""
    vectors = (F.col(vectors) if isinstance(vectors, str) else vectors).cast("array<array<double>>")
    mask = _d(mask)
    weighted = F.zip_with(vectors, mask, lambda v, m: F.transform(v, lambda x: x * m))
    zero = F.transform(F.element_at(vectors, 1), lambda x: F.lit(0.0))
    total = F.aggregate(weighted, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    n = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, m: s + m), F.lit(1.0))
    return F.transform(total, lambda x: x / n)
