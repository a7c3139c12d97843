"""Vectors as array columns, in double precision and inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column, guard: float = 1e-9) -> Column:
    """v over its length; a length under the guard counts as the guard."""
    # the length is bound once: within the inner function it would be computed for each component
    return F.transform(F.array(F.greatest(norm(v), F.lit(guard))), lambda n: F.transform(v, lambda x: x.cast("double") / n))[0]


def rows_to_one(v: Column, guard: float = 1e-12) -> Column:
    """v over its sum, which is at least the guard."""
    return F.transform(v, lambda x: x / F.greatest(total(v), F.lit(guard)))


def dequantise(v: Column) -> Column:
    """Bytes 0..255 as shares of their sum."""
    return rows_to_one(F.transform(v, lambda x: x / F.lit(255.0)))


def entropy(p: Column) -> Column:
    """Entropy over its maximum, probabilities held in [1e-12, 1]."""
    clipped = lambda x: F.least(F.greatest(x, F.lit(1e-12)), F.lit(1.0))
    return F.aggregate(p, F.lit(0.0), lambda s, x: s - clipped(x) * F.ln(clipped(x))) / F.ln(F.size(p))


def predicted_known(p: Column, known: int) -> Column:
    """Whether a known class is at least as probable as the best of the others (0, if there are none)."""
    others = F.coalesce(F.array_max(F.slice(p, F.lit(known + 1), F.greatest(F.size(p) - known, F.lit(0)))), F.lit(0.0))
    return F.array_max(F.slice(p, 1, known)) >= others


def hellinger(v: Column) -> Column:
    return unit(F.transform(v, lambda x: F.sqrt(F.greatest(x, F.lit(0.0)))))
