"""Small numeric rules in which missing is NULL, never 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def schedule_weight(rank: Column, classes: Column, ratio: float) -> Column:
    """Long-tail weight: 1 for rank 0 down to 1 / ratio for the last."""
    return F.pow(F.lit(float(ratio)), -rank / F.greatest(classes - 1, F.lit(1)))


def exchange_rate(forgetting: Column, new: Column, current: Column) -> Column:
    """Forgetting for each unit learned; NULL if nothing was."""
    gain = F.coalesce(F.nullif(new, F.lit(0.0)), current)
    return forgetting / F.nullif(gain, F.lit(0.0))


def relative_gain(value: Column, base: Column) -> Column:
    return F.when(base > 0, (value - base) / base)


def meets(value: Column, threshold: float) -> Column:
    return F.coalesce(value >= threshold, F.lit(False))


def step_scale(update: Column, drop_at: int, factor: float = 0.1) -> Column:
    return F.when(update >= drop_at, F.lit(factor)).otherwise(F.lit(1.0))


def share_count(n: Column, share: float) -> Column:
    """Rows of a share, to even, one at least."""
    return F.greatest(F.bround(n * F.lit(float(share))).cast("long"), F.lit(1).cast("long"))


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))
