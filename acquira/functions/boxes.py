"""Boxes as columns: centre form (cx, cy, w, h) of the unit square, corner form in pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def admissibility(objectness: Column, w: Column, h: Column) -> Column:
    """Objectness times the side of a square of the box's area."""
    return objectness * F.sqrt(F.greatest(w * h, F.lit(0.0)))


def corners(cx: Column, cy: Column, w: Column, h: Column, width=1.0, height=1.0) -> Box:
    x, y = F.lit(width) if not isinstance(width, Column) else width, F.lit(height) if not isinstance(height, Column) else height
    return (cx - w / 2) * x, (cy - h / 2) * y, (cx + w / 2) * x, (cy + h / 2) * y


def centred(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Box:
    return (x1 + x2) / 2 / width, (y1 + y2) / 2 / height, (x2 - x1) / width, (y2 - y1) / height


def _shared(a: Box, b: Box) -> tuple[Column, Column]:
    span = lambda lo1, lo2, hi1, hi2: F.greatest(F.least(hi1, hi2) - F.greatest(lo1, lo2), F.lit(0.0))
    both = span(a[0], b[0], a[2], b[2]) * span(a[1], b[1], a[3], b[3])
    area = lambda r: F.greatest(r[2] - r[0], F.lit(0.0)) * F.greatest(r[3] - r[1], F.lit(0.0))
    return both, area(a) + area(b) - both


def iou(a: Box, b: Box, guard: float | None = 1e-9) -> Column:
    """Overlap over union of corner boxes; the union is at least the guard, or, without one, an empty union gives 0."""
    both, union = _shared(a, b)
    return F.when(union > 0, both / union).otherwise(0.0) if guard is None else both / F.greatest(union, F.lit(guard))


def overlap_above(a: Box, b: Box, threshold: float, guard: float = 1e-9) -> Column:
    """Whether iou(a, b) is above the threshold, by its product with the union: a quotient rounds to the threshold where this doesn't."""
    both, union = _shared(a, b)
    return both > threshold * F.greatest(union, F.lit(guard))


def struct_corners(s: Column) -> Box:
    return s["x1"], s["y1"], s["x2"], s["y2"]


def square_crop(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column, margin: float) -> tuple[Column, Column, Column]:
    """Left, top and side in pixels of a square around a box with a margin, shifted into the image, no larger than it."""
    side = F.least(F.greatest(w * width, h * height) * (1 + margin), width, height)
    left = F.least(F.greatest(cx * width - side / 2, F.lit(0.0)), width - side)
    top = F.least(F.greatest(cy * height - side / 2, F.lit(0.0)), height - side)
    return F.bround(left), F.bround(top), F.greatest(F.bround(side), F.lit(1.0))
