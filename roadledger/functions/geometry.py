"""Boxes as four columns x1, y1, x2, y2, with an optional prefix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x1", "y1", "x2", "y2")


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(prefix + s) for s in SIDES)  # type: ignore[return-value]


def whole(pixel: Column) -> Column:
    """A coordinate cut toward zero."""
    return pixel.cast("bigint")


def centre(a: Column, b: Column) -> Column:
    """The middle as a double."""
    return (a + b) / F.lit(2.0)


def centre_floor(a: Column, b: Column) -> Column:
    """The middle, rounded down, also for negative coordinates."""
    return F.floor((a + b) / F.lit(2.0))


def overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union; 0.0 wherever nothing is shared, so nothing is divided by zero."""
    wide = F.greatest(F.lit(0).cast("bigint"), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    high = F.greatest(F.lit(0).cast("bigint"), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    shared = wide * high
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return F.when(shared == 0, F.lit(0.0)).otherwise(shared.cast("double") / (area(a) + area(b) - shared))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def crop_origin(side: Column) -> Column:
    """Crops begin inside the frame."""
    return F.greatest(F.lit(0).cast("bigint"), side)


def scaled_height(width: Column, height: Column, max_width: int) -> Column:
    """Height after a frame wider than max_width is scaled down to it."""
    return F.when(width > max_width, F.floor(height * (F.lit(float(max_width)) / width))).otherwise(height)


def scaled_width(width: Column, max_width: int) -> Column:
    return F.least(width, F.lit(max_width).cast("bigint"))
