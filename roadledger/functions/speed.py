"""Speed from the horizontal way of a plate between two sightings, on event time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pixels_per_metre(pixels: Column, metres: Column) -> Column:
    """A calibration; lengths that aren't positive are an error."""
    return F.when(metres > 0, pixels / metres).otherwise(F.raise_error(F.lit("metres must be positive")).cast("double"))


def kmh(x: Column, last_x: Column, frame: Column, last_frame: Column, per_metre: float, fps: float) -> Column:
    """Whole km/h, cut; 0 for a first sighting."""
    if per_metre <= 0:
        raise ValueError("the calibration must be positive")
    seconds = (frame - last_frame) / F.lit(float(fps))
    metres = F.abs(x - last_x) / F.lit(float(per_metre))
    return F.when(seconds > 0, F.floor(metres / seconds * F.lit(3.6))).otherwise(F.lit(0).cast("bigint"))


def source_fps(fps: Column, default: float = 25.0) -> Column:
    """0 or null, as some sources report, means the default."""
    return F.coalesce(F.nullif(fps, F.lit(0.0)), F.lit(default))
