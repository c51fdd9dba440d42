"""File names, evidence paths and report texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def evidence_url(path: Column) -> Column:
    """Null for a null path."""
    return F.concat(F.lit("/evidence/"), basename(path))


def evidence_path(plate: Column, violation: Column, video: Column, frame: Column, track: Column) -> Column:
    """A name from the event's keys, so names can't collide."""
    return F.concat(F.lit("evidence/"), F.concat_ws("_", plate, violation, video.cast("string"), frame.cast("string"), track.cast("string")), F.lit(".jpg"))


def extension(name: Column, default: str = ".jpg") -> Column:
    """The suffix of an uploaded file's name with its dot."""
    found = F.regexp_extract(basename(name), r"[^.](\.[^.]*)$", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(default))


def report_line(violation: Column, amount: Column, status: Column) -> Column:
    return F.concat(F.replace(violation, F.lit("_"), F.lit(" ")), F.lit(" ₹"), amount.cast("string"), F.lit(" ("), status, F.lit(")"))


def job_id() -> Column:
    """A random id for each row; not the same twice."""
    return F.uuid()
