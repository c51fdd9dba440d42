from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from roadledger.functions import geometry, speed
from roadledger.operators import detections

BOX = "x1 bigint, y1 bigint, x2 bigint, y2 bigint"


@pytest.mark.parametrize(
    "a, b, want",
    [((0, 0, 11, 10), (9, 0, 20, 10), 0.1), ((0, 0, 10, 10), (10, 0, 20, 10), 0.0), ((0, 0, 10, 10), (0, 0, 10, 10), 1.0), ((5, 5, 5, 5), (5, 5, 5, 5), 0.0)],
)
def test_overlap(spark, a, b, want):
    row = spark.createDataFrame([(*a, *b)], ", ".join(f"{p}{s} bigint" for p in ("", "b_") for s in geometry.SIDES))
    assert row.select(geometry.overlap(geometry.box(), geometry.box("b_"))).first()[0] == want


def test_a_contradiction_needs_more_than_the_threshold(spark):
    schema = "video_id bigint, frame_idx bigint, det_id bigint, " + BOX
    without = spark.createDataFrame([(1, 1, 1, 0, 0, 11, 10), (1, 1, 2, 9, 0, 19, 10), (1, 2, 3, 9, 0, 20, 10)], schema)
    helmets = spark.createDataFrame([(1, 1, 9, 9, 0, 20, 10)], schema)
    assert sorted(r["det_id"] for r in detections.uncontradicted(without, helmets).collect()) == [1, 3]


def test_nearest_ties_go_to_the_smaller_id_and_empty_frames_drop(spark):
    schema = "video_id bigint, frame_idx bigint, det_id bigint, " + BOX
    boxes = spark.createDataFrame([(1, 1, 1, 10, 0, 20, 10), (1, 2, 2, 0, 0, 1, 1)], schema)
    targets = spark.createDataFrame([(1, 1, 8, 0, 0, 10, 10), (1, 1, 3, 20, 0, 30, 10)], schema)
    assert [(r["det_id"], r["near_id"], r["distance"]) for r in detections.nearest(boxes, targets, "det_id").collect()] == [(1, 3, 10.0)]


def test_last_plate_wins_even_if_unreadable(spark):
    dets = spark.createDataFrame([(1, 1, 1, "Plate", ["MH 1"]), (1, 1, 2, "Plate", []), (1, 2, 1, "Plate", ["***"])], "video_id bigint, frame_idx bigint, det_id bigint, label string, ocr_texts array<string>")
    assert sorted(tuple(r) for r in detections.image_plates(dets).collect()) == [(1, 1, None), (1, 2, "")]


def test_calibration(spark):
    assert spark.range(1).select(speed.pixels_per_metre(F.lit(340.0), F.lit(5.0))).first()[0] == 68.0
    with pytest.raises(PySparkException):
        spark.range(1).select(speed.pixels_per_metre(F.lit(340.0), F.lit(0.0))).collect()
    row = spark.range(1).select(speed.kmh(F.lit(68), F.lit(0), F.lit(6), F.lit(1), 68.0, 10.0), speed.kmh(F.lit(1), F.lit(None).cast("int"), F.lit(1), F.lit(None).cast("int"), 68.0, 10.0)).first()
    assert tuple(row) == (7, 0)
    with pytest.raises(ValueError):
        speed.kmh(F.lit(1), F.lit(1), F.lit(1), F.lit(1), 0.0, 25.0)
