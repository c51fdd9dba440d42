"""Work done once: shuffles, tables written, and boxes attributed in one pass as by the two steps."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roadledger import storage
from roadledger.functions import geometry
from roadledger.operators import detections
from roadledger.plans import catalog

BOXES = "video_id bigint, frame_idx bigint, det_id bigint, label string, x1 bigint, y1 bigint, x2 bigint, y2 bigint, lane bigint"


def boxes(spark):
    rng, rows = random.Random(8), []
    for v, f in ((v, f) for v in range(3) for f in range(60)):
        for d in range(1, rng.randrange(1, 12)):
            x, y, size = rng.randrange(0, 60, 10), rng.randrange(0, 60, 10), rng.choice((10, 20, 40))
            left = None if rng.random() < 0.03 else x
            rows.append((None if rng.random() < 0.02 else v, f, d, rng.choice(["Plate", "Plate", "WithoutHelmet", "TripleRiding", "Helmet?", None]), left, y, x + size, y + size, rng.randrange(3)))
    return spark.createDataFrame(rows, BOXES)


def in_two_steps(dets, more):
    label = detections.video_class(F.col("label"))
    free = detections.uncontradicted(dets.where(label == "WithoutHelmet"), dets.where(label == "WithHelmet"))
    targets = dets.where("label = 'Plate'")
    near = detections.nearest(free.unionByName(dets.where(label == "TripleRiding")).select("video_id", "frame_idx", "det_id", "label", *geometry.SIDES), targets, "det_id")
    lanes = targets.select("video_id", "frame_idx", F.col("det_id").alias("near_id"), *more)
    return near.join(lanes, ["video_id", "frame_idx", "near_id"])


@pytest.mark.parametrize("pairs", [detections.PAIRS, 3])
def test_attributed_as_in_two_steps(spark, pairs, monkeypatch):
    dets = boxes(spark)
    pick = ["video_id", "frame_idx", "det_id", "label", "near_id", "distance", "lane"]
    want = sorted(map(tuple, in_two_steps(dets, ["lane"]).select(pick).collect()), key=repr)
    found = detections.attributed(dets, dets.where("label = 'Plate'"), "det_id", "lane")
    assert len(want) > 100 and sorted(map(tuple, found.select(pick).collect()), key=repr) == want
    # the same by hand, in small batches and few pairs at a time
    monkeypatch.setattr(detections, "PAIRS", pairs)
    kinds = {k: n for n, k in enumerate(detections.KINDS)}
    rows = sorted((r for r in dets.withColumn("label", detections.video_class(F.col("label"))).collect() if r["video_id"] is not None), key=lambda r: (r["frame_idx"], r["video_id"]))
    table = pa.table({"kind": pa.array([kinds[r["label"]] for r in rows], pa.int32()), "id": [r["det_id"] for r in rows], **{c: [r[c] for r in rows] for c in ("video_id", "frame_idx", *geometry.SIDES, "lane")}})
    out = [x for b in detections._whole_frames(table.to_batches(max_chunksize=7)) for part in detections._attribute(b, 0.1, ("lane",)) for x in part.to_pylist()]
    assert sorted((tuple(detections.KINDS[x["kind"]] if c == "label" else x[c] for c in pick) for x in out), key=repr) == want


def test_attribution_shuffles_once(spark):
    dets = boxes(spark)
    found = detections.attributed(dets, dets.where("label = 'Plate'"), "det_id")
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name, label", [("record_fines", "detections"), ("centroid_tracker", "detections"), ("run_summary", "tracks"), ("run_summary_lanes", "tracks"), ("video_violations_lanes", "tracks")])
def test_tables_of_several_branches_are_made_once(spark, sf, monkeypatch, name, label):
    made, real = [], storage.written
    monkeypatch.setattr(storage, "written", lambda df, at: (made.append(at), real(df, at))[1])
    catalog.QUERIES[name](spark, sf)
    assert made.count(label) == 1


def test_numbering_detections_needs_no_shuffle_of_its_own(spark, sf):
    from roadledger.sources import fixtures

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = fixtures.detections(spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange hashpartitioning(video_id" not in plan
