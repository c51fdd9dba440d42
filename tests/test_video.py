"""Streaks, deferral and reports: the relational plan, the frame program and the stream agree."""

from __future__ import annotations

import random
import time

import pytest

from roadledger import schemas
from roadledger.config import Config
from roadledger.plans import catalog, video
from roadledger.sources import dims, files
from roadledger.sources import ledger as ledger_table
from roadledger.streaming import frames as program
from roadledger.streaming import progress


def det(k, label, x, y=0, texts=("MH01AB1",), size=10):
    return {"det_id": k, "label": label, "x1": x, "y1": y, "x2": x + size, "y2": y + size, "ocr_texts": list(texts)}


def scene(bare=1, texts=("MH01AB1",), extra=()):
    return [det(1, "Plate", 0, texts=texts), *(det(2 + k, "WithoutHelmet", 0, 30 + 40 * k) for k in range(bare)), *extra]


VIDEOS = {
    "four frames are too few": ([scene()] * 4, 0),
    "five confirm": ([scene()] * 5, 1),
    "two boxes count twice: two frames": ([scene(2)] * 2, 0),
    "two boxes count twice: three frames": ([scene(2)] * 3, 1),
    "an empty frame resets": ([scene()] * 3 + [[]] + [scene()] * 3, 0),
    "unreadable plates defer": ([scene(texts=())] * 6 + [scene(texts=("KA 5", "x1"))] * 2, 1),
    "marks alone are no plate": ([scene(texts=("***",))] * 8, 0),
    "ten empty frames keep the track": ([scene()] * 5 + [[]] * 10 + [scene()] * 5, 1),
    "eleven end it": ([scene()] * 5 + [[]] * 11 + [scene()] * 5, 2),
    "an unknown label is a helmet": ([scene(extra=[det(9, "Person", 0, 30)])] * 6, 0),
}


def tables(spark, videos):
    rows = [(v, f, d["det_id"], d["label"], 0.9, d["x1"], d["y1"], d["x2"], d["y2"], d["ocr_texts"]) for v, frames in videos.items() for f, found in enumerate(frames, 1) for d in found]
    return spark.createDataFrame(rows, schemas.DETECTIONS)


def stepped(videos, config):
    out = []
    for v, frames in videos.items():
        p = program.FrameProgram(config)
        for f, found in enumerate(frames, 1):
            out += [(v, *x) for x in p.step(f, found)]
    return sorted(out)


def planned(spark, videos, config):
    rows = video.violations(tables(spark, videos), dims.amounts(spark), config).collect()
    return sorted((r["video_id"], r["frame_idx"], r["track_id"], r["violation"], r["plate"]) for r in rows)


def test_cases(spark):
    videos = {k: frames for k, (frames, _) in enumerate(VIDEOS.values())}
    found = stepped(videos, Config())
    for k, (name, (_, want)) in enumerate(VIDEOS.items()):
        assert sum(x[0] == k for x in found) == want, name
    assert planned(spark, videos, Config()) == found
    assert [x[4] for x in found if x[0] == 5] == ["KA5X1"]


def random_frame(rng):
    plates = [det(0, "Plate", rng.randrange(0, 500, 9), rng.randrange(0, 90), rng.choice([(), ("***",), ("MH1", "AB2"), ("KA02C3",)])) for _ in range(rng.randrange(4))]
    others = [det(0, rng.choice(["WithoutHelmet", "WithoutHelmet", "TripleRiding", "WithHelmet", "?"]), rng.randrange(0, 500, 11), rng.randrange(0, 90), size=rng.choice((10, 30))) for _ in range(rng.randrange(5))]
    found = [] if rng.random() < 0.05 else plates + others
    rng.shuffle(found)
    return [{**d, "det_id": k} for k, d in enumerate(found, 1)]


@pytest.mark.parametrize("config", [Config(streak=3), Config(streak=2, pixels_per_metre=4.0), Config(streak=2, max_frames=30)])
def test_random_videos(spark, config):
    rng = random.Random(str(config))
    videos = {v: [random_frame(rng) for _ in range(50)] for v in range(40)}
    want = stepped(videos, config)
    assert len(want) > 20
    assert planned(spark, videos, config) == want


def test_stream_equals_batch(spark, sf):
    pick = ["video_id", "frame_idx", "track_id", "violation", "plate", "amount"]
    batch = catalog.video_violations(spark, sf).select(pick).collect()
    stream = catalog.stream_violations(spark, sf).select(pick).collect()
    assert batch and sorted(map(tuple, batch)) == sorted(map(tuple, stream))


def test_stream_restarts_where_it_ended(spark, tmp_path):
    frames = [scene()] * 8
    source, sink, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    config = Config()
    for start, part in ((1, frames[:4]), (5, frames[4:6]), (3, frames[2:8])):  # the last repeats frames that are done
        rows = [(7, f, [tuple(d[k] for k in ("det_id", "label", "x1", "y1", "x2", "y2", "ocr_texts")) for d in found]) for f, found in enumerate(part, start)]
        spark.createDataFrame(rows, schemas.FRAME_STREAM).coalesce(1).write.mode("append").parquet(source)
        program.run_to_end(files.frame_stream(spark, source), sink, marks, config)
    out = spark.read.schema(schemas.VIOLATIONS).parquet(sink).collect()
    assert [(r["video_id"], r["frame_idx"], r["violation"]) for r in out] == [(7, 5, "no_helmet")]


def test_summary(spark, sf):
    row = catalog.run_summary(spark, sf).selectExpr("sum(violations) v", "sum(frames) f", "count(*) n").first()
    assert row["n"] == 25 and row["f"] == 1500 and row["v"] == catalog.video_violations(spark, sf).count()


def test_a_stream_records_fines(spark, tmp_path):
    """What the stream confirms is in the ledger as unpaid fines, beside appended ones; a callback can record instead."""
    source, sink, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    rows = [(7, f, [tuple(d[k] for k in ("det_id", "label", "x1", "y1", "x2", "y2", "ocr_texts")) for d in scene()]) for f in range(1, 9)]
    spark.createDataFrame(rows, schemas.FRAME_STREAM).coalesce(1).write.parquet(source)
    ledger_table.create(spark, sink)
    program.run_to_end(files.frame_stream(spark, source), sink, marks, Config())
    ledger_table.record(spark.createDataFrame([("ka9", "overspeed", "x.jpg")], "plate string, violation string, image_path string"), sink, dims.amounts(spark))
    out = ledger_table.read(spark, sink).orderBy("id").collect()
    assert [(r["violation"], r["amount"], r["status"]) for r in out] == [("no_helmet", 500, "unpaid"), ("overspeed", 700, "unpaid")]
    assert out[0]["image_path"].startswith("evidence/") and all(r["timestamp"] is not None for r in out)
    told = []
    program.run_to_end(files.frame_stream(spark, source), sink, str(tmp_path / "more"), Config(), lambda df, n: told.extend(r["violation"] for r in df.collect()))
    assert told == ["no_helmet"] and ledger_table.read(spark, sink).count() == 2


def test_a_job_goes_on_by_itself_and_its_state_can_be_polled(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(7, f, [tuple(d[k] for k in ("det_id", "label", "x1", "y1", "x2", "y2", "ocr_texts")) for d in scene()]) for f in range(1, 9)]
    spark.createDataFrame(rows, schemas.FRAME_STREAM).coalesce(1).write.parquet(source)
    table = progress.JobTable(spark, str(tmp_path / "jobs"))
    listener = progress.Progress(table.report)
    spark.streams.addListener(listener)

    def fail(df, n):
        raise ValueError("no ledger")

    try:
        good = program.start(files.frame_stream(spark, source), sink, str(tmp_path / "a"), Config())
        bad = program.start(files.frame_stream(spark, source), sink, str(tmp_path / "b"), Config(), fail)
        for job in (good, bad):
            try:
                job.awaitTermination(120)
            except Exception as error:
                assert "no ledger" in str(error)
        for _ in range(120):
            states = {r["job_id"]: r for r in table.states().collect()} if (tmp_path / "jobs").exists() else {}
            if {r["status"] for r in states.values()} == {"done", "error"}:
                break
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(listener)
    assert (states[str(good.id)]["status"], states[str(good.id)]["done"]) == ("done", 8)
    assert states[str(bad.id)]["status"] == "error" and "no ledger" in states[str(bad.id)]["error"]


def test_state_does_not_grow_with_tracks_that_ended():
    """20,000 short tracks, one after the other, with reports and positions: what is kept is of the living ones."""
    import pickle

    state = program.FrameProgram(Config(streak=1, missed_frames=1, pixels_per_metre=4.0))
    sizes, reports = [], 0
    for k in range(20_000):
        reports += len(state.step(3 * k + 1, scene()))
        if k % 5000 == 10:
            sizes.append(len(pickle.dumps(state)))
    assert reports >= 20_000 and state.tracks.begun == 20_000
    assert len(state.reported) <= 2 and len(state.position) == 1 and max(sizes) < min(sizes) + 64


def test_the_command_line_text_of_a_stream():
    plate = {"ocr_texts": ["x?", "ka-01é", "z"], "ocr_confs": [0.4, 0.41, 0.9]}
    assert program.first_text(plate) == "KA01É" and program.joined_text(plate) == "XKA01Z"
    assert program.first_text({"ocr_texts": ["a"], "ocr_confs": [0.2]}) is None and program.first_text({"ocr_texts": None, "ocr_confs": None}) is None


def test_the_command_line_stream_equals_its_batch(spark, sf, tmp_path):
    from pyspark.sql import functions as F

    from roadledger.functions import geometry
    from roadledger.sources import fixtures

    dets = fixtures.detections(spark, sf)
    packed = dets.groupBy("video_id", "frame_idx").agg(F.collect_list(F.struct("det_id", "label", *geometry.SIDES, "ocr_texts", "ocr_confs")).alias("detections"))
    frames = fixtures.frames(spark, sf).select("video_id", "frame_idx").join(packed, ["video_id", "frame_idx"], "left")
    source, sink, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    frames.withColumn("detections", F.coalesce("detections", F.array().cast(packed.schema["detections"].dataType))).repartition("video_id").write.parquet(source)
    program.run_to_end(files.frame_stream(spark, source, 1000, schemas.READ_FRAME_STREAM), sink, marks, catalog.CALIBRATED, text=program.first_text)
    pick = ["video_id", "frame_idx", "track_id", "violation", "plate", "amount"]
    batch = catalog.cli_video_violations(spark, sf).select(pick).collect()
    stream = spark.read.schema(schemas.VIOLATIONS).option("recursiveFileLookup", "true").parquet(sink).select(pick).collect()
    assert batch and sorted(map(tuple, batch)) == sorted(map(tuple, stream))


def test_a_micro_batch_is_held_in_blocks():
    """Any number of parts in any order, repeated frames too: each frame once, in order, with few rows in memory."""
    rng = random.Random(3)
    numbers = [*range(1, 3000), *range(500, 600)]
    rng.shuffle(numbers)
    rows = program.Runs(block=4, most=3)
    for k in range(0, len(numbers), 50):
        rows.add([(n, str(n)) for n in numbers[k : k + 50]])
    assert len(rows.levels) > 2 and all(len(runs) <= 3 for _, runs in rows.levels)
    assert list(rows) == [(n, str(n)) for n in range(1, 3000)]
    tidy = program.Runs()
    for k in range(0, 1000, 100):
        tidy.add([(n, "") for n in range(k, k + 100)])
    assert [len(runs) for _, runs in tidy.levels] == [1] and [n for n, _ in tidy] == list(range(1000))


def test_memory_of_a_stream_does_not_grow_with_its_micro_batch():
    import json
    import tracemalloc

    import pandas as pd

    class State:
        exists = False

        def update(self, value):
            pass

    class Frames:
        """Stands in for the stream; gives the function that Spark would call."""

        def select(self, *_):
            return self

        groupBy = select

        def applyInPandasWithState(self, fn, *_):
            return fn

    update = program.detect(Frames(), Config(streak=1, missed_frames=1))
    text, peaks = json.dumps(scene()), []
    for parts in (program.RUNS, 4 * program.RUNS):
        made = (pd.DataFrame({"frame_idx": range(k * 100 + 1, k * 100 + 101), "detections": [text + " " * n for n in range(100)]}) for k in reversed(range(parts)))
        tracemalloc.start()
        found = sum(len(x) for x in update((7,), made, State()))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert found == 1
    assert peaks[1] < 1.5 * peaks[0]


def test_odd_numbers_in_a_frame(spark, tmp_path):
    """Confidences that are no number, null texts and a null list of detections pass through the stream."""
    source, sink, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    plate = (1, "Plate", 0, 0, 10, 10, [None, "ka\"1", "x"], [float("nan"), float("inf"), 0.1])
    bare = (2, "WithoutHelmet", 0, 30, 10, 40, [], [])
    spark.createDataFrame([(7, f, [bare, plate]) for f in range(1, 7)] + [(7, 7, None)], schemas.READ_FRAME_STREAM).write.parquet(source)
    program.run_to_end(files.frame_stream(spark, source, 1000, schemas.READ_FRAME_STREAM), sink, marks, Config(), text=program.first_text)
    out = spark.read.schema(schemas.VIOLATIONS).option("recursiveFileLookup", "true").parquet(sink).collect()
    assert [(r["frame_idx"], r["plate"]) for r in out] == [(5, "KA1")]
