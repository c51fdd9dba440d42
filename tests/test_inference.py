from __future__ import annotations

from pyspark.sql import functions as F

from roadledger.functions import names
from roadledger.sources import inference
from roadledger.streaming.progress import Progress


def test_injected_model(spark):
    load_model = lambda: lambda content: [("Plate", 0.5, (1.9, -1.9, 3.0, 4.2))] * len(content)
    images = spark.createDataFrame([("a", b"xx"), ("b", b""), ("c", b"y")], "path string, content binary")
    rows = sorted(tuple(r) for r in inference.detect(images, "fake", load_model).collect())
    assert rows == [("a", 1, "Plate", 0.5, 1, -1, 3, 4), ("a", 2, "Plate", 0.5, 1, -1, 3, 4), ("c", 1, "Plate", 0.5, 1, -1, 3, 4)]


def test_injected_reader(spark):
    load_reader = lambda: lambda crop: ["KA", crop.decode()]
    crops = spark.createDataFrame([(1, b"7"), (2, None)], "k int, crop binary")
    assert {r["k"]: r["ocr_texts"] for r in inference.read_plates(crops, "fake reader", load_reader).collect()} == {1: ["KA", "7"], 2: []}


def test_models_load_once():
    made = []
    for _ in range(3):
        inference.once("counted", lambda: made.append(1) or "model")
    assert made == [1]


def test_job_ids_differ(spark):
    assert spark.range(50).select(names.job_id().alias("j")).agg(F.count_distinct("j")).first()[0] == 50


def test_progress_is_reported(spark, tmp_path):
    import time

    seen = []
    listener = Progress(lambda *x: seen.append(x))
    spark.streams.addListener(listener)
    try:
        (tmp_path / "in").mkdir()
        (tmp_path / "in" / "a.txt").write_text("1\n2\n3\n")
        stream = spark.readStream.text(str(tmp_path / "in"))
        q = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        for _ in range(50):
            if any(x[1] == "done" for x in seen):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert [x[1] for x in seen][0] == "running" and seen[-1][1:] == ("done", 3, None)
