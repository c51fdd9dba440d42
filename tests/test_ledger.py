from __future__ import annotations

import datetime
import json

from roadledger import schemas
from roadledger.operators import ledger
from roadledger.sources import dims, files
from roadledger.sources import ledger as table

NOW = datetime.datetime(2024, 5, 6, 7, 8, 9)


def fines(spark):
    rows = [(1, "MH02DL4596", "no_helmet", 500, "a/b.jpg", NOW, "unpaid"), (2, "MH02DL4596", "overspeed", 700, None, NOW, "paid"), (3, "MH02DL4596", "odd", 300, "c.jpg", NOW, None), (4, "KA01A1", "no_helmet", 500, "d.jpg", NOW, "paid")]
    return spark.createDataFrame(rows, schemas.FINES)


def test_only_unpaid_counts(spark):
    assert {r["plate"]: (r["total"], r["n_fines"]) for r in ledger.totals(fines(spark)).collect()} == {"MH02DL4596": (500, 3), "KA01A1": (0, 1)}


def test_lookup_normalises_and_tolerates(spark):
    row = ledger.lookup(fines(spark), " mh02dl4596\t", dims.states(spark), dims.districts(spark)).first()
    assert [f["violation"] for f in row["fines"]] == ["no_helmet", "overspeed", "odd"] and row["fines"][1]["image"] is None
    assert row["total"] == 500 and row["vehicle"]["rto"] == "Mumbai (West)"
    none = ledger.lookup(fines(spark), "nothing", dims.states(spark), dims.districts(spark)).first()
    assert (none["fines"], none["total"], none["vehicle"]["recognized"]) == ([], 0, False)


def test_report(spark):
    assert {r["plate"]: r["due"] for r in ledger.report(fines(spark)).collect()} == {"MH02DL4596": "₹500 due", "KA01A1": "all paid"}


def test_ingest(spark):
    full = {"plate": " ka 1 ", "violation": "v", "image_path": "p"}
    bodies = [json.dumps(full), json.dumps({**full, "plate": None}), json.dumps({"plate": "x"}), "no json", None, json.dumps({**full, "more": 1})]
    out = ledger.accepted(spark.createDataFrame([(k, b) for k, b in enumerate(bodies)], "k int, body string")).collect()
    assert sorted((r["k"], r["plate"]) for r in out) == [(0, "KA 1"), (5, "KA 1")]


def test_table(spark, tmp_path):
    path = str(tmp_path / "ledger")
    table.create(spark, path)
    table.create(spark, path)
    assert table.read(spark, path).count() == 0
    table.append(fines(spark).select("plate", "violation", "amount", "image_path"), path, NOW)
    table.append(fines(spark), path, NOW)
    rows = table.read(spark, path).collect()
    assert len(rows) == 8 and {r["status"] for r in rows} == {"unpaid", "paid"} and {r["timestamp"] for r in rows} == {NOW}
    table.replace(fines(spark).where("id = 1"), path)
    assert table.read(spark, path).count() == 1


def test_recorded_fines_have_ids_of_their_own(spark, tmp_path):
    """Equal events are two fines, as often as they are recorded; the plate becomes a key and the amount the violation's."""
    path = str(tmp_path / "ledger")
    table.create(spark, path)
    rows = spark.createDataFrame([(" mh01ab0001 ", "no_helmet", "evidence/x.jpg")] * 3 + [("KA02", "parking", "evidence/y.jpg")], "plate string, violation string, image_path string").repartition(3)
    for _ in range(2):
        before = {r["id"] for r in table.read(spark, path).collect()}
        table.record(rows, path, dims.amounts(spark), NOW)
        new = [r for r in table.read(spark, path).collect() if r["id"] not in before]
        assert len(new) == 4 and min(r["id"] for r in new) > max(before, default=0)
    out = table.read(spark, path).collect()
    assert len({r["id"] for r in out}) == 8 == len(out)
    assert {(r["plate"], r["violation"], r["amount"], r["status"], r["timestamp"]) for r in out} == {("MH01AB0001", "no_helmet", 500, "unpaid", NOW), ("KA02", "parking", 300, "unpaid", NOW)}


def test_batches_are_idempotent(spark, tmp_path):
    write = table.batch_sink(str(tmp_path / "sink"))
    for batch in (0, 1, 1):
        write(fines(spark), batch)
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 8


def test_jobs(spark):
    rows = [(1, 1, "running", None), (1, 2, None, 5), (1, 3, "done", None), (2, 1, None, 0)]
    out = ledger.latest_jobs(spark.createDataFrame(rows, "job_id int, seq int, status string, done int")).collect()
    assert {r["job_id"]: (r["status"], r["done"]) for r in out} == {1: ("done", 5), 2: (None, 0)}


PNG = b"\x89PNG\r\n\x1a\n" + b"\0" * 30 + b"\0\0\0\0IEND\xaeB`\x82"
WHOLE = {
    "a.png": PNG,
    "b.jpg": b"\xff\xd8\xff\xe0" + b"\0" * 40 + b"\xff\xd9",
    "c.bmp": b"BM" + (60).to_bytes(4, "little") + b"\1" * 54,
    "d.webp": b"RIFF" + (52).to_bytes(4, "little") + b"WEBP" + b"\2" * 48,
    "e.gif": b"GIF89a" + b"\3" * 40 + b"\x3b",
}


def test_images(spark, tmp_path):
    """Whole images of the known kinds are fine; what is cut short or something else has an error."""
    for name, content in WHOLE.items():
        (tmp_path / f"whole_{name}").write_bytes(content)
        (tmp_path / f"short_{name}").write_bytes(content[:-7])
    (tmp_path / "short_stub.png").write_bytes(b"\x89PNG....")
    (tmp_path / "short_text.jpg").write_bytes(b"nothing")
    out = {r["path"].rsplit("/", 1)[1]: r["error"] for r in files.images(spark, str(tmp_path)).collect()}
    assert len(out) == 12 and all((error is None) == name.startswith("whole") for name, error in out.items())
    assert out["short_text.jpg"].endswith("short_text.jpg")


def test_dropped_photos(spark, tmp_path):
    (tmp_path / "drop").mkdir()
    (tmp_path / "drop" / "a.png").write_bytes(PNG)
    (tmp_path / "drop" / "a.mp4").write_bytes(b"video")
    seen = []
    files.dropped_files(spark, str(tmp_path / "drop"), "*.png").writeStream.option("checkpointLocation", str(tmp_path / "marks")).foreachBatch(lambda df, n: seen.extend(df.select("path", "length").collect())).trigger(availableNow=True).start().awaitTermination()
    assert [r["length"] for r in seen] == [len(PNG)]


def test_files(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"plate":"a"}\n')
    assert [r["body"] for r in files.records(spark, str(tmp_path / "r.json")).collect()] == ['{"plate":"a"}']
