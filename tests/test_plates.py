from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from roadledger.functions import names, plates
from roadledger.sources import dims

CASES = [
    ("MH02DL4596", True, "Maharashtra", "MH", "02", "Mumbai (West)", "DL", "4596", None),
    ("dl7ce1234", True, "Delhi", "DL", "07", "Delhi (East)", "CE", "1234", None),
    (" ka-05 ab 1 ", True, "Karnataka", "KA", "05", "Bengaluru (Jayanagar)", "AB", "1", None),
    ("MH99AB1", True, "Maharashtra", "MH", "99", None, "AB", "1", None),
    ("MH0AB1", True, "Maharashtra", "MH", "00", None, "AB", "1", None),
    ("22BH1234AA", True, plates.NATIONAL_NAME, "BH", None, None, "AA", "1234", "Registered 2022"),
    ("22BH1234AAA", False, None, None, None, None, None, None, None),
    ("MH02DL45967", False, None, None, None, None, None, None, None),
    ("XX02DL4596", False, None, None, None, None, None, None, None),
    ("", False, None, None, None, None, None, None, None),
    (None, False, None, None, None, None, None, None, None),
]


def test_decode(spark):
    rows = spark.createDataFrame([(k, c[0]) for k, c in enumerate(CASES)], "k int, plate string")
    out = {r["k"]: r for r in plates.decode(rows, dims.states(spark), dims.districts(spark)).collect()}
    for k, (_, *want) in enumerate(CASES):
        assert [out[k][c] for c in ("recognized", "state", "state_code", "rto_code", "rto", "series", "number", "extra")] == want
    assert out[9]["clean_plate"] is None and out[7]["clean_plate"] == "MH02DL45967"


def test_dimensions_are_whole():
    assert len(dims.state_rows()) == len({c for c, _ in dims.state_rows()}) == 40
    assert len(dims.district_rows()) == 35
    assert dict(dims.state_rows())["UA"] == "Uttarakhand"


@pytest.mark.parametrize(
    "text, key, ascii_, any_",
    [("\t mh-12 x\n", "MH-12 X", "MH12X", "MH12X"), ("***", "***", "", ""), ("a²é", "A²É", "A", "A²É"), ("", "", "", None), (None, None, None, None)],
)
def test_cleaning(spark, text, key, ascii_, any_):
    row = spark.createDataFrame([(text,)], "t string").select(plates.lookup_key(F.col("t")), plates.cleaned(F.col("t")), plates.cleaned_unicode(F.col("t"))).first()
    assert tuple(row) == (key, ascii_, any_)


def test_names(spark):
    df = spark.createDataFrame([("a/b/c.JPG",), ("x",), (".hidden",), (None,)], "p string")
    out = [tuple(r) for r in df.select(names.basename(F.col("p")), names.evidence_url(F.col("p")), names.extension(F.col("p"))).collect()]
    assert out == [("c.JPG", "/evidence/c.JPG", ".JPG"), ("x", "/evidence/x", ".jpg"), (".hidden", "/evidence/.hidden", ".jpg"), (None, None, ".jpg")]
