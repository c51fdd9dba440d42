"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from roadledger.llm import decontaminate, htmltext, langid, neardup, pieces, pii, quality, search, substrings, warc

from .conftest import AWKWARD, LONG

ROWS = len(AWKWARD) + 3


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "the end"), (1, "the end"), (2, None), (3, ""), (4, "?!"), (None, "the end"), (5, " ".join(LONG.split()[:40])), (6, "word5 THE... of and word6")]
    return spark.createDataFrame([(*r, "c", 1) for r in rows], "item_id bigint, text string, term string, n int")


def empty(df):
    return df.where(F.lit(False))


def test_language_id(awkward, lang_model):
    out = langid.identify(awkward, lang_model).collect()
    assert len(out) == ROWS and sum(r["doc_id"] is None for r in out) == 2
    by = {r["doc_id"]: r for r in out}
    for k in range(5):
        assert (by[k]["lang"], by[k]["confidence"], by[k]["kept"]) == (None, 0.0, False)
    assert by[5]["spans"] == by[6]["spans"] and by[12]["n_words"] == len(LONG.split()) and by[12]["lang"] == "en"
    kept = langid.keep_identified(awkward, lang_model)
    assert kept.schema == awkward.schema and kept.count() == sum(r["kept"] for r in out)
    assert langid.identify(empty(awkward), lang_model).count() == 0
    assert not any(r["kept"] for r in langid.identify(awkward.withColumn("lang", F.lit(None).cast("string"))).collect())


def test_near_duplicates(awkward):
    out = sorted(tuple(r) for r in neardup.near_duplicates(awkward).collect())
    assert out == [(6, 5), (8, 7), (13, 12)]
    left = neardup.deduplicate(awkward)
    assert left.columns == awkward.columns and left.count() == ROWS - 3
    assert neardup.near_duplicates(empty(awkward)).count() == 0 and neardup.deduplicate(empty(awkward)).count() == 0


def test_decontamination(awkward, items):
    out = sorted(tuple(r) for r in decontaminate.contaminated(awkward, items).collect())
    assert [(d, i) for d, i, _ in out] == [(7, 1), (8, 1), (12, 5), (12, 6), (13, 5), (13, 6)]
    left = decontaminate.decontaminate(awkward, items)
    assert left.columns == awkward.columns and {r["doc_id"] for r in left.collect()} == {None, *range(len(AWKWARD))} - {7, 8, 12, 13}
    assert decontaminate.contaminated(awkward, empty(items)).count() == 0 == decontaminate.contaminated(empty(awkward), items).count()
    assert decontaminate.decontaminate(awkward, empty(items)).count() == ROWS


def test_pii(awkward, pii_model):
    out = pii.find(awkward, pii_model)
    assert out.count() == 0
    same = pii.redact(awkward, pii_model)
    assert same.schema == awkward.schema and sorted(map(str, same.collect())) == sorted(map(str, awkward.collect()))
    mail = awkward.withColumn("text", F.concat("text", F.lit(" me@mail.example.com")))
    changed = pii.redact(mail, pii_model).where("doc_id = 7").collect()
    assert len(changed) == 2 and changed[0]["text"] == "the end [EMAIL]" and changed[0]["n_chars"] == 15
    assert pii.find(empty(awkward), pii_model).count() == 0


def test_pieces(awkward):
    out = pieces.decode(pieces.encode(awkward)).collect()
    assert len(out) == ROWS
    for r in out:
        assert r["decoded"] == (None if r["text"] is None else r["text"].replace("▁", " "))
        assert (r["n_tokens"] is None) == (r["text"] is None) and (r["ids"] is None) == (r["text"] is None)
    assert pieces.encode(awkward).columns == [c for c in awkward.columns if c != "ids"] + ["ids", "n_tokens"]
    assert pieces.encode(empty(awkward)).count() == 0 == pieces.round_trip(empty(awkward)).count()


def test_substrings(awkward):
    out = sorted(tuple(r) for r in substrings.repeats(awkward).collect())
    size = len(LONG.split())
    assert out == [(12, 0, size, size, 12), (13, 0, size, size, 12)]
    assert substrings.repeats(empty(awkward)).count() == 0


def test_search(awkward, items):
    out = search.top_k(awkward, items, 3).collect()
    by = {}
    for r in sorted(out, key=lambda r: (r["item_id"], r["place"])):
        by.setdefault(r["item_id"], []).append(r["doc_id"])
    assert by[1] == [7, 7, 8] and set(by) == {1, 5, 6}  # the repeated row of 7 is a document of its own
    assert search.top_k(awkward, empty(items)).count() == 0 == search.top_k(empty(awkward), items).count()


def test_quality(spark, awkward, quality_model):
    out = quality.classify(awkward, quality_model).collect()
    assert len(out) == ROWS and all(0 <= r["p_quality"] <= 1 and r["kept"] == (r["quality"] == 1 and r["toxic"] == 0) for r in out)
    labels = spark.createDataFrame([(None, 1, 1), (7, None, 0)], "doc_id bigint, quality int, toxic int")
    untrained = quality.classify(awkward, quality.train(awkward, labels)).collect()
    assert {(r["p_quality"], r["p_toxic"], r["kept"]) for r in untrained} == {(0.5, 0.5, True)}
    assert quality.classify(empty(awkward), quality_model).count() == 0


PAGE = "<html><body><nav><a href='/'>home of everything</a></nav><div class='post'><p>{}</p></div></body></html>"


@pytest.fixture(scope="module")
def pages(spark):
    text = "A sentence that is long enough, with commas, to count as a paragraph."
    rows = [(1, "http://h.example/a", PAGE.format(text)), (1, "http://h.example/a", PAGE.format(text)), (2, None, PAGE.format(text)), (3, "http://h.example/b", None), (4, "http://h.example/c", ""), (None, "no url at all", "<p"), (5, "http://h.example/d", "<div>" * 3000 + text), (6, "http://h.example/e", PAGE.format(text * 3000)), (7, "", "plain <b>text")]
    return spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id bigint, url string, html string, host string, lines int")


def test_html(pages):
    out = htmltext.main_text(pages).collect()
    assert len(out) == 9
    by = {r["page_id"]: r for r in out}
    assert by[1]["method"] == "consensus" and by[1]["path"] == "html>body>div.post" and "home" not in by[1]["text"]
    assert by[2]["method"] == "own" and by[2]["host"] is None
    assert (by[3]["method"], by[3]["text"]) == ("none", None) and (by[4]["method"], by[4]["text"]) == ("none", "")
    assert by[5]["method"] == "own" and by[5]["text"].startswith("A sentence") and len(by[6]["text"]) > 100_000
    assert by[7]["text"] == "plain text" and by[None]["text"] == "<p"
    assert htmltext.main_text(empty(pages)).count() == 0


def test_warc(pages):
    out = warc.captures(pages, lines=2).collect()
    assert len(out) == 8 and all(r["sound"] or r["digest"] is None for r in out)
    a = [r for r in out if r["key"] == "example,h)/a"]
    assert [r["n_captures"] for r in a] == [2, 2] and {r["capture"] for r in a} == {1, 2}
    assert [(r["digest"], r["n_bytes"]) for r in out if r["page_id"] == 3] == [(None, None)]
    assert {r["key"] for r in out} >= {"no url at all", ""}
    assert warc.captures(empty(pages)).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, awkward, sf, name, tmp_path):
    stage = dict(corpus_pipeline.STAGES)[name]
    path = str(tmp_path / "stage")
    stage(spark, awkward, sf).write.parquet(path)
    out = spark.read.parquet(path)
    if name != "SentencePiece":
        assert out.columns == awkward.columns
    assert out.count() > 0 and stage(spark, empty(awkward), sf).count() == 0
