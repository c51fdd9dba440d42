from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from roadledger.llm import base, pieces


@pytest.fixture(scope="module")
def model():
    return pieces.load(pieces.MODEL)


def check(model, texts):
    offsets, ids = model.encode(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        own = ids[offsets[k] : offsets[k + 1]]
        assert own.tolist() == model.sp.encode(t), repr(t)
    assert model.decode(offsets, ids) == [model.sp.decode(model.sp.encode(t)) for t in texts] == [t.replace(pieces.MARK, " ") for t in texts]


def test_odd_texts(model):
    check(model, ["", " ", "   ", "a", " a", "a ", "a  b   c ", "▁", "▁a▁▁b", "\n \n", "\t x", "é é", "ﬁ", "日本 語", "😀 😀", "<s> </s> <unk> <0x0A>", "\x00", "x" * 3000, "  y", " z"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" ▁\nab"), st.characters(exclude_categories=["Cs"])), max_size=30), min_size=1, max_size=6))
def test_any_text(model, texts):
    check(model, texts)


def test_corpus_round_trip(spark, model):
    rows = pieces.round_trip(base.table(spark, "/root/testdata/sf0.001", "documents")).collect()
    texts = {r["doc_id"]: r["text"] for r in base.table(spark, "/root/testdata/sf0.001", "documents").collect()}
    assert len(rows) == 200 and all(r["exact"] for r in rows)
    for r in rows:
        assert list(r["ids"]) == model.sp.encode(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])


def test_decoding_anything(spark, model):
    size = model.sp.get_piece_size()
    rows = [(1, [5, 99, 200]), (2, None), (3, []), (4, [size, -3]), (5, [1, 264, 2]), (6, [264, None]), (7, [0])]
    out = {r["k"]: r["decoded"] for r in pieces.decode(spark.createDataFrame(rows, "k int, ids array<int>")).collect()}
    assert out[2] is None and out[3] == "" and out[5] == model.sp.decode([1, 264, 2]) == "a" and "⁇" in out[4] and "⁇" in out[6]
    assert "�" in pieces.load(pieces.MODEL).decode(np.array([0, 1]), np.array([3 + 0xFF]))[0]


def test_a_word_is_segmented_once(monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_WORDS", 40)
    model = pieces.Pieces(pieces.MODEL)
    texts = ["a house and a garden", "a garden and a house", "the house"] * 5
    for _ in range(3):
        check(model, texts)
    assert model.segmented == 5
    check(model, [" ".join(f"w{k}" for k in range(50))])
    check(model, texts)  # a full table is begun anew
    assert model.segmented == 60


def test_encoding_with_a_check(spark):
    rows = pieces.encode(spark.createDataFrame([(1, "a b"), (2, None), (3, "x ▁ y"), (4, "")], "k int, text string"), check=True).collect()
    assert {r["k"]: r["exact"] for r in rows} == {1: True, 2: None, 3: False, 4: True}
