"""SentencePiece encoding and decoding (9): a table of distinct marked words.

In the vocabularies this is for, no piece goes on from another character to a white-space mark,
so a text's segmentation is that of its marked words in a row (checked when the model is loaded).
Each worker keeps a table of the distinct marked words that it has met, of up to `TABLE_WORDS` words
(a full table is begun anew; results don't depend on it): a word that is in it isn't segmented again,
and the ids are joined back by position. A table for the whole corpus would need every task's distinct
words shuffled twice; README has the figures.

Defined cases: a null text gives null ids, n_tokens and exact; an empty text gives no ids; decoding null
gives null, an id outside the vocabulary gives what the unknown piece gives, bytes that are not
UTF-8 give U+FFFD; equal rows give equal results; an empty table gives an empty one. The result
columns replace columns of docs that have their names; all others are passed on.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadledger.llm import base

#: Where the public tokenizer's file is on every machine; a parameter of all functions.
MODEL = os.environ.get("ROADLEDGER_SENTENCEPIECE", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"
#: Words of a worker's table.
TABLE_WORDS = 200_000
_loaded: dict[str, "Pieces"] = {}


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each length, in a row."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Pieces:
    """A SentencePiece model whose marked words are independent."""

    def __init__(self, model: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        size = self.sp.get_piece_size()
        pieces = [self.sp.id_to_piece(k) for k in range(size)]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("pieces of this model cross white-space marks")
        self.blank = self.sp.piece_to_id(MARK)
        self.unknown = self.sp.unk_id()
        surface = []
        for k, p in enumerate(pieces):
            if self.sp.is_byte(k):
                surface.append(bytes([int(p[3:5], 16)]))
            elif self.sp.is_control(k):
                surface.append(b"")
            elif self.sp.is_unknown(k):
                surface.append(" ⁇ ".encode())
            else:
                surface.append(p.replace(MARK, " ").encode())
        self.control = np.array([self.sp.is_control(k) for k in range(size)])
        self.led = np.array([p.startswith(MARK) for p in pieces])
        self.surface_len = np.array([len(s) for s in surface])
        self.surface_at = np.cumsum(self.surface_len) - self.surface_len
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.segmented = 0
        self._begin()

    def _begin(self) -> None:
        """An empty table: each word's number, and its ids in one array for all."""
        self.number = {"": 0}
        self.ids, self.ends = np.array([self.blank], np.int32), np.array([0, 1])

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Marked words of each text without their first mark: (offsets, codes, distinct)."""
        plain = pc.replace_substring(pc.fill_null(texts, ""), MARK, " ")
        odd = pc.match_substring_regex(plain, r"  |^ | $").to_numpy(zero_copy_only=False)
        if not odd.any():
            lists = pc.split_pattern(plain, " ")
        else:  # runs of spaces belong to the word after them
            lists = pa.array([re.findall(r" *[^ ]+|^ +$| +$", " " + t) for t in plain.to_pylist()], pa.list_(pa.string()))
            lists = pa.ListArray.from_arrays(lists.offsets, pc.utf8_slice_codeunits(lists.values, 1))
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        lengths = np.diff(offsets) * pc.greater(pc.binary_length(plain), 0).to_numpy(zero_copy_only=False)
        codes = coded.indices.to_numpy(zero_copy_only=False)[ranges(offsets[:-1] - offsets[0], lengths)]
        return np.concatenate([[0], np.cumsum(lengths)]), codes, coded.dictionary.to_pylist()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of all texts; a null text has none."""
        offsets, codes, words = self.words(texts)
        if len(self.number) > TABLE_WORDS:
            self._begin()
        new = [w for w in words if w not in self.number]
        made = self.sp.encode(new, num_threads=1)
        self.segmented += len(new)
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        self.ids = np.concatenate([self.ids, np.fromiter((i for ids in made for i in ids), np.int32, int(sizes.sum()))])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        at = np.fromiter((self.number[w] for w in words), np.int64, len(words))[codes]
        lengths = self.ends[at + 1] - self.ends[at]
        return np.concatenate([[0], np.cumsum(lengths)])[offsets], self.ids[ranges(self.ends[at], lengths)]

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> list[str]:
        """The text of each run of ids."""
        ids = np.where((ids < 0) | (ids >= len(self.control)), self.unknown, ids)
        lengths = self.surface_len[ids]
        raw = self.surface[ranges(self.surface_at[ids], lengths)].tobytes()
        ends = np.concatenate([[0], np.cumsum(lengths)])
        real = np.append(np.flatnonzero(~self.control[ids]), len(ids))
        first = real[np.searchsorted(real, offsets[:-1])]  # the first piece that isn't a control
        strip = np.array([f < e and self.led[ids[f]] for f, e in zip(first, offsets[1:])], bool)
        return [raw[a + s : b].decode("utf-8", "replace") for a, b, s in zip(ends[offsets[:-1]].tolist(), ends[offsets[1:]].tolist(), strip.tolist())]


def load(model: str) -> Pieces:
    if model not in _loaded:
        _loaded[model] = Pieces(model)
    return _loaded[model]


def _lists(offsets: np.ndarray, ids: np.ndarray, null: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()), mask=pa.array(null))


def _plain(docs: DataFrame, *taken: str) -> DataFrame:
    return docs.drop(*taken).select(*(F.col(f"`{c}`") for c in docs.columns if c not in taken))


def encode(docs: DataFrame, model: str = MODEL, check: bool = False) -> DataFrame:
    """docs with `ids` and `n_tokens` of `text`; with check also `exact`, whether decoding gives the text back."""
    added = ["ids", "n_tokens", *(["exact"] if check else [])]
    docs = _plain(docs, *added)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in base.sized(batches, "text"):
            offsets, ids = pieces.encode(batch.column(place))
            null = batch.column(place).is_null().to_numpy(zero_copy_only=False)
            counts = pa.array(np.diff(offsets), pa.int32(), mask=null)
            exact = [pc.equal(pa.array(pieces.decode(offsets, ids), pa.string()), batch.column(place))] if check else []
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(offsets, ids, null), counts, *exact], [*batch.schema.names, *added])

    kinds = (T.ArrayType(T.IntegerType()), T.IntegerType(), T.BooleanType())
    return base.mapped(docs, run, T.StructType([*docs.schema.fields, *(T.StructField(name, kind) for name, kind in zip(added, kinds))]))


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """rows with `decoded`, the text of `ids`."""
    rows = _plain(rows, "decoded")
    place = rows.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            lists = batch.column(place)
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ids = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
            texts = pieces.decode(np.concatenate([[0], np.cumsum(lengths)]), ids)
            null = lists.is_null().to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if n else t for n, t in zip(null, texts)], pa.string())], [*batch.schema.names, "decoded"])

    return base.mapped(rows, run, T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))


def round_trip(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, ids, n_tokens, exact): encoded, decoded in the same pass, and compared with the text."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in base.sized(batches, "text"):
            offsets, ids = pieces.encode(batch.column(1))
            null = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            back = pa.array(pieces.decode(offsets, ids), pa.string())
            exact = pc.equal(back, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(offsets, ids, null), pa.array(np.diff(offsets), pa.int32(), mask=null), exact], ["doc_id", "ids", "n_tokens", "exact"])

    return base.mapped(texts, run, "doc_id bigint, ids array<int>, n_tokens int, exact boolean")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(base.table(spark, sf_dir, "documents"))


QUERIES = {"op9_sentencepiece": op9_sentencepiece}
ORACLE: dict[str, str] = {}
