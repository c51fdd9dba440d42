"""Language ID (7): a linear-chain conditional random field that labels every word.

A word's features are its characters' n-grams between boundary marks (so prefixes and suffixes
are among them) and its entry in a lexicon of frequent words; languages follow each other by
learned transitions. Forward-backward gives each word's marginals. Weights are learned from a
bounded sample of documents with a `lang`, whose lines are strung together as code-switched text.

A document's language is the one with the largest sum of marginals over words with letters;
`confidence` is its share. Marginals only compare the languages that were learned, so whether a
text is in any of them is measured apart: a word's fit is the share of its 3- and 4-grams that the
sample has in the language that the word is labelled with, a document's fit the mean over its
words with letters. A document is kept if it has a word with letters, one language has `least` of
the marginals and its fit is `FIT` or more; text in other languages, gibberish and encoded blobs
stay below.

Defined cases: a null or empty text, or one without letters, has lang null, confidence 0, no
words kept and kept = false; words without letters take their label from their neighbours; on
ties the language first in the alphabet wins; equal rows give equal results, each row its own; a null doc_id stays
null; without a row that has both lang and text nothing can be learned and every document is
rejected. Other columns are ignored or passed on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadledger.llm import base

#: Labelled documents of each language that weights are learned from.
TRAIN_DOCS = 60
LEAST = 0.3
#: Least fit of a document, and the n-grams and slots that it is measured with.
FIT, FIT_ORDERS, FIT_BITS = 0.5, (3, 4), 18
BITS, ORDERS, BLOCK = 16, (1, 2, 3, 4), 64
LEXICON_COUNT = 5
ROUNDS, RATE, DECAY = 20, 0.15, 1e-4
RESULT = "doc_id bigint, lang string, confidence double, n_words int, kept boolean, spans array<struct<start:int,end:int,lang:string>>"


def forward_backward(emit: np.ndarray, offsets: np.ndarray, trans: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
    """Marginals of each position. emit: potentials of each label, scaled; offsets: of sequences.

    Sequences are cut into blocks whose transfer matrices carry the messages across, so that all
    blocks step together. counts, if given, gets the expected transitions added.
    """
    n, size = emit.shape
    lengths = np.diff(offsets)
    per = -(-lengths // BLOCK)
    total = int(per.sum())
    if not total:
        return np.empty((0, size))
    seq = np.repeat(np.arange(len(lengths)), per)
    rank = np.arange(total) - np.repeat(np.cumsum(per) - per, per)
    first = offsets[:-1][seq] + rank * BLOCK
    width = np.minimum(BLOCK, offsets[1:][seq] - first)
    order = np.argsort(-width, kind="stable")
    first, width, seq, rank = first[order], width[order], seq[order], rank[order]
    active = np.searchsorted(-width, -np.arange(1, width[0] + 1), side="right")  # blocks longer than t
    start = np.full((total, size), 1.0 / size)
    end = np.ones((total, size))
    if per.max() > 1:
        move = np.broadcast_to(np.eye(size), (total, size, size)).copy()
        for t, k in enumerate(active):
            move[:k] = (move[:k].reshape(-1, size) @ trans).reshape(k, size, size) * emit[first[:k] + t][:, None, :]
            if t % 8 == 7:
                move[:k] /= move[:k].max(axis=(1, 2), keepdims=True)
        move /= move.max(axis=(1, 2), keepdims=True)
        place = np.empty(total, np.int64)
        base_of = np.cumsum(per) - per
        place[base_of[seq] + rank] = np.arange(total)
        long = np.flatnonzero(per > 1)
        for r in range(1, int(per.max())):
            own = long[per[long] > r]
            a, b = place[base_of[own] + r - 1], place[base_of[own] + r]
            x = np.einsum("bi,bij->bj", start[a], move[a])
            start[b] = x / x.sum(1, keepdims=True)
        for r in range(int(per.max()) - 1, 0, -1):
            own = long[per[long] > r]
            a, b = place[base_of[own] + r - 1], place[base_of[own] + r]
            x = np.einsum("bij,bj->bi", move[b], end[b])
            end[a] = x / x.sum(1, keepdims=True)
    out = np.empty((n, size))
    x = start
    for t, k in enumerate(active):
        x = (x[:k] @ trans) * emit[first[:k] + t]
        x /= x.sum(1, keepdims=True)
        out[first[:k] + t] = x
    beta = end
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        at = first[:k] + t
        both = out[at] * beta[:k]
        carried = emit[at] * beta[:k]
        if counts is not None and t:
            pair = out[at - 1][:, :, None] * trans * carried[:, None, :]
            counts += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(0)
        out[at] = both / both.sum(1, keepdims=True)
        new = carried @ trans.T
        beta[:k] = new / new.sum(1, keepdims=True)
    return out


class Model:
    """Weights of hashed n-grams and lexicon words for each language, and transitions."""

    def __init__(self, languages: list[str]):
        size = len(languages)
        self.languages = languages
        self.grams = np.zeros((1 << BITS, size), np.float32)
        self.lexicon = np.empty(0, np.uint64)
        self.entries = np.zeros((1, size), np.float32)  # the last one is for words outside
        self.seen = np.zeros((1 << FIT_BITS, size), bool)  # n-grams of each language's sample
        self.trans = np.eye(size) * 0.9 + 0.1 / max(1, size)

    def entry(self, words: pa.Array) -> np.ndarray:
        hashed = base.hash_strings(words)
        if not len(self.lexicon):
            return np.zeros(len(hashed), np.int64)
        at = np.minimum(np.searchsorted(self.lexicon, hashed), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == hashed, at, len(self.lexicon))

    def scores(self, slots: np.ndarray, word: np.ndarray, entry: np.ndarray, has: np.ndarray) -> np.ndarray:
        """Summed weights of each distinct word; 0 for words without letters."""
        out = self.entries[entry].astype(np.float64)
        if len(word):
            bounds = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            out[word[bounds]] += np.add.reduceat(self.grams[slots], bounds, axis=0)
        out[~has] = 0
        return out

    def fits(self, plain: pa.Array) -> np.ndarray:
        """The share of each distinct word's n-grams that each language's sample has."""
        slots, word = base.grams(plain, FIT_ORDERS, FIT_BITS, ordered=False)
        known = np.stack([np.bincount(word, self.seen[slots, k], len(plain)) for k in range(len(self.languages))], 1)
        return known / np.maximum(1, np.bincount(word, minlength=len(plain)))[:, None]

    @staticmethod
    def potentials(scores: np.ndarray) -> np.ndarray:
        return np.exp(np.maximum(scores - scores.max(1, keepdims=True), -20)) if len(scores) else scores


def letters(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words in lower case with letters alone; whether there are any."""
    plain = pc.replace_substring_regex(pc.utf8_lower(words), r"[^\p{L}]+", "")
    return plain, pc.greater(pc.utf8_length(plain), 0).to_numpy(zero_copy_only=False)


def train(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """Weights from (lang, text) rows by gradient ascent on the conditional likelihood."""
    languages = sorted({lang for lang, _ in rows})
    model = Model(languages)
    if not languages:
        return model
    rng = np.random.default_rng(seed)
    lines = [(languages.index(lang), line) for lang, text in rows for line in text.split("\n") if line.split()]
    lines = [lines[k] for k in rng.permutation(len(lines))]
    if not lines:
        return Model([])
    line_off, codes, words = base.split_words(pa.array([x for _, x in lines]))
    gold = np.repeat([k for k, _ in lines], np.diff(line_off))
    cuts = np.flatnonzero(rng.random(len(lines)) < 0.4)  # a sequence is one line or a few
    offsets = np.unique(np.concatenate([[0], line_off[cuts], [len(codes)]]))
    plain, has = letters(words)
    own, place = base.grams(plain, FIT_ORDERS, FIT_BITS)
    for k in range(len(languages)):
        within = np.zeros(len(words), bool)
        within[codes[gold == k]] = True
        model.seen[own[within[place]], k] = True
    slots, word = base.grams(plain, ORDERS, BITS)
    hashed, times = base.hash_strings(plain), np.bincount(codes, minlength=len(words))
    order = np.argsort(hashed)
    own, at = np.unique(hashed[order], return_index=True)
    model.lexicon = own[np.add.reduceat(times[order], at) >= LEXICON_COUNT]
    model.entries = np.zeros((len(model.lexicon) + 1, len(languages)), np.float32)
    entry, size = model.entry(plain), len(languages)
    follow = np.ones((size, size))
    inside = np.ones(len(codes), bool)
    inside[offsets[:-1]] = False
    at = np.flatnonzero(inside)
    np.add.at(follow, (gold[at - 1], gold[at]), 1)
    logits = np.log(follow / follow.sum(1, keepdims=True))
    seen = [np.full(x.shape, 1e-6) for x in (model.grams, model.entries, logits)]
    spelled = has[codes]
    for _ in range(ROUNDS):
        model.trans = np.exp(logits)
        expected = np.zeros((size, size))
        wrong = -forward_backward(Model.potentials(model.scores(slots, word, entry, has))[codes], offsets, model.trans, expected)
        wrong[np.arange(len(codes)), gold] += 1
        wrong[~spelled] = 0
        by_word = np.stack([np.bincount(codes, wrong[:, k], len(words)) for k in range(size)], 1)
        steps = (
            np.stack([np.bincount(slots, by_word[word, k], 1 << BITS) for k in range(size)], 1) - DECAY * model.grams,
            np.stack([np.bincount(entry, by_word[:, k], len(model.entries)) for k in range(size)], 1) * (np.arange(len(model.entries)) < len(model.lexicon))[:, None],
            follow - 1 - expected,
        )
        for weights, step, square in zip((model.grams, model.entries, logits), steps, seen):
            square += step * step
            weights += (RATE * step / np.sqrt(square)).astype(weights.dtype)
        logits -= np.log(np.exp(logits).sum(1, keepdims=True))
    model.trans = np.exp(logits)
    return model


def label(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word offsets of each text, marginals of each word, and whether the word has letters."""
    return _labelled(model, texts)[:3]


def _labelled(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What `label` gives, and each word's fit."""
    offsets, codes, words = base.split_words(texts)
    plain, has = letters(words)
    slots, word = base.grams(plain, ORDERS, BITS)
    potentials = Model.potentials(model.scores(slots, word, model.entry(plain), has))
    marginals = forward_backward(potentials[codes], offsets, model.trans)
    return offsets, marginals, has[codes], model.fits(plain)[codes, marginals.argmax(1)]


def decide(model: Model, texts: pa.Array, least: float) -> dict[str, np.ndarray]:
    """Of each text: lang (an index, -1 for none), confidence, fit, n_words, kept; and the words' labels."""
    rows = len(texts)
    if not model.languages:
        offsets, _, _ = base.split_words(texts)
        nothing = np.zeros(rows)
        return {"lang": np.full(rows, -1), "confidence": nothing, "fit": nothing, "n_words": np.diff(offsets), "kept": nothing > 1, "offsets": np.zeros(rows + 1, np.int64), "labels": np.empty(0, np.int64)}
    offsets, marginals, has, fits = _labelled(model, texts)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    sums = np.stack([np.bincount(row, marginals[:, k] * has, rows) for k in range(len(model.languages))], 1)
    spelled = np.bincount(row, has, rows)
    lang = np.where(spelled > 0, np.round(sums, 9).argmax(1), -1)
    confidence = np.where(spelled > 0, sums.max(1) / np.maximum(spelled, 1), 0.0)
    fit = np.bincount(row, fits * has, rows) / np.maximum(spelled, 1)
    return {"lang": lang, "confidence": confidence, "fit": fit, "n_words": np.diff(offsets), "kept": (lang >= 0) & (confidence >= least) & (fit >= FIT), "offsets": offsets, "labels": marginals.argmax(1)}


def _named(model: Model, codes: np.ndarray) -> pa.Array:
    return pa.array(model.languages, pa.string()).take(pa.array(codes, pa.int32(), mask=codes < 0))


def _identify(model: Model, least: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in base.sized(batches, "text"):
        d = decide(model, batch.column(1), least)
        offsets, labels = d["offsets"], d["labels"]
        new = np.ones(len(labels), bool)
        new[1:] = labels[1:] != labels[:-1]
        new[offsets[:-1][offsets[:-1] < len(labels)]] = True
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(labels))[: len(begin)]
        origin = offsets[np.searchsorted(offsets, begin, side="right") - 1]
        spans = pa.StructArray.from_arrays([pa.array(begin - origin, pa.int32()), pa.array(end - origin, pa.int32()), _named(model, labels[begin])], ["start", "end", "lang"])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), _named(model, d["lang"]), pa.array(d["confidence"]), pa.array(d["n_words"], pa.int32()), pa.array(d["kept"]), pa.ListArray.from_arrays(pa.array(np.searchsorted(begin, offsets), pa.int32()), spans)],
            ["doc_id", "lang", "confidence", "n_words", "kept", "spans"],
        )


def _keep(model: Model, least: float, batches: Iterator[pa.RecordBatch], place: int) -> Iterator[pa.RecordBatch]:
    for batch in base.sized(batches, "text"):
        yield batch.filter(pa.array(decide(model, batch.column(place), least)["kept"]))


def sample(docs: DataFrame, per_language: int = TRAIN_DOCS) -> list[tuple[str, str]]:
    """(lang, text) of at most per_language documents of each language, chosen by hashed doc_id."""
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = docs.where("lang is not null and doc_id is not null and text is not null").select("lang", "doc_id").withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= per_language).select("doc_id").distinct()
    chosen = [r[0] for r in ids.collect()]
    rows = docs.where(F.col("doc_id").isin(chosen) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), "text").distinct().collect()
    return [(r["lang"], r["text"]) for r in sorted(rows)]


def identify(docs: DataFrame, model: Model | None = None, least: float = LEAST) -> DataFrame:
    """One row for each document: language, confidence, whether it is kept, and runs of words by language."""
    model = model or train(sample(docs))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapped(texts, lambda batches: _identify(model, least, batches), RESULT)


def keep_identified(docs: DataFrame, model: Model | None = None, least: float = LEAST) -> DataFrame:
    """docs, all columns, without the documents that are rejected."""
    model = model or train(sample(docs))
    place = docs.columns.index("text")
    return base.mapped(docs, lambda batches: _keep(model, least, batches, place), T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(base.table(spark, sf_dir, "documents"))


QUERIES = {"op7_language_id": op7_language_id}
ORACLE: dict[str, str] = {}
