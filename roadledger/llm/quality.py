"""Quality classifier (8): supervised subword embeddings for quality and toxicity.

A text's features are its words and their characters' n-grams between boundary marks, hashed
into `BITS` bits of learned vectors; a document is the average of its features' vectors, from
which one softmax tells good from bad quality and another toxic from harmless. The vectors and
the output weights are trained by numpy stochastic gradient descent, one document a step, on at
most `TRAIN_DOCS` rows of `labels`, chosen by hashed doc_id.

For prediction, vectors and output weights are multiplied out once: the average is linear, so a
document's logit is the average of its features' logits.

Defined cases: a null or empty text has no features, and its probabilities are the output
biases'; null labels are left out; repeated rows give equal results, each its own; a null doc_id
stays null; without labels the probabilities are 0.5, quality is 1 and toxic 0 (ties go to keeping the document);
an empty table gives an empty result; other columns are ignored or passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadledger.llm import base

#: Labelled documents that are trained on at most.
TRAIN_DOCS = 6000
BITS, ORDERS, SIZE = 20, (3, 4, 5), 32
PASSES, RATE, SCALE = 5, 0.3, 30.0
#: Texts whose features are made together while training; bounds the driver's memory.
STEP_TEXTS = 250
RESULT = "doc_id bigint, p_quality double, quality int, p_toxic double, toxic int, kept boolean"


def word_features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(slots, word) of the distinct words: their n-grams and themselves."""
    slots, word = base.grams(words, ORDERS, BITS, ordered=False)
    whole = (base.hash_strings(words) >> np.uint64(64 - BITS)).astype(np.int64)
    return np.concatenate([slots, whole]), np.concatenate([word, np.arange(len(words))])


class Model:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.vectors = rng.random((1 << BITS, SIZE), np.float32)  # no copy of twice the size on the way
        self.vectors -= np.float32(0.5)
        self.vectors *= np.float32(0.2)
        self.output = np.zeros((SIZE, 2), np.float64)  # log odds of each head; a softmax of two classes
        self.bias = np.zeros(2)
        self.table: np.ndarray | None = np.zeros((1 << BITS, 2), np.float32)

    @staticmethod
    def bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(slots, weights) of the features of each text; weights are shares times SCALE."""
        offsets, codes, words = base.split_words(pa.array(texts, pa.string()))
        slots, word = word_features(words)
        order = np.argsort(word, kind="stable")
        slots, first = slots[order], np.searchsorted(word[order], np.arange(len(words) + 1))
        out = []
        for a, b in zip(offsets, offsets[1:]):
            distinct, times = np.unique(codes[a:b], return_counts=True)
            lengths = first[distinct + 1] - first[distinct]
            own = np.repeat(first[distinct] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            slot, back = np.unique(slots[own], return_inverse=True)
            weight = np.bincount(back, np.repeat(times, lengths), len(slot))
            out.append((slot.astype(np.int32), (SCALE * weight / max(1.0, weight.sum())).astype(np.float32)))
        return out

    def slopes(self, own: np.ndarray, weight: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The log likelihood's derivatives by a document's own vectors, the output weights and the biases."""
        mean = weight @ own
        wrong = label - 1 / (1 + np.exp(-(mean @ self.output + self.bias)))
        return weight[:, None] * (self.output @ wrong).astype(weight.dtype)[None, :], np.outer(mean, wrong), wrong

    def learn(self, texts: list[str], labels: np.ndarray, passes: int = PASSES, seed: int = 5) -> None:
        """labels: (quality, toxic) of each text."""
        bags = [bag for k in range(0, len(texts), STEP_TEXTS) for bag in self.bags(texts[k : k + STEP_TEXTS])]
        rng = np.random.default_rng(seed)
        seen = np.full(len(self.vectors), 1e-4, np.float32)  # one adaptive rate for each vector
        seen_out, seen_bias = np.full(self.output.shape, 1e-2), np.full(2, 1e-2)
        self.output = rng.normal(0, 0.5, self.output.shape)
        for _ in range(passes):
            for k in rng.permutation(len(bags)):
                slot, weight = bags[k]
                own = self.vectors[slot]
                change, step, wrong = self.slopes(own, weight, labels[k])
                step -= 1e-4 * self.output
                seen_out += step * step
                seen_bias += wrong * wrong
                self.output += 0.1 * step / np.sqrt(seen_out)
                self.bias += 0.1 * wrong / np.sqrt(seen_bias)
                if len(slot):
                    seen[slot] += (change * change).mean(1)
                    self.vectors[slot] = own + np.float32(RATE) * change / np.sqrt(seen[slot])[:, None]
        untouched = np.ones(len(seen), bool)
        for slot, _ in bags:
            untouched[slot] = False
        self.table = self.vectors @ (SCALE * self.output).astype(np.float32)
        self.table[untouched] = 0
        self.vectors = np.empty((0, SIZE), np.float32)  # only the product goes to the executors

    def odds(self, texts: pa.Array) -> np.ndarray:
        """Log odds of (quality, toxic) of each text."""
        offsets, codes, words = base.split_words(texts)
        slots, word = word_features(words)
        count = np.bincount(word, minlength=len(words))
        row = np.repeat(np.arange(len(texts)), np.diff(offsets))
        total = np.maximum(np.bincount(row, count[codes], len(texts)), 1)
        out = np.empty((len(texts), 2))
        for k in range(2):
            by_word = np.bincount(word, self.table[slots, k], len(words))
            out[:, k] = np.bincount(row, by_word[codes], len(texts)) / total + self.bias[k]
        return out


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Model:
    """The model of at most `most` labelled documents."""
    chosen = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.where("text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("quality").alias("quality"), F.max("toxic").alias("toxic")).collect()
    model = Model()
    rows = sorted(rows, key=lambda r: r["doc_id"])
    if rows:
        model.learn([r["text"] for r in rows], np.array([(float(r["quality"] > 0), float(r["toxic"] > 0)) for r in rows]))
    return model


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """Probabilities and decisions for every document; kept: good quality and not toxic."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast((model.table, model.bias))  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.__new__(Model)
        own.table, own.bias = shared.value
        for batch in base.sized(batches, "text"):
            chance = 1 / (1 + np.exp(-own.odds(batch.column(1))))
            good, toxic = chance[:, 0] >= 0.5, chance[:, 1] > 0.5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(chance[:, 0]), pa.array(good.astype(np.int32)), pa.array(chance[:, 1]), pa.array(toxic.astype(np.int32)), pa.array(good & ~toxic)],
                ["doc_id", "p_quality", "quality", "p_toxic", "toxic", "kept"],
            )

    return base.mapped(texts, run, RESULT)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    return classify(docs, train(docs, base.table(spark, sf_dir, "labels")))


QUERIES = {"op8_quality": op8_quality}
ORACLE: dict[str, str] = {}
