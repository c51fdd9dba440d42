"""Benchmark decontamination (10): Wu-Manber multi-pattern search for benchmark passages.

Texts and items are normalised alike: lower case, every run of other characters than letters
and digits becomes one space. The test strings are all windows of `n_words` words of an item;
an item with fewer words is one test string as a whole. A test string matches whole words only.

Defined cases: a null or empty text, or one without letters and digits, matches nothing; a null
item or one without letters and digits gives no test string; a null doc_id or item_id is left
out of the pairs; equal rows give one pair; equal items give a pair for each item_id; rows with
the same item_id are one item of all their texts' test strings; rows with the same doc_id are one
document, whose n_windows is the sum over its distinct normalised texts of the item's test strings
found in each; neither depends on how many passes the search takes; an empty table on either side gives an empty result. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadledger.llm import base

N_WORDS = 13
#: Bytes of test strings after which a pass is full; the next items take a further pass.
PASS_BYTES = 32 << 20
#: Test strings are searched in two groups, so that few short ones don't shorten all skips.
SHORT_BYTES = 24
TABLE_BITS = 20
LANE_BYTES = 1024
PAIRS = "doc_id bigint, item_id bigint, n_windows int"
#: `text` is a normalised text's hash; `string` a test string's number in its pass, all of an item's being in one.
HITS = "doc_id bigint, text binary, item_id bigint, string int"


class WuManber:
    """Finds byte strings: SHIFT by hashed block, buckets by the block that ends the shared prefix.

    m is the shortest string's length. A window of m bytes slides over the text; SHIFT of its
    last block of B bytes says how far no string can begin. At shift 0 the bucket of that block
    gives the strings to compare.
    """

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.m = min(map(len, strings))
        self.block = min(8, self.m)
        self.mask = np.uint64((1 << (8 * self.block)) - 1)
        heads = np.frombuffer(b"".join(s[: self.m] for s in strings), np.uint8).reshape(len(strings), self.m)
        shift = np.full(1 << TABLE_BITS, self.m - self.block + 1, np.int32)
        for at in range(self.m - self.block + 1):  # later blocks shift less
            shift[self.slot(self.pack(heads[:, at : at + self.block]))] = self.m - self.block - at
        self.shift = shift
        ends = self.pack(heads[:, self.m - self.block :])
        order = np.argsort(ends, kind="stable")
        self.bucket, first = np.unique(ends[order], return_index=True)
        self.first, self.order = np.append(first, len(strings)), order

    def pack(self, blocks: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(blocks), 8), np.uint8)
        padded[:, : self.block] = blocks
        return padded.view("<u8").ravel()

    def slot(self, values: np.ndarray) -> np.ndarray:
        return (values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)

    def search(self, text: np.ndarray) -> Iterator[tuple[int, int]]:
        """(string, start) of each occurrence; all lanes of the text step at once."""
        size, m, tail = len(text), self.m, self.block - 1
        if size < m:
            return
        padded = np.concatenate([text, np.zeros(8, np.uint8)])
        blocks = np.ndarray((size,), "<u8", padded, 0, (1,))
        raw = text.tobytes()
        at = np.arange(m - 1, size, LANE_BYTES)  # a window's last byte
        end = np.minimum(at + LANE_BYTES, size)
        while len(at):
            value = blocks[at - tail] & self.mask
            step = self.shift[self.slot(value)]
            zero = np.flatnonzero(step == 0)
            if len(zero):
                k = np.minimum(np.searchsorted(self.bucket, value[zero]), len(self.bucket) - 1)
                for z, b in zip(zero[hit := self.bucket[k] == value[zero]], k[hit]):
                    start = int(at[z]) - m + 1
                    for s in self.order[self.first[b] : self.first[b + 1]]:
                        if raw.startswith(self.strings[s], start):
                            yield int(s), start
            at = at + np.maximum(step, 1)
            live = at < end
            at, end = at[live], end[live]


def windows(text: str, n_words: int) -> set[bytes]:
    """The test strings of a normalised item, with a space at either end."""
    words = text.split()
    if not words:
        return set()
    n = min(n_words, len(words))
    return {f" {' '.join(words[i : i + n])} ".encode() for i in range(len(words) - n + 1)}


def _search(strings: list[bytes], items: list[list[int]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    groups = []
    for wanted in (lambda s: len(s) < SHORT_BYTES, lambda s: len(s) >= SHORT_BYTES):
        own = [k for k, s in enumerate(strings) if wanted(s)]
        if own:
            groups.append((own, WuManber([strings[k] for k in own])))
    for batch in base.sized(batches, "text"):
        plain = base.normalise(batch.column(1))
        joined = pc.binary_join_element_wise("\n", plain, "\n", " ")
        lengths = pc.binary_length(joined).to_numpy().astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        text = np.frombuffer("".join(joined.to_pylist()).encode(), np.uint8)
        found: set[tuple[int, int]] = set()
        for own, finder in groups:
            hits = list(finder.search(text))
            rows = np.searchsorted(starts, [h[1] for h in hits], side="right") - 1
            found.update((int(r), own[h[0]]) for r, h in zip(rows, hits))
        ids = batch.column(0).to_pylist()
        own = {row: xxhash.xxh3_128_digest(plain[row].as_py().strip().encode("utf-8", "surrogatepass")) for row in {row for row, _ in found}}
        out = [(ids[row], own[row], item, s) for row, s in found if ids[row] is not None for item in items[s]]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.binary(), pa.int64(), pa.int32()))], ["doc_id", "text", "item_id", "string"])


def contaminated(docs: DataFrame, benchmark: DataFrame, n_words: int = N_WORDS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(doc_id, item_id, n_windows): how many test strings of each item a document holds, if any.

    The test strings go to the executors with the function, in passes of about `pass_bytes` that
    end between two items; the documents are scanned once a pass and nothing of them is shuffled
    but the matches.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct().orderBy("item_id")
    strings: dict[bytes, list[int]] = {}
    held, out, last = 0, [], None

    def searched() -> DataFrame:
        own, ids = list(strings), list(strings.values())
        return base.mapped(texts, lambda batches: _search(own, ids, batches), HITS)

    for row in items.toLocalIterator():
        if held > pass_bytes and row["item_id"] != last:
            out.append(searched())
            strings, held = {}, 0
        last = row["item_id"]
        for s in windows(base.normalise(pa.array([row["text"]]))[0].as_py(), n_words):
            if row["item_id"] not in strings.setdefault(s, []):
                strings[s].append(row["item_id"])
            held += len(s)
    if strings:
        out.append(searched())
    if not out:
        return spark.createDataFrame([], PAIRS)
    found = out[0]
    for more in out[1:]:
        found = found.unionAll(more)
    distinct = found.distinct()  # an item's numbers are of one pass, so they can't meet others
    return distinct.groupBy("doc_id", "item_id").agg(F.count("*").cast("int").alias("n_windows"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n_words: int = N_WORDS) -> DataFrame:
    """docs without the documents that hold a test string; rows with a null doc_id stay."""
    bad = base.stash(contaminated(docs, benchmark, n_words).select(F.col("doc_id").alias("__bad_id")).distinct(), "contaminated")
    return docs.join(base.small(bad), docs["doc_id"] == bad["__bad_id"], "left_anti")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "benchmark"))


ORACLE = {
    "op10_decontaminate": r"""
WITH b AS (SELECT DISTINCT item_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
s AS (SELECT DISTINCT item_id, ' ' || array_to_string(w[i : i + least(13, len(w)) - 1], ' ') || ' ' AS win FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b) WHERE w[1] <> ''),
d AS (SELECT DISTINCT doc_id, ' ' || trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS t FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)
SELECT doc_id, item_id, CAST(count(*) AS INTEGER) AS n_windows FROM d JOIN s ON contains(d.t, s.win) GROUP BY doc_id, item_id"""
}
QUERIES = {"op10_decontaminate": op10_decontaminate}
