"""Substring dedup (1): prefix-partitioned suffix trees over words.

A repeat is a passage of at least `LEAST` white-space words that occurs at two places or more.
Suffixes are partitioned by variable-length prefixes: a suffix's prefix reaches from its start to
the end of the k-gram with the least hash among the k-grams of its first LEAST words, so suffixes
that share LEAST words share that prefix, and one record per k-gram holds all suffixes that end
their prefix there. Prefixes that can't hold a repeat are dropped before any text moves. In a group
of up to `GROUP_ROWS` records, the suffixes are ranked by prefix doubling to depth LEAST; those of
one rank are the leaves under one node of the group's suffix tree at that depth. A larger group has
its prefixes extended to LEAST words, where the prefix is the node itself and is only counted.

What lies deeper is needed for suffixes alone that can begin a maximal repeat: those under a node
whose leaves differ in the word before them. Each takes its text to the end of its run of repeated
windows, beyond which no repeat goes; equal ones are counted together; and the suffix tree of each
LEAST-word prefix is built from the sorted texts and their longest common prefixes. Its internal
nodes, and leaves of several suffixes, are right-maximal; those whose leaves differ in the word
before are the maximal repeats.

Results: `repeats` merges overlapping windows of a document to stretches, whichever documents each
window is shared with, so a stretch can be longer than any repeat in it. `op1_substring_dedup`
counts documents: passages that repeat inside one document only are none. `op1_substring_dedup_inside`
counts occurrences, each a document and a start: a passage is a repeat if it occurs at two starts, be
it of one document, and overlapping occurrences count as well, so a line that is said over and over is
one stretch. `op1_substring_dedup_maximal` has a row for each maximal repeat: its first occurrence,
its length, how often it occurs and the last document with it; of occurrences of the same LEAST words
in one document, those that begin inside the one counted before are left out.

Defined cases: null and short texts have no repeats; rows with the same doc_id are one document; a null
doc_id is ignored; an empty table gives an empty result; other columns are ignored. Exact copies repeat
as a whole, as one maximal repeat. For maximal repeats, repeated rows of a document are one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadledger.llm import base
from roadledger.llm.pieces import ranges

LEAST, GRAM = 50, 8
#: Records of a prefix that one subtree is built for in memory.
GROUP_ROWS = 2000
#: Words that one step of subtree building works on, more only for a single group.
STEP_WORDS = 400_000
_PLACE = np.uint64((1 << 30) - 1)
RECORD_COLUMNS = ["prefix", "more", "doc_id", "lo", "hi", "words", "ahead"]
#: Runs of starts of repeated windows; without an end, a start under a node whose leaves differ in the word before.
RUN = "doc_id bigint, start_word int, end_word int, first_doc_id bigint"
SUFFIX_COLUMNS = ["key1", "key2", "rest1", "rest2", "doc_id", "start_word", "ahead", "words"]
MAXIMAL_COLUMNS = ["doc_id", "start_word", "n_words", "n_occurrences", "last_doc_id"]
MAXIMAL = "doc_id bigint, start_word int, n_words int, n_occurrences bigint, last_doc_id bigint"


def anchors(word: np.ndarray, offsets: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, k-gram hash, k-gram start, first and last suffix start) of every prefix's end."""
    n = np.diff(offsets)
    rows = np.flatnonzero(n >= least)
    none = tuple(np.empty(0, np.int64) for _ in range(5))
    if not len(rows):
        return none
    value = np.zeros(len(word), np.uint64)
    for k in range(gram):
        value = value * np.uint64(0x9E3779B97F4A7C15)
        value[: len(word) - k] += word[k:]
    grams = base.mix64(value)
    packed = (grams & ~_PLACE) | np.arange(len(word), dtype=np.uint64)
    window, span, least_of = least - gram + 1, 1, packed
    while 2 * span <= window:  # minima of windows of doubling width
        wider = least_of.copy()
        wider[:-span] = np.minimum(least_of[:-span], least_of[span:])
        least_of, span = wider, 2 * span
    if span < window:
        rest = window - span
        wider = least_of.copy()
        wider[:-rest] = np.minimum(least_of[:-rest], least_of[rest:])
        least_of = wider
    counts = n[rows] - least + 1
    starts = ranges(offsets[:-1][rows], counts)
    own = np.repeat(rows, counts)
    at = (least_of[starts] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (own[1:] != own[:-1])]))
    last = np.append(first[1:], len(at)) - 1
    origin = offsets[:-1][own[first]]
    return own[first], grams[at[first]].view(np.int64), at[first] - origin, starts[first] - origin, starts[last] - origin


def _anchors(batches: Iterator[pa.RecordBatch], least: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in base.sized(batches, "text"):
        offsets, codes, words = base.split_words(batch.column(1))
        row, prefix, at, lo, hi = anchors(base.hash_strings(words)[codes] if len(codes) else np.empty(0, np.uint64), offsets, least, gram)
        yield pa.RecordBatch.from_arrays([pa.array(prefix), batch.column(0).take(pa.array(row)), pa.array(at, pa.int32()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["prefix", "doc_id", "at", "lo", "hi"])


def _records(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, found) to one record a prefix with its words, or one a suffix of crowded prefixes."""
    for batch in base.sized(batches, "text", 1 << 20):
        lists = pc.utf8_split_whitespace(batch.column(1))
        docs, found = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        out: list[tuple] = []
        for doc, words, own in zip(docs, lists.to_pylist(), found):
            words = [w for w in words if w]
            for one in own:
                lo, hi = one["lo"], one["hi"]
                text = words[lo : hi + least]
                if len(text) < hi - lo + least:
                    continue  # of another row with this doc_id
                if not one["crowded"]:
                    out.append((one["prefix"], 0, doc, lo, hi, " ".join(text), words[lo - 1] if lo else None))
                else:
                    out += [(*_whole(text[p - lo : p - lo + least]), doc, p, p, None, words[p - 1] if p else None) for p in range(lo, hi + 1)]
        columns = list(zip(*out)) or [[]] * 7
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], RECORD_COLUMNS)


def _whole(words: list[str]) -> tuple[int, int]:
    import xxhash

    both = xxhash.xxh3_128_intdigest("\0".join(words).encode("utf-8", "surrogatepass"))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return signed(both >> 64), signed(both & ((1 << 64) - 1))


def names(codes: np.ndarray, depth: int) -> tuple[np.ndarray, int]:
    """A name for the `2**k <= depth` words from each place on, equal for equal words; and 2**k."""
    name, span = codes.astype(np.int64), 1
    while 2 * span <= depth:
        pair = np.full(len(name), -1, np.int64)
        most = int(name.max(initial=0)) + 2
        pair[: len(name) - span] = (name[: len(name) - span] + 1) * most + name[span:] + 1
        _, name = np.unique(pair, return_inverse=True)
        span *= 2
    return name, span


def _subtree(group: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, texts: pa.Array, ahead: pa.Array, least: int, inside: bool, marked: bool) -> list[np.ndarray]:
    """Runs (doc, first start, end, first document) of suffixes under nodes of two documents, or with inside of two places.

    With marked, there follow the starts under nodes whose leaves differ in the word before, with end -1.
    """
    lists = pc.split_pattern(texts, " ")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten()
    codes = pa.concat_arrays([flat, ahead]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    codes, before = codes[: len(flat)], codes[len(flat) :]
    offsets -= offsets[0]
    rank, span = names(codes, least)
    counts = hi - lo + 1
    record = np.repeat(np.arange(len(doc)), counts)
    start = ranges(offsets[:-1], counts)
    place = lo[record] + start - offsets[:-1][record]
    order = np.lexsort((rank[start + least - span], rank[start], group[record]))  # suffixes as the tree has them
    keys = [x[order] for x in (group[record], rank[start], rank[start + least - span])]
    new = np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]) if len(order) else np.empty(0, bool)
    first = np.flatnonzero(new)  # of each node's leaves
    if not len(first):
        return [np.empty(0, np.int64)] * 4
    own, at = doc[record][order], place[order]
    several = (least_doc := np.minimum.reduceat(own, first)) != np.maximum.reduceat(own, first)
    if inside:
        several |= np.minimum.reduceat(at, first) != np.maximum.reduceat(at, first)
    node = np.empty(len(order), np.int64)
    node[order] = np.cumsum(new) - 1
    deep = several[node]
    kept, starts, firsts = record[deep], place[deep], least_doc[node][deep]
    if not len(kept):
        return [np.empty(0, np.int64)] * 4
    begin = np.flatnonzero(np.concatenate([[True], (kept[1:] != kept[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    end = np.append(begin[1:], len(starts)) - 1
    out = [doc[kept[begin]], starts[begin], starts[end] + least, np.minimum.reduceat(firsts, begin)]
    if marked:
        word = np.where(place > lo[record], codes[start - 1], before[record])[order]
        diverse = (low := np.minimum.reduceat(word, first)) != np.maximum.reduceat(word, first)
        diverse |= low < 0  # the start of a document is like nothing else
        mark = np.flatnonzero(diverse[node] & deep)
        none = np.full(len(mark), -1)
        out = [np.concatenate(x) for x in zip(out, (doc[record[mark]], place[mark], none, none))]
    return out


def _trees(batches: Iterator[pa.RecordBatch], least: int, inside: bool, marked: bool) -> Iterator[pa.RecordBatch]:
    """Records sorted by prefix to runs, whole groups at a time."""
    schema = ["doc_id", "start_word", "end_word", "first_doc_id"]

    def built(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        joint = pa.Table.from_batches(rows).combine_chunks()
        group = joint.column("prefix").combine_chunks().dictionary_encode()
        group = (group.chunk(0) if isinstance(group, pa.ChunkedArray) else group).indices.to_numpy(zero_copy_only=False).astype(np.int64)
        doc, lo, hi = (joint.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "lo", "hi"))
        texts = joint.column("words").combine_chunks()
        texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
        ahead = joint.column("ahead").combine_chunks()
        ahead = ahead.chunk(0) if isinstance(ahead, pa.ChunkedArray) else ahead
        a, b, c, d = _subtree(group, doc, lo, hi, texts, ahead, least, inside, marked)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, pa.int32()), pa.array(c, pa.int32()), pa.array(d)], schema)

    held, words = [], 0
    for batch in base.sized(batches, "words", 1 << 20):
        prefix = batch.column(0).to_numpy()
        edges = np.flatnonzero(prefix[1:] != prefix[:-1]) + 1
        if held and held[-1].column(0)[-1].as_py() != prefix[0]:
            edges = np.concatenate([[0], edges])
        if words > STEP_WORDS and len(edges):
            if edges[0]:
                held.append(batch.slice(0, edges[0]))
            yield built(held)
            held, words = [batch.slice(edges[0])], 0
        else:
            held.append(batch)
        words += int(held[-1].column(5).nbytes) // 6
    if held:
        yield built(held)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")


def _runs(texts: DataFrame, least: int, gram: int, group_rows: int, inside: bool, marked: bool = False) -> DataFrame:
    gram = min(gram, least)
    all_ = base.stash(base.mapped(texts, lambda batches: _anchors(batches, least, gram), "prefix bigint, doc_id bigint, at int, lo int, hi int"), "prefixes")
    ends = [F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.min("at").alias("c"), F.max("at").alias("d")]
    shared = all_.groupBy("prefix").agg(*ends, F.count("*").alias("rows")).where("a <> b or c <> d" if inside else "a <> b").select("prefix", (F.col("rows") > group_rows).alias("crowded"))
    own = all_.join(shared, "prefix").groupBy("doc_id").agg(F.collect_set(F.struct("prefix", "lo", "hi", "crowded")).alias("found"))
    records = base.mapped(texts.join(own, "doc_id").select("doc_id", "text", "found"), lambda batches: _records(batches, least), "prefix bigint, more bigint, doc_id bigint, lo int, hi int, words string, ahead string")
    records = base.stash(records, "records")

    few = records.where("words is not null").repartition("prefix").sortWithinPartitions("prefix")
    runs = base.mapped(few, lambda batches: _trees(batches, least, inside, marked), RUN)
    crowd = records.where("words is null").select("prefix", "more", "doc_id", "lo", "ahead")
    deep = crowd.groupBy("prefix", "more").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("b"), F.min("lo").alias("c"), F.max("lo").alias("d"), (F.max(F.col("ahead").isNull()) | (F.min("ahead") != F.max("ahead"))).alias("diverse"))
    deep = deep.where("first_doc_id <> b or c <> d" if inside else "first_doc_id <> b").drop("b", "c", "d")
    leaves = crowd.join(deep, ["prefix", "more"])
    runs = runs.unionAll(leaves.select("doc_id", F.col("lo").alias("start_word"), (F.col("lo") + least).alias("end_word"), "first_doc_id"))
    if marked:
        none = F.lit(-1)
        runs = runs.unionAll(leaves.where("diverse").select("doc_id", F.col("lo").alias("start_word"), none.alias("end_word"), none.cast("bigint").alias("first_doc_id")))
    return runs


def _stretches(runs: DataFrame, overlap: int) -> DataFrame:
    """Runs of a document that overlap by this many words, as one."""
    by_doc = Window.partitionBy("doc_id").orderBy("start_word", "end_word")
    before = F.max("end_word").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    steps = runs.withColumn("new", F.when(F.col("start_word") <= before - overlap, 0).otherwise(1)).withColumn("stretch", F.sum("new").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    return steps.groupBy("doc_id", "stretch").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.min("first_doc_id").alias("first_doc_id"))


def repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM, group_rows: int = GROUP_ROWS, inside: bool = False) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, first_doc_id): stretches of each document that occur in another, or with inside at another place.

    first_doc_id is the smallest document that a part of the stretch occurs in; where it is the
    document itself, this is the occurrence to keep.
    """
    out = _stretches(_runs(_texts(docs), least, gram, group_rows, inside), 1)
    return out.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "first_doc_id")


def _suffixes(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, runs, starts) to suffixes from starts to the ends of their runs, keyed by their first words."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string())
    for batch in base.sized(batches, "text", 1 << 18):
        for doc, text, runs, starts in zip(*(c.to_pylist() for c in batch.columns)):
            words, out, counted = text.split(), [], {}
            runs = sorted((r["start_word"], r["end_word"]) for r in runs)
            k = 0
            for p in sorted(starts):
                while runs[k][1] - least < p:
                    k += 1
                if runs[k][1] > len(words):
                    break  # of another row with this doc_id
                key = _whole(words[p : p + least])
                if p - counted.get(key, -least) >= least:
                    counted[key] = p
                    rest = words[p : runs[k][1]]
                    out.append((*key, *_whole(rest), doc, p, words[p - 1] if p else None, " ".join(rest)))
                if len(out) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], SUFFIX_COLUMNS)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], SUFFIX_COLUMNS)


def tree(leaves: list[list[int]]) -> Iterator[tuple[int, int, int]]:
    """(depth, first leaf, last leaf) of the internal nodes of the suffix tree whose leaves are these sorted sequences."""

    def common(a: list[int], b: list[int]) -> int:
        same = np.asarray(a[: len(b)]) == np.asarray(b[: len(a)])
        return len(same) if same.all() else int(same.argmin())

    stack: list[tuple[int, int]] = []  # (depth, first leaf) of the nodes that are open
    for k in range(1, len(leaves) + 1):
        depth, first = (common(leaves[k - 1], leaves[k]) if k < len(leaves) else 0), k - 1
        while stack and stack[-1][0] > depth:
            deeper, first = stack.pop()
            yield deeper, first, k - 1
        if depth and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def _maximal(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Rows (key1, key2, words, n, first, last_doc, low, high, start) sorted by key, to maximal repeats."""
    held: list[tuple] = []

    def group() -> list[tuple]:
        code: dict[str, int] = {}
        rows = sorted(([code.setdefault(w, len(code)) for w in r[2].split(" ")], *r[3:]) for r in held)
        nodes = {(d, a, b) for d, a, b in tree([r[0] for r in rows]) if d >= least}
        inner = {(d, b) for d, _, b in nodes} | {(d, a) for d, a, _ in nodes}
        nodes |= {(len(r[0]), k, k) for k, r in enumerate(rows) if r[1] > 1 and (len(r[0]), k) not in inner}
        out = []
        for depth, a, b in nodes:
            own = rows[a : b + 1]
            lows = [r[4] for r in own if r[4] is not None]
            if any(r[6] for r in own) or min(lows) != max(r[5] for r in own if r[5] is not None):
                doc, at = min((r[2]["doc_id"], r[2]["start_word"]) for r in own)
                out.append((doc, at, depth, sum(r[1] for r in own), max(r[3] for r in own)))
        return out

    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    for batch in base.sized(batches, "words"):
        out = []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[0][:2] != row[:2]:
                out += group()
                held.clear()
            held.append(row)
        columns = list(zip(*out)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], MAXIMAL_COLUMNS)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*group())) or [[]] * 5, kinds)], MAXIMAL_COLUMNS)


def maximal_repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, start_word, n_words, n_occurrences, last_doc_id) of each maximal repeat: its first occurrence, length, number and last document."""
    texts = _texts(docs)
    runs = base.stash(_runs(texts, least, gram, group_rows, True, True), "runs")
    own = _stretches(runs.where("end_word >= 0"), least - 1).groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "end_word")).alias("runs"))
    starts = runs.where("end_word < 0").groupBy("doc_id").agg(F.collect_set("start_word").alias("starts"))
    rows = texts.distinct().join(own, "doc_id").join(starts, "doc_id").select("doc_id", "text", "runs", "starts")
    suffixes = base.mapped(rows, lambda batches: _suffixes(batches, least), "key1 bigint, key2 bigint, rest1 bigint, rest2 bigint, doc_id bigint, start_word int, ahead string, words string")
    leaves = suffixes.groupBy("key1", "key2", "rest1", "rest2").agg(
        F.min("words").alias("words"), F.count("*").alias("n"), F.min(F.struct("doc_id", "start_word")).alias("first"), F.max("doc_id").alias("last_doc"), F.min("ahead").alias("low"), F.max("ahead").alias("high"), F.max(F.col("ahead").isNull()).alias("begins")
    )
    leaves = leaves.drop("rest1", "rest2").repartition("key1", "key2").sortWithinPartitions("key1", "key2")
    return base.mapped(leaves, lambda batches: _maximal(batches, least), MAXIMAL)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(base.table(spark, sf_dir, "documents"))


def op1_substring_dedup_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(base.table(spark, sf_dir, "documents"), inside=True)


def op1_substring_dedup_maximal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maximal_repeats(base.table(spark, sf_dir, "documents"))


ORACLE = {
    "op1_substring_dedup": r"""
WITH d AS (SELECT DISTINCT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT doc_id, i - 1 AS p, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
g AS (SELECT h, min(doc_id) AS first_doc_id FROM s GROUP BY h HAVING min(doc_id) <> max(doc_id)),
r AS (SELECT DISTINCT doc_id, p, first_doc_id FROM s JOIN g USING (h)),
t AS (SELECT *, CASE WHEN p < lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM r),
u AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS k FROM t)
SELECT doc_id, CAST(min(p) AS INTEGER) AS start_word, CAST(max(p) + 50 AS INTEGER) AS end_word, CAST(max(p) + 50 - min(p) AS INTEGER) AS n_words, min(first_doc_id) AS first_doc_id
FROM u GROUP BY doc_id, k"""
}
ORACLE["op1_substring_dedup_inside"] = ORACLE["op1_substring_dedup"].replace("HAVING min(doc_id) <> max(doc_id)", "HAVING min(doc_id) <> max(doc_id) OR min(p) <> max(p)")
QUERIES = {"op1_substring_dedup": op1_substring_dedup, "op1_substring_dedup_inside": op1_substring_dedup_inside, "op1_substring_dedup_maximal": op1_substring_dedup_maximal}
