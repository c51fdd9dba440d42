"""MinHash near-dedup (6): Order MinHash sketches, candidates verified by banded alignment.

Texts are compared as words in lower case with letters and digits alone. Every pair of
neighbouring words is a k-mer, labelled with how often it occurred before; each hash function
of a family takes the smallest few labelled k-mers and hashes them in text order, so that
agreement falls with edit distance and not only with overlap. `FAMILIES` lists the families:
one for all texts and two that take fewer k-mers, for short texts alone, where an edit within
the threshold spoils a large share of the k-mers; a text's families follow from its own length.
Documents that agree in a sketch are candidates; a pair is near if its word edit distance, by
bit-parallel banded alignment, is at most 1 - `similarity` of the longer one's words. Groups are
the connected parts.

Equal word sequences are collapsed first by a 128-bit hash. The documents of a bucket are then
compared in two rounds. In the first, each with the least doc_id of the bucket. In the second,
every two that the near pairs so far don't connect. Pairs in one part can't change the parts, so
the groups are those of all pairs in all buckets, whatever the buckets' sizes. In both rounds a
pair is left out if the counts of its words in 64 hashed bins prove the distance too large (the
bound is exact). Nothing is capped: a bucket of many members is spread over blocks of two parts.

Defined cases: null or empty texts and texts without letters and digits are near to nothing;
texts of one word are near if that word is equal; rows with the same doc_id are one document,
near to all that one of its texts is near to; null doc_ids are ignored and always kept; the
smallest doc_id of a group stays; an empty table gives an empty result. Other columns are ignored
or passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadledger.llm import base
from roadledger.llm.pieces import ranges

SIMILARITY = 0.8
#: (sketches, k-mers that each takes, most words of a text that has them).
FAMILIES = ((32, 3, 1 << 30), (24, 2, 40), (16, 1, 10))
BINS = 64
#: Members of a large bucket that share a part, and pairs of a document that are verified together.
PART_ROWS, TOGETHER = 500, 64
_RNG = np.random.default_rng(20240607)
_ODD = _RNG.integers(1, 1 << 63, sum(f[0] for f in FAMILIES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEED = _RNG.integers(1, 1 << 63, len(_ODD), dtype=np.uint64)
_PLACE = np.uint64((1 << 30) - 1)


def sketch(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """(rows, n_words, two hashes, keys, bins) of the texts that have words; keys: which of them and their keys, of each family."""
    offsets, codes, words = base.split_words(base.normalise(texts))
    n_words = np.diff(offsets)
    rows = np.flatnonzero(n_words)
    n_words, starts = n_words[rows], offsets[:-1][rows]
    if not len(rows):
        return rows, n_words, np.empty((0, 2), np.int64), [], np.empty((0, BINS), np.uint16)
    word = base.hash_strings(words)[codes]
    own = np.repeat(np.arange(len(rows)), n_words)
    place = np.arange(len(word)) - starts[own]
    longest = int(n_words.max())
    whole = [np.add.reduceat(word * np.cumprod(np.full(longest, m, np.uint64))[place], starts) for m in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]
    bins = np.minimum(np.bincount(own * BINS + (word >> np.uint64(58)).astype(np.int64), minlength=len(rows) * BINS), 65535).astype(np.uint16).reshape(-1, BINS)

    # k-mers of two words; the only word of a text stands alone
    pair = np.append(word[1:], np.uint64(0))
    last = starts + n_words - 1
    pair[last] = 0
    kmer = base.mix64(word * np.uint64(0xFF51AFD7ED558CCD) + pair)
    use = np.ones(len(kmer), bool)
    use[last[n_words > 1]] = False
    kmer, own = kmer[use], own[use]
    inside = kmer ^ base.mix64(own.astype(np.uint64) + np.uint64(1))
    order = np.argsort(inside, kind="stable")
    sorted_ = inside[order]
    new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    at = np.arange(len(order))
    occurrence = np.empty(len(order), np.uint64)
    occurrence[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    label = base.mix64(kmer + occurrence * np.uint64(0x9E3779B97F4A7C15))
    starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))

    keys, done = [], 0
    for many, taken, most in FAMILIES:
        some = np.flatnonzero(n_words <= most)
        lengths = np.diff(np.append(starts, len(label)))[some]
        chosen = label if len(some) == len(rows) else label[ranges(starts[some], lengths)]
        keys.append((some, _keys(chosen, np.cumsum(lengths) - lengths, range(done, done + many), taken)))
        done += many
    return rows, n_words, np.stack(whole, 1).view(np.int64), keys, bins


def _keys(label: np.ndarray, starts: np.ndarray, sketches: range, taken: int) -> np.ndarray:
    """The key of each text, whose labelled k-mers begin at starts, in each sketch."""
    keys = np.empty((len(starts), len(sketches)), np.int64)
    if not len(starts):
        return keys
    index = np.arange(len(label), dtype=np.uint64)
    label_or_none = np.append(label, np.uint64(0))
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    for k, s in enumerate(sketches):
        value = ((label * _ODD[s]) & ~_PLACE) | index
        least_few = []
        for _ in range(taken):
            least = np.minimum.reduceat(value, starts)
            where = np.where(least == none, len(label), (least & _PLACE)).astype(np.int64)
            value[where[where < len(label)]] = none
            least_few.append(where)
        key = np.full(len(starts), _SEED[s], np.uint64)
        for where in np.sort(np.stack(least_few), axis=0):
            key = base.mix64(key * np.uint64(0xC4CEB9FE1A85EC53) + label_or_none[where])
        keys[:, k] = key.view(np.int64)
    return keys


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in base.sized(batches, "text"):
        rows, n_words, whole, keys, bins = sketch(batch.column(1))
        sizes = np.zeros(len(rows), np.int64)
        for some, own in keys:
            sizes[some] += own.shape[1]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        flat, at = np.empty(ends[-1], np.int64), ends[:-1].copy()
        for some, own in keys:
            flat[(at[some][:, None] + np.arange(own.shape[1])).ravel()] = own.ravel()
            at[some] += own.shape[1]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(rows)), pa.array(n_words, pa.int32()), pa.array(np.ascontiguousarray(whole[:, 0])), pa.array(np.ascontiguousarray(whole[:, 1])),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                pa.array([b.tobytes() for b in bins], pa.binary()),
            ],
            ["doc_id", "n", "h1", "h2", "keys", "bins"],
        )


def within(a: list, b: list, most: int, table: dict | None = None) -> bool:
    """Whether the edit distance of a and b is at most `most`: one column of the band at a time.

    Bit p of a column j stands for row j - most + p; the score is followed along the diagonal
    that ends in the last cell, where it never falls. table: positions() of a, if at hand.
    """
    n, m = len(a), len(b)
    score = abs(n - m)
    if score > most:
        return False
    table = positions(a) if table is None else table
    width = 2 * most + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    goal = 1 << (n - m + most)
    vn = (1 << (most + 1)) - 1
    vp = full ^ vn
    for j in range(1, m + 1):
        vp, vn = vp >> 1 | top, vn >> 1
        eq = table.get(b[j - 1], 0)
        if eq:
            shift = j - most - 1
            eq = (eq >> shift if shift >= 0 else eq << -shift) & full
        d0 = (((eq & vp) + vp) ^ vp | eq | vn) & full
        if not d0 & goal:
            score += 1
            if score > most:
                return False
        hp = ((vn | full ^ (d0 | vp)) << 1 | 1) & full
        vn, vp = d0 & hp, ((d0 & vp) << 1 | full ^ (d0 | hp)) & full
    return True


def positions(a: list) -> dict:
    """A bit set of the places of each element."""
    places: dict = {}
    for k, x in enumerate(a):
        places.setdefault(x, []).append(k)
    out = {}
    for x, ks in places.items():
        bits = bytearray(ks[-1] // 8 + 1)
        for k in ks:
            bits[k >> 3] |= 1 << (k & 7)
        out[x] = int.from_bytes(bits, "little")
    return out


def allowed(longer: int, similarity: float) -> int:
    """Edits that a pair may have whose longer text has so many words."""
    return int((1 - similarity) * longer + 1e-9)


def _bins(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BINS).astype(np.int32)


def _bounded(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, n_a, n_b, bins_a, bins_b) whose lengths and bins allow them to be near, as (a, b)."""
    for batch in batches:
        if batch.num_rows:
            n_a, n_b = (batch.column(k).to_numpy().astype(np.int64) for k in (2, 3))
            most = ((1 - similarity) * np.maximum(n_a, n_b) + 1e-9).astype(np.int64)
            fits = (np.abs(n_a - n_b) <= most) & (np.abs(_bins(batch.column(4)) - _bins(batch.column(5))).sum(1) <= 2 * most)
            yield batch.select([0, 1]).filter(pa.array(fits))


def _apart(rows: pa.RecordBatch, similarity: float) -> pa.RecordBatch:
    """Pairs that may be near and aren't connected yet, of one block: (.., low, high, part, doc, root, n, bins).

    A block is two parts of a bucket, or one; in a block of two, only pairs across count.
    """
    low, high, part, doc, root, n = (rows.column(k).to_numpy().astype(np.int64) for k in range(1, 7))
    order = np.argsort(n, kind="stable")
    part, doc, root, n, bins = part[order], doc[order], root[order], n[order], _bins(rows.column(7).take(pa.array(order)))
    across = low[0] != high[0]
    most = ((1 - similarity) * n + 1e-9).astype(np.int64)  # of pairs whose longer text this is
    first = np.searchsorted(n, n - most)
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for k in range(1, len(doc)):
        others = np.arange(first[k], k)
        others = others[(root[others] != root[k]) & ((part[others] != part[k]) | (not across)) & (doc[others] != doc[k])]
        others = others[np.abs(bins[others] - bins[k]).sum(1) <= 2 * most[k]]
        a.append(doc[others])
        b.append(np.full(len(others), doc[k]))
    a, b = np.concatenate(a), np.concatenate(b)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _blocks(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, low, high, part, doc, root, n, bins) sorted by block, to pairs."""
    held: list[pa.RecordBatch] = []
    found: list[pa.RecordBatch] = []
    at = None

    def block() -> None:
        found.append(_apart(pa.Table.from_batches(held).combine_chunks().to_batches()[0], similarity))
        held.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)], 1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
        for x, y in zip(cuts, cuts[1:]):
            if held and at != key[x].tolist():
                block()
            at = key[x].tolist()
            held.append(batch.slice(x, y - x))
        if found:
            yield pa.Table.from_batches(found).combine_chunks().to_batches(1 << 20)[0] if sum(f.num_rows for f in found) else found[0]
            found.clear()
    if held:
        block()
        yield from found


def _verify(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (lead, doc, part, text), the lead's own first in each part, to (a, b, near)."""
    at, leads = None, []
    for batch in base.sized(batches, "text"):
        out = []
        own, docs, parts = (batch.column(k).to_pylist() for k in range(3))
        for lead, doc, part, text in zip(own, docs, parts, base.normalise(batch.column(3)).to_pylist()):
            words = text.split()
            if lead == doc:
                if at != (lead, part):
                    at, leads = (lead, part), []
                leads.append((words, positions(words)))
                continue
            near = at == (lead, part) and bool(words) and any(first and within(first, words, allowed(max(len(words), len(first)), similarity), table) for first, table in leads)
            out.append((lead, doc, near))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.bool_())], ["a", "b", "near"])


def _verified(texts: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """(a, b, near) of pairs; only the texts they name are shuffled, while the pairs are few enough to broadcast."""
    parts = F.ceil(F.count("*").over(Window.partitionBy("a")) / TOGETHER)
    pairs = base.stash(pairs.select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part")), "pairs")
    need = pairs.select(F.col("a").alias("lead"), F.col("b").alias("doc"), "part").unionAll(pairs.select(F.col("a").alias("lead"), F.col("a").alias("doc"), "part").distinct())
    rows = texts.join(base.small(need), texts["doc_id"] == F.col("doc")).select("lead", "doc", "part", "text")
    rows = rows.repartition("lead", "part").sortWithinPartitions("lead", "part", F.col("doc") != F.col("lead"), "doc")
    out = base.mapped(rows, lambda batches: _verify(batches, similarity), "a bigint, b bigint, near boolean")
    return base.stash(out.groupBy("a", "b").agg(F.max("near").alias("near")), "verified")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of edges (a, b): the least node that is connected."""
    both = base.stash(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = base.stash(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        beside = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("beside"))
        nearer = labels.join(beside, labels["node"] == beside["a"]).select("node", F.col("root").alias("was"), F.least("root", "beside").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("root").alias("far"))
        moved = base.stash(nearer.join(jump, "next", "left").select("node", "was", F.coalesce(F.least("next", "far"), "next").alias("root")), "labels")
        labels = moved.select("node", "root")
        if moved.where("root <> was").isEmpty():
            return labels


def _possible(pairs: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """The pairs that the marks of their documents don't rule out."""
    pairs = base.stash(pairs, "pairs")
    named = base.small(pairs.select(F.col("a").alias("doc")).unionAll(pairs.select(F.col("b").alias("doc"))).distinct())
    own = base.stash(marks.join(named, "doc", "left_semi"), "marks")
    a, b = (own.select(F.col("doc").alias(x), F.col("n").alias(f"n_{x}"), F.col("bins").alias(f"bins_{x}")) for x in "ab")
    rows = pairs.join(a, "a").join(b, "b").select("a", "b", "n_a", "n_b", "bins_a", "bins_b")
    return base.mapped(rows, lambda batches: _bounded(batches, similarity), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, part_rows: int = PART_ROWS, stars: bool = True) -> DataFrame:
    """(doc_id, kept_id): every document that goes, with the one of its group that stays.

    Neither part_rows nor stars, which is whether there is a first round, changes the result.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    all_ = base.stash(base.mapped(texts, _sketches, "doc_id bigint, n int, h1 bigint, h2 bigint, keys array<bigint>, bins binary"), "sketches")
    equal = all_.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"))
    rep_of = base.stash(all_.select("doc_id", "h1", "h2", "n").join(equal, ["h1", "h2", "n"]).select("doc_id", "rep").distinct(), "equal")
    reps = all_.join(rep_of.where("doc_id = rep").select("doc_id"), "doc_id", "left_semi")
    marks = reps.select(F.col("doc_id").alias("doc"), "n", "bins")

    members = reps.select(F.explode("keys").alias("bucket"), F.col("doc_id").alias("doc"))
    shared = members.groupBy("bucket").agg(F.min("doc").alias("lead"), F.max("doc").alias("last"), F.count("*").alias("rows")).where("lead <> last").drop("last")
    members = base.stash(members.join(shared, "bucket"), "buckets")
    near = checked = None
    if stars:
        pairs = members.where("doc <> lead").select(F.col("lead").alias("a"), F.col("doc").alias("b")).distinct()
        checked = _verified(texts, _possible(pairs, marks, similarity), similarity)
        near = checked.where("near").select("a", "b")
        members = members.where("rows > 2")
    # documents that have texts equal to those of several others tie these together
    several = rep_of.groupBy("doc_id").agg(F.count("*").alias("reps")).where("reps > 1").select("doc_id")
    edges = rep_of.join(several, "doc_id", "left_semi").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).where("a <> b")
    edges = edges if near is None else edges.unionAll(near)
    roots = components(edges)
    members = members.join(roots, members["doc"] == roots["node"], "left").select("bucket", "doc", F.coalesce("root", "doc").alias("root"))
    split = members.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("rows")).where("x <> y").select("bucket", F.ceil(F.col("rows") / part_rows).cast("int").alias("parts"))
    rows = members.join(split, "bucket").join(marks, "doc").withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("bucket", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "doc", "root", "n", "bins")
    blocks = rows.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    more = base.mapped(blocks, lambda batches: _blocks(batches, similarity), "a bigint, b bigint").distinct()
    more = base.stash(more if checked is None else more.join(checked, ["a", "b"], "left_anti"), "apart")
    if not more.isEmpty():
        roots = components(edges.unionAll(_verified(texts, more, similarity).where("near").select("a", "b")))

    out = rep_of.join(roots, rep_of["rep"] == roots["node"], "left").groupBy("doc_id").agg(F.min(F.coalesce("root", "rep")).alias("kept_id"))
    return out.where("doc_id <> kept_id")


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one document of each group."""
    gone = base.stash(near_duplicates(docs, similarity).select(F.col("doc_id").alias("__gone_id")), "duplicates")
    return docs.join(base.small(gone), docs["doc_id"] == gone["__gone_id"], "left_anti")


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(base.table(spark, sf_dir, "documents"))


QUERIES = {"op6_order_minhash": op6_order_minhash}
ORACLE: dict[str, str] = {}
