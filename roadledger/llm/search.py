"""Exact top-k search (4): BM25 over sharded inverted indexes with block-max WAND pruning.

`build` makes an inverted index of all terms once, as a table: each shard of documents has a row
of their ids and lengths and a row of postings for each of its terms. Any number of searches read
it. A search sums up documents, words and the documents of each query term over all shards, and
takes the query terms' postings of each shard: impacts (complete BM25 contributions, from the
global statistics) with the maximum of each list and of each block of `BLOCK` postings.

For a query, the lists are ordered by their maxima. The pivot is the first at which the summed
maxima reach the k-th best score so far: a document that is only in lists before the pivot can't
get there, so these lists are never walked. Lists from the pivot on are walked from the highest
maximum down, `TOGETHER` postings at a time, while the pivot moves up with the k-th best score.
A document found there is a candidate if its impacts so far and the maxima of the blocks that it
would be in, of all other lists, reach the k-th best score; candidates are then looked up in one
list after the other, highest maximum first, and dropped once the maxima left can't make up for
the rest. This is WAND's pivot and block test for sets of documents, as numpy needs them, instead
of one cursor move at a time. The shards' top k are merged exactly, by score and doc_id.

Scores are rounded to 6 places, ties go to the smaller doc_id; a query's repeated words count as
often as they occur. Every row of the query table is a query.

Defined cases: null or empty texts, or ones without letters and digits, aren't documents and find nothing
as queries; null ids on either side are ignored; documents without a query word are no results,
so a query may have fewer than k; repeated rows are documents of their own; repeated queries
with the same id are one, of all their rows' words; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadledger.llm import base
from roadledger.llm.pieces import ranges

K, K1, B = 10, 1.2, 0.75
BLOCK = 64
#: Documents of a shard at most, and postings after which it is full, so that long documents make smaller shards.
SHARD_DOCS, SHARD_POSTINGS = 20_000, 4_000_000
#: Queries that are answered together.
SCAN_QUERIES = 5_000
#: Postings that are walked before the pivot is looked for again: at first, and at most.
AT_FIRST, TOGETHER = 50, 2000
#: How far below the k-th best score a bound may be by the rounding of scores.
SLACK = 1e-5
#: A row without a term holds its shard's documents; n counts postings, or documents.
INDEX = "shard bigint, term string, n bigint, words bigint, docs array<int>, times array<int>, ids array<bigint>"


def _postings(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(length of each text; text, term and times of each distinct pair; terms)."""
    offsets, codes, words = base.split_words(base.normalise(texts))
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    size = max(1, len(words))
    pair, times = np.unique(text * np.int64(size) + codes, return_counts=True)
    return np.diff(offsets), pair // size, pair % size, times, words


def _index(batches: Iterator[pa.RecordBatch], shard_docs: int, shard_postings: int) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()))
    names = ["shard", "term", "n", "words", "docs", "times", "ids"]
    held: list[tuple] = []
    made = 0

    def shard() -> Iterator[pa.RecordBatch]:
        nonlocal made
        number = (TaskContext.get().partitionId() << 32) + made
        made += 1
        sizes = [len(h[0]) for h in held]
        lengths = np.concatenate([h[1] for h in held])
        some = np.flatnonzero(lengths)
        at = np.cumsum(lengths > 0) - 1  # numbers of the texts that have words
        doc = at[np.concatenate([h[2] + a for h, a in zip(held, np.cumsum([0, *sizes]))])]
        coded = pa.concat_arrays([h[5] for h in held]).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        term = code[np.concatenate([h[3] + a for h, a in zip(held, np.cumsum([0, *(len(h[5]) for h in held)]))])]
        order = np.argsort(term, kind="stable")  # documents ascend within a term
        doc, times = doc[order].astype(np.int32), np.concatenate([h[4] for h in held])[order].astype(np.int32)
        first = np.searchsorted(term[order], np.arange(len(coded.dictionary) + 1))
        ids = np.concatenate([h[0] for h in held])[some]
        rows = [[number], [None], [len(ids)], [int(lengths.sum())], [None], [lengths[some].astype(np.int32)], [ids]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names)
        for a in range(0, len(coded.dictionary), 10_000):
            b = min(a + 10_000, len(coded.dictionary))
            ends = pa.array(first[a : b + 1] - first[a], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[first[a] : first[b]])) for x in (doc, times)]
            none = [pa.nulls(b - a, kinds[3]), pa.nulls(b - a, kinds[6])]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, number)), coded.dictionary[a:b], pa.array(np.diff(first[a : b + 1])), none[0], *lists, none[1]], names)
        held.clear()

    for batch in base.sized(batches, "text"):
        held.append((batch.column(0).to_numpy(), *_postings(batch.column(1))))
        if sum(len(h[0]) for h in held) >= shard_docs or sum(len(h[2]) for h in held) >= shard_postings:
            yield from shard()
    if held:
        yield from shard()


class Shard:
    """The query terms' part of an inverted index: documents and impacts, in blocks with maxima."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, doc: np.ndarray, term: np.ndarray, times: np.ndarray, idf: np.ndarray, average: float, block: int = BLOCK):
        self.ids = ids
        order = np.lexsort((doc, term))
        self.doc, term, times = doc[order], term[order], times[order]
        self.impact = idf[term] * times * (K1 + 1) / (times + K1 * (1 - B + B * lengths[self.doc] / average))
        self.first = np.searchsorted(term, np.arange(len(idf) + 1))
        sizes = np.diff(self.first)
        blocks = -(-sizes // block)
        self.block_first = np.concatenate([[0], np.cumsum(blocks)])
        starts = ranges(np.zeros(len(sizes), np.int64), blocks) * block + np.repeat(self.first[:-1], blocks)
        ends = np.minimum(starts + block, np.repeat(self.first[1:], blocks))
        self.block_last = self.doc[ends - 1] if len(ends) else np.empty(0, np.int64)
        self.block_max = np.maximum.reduceat(self.impact, starts) if len(starts) else np.empty(0)
        self.list_max = np.zeros(len(idf))
        some = np.flatnonzero(sizes)
        if len(some):
            self.list_max[some] = np.maximum.reduceat(self.impact, self.first[some])
        self.postings = self.read = self.probes = 0  # of all queries: postings of their terms, those that entered a score, and look-ups

    def _bound(self, term: int, docs: np.ndarray) -> np.ndarray:
        """The maximum of the block that each document would be in."""
        a, b = self.block_first[term], self.block_first[term + 1]
        return np.append(self.block_max[a:b], 0.0)[np.searchsorted(self.block_last[a:b], docs)]

    def _look_up(self, term: int, docs: np.ndarray) -> np.ndarray:
        """The impact of each document, 0 where the list doesn't have it."""
        a, b = self.first[term], self.first[term + 1]
        at = np.minimum(np.searchsorted(self.doc[a:b], docs), b - a - 1) + a
        there = self.doc[at] == docs
        self.probes += len(docs)
        self.read += int(there.sum())
        return np.where(there, self.impact[at], 0.0)

    def top(self, terms: np.ndarray, times: np.ndarray, k: int, least: float, together: int = TOGETHER) -> list[tuple[float, int]]:
        """(score, doc_id) of the k best of at least `least`."""
        own = [(t, n) for t, n in zip(terms, times) if self.first[t + 1] > self.first[t]]
        own.sort(key=lambda x: (x[1] * self.list_max[x[0]], x[0]))
        most = np.cumsum([n * self.list_max[t] for t, n in own])  # of documents in none but the first lists
        sizes = [int(self.first[t + 1] - self.first[t]) for t, _ in own]
        self.postings += sum(sizes)
        seen = np.zeros(len(self.ids), bool)
        best: list[tuple[float, int]] = []
        end, step = len(own), min(AT_FIRST, together)
        while end and most[end - 1] >= least - SLACK:
            begin, walked = end - 1, sizes[end - 1]
            while begin and most[begin - 1] >= least - SLACK and walked + sizes[begin - 1] <= step:
                begin -= 1
                walked += sizes[begin]
            self.read += walked
            step = min(2 * step, together)
            at = [slice(self.first[t], self.first[t + 1]) for t, _ in own[begin:end]]
            docs, back = np.unique(np.concatenate([self.doc[x] for x in at]), return_inverse=True)
            score = np.bincount(back, np.concatenate([n * self.impact[x] for x, (_, n) in zip(at, own[begin:end])]), len(docs))
            new = ~seen[docs]
            seen[docs] = True
            end = begin
            docs, score = docs[new], score[new]
            bound = score.copy()
            if end:  # may be in lists not walked yet
                some = score + most[end - 1] >= least - SLACK
                docs, score, bound = docs[some], score[some], bound[some]
                for t, n in own[:end]:
                    bound += n * self._bound(t, docs)
            order = np.argsort(-bound, kind="stable")  # the most promising first, so that the rest meets a high k-th best
            for part in (order[:k], order[k:]):
                part = part[bound[part] >= least - SLACK]
                if len(part):
                    best = self._scored(docs[part], score[part], own[:end], most, k, least, best)
                    if len(best) == k:
                        least = max(least, -best[-1][0])
        return [(-s, d) for s, d in best]

    def _scored(self, docs: np.ndarray, score: np.ndarray, others: list, most: np.ndarray, k: int, least: float, best: list[tuple[float, int]]) -> list[tuple[float, int]]:
        """best with the candidates' full scores: looked up in the other lists while they can reach `least`."""
        for j in range(len(others) - 1, -1, -1):
            some = score + most[j] >= least - SLACK
            docs, score = docs[some], score[some]
            if not len(docs):
                return best
            score = score + others[j][1] * self._look_up(others[j][0], docs)
        score = np.round(score, 6)
        hits = np.flatnonzero((score > 0) & (score >= least))
        if len(hits) > k:
            kept = np.partition(score[hits], len(hits) - k)[len(hits) - k]
            hits = hits[score[hits] >= kept]
        return sorted([*best, *((-score[h], int(self.ids[docs[h]])) for h in hits)])[:k]


def _search(batches: Iterator[pa.RecordBatch], idf: np.ndarray, average: float, queries: list[tuple[int, np.ndarray, np.ndarray]], k: int, block: int, together: int) -> Iterator[pa.RecordBatch]:
    """Rows (shard, code, docs, times, ids) sorted by shard, to the k best of each query."""
    best: list[list[tuple[float, int]]] = [[] for _ in queries]
    held: list[pa.RecordBatch] = []

    def search() -> None:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        code, sizes = rows.column(1), rows.column(2).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        header = code.is_null().to_numpy(zero_copy_only=False)
        head = rows.filter(pa.array(header))
        lists = rows.filter(pa.array(~header))
        ids, lengths = head.column(4).flatten().to_numpy(), head.column(3).flatten().to_numpy().astype(np.int64)
        term = np.repeat(lists.column(1).to_numpy().astype(np.int64), sizes[~header])
        shard = Shard(ids, lengths, lists.column(2).flatten().to_numpy().astype(np.int64), term, lists.column(3).flatten().to_numpy().astype(np.int64), idf, average, block)
        for q, (_, terms, times) in enumerate(queries):
            least = best[q][-1][0] if len(best[q]) == k else 0.0
            found = shard.top(terms, times, k, least, together)
            best[q] = sorted([*best[q], *found], key=lambda x: (-x[0], x[1]))[:k]
        held.clear()

    at = None
    for batch in batches:
        if not batch.num_rows:
            continue
        number = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(number)]
        for a, b in zip(cuts, cuts[1:]):
            if held and number[a] != at:
                search()
            at = number[a]
            held.append(batch.slice(a, b - a))
    if held:
        search()
    rows = [(queries[q][0], d, s) for q, found in enumerate(best) for s, d in found]
    columns = list(zip(*rows)) or [[]] * 3
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["item_id", "doc_id", "score"])


def build(docs: DataFrame, shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """The inverted index of all terms of docs, as a written table. Results don't depend on the shards' sizes."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    return base.stash(base.mapped(texts, lambda batches: _index(batches, shard_docs, shard_postings), INDEX), "index")


def search(index: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, together: int = TOGETHER) -> DataFrame:
    """(item_id, place, doc_id, score): the k best documents of the index for each query by BM25."""
    spark = index.sparkSession
    asked = queries.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    asked = asked.groupBy("item_id").agg(F.array_join(F.sort_array(F.collect_list("text")), " ").alias("text")).orderBy("item_id")
    totals = index.where("term is null").agg(F.sum("n").alias("documents"), F.sum("words").alias("words")).first()
    documents = totals["documents"] or 0
    results: list[DataFrame] = []

    def answer(batch: list[tuple[int, Counter]]) -> None:
        vocabulary = sorted({w for _, words in batch for w in words})
        if not vocabulary or not documents:
            return
        code = {w: n for n, w in enumerate(vocabulary)}
        terms = F.broadcast(spark.createDataFrame(list(code.items()), "term string, code int"))  # of SCAN_QUERIES queries at most
        lists = index.join(terms, "term")
        held = np.zeros(len(vocabulary))
        for r in lists.groupBy("code").agg(F.sum("n").alias("n")).collect():
            held[r["code"]] = r["n"]
        idf = np.log(1 + (documents - held + 0.5) / (held + 0.5))
        own = [(item, np.array([code[w] for w in sorted(words)]), np.array([words[w] for w in sorted(words)])) for item, words in batch if words]
        average = totals["words"] / documents
        columns = ["shard", "code", "docs", "times", "ids"]
        rows = lists.select(*columns).unionAll(index.where("term is null").withColumn("code", F.lit(None).cast("int")).select(*columns))
        rows = rows.repartition("shard").sortWithinPartitions("shard")
        results.append(base.mapped(rows, lambda batches: _search(batches, idf, average, own, k, block, together), "item_id bigint, doc_id bigint, score double"))

    batch: list[tuple[int, Counter]] = []
    for row in asked.toLocalIterator():
        batch.append((row["item_id"], Counter(base.normalise(pa.array([row["text"]]))[0].as_py().split())))
        if len(batch) == SCAN_QUERIES:
            answer(batch)
            batch = []
    if batch:
        answer(batch)
    if not results:
        return spark.createDataFrame([], "item_id bigint, place int, doc_id bigint, score double")
    found = results[0]
    for more in results[1:]:
        found = found.unionAll(more)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("item_id", "place", "doc_id", "score")


def top_k(docs: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(item_id, place, doc_id, score): the k best documents of each query by BM25."""
    return search(build(docs), queries, k)


def op4_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "benchmark"))


ORACLE = {
    "op4_top_k_search": r"""
WITH d AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
l AS (SELECT doc_id, w, len(w) AS dl FROM d WHERE w[1] <> ''),
g AS (SELECT count(*) AS n, avg(dl) AS a FROM l),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, dl, unnest(w) AS term FROM l) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')) AS term FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL) WHERE term <> '' GROUP BY ALL),
s AS (SELECT item_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / a))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term) CROSS JOIN g GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS place, doc_id, score FROM s)
SELECT item_id, place, doc_id, score FROM r WHERE place <= 10"""
}
QUERIES = {"op4_top_k_search": op4_top_k_search}
