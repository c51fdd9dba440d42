from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from roadledger.llm import base, search


def brute(docs, queries, k):
    words = {d: t.lower().split() for d, t in docs if t.split()}
    average = sum(map(len, words.values())) / len(words)
    df = {}
    for w in words.values():
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for q, text in queries:
        scores = []
        for d, w in words.items():
            s = 0.0
            for t in sorted(text.lower().split()):
                tf = w.count(t)
                if tf:
                    s += math.log(1 + (len(words) - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / average))
            if round(s, 6) > 0:
                scores.append((-round(s, 6), d))
        out += [(q, n, d, -s) for n, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return out


@pytest.mark.parametrize("shard, postings, block, together", [(20_000, 4_000_000, 64, 2000), (37, 4_000_000, 4, 8), (20_000, 900, 3, 1)])
def test_against_brute_force(spark, shard, postings, block, together):
    rng = random.Random(block)
    vocabulary = [f"t{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    docs = [(d, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60)))) for d in range(900)]
    docs += [(1000 + d, docs[d][1]) for d in range(40)]  # ties
    queries = [(q, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 9)))) for q in range(60)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    index = search.build(table, shard, postings)
    got = sorted(tuple(r) for r in search.search(index, spark.createDataFrame(queries, "item_id bigint, text string"), 7, block, together).collect())
    want = brute(docs, queries, 7)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want], atol=2e-6)
    # the same index serves other queries
    again = [(1, "t1 t2 t3 t5")]
    assert [tuple(r)[:3] for r in search.search(index, spark.createDataFrame(again, "item_id bigint, text string"), 3).orderBy("place").collect()] == [x[:3] for x in brute(docs, again, 3)]


def test_several_scans_of_queries(spark, monkeypatch):
    monkeypatch.setattr(search, "SCAN_QUERIES", 2)
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id bigint, text string")
    queries = spark.createDataFrame([(k, t) for k, t in enumerate(("a", "b", "c", "z", "a c"))], "item_id bigint, text string")
    out = search.top_k(docs, queries).collect()
    assert sorted((r["item_id"], r["place"], r["doc_id"]) for r in out) == [(0, 1, 1), (1, 1, 1), (1, 2, 2), (2, 1, 2), (4, 1, 1), (4, 2, 2)]


def test_lists_before_the_pivot_are_not_walked():
    size = 4000
    times = np.ones(size, np.int64)
    times[17] = 50
    doc, term = np.concatenate([np.arange(size), [17, 400]]), np.repeat([0, 1], [size, 2])
    shard = search.Shard(np.arange(size), np.full(size, 100), doc, term, np.concatenate([times, [1, 1]]), np.array([0.5, 9.0]), 100.0, 8)
    assert [d for _, d in shard.top(np.array([0, 1]), np.array([1, 1]), 2, 0.0)] == [17, 400]
    assert shard.postings == size + 2 and shard.read <= 4


def test_most_postings_of_benchmark_are_skipped():
    """At sf0.1, as one shard: the results are those of scoring everything, with under half of the postings entering a score."""
    import pyarrow.parquet as pq

    docs = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"])
    queries = [t for t in pq.read_table("/root/testdata/sf0.1/benchmark.parquet").column("text").to_pylist() if t]
    counts = [search.Counter(base.normalise(pa.array([t]))[0].as_py().split()) for t in queries]
    code = {w: n for n, w in enumerate(sorted({w for c in counts for w in c}))}
    ids, lengths, doc, term, times = [], [], [], [], []
    for batch in base.sized(docs.to_batches(), "text"):
        size, text, own, n, words = search._postings(batch.column(1))
        own = np.array([code.get(w, -1) for w in words.to_pylist()])[own]
        doc.append(text[own >= 0] + sum(map(len, ids)))
        term.append(own[own >= 0])
        times.append(n[own >= 0])
        ids.append(batch.column(0).to_numpy())
        lengths.append(size)
    ids, lengths, doc, term, times = map(np.concatenate, (ids, lengths, doc, term, times))
    held = np.bincount(term, minlength=len(code))
    idf = np.log(1 + ((lengths > 0).sum() - held + 0.5) / (held + 0.5))
    shard = search.Shard(ids, lengths, doc, term, times, idf, lengths.sum() / (lengths > 0).sum())
    for c in counts:
        own, n = np.array([code[w] for w in sorted(c)]), np.array([c[w] for w in sorted(c)])
        got = shard.top(own, n, 10, 0.0)
        score = np.zeros(len(ids))
        for t, many in zip(own, n):
            at = slice(shard.first[t], shard.first[t + 1])
            score[shard.doc[at]] += many * shard.impact[at]
        score = np.round(score, 6)
        order = np.lexsort((ids, -score))[:10]
        assert [d for _, d in got] == ids[order].tolist() and np.allclose([x for x, _ in got], score[order], atol=2e-6)
    print(shard.read / shard.postings, shard.probes / shard.postings)
    assert shard.read < shard.postings / 2 and shard.probes < shard.postings
