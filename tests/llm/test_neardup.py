from __future__ import annotations

import random

import pytest

from roadledger.llm import neardup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, words, share):
    out = []
    for w in words:
        x = rng.random()
        if x < share / 3:
            continue
        out.append(w if x > share * 2 / 3 else f"n{rng.randrange(10**6)}")
        if x > 1 - share / 3:
            out.append(f"i{rng.randrange(10**6)}")
    return out


def test_banded_alignment_is_exact():
    rng = random.Random(5)
    for _ in range(1500):
        a = [rng.choice("abc") for _ in range(rng.randrange(15))]
        b = edited(rng, a, 0.4)[:15] if rng.random() < 0.7 else [rng.choice("abc") for _ in range(rng.randrange(15))]
        d = distance(a, b)
        assert [neardup.within(a, b, t) for t in range(9)] == [d <= t for t in range(9)]


def vocabulary(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


@pytest.mark.parametrize("shared", [False, True])
def test_recall_and_precision_against_all_pairs(spark, shared):
    """Groups of edited copies; with `shared`, most documents also hold one long common passage."""
    rng = random.Random(11)
    passage = vocabulary(rng, 60)
    docs = []
    for group in range(40):
        base = vocabulary(rng, rng.choice((8, 30, 90, 250)))
        if shared:
            base = base + passage
        docs += [edited(rng, base, rng.choice((0.03, 0.1, 0.2))) for _ in range(rng.choice((1, 1, 2, 3, 12)))]
    rng.shuffle(docs)
    table = spark.createDataFrame([(k, " ".join(w).upper() if k % 3 else ", ".join(w)) for k, w in enumerate(docs)], "doc_id bigint, text string").repartition(4)
    gone = dict(tuple(r) for r in neardup.near_duplicates(table).collect())
    root = lambda d: gone.get(d, d)
    near = [(i, j) for i in range(len(docs)) for j in range(i) if abs(len(docs[i]) - len(docs[j])) <= 0.2 * max(len(docs[i]), len(docs[j])) and neardup.within(docs[i], docs[j], neardup.allowed(max(len(docs[i]), len(docs[j])), 0.8))]
    assert len(near) > 100
    assert sum(root(i) == root(j) for i, j in near) >= 0.9 * len(near)
    # groups are parts connected by near pairs, and nothing else
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in near:
        parent[max(find(i), find(j))] = min(find(i), find(j))
    assert all(find(d) == find(k) for d, k in gone.items())


def test_large_groups_of_copies(spark):
    rng = random.Random(2)
    base = vocabulary(rng, 120)
    docs = [(k, " ".join(base if k < 300 else edited(rng, base, 0.05))) for k in range(500)]
    docs += [(1000 + k, " ".join(vocabulary(rng, 120))) for k in range(50)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    gone = dict(tuple(r) for r in neardup.near_duplicates(table).collect())
    assert set(gone) == set(range(1, 500)) and set(gone.values()) == {0}


@pytest.mark.parametrize("words", [5, 6, 7, 8, 10, 12, 15, 20, 30, 50, 120])
def test_candidates_at_the_threshold(words):
    """Pairs with as many edits as the threshold allows agree in a sketch nine times in ten at each length."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(words)
    pairs = []
    for _ in range(400):
        a = vocabulary(rng, words)
        b = list(a)
        for at in rng.sample(range(words), neardup.allowed(words, 0.8)):
            b[at] = f"n{rng.randrange(10**6)}"
        pairs += [" ".join(a), " ".join(b)]
    _, _, _, keys, _ = neardup.sketch(pa.array(pairs))
    met = np.zeros(400, bool)
    for some, own in keys:
        if len(some):
            assert len(some) == 800
            met |= (own[::2] == own[1::2]).any(1)
    assert met.mean() >= 0.9


@pytest.fixture(scope="module")
def chains():
    """Copies that drift from one to the next, among documents that share much but not enough."""
    rng = random.Random(21)
    docs, passage = [], vocabulary(rng, 50)
    for _ in range(12):
        words = vocabulary(rng, 60) + passage
        for _ in range(rng.choice((2, 9, 14))):
            docs.append(list(words))
            for at in rng.sample(range(len(words)), 14):
                words[at] = f"c{rng.randrange(10**6)}"
    docs += [vocabulary(rng, 25) + passage for _ in range(60)]
    rng.shuffle(docs)
    return docs


def test_groups_do_not_depend_on_rounds_or_parts(spark, chains):
    table = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(chains)], "doc_id bigint, text string").repartition(4)
    results = [sorted(tuple(r) for r in neardup.near_duplicates(table, part_rows=parts, stars=stars).collect()) for parts, stars in ((500, True), (2, True), (6, False), (10**6, False))]
    assert results[0] == results[1] == results[2] == results[3]
    import numpy as np
    import pyarrow as pa

    _, _, _, keys, _ = neardup.sketch(pa.array([" ".join(w) for w in chains]))
    own, parent = keys[0][1], list(range(len(chains)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(chains)):
        for j in range(i):
            if (own[i] == own[j]).any() and neardup.within(chains[i], chains[j], neardup.allowed(max(len(chains[i]), len(chains[j])), 0.8)):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    assert results[0] == sorted((k, find(k)) for k in range(len(chains)) if find(k) != k) and len(results[0]) > 30
    # most documents share a bucket with a large part of the others, so that the parts matter
    assert max(np.unique(own, return_counts=True)[1]) > 12


def test_a_document_of_several_texts_is_near_to_what_any_of_them_is_near_to(spark):
    rng = random.Random(4)
    a, b, c = (vocabulary(rng, 40) for _ in range(3))
    other = [*b[:20], "x", *b[21:]]
    rows = [(5, a), (5, b), (2, other), (7, a), (9, c), (8, c), (5, c), (11, vocabulary(rng, 40))]
    table = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id bigint, text string")
    for parts in (1, 3):
        assert sorted(tuple(r) for r in neardup.near_duplicates(table.repartition(parts)).collect()) == [(5, 2), (7, 2), (8, 2), (9, 2)]


def test_components(spark):
    chain = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (102, 101), (200, 200)]
    out = dict(tuple(r) for r in neardup.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect())
    assert {out[k] for k in range(41)} == {0} and out[101] == out[102] == 100 and out[200] == 200
    assert neardup.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
