from __future__ import annotations

import random

import pytest

from roadledger.llm import base, substrings


def brute(docs, least):
    """(doc, start, end, n, first document) of every merged stretch of windows found in two documents."""
    words = {d: t.split() for d, t in docs}
    where = {}
    for d, w in words.items():
        for p in range(len(w) - least + 1):
            where.setdefault(tuple(w[p : p + least]), set()).add(d)
    out = []
    for d, w in words.items():
        starts = [p for p in range(len(w) - least + 1) if len(where[tuple(w[p : p + least])]) > 1]
        stretch = []
        for p in starts:
            first = min(where[tuple(w[p : p + least])])
            if stretch and p < stretch[-1][1]:
                stretch[-1][1], stretch[-1][2] = p + least, min(stretch[-1][2], first)
            else:
                stretch.append([p, p + least, first])
        out += [(d, a, b, b - a, f) for a, b, f in stretch]
    return sorted(out)


@pytest.mark.parametrize("group_rows", [10_000, 3, 0])
def test_against_brute_force(spark, group_rows):
    rng = random.Random(group_rows)
    passages = [[rng.choice("abcdefgh") for _ in range(rng.randrange(5, 25))] for _ in range(12)]
    docs = []
    for d in range(120):
        words = []
        while len(words) < 40:
            words += rng.choice(passages) if rng.random() < 0.3 else [rng.choice("abcdefghijklmnopq") for _ in range(rng.randrange(9))]
        docs.append((d, " ".join(words[: rng.randrange(3, 60)])))
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    got = sorted(tuple(r) for r in substrings.repeats(table, least=7, gram=3, group_rows=group_rows).collect())
    assert got == brute(docs, 7) and len(got) > 50


def test_names_tell_equal_runs():
    import numpy as np

    rng = np.random.default_rng(1)
    codes = rng.integers(0, 3, 400)
    name, span = substrings.names(codes, 7)
    assert span == 4
    for a in range(0, 380, 7):
        for b in range(380):
            assert (name[a] == name[b]) == (list(codes[a : a + 4]) == list(codes[b : b + 4]))


def test_equal_passages_share_an_anchor():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(3)
    common = [str(rng.random()) for _ in range(50)]
    texts = [" ".join([*(str(rng.random()) for _ in range(rng.randrange(90))), *common, *(str(rng.random()) for _ in range(rng.randrange(90)))]) for _ in range(40)]
    offsets, codes, words = base.split_words(pa.array(texts))
    row, prefix, at, lo, hi = substrings.anchors(base.hash_strings(words)[codes], offsets, 50, 8)
    own = [set(prefix[row == k]) for k in range(40)]
    assert set.intersection(*own)
    for k in range(40):  # every start has exactly one anchor
        spans = [s for a, b in zip(lo[row == k], hi[row == k]) for s in range(a, b + 1)]
        assert spans == list(range(int(np.diff(offsets)[k]) - 49))


def test_repeats_inside_one_document_are_left_alone(spark):
    once = " ".join(f"w{k}" for k in range(60))
    table = spark.createDataFrame([(1, f"{once} and {once}"), (2, "other text"), (1, "other text of the same id")], "doc_id bigint, text string")
    assert substrings.repeats(table).count() == 0


def brute_inside(docs, least):
    """As brute, of windows found at two places."""
    where = {}
    words = {d: t.split() for d, t in docs}
    for d, w in words.items():
        for p in range(len(w) - least + 1):
            where.setdefault(tuple(w[p : p + least]), []).append(d)
    out = []
    for d, w in words.items():
        stretch = []
        for p in range(len(w) - least + 1):
            found = where[tuple(w[p : p + least])]
            if len(found) > 1 and stretch and p < stretch[-1][1]:
                stretch[-1][1], stretch[-1][2] = p + least, min(stretch[-1][2], *found)
            elif len(found) > 1:
                stretch.append([p, p + least, min(found)])
        out += [(d, a, b, b - a, f) for a, b, f in stretch]
    return sorted(out)


@pytest.mark.parametrize("group_rows", [10_000, 3, 0])
def test_repeats_inside_one_document_are_found_where_they_count(spark, group_rows):
    rng = random.Random(group_rows)
    docs = []
    for d in range(80):
        own = [f"{d}-{k}" for k in range(rng.randrange(3, 14))]
        words = [*own, *(rng.choice("abcdefghijkl") for _ in range(rng.randrange(20))), *own * rng.randrange(3)]
        docs.append((d, " ".join(words)))
    docs += [(100, "so it goes " * 9), (101, " ".join(f"w{k}" for k in range(30)))]
    rows = [*docs, docs[1]]  # a row twice is one document
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = sorted(tuple(r) for r in substrings.repeats(table, least=7, gram=3, group_rows=group_rows, inside=True).collect())
    assert got == brute_inside(docs, 7) and (100, 0, 27, 27, 100) in got
    assert len({r[0] for r in got}) > len({r[0] for r in brute(docs, 7)}) + 10


def brute_maximal(docs, least):
    """Maximal repeats, by comparing every two counted places of the same first words."""
    words = {d: t.split() for d, t in docs}
    where = {}
    for d, w in sorted(words.items()):
        for p in range(len(w) - least + 1):
            own = where.setdefault(tuple(w[p : p + least]), [])
            if not own or own[-1][0] != d or p - own[-1][1] >= least:
                own.append((d, p))
    total = {}
    for d, w in words.items():
        for p in range(len(w) - least + 1):
            total[tuple(w[p : p + least])] = total.get(tuple(w[p : p + least]), 0) + 1
    out = set()
    for key, places in where.items():
        if total[key] < 2:
            continue

        def end(d, p):  # of the windows in a row that occur twice
            while p + least <= len(words[d]) and total[tuple(words[d][p : p + least])] > 1:
                p += 1
            return p + least - 1

        rests = [tuple(words[d][p : end(d, p)]) for d, p in places]
        depths = set()
        for a in range(len(places)):
            for b in range(a):
                n = 0
                while n < min(len(rests[a]), len(rests[b])) and rests[a][n] == rests[b][n]:
                    n += 1
                depths.add(rests[a][:n])
        for passage in depths:
            own = [pl for pl, r in zip(places, rests) if r[: len(passage)] == passage]
            left = {words[d][p - 1] if p else (d, p) for d, p in own}
            if len(left) > 1 or any(p == 0 for _, p in own):
                out.add((*min(own), len(passage), len(own), max(own)[0]))
    return sorted(out)


@pytest.mark.parametrize("group_rows", [10_000, 3, 0])
def test_maximal_repeats(spark, group_rows):
    rng = random.Random(group_rows + 1)
    passages = [[rng.choice("abcdefgh") for _ in range(rng.randrange(5, 25))] for _ in range(10)]
    docs = []
    for d in range(70):
        words = []
        while len(words) < 40:
            words += rng.choice(passages) if rng.random() < 0.4 else [rng.choice("abcdefghijklmnopq") for _ in range(rng.randrange(9))]
        docs.append((d, " ".join(words[: rng.randrange(3, 60)])))
    docs += [(100, "so it goes " * 20), (101, docs[0][1]), (102, docs[0][1]), (103, "x " * 45), (104, f"y {docs[3][1]}")]
    table = spark.createDataFrame([*docs, docs[5]], "doc_id bigint, text string").repartition(5)
    got = sorted(tuple(r) for r in substrings.maximal_repeats(table, least=7, gram=3, group_rows=group_rows).collect())
    assert got == brute_maximal(docs, 7) and len(got) > 40 and max(r[2] for r in got) > 20


def test_a_tree_has_a_node_for_each_branching():
    leaves = sorted([[1, 2, 3], [1, 2, 3, 4], [1, 2, 5], [2], [2, 7], [2, 7, 7]])
    assert sorted(substrings.tree(leaves)) == [(1, 3, 5), (2, 0, 2), (2, 4, 5), (3, 0, 1)]
    assert list(substrings.tree([])) == [] == list(substrings.tree([[1, 2]]))
