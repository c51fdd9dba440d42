from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from roadledger.llm import base, decontaminate


def brute(docs, items, n):
    norm = lambda t: f" {base.normalise(pa.array([t]))[0].as_py().strip()} "
    strings = {i: [s.decode() for s in decontaminate.windows(norm(item), n)] for i, item in items}
    out = []
    for d, text in docs:
        own = norm(text)
        for i, _ in items:
            found = sum(s in own for s in strings[i])
            if found:
                out.append((d, i, found))
    return sorted(out)


@pytest.mark.parametrize("pass_bytes", [1 << 20, 60])
def test_against_brute_force(spark, pass_bytes):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abéC1") for _ in range(rng.randrange(1, 5)))
    items = [(i, "; ".join(word() for _ in range(rng.choice((1, 2, 4, 9, 20))))) for i in range(40)]
    docs = []
    for d in range(150):
        words = [word() for _ in range(rng.randrange(40))]
        if rng.random() < 0.5:
            own = rng.choice(items)[1].upper().split("; ")
            a = rng.randrange(len(own))
            at = rng.randrange(len(words) + 1)
            words[at:at] = own[a : a + rng.randrange(1, 21)]
        docs.append((d, rng.choice((" ", "\n", "%% ", ", ")).join(words)))
    table, bench = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted(tuple(r) for r in decontaminate.contaminated(table, bench, 6, pass_bytes).collect())
    assert got == brute(docs, items, 6) and len(got) > 100


@pytest.mark.parametrize("sizes", [(1, 3), (4, 9), (8, 8), (20, 60)])
def test_search_finds_every_occurrence(sizes):
    rng = random.Random(sizes[0])
    for _ in range(30):
        text = "".join(rng.choice("ab") for _ in range(rng.randrange(0, 6000)))
        strings = sorted({text[a : a + rng.randint(*sizes)].encode() for a in (rng.randrange(len(text) + 1) for _ in range(6))} | {b"ba" * sizes[1]})
        strings = [s for s in strings if len(s) >= sizes[0]]
        want = {(k, a) for k, s in enumerate(strings) for a in range(len(text)) if text.encode().startswith(s, a)}
        got = list(decontaminate.WuManber(strings).search(np.frombuffer(text.encode(), np.uint8)))
        assert len(got) == len(set(got)) and set(got) == want


def test_shifts_skip():
    finder = decontaminate.WuManber([b"the quick brown fox jumps over the lazy dog"])
    assert finder.shift.max() == finder.m - 7 == 36 and finder.shift.min() == 0


@pytest.mark.parametrize("pass_bytes", [1 << 20, 60])
def test_repeated_ids_match_the_sql(spark, pass_bytes):
    """Items and documents of several texts: windows are counted once, in however many passes and rows they are found."""
    import duckdb

    rng = random.Random(8)
    passage = [f"w{rng.randrange(50)}" for _ in range(60)]
    items = [(k % 4, " ".join(passage[a : a + 25])) for k, a in enumerate((0, 4, 30, 35, 8, 8, 20, 0))] + [(9, "w1 w2"), (9, "w3"), (None, "w1"), (5, None)]
    docs = [(k % 7, " ".join(passage[a : a + rng.randrange(2, 40)])) for k in range(30) for a in (rng.randrange(50),)] + [(None, "w1 w2"), (3, None)]
    table, bench = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string")
    con = duckdb.connect()
    for name, column, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        con.execute(f"CREATE TABLE {name} ({column} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    want = sorted(con.execute(decontaminate.ORACLE["op10_decontaminate"]).fetchall())
    got = sorted((r["doc_id"], r["item_id"], r["n_windows"]) for r in decontaminate.contaminated(table, bench, pass_bytes=pass_bytes).collect())
    assert got == want and len(got) > 15 and any(n > 13 for _, _, n in got)
