"""The pipeline's stages and its whole against plain Python over the same documents."""

from __future__ import annotations

import re

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from roadledger.llm import base, langid, neardup, pieces, pii

from .test_langid import plain

SF = "/root/testdata/sf0.001"


def words(text):
    return base.normalise(pa.array([text]))[0].as_py().split()


def by_language(docs, model):
    kept = []
    for d in docs:
        _, codes, distinct = base.split_words(pa.array([d["text"]]))
        letters, has = langid.letters(distinct)
        slots, word = base.grams(letters, langid.ORDERS, langid.BITS)
        emit = langid.Model.potentials(model.scores(slots, word, model.entry(letters), has))[codes]
        own = plain(emit, model.trans)[has[codes]] if len(codes) else np.empty((0, 1))
        if len(own) and own.sum(0).max() / len(own) >= langid.LEAST:
            kept.append(d)
    return kept


def deduplicated(docs):
    own = [words(d["text"]) for d in docs]
    group = list(range(len(docs)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            most = neardup.allowed(max(len(own[i]), len(own[j])), neardup.SIMILARITY)
            if own[i] and own[j] and neardup.within(own[i], own[j], most):
                group[max(find(i), find(j))] = min(find(i), find(j))
    return [d for k, d in enumerate(docs) if find(k) == k]


def clean(docs, items):
    strings = set()
    for item in items:
        w = words(item)
        strings |= {f" {' '.join(w[k : k + 13])} " for k in range(max(1, len(w) - 12))}
    kept = []
    for d in docs:
        own = f" {' '.join(words(d['text']))} "
        if not any(s in own for s in strings):
            kept.append(d)
    return kept


def redacted(docs, model):
    out = []
    for d in docs:
        spans = pii.entities(model, pa.array([d["text"]])).get(0, [])
        text = d["text"]
        for a, b, kind in reversed(spans):
            text = f"{text[:a]}[{kind}]{text[b:]}"
        out.append({**d, "text": text, "n_chars": len(text) if spans else d["n_chars"]})
    return out


@pytest.fixture(scope="module")
def steps(spark, pii_model):
    """The documents after each stage, by brute force."""
    table = base.table(spark, SF, "documents")
    docs = sorted((r.asDict() for r in table.collect()), key=lambda d: d["doc_id"])
    items = [r["text"] for r in base.table(spark, SF, "benchmark").collect()]
    after = [by_language(docs, langid.train(langid.sample(table)))]
    after.append(deduplicated(after[-1]))
    after.append(clean(after[-1], items))
    after.append(redacted(after[-1], pii_model))
    sp = pieces.load(pieces.MODEL).sp
    after.append([{**d, "ids": sp.encode(d["text"]), "n_tokens": len(sp.encode(d["text"])), "exact": sp.decode(sp.encode(d["text"])) == d["text"]} for d in after[-1]])
    return after


def test_stages_against_brute_force(spark, steps):
    docs = base.table(spark, SF, "documents")
    for (name, stage), want in zip(corpus_pipeline.STAGES, steps):
        docs = base.stash(stage(spark, docs, SF), "stage")
        got = sorted((r.asDict() for r in docs.collect()), key=lambda d: d["doc_id"])
        assert got == want, name
    assert 0 < len(steps[1]) < len(steps[0]) and len(steps[2]) < len(steps[1])


def test_run(spark, steps):
    got = sorted((r.asDict() for r in corpus_pipeline.run(spark, SF).collect()), key=lambda d: d["doc_id"])
    assert got == steps[-1]
    assert not any(re.search(r"@mail\d", d["text"]) for d in got)
