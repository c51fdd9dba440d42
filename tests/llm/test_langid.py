from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa

from roadledger.llm import base, langid


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    trans = rng.random((3, 3)) + 0.1
    trans /= trans.sum(1, keepdims=True)
    lengths = [4, 1, 6, 0, 3]
    emit = rng.random((sum(lengths), 3)) + 0.05
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    counts = np.zeros((3, 3))
    got = langid.forward_backward(emit, offsets, trans, counts)
    want, pairs = np.zeros_like(emit), np.zeros((3, 3))
    for a, b in zip(offsets, offsets[1:]):
        total, mass, both = 0, np.zeros((b - a, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(b - a)):
            p = trans.mean(0)[path[0]] * emit[a, path[0]] if b > a else 1
            for t in range(1, b - a):
                p *= trans[path[t - 1], path[t]] * emit[a + t, path[t]]
            total += p
            for t, y in enumerate(path):
                mass[t, y] += p
                if t:
                    both[path[t - 1], y] += p
        if b > a:
            want[a:b] = mass / total
            pairs += both / total
    assert np.allclose(got, want) and np.allclose(counts, pairs)


def plain(emit, trans):
    """Step by step over one sequence."""
    x, ahead = np.full(len(trans), 1 / len(trans)), []
    for e in emit:
        x = (x @ trans) * e
        x /= x.sum()
        ahead.append(x)
    behind, out = np.ones(len(trans)), []
    for e, f in zip(emit[::-1], ahead[::-1]):
        p = f * behind
        out.append(p / p.sum())
        behind = trans @ (e * behind)
        behind /= behind.sum()
    return np.array(out[::-1])


def test_blocks_join_exactly():
    rng = np.random.default_rng(1)
    trans = np.full((4, 4), 0.02) + np.eye(4) * 0.92
    lengths = [1, 63, 64, 65, 128, 1000, 2, 777]
    emit = np.exp(-rng.random((sum(lengths), 4)) * 20)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    got = langid.forward_backward(emit, offsets, trans)
    for a, b in zip(offsets, offsets[1:]):
        assert np.allclose(got[a:b], plain(emit[a:b], trans), atol=1e-9)


def test_held_out_accuracy_and_switches(spark):
    docs = base.table(spark, "/root/testdata/sf0.01", "documents")
    model = langid.train(langid.sample(docs.where("doc_id % 2 = 0"), 40))
    held = docs.where("doc_id % 2 = 1").select("lang", "text").collect()
    d = langid.decide(model, pa.array([r["text"] for r in held]), langid.LEAST)
    right = np.mean([model.languages[k] == r["lang"] for k, r in zip(d["lang"], held)])
    assert right > 0.97 and d["kept"].mean() > 0.99
    one = {r["lang"]: " ".join(r["text"].split()[:40]) for r in held if len(r["text"].split()) > 60}
    text = " ".join(one[x] for x in ("en", "fr", "es", "de"))
    offsets, marginals, _ = langid.label(model, pa.array([text]))
    want = np.repeat([model.languages.index(x) for x in ("en", "fr", "es", "de")], 40)
    assert (marginals.argmax(1) == want).mean() > 0.9


#: Text in none of the documents' languages.
FOREIGN = {
    "nl": "De kat zat op de mat en keek naar buiten terwijl het regende. Wij gaan morgen met de trein naar Amsterdam omdat het weer daar veel beter is dan hier.",
    "it": "Il gatto era seduto sul tappeto e guardava fuori mentre pioveva. Domani andremo in treno a Roma perché il tempo è molto migliore di quello che abbiamo qui.",
    "pt": "O gato estava sentado no tapete e olhava para fora enquanto chovia. Amanhã vamos de trem para Lisboa porque o tempo lá é muito melhor do que aqui.",
    "pl": "Kot siedział na macie i patrzył na zewnątrz, kiedy padał deszcz. Jutro pojedziemy pociągiem do Krakowa, ponieważ pogoda jest tam znacznie lepsza.",
    "fi": "Kissa istui matolla ja katsoi ulos sateen aikana. Huomenna menemme junalla Helsinkiin, koska sää on siellä paljon parempi kuin täällä.",
    "ru": "Кот сидел на коврике и смотрел на улицу, пока шёл дождь. Завтра мы поедем на поезде в Москву, потому что погода там лучше.",
}


def test_foreign_text_and_gibberish_are_rejected_and_clean_text_is_kept(spark):
    docs = base.table(spark, "/root/testdata/sf0.01", "documents")
    model = langid.train(langid.sample(docs.where("doc_id % 2 = 0"), 40))
    rng = np.random.default_rng(3)
    drawn = lambda alphabet, least, most, count: " ".join("".join(rng.choice(list(alphabet), rng.integers(least, most))) for _ in range(count))
    small = "abcdefghijklmnopqrstuvwxyz"
    texts = [*FOREIGN.values(), *(drawn(small, 2, 11, 30) for _ in range(20)), *(drawn(small + small.upper() + "0123456789+/", 76, 77, 6) for _ in range(20))]
    held = [r["text"] for r in docs.where("doc_id % 2 = 1").collect() if len(r["text"].split()) > 30]
    texts += [" ".join("".join(rng.permutation(list(w))) for w in t.split()[:200]) for t in held[:20]]  # shuffled letters
    assert not langid.decide(model, pa.array(texts), langid.LEAST)["kept"].any()
    assert langid.decide(model, pa.array(held), langid.LEAST)["kept"].mean() > 0.99
    short = [" ".join(t.split()[:5]) for t in held]
    assert langid.decide(model, pa.array(short), langid.LEAST)["kept"].mean() > 0.98


def test_one_language_alone_can_reject():
    model = langid.train([("en", "the cat and the dog of this house were with them for the night\n" * 3)])
    d = langid.decide(model, pa.array(["the dog of the house", "qzx jvk wpf", FOREIGN["ru"]]), langid.LEAST)
    assert list(d["kept"]) == [True, False, False] and list(d["confidence"].round(6)) == [1, 1, 1]


def test_the_query_against_plain_forward_backward(spark):
    """Spans, confidence, fit and decision of every document, from messages passed one word at a time."""
    docs = base.table(spark, "/root/testdata/sf0.001", "documents")
    model = langid.train(langid.sample(docs))
    rows = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    for d in docs.collect():
        words = d["text"].split()[:3000]
        if len(d["text"].split()) > 3000 or not words:
            continue
        _, codes, distinct = base.split_words(pa.array([d["text"]]))
        letters, has = langid.letters(distinct)
        slots, word = base.grams(letters, langid.ORDERS, langid.BITS)
        emit = langid.Model.potentials(model.scores(slots, word, model.entry(letters), has))[codes]
        own = plain(emit, model.trans)
        spans, names = [], [model.languages[k] for k in own.argmax(1)]
        for k, name in enumerate(names):
            if spans and spans[-1][2] == name:
                spans[-1][1] = k + 1
            else:
                spans.append([k, k + 1, name])
        spelled = has[codes]
        sums = own[spelled].sum(0)
        seen = {}
        for w, name, use in zip(codes, names, spelled):
            if use:
                k = model.languages.index(name)
                s, at = base.grams(letters.take(pa.array([w])), langid.FIT_ORDERS, langid.FIT_BITS)
                seen.setdefault((w, k), model.seen[s, k].mean() if len(s) else 0.0)
        fit = np.mean([seen[w, model.languages.index(name)] for w, name, use in zip(codes, names, spelled) if use]) if spelled.any() else 0.0
        row = rows[d["doc_id"]]
        assert [list(s) for s in row["spans"]] == spans and row["n_words"] == len(words)
        assert abs(row["confidence"] - (sums.max() / spelled.sum() if spelled.any() else 0)) < 1e-6
        assert row["kept"] == bool(spelled.any() and sums.max() / spelled.sum() >= langid.LEAST and fit >= langid.FIT)
