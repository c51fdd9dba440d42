from __future__ import annotations

import numpy as np
import pyarrow as pa

from roadledger.llm import base, quality


def test_held_out_accuracy(spark):
    docs = base.table(spark, "/root/testdata/sf0.1", "documents")
    labels = base.table(spark, "/root/testdata/sf0.1", "labels")
    model = quality.train(docs, labels.where("doc_id % 4 > 0"), 2500)
    held = labels.where("doc_id % 4 = 0").join(docs, "doc_id").select("text", "quality", "toxic").collect()
    odds = np.concatenate([model.odds(pa.array([r["text"] for r in held[k : k + 200]])) for k in range(0, len(held), 200)])
    good, toxic = np.array([r["quality"] for r in held]), np.array([r["toxic"] for r in held])
    assert ((odds[:, 0] > 0) == good).mean() > 0.94
    assert ((odds[:, 1] > 0) == toxic).mean() > 0.94
    assert (odds[toxic == 0, 1] <= 0).mean() > 0.98 and (odds[toxic == 1, 1] > 0).mean() > 0.6


def test_the_product_is_the_average():
    """The multiplied-out table gives what averaging vectors and then a softmax gives."""
    model = quality.Model()
    vectors = []
    texts = ["good clean words here", "bad awful words there", "clean garden words", "awful bad mess"]
    real = quality.Model.learn
    keep = {}

    class Spy(quality.Model):
        def __setattr__(self, name, value):
            if name == "vectors" and value.shape[0] == 0:
                keep["vectors"] = self.vectors.copy()
            super().__setattr__(name, value)

    model = Spy()
    real(model, texts, np.array([(1, 0), (0, 1), (1, 0), (0, 1)], float), passes=30)
    for text in texts:
        (slot, weight), = quality.Model.bags([text])
        mean = weight @ keep["vectors"][slot]
        want = mean @ model.output + model.bias
        assert np.allclose(model.odds(pa.array([text]))[0], want, atol=1e-3)
    assert (model.odds(pa.array(texts))[:, 0] > 0).tolist() == [True, False, True, False]


def test_slopes_against_differences():
    rng = np.random.default_rng(2)
    model = quality.Model()
    model.output, model.bias = rng.normal(0, 1, model.output.shape), rng.normal(0, 1, 2)
    own, weight, label = rng.normal(0, 1, (5, quality.SIZE)), rng.random(5), np.array([1.0, 0.0])

    def likelihood():
        odds = weight @ own @ model.output + model.bias
        return float((label * odds - np.logaddexp(0, odds)).sum())

    for slope, array in zip(model.slopes(own, weight, label), (own, model.output, model.bias)):
        for at in [tuple(rng.integers(0, n) for n in array.shape) for _ in range(12)]:
            was = array[at]
            array[at] = was + 1e-5
            up = likelihood()
            array[at] = was - 1e-5
            down = likelihood()
            array[at] = was
            assert abs((up - down) / 2e-5 - slope[at]) < 1e-6


def test_the_query_against_one_text_at_a_time(spark):
    """Every row of the query is what the bags of its own text give."""
    sf = "/root/testdata/sf0.001"
    docs, labels = base.table(spark, sf, "documents"), base.table(spark, sf, "labels")
    model = quality.train(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = quality.op8_quality(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    for r in rows:
        (slot, weight), = quality.Model.bags([texts[r["doc_id"]] or ""])
        odds = (weight / quality.SCALE).astype(float) @ model.table[slot] + model.bias
        chance = 1 / (1 + np.exp(-odds))
        assert np.allclose([r["p_quality"], r["p_toxic"]], chance, atol=1e-3)
        assert r["kept"] == (r["p_quality"] >= 0.5 and r["p_toxic"] <= 0.5)
