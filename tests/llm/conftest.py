from __future__ import annotations

import pytest

from roadledger.llm import langid, pii, quality

#: Texts that operators must bear: null, empty, blank, marks, one word, ties, odd characters, no spaces, long.
LONG = " ".join(f"word{k % 97} the of and" for k in range(9000))
AWKWARD = [None, "", "   ", "\n\t ", "!!! --- ???", "x", "x", "the end", "the end", "é́ ß ﬁ     日本語 😀", "\x00a\x7f", "y" * 50_000, LONG, LONG, "<s> ▁ ▁▁ </s>", "1 2 3 4.5 @ a@b", "7" * 300]


@pytest.fixture(scope="session")
def awkward(spark):
    """Awkward texts, repeated rows, a null doc_id, and columns named like the operators' own."""
    rows = [(k, t, ["en", None, "fr"][k % 3], "s", len(t) if t is not None else None, "1", 2, [3], 4.0, "p") for k, t in enumerate(AWKWARD)]
    rows += [rows[7], (None, "the end of a text without id", "en", None, 1, "1", 2, [3], 4.0, "p"), (None, None, None, None, None, None, None, None, None, None)]
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept_id string, prefix int, ids array<int>, score double, `__bad_id` string"
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="session")
def lang_model():
    rows = [("en", "the cat and the dog of this house were with them for the night\n" * 3), ("de", "der hund und die katze von diesem haus waren nicht mit ihnen auf der straße\n" * 3), ("fr", "le chat et le chien de cette maison étaient avec eux pour une nuit\n" * 3)]
    return langid.train(rows)


@pytest.fixture(scope="session")
def pii_model():
    return pii.train()


@pytest.fixture(scope="session")
def quality_model():
    model = quality.Model()
    texts = [t for k in range(40) for t in (f"a good and clean text number {k} about gardens", f"buy!! now$$$ %%% cheap{k}", f"you stupid idiot number {k} go away")]
    import numpy as np

    model.learn(texts, np.array([(1, 0), (0, 0), (1, 1)] * 40, float), passes=20)
    return model
