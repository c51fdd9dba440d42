"""A corpus pipeline over documents: five stages, each one operator of roadledger.llm.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Between
stages the table is written to the shared folder and read again, so a lost executor costs the
work of one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roadledger.llm import base, decontaminate, langid, neardup, pieces, pii


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents in no known language; weights come from the documents' own `lang`.

    Null, empty and letterless texts go, so an empty table, or one without `lang`, gives an empty one;
    repeated rows are judged alike.
    """
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates.

    Rows with a null doc_id stay, as do null and wordless texts; repeated rows of the document that
    stays all stay.
    """
    return neardup.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a passage of `benchmark`; null doc_ids and texts stay."""
    return decontaminate.decontaminate(docs, base.table(spark, sf_dir, "benchmark"))


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in `text` replaced by its type; null and empty texts are as before, n_chars follows the text."""
    return pii.redact(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With `ids` and `n_tokens` of the text, and `exact`: whether decoding the ids gave the text back."""
    return pieces.encode(docs, check=True)


STAGES = [
    ("language ID", language_id),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("PII", pii_redaction),
    ("SentencePiece", sentencepiece),
]

#: SQL can't express the learned models, the sketches or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = base.stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
