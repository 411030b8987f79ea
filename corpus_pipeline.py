"""Corpus pipeline: language ID, toxicity, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next one's docs. All
but the last return the columns of documents.

Defined cases: null and empty texts have no letter and leave in the first stage, as do texts that tell no
language from another (such as one in a script that no labelled document is in). lang becomes the language found, also where it was null
or another; without any lang to learn from it stays null, and every text with a letter stays. Null values of source and
n_chars pass through. Rows without an id are documents like others; near-duplicates of one id, or without one, count as one
document's rows and stay together. Repeated rows are near-duplicates of each other: the smallest id of a group stays, with
all rows of that id. Extra columns pass through the first four stages, whatever their names. Texts of any length are read
whole. An empty table gives no rows, and no labels make no document toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import langid, minhash, packing, secrets, toxicity
from tracewell.llm.common import persisted, table
from tracewell.llm.entries import vocabulary

SIMILARITY = 0.8


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets lang to the language of the text; drops documents without a letter and those that no language is likelier for."""
    model = langid.fit(docs).without_prior()
    # a text that tells nothing has an equal share of each language; any more is enough
    return langid.identified(docs, model, (1 + 1e-6) / len(model.langs) if len(model.langs) > 1 else 0.0)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic."""
    return toxicity.accepted(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near-duplicates."""
    return minhash.deduplicated(docs, SIMILARITY)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the text by a mask."""
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences along the curve."""
    return packing.packed(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: Learned models, near-duplicates and tokenizers are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = persisted(docs, name)
    return docs
