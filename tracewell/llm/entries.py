"""The registered corpus queries, with production parameters over whole tables, and their DuckDB equivalents."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import divergence, embedding_links, fingerprints, langid, licenses, minhash, packing, pages, piece_bpe, quality, secrets, toxicity, whitening
from tracewell.llm.common import table

NEAR_DUPLICATE, LINKED = 0.85, 0.93


def vocabulary(name: str) -> str:
    """A public vocabulary file; TRACEWELL_TOKENIZERS names another folder than the installed package's."""
    folder = os.environ.get("TRACEWELL_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.digests(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), toxicity.held_out_rows()
    return toxicity.predict(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held), held)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op6_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links.linked(table(spark, sf_dir, "embeddings"), LINKED)


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), NEAR_DUPLICATE)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op9_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages")
    return pages.extracted(rows, pages.fit(rows))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), langid.held_out_rows()
    return langid.predict(docs, langid.fit(docs, ~held), held)


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(table(spark, sf_dir, "embeddings"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_secrets, op2_sentencepiece, op3_toxicity, op4_quality, op5_packing, op6_embedding_links, op7_minhash, op8_licenses, op9_pages, op10_langid, op11_fingerprints, op12_whitening, op13_divergence)}

ORACLE_SQL = {"op1_secrets": secrets.oracle_sql(), "op4_quality": quality.oracle_sql(), "op11_fingerprints": fingerprints.oracle_sql(), "op13_divergence": divergence.oracle_sql()}
