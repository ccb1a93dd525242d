"""The corpus pipeline: five stages over ``documents``, each on all that the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tallyfield.llm import bpe, decontaminate, language_id, near_dedup, secrets
from tallyfield.llm.common import shared_folder, table

MIN_LANGUAGE_SCORE = 0.5


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a score of MIN_LANGUAGE_SCORE or more; those without a letter go.

    Edge cases as ``language_id.keep`` states them: null and empty texts go, null ids, repeated rows and further columns
    stay, long texts are judged whole, no row gives none.
    """
    return language_id.keep(docs, MIN_LANGUAGE_SCORE)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least doc_id.

    Edge cases as ``near_dedup.keep_one`` states them: rows with a null doc_id, null and empty texts stay, of equal rows one
    stays, long texts are compared whole, further columns stay, no row gives none.
    """
    return near_dedup.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item of ``benchmark``.

    Edge cases as ``decontaminate.without_leaks`` states them: every row is judged by its own text, null and empty texts stay,
    long ones are searched whole, repeated test items are one, no row gives none.
    """
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked and ``n_chars`` to fit.

    Edge cases as ``secrets.redact`` states them: null and empty texts stay, long ones are scanned whole, no row gives none.
    """
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and hashes of every document's tokens and of its decoded text; no document goes.

    Edge cases as ``bpe.encode_decode`` states them: a null text is the empty one and has no tokens, a null doc_id stays
    null, repeated rows give a row each, of long texts a bounded number of ids is held, no row gives none.
    """
    return bpe.encode_decode(docs)


STAGES = [
    ("language_id", keep_languages),
    ("near_dedup", keep_one_of_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", mask_secrets),
    ("bpe", encode),
]
#: Language posteriors, alignments and BPE can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table, each written as Parquet and read again for the next."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = f"{folder}/{k}-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
