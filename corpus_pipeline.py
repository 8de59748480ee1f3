"""A training-data pipeline over documents: STAGES in order, each stored as Parquet and read again as the next one's input.

Every stage works on all rows that its predecessor kept. All but the last return the columns of documents; the last returns
the pieces of the packed sequences. No stage fails on null texts, languages or doc_ids: a null text has no language and goes
in the first stage, a null doc_id is never a copy's keeper if another row has one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import common
from lodestar.llm.exact_dedup import exact_dedup
from lodestar.llm.language_id import drop_rejected
from lodestar.llm.near_dedup import near_dedup
from lodestar.llm.packing import pack
from lodestar.llm.secret_scan import redact_secrets


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go: those without a letter, and those that no learned language fits well enough."""
    return drop_rejected(docs)


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the row with the smallest doc_id stays."""
    return exact_dedup(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, the document with the smallest doc_id stays."""
    return near_dedup(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced within the texts; no document goes, and a text without secrets stays as it is."""
    return redact_secrets(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document, with its sequence and its place there."""
    return pack(docs)


STAGES = [
    ("language ID", known_language),
    ("exact dedup", without_exact_copies),
    ("near dedup", without_near_copies),
    ("secret scans", without_secrets),
    ("packing", packed),
]

#: SQL can express neither a trained language model nor a tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents of sf_dir."""
    docs = common.documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stored(docs, f"stage{k}")
    return docs
