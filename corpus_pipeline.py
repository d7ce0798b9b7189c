"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Language ID drops what it rejects, exact dedup and the n-gram join keep one document of each group, decontamination
drops documents that hold benchmark passages, and packing deals what is left into sequences. Every stage works on all
that its predecessor kept. Nulls, empty texts, ties and empty tables are handled as the operators' modules define.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from furrow.llm.decontamination import drop_contaminated
from furrow.llm.exact_dedup import drop_copies
from furrow.llm.language_id import keep_languages, train_language_model
from furrow.llm.ngram_join import keep_one_of_each
from furrow.llm.packing import pack_documents
from furrow.llm.shared import table
from furrow.storage import materialise

#: Near duplicates share at least 0.8 of their shingles of five words.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose language is determined with a posterior of one half or more stay."""
    return keep_languages(docs, train_language_model(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates the smallest doc_id stays."""
    return keep_one_of_each(docs, n=SHINGLE_WORDS, num=SIMILAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage stay."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its sequence and place."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("ngram_join", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The classifier's decisions and the packing's greedy order are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
