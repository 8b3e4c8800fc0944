"""A training corpus from raw documents: each stage reads what the one before it kept.

Rows keep all columns of `documents`, whatever others there are, up to the last stage. A null text counts as empty: it is
kept by every stage but exact dedup, where all empty texts are one group, and is packed as the end id alone. Ties of equal
texts go to the smallest id. Rows without an id are never dropped as copies or leaks, only as toxic. Rows that share an id
stand or fall together. An empty table gives an empty result; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docspark.llm import decontaminate, exact_dedup, near_dedup, packing, toxicity
from docspark.llm.staging import stage, table


def clean_speech(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact_copies(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 on shingles of five words."""
    return near_dedup.drop_near_copies(docs)


def no_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the kept documents, placed in sequences of 4096 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", clean_speech),
    ("exact dedup", no_copies),
    ("near dedup", no_near_copies),
    ("decontamination", no_leaks),
    ("packing", packed),
]

ORACLE_SQL = None  # toxicity is learned and packing is not unique


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs
