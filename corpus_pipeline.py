"""A training corpus from raw documents, in stages that each read what the one before wrote.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame: the columns of ``documents``, but for the last stage,
which returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.llm import common, mixing, ngram_join, packing, quality_classifier, suffix_dedup


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality_classifier.accepted(docs, common.table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.deduplicated(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that occur earlier."""
    return suffix_dedup.trimmed(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, a row for each pass over a document."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.packed(docs)


STAGES = [
    ("quality_classifier", good_documents),
    ("ngram_join", without_near_duplicates),
    ("suffix_dedup", without_repeats),
    ("mixing", mixed),
    ("packing", packed),
]

#: Trained models, byte cuts and a tokenizer: not for SQL. tests/llm checks the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's own tables go when its result is written, and that when the next one's is."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, common.settled(lambda: stage(spark, docs, sf_dir), f"pipeline-{name}")  # noqa: B023  (called at once)
        if k:
            common.discard(before)
    return docs
