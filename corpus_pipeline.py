"""Training-corpus pipeline: quality rules, quality classifier, near-duplicates, shared passages, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; all but the last return the
columns of documents.  ``run`` writes each stage's result to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hourglass.llm import near_dedup, packing, quality_model, quality_rules, substring_dedup
from hourglass.llm.catalog import WORD_BPE, vocabulary
from hourglass.llm.common import shared_path, table


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules keep, without their failing lines."""
    return quality_rules.clean_documents(docs)


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the cut; the forest learns from the raw table's labelled documents."""
    forest = quality_model.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_model.keep_good(docs, forest)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 or more on five-word shingles."""
    return near_dedup.keep_one(docs, words=5, per_cent=80)


def passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has."""
    return substring_dedup.dedup_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in the packed sequences."""
    return packing.pack_documents(spark, docs, vocabulary(WORD_BPE))


STAGES = [
    ("quality_rules", rules_stage),
    ("quality_classifier", classifier_stage),
    ("near_duplicates", near_duplicates_stage),
    ("substring_dedup", passages_stage),
    ("packing", packing_stage),
]

#: A trained classifier, a component search and a tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
