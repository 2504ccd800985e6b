"""The registered query of every training-data operator, over its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hourglass.llm import (bpe, chat, hard_negatives, lexical_search, near_dedup, packing, quality_model, quality_rules, secret_scan,
                           substring_dedup, suffix_dedup, token_files, vector_search)
from hourglass.llm.common import table

BYTE_BPE, WORD_BPE, BYTE_RANKS = "byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_50k.tiktoken"


def vocabulary(name: str) -> str:
    """The place of an installed public vocabulary file (the same on every machine)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.line_quality(table(spark, sf_dir, "documents")).drop("cleaned")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary(BYTE_BPE)
    return bpe.digests(bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.components(table(spark, sf_dir, "documents"), words=2, per_cent=80)


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.score_documents(docs, quality_model.train(docs, table(spark, sf_dir, "labels")))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(spark, table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, table(spark, sf_dir, "documents"), vocabulary(WORD_BPE))


def op8_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.search(table(spark, sf_dir, "embeddings"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.dedup(table(spark, sf_dir, "documents")))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.with_hostile(table(spark, sf_dir, "conversations"))
    return chat.formatted_digests(spark, rows, vocabulary(BYTE_BPE))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(hard_negatives.mislabelled(hard_negatives.scaled(table(spark, sf_dir, "embeddings"))))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"), vocabulary(BYTE_RANKS))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_quality_rules, op3_bpe, op4_near_dedup, op5_quality_model, op6_token_files,
                                   op7_packing, op8_vector_search, op9_suffix_dedup, op10_chat, op11_lexical_search, op12_hard_negatives,
                                   op13_secret_scan)}
ORACLE = {"op2_quality_rules": quality_rules.ORACLE_SQL, "op10_chat": chat.ORACLE_SQL, "op11_lexical_search": lexical_search.ORACLE_SQL,
          "op12_hard_negatives": hard_negatives.ORACLE_SQL}
