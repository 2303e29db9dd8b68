"""From raw documents to token counts, in stages that each write Parquet for the next one.

toxicity, line dedup, near-duplicates, benchmark decontamination, tokenisation. SQL can't express
the learnt and similarity stages, so ORACLE_SQL is None; tests/llm checks run() against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from crosswin.llm import stages
from crosswin.llm.tables import Scratch

ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.without_toxic(docs, stages.table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.with_deduped_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.without_leaks(docs, stages.table(spark, sf_dir, "benchmark"))


def tokenisation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.tokenised(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", toxicity), ("line_dedup", line_dedup), ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination), ("sentencepiece", tokenisation),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's table is deleted once the next is written."""
    scratch = Scratch(spark, "pipeline")
    docs, before = stages.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
