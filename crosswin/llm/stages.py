"""Corpus stages: each takes documents, applies one operator, and returns the columns of documents."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from crosswin.llm import jaccard_join, line_dedup, piece_codec, pu_toxicity, template_leaks
from crosswin.llm.tables import Scratch, look_up


def marked_rows(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """docs with the marks of their doc_id; marks has one written row per doc_id and no other column of docs."""
    keyed = marks.withColumnRenamed("doc_id", "_marked_id")
    typed = docs.withColumn("_marked_id", F.col("doc_id").cast("bigint"))
    return look_up(typed, keyed, ["_marked_id"]).drop("_marked_id")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents not predicted toxic. A doc_id goes if any of its rows is toxic; null doc_ids stay."""
    scratch = Scratch(docs.sparkSession, "stage-toxic")
    bad = pu_toxicity.score_toxicity(docs, labels).where("predicted = 1 AND doc_id IS NOT NULL")
    bad = scratch.put(bad.select("doc_id", F.lit(True).alias("_toxic")).distinct(), "toxic")
    return marked_rows(docs, bad).where("_toxic IS NULL").select(*docs.columns)


def with_deduped_lines(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """Documents with the lines that repeat in ``min_docs`` documents taken out; every row stays.

    text and n_chars change; a document of which nothing is left has an empty text.
    """
    kept = line_dedup.keep_bitmaps(docs, min_docs=min_docs)
    rows = docs.withColumn("_doc", F.col("doc_id").cast("bigint")).withColumn("_hash", F.xxhash64("_doc", F.col("text").cast("string")))
    marks = kept.select(F.col("doc_id").alias("_doc"), F.col("row_hash").alias("_hash"), F.col("keep").alias("_keep"))
    rows = look_up(rows, marks, ["_doc", "_hash"])
    text = line_dedup.kept_text(F.col("text"), F.col("_keep"))
    new = F.when(F.col("_keep").isNull(), F.col("text")).otherwise(text)
    out = rows.withColumn("_new", new)
    count = F.when(F.col("_keep").isNull(), F.col("n_chars")).otherwise(F.length("_new").cast("bigint"))
    return out.select(*[{"text": F.col("_new"), "n_chars": count}.get(c, F.col(c)).alias(c) for c in docs.columns])


def one_of_each_group(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Of linked documents the one with the smallest doc_id; documents without words all stay."""
    scratch = Scratch(docs.sparkSession, "stage-near")
    found = jaccard_join.similar_documents(docs, width, percent)
    copies = found.where("n_shingles > 0 AND component_id <> doc_id").select("doc_id", F.lit(True).alias("_copy")).distinct()
    rest = marked_rows(docs, scratch.put(copies, "copies")).where("_copy IS NULL").select(*docs.columns)
    # rows that repeat a doc_id are one group too
    repeated = scratch.put(rest.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select("doc_id", F.lit(True).alias("_again")), "repeated")
    if repeated.isEmpty():
        return rest
    split = marked_rows(rest, repeated)
    return split.where("_again IS NULL").select(*docs.columns).unionByName(split.where("_again").select(*docs.columns).dropDuplicates(["doc_id"]))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold no benchmark item."""
    scratch = Scratch(docs.sparkSession, "stage-leaks")
    leaks = template_leaks.find_leaks(docs, benchmark).select("doc_id", F.lit(True).alias("_leak")).distinct()
    return marked_rows(docs, scratch.put(leaks, "leaks")).where("_leak IS NULL").select(*docs.columns)


def tokenised(docs: DataFrame, model_path: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of each document."""
    return piece_codec.round_trip(docs, model_path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
