"""Tables between the steps of an operator, and joins that don't outgrow memory."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crosswin.operators.scale import shared_folder, table_bytes

BROADCAST_BYTES = 24 << 20
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


class Scratch:
    """Tables written once to the folder all executors share; they survive lost executors.

    ``drop`` deletes a table that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.folder = os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")

    def put(self, df: DataFrame, name: str, batch_bytes: int | None = None) -> DataFrame:
        """Write and read back; ``batch_bytes`` bounds the Arrow batches between Spark and Python meanwhile."""
        path = os.path.join(self.folder, name)
        before = self.spark.conf.get(BATCH_BYTES)
        try:
            if batch_bytes is not None:
                self.spark.conf.set(BATCH_BYTES, str(batch_bytes))
            df.write.parquet(path)
        finally:
            self.spark.conf.set(BATCH_BYTES, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(os.path.join(self.folder, name))
            path.getFileSystem(conf).delete(path, True)


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of the key columns."""
    out = F.lit(True)
    for k in keys:
        out = out & left[k].eqNullSafe(right[k])
    return out


def look_up(big: DataFrame, facts: DataFrame, keys: list[str], how: str = "left", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join a written table of facts, one row per key, nulls matching nulls.

    Facts whose measured size is below ``limit`` are broadcast. Others are shuffled with the
    big table, whose hot keys adaptive execution splits.
    """
    if table_bytes(facts) <= limit:
        facts = F.broadcast(facts)
    renamed = facts.withColumnsRenamed({k: f"_f_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_f_{k}"))
    return big.join(renamed, on, how).drop(*[f"_f_{k}" for k in keys])


def text_rows(docs: DataFrame) -> DataFrame:
    """doc_id as long and text, whatever other columns there are."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
