"""Writers: stage tables, predictions, metric files, run descriptions, splits."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from crosswin.functions.expr import class_column_names
from crosswin.operators.network import window_index
from crosswin.operators.scale import settle


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write_stage(df: DataFrame, path: str, partition_by: list[str] | None = None, force: bool = False) -> None:
    """Parquet; what exists is left alone unless forced.

    With partitions this holds for each of them: rows of partitions that the path has already are
    left out, others are added, and a forced write replaces only the partitions it holds.
    """
    if not partition_by:
        df.write.mode("overwrite" if force else "ignore").parquet(path)
        return
    if force:
        df.write.mode("overwrite").partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic").parquet(path)
        return
    if path_exists(df.sparkSession, path):
        # partition values only, one row each; written first, since the path is about to change
        have = settle(df.sparkSession.read.parquet(path).select(*[F.col(c).cast("string").alias(c) for c in partition_by]).distinct(), "partitions")
        same = F.lit(True)
        for c in partition_by:
            same = same & df[c].cast("string").eqNullSafe(have[c])
        df = df.join(F.broadcast(have), same, "left_anti")
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def write_window_index(windows: DataFrame, path: str, W: int, S: int, force: bool = False) -> None:
    tagged = window_index(windows).withColumns({"W": F.lit(W), "S": F.lit(S)})
    write_stage(tagged, path, ["W", "S"], force)


def write_csv(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite").option("header", True)
    (w.partitionBy(*partition_by) if partition_by else w).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def binary_predictions(rows: DataFrame, meta: list[str], label: str = "y_bin", score: str = "score") -> DataFrame:
    """Meta, y_true as one byte, score as a float."""
    return rows.select(*meta, F.col(label).cast("tinyint").alias("y_true"), F.col(score).cast("float").alias("score"))


def multiclass_predictions(rows: DataFrame, meta: list[str], classes: list[str], proba: str = "proba") -> DataFrame:
    """Meta, labels, p_max and one probability column per class."""
    names = class_column_names(classes)
    return rows.select(
        *meta, F.col("y_true").cast("string").alias("y_true"), F.col("y_pred").cast("string").alias("y_pred"),
        F.col("p_max").cast("float").alias("p_max"),
        *[F.col(proba)[i].cast("float").alias(n) for i, n in enumerate(names)])


def write_run_artifact(spark, path: str, description: dict[str, Any]) -> None:
    """One JSON document: configuration, feature lists and counts of a run."""
    spark.createDataFrame([(json.dumps(description),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_splits(splits: DataFrame, path: str, export: str | None = None) -> None:
    """Long split table, one folder per split; ``export`` adds one JSON row per split."""
    splits.write.mode("overwrite").partitionBy("split_name").parquet(path)
    if export is not None:
        ids = [F.array_sort(F.collect_list(F.when(F.col("part") == p, F.col("run_id")))).alias(f"{p}_run_ids")
               for p in ("train", "val", "test")]
        # the export format lists the run ids of a split in one document
        splits.groupBy("split_name", "seed").agg(*ids).write.mode("overwrite").json(export)


def preprocess_summary(rows: DataFrame) -> DataFrame:
    """Rows and positive rate per split, modality, window setting and part, where present."""
    keys = [c for c in ("split_name", "modality", "W", "S", "part") if c in rows.columns]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("y_bin").alias("y_bin_rate"))


def lag_curve_maps(curves: DataFrame) -> DataFrame:
    """Correlation by lag as one map per run; the number of lags is fixed by the search."""
    return curves.groupBy("run_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("lag", "corr")))).alias("corr_by_lag"))
