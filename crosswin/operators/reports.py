"""Report tables over metric rows and pooled predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from crosswin.functions.expr import divide, null_if_not_finite, seed_of
from crosswin.operators.metrics import class_scores, confusion_counts
from crosswin.operators.scale import exact_quantiles, settle

SYSTEMS = ("network_only", "radio_only", "fusion_mean", "fusion_stacked")
# fixed values
DETECTABLE = 0.80
UNSTABLE_STD = 0.10
HURTS = -0.05
BLIND_SEEDS = 3
TOP_PAIRS = 6


def report_filter(rows: DataFrame, W: int = 10, part: str = "test", policy: str | None = None,
                  ttd_mode: str | None = None) -> DataFrame:
    """Rows of the reported setting: one window size, one part, stratified splits."""
    out = rows.where((F.col("W") == W) & (F.col("part") == part) & ~F.col("time_ordered"))
    if policy is not None:
        out = out.where(F.col("threshold_policy") == policy)
    return out.where(F.col("ttd_mode") == ttd_mode) if ttd_mode is not None else out


def with_seed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("seed", seed_of("split"))


def seed_mean_std(rows: DataFrame, metrics: list[str], by: tuple[str, ...] = ("model", "system")) -> DataFrame:
    """Mean and sample standard deviation over seeds, with the number of seeds."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("n_seeds"),
        *[F.avg(m).alias(f"{m}_mean") for m in metrics], *[F.stddev_samp(m).alias(f"{m}_std") for m in metrics])


def leaderboard(rows: DataFrame, metric: str, by: str = "model") -> DataFrame:
    return rows.groupBy(by).agg(F.avg(metric).alias(metric)).orderBy(F.col(metric).desc_nulls_last(), by)


def report_cells(rows: DataFrame, expected_cells: int, expected_seeds: int) -> DataFrame:
    """One row: number of (model, system) cells and the seeds per cell, against what is expected."""
    cells = rows.groupBy("model", "system").agg(F.count("*").alias("n"))
    return cells.agg(
        F.count("*").alias("cells"), F.min("n").alias("min_seeds"), F.max("n").alias("max_seeds")).withColumn(
        "ok", (F.col("cells") == expected_cells) & (F.col("min_seeds") == expected_seeds)
        & (F.col("max_seeds") == expected_seeds))


def detection_report(rows: DataFrame) -> DataFrame:
    """Per model and system: mean detection rate, seeds without detection, and the median
    delay over seeds with a finite one, where the mean rate is high enough to mean something."""
    rows = settle(rows.withColumn("ttd_median", null_if_not_finite("ttd_median")), "detection")
    base = rows.groupBy("model", "system").agg(
        F.avg("detect_rate").alias("detect_rate"), F.count(F.when(F.col("detect_rate") == 0, 1)).alias("blind_seeds"),
        F.count("*").alias("n_seeds"))
    med = exact_quantiles(rows, ["model", "system"], "ttd_median", {"ttd_median": 0.5}).drop("n_values")
    return base.join(med, ["model", "system"], "left").withColumns({
        "ttd_median": F.when(F.col("detect_rate") > DETECTABLE, F.col("ttd_median")),
        "reliability": F.when(F.col("blind_seeds") > BLIND_SEEDS, "UNRELIABLE")
        .when(F.col("blind_seeds") > 0, "CAUTION").otherwise("OK")})


def system_columns(rows: DataFrame, metric: str) -> DataFrame:
    """Seed mean of a metric per model, one column per system."""
    return rows.groupBy("model").agg(
        *[F.avg(F.when(F.col("system") == s, F.col(metric))).alias(s) for s in SYSTEMS])


def modality_gap(rows: DataFrame, metric: str) -> DataFrame:
    """Radio against network, and fusion against radio, per model."""
    return system_columns(rows, metric).withColumns({
        "radio_minus_network": F.col("radio_only") - F.col("network_only"),
        "fusion_gain": F.col("fusion_mean") - F.col("radio_only")})


def gap_range(gaps: DataFrame) -> DataFrame:
    return gaps.agg(
        F.min("radio_minus_network").alias("min_gap"), F.max("radio_minus_network").alias("max_gap"),
        F.min("fusion_gain").alias("min_gain"), F.max("fusion_gain").alias("max_gain"),
        F.min(F.col("fusion_gain") > 0).alias("fusion_helps_all"))


def stacked_stability(rows: DataFrame, metric: str = "roc_auc", rate: str = "detect_rate") -> DataFrame:
    """Spread of stacked fusion over seeds, and what it does to the detection rate."""
    stacked = F.col("system") == "fusion_stacked"
    g = rows.groupBy("model").agg(
        F.stddev_samp(F.when(stacked, F.col(metric))).alias("std"),
        (F.avg(F.when(stacked, F.col(rate))) - F.avg(F.when(F.col("system") == "radio_only", F.col(rate)))).alias("delta"))
    return g.withColumns({"unstable": F.col("std") > UNSTABLE_STD, "hurts": F.col("delta") < HURTS})


def best_config(rows: DataFrame, metric: str, largest: bool = True) -> DataFrame:
    """The (model, system) with the best seed mean; ties go to the first by name."""
    means = rows.groupBy("model", "system").agg(F.avg(metric).alias(metric))
    value = -F.col(metric) if largest else F.col(metric)
    return means.where(F.col(metric).isNotNull()).agg(
        F.min(F.struct(value.alias("v"), "model", "system", metric)).alias("b")).select(
        "b.model", "b.system", f"b.{metric}")


def lowest_system(rows: DataFrame, metric: str = "log_loss") -> DataFrame:
    """Per model, the system with the lowest seed mean."""
    means = rows.groupBy("model", "system").agg(F.avg(metric).alias(metric))
    rank = F.array_position(F.array(*[F.lit(s) for s in SYSTEMS]), F.col("system"))
    return means.groupBy("model").agg(
        F.min(F.struct(metric, rank.alias("r"), "system")).alias("b")).select("model", "b.system", f"b.{metric}")


# ---- predictions -------------------------------------------------------------------------


def per_class_f1(preds: DataFrame, by: tuple[str, ...] = ("system",)) -> DataFrame:
    """Precision, recall and F1 of each class, pooled."""
    return class_scores(confusion_counts(preds, list(by)), list(by))


def macro_f1_by_seed(preds: DataFrame, classes: list[str]) -> DataFrame:
    """Macro F1 per system over seeds: mean, population and sample standard deviation.

    The class list is fixed, so a class that a seed lacks counts with F1 = 0.
    """
    f1 = class_scores(confusion_counts(preds, ["system", "seed"]), ["system", "seed"]).where(F.col("label").isin(*classes))
    seeds = f1.groupBy("system", "seed").agg((F.sum("f1") / len(classes)).alias("m"))
    return seeds.groupBy("system").agg(
        F.avg("m").alias("f1_macro"), F.stddev_pop("m").alias("std_pop"), F.stddev_samp("m").alias("std_samp"))


def top_confusions(preds: DataFrame, by: list[str], k: int = TOP_PAIRS) -> DataFrame:
    """The k most frequent wrong (true, predicted) pairs per group with their shares.

    Works on confusion counts, classes x classes rows per group.
    """
    cells = confusion_counts(preds, by)
    row = Window.partitionBy(*by, "y_true")
    group = Window.partitionBy(*by)
    wrong = F.when(F.col("y_true") != F.col("y_pred"), F.col("n")).otherwise(0)
    shares = cells.select(
        *by, "y_true", "y_pred", "n",
        (100.0 * F.col("n") / F.sum("n").over(row)).alias("row_pct"),
        (100.0 * divide("n", F.sum(wrong).over(group))).alias("error_pct"),
    ).where("y_true <> y_pred")
    order = Window.partitionBy(*by).orderBy(F.col("n").desc(), "y_true", "y_pred")
    return shares.select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k).withColumn(
        "cumulative_pct", F.sum("error_pct").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def attack_to_benign(preds: DataFrame, by: list[str], benign: str = "Benign") -> DataFrame:
    """Errors per group, and how many of them call an attack benign."""
    wrong = F.col("y_true") != F.col("y_pred")
    to_benign = wrong & (F.col("y_pred") == benign)
    return preds.groupBy(*by).agg(
        F.count("*").alias("n"), F.count(F.when(wrong, 1)).alias("errors"),
        F.count(F.when(to_benign, 1)).alias("attack_to_benign")).withColumn(
        "attack_to_benign_pct", 100.0 * divide("attack_to_benign", "errors"))


def confusion_rate(preds: DataFrame, by: list[str], true: str, predicted: str) -> DataFrame:
    """Share of a class that is predicted as another one, in percent."""
    hit = F.col("y_pred") == predicted
    return preds.where(F.col("y_true") == true).groupBy(*by).agg(
        (100.0 * F.count(F.when(hit, 1)) / F.count("*")).alias("pct"))


def confusion_rate_rollup(rates: DataFrame, levels: list[str]) -> DataFrame:
    """Range, mean and population deviation of the rates overall and by each single level."""
    sets = [[], *[[c] for c in levels]]
    return rates.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in levels]).agg(
        F.count("*").alias("n"), F.min("pct").alias("min_pct"), F.max("pct").alias("max_pct"),
        F.avg("pct").alias("mean_pct"), F.stddev_pop("pct").alias("std_pct"))


def class_mix(preds: DataFrame, classes: list[str]) -> DataFrame:
    """Windows per seed and the share of every class in percent."""
    def share(c: str) -> Column:
        return (100.0 * F.count(F.when(F.col("y_true") == c, 1)) / F.count("*")).alias(c)

    return preds.groupBy("seed").agg(F.count("*").alias("n"), *[share(c) for c in classes])


def class_mix_range(mix: DataFrame, classes: list[str]) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("pct")) for c in classes]))
    return mix.select(pairs.alias("_e")).groupBy("_e.label").agg(
        F.min("_e.pct").alias("min_pct"), F.max("_e.pct").alias("max_pct"))


def class_windows_per_run(preds: DataFrame, label: str) -> DataFrame:
    """Per run: windows of a class and all windows, from its first seed, and whether the
    seeds agree."""
    per = preds.groupBy("run_id", "seed").agg(
        F.count(F.when(F.col("y_true") == label, 1)).alias("class_windows"), F.count("*").alias("total_windows"))
    pair = F.struct("class_windows", "total_windows")
    return per.groupBy("run_id").agg(
        F.min_by(pair, "seed").alias("_f"), (F.count_distinct(pair) == 1).alias("consistent")).select(
        "run_id", "_f.class_windows", "_f.total_windows", "consistent")


def class_windows_range(per_run: DataFrame) -> DataFrame:
    """Runs that hold the class, and the range and median of their window counts."""
    have = settle(per_run.where("class_windows > 0"), "class-windows")
    med = exact_quantiles(have, [], "class_windows", {"median": 0.5}).select("median")
    return have.agg(F.count("*").alias("runs"), F.min("class_windows").alias("min"), F.max("class_windows").alias("max")).crossJoin(
        F.broadcast(med))  # one row each
