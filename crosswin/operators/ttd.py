"""Onset of an attack and time to detect it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from crosswin.functions.expr import divide, finite, norm, to_double
from crosswin.operators.scale import attach, exact_quantiles, first_per_key, settle

INF = float("inf")
SLACK_S = 60.0  # fixed value: how far an onset may lie past the last window


def onset_map(summary: DataFrame, onset: str = "t_first_attack_flow_s", benign: str = "Benign") -> DataFrame:
    """First row per run (by ``ord``): onset_s, +inf for benign runs; ``valid`` tells whether
    an attack run has a finite onset that is not negative."""
    rows = first_per_key(summary.select("run_id", "ord", "family", onset), ["run_id"], ["ord"])
    is_benign = norm("family") == benign.strip().lower()
    x = to_double(onset)
    return rows.select(
        "run_id", "family", F.when(is_benign, F.lit(INF)).otherwise(x).alias("onset_s"),
        F.coalesce(is_benign | (x >= 0), F.lit(False)).alias("valid"))


def onset_lookup(rows: DataFrame, onsets: DataFrame) -> DataFrame:
    """Rows with the onset of their run; unknown runs get null."""
    return attach(rows, onsets.select("run_id", "onset_s"), "run_id")


def onset_violations(rows: DataFrame, onsets: DataFrame, benign: str = "Benign") -> DataFrame:
    """Runs whose onset is missing, not +inf for benign, not finite for attack, or far past
    the last window."""
    runs = rows.groupBy("run_id").agg(F.min("family").alias("family"), F.max("window_end_s").alias("last_end"))
    j = runs.join(onsets.select("run_id", "onset_s", F.lit(1).alias("_k")), "run_id", "left")
    is_benign = norm("family") == benign.strip().lower()
    ok = finite("onset_s")
    problem = (
        F.when(F.col("_k").isNull(), "missing_run")
        .when(is_benign & (F.coalesce(F.col("onset_s"), F.lit(0.0)) != INF), "benign_not_infinite")
        .when(~is_benign & ~ok, "attack_not_finite")
        .when(ok & (F.col("onset_s") > F.col("last_end") + SLACK_S), "onset_out_of_range"))
    return j.select("run_id", problem.alias("problem")).where("problem is not null")


def first_detections(
    rows: DataFrame, onsets: DataFrame, thresholds: DataFrame, keys: list[str], part_keys: tuple[str, ...] = (), benign: str = "Benign"
) -> DataFrame:
    """Per group, threshold and attack run: onset, first alarm at or after it, delay.

    ``onsets``: run_id, onset_s (null onset counts as a miss). ``keys`` link rows to
    thresholds, ``part_keys`` split the result further. Rows with a family: every attack run
    counts, and one that ``onsets`` lacks is a miss; without it, the runs of ``onsets`` do.
    """
    if "family" in rows.columns:
        near = attach(rows.where(norm("family") != benign.strip().lower()), onsets, "run_id")
    else:
        near = attach(rows, onsets, "run_id", "inner")
    shots = attach(near, settle(thresholds, "thresholds"), keys, "inner", settled=True)
    alarm = (F.col("window_end_s") >= F.col("onset_s")) & (F.col("score") >= F.col("threshold")) & ~F.isnan("score")
    g = shots.groupBy(*keys, *part_keys, "threshold_policy", "fpr_target", "run_id").agg(
        F.max("onset_s").alias("onset_s"), F.min(F.when(alarm, F.col("window_end_s"))).alias("detect_s"))
    found = F.col("detect_s").isNotNull()
    delay = F.greatest(F.col("detect_s") - F.col("onset_s"), F.lit(0.0)).cast("double")
    return g.withColumns({"detected": found, "ttd_s": F.when(found, delay).otherwise(F.lit(INF))})


def attack_onsets(onsets: DataFrame, benign: str = "Benign") -> DataFrame:
    """Flow onsets of attack runs."""
    return onsets.where(norm("family") != benign.strip().lower()).select("run_id", "onset_s")


def window_onsets(rows: DataFrame, benign: str = "Benign") -> DataFrame:
    """Onset of attack runs by label: start of the first positive window, null without one."""
    return rows.where(norm("family") != benign.strip().lower()).groupBy("run_id").agg(
        F.min(F.when(F.col("y_bin") == 1, F.col("window_start_s"))).cast("double").alias("onset_s"))


def _spread(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    return exact_quantiles(rows, keys, value, {f"{name}_median": 0.5, f"{name}_p25": 0.25, f"{name}_p75": 0.75}).drop(
        "n_values")


def summarize_ttd(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Attack runs, detection rate and delay quartiles over detected runs; +inf when no run
    of a group is detected."""
    runs = settle(runs, "ttd")
    base = runs.groupBy(*keys).agg(
        F.count("*").alias("n_attack_runs"), F.count(F.when(F.col("detected"), 1)).alias("_d"))
    q = _spread(runs.where("detected"), keys, "ttd_s", "ttd")
    j = base.join(q, keys, "left").withColumn("detect_rate", divide("_d", "n_attack_runs"))
    cols = ["ttd_median", "ttd_p25", "ttd_p75"]
    return j.select(*keys, "n_attack_runs", "detect_rate", *[
        F.when(F.col("_d") == 0, F.lit(INF)).otherwise(F.col(c)).alias(c) for c in cols])


def ttd_runs(flow: DataFrame, window: DataFrame, keys: list[str]) -> DataFrame:
    """Both onset definitions per run, side by side, and their difference."""
    k = [*keys, "threshold_policy", "fpr_target", "run_id"]
    cols = ["onset_s", "detect_s", "detected", "ttd_s"]
    a = flow.select(*k, *[F.col(c).alias(f"flow_{c}") for c in cols])
    b = window.select(*k, *[F.col(c).alias(f"window_{c}") for c in cols])
    both = F.coalesce(F.col("flow_detected"), F.lit(False)) & F.coalesce(F.col("window_detected"), F.lit(False))
    return a.join(b, k, "full").withColumn("delta_s", F.when(both, F.col("window_ttd_s") - F.col("flow_ttd_s")))


def summarize_delta(sided: DataFrame, keys: list[str]) -> DataFrame:
    """Quartiles of the difference over runs detected under both definitions."""
    sided = settle(sided, "ttd-delta")
    base = sided.groupBy(*keys).agg(F.count("delta_s").alias("n_delta"))
    return base.join(_spread(sided, keys, "delta_s", "delta"), keys, "left")


def finite_or_null(c: str) -> Column:
    """Misses as null, for comparison with engines that print infinity differently."""
    return F.when(finite(c), F.col(c))
