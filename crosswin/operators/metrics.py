"""Ranking, calibration and operating-point metrics of scored windows.

Every metric works on groups (split, model, system, part, ...) in one job. Rows are first
collapsed to one row per distinct score, and cumulative counts come from the prefix-sum
helper, so a group with most of the rows is never sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from crosswin.functions.expr import argmax, array_sum, divide, metric_score, norm, null_if_not_finite, sanitize_proba
from crosswin.operators.scale import attach, exact_quantiles, join_keys, running_totals, settle

BINS = 15  # fixed value
POLICIES = ("benign_runs_only", "pre_attack", "all_benign_labeled")
POLICY_ALIASES = {  # fixed values
    "benign_runs": "benign_runs_only", "family_benign": "benign_runs_only", "preattack": "pre_attack",
    "all_benign": "all_benign_labeled", "window_label": "all_benign_labeled",
}
LOG_CLIP = 2.220446049250313e-16  # fixed value: machine epsilon


def score_ranks(rows: DataFrame, keys: list[str], score: str = "score", label: str = "y_bin") -> DataFrame:
    """Per distinct score, falling: rows, positives, and counts at or above the score."""
    steps = rows.groupBy(*keys, metric_score(score).alias("s")).agg(
        F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos"))
    steps = steps.withColumn("neg", F.col("n") - F.col("pos"))
    return running_totals(steps, keys, [F.col("s").desc()], {"tp": "pos", "fp": "neg"})


def ranking_metrics(ranks: DataFrame, keys: list[str]) -> DataFrame:
    """ROC area (ties count half) and average precision; null when a class is absent."""
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "pos", "neg"))
    g = ranks.groupBy(*keys).agg(
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"),
        # positives above a step beat its negatives, ties count half
        F.sum(neg.cast("double") * (tp - pos + pos / 2.0)).alias("_wins"),
        F.sum(pos * divide(tp, tp + fp)).alias("_prec"),
    )
    both = (F.col("_p") > 0) & (F.col("_n") > 0)
    return g.select(
        *keys,
        F.when(both, F.col("_wins") / (F.col("_p").cast("double") * F.col("_n"))).alias("roc_auc"),
        F.try_divide(F.col("_prec"), F.col("_p").cast("double")).alias("pr_auc"))


def ece_bin(p: Column) -> Column:
    """Equal-width bin of a clipped probability; edges belong upwards, 1.0 to the last bin."""
    raw = F.floor(p * BINS)
    # keep to the edges i * (1/BINS) where the product rounds across one
    step = 1.0 / BINS
    low = F.when(p < raw * step, raw - 1).when(p >= (raw + 1) * step, raw + 1).otherwise(raw)
    return F.least(F.greatest(low, F.lit(0)), F.lit(BINS - 1))


def calibration_error(rows: DataFrame, keys: list[str], score: str = "score", label: str = "y_bin") -> DataFrame:
    p = F.least(F.greatest(metric_score(score), F.lit(1e-15)), F.lit(1 - 1e-15))
    bins = rows.select(*keys, p.alias("_p"), F.col(label).cast("double").alias("_y")).groupBy(
        *keys, ece_bin(F.col("_p")).alias("_b")).agg(
        F.count("*").alias("_n"), F.avg("_y").alias("_acc"), F.avg("_p").alias("_conf"))
    return bins.groupBy(*keys).agg(
        (F.sum(F.col("_n") * F.abs(F.col("_acc") - F.col("_conf"))) / F.sum("_n")).alias("ece"))


def binary_metrics(rows: DataFrame, keys: list[str], score: str = "score", label: str = "y_bin", settled: bool = False) -> DataFrame:
    """n, pos_rate, roc_auc, pr_auc, brier, log_loss, ece, pr_lift and pr_ratio per group.

    ``settled`` rows come from a written table and are read again instead of being written.
    """
    rows = rows.select(*keys, F.col(score).cast("double").alias("score"), F.col(label).alias("y_bin"))
    rows = rows if settled else settle(rows, "scored")
    p, y = metric_score("score"), F.col("y_bin").cast("double")
    clipped = F.least(F.greatest(p, F.lit(LOG_CLIP)), F.lit(1.0 - LOG_CLIP))
    base = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(y).alias("pos_rate"), F.avg((p - y) * (p - y)).alias("brier"),
        F.avg(-(y * F.ln(clipped) + (1 - y) * F.ln(1 - clipped))).alias("log_loss"))
    out = base
    for part in (ranking_metrics(score_ranks(rows, keys), keys), calibration_error(rows, keys)):
        out = join_keys(out, part, keys)
    return out.withColumns({
        "pr_lift": F.col("pr_auc") - F.col("pos_rate"), "pr_ratio": divide("pr_auc", "pos_rate")})


# ---- thresholds --------------------------------------------------------------------------


def policy_name(policy: str) -> str:
    p = policy.strip().lower()
    p = POLICY_ALIASES.get(p, p)
    if p not in POLICIES:
        raise ValueError(f"unknown threshold policy {policy!r}; known: {list(POLICIES)}")
    return p


def policy_filter(policy: str, benign: str = "Benign") -> Column:
    """Which train rows calibrate the threshold; ``onset_s`` is needed by pre_attack only."""
    if policy == "benign_runs_only":
        return norm("family") == benign.strip().lower()
    if policy == "pre_attack":
        onset = F.when(~F.isnan("onset_s"), F.col("onset_s"))
        return F.coalesce(F.col("window_end_s") < onset, F.lit(False))
    return F.col("y_bin") == 0


def select_for_threshold(train: DataFrame, policies: list[str]) -> DataFrame:
    """Train rows once per policy that selects them (column ``threshold_policy``)."""
    tags = F.array(*[F.when(policy_filter(policy_name(p)), F.lit(policy_name(p))) for p in policies])
    return train.withColumn("threshold_policy", F.explode(F.array_compact(tags)))


def threshold_info(train: DataFrame, keys: list[str], policies: list[str]) -> DataFrame:
    """Selected rows and the range of their finite scores, per group and policy."""
    total = train.groupBy(*keys).agg(F.count("*").alias("n_total_train_windows"))
    names = F.array(*[F.lit(policy_name(p)) for p in policies])
    every = total.withColumn("threshold_policy", F.explode(names))
    got = select_for_threshold(train, policies).groupBy(*keys, "threshold_policy").agg(
        F.count("*").alias("n_selected"),
        F.min(null_if_not_finite("score")).alias("selected_score_min"),
        F.max(null_if_not_finite("score")).alias("selected_score_max"))
    zero = F.lit(0).cast("bigint")
    return every.join(got, [*keys, "threshold_policy"], "left").withColumn("n_selected", F.coalesce("n_selected", zero))


def benign_thresholds(train: DataFrame, keys: list[str], policies: list[str], fpr_targets: list[float]) -> DataFrame:
    """Score threshold per group, policy and false-alarm target: the exact quantile of the
    selected finite scores at 1 - target; null when a policy selects none."""
    chosen = select_for_threshold(train, policies).withColumn("score", null_if_not_finite("score"))
    probs = {f"q{i}": min(max(1.0 - t, 0.0), 1.0) for i, t in enumerate(fpr_targets)}
    q = exact_quantiles(chosen, [*keys, "threshold_policy"], "score", probs).drop("n_values")
    every = train.select(*keys).distinct().withColumn(
        "threshold_policy", F.explode(F.array(*[F.lit(policy_name(p)) for p in policies])))
    targets = F.array(*[
        F.struct(F.lit(t).alias("fpr_target"), F.col(f"q{i}").alias("threshold")) for i, t in enumerate(fpr_targets)])
    return every.join(q, [*keys, "threshold_policy"], "left").withColumn("_t", F.explode(targets)).select(
        *keys, "threshold_policy", "_t.fpr_target", "_t.threshold")


def operating_points(rows: DataFrame, thresholds: DataFrame, keys: list[str], part_keys: list[str]) -> DataFrame:
    """Confusion counts and rates at every threshold of the group of the row.

    ``keys`` link rows to thresholds; ``part_keys`` split the rows further. Scores are
    collapsed to distinct values before they meet the thresholds. A missing threshold calls
    nothing positive.
    """
    settled = settle(thresholds, "thresholds")
    steps = rows.groupBy(*keys, *part_keys, F.col("score").cast("double").alias("s")).agg(
        F.count(F.when(F.col("y_bin") == 1, 1)).alias("p"), F.count(F.when(F.col("y_bin") == 0, 1)).alias("q"))
    hit = F.coalesce((F.col("s") >= F.col("threshold")) & ~F.isnan("s"), F.lit(False))
    j = attach(steps, settled, keys, "inner", settled=True).groupBy(
        *keys, *part_keys, "threshold_policy", "fpr_target", "threshold").agg(
        F.sum(F.when(~hit, F.col("q")).otherwise(0)).alias("tn"), F.sum(F.when(hit, F.col("q")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit, F.col("p")).otherwise(0)).alias("fn"), F.sum(F.when(hit, F.col("p")).otherwise(0)).alias("tp"))
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    prec, rec = divide(tp, tp + fp), divide(tp, tp + fn)
    return j.withColumns({
        "tpr": rec, "fpr": divide(fp, fp + tn), "precision": prec, "recall": rec,
        "f1": F.try_divide(2 * prec * rec, prec + rec)})


# ---- multiclass --------------------------------------------------------------------------


def predict_class(rows: DataFrame, proba: str, classes: list[str]) -> DataFrame:
    """Add clean probabilities ``proba``, ``y_pred`` (first maximum wins) and ``p_max``."""
    names = F.array(*[F.lit(c) for c in classes])
    clean = rows.withColumn("proba", sanitize_proba(proba))
    return clean.withColumns({
        "y_pred": F.element_at(names, argmax(F.col("proba")) + 1), "p_max": F.array_max("proba")})


def confusion_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, "y_true", "y_pred").agg(F.count("*").alias("n"))


def confusion_matrix(rows: DataFrame, keys: list[str], classes: list[str]) -> DataFrame:
    """Every (true, predicted) pair of the class list with its count; other labels left out."""
    got = confusion_counts(rows.where(F.col("y_true").isin(*classes) & F.col("y_pred").isin(*classes)), keys)
    names = F.array(*[F.lit(c) for c in classes])
    cells = rows.select(*keys).distinct() if keys else rows.sparkSession.range(1)
    cells = cells.withColumn("y_true", F.explode(names)).withColumn("y_pred", F.explode(names))
    return cells.select(*keys, "y_true", "y_pred").join(got, [*keys, "y_true", "y_pred"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0).cast("bigint")))


def class_scores(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall and F1 per class from confusion counts; empty denominators give 0.

    Classes are those that occur as true or predicted label with a positive count.
    """
    sides = counts.where("n > 0").select(*keys, "n", (F.col("y_true") == F.col("y_pred")).alias("_ok"), F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("y_true").alias("label")),
        F.struct(F.lit(1).alias("side"), F.col("y_pred").alias("label")))).alias("_l"))
    zero = F.lit(0).cast("bigint")

    def total(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col("n")).otherwise(zero))

    true_side = F.col("_l.side") == 0
    g = sides.groupBy(*keys, F.col("_l.label").alias("label")).agg(
        total(true_side & F.col("_ok")).alias("tp"), total(true_side).alias("support"), total(~true_side).alias("predicted"))
    tp = F.col("tp")

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(divide(a, b), F.lit(0.0))

    return g.withColumns({
        "precision": ratio(tp, F.col("predicted")), "recall": ratio(tp, F.col("support")),
        "f1": ratio(2 * tp, F.col("predicted") + F.col("support"))})


def multiclass_metrics(rows: DataFrame, keys: list[str], classes: list[str]) -> DataFrame:
    """n, accuracy, macro and weighted F1, log-loss of rows with ``proba`` and ``y_pred``."""
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("y_true")).cast("int")
    p_true = F.try_element_at("proba", F.when(place > 0, place))
    p_true = F.least(F.greatest(p_true / array_sum(F.col("proba")), F.lit(LOG_CLIP)), F.lit(1.0 - LOG_CLIP))
    base = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("acc"),
        F.avg(-F.ln(p_true)).alias("log_loss"))
    f1 = class_scores(confusion_counts(rows, keys), keys).groupBy(*keys).agg(
        F.avg("f1").alias("f1_macro"), divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1_weighted"))
    return join_keys(base, f1, keys)
