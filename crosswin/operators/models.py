"""Detectors on Spark MLlib: training, out-of-fold scores, stacking, evaluation, search.

The driver only loops over folds, models and parameter sets; rows stay in Spark.
"""

from __future__ import annotations

import json
import os
import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from crosswin.functions.expr import array_sum, finite, logit
from crosswin.operators import metrics as mt
from crosswin.operators import ttd as td
from crosswin.operators.features import encode_classes, with_weights
from crosswin.operators.fusion import fusion_mean_binary, fusion_mean_multiclass
from crosswin.operators.scale import settle

FEATURES, LABEL, WEIGHT = "features", "label", "weight"
LOG_EPS = 1e-6
MODALITIES = ("network", "radio")
MAX_DEPTH = 30  # limit of Spark's trees
FITS_AT_ONCE = 4  # threads of the driver that wait for fits; the work is Spark's
WINDOW_KEY = ["run_id", "window_start_s", "window_end_s"]
SYSTEMS = ("network_only", "radio_only", "fusion_mean", "fusion_stacked")


def resolve_config(config: dict[str, Any], task: str, modality: str) -> dict[str, Any]:
    """Flatten a nested model config: general, then task, then modality, then task__modality.

    Modality settings of the task replace those at the top level.
    """
    reserved = {"enabled", "binary", "multiclass", *MODALITIES} | {
        f"{t}__{m}" for t in ("binary", "multiclass") for m in MODALITIES}
    by_task = config.get(task) or {}
    layers = [
        {k: v for k, v in config.items() if k not in reserved},
        {k: v for k, v in by_task.items() if k not in MODALITIES},
        by_task.get(modality) or config.get(modality) or {},
        config.get(f"{task}__{modality}") or {},
    ]
    return {k: v for layer in layers for k, v in layer.items()}


# ---- estimators --------------------------------------------------------------------------


def logreg(cfg: dict[str, Any], multiclass: bool, weight_sum: float, seed: int) -> LogisticRegression:
    """Ridge logistic regression. MLlib divides the loss by the weight sum, hence 1/(C * sum)."""
    weighted = {"weightCol": WEIGHT} if cfg.get("class_weight", None if multiclass else "balanced") else {}
    return LogisticRegression(
        featuresCol=FEATURES, labelCol=LABEL, family="multinomial" if multiclass else "binomial",
        regParam=1.0 / (float(cfg.get("C", 1.0)) * max(weight_sum, 1.0)), elasticNetParam=0.0, standardization=False,
        maxIter=int(cfg.get("max_iter", 100)), **weighted)


def tree_depth(cfg: dict[str, Any], default: int) -> int:
    """Spark's trees end at MAX_DEPTH; a deeper or unlimited tree is refused, not cut."""
    depth = cfg.get("max_depth", default)
    if depth is None or not 0 <= int(depth) <= MAX_DEPTH:
        raise ValueError(f"max_depth must be 0 to {MAX_DEPTH}, not {depth}")
    return int(depth)


def random_forest(cfg: dict[str, Any], multiclass: bool, weight_sum: float, seed: int) -> RandomForestClassifier:
    """800 trees of depth 20 unless the config says otherwise; two classes are weighed."""
    weighted = {"weightCol": WEIGHT} if cfg.get("class_weight", None if multiclass else "balanced") else {}
    return RandomForestClassifier(
        featuresCol=FEATURES, labelCol=LABEL, numTrees=int(cfg.get("n_estimators", 800)),
        maxDepth=tree_depth(cfg, 20), seed=seed, **weighted)


def boosted_trees(cfg: dict[str, Any], multiclass: bool, weight_sum: float, seed: int):
    """Gradient-boosted trees; several classes through one-vs-rest. Unweighted unless class_weight is set."""
    if multiclass and cfg.get("class_weight"):
        raise ValueError("one-vs-rest boosted trees take no class_weight")
    weighted = {"weightCol": WEIGHT} if cfg.get("class_weight") else {}
    gbt = GBTClassifier(
        featuresCol=FEATURES, labelCol=LABEL, maxIter=int(cfg.get("n_estimators", 600)),
        maxDepth=tree_depth(cfg, 6), stepSize=float(cfg.get("learning_rate", 0.1)),
        subsamplingRate=float(cfg.get("subsample", 0.9)), seed=seed, **weighted)
    return OneVsRest(classifier=gbt, featuresCol=FEATURES, labelCol=LABEL) if multiclass else gbt


MODELS: dict[str, Callable] = {"logreg": logreg, "rf": random_forest, "boosted_trees": boosted_trees}


def assemble(rows: DataFrame, features: list[str], label: str | None = None) -> DataFrame:
    """Add the feature vector (bad values fail) and the label as double."""
    out = VectorAssembler(inputCols=features, outputCol=FEATURES, handleInvalid="error").transform(rows)
    return out if label is None else out.withColumn(LABEL, F.col(label).cast("double"))


def fit(train: DataFrame, model: str, cfg: dict[str, Any] | None = None, multiclass: bool = False, seed: int = 0) -> Model:
    """Fit a named model on rows that carry features and label; weights are balanced."""
    weighted = with_weights(train, LABEL, WEIGHT)
    facts = weighted.agg(F.sum(WEIGHT).alias("w"), F.count_distinct(LABEL).alias("k")).first()
    if facts["k"] < 2:
        raise ValueError("training rows hold fewer than two classes")
    return MODELS[model](cfg or {}, multiclass, facts["w"], seed).fit(weighted)


def predict_proba(model: Model, rows: DataFrame, out: str = "proba") -> DataFrame:
    """Class probabilities as an array; tree scores of one-vs-rest go through the sigmoid."""
    scored = model.transform(rows)
    if "probability" in scored.columns:
        return scored.withColumn(out, vector_to_array("probability")).drop("probability", "rawPrediction", "prediction")
    raw = F.transform(vector_to_array("rawPrediction"), lambda v: 1.0 / (1.0 + F.exp(-2.0 * v)))
    scored = scored.withColumn("_r", raw)
    return scored.withColumn(out, F.transform("_r", lambda v: v / array_sum(F.col("_r")))).drop(
        "_r", "rawPrediction", "prediction")


def predict_binary(model: Model, rows: DataFrame, out: str = "score") -> DataFrame:
    return predict_proba(model, rows, "_p").withColumn(out, F.col("_p")[1]).drop("_p")


def at_once(spark, jobs: list[Callable[[], Any]], threads: int = FITS_AT_ONCE) -> list[Any]:
    """Results of independent fits, in order; their jobs share the cluster through a scheduler pool."""
    def run(job: Callable[[], Any]) -> Any:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", "fits")
        return job()

    with ThreadPoolExecutor(max(1, min(threads, len(jobs) or 1))) as pool:
        return list(pool.map(inheritable_thread_target(spark)(run), jobs))


def oof_predict(
    train: DataFrame, model: str, cfg: dict[str, Any] | None = None, seed: int = 0, out: str = "score",
    multiclass: bool = False,
) -> DataFrame:
    """Every row scored by the model that never saw its run; rows carry ``fold``.

    The assembled rows are written once, and the folds' models are fitted side by side.
    """
    train = settle(train, "oof")
    folds = [r["fold"] for r in train.select("fold").distinct().toLocalIterator()]  # a few numbers
    if None in folds:
        raise ValueError("rows without a fold would be left out")
    folds.sort()
    fits = [lambda k=k: fit(train.where(F.col("fold") != k), model, cfg, multiclass, seed) for k in folds]
    score = predict_proba if multiclass else predict_binary
    parts = [score(m, train.where(F.col("fold") == k), out) for k, m in zip(folds, at_once(train.sparkSession, fits))]
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


# ---- stacking ----------------------------------------------------------------------------


def stack_features(rows: DataFrame, net: str = "p_net", rad: str = "p_rad") -> DataFrame:
    return rows.withColumn(FEATURES, array_to_vector(F.array(logit(net), logit(rad))))


def fit_stacked(oof: DataFrame, label: str = "y_bin", C: float = 1.0) -> Model:
    """Logistic head on the log-odds of both out-of-fold scores."""
    rows = stack_features(oof).withColumn(LABEL, F.col(label).cast("double"))
    return fit(rows.select(FEATURES, LABEL), "logreg", {"C": C})


def predict_stacked(head: Model, rows: DataFrame, out: str = "score") -> DataFrame:
    return predict_binary(head, stack_features(rows), out).drop(FEATURES)


def oof_stacked(oof: DataFrame, label: str = "y_bin", C: float = 1.0, out: str = "score") -> DataFrame:
    """Stacked scores of the train rows, cross-fitted over the same folds."""
    rows = stack_features(oof).withColumn(LABEL, F.col(label).cast("double"))
    return oof_predict(rows, "logreg", {"C": C}, out=out).drop(FEATURES, LABEL)


def stack_features_multiclass(rows: DataFrame, net: str, rad: str) -> DataFrame:
    def logs(c: str):
        return F.transform(c, lambda v: F.ln(F.least(F.greatest(
            F.when(finite(v), v.cast("double")).otherwise(LOG_EPS), F.lit(LOG_EPS)), F.lit(1.0))))

    return rows.withColumn(FEATURES, array_to_vector(F.concat(logs(net), logs(rad))))


def oof_stacked_multiclass(rows: DataFrame, label: str = "class_id", net: str = "proba_net", rad: str = "proba_rad", C: float = 1.0, out: str = "proba") -> DataFrame:
    """Stacked class probabilities of the train rows, cross-fitted over the same folds."""
    x = stack_features_multiclass(rows, net, rad).withColumn(LABEL, F.col(label).cast("double"))
    return oof_predict(x, "logreg", {"C": C}, out=out, multiclass=True).drop(FEATURES)


def fit_stacked_multiclass(rows: DataFrame, label: str = "class_id", net: str = "proba_net", rad: str = "proba_rad", C: float = 1.0) -> Model:
    x = stack_features_multiclass(rows, net, rad).withColumn(LABEL, F.col(label).cast("double"))
    return fit(x.select(FEATURES, LABEL), "logreg", {"C": C}, multiclass=True)


# ---- one experiment ----------------------------------------------------------------------


def score_systems(
    rows: DataFrame, net_features: list[str], rad_features: list[str], model: str,
    cfg: dict[str, Any] | None = None, seed: int = 0,
) -> tuple[DataFrame, ModelBundle]:
    """Train per modality and return (predictions, models).

    ``rows`` hold the features of both modalities, part, y_bin, and ``fold`` for train rows.
    Predictions are long, one row per (window, system): out-of-fold scores for train rows,
    full-model scores for val and test.
    """
    keep = [c for c in rows.columns if c not in (*net_features, *rad_features)]
    key = ["run_id", "window_start_s", "window_end_s"]
    rows = settle(rows, "experiment")
    models: dict[str, Model] = {}
    scored = None
    for name, feats, column in (("network", net_features, "p_net"), ("radio", rad_features, "p_rad")):
        x = assemble(rows, feats, "y_bin").select(*keep, FEATURES, LABEL)
        train, rest = x.where("part = 'train'"), x.where("part <> 'train'")
        models[name] = fit(train, model, cfg, seed=seed)
        both = oof_predict(train, model, cfg, seed, column).unionByName(predict_binary(models[name], rest, column))
        side = both.drop(FEATURES, LABEL)
        scored = side if scored is None else scored.join(side.select(*key, column), key)
    scored = settle(scored, "base-scores")
    train, rest = scored.where("part = 'train'"), scored.where("part <> 'train'")
    models["stacked"] = fit_stacked(train)
    stacked = oof_stacked(train, out="p_stacked").unionByName(predict_stacked(models["stacked"], rest, "p_stacked"))
    return settle(long_binary(stacked, keep), "predictions"), ModelBundle("binary", models, net_features, rad_features, [])


def long_binary(rows: DataFrame, keep: list[str]) -> DataFrame:
    """One row per (window, system) from the scores of the base and stacked models."""
    pairs = F.array(*[F.struct(F.lit(s).alias("system"), c.cast("float").cast("double").alias("score")) for s, c in zip(SYSTEMS, (
        F.col("p_net"), F.col("p_rad"), fusion_mean_binary("p_net", "p_rad"), F.col("p_stacked")))])
    return rows.withColumn("_e", F.explode(pairs)).select(*keep, "_e.system", "_e.score")


def evaluate_all(
    predictions: DataFrame, onsets: DataFrame, policies: list[str], fpr_targets: list[float], keys: tuple[str, ...] = ("system",),
    settled: bool = False,
) -> dict[str, DataFrame]:
    """Metric tables of one prediction table (``settled`` if it is written): ``binary``, ``operating``, ``ttd``.

    Thresholds come from train rows; val and test rows are reported. Time to detect has one
    row per onset definition plus one for their difference.
    """
    k = list(keys)
    predictions = predictions if settled else settle(predictions, "predictions")
    train = td.onset_lookup(predictions.where("part = 'train'"), onsets)
    thresholds = settle(mt.benign_thresholds(train, k, policies, fpr_targets), "thresholds")
    shown = predictions.where("part in ('val', 'test')")
    g = [*k, "part", "threshold_policy", "fpr_target"]
    flow = settle(td.first_detections(shown, td.attack_onsets(onsets), thresholds, k, ("part",)), "flow-ttd")
    window = settle(td.first_detections(
        shown, td.window_onsets(shown), thresholds, k, ("part",)), "window-ttd")
    delta = td.summarize_delta(td.ttd_runs(flow, window, [*k, "part"]), g).withColumn(
        "ttd_mode", F.lit("delta_window_minus_flow"))
    ttd = td.summarize_ttd(flow, g).withColumn("ttd_mode", F.lit("flow_onset")).unionByName(
        td.summarize_ttd(window, g).withColumn("ttd_mode", F.lit("window_onset")))
    return {
        "binary": mt.binary_metrics(shown, [*k, "part"], settled=True),
        "operating": mt.operating_points(shown, thresholds, k, ["part"]),
        "ttd": ttd.unionByName(delta, allowMissingColumns=True),
    }


def classes_of(train: DataFrame, label: str = "y_cat") -> list[str]:
    """Class names in the order of their numbers."""
    return [r[label] for r in encode_classes(train, label).orderBy("class_id").toLocalIterator()]


def with_class_ids(rows: DataFrame, classes: list[str], label: str = "y_cat") -> DataFrame:
    """Numeric class labels; a class that train does not have fails the job."""
    pos = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label))
    bad = F.raise_error(F.concat(F.lit("class unknown to train: "), F.coalesce(F.col(label), F.lit("null"))))
    return rows.withColumn(LABEL, F.when(pos > 0, (pos - 1).cast("double")).otherwise(bad.cast("double")))


def score_systems_multiclass(
    rows: DataFrame, net_features: list[str], rad_features: list[str], model: str,
    cfg: dict[str, Any] | None = None, seed: int = 0,
) -> tuple[DataFrame, ModelBundle]:
    """Class probabilities of every window by both modalities, their mean and the stacked head.

    Both modalities share one class order, that of the train rows, and a class train does not know
    fails the job. ``rows`` have part, y_cat, and ``fold`` for train rows, which get out-of-fold
    scores. Predictions are long: key, part, y_true, system, proba, y_pred, p_max.
    """
    keep = [c for c in rows.columns if c not in (*net_features, *rad_features)]
    rows = settle(rows, "experiment")
    classes = classes_of(rows.where("part = 'train'"))
    models: dict[str, Model] = {}
    scored = None
    for name, feats, column in (("network", net_features, "proba_net"), ("radio", rad_features, "proba_rad")):
        x = with_class_ids(assemble(rows, feats), classes).select(*keep, FEATURES, LABEL)
        x = settle(x, "assembled")
        train, rest = x.where("part = 'train'"), x.where("part <> 'train'")
        models[name] = fit(train, model, cfg, multiclass=True, seed=seed)
        both = oof_predict(train, model, cfg, seed, column, True).unionByName(predict_proba(models[name], rest, column))
        side = both.drop(FEATURES)
        scored = side if scored is None else scored.join(side.select(*WINDOW_KEY, column), WINDOW_KEY)
    scored = settle(scored, "base-scores")
    train, rest = scored.where("part = 'train'"), scored.where("part <> 'train'")
    models["stacked"] = fit_stacked_multiclass(train, LABEL)
    stacked = oof_stacked_multiclass(train, LABEL, out="proba_stacked").unionByName(
        predict_proba(models["stacked"], stack_features_multiclass(rest, "proba_net", "proba_rad"), "proba_stacked").drop(FEATURES))
    predictions = long_multiclass(stacked, [c for c in keep if c not in ("y_cat", "fold")], classes)
    return settle(predictions, "predictions"), ModelBundle("multiclass", models, net_features, rad_features, classes)


def long_multiclass(rows: DataFrame, keep: list[str], classes: list[str]) -> DataFrame:
    """One row per (window, system) from the probability arrays of the base and stacked models."""
    pairs = F.array(*[F.struct(F.lit(s).alias("system"), c.alias("proba")) for s, c in zip(SYSTEMS, (
        F.col("proba_net"), F.col("proba_rad"), fusion_mean_multiclass("proba_net", "proba_rad"), F.col("proba_stacked")))])
    each = rows.withColumn("_e", F.explode(pairs)).select(*keep, F.col("y_cat").alias("y_true"), "_e.system", F.col("_e.proba").alias("_raw"))
    return mt.predict_class(each, "_raw", classes).drop("_raw")


def evaluate_multiclass(predictions: DataFrame, classes: list[str]) -> dict[str, DataFrame]:
    """``metrics`` per system and part of val and test, and their ``confusion`` matrices."""
    shown = predictions.where("part in ('val', 'test')")
    keys = ["system", "part"]
    return {"metrics": mt.multiclass_metrics(shown, keys, classes), "confusion": mt.confusion_matrix(shown, keys, classes)}


# ---- search and replay -------------------------------------------------------------------


def sample_params(space: dict[str, tuple], trials: int, seed: int) -> list[dict[str, Any]]:
    """Seeded draws from bounded ranges: (low, high), (low, high, "log") or a list of choices."""
    rng = random.Random(seed)
    draws = []
    for _ in range(trials):
        p: dict[str, Any] = {}
        for name, spec in space.items():
            if isinstance(spec, list):
                p[name] = rng.choice(spec)
            elif len(spec) == 3:
                low, high = spec[0], spec[1]
                p[name] = low * (high / low) ** rng.random()
            elif isinstance(spec[0], int):
                p[name] = rng.randint(spec[0], spec[1])
            else:
                p[name] = rng.uniform(spec[0], spec[1])
        draws.append(p)
    return draws


def validation_loss(scored: DataFrame, multiclass: bool) -> tuple[float | None, bool]:
    """(log-loss, usable): of the true class's clipped probability; scores outside [0, 1] are no use."""
    if multiclass:
        p, values = F.try_element_at("proba", (F.col(LABEL) + 1).cast("int")), F.col("proba")
        bad = F.exists(values, lambda v: ~F.coalesce(v.between(0, 1), F.lit(False)) | F.isnan(v))
    else:
        p = F.when(F.col(LABEL) == 1, F.col("score")).otherwise(1 - F.col("score"))
        bad = ~finite("score") | (F.col("score") < 0) | (F.col("score") > 1)
    clipped = F.least(F.greatest(p, F.lit(mt.LOG_CLIP)), F.lit(1.0 - mt.LOG_CLIP))
    row = scored.agg(F.avg(-F.ln(clipped)).alias("loss"), F.max(bad.cast("int")).alias("bad")).first()
    return row["loss"], row["bad"] == 0


def param_search(
    train: DataFrame, val: DataFrame, model: str, space: dict[str, tuple], trials: int = 50, seed: int = 0,
    multiclass: bool = False, threads: int = FITS_AT_ONCE,
) -> tuple[list[dict[str, Any]], dict[str, Any]]:
    """Parameter sets ranked by validation log-loss, best first, and the best set.

    Trials run side by side over the same written tables (features and label). A trial with
    scores that are not finite or leave [0, 1] is marked invalid and ranked last.
    """
    train, val = (settle(df.select(FEATURES, LABEL), "search") for df in (train, val))
    draws = sample_params(space, trials, seed)

    def trial(params: dict[str, Any]) -> tuple[float | None, bool]:
        m = fit(train, model, params, multiclass, seed)
        return validation_loss(predict_proba(m, val) if multiclass else predict_binary(m, val), multiclass)

    losses = at_once(train.sparkSession, [lambda p=p: trial(p) for p in draws], threads)
    results = [
        {"trial": i, "params": p, "log_loss": loss if ok else None, "valid": ok} for i, (p, (loss, ok)) in enumerate(zip(draws, losses))]
    results.sort(key=lambda r: (not r["valid"], r["log_loss"] if r["valid"] else 0.0, r["trial"]))
    if not results or not results[0]["valid"]:
        raise ValueError("no trial gave usable scores")
    return results, results[0]["params"]


def search_all(
    rows: DataFrame, features: dict[str, list[str]], model: str, space: dict[str, tuple], trials: int = 50, seed: int = 0,
) -> list[dict[str, Any]]:
    """Searches of both tasks for each modality: task, modality, place, trial, params, log_loss, valid.

    ``rows`` have part, y_bin and y_cat; train rows are fitted, val rows decide.
    """
    out = []
    for modality, columns in features.items():
        for task in ("binary", "multiclass"):
            many = task == "multiclass"
            x = with_class_ids(assemble(rows, columns), classes_of(rows.where("part = 'train'"))) if many else assemble(rows, columns, "y_bin")
            ranked, _ = param_search(x.where("part = 'train'"), x.where("part = 'val'"), model, space, trials, seed, many)
            out += [{"task": task, "modality": modality, "place": i, **r} for i, r in enumerate(ranked)]
    return out


@dataclass
class ModelBundle:
    """The models of one experiment, with all that scoring needs: features per modality and class order."""

    task: str
    models: dict[str, Model]
    net_features: list[str]
    rad_features: list[str]
    classes: list[str]

    def save(self, path: str) -> None:
        """One folder: a model folder per modality and head, and bundle.json, written last."""
        for name, m in self.models.items():
            save_model(m, os.path.join(path, name))
        spark = SparkSession.getActiveSession()
        facts = {"task": self.task, "models": sorted(self.models), "net_features": self.net_features, "rad_features": self.rad_features, "classes": self.classes}
        spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(os.path.join(path, "bundle"))

    @classmethod
    def load(cls, spark, path: str) -> ModelBundle:
        facts = json.loads(spark.read.text(os.path.join(path, "bundle")).first()["value"])
        models = {name: load_model(os.path.join(path, name)) for name in facts["models"]}
        return cls(facts["task"], models, facts["net_features"], facts["rad_features"], facts["classes"])

    def predict(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """Long predictions of all four systems by the full models, without training again."""
        scored = None
        many = self.task == "multiclass"
        for name, feats, column in (("network", self.net_features, "net"), ("radio", self.rad_features, "rad")):
            x = assemble(rows, feats).select(*keep, *[c for c in WINDOW_KEY if c not in keep], FEATURES)
            side = (predict_proba(self.models[name], x, f"proba_{column}") if many else predict_binary(self.models[name], x, f"p_{column}")).drop(FEATURES)
            scored = side if scored is None else scored.join(side.select(*WINDOW_KEY, side.columns[-1]), WINDOW_KEY)
        if many:
            x = predict_proba(self.models["stacked"], stack_features_multiclass(scored, "proba_net", "proba_rad"), "proba_stacked").drop(FEATURES)
            return long_multiclass(x, [c for c in keep if c != "y_cat"], self.classes)
        return long_binary(predict_stacked(self.models["stacked"], scored, "p_stacked"), keep)


def save_model(model: Model, path: str) -> None:
    PipelineModel(stages=[model]).write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def replay_violations(model: Model, rows: DataFrame, stored: DataFrame, key: list[str], tol: float = 1e-5) -> DataFrame:
    """Keys whose score from the model differs from the stored one, or that one side lacks."""
    fresh = predict_binary(model, rows, "fresh").select(*key, "fresh")
    j = fresh.join(stored.select(*key, F.col("score").alias("stored")), key, "full")
    gap = F.abs(F.col("fresh") - F.col("stored"))
    return j.where(F.col("fresh").isNull() | F.col("stored").isNull() | (gap > tol)).select(*key, "fresh", "stored")


def replay_fusion_violations(predictions: DataFrame, key: list[str], tol: float = 1e-5) -> DataFrame:
    """Stored mean-fusion scores that do not follow from the stored base scores."""
    def of(system: str, name: str) -> DataFrame:
        return predictions.where(F.col("system") == system).select(*key, F.col("score").alias(name))

    j = of("network_only", "a").join(of("radio_only", "b"), key).join(of("fusion_mean", "m"), key)
    again = fusion_mean_binary("a", "b")
    return j.where(F.abs(again - F.col("m")) > tol).select(*key, again.alias("fresh"), F.col("m").alias("stored"))


def replay_bundle(bundle: ModelBundle, rows: DataFrame, stored: DataFrame, tol: float = 1e-5) -> DataFrame:
    """Stored predictions of all systems against those of a reloaded bundle: (key, system, rule).

    Labels must be equal, scores and probabilities within ``tol``; a window or system that one side
    lacks breaks ``present``. ``stored`` is long, as score_systems and score_systems_multiclass give it.
    """
    key = [*WINDOW_KEY, "system"]
    many = bundle.task == "multiclass"
    value, label = ("proba", "y_pred") if many else ("score", "score")
    fresh = bundle.predict(rows, [*WINDOW_KEY, "y_cat"] if many else WINDOW_KEY)
    a = fresh.select(*key, F.struct(F.col(value).alias("v"), F.col(label).cast("string").alias("l")).alias("a"))
    b = stored.select(*key, F.struct(F.col(value).alias("v"), F.col(label).cast("string").alias("l")).alias("b"))
    j = a.join(b, key, "full")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    if many:
        near = ~F.exists(F.zip_with("a.v", "b.v", lambda x, y: ~F.coalesce(F.abs(x - y) <= tol, F.lit(False))), lambda off: off)
        same = F.col("a.l") == F.col("b.l")
    else:
        near, same = F.abs(F.col("a.v") - F.col("b.v")) <= tol, F.lit(True)
    rules = F.array_compact(F.array(
        F.when(~both, "present"), F.when(both & ~F.coalesce(near, F.lit(False)), "value"), F.when(both & ~F.coalesce(same, F.lit(False)), "label")))
    return j.select(*key, F.explode(rules).alias("rule"))
