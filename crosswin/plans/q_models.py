"""Detectors trained on the vectors: the first half is one modality, the second the other."""

from __future__ import annotations

import math

from pyspark.sql import Window, functions as F

from crosswin.functions.expr import hash_number
from crosswin.operators import metrics as mt
from crosswin.operators import models as md
from crosswin.operators import ttd
from crosswin.operators.scale import settle
from crosswin.plans import bindings as b
from crosswin.plans import q_checks as qc
from crosswin.plans import q_scores as qs
from crosswin.plans.registry import query, r4, rounded, sql_r4

NET = [f"n{i}" for i in range(32)]
RAD = [f"r{i}" for i in range(32)]
SMALL = {"rf": {"n_estimators": 10, "max_depth": 5}, "boosted_trees": {"n_estimators": 5, "max_depth": 3}, "logreg": {}}


def rows(spark, d):
    """Windows of 40 runs, 32 network and 32 radio features, folds by run."""
    x, label = F.col("embedding"), F.col("label")
    run = F.col("vec_id") % 40
    h = hash_number(F.concat(F.lit("run"), run.cast("string"))) % 10
    family = F.when(run % 3 == 0, "Benign").otherwise("DoS")
    return settle(b.table(spark, d, "embeddings").select(
        run.cast("string").alias("run_id"), family.alias("family"),
        (F.floor(F.col("vec_id") / 40) * 2).alias("window_start_s"), (F.floor(F.col("vec_id") / 40) * 2 + 10).alias("window_end_s"),
        ((run % 3 != 0) & (label >= 3)).cast("int").alias("y_bin"),
        F.element_at(F.array(*[F.lit(f) for f in b.FAMILIES]), (label % 3 + 1).cast("int")).alias("y_cat"),
        F.when(h < 6, "train").when(h < 8, "val").otherwise("test").alias("part"), (run % 3).cast("int").alias("fold0"),
        (F.floor(run / 3) % 3).cast("int").alias("fold"),
        *[(x[i].cast("double") + F.when(label >= 3, 0.1).otherwise(0.0)).alias(n) for i, n in enumerate(NET)],
        *[(x[32 + i].cast("double") + F.when(run % 3 != 0, 0.1).otherwise(0.0)).alias(n) for i, n in enumerate(RAD)],
    ).drop("fold0"), "model-rows")


ROWS_SQL = """
r AS (
  SELECT CAST(vec_id % 40 AS VARCHAR) AS run_id, vec_id // 40 * 2 AS window_start_s, CAST('0x' || substr(md5('run' || (vec_id % 40)), 1, 8) AS BIGINT) % 10 AS h,
         CASE WHEN vec_id % 40 % 3 <> 0 AND label >= 3 THEN 1 ELSE 0 END::BIGINT AS y_bin FROM embeddings),
w AS (SELECT run_id, window_start_s::BIGINT AS window_start_s, y_bin, CASE WHEN h < 6 THEN 'train' WHEN h < 8 THEN 'val' ELSE 'test' END AS part FROM r)"""
TRAINED_SQL = f"WITH {ROWS_SQL} SELECT run_id, window_start_s, part, y_bin, TRUE AS scored FROM w WHERE part <> 'train'"


def _scores(spark, d, model):
    x = md.assemble(rows(spark, d), NET, "y_bin")
    m = md.fit(x.where("part = 'train'"), model, SMALL[model], seed=1)
    scored = F.col("score").between(0, 1).alias("scored")  # weights can't be compared, all else can
    return rounded(md.predict_binary(m, x.where("part <> 'train'")).select("run_id", "window_start_s", "part", "y_bin", scored))


@query("train_logreg", "M12 M15", TRAINED_SQL)
def _train_logreg(spark, d):
    return _scores(spark, d, "logreg")


@query("train_random_forest", "M13 M15", TRAINED_SQL)
def _train_random_forest(spark, d):
    return _scores(spark, d, "rf")


@query("train_boosted_trees", "M14 M15", TRAINED_SQL)
def _train_boosted_trees(spark, d):
    return _scores(spark, d, "boosted_trees")


def multiclass(spark, d, model, feats):
    r = rows(spark, d)
    classes = md.classes_of(r.where("part = 'train'"))
    x = md.with_class_ids(md.assemble(r, feats), classes)
    return classes, x, md.fit(x.where("part = 'train'"), model, SMALL[model], multiclass=True, seed=1)


@query("train_multiclass", "M12 M13 M14 M15 M23 M36", f"""WITH {ROWS_SQL}
SELECT model, count(*) AS n, TRUE AS rates_in_range, TRUE AS loss_is_positive FROM w, (SELECT unnest(['logreg', 'rf', 'boosted_trees']) AS model) WHERE part = 'test' GROUP BY 1""")
def _train_multiclass(spark, d):
    out = None
    for model in ("logreg", "rf", "boosted_trees"):
        classes, x, m = multiclass(spark, d, model, NET)
        p = md.predict_proba(m, x.where("part = 'test'"), "raw").withColumn("model", F.lit(model)).withColumn("y_true", F.col("y_cat"))
        r = mt.multiclass_metrics(settle(mt.predict_class(p.drop(md.FEATURES), "raw", classes), "mc"), ["model"], classes)
        out = r if out is None else out.unionByName(r)
    rates = F.col("acc").between(0, 1) & F.col("f1_macro").between(0, 1) & F.col("f1_weighted").between(0, 1)
    return out.select("model", "n", rates.alias("rates_in_range"), (F.col("log_loss") > 0).alias("loss_is_positive"))


@query("oof_predict", "M16", """
SELECT CAST(vec_id % 40 AS VARCHAR) AS run_id, CAST(vec_id // 40 * 2 AS BIGINT) AS window_start_s, CAST(vec_id % 40 // 3 % 3 AS BIGINT) AS fold, TRUE AS scored FROM embeddings
WHERE CAST('0x' || substr(md5('run' || (vec_id % 40)), 1, 8) AS BIGINT) % 10 < 6""")
def _oof_predict(spark, d):
    x = md.assemble(rows(spark, d).where("part = 'train'"), NET, "y_bin")
    return rounded(md.oof_predict(x, "logreg").select(
        "run_id", "window_start_s", "fold", F.col("score").between(0, 1).alias("scored")))


@query("fusion_stacked", "M18", f"WITH {b.SCORES_SQL} SELECT doc_id, part, CAST(y_bin AS BIGINT) AS y_bin, TRUE AS scored FROM scores")
def _fusion_stacked(spark, d):
    s = settle(b.scores(spark, d), "scores")
    head = md.fit_stacked(s.where("part = 'train'"))
    train = md.oof_stacked(s.where("part = 'train'"))
    rest = md.predict_stacked(head, s.where("part <> 'train'"))
    keep = ["doc_id", "part", "y_bin", F.col("score").between(0, 1).alias("scored")]
    return rounded(train.select(*keep).unionByName(rest.select(*keep)))


@query("fusion_stacked_multiclass", "M19", f"WITH {ROWS_SQL} SELECT run_id, window_start_s, 3::BIGINT AS n_classes, TRUE AS sums_to_one FROM w WHERE part = 'test'")
def _fusion_stacked_multiclass(spark, d):
    base = None
    for feats, name in ((NET, "proba_net"), (RAD, "proba_rad")):
        classes, x, m = multiclass(spark, d, "logreg", feats)
        p = md.predict_proba(m, x, name).select("run_id", "window_start_s", "part", md.LABEL, name)
        base = p if base is None else base.join(p.drop("part", md.LABEL), ["run_id", "window_start_s"])
    base = settle(base, "stack")
    head = md.fit_stacked_multiclass(base.where("part = 'train'"), md.LABEL)
    test = md.stack_features_multiclass(base.where("part = 'test'"), "proba_net", "proba_rad")
    total = F.aggregate("proba", F.lit(0.0), lambda a, p: a + p)
    return rounded(md.predict_proba(head, test).select(
        "run_id", "window_start_s", F.size("proba").alias("n_classes"), (F.abs(total - 1) < 1e-9).alias("sums_to_one")))


@query("experiment", "M31 M16 M17 M18", f"""WITH {ROWS_SQL}
SELECT system, part, threshold_policy, fpr_target, count(*) AS n, sum(y_bin)::BIGINT AS positives, TRUE AS in_range
FROM w, (SELECT unnest(['network_only', 'radio_only', 'fusion_mean', 'fusion_stacked']) AS system), (SELECT unnest({qs.POL}) AS threshold_policy), (SELECT unnest([0.01, 0.1]::DOUBLE[]) AS fpr_target)
WHERE part <> 'train' GROUP BY 1, 2, 3, 4""")
def _experiment(spark, d):
    r = rows(spark, d)
    preds, _ = md.score_systems(r, NET, RAD, "logreg")
    onsets = ttd.onset_map(r.groupBy("run_id").agg(
        F.min("family").alias("family"), F.lit(0).alias("ord"),
        F.coalesce(F.min(F.when(F.col("y_bin") == 1, F.col("window_start_s") + 0.5)), F.lit(0.5)).alias("t_first_attack_flow_s")))
    out = md.evaluate_all(preds, onsets, qs.POL, [0.01, 0.1])["operating"]
    in_range = F.coalesce(F.col("tpr"), F.lit(0.0)).between(0, 1) & F.coalesce(F.col("fpr"), F.lit(0.0)).between(0, 1)
    return out.select(
        "system", "part", "threshold_policy", "fpr_target", F.expr("tn + fp + fn + tp").alias("n"), F.expr("fn + tp").alias("positives"), in_range.alias("in_range"))


EV_SQL = qs.ONSET_SQL + """,
att AS (SELECT run_id, onset FROM ons WHERE family <> 'Benign'),
won AS (SELECT run_id, min(CASE WHEN y_bin = 1 THEN window_start_s END)::DOUBLE AS onset FROM scores WHERE family <> 'Benign' AND part <> 'train' GROUP BY 1),
fl AS (
  SELECT c.system, c.part, threshold_policy, fpr_target, c.run_id, max(a.onset) AS onset, min(CASE WHEN window_end_s >= a.onset AND score >= threshold THEN window_end_s END) AS det
  FROM cl c JOIN att a USING (run_id) JOIN thr USING (system) WHERE part <> 'train' GROUP BY 1, 2, 3, 4, 5),
wi AS (
  SELECT c.system, c.part, threshold_policy, fpr_target, c.run_id, max(a.onset) AS onset, min(CASE WHEN window_end_s >= a.onset AND score >= threshold THEN window_end_s END) AS det
  FROM cl c JOIN won a USING (run_id) JOIN thr USING (system) WHERE part <> 'train' GROUP BY 1, 2, 3, 4, 5),
bo AS (SELECT *, 'flow_onset' AS ttd_mode FROM fl UNION ALL SELECT *, 'window_onset' FROM wi)"""


@query("evaluate_all", "M31", f"""WITH {EV_SQL}
SELECT system, part, threshold_policy, fpr_target, ttd_mode, count(*) AS n_attack_runs, {sql_r4('count(det)::DOUBLE / count(*)')} AS detect_rate,
       {sql_r4('quantile_cont(CASE WHEN det IS NOT NULL THEN greatest(det - onset, 0)::DOUBLE END, 0.5)')} AS ttd_median, NULL::BIGINT AS n_delta, NULL::DOUBLE AS delta_median
FROM bo GROUP BY 1, 2, 3, 4, 5
UNION ALL SELECT system, part, threshold_policy, fpr_target, 'delta_window_minus_flow', NULL, NULL, NULL,
       count(CASE WHEN f.det IS NOT NULL AND w.det IS NOT NULL THEN 1 END),
       {sql_r4('quantile_cont(CASE WHEN f.det IS NOT NULL AND w.det IS NOT NULL THEN (greatest(w.det - w.onset, 0) - greatest(f.det - f.onset, 0))::DOUBLE END, 0.5)')}
FROM fl f FULL JOIN wi w USING (system, part, threshold_policy, fpr_target, run_id) GROUP BY 1, 2, 3, 4, 5""")
def _evaluate_all(spark, d):
    p = qs.scored(spark, d)
    t = md.evaluate_all(p, qs.run_onsets(spark, d), qs.POL, qs.FPR)["ttd"]
    return t.select("system", "part", "threshold_policy", "fpr_target", "ttd_mode", "n_attack_runs", r4("detect_rate"),
                    r4(ttd.finite_or_null("ttd_median"), "ttd_median"), "n_delta", r4("delta_median"))


SPACE = {"C": (0.01, 10.0, "log"), "max_iter": [20, 50]}


@query("param_search", "M33", f"""WITH {ROWS_SQL}
SELECT task, modality, CAST(place AS BIGINT) AS place, TRUE AS valid, TRUE AS in_order, TRUE AS beats_a_guess
FROM (SELECT unnest(['binary', 'multiclass']) AS task), (SELECT unnest(['network', 'radio']) AS modality), (SELECT unnest(range(3)) AS place) WHERE EXISTS (SELECT * FROM w)""")
def _param_search(spark, d):
    """Both tasks for each modality, ranked by validation loss; three trials each."""
    r = rows(spark, d)
    found = md.search_all(r, {"network": NET, "radio": RAD}, "logreg", SPACE, trials=3, seed=5)
    found = [(f["task"], f["modality"], f["place"], f["trial"], f["log_loss"], f["valid"]) for f in found]
    ranked = spark.createDataFrame(found, "task string, modality string, place long, trial long, log_loss double, valid boolean")
    w = Window.partitionBy("task", "modality").orderBy("place")
    in_order = F.coalesce(F.col("log_loss") >= F.lag("log_loss").over(w), F.lit(True))
    # the classes are drawn at random in these tables, so only the binary task can be learnt
    guess = F.when(F.col("task") == "binary", math.log(2) + 0.05).otherwise(F.lit(float("inf")))
    ranked = ranked.select("task", "modality", "place", "valid", in_order.alias("in_order"), (F.col("log_loss") < guess).alias("beats_a_guess"))
    return ranked.join(r.limit(1).select(F.lit(True).alias("has_rows")), how="cross").drop("has_rows")


@query("experiment_multiclass", "M31 M16 M17 M19 M23 M36", f"""WITH {ROWS_SQL},
e AS (SELECT CAST(vec_id % 40 AS VARCHAR) AS run_id, vec_id // 40 * 2 AS window_start_s, {b.FAMILY_SQL}[CAST(label % 3 AS INT) + 1] AS y_true FROM embeddings)
SELECT system, part, y_true, count(*)::BIGINT AS n, TRUE AS rates_in_range, TRUE AS loss_is_positive
FROM w JOIN e USING (run_id, window_start_s), (SELECT unnest(['network_only', 'radio_only', 'fusion_mean', 'fusion_stacked']) AS system) WHERE part <> 'train' GROUP BY ALL""")
def _experiment_multiclass(spark, d):
    """Rows of the confusion matrices of all four systems with one class order."""
    predictions, bundle = md.score_systems_multiclass(rows(spark, d), NET, RAD, "logreg")
    out = md.evaluate_multiclass(predictions, bundle.classes)
    rates = F.col("acc").between(0, 1) & F.col("f1_macro").between(0, 1) & F.col("f1_weighted").between(0, 1)
    facts = out["metrics"].select("system", "part", rates.alias("rates_in_range"), (F.col("log_loss") > 0).alias("loss_is_positive"))
    true_counts = out["confusion"].groupBy("system", "part", "y_true").agg(F.sum("n").alias("n"))
    return true_counts.where("n > 0").join(facts, ["system", "part"])


def moved_rows():
    return F.col("window_start_s") % 20 == 0


@query("replay_bundle", "M34 K8", f"""WITH {ROWS_SQL}
SELECT run_id, window_start_s, window_start_s + 10 AS window_end_s, 'fusion_stacked' AS system, 'value' AS rule FROM w WHERE window_start_s % 20 = 0
UNION ALL SELECT run_id, window_start_s, window_start_s + 10, 'radio_only', 'present' FROM w WHERE window_start_s % 20 = 10""")
def _replay_bundle(spark, d):
    """All four binary systems scored again by the saved models; some stored scores were changed or lost."""
    r = rows(spark, d)
    _, bundle = md.score_systems(r, NET, RAD, "logreg")
    path = qc.fresh(spark, "bundle")
    bundle.save(path)
    stored = settle(bundle.predict(r, [*md.WINDOW_KEY]), "stored")
    off = moved_rows() & (F.col("system") == "fusion_stacked")
    stored = stored.withColumn("score", F.when(off, F.col("score") + 0.25).otherwise(F.col("score")))
    stored = stored.where(~((F.col("window_start_s") % 20 == 10) & (F.col("system") == "radio_only")))
    return rounded(md.replay_bundle(md.ModelBundle.load(spark, path), r, stored))


@query("replay_bundle_multiclass", "M34 K8", f"""WITH {ROWS_SQL}
SELECT run_id, window_start_s, window_start_s + 10 AS window_end_s, unnest(['fusion_mean', 'fusion_stacked']) AS system, 'label' AS rule FROM w WHERE window_start_s % 20 = 0""")
def _replay_bundle_multiclass(spark, d):
    """Class labels of mean and stacked fusion compared exactly with those of the reloaded models."""
    r = rows(spark, d)
    _, bundle = md.score_systems_multiclass(r, NET, RAD, "logreg")
    path = qc.fresh(spark, "bundle")
    bundle.save(path)
    stored = settle(bundle.predict(r, [*md.WINDOW_KEY, "y_cat"]), "stored")
    off = moved_rows() & F.col("system").startswith("fusion")
    stored = stored.withColumn("y_pred", F.when(off, F.concat("y_pred", F.lit("?"))).otherwise(F.col("y_pred")))
    return rounded(md.replay_bundle(md.ModelBundle.load(spark, path), r, stored))


@query("oof_quality", "M16", f"""WITH {ROWS_SQL}
SELECT modality, count(*) AS n, sum(y_bin)::BIGINT AS positives, TRUE AS ranks_above_chance FROM w, (SELECT unnest(['network', 'radio']) AS modality) WHERE part = 'train' GROUP BY 1""")
def _oof_quality(spark, d):
    """Out-of-fold scores of all 32 features of each modality rank above chance."""
    r = rows(spark, d).where("part = 'train'")
    out = None
    for name, feats in (("network", NET), ("radio", RAD)):
        s = md.oof_predict(md.assemble(r, feats, "y_bin"), "logreg").select(F.lit(name).alias("modality"), "y_bin", "score")
        out = s if out is None else out.unionByName(s)
    m = mt.binary_metrics(out, ["modality"])
    return m.select("modality", "n", F.round(F.col("pos_rate") * F.col("n")).cast("bigint").alias("positives"), (F.col("roc_auc") > 0.5).alias("ranks_above_chance"))


@query("replay_check", "M34 K8", f"WITH {ROWS_SQL} SELECT run_id, window_start_s, TRUE AS moved FROM w WHERE window_start_s % 20 = 0")
def _replay_check(spark, d):
    x = md.assemble(rows(spark, d), NET, "y_bin")
    m = md.fit(x.where("part = 'train'"), "rf", SMALL["rf"], seed=1)
    moved = F.when(F.col("window_start_s") % 20 == 0, F.col("score") + 0.25).otherwise(F.col("score"))  # one stored score in ten is wrong
    stored = md.predict_binary(m, x).select("run_id", "window_start_s", moved.alias("score"))
    path, stored = qc.fresh(spark, "model"), settle(stored, "stored")
    md.save_model(m, path)
    found = md.replay_violations(md.load_model(path), x, stored, ["run_id", "window_start_s"])
    return rounded(found.select("run_id", "window_start_s", (F.abs(F.col("stored") - F.col("fresh") - 0.25) < 1e-6).alias("moved")))


@query("replay_fusion", "M34", f"""WITH {b.SCORES_SQL}
SELECT doc_id, {sql_r4('(coalesce(p_net, 0.5) + p_rad) / 2')} AS fresh, {sql_r4('(coalesce(p_net, 0.5) + p_rad) / 2 + 0.25')} AS stored FROM scores WHERE doc_id % 9 = 0""")
def _replay_fusion(spark, d):
    p = qs.scored(spark, d)
    off = (F.col("system") == "fusion_mean") & (F.col("doc_id") % 9 == 0)
    p = p.withColumn("score", F.when(off, F.col("score") + 0.25).otherwise(F.col("score")))
    return rounded(md.replay_fusion_violations(p, ["doc_id"]))
