"""Metrics, thresholds, fusion and time to detect on scored windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosswin.functions import expr as ex
from crosswin.operators import fusion as fu
from crosswin.operators import metrics as mt
from crosswin.operators import ttd
from crosswin.operators.scale import settle
from crosswin.plans import bindings as b
from crosswin.plans.registry import query, r4, rounded, sql_r4

KEYS = ["system", "part"]
POL = list(mt.POLICIES)
FPR = [0.01, 0.05, 0.1]

LONG_SQL = b.SCORES_SQL + """,
lng AS (
  SELECT s.* EXCLUDE (p_raw), system, CASE system WHEN 'network_only' THEN p_net WHEN 'radio_only' THEN p_rad ELSE (coalesce(p_net, 0.5) + p_rad) / 2 END AS score
  FROM scores s, (SELECT unnest(['network_only', 'radio_only', 'fusion_mean']) AS system)),
cl AS MATERIALIZED (SELECT *, coalesce(score, 0) AS s FROM lng)"""


def scored(spark, d):
    s = b.scores(spark, d)
    pairs = F.array(*[F.struct(F.lit(n).alias("system"), c.alias("score")) for n, c in (
        ("network_only", F.col("p_net")), ("radio_only", F.col("p_rad")),
        ("fusion_mean", fu.fusion_mean_binary("p_net", "p_rad")))])
    return s.withColumn("_e", F.explode(pairs)).select(*s.columns, "_e.system", "_e.score")


@query("sanitize_scores", "P13", f"""WITH {b.SCORES_SQL}
SELECT doc_id, {sql_r4('coalesce(p_net, 0.5)')} AS p, {sql_r4('least(greatest(coalesce(p_net, 0.5), 0.1), 0.9)')} AS clipped,
       {sql_r4('ln(least(greatest(coalesce(p_net, 0.5), 1e-6), 1 - 1e-6) / (1 - least(greatest(coalesce(p_net, 0.5), 1e-6), 1 - 1e-6)))')} AS logit FROM scores""")
def _sanitize_scores(spark, d):
    return b.scores(spark, d).select(
        "doc_id", r4(fu.sanitize_score("p_net"), "p"), r4(ex.clip_unit("p_net", 0.1), "clipped"), r4(ex.logit("p_net"), "logit"))


@query("sanitize_proba", "P14", f"WITH {b.MULTI_SQL} SELECT vec_id, system, j, {sql_r4('prob')} AS prob FROM mc_p")
def _sanitize_proba(spark, d):
    return b.multiclass_scores(spark, d).select(
        "vec_id", "system", F.posexplode(ex.sanitize_proba("raw")).alias("j", "p")).select(
        "vec_id", "system", F.col("j").cast("bigint").alias("j"), r4("p", "prob"))


@query("fusion_mean", "M17", f"WITH {b.SCORES_SQL} SELECT doc_id, {sql_r4('(coalesce(p_net, 0.5) + p_rad) / 2')} AS score FROM scores")
def _fusion_mean(spark, d):
    return b.scores(spark, d).select("doc_id", r4(fu.fusion_mean_binary("p_net", "p_rad"), "score"))


@query("fusion_mean_multiclass", "M17", f"""WITH {b.MULTI_SQL},
m AS (SELECT n.vec_id, n.j, (n.prob + r.prob) / 2 AS p FROM mc_p n JOIN mc_p r USING (vec_id, j) WHERE n.system = 'network_only' AND r.system = 'radio_only')
SELECT vec_id, j, {sql_r4('p / sum(p) OVER (PARTITION BY vec_id)')} AS prob FROM m""")
def _fusion_mean_multiclass(spark, d):
    p = b.multiclass_scores(spark, d).select("vec_id", "system", ex.sanitize_proba("raw").alias("p"))
    n = p.where("system = 'network_only'").select("vec_id", F.col("p").alias("a"))
    r = p.where("system = 'radio_only'").select("vec_id", F.col("p").alias("b"))
    return n.join(r, "vec_id").select("vec_id", F.posexplode(fu.fusion_mean_multiclass("a", "b")).alias("j", "p")).select(
        "vec_id", F.col("j").cast("bigint").alias("j"), r4("p", "prob"))


@query("score_ranks", "W10", f"""WITH {LONG_SQL},
g AS (SELECT system, part, s, count(*) AS n, CAST(sum(y_bin) AS BIGINT) AS pos FROM cl GROUP BY 1, 2, 3)
SELECT system, part, {sql_r4('s')} AS s, n, pos, n - pos AS neg, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(n - pos) OVER w AS BIGINT) AS fp
FROM g WINDOW w AS (PARTITION BY system, part ORDER BY s DESC)""")
def _score_ranks(spark, d):
    return rounded(mt.score_ranks(scored(spark, d), KEYS))


BIN_SQL = LONG_SQL + """,
rk AS (SELECT system, part, y_bin, rank() OVER (PARTITION BY system, part ORDER BY s) + (count(*) OVER (PARTITION BY system, part, s) - 1) / 2.0::DOUBLE AS r FROM cl),
au AS (SELECT system, part, CASE WHEN min(y_bin) < max(y_bin) THEN (sum(r) FILTER (y_bin = 1) - sum(y_bin) * (sum(y_bin) + 1) / 2.0::DOUBLE) / (sum(y_bin) * (count(*) - sum(y_bin)))::DOUBLE END AS roc_auc FROM rk GROUP BY 1, 2),
gg AS (SELECT system, part, s, sum(y_bin) AS pos, count(*) AS n FROM cl GROUP BY 1, 2, 3),
cm AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS m FROM gg WINDOW w AS (PARTITION BY system, part ORDER BY s DESC)),
ap AS (SELECT system, part, sum(pos::DOUBLE * tp / m) / sum(pos) AS pr_auc FROM cm GROUP BY 1, 2),
eb AS (SELECT system, part, greatest(least(floor(p * 15) + CASE WHEN p < floor(p * 15) * (1.0::DOUBLE / 15) THEN -1 WHEN p >= (floor(p * 15) + 1) * (1.0::DOUBLE / 15) THEN 1 ELSE 0 END, 14), 0) AS bin, count(*) AS n, avg(y_bin) AS acc, avg(p) AS conf
       FROM (SELECT *, least(greatest(s, 1e-15), 1 - 1e-15) AS p FROM cl) GROUP BY 1, 2, 3),
ec AS (SELECT system, part, sum(n * abs(acc - conf)) / sum(n) AS ece FROM eb GROUP BY 1, 2),
bs AS (
  SELECT system, part, count(*) AS n, avg(y_bin) AS pos_rate, avg((s - y_bin) * (s - y_bin)) AS brier,
         avg(-(y_bin * ln(greatest(least(s, 1 - 2.220446049250313e-16), 2.220446049250313e-16)) + (1 - y_bin) * ln(1 - greatest(least(s, 1 - 2.220446049250313e-16), 2.220446049250313e-16)))) AS log_loss
  FROM cl GROUP BY 1, 2)"""


@query("binary_metrics", "M20", f"""WITH {BIN_SQL}
SELECT system, part, n, {', '.join(f'{sql_r4(c)} AS {c}' for c in ('pos_rate', 'brier', 'log_loss', 'roc_auc', 'pr_auc', 'ece'))},
       {sql_r4('pr_auc - pos_rate')} AS pr_lift, {sql_r4('pr_auc / pos_rate')} AS pr_ratio
FROM bs JOIN au USING (system, part) JOIN ap USING (system, part) JOIN ec USING (system, part)""")
def _binary_metrics(spark, d):
    return rounded(mt.binary_metrics(scored(spark, d), KEYS))


@query("calibration_error", "M21", f"WITH {BIN_SQL} SELECT system, part, {sql_r4('ece')} AS ece FROM ec")
def _calibration_error(spark, d):
    return rounded(mt.calibration_error(scored(spark, d), KEYS))


@query("pr_lift", "M22", f"""WITH {BIN_SQL}
SELECT system, part, {sql_r4('pr_auc - pos_rate')} AS pr_lift, {sql_r4('pr_auc / pos_rate')} AS pr_ratio FROM bs JOIN ap USING (system, part)""")
def _pr_lift(spark, d):
    return rounded(mt.binary_metrics(scored(spark, d), KEYS).select("system", "part", "pr_lift", "pr_ratio"))


ONSET_SQL = LONG_SQL + """,
sm AS (SELECT run_id, min(family) AS family, min(doc_id) AS ord, min(window_start_s) + 300.0::DOUBLE AS t_first FROM scores GROUP BY 1),
ons AS (SELECT run_id, family, ord, CASE WHEN family <> 'Benign' THEN t_first END AS onset FROM sm),
sel AS (
  SELECT c.*, p AS threshold_policy FROM cl c JOIN ons o USING (run_id), (SELECT unnest(['benign_runs_only', 'pre_attack', 'all_benign_labeled']) AS p)
  WHERE part = 'train' AND CASE p WHEN 'benign_runs_only' THEN lower(trim(c.family)) = 'benign' WHEN 'pre_attack' THEN c.family = 'Benign' OR c.window_end_s < o.onset ELSE y_bin = 0 END),
ft AS (SELECT unnest([0.01, 0.05, 0.1]::DOUBLE[]) AS fpr_target),
thr AS MATERIALIZED (
  SELECT system, threshold_policy, 0.01::DOUBLE AS fpr_target, quantile_cont(score, 0.99) AS threshold FROM sel GROUP BY 1, 2
  UNION ALL SELECT system, threshold_policy, 0.05, quantile_cont(score, 0.95) FROM sel GROUP BY 1, 2
  UNION ALL SELECT system, threshold_policy, 0.1, quantile_cont(score, 0.9) FROM sel GROUP BY 1, 2)"""


def run_onsets(spark, d):
    summary = b.scores(spark, d).groupBy("run_id").agg(
        F.min("family").alias("family"), F.min("doc_id").alias("ord"),
        (F.min("window_start_s") + 300.0).alias("t_first_attack_flow_s"))
    return ttd.onset_map(summary)


def train_rows(spark, d):
    return ttd.onset_lookup(scored(spark, d), run_onsets(spark, d)).where("part = 'train'")


@query("onset_map", "S9", f"""WITH {ONSET_SQL}
SELECT run_id, family, {sql_r4('onset')} AS onset_s, family = 'Benign' AS is_infinite, TRUE AS valid FROM ons""")
def _onset_map(spark, d):
    return rounded(run_onsets(spark, d).select(
        "run_id", "family", ttd.finite_or_null("onset_s").alias("onset_s"),
        (F.col("onset_s") == float("inf")).alias("is_infinite"), "valid"))


@query("onset_lookup", "J12", f"""WITH {ONSET_SQL}
SELECT doc_id, s.run_id, {sql_r4('onset')} AS onset_s FROM scores s LEFT JOIN ons o ON o.run_id = s.run_id AND o.ord % 3 <> 0""")
def _onset_lookup(spark, d):
    known = run_onsets(spark, d).join(
        b.scores(spark, d).groupBy("run_id").agg(F.min("doc_id").alias("o")), "run_id").where("o % 3 <> 0")
    return ttd.onset_lookup(b.scores(spark, d), known).select(
        "doc_id", "run_id", r4(ttd.finite_or_null("onset_s"), "onset_s"))


@query("validate_onset", "M26", f"""WITH {ONSET_SQL},
r AS (SELECT run_id, min(family) AS family, max(window_end_s) AS last_end FROM scores GROUP BY 1)
SELECT r.run_id, CASE WHEN ord % 3 = 0 THEN 'missing_run' ELSE 'onset_out_of_range' END AS problem
FROM r JOIN ons o USING (run_id) WHERE ord % 3 = 0 OR onset > last_end + 60""")
def _validate_onset(spark, d):
    s = b.scores(spark, d)
    known = run_onsets(spark, d).join(s.groupBy("run_id").agg(F.min("doc_id").alias("o")), "run_id").where("o % 3 <> 0")
    return ttd.onset_violations(s, known.drop("family"))


@query("threshold_info", "M25", f"""WITH {ONSET_SQL},
t AS (SELECT system, count(*) AS n FROM cl WHERE part = 'train' GROUP BY 1)
SELECT t.system, t.n AS n_total_train_windows, threshold_policy, count(*) AS n_selected, {sql_r4('min(score)')} AS selected_score_min, {sql_r4('max(score)')} AS selected_score_max
FROM t JOIN sel USING (system) GROUP BY 1, 2, 3""")
def _threshold_info(spark, d):
    return rounded(mt.threshold_info(train_rows(spark, d), ["system"], POL))


@query("benign_thresholds", "A22 M25", f"WITH {ONSET_SQL} SELECT system, threshold_policy, fpr_target, {sql_r4('threshold')} AS threshold FROM thr")
def _benign_thresholds(spark, d):
    t = mt.benign_thresholds(train_rows(spark, d), ["system"], POL, FPR)
    return t.withColumn("threshold", r4("threshold"))


@query("operating_points", "M24", f"""WITH {ONSET_SQL},
o AS (SELECT c.system, c.part, threshold_policy, fpr_target, threshold,
  count(*) FILTER (y_bin = 0 AND NOT coalesce(score >= threshold, FALSE)) AS tn, count(*) FILTER (y_bin = 0 AND score >= threshold) AS fp,
  count(*) FILTER (y_bin = 1 AND NOT coalesce(score >= threshold, FALSE)) AS fn, count(*) FILTER (y_bin = 1 AND score >= threshold) AS tp
  FROM cl c JOIN thr USING (system) GROUP BY 1, 2, 3, 4, 5)
SELECT system, part, threshold_policy, fpr_target, {sql_r4('threshold')} AS threshold, tn, fp, fn, tp, {sql_r4('tp::DOUBLE / nullif(tp + fn, 0)')} AS tpr,
       {sql_r4('fp::DOUBLE / nullif(fp + tn, 0)')} AS fpr, {sql_r4('tp::DOUBLE / nullif(tp + fp, 0)')} AS "precision", {sql_r4('tp::DOUBLE / nullif(tp + fn, 0)')} AS recall,
       {sql_r4('CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) END')} AS f1 FROM o""")
def _operating_points(spark, d):
    thr = mt.benign_thresholds(train_rows(spark, d), ["system"], POL, FPR)
    o = mt.operating_points(scored(spark, d), thr, ["system"], ["part"])
    return o.select("system", "part", "threshold_policy", "fpr_target", r4("threshold"), "tn", "fp", "fn", "tp",
                    *[r4(c) for c in ("tpr", "fpr", "precision", "recall", "f1")])


TTD_SQL = ONSET_SQL + """,
att AS (SELECT run_id, onset FROM ons WHERE family <> 'Benign'),
won AS (SELECT run_id, min(CASE WHEN y_bin = 1 THEN window_start_s END)::DOUBLE AS onset FROM scores WHERE family <> 'Benign' GROUP BY 1),
fl AS (
  SELECT c.system, threshold_policy, fpr_target, c.run_id, max(a.onset) AS onset, min(CASE WHEN window_end_s >= a.onset AND score >= threshold THEN window_end_s END) AS det
  FROM cl c JOIN att a USING (run_id) JOIN thr USING (system) GROUP BY 1, 2, 3, 4),
wi AS (
  SELECT c.system, threshold_policy, fpr_target, c.run_id, max(a.onset) AS onset, min(CASE WHEN window_end_s >= a.onset AND score >= threshold THEN window_end_s END) AS det
  FROM cl c JOIN won a USING (run_id) JOIN thr USING (system) GROUP BY 1, 2, 3, 4)"""


def detections(spark, d, window: bool):
    rows = settle(scored(spark, d), "scored")
    thr = mt.benign_thresholds(train_rows(spark, d), ["system"], POL, FPR)
    onsets = ttd.window_onsets(rows) if window else ttd.attack_onsets(run_onsets(spark, d))
    return ttd.first_detections(rows, onsets, thr, ["system"])


def _det_sql(t: str) -> str:
    return f"""SELECT system, threshold_policy, fpr_target, run_id, {sql_r4('onset')} AS onset_s, det AS detect_s, det IS NOT NULL AS detected,
       CASE WHEN det IS NOT NULL THEN {sql_r4('greatest(det - onset, 0)')} END AS ttd_s FROM {t}"""


def _det(df):
    return df.select("system", "threshold_policy", "fpr_target", "run_id", r4("onset_s"), "detect_s", "detected",
                     r4(ttd.finite_or_null("ttd_s"), "ttd_s"))


@query("ttd_flow_onset", "M27 W9", f"WITH {TTD_SQL} {_det_sql('fl')}")
def _ttd_flow_onset(spark, d):
    return _det(detections(spark, d, False))


@query("ttd_window_onset", "M28 W9", f"WITH {TTD_SQL} {_det_sql('wi')}")
def _ttd_window_onset(spark, d):
    return _det(detections(spark, d, True))


@query("summarize_ttd", "M29", f"""WITH {TTD_SQL}
SELECT system, threshold_policy, fpr_target, count(*) AS n_attack_runs, {sql_r4('count(det)::DOUBLE / count(*)')} AS detect_rate,
       {', '.join(f"{sql_r4(f'quantile_cont(CASE WHEN det IS NOT NULL THEN greatest(det - onset, 0)::DOUBLE END, {q})')} AS {n}" for n, q in (('ttd_median', 0.5), ('ttd_p25', 0.25), ('ttd_p75', 0.75)))}
FROM fl GROUP BY 1, 2, 3""")
def _summarize_ttd(spark, d):
    s = ttd.summarize_ttd(detections(spark, d, False), ["system", "threshold_policy", "fpr_target"])
    return s.select("system", "threshold_policy", "fpr_target", "n_attack_runs", r4("detect_rate"),
                    *[r4(ttd.finite_or_null(c), c) for c in ("ttd_median", "ttd_p25", "ttd_p75")])


SIDED_SQL = TTD_SQL + """,
sd AS (SELECT system, threshold_policy, fpr_target, run_id, f.det AS fd, w.det AS wd, greatest(f.det - f.onset, 0) AS ft_, greatest(w.det - w.onset, 0) AS wt_,
              greatest(w.det - w.onset, 0) - greatest(f.det - f.onset, 0) AS dl
       FROM (SELECT * FROM fl WHERE CAST(substr(md5(run_id), 1, 1) <> '0' AS BOOLEAN)) f FULL JOIN wi w USING (system, threshold_policy, fpr_target, run_id))"""


def sided(spark, d):
    flow = detections(spark, d, False).where(F.substring(F.md5("run_id"), 1, 1) != "0")
    return ttd.ttd_runs(flow, detections(spark, d, True), ["system"])


@query("ttd_runs", "J15 K6", f"""WITH {SIDED_SQL}
SELECT system, threshold_policy, fpr_target, run_id, fd AS flow_detect_s, wd AS window_detect_s, CASE WHEN fd IS NOT NULL AND wd IS NOT NULL THEN {sql_r4('dl')} END AS delta_s FROM sd""")
def _ttd_runs(spark, d):
    return sided(spark, d).select(
        "system", "threshold_policy", "fpr_target", "run_id", "flow_detect_s", "window_detect_s", r4("delta_s"))


@query("summarize_ttd_delta", "M30", f"""WITH {SIDED_SQL}
SELECT system, threshold_policy, fpr_target, count(dd) AS n_delta,
       {', '.join(f"{sql_r4(f'quantile_cont(dd, {q})')} AS {n}" for n, q in (('delta_median', 0.5), ('delta_p25', 0.25), ('delta_p75', 0.75)))}
FROM (SELECT *, CASE WHEN fd IS NOT NULL AND wd IS NOT NULL THEN dl::DOUBLE END AS dd FROM sd) GROUP BY 1, 2, 3""")
def _summarize_ttd_delta(spark, d):
    s = ttd.summarize_delta(sided(spark, d), ["system", "threshold_policy", "fpr_target"])
    return s.select("system", "threshold_policy", "fpr_target", "n_delta",
                    *[r4(c) for c in ("delta_median", "delta_p25", "delta_p75")])


F1_SQL = b.MULTI_SQL + """,
cfc AS (SELECT system, seed, y_true, y_pred, count(*) AS n FROM mc_best GROUP BY 1, 2, 3, 4),
lb AS (SELECT DISTINCT system, seed, y_true AS label FROM cfc UNION SELECT DISTINCT system, seed, y_pred FROM cfc),
pc AS (
  SELECT l.system, l.seed, l.label, coalesce(sum(n) FILTER (y_true = label AND y_pred = label), 0) AS tp, coalesce(sum(n) FILTER (y_true = label), 0) AS sup,
         coalesce(sum(n) FILTER (y_pred = label), 0) AS prd FROM lb l JOIN cfc c USING (system, seed) GROUP BY 1, 2, 3),
f1s AS (SELECT *, coalesce(2.0::DOUBLE * tp / nullif(prd + sup, 0), 0) AS f1 FROM pc)"""


def predicted(spark, d):
    return mt.predict_class(b.multiclass_scores(spark, d), "raw", b.FAMILIES)


@query("multiclass_metrics", "M23", f"""WITH {F1_SQL},
ll AS (SELECT system, seed, avg(-ln(prob)) AS log_loss FROM (
  SELECT p.system, p.seed, least(greatest(prob, 2.220446049250313e-16), 1 - 2.220446049250313e-16) AS prob FROM mc_p p WHERE {b.FAMILY_SQL}[CAST(j AS INT) + 1] = y_true) GROUP BY 1, 2),
ac AS (SELECT system, seed, count(*) AS n, avg((y_true = y_pred)::INT) AS acc FROM mc_best GROUP BY 1, 2)
SELECT system, CAST(seed AS BIGINT) AS seed, ac.n, {sql_r4('acc')} AS acc, {sql_r4('log_loss')} AS log_loss, {sql_r4('m')} AS f1_macro, {sql_r4('w')} AS f1_weighted
FROM ac JOIN ll USING (system, seed) JOIN (SELECT system, seed, avg(f1) AS m, sum(f1 * sup) / sum(sup) AS w FROM f1s GROUP BY 1, 2) USING (system, seed)""")
def _multiclass_metrics(spark, d):
    return rounded(mt.multiclass_metrics(predicted(spark, d), ["system", "seed"], b.FAMILIES))


@query("predict_class", "M23 K5", f"WITH {b.MULTI_SQL} SELECT vec_id, system, y_pred, {sql_r4('p_max')} AS p_max FROM mc_best")
def _predict_class(spark, d):
    return predicted(spark, d).select("vec_id", "system", "y_pred", r4("p_max"))
