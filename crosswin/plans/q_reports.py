"""Report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosswin.functions import expr as ex
from crosswin.operators import metrics as mt
from crosswin.operators import reports as rp
from crosswin.plans import bindings as b
from crosswin.plans import q_scores as qs
from crosswin.plans.registry import query, r4, rounded, sql_r4
from crosswin.sources import readers

M = b.METRICS_SQL
SYS = list(rp.SYSTEMS)


def rows(spark, d):
    return rp.with_seed(rp.report_filter(b.metric_rows(spark, d)))


@query("report_filter", "P15 P16", f"WITH {M} SELECT model, system, split, CAST(seed AS BIGINT) AS seed, {sql_r4('roc_auc')} AS roc_auc, n FROM test_rows")
def _report_filter(spark, d):
    return rounded(rows(spark, d).select("model", "system", "split", "seed", "roc_auc", "n"))


@query("numeric_coercion", "P17", f"""SELECT p_partkey, {sql_r4("TRY_CAST(CASE WHEN p_partkey % 5 = 0 THEN 'x' || p_size WHEN p_partkey % 5 = 1 THEN ' ' || p_size || '.5 ' ELSE CAST(p_size AS VARCHAR) END AS DOUBLE)")} AS v FROM part""")
def _numeric_coercion(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.when(k % 5 == 0, F.concat(F.lit("x"), s)).when(k % 5 == 1, F.concat(F.lit(" "), s, F.lit(".5 "))).otherwise(s)
    return b.table(spark, d, "part").select("p_partkey", r4(ex.to_double(text), "v"))


@query("seed_mean_std", "A23", f"""WITH {M}
SELECT model, system, count(*) AS n_seeds, {', '.join(f"{sql_r4(f'avg({c})')} AS {c}_mean, {sql_r4(f'stddev_samp({c})')} AS {c}_std" for c in ('roc_auc', 'log_loss'))}
FROM test_rows GROUP BY 1, 2""")
def _seed_mean_std(spark, d):
    return rounded(rp.seed_mean_std(rows(spark, d), ["roc_auc", "log_loss"]))


@query("leaderboard", "A29 T6", f"WITH {M} SELECT model, {sql_r4('avg(roc_auc)')} AS roc_auc FROM test_rows GROUP BY 1")
def _leaderboard(spark, d):
    return rounded(rp.leaderboard(rows(spark, d), "roc_auc"))


@query("union_metrics", "S11 U1", f"""WITH {M}
SELECT 'one' AS model, system, n, {sql_r4('roc_auc')} AS roc_auc, NULL::DOUBLE AS log_loss FROM mrows WHERE part = 'val'
UNION ALL SELECT model, system, n, NULL, {sql_r4('log_loss')} FROM mrows WHERE part = 'test'""")
def _union_metrics(spark, d):
    m = b.metric_rows(spark, d)
    return rounded(readers.union_metrics({
        "one": m.where("part = 'val'").select("system", "n", "roc_auc"),
        "two": m.where("part = 'test'").select("model", "system", "n", "log_loss")}).select(
        "model", "system", "n", "roc_auc", "log_loss"))


@query("discover_partitions", "S13", f"WITH {M} SELECT DISTINCT split, CAST(W AS BIGINT) AS \"W\", part FROM mrows")
def _discover_partitions(spark, d):
    return rounded(readers.discover(b.metric_rows(spark, d), ["split", "W", "part"]))


@query("report_cells", "V7", f"""WITH {M}, c AS (SELECT model, system, count(*) AS n FROM test_rows GROUP BY 1, 2)
SELECT count(*) AS cells, min(n) AS min_seeds, max(n) AS max_seeds, count(*) = 24 AND min(n) = 5 AND max(n) = 5 AS ok FROM c""")
def _report_cells(spark, d):
    return rp.report_cells(rows(spark, d), 24, 5)


@query("detection_report", "A30", f"""WITH {M}
SELECT model, system, {sql_r4('avg(detect_rate)')} AS detect_rate, count(CASE WHEN detect_rate = 0 THEN 1 END) AS blind_seeds, count(*) AS n_seeds,
       CASE WHEN avg(detect_rate) > 0.8 THEN {sql_r4('quantile_cont(ttd_median, 0.5)')} END AS ttd_median,
       CASE WHEN count(CASE WHEN detect_rate = 0 THEN 1 END) > 3 THEN 'UNRELIABLE' WHEN count(CASE WHEN detect_rate = 0 THEN 1 END) > 0 THEN 'CAUTION' ELSE 'OK' END AS reliability
FROM (SELECT * REPLACE (CASE WHEN system = 'radio_only' THEN 0.7 + detect_rate / 2 ELSE detect_rate END AS detect_rate) FROM test_rows) GROUP BY 1, 2""")
def _detection_report(spark, d):
    rate = F.when(F.col("system") == "radio_only", 0.7 + F.col("detect_rate") / 2).otherwise(F.col("detect_rate"))
    return rounded(rp.detection_report(rows(spark, d).withColumn("detect_rate", rate)))


GAP_SQL = M + """,
gp AS (SELECT model, """ + ", ".join(f"avg(f1_macro) FILTER (system = '{s}') AS {s}" for s in SYS) + """ FROM test_rows GROUP BY 1)"""


@query("modality_gap", "A31", f"""WITH {GAP_SQL}
SELECT model, {', '.join(f'{sql_r4(s)} AS {s}' for s in SYS)}, {sql_r4('radio_only - network_only')} AS radio_minus_network, {sql_r4('fusion_mean - radio_only')} AS fusion_gain FROM gp""")
def _modality_gap(spark, d):
    return rounded(rp.modality_gap(rows(spark, d), "f1_macro"))


@query("gap_range", "A31", f"""WITH {GAP_SQL}
SELECT {sql_r4('min(radio_only - network_only)')} AS min_gap, {sql_r4('max(radio_only - network_only)')} AS max_gap, {sql_r4('min(fusion_mean - radio_only)')} AS min_gain,
       {sql_r4('max(fusion_mean - radio_only)')} AS max_gain, bool_and(fusion_mean > radio_only) AS fusion_helps_all FROM gp""")
def _gap_range(spark, d):
    return rounded(rp.gap_range(rp.modality_gap(rows(spark, d), "f1_macro")))


@query("stacked_stability", "A31", f"""WITH {M}, g AS (
  SELECT model, stddev_samp(roc_auc) FILTER (system = 'fusion_stacked') AS s, avg(detect_rate) FILTER (system = 'fusion_stacked') - avg(detect_rate) FILTER (system = 'radio_only') AS dl FROM test_rows GROUP BY 1)
SELECT model, {sql_r4('s')} AS std, {sql_r4('dl')} AS delta, s > 0.1 AS unstable, dl < -0.05 AS hurts FROM g""")
def _stacked_stability(spark, d):
    return rounded(rp.stacked_stability(rows(spark, d)))


@query("best_config", "T7", f"""WITH {M}, g AS (SELECT model, system, avg(roc_auc) AS v FROM test_rows GROUP BY 1, 2)
SELECT model, system, {sql_r4('v')} AS roc_auc FROM g ORDER BY v DESC, model, system LIMIT 1""")
def _best_config(spark, d):
    return rounded(rp.best_config(rows(spark, d), "roc_auc"))


@query("lowest_log_loss", "A31 T7", f"""WITH {M}, g AS (SELECT model, system, avg(log_loss) AS v FROM test_rows GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY v, list_position(['network_only','radio_only','fusion_mean','fusion_stacked'], system)) AS rn FROM g)
SELECT model, system, {sql_r4('v')} AS log_loss FROM r WHERE rn = 1""")
def _lowest_log_loss(spark, d):
    return rounded(rp.lowest_system(rows(spark, d)))


P = b.MULTI_SQL


@query("load_predictions", "S10", f"WITH {P} SELECT vec_id, system, CAST(seed AS BIGINT) AS seed, y_true, y_pred FROM mc_best")
def _load_predictions(spark, d):
    p = qs.predicted(spark, d).select("vec_id", "system", "seed", "y_true", "y_pred")
    low = p.where("seed < 2").withColumnsRenamed({"y_true": "Label", "y_pred": "prediction"})
    return rounded(readers.union_all([readers.unify_predictions(x) for x in (low, p.where("seed >= 2"))]))


@query("confusion_matrix", "A24", f"""WITH {P}, c AS (SELECT unnest({b.FAMILY_SQL}) AS c)
SELECT s.system, t.c AS y_true, p.c AS y_pred, count(m.vec_id) AS n FROM (SELECT DISTINCT system FROM mc_best) s, c t CROSS JOIN c p
LEFT JOIN mc_best m ON m.system = s.system AND m.y_true = t.c AND m.y_pred = p.c GROUP BY 1, 2, 3""")
def _confusion_matrix(spark, d):
    return mt.confusion_matrix(qs.predicted(spark, d), ["system"], b.FAMILIES)


@query("per_class_f1", "A25", f"""WITH {P}, g AS (
  SELECT system, c AS label, count(*) FILTER (y_true = c AND y_pred = c) AS tp, count(*) FILTER (y_true = c) AS support, count(*) FILTER (y_pred = c) AS predicted
  FROM mc_best, (SELECT unnest({b.FAMILY_SQL}) AS c) GROUP BY 1, 2)
SELECT system, label, tp, support, predicted, {sql_r4('coalesce(tp::DOUBLE / nullif(predicted, 0), 0)')} AS "precision", {sql_r4('coalesce(tp::DOUBLE / nullif(support, 0), 0)')} AS recall,
       {sql_r4('coalesce(2.0::DOUBLE * tp / nullif(predicted + support, 0), 0)')} AS f1 FROM g WHERE support + predicted > 0""")
def _per_class_f1(spark, d):
    return rounded(rp.per_class_f1(qs.predicted(spark, d)))


@query("macro_f1_by_seed", "A25", f"""WITH {qs.F1_SQL}, s AS (SELECT system, seed, sum(f1) / 6 AS m FROM f1s GROUP BY 1, 2)
SELECT system, {sql_r4('avg(m)')} AS f1_macro, {sql_r4('stddev_pop(m)')} AS std_pop, {sql_r4('stddev_samp(m)')} AS std_samp FROM s GROUP BY 1""")
def _macro_f1_by_seed(spark, d):
    return rounded(rp.macro_f1_by_seed(qs.predicted(spark, d), b.FAMILIES))


@query("top_confusions", "T3", f"""WITH {P}, c AS (SELECT system, y_true, y_pred, count(*) AS n FROM mc_best GROUP BY 1, 2, 3),
s AS (SELECT *, 100.0::DOUBLE * n / sum(n) OVER (PARTITION BY system, y_true) AS rp, 100.0::DOUBLE * n / sum(CASE WHEN y_true <> y_pred THEN n ELSE 0 END) OVER (PARTITION BY system) AS ep FROM c),
r AS (SELECT *, row_number() OVER w AS rank, sum(ep) OVER w AS cp FROM s WHERE y_true <> y_pred WINDOW w AS (PARTITION BY system ORDER BY n DESC, y_true, y_pred ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT system, y_true, y_pred, n, {sql_r4('rp')} AS row_pct, {sql_r4('ep')} AS error_pct, rank, {sql_r4('cp')} AS cumulative_pct FROM r WHERE rank <= 6""")
def _top_confusions(spark, d):
    return rounded(rp.top_confusions(qs.predicted(spark, d), ["system"]))


@query("attack_to_benign", "T3", f"""WITH {P}, g AS (
  SELECT system, count(*) AS n, count(*) FILTER (y_true <> y_pred) AS errors, count(*) FILTER (y_true <> y_pred AND y_pred = 'Benign') AS ab FROM mc_best GROUP BY 1)
SELECT system, n, errors, ab AS attack_to_benign, {sql_r4('100.0::DOUBLE * ab / nullif(errors, 0)')} AS attack_to_benign_pct FROM g""")
def _attack_to_benign(spark, d):
    return rounded(rp.attack_to_benign(qs.predicted(spark, d), ["system"]))


@query("confusion_rate_rollup", "A26", f"""WITH {P},
r AS (SELECT system, seed, 100.0::DOUBLE * count(*) FILTER (y_pred = 'Benign') / count(*) AS pct FROM mc_best WHERE y_true = 'DoS' GROUP BY 1, 2)
SELECT system, CAST(seed AS BIGINT) AS seed, count(*) AS n, {sql_r4('min(pct)')} AS min_pct, {sql_r4('max(pct)')} AS max_pct, {sql_r4('avg(pct)')} AS mean_pct, {sql_r4('stddev_pop(pct)')} AS std_pct
FROM r GROUP BY GROUPING SETS ((), (system), (seed))""")
def _confusion_rate_rollup(spark, d):
    rates = rp.confusion_rate(qs.predicted(spark, d), ["system", "seed"], "DoS", "Benign")
    return rounded(rp.confusion_rate_rollup(rates, ["system", "seed"]))


@query("class_mix_by_seed", "A27", f"""WITH {P}
SELECT CAST(seed AS BIGINT) AS seed, count(*) AS n, {', '.join(f"{sql_r4(f'''100.0::DOUBLE * count(*) FILTER (y_true = '{c}') / count(*)''')} AS {c}" for c in b.FAMILIES)}
FROM mc_best WHERE system = 'fusion_mean' GROUP BY 1""")
def _class_mix_by_seed(spark, d):
    return rounded(rp.class_mix(qs.predicted(spark, d).where("system = 'fusion_mean'"), b.FAMILIES))


@query("class_mix_range", "A27", f"""WITH {P}, m AS (
  SELECT seed, c AS label, 100.0::DOUBLE * count(*) FILTER (y_true = c) / count(*) AS pct FROM mc_best, (SELECT unnest({b.FAMILY_SQL}) AS c) WHERE system = 'fusion_mean' GROUP BY 1, 2)
SELECT label, {sql_r4('min(pct)')} AS min_pct, {sql_r4('max(pct)')} AS max_pct FROM m GROUP BY 1""")
def _class_mix_range(spark, d):
    return rounded(rp.class_mix_range(rp.class_mix(qs.predicted(spark, d).where("system = 'fusion_mean'"), b.FAMILIES), b.FAMILIES))


WPR_SQL = P + """,
pr AS (SELECT run_id, seed, count(*) FILTER (y_true = 'DoS') AS k, count(*) AS t FROM mc_best WHERE system = 'fusion_mean' GROUP BY 1, 2),
wp AS (SELECT run_id, arg_min(k, seed) AS class_windows, arg_min(t, seed) AS total_windows, count(DISTINCT (k, t)) = 1 AS consistent FROM pr GROUP BY 1)"""


@query("class_windows_per_run", "A28", f"WITH {WPR_SQL} SELECT * FROM wp")
def _class_windows_per_run(spark, d):
    return rp.class_windows_per_run(qs.predicted(spark, d).where("system = 'fusion_mean'"), "DoS")


@query("class_windows_range", "A28", f"""WITH {WPR_SQL}
SELECT count(*) AS runs, min(class_windows) AS min, max(class_windows) AS max, {sql_r4('quantile_cont(class_windows::DOUBLE, 0.5)')} AS median FROM wp WHERE class_windows > 0""")
def _class_windows_range(spark, d):
    per = rp.class_windows_per_run(qs.predicted(spark, d).where("system = 'fusion_mean'"), "DoS")
    return rounded(rp.class_windows_range(per))
