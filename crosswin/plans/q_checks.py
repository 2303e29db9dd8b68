"""Checks over tables with planted faults, and writers read back."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from crosswin.operators import alignment as al
from crosswin.operators import checks as ck
from crosswin.operators import models as md
from crosswin.operators import splits as sp
from crosswin.operators.scale import settle, shared_folder
from crosswin.plans import bindings as b
from crosswin.plans import q_alignment as qa
from crosswin.plans import q_features as qf
from crosswin.plans import q_network as qn
from crosswin.plans import q_radio as qr
from crosswin.plans import q_scores as qs
from crosswin.plans import q_splits as ql
from crosswin.plans.registry import query, r4, rounded, sql_r4
from crosswin.sources import sinks


def fresh(spark, name):
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


@query("check_windows", "V1", f"""WITH {qn.WIN_SQL}
SELECT run_id, w0 AS window_start_s, w0 + 10 AS window_end_s, 'key_on_both_sides' AS rule, 'index_network' AS "check" FROM grid WHERE run_id = '8'
UNION ALL SELECT run_id, w0, w0 + 10, 'traffic_type_win_equal', 'index_radio' FROM grid WHERE run_id = '9' AND w0 % 100 = 0
UNION ALL SELECT run_id, w0, w0 + 10, r, 'radio' FROM grid, (SELECT unnest(['fraction_fits', 'flag_is_0_or_1']) AS r) WHERE run_id = '10' AND w0 % 50 = 0""")
def _check_windows(spark, d):
    index = settle(qn.index(spark, d), "index")
    sec, lengths = qr.radio.reported_seconds(qr.records(spark, d), qr.KPIS)
    radio = qr.radio.radio_windows(sec, index, 10, 2, qr.KPIS, lengths)
    radio = settle(radio.select(*ck.WINDOW_COLUMNS), "radio")  # what the rules read
    flip = (F.col("run_id") == "9") & (F.col("window_start_s") % 100 == 0)
    bad = (F.col("run_id") == "10") & (F.col("window_start_s") % 50 == 0)
    radio = radio.withColumns({
        "traffic_type_win": F.when(flip, "Other").otherwise(F.col("traffic_type_win")),
        "radio_missing_frac": F.when(bad, -1.0).otherwise(F.col("radio_missing_frac")),
        "radio_window_missing": F.when(bad, 7).otherwise(F.col("radio_window_missing"))})
    return ck.window_violations(index, index.where("run_id <> '8'"), radio, 10)


@query("check_seconds", "V1", f"""WITH {qr.SEC_SQL}
SELECT run_id, CAST(t_rel_s AS BIGINT) AS t_rel_s, 'rate_not_negative' AS rule FROM rsec WHERE run_id = '5' AND t_rel_s % 10 = 3""")
def _check_seconds(spark, d):
    sec = qr.radio.radio_seconds(qr.records(spark, d), qr.KPIS)
    bad = (F.col("run_id") == "5") & (F.col("t_rel_s") % 10 == 3)
    return ck.second_violations(sec.withColumn("rate_total", F.when(bad, -1.0).otherwise(F.col("rate_total"))))


@query("check_run_count", "V1", "SELECT count(DISTINCT user_id) AS runs FROM events HAVING count(DISTINCT user_id) <> 42")
def _check_run_count(spark, d):
    return ck.run_count_violations(b.flows(spark, d), 42)


@query("check_processed", "V3", f"""WITH {b.SCORES_SQL}
SELECT run_id, window_start_s, window_end_s, 'p_net_finite' AS rule FROM scores WHERE p_net IS NULL
UNION ALL SELECT run_id, window_start_s, window_end_s, 'y_bin_is_0_or_1' FROM scores WHERE doc_id % 50 = 0
UNION ALL SELECT run_id, window_start_s, window_end_s, 'y_cat_not_empty' FROM scores WHERE family = 'fr'""")
def _check_processed(spark, d):
    s = b.scores(spark, d)
    s = s.withColumns({
        "y_bin": F.when(F.col("doc_id") % 50 == 0, 2).otherwise(F.col("y_bin")),
        "y_cat": F.when(F.col("family") == "fr", " ").otherwise(F.col("family"))})
    return ck.processed_violations(s, ["p_net", "p_rad"])


@query("feature_fingerprint", "V3", f"""WITH {qf.FRAME_SQL},
c AS (SELECT part, unnest([struct_pack(c := 'kind', v := kind), struct_pack(c := 'size', v := CAST(CAST(size AS BIGINT) AS VARCHAR)), struct_pack(c := 'word', v := word)]) AS e FROM f),
h AS (SELECT part, e.c AS "column", CAST('0x' || substr(md5(e.c || '=' || coalesce('v' || e.v, 'null')), 1, 15) AS BIGINT) AS h FROM c)
SELECT part, "column", count(*) AS n, sum(h)::VARCHAR AS hash_sum, bit_xor(h) AS hash_xor FROM h GROUP BY 1, 2""")
def _feature_fingerprint(spark, d):
    f = qf.frame(spark, d).withColumn("size", F.col("size").cast("bigint"))
    # the same rows in another order and layout have the same digests
    shuffled = f.repartition(5, "p_partkey").orderBy(F.col("price").desc())
    return rounded(ck.content_digests(shuffled, ["part"], ["kind", "size", "word"])).withColumn("hash_sum", F.col("hash_sum").cast("string"))


@query("feature_lists", "V3", """
SELECT part, feature, rule FROM (VALUES ('test', 'price', 'missing'), ('test', 'weight', 'extra'), ('val', 'size', 'order')) v(part, feature, rule)
WHERE EXISTS (SELECT * FROM part)""")
def _feature_lists(spark, d):
    f = b.table(spark, d, "part").select("p_partkey", F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    parts = {"train": f, "val": f.select("p_partkey", "price", "size"), "test": f.drop("price").withColumn("weight", F.col("size"))}
    listed = ck.feature_list_violations(parts, skip=["p_partkey"])
    return listed.join(f.limit(1).select("p_partkey"), how="cross").drop("p_partkey")


@query("content_differences", "V3", f"""WITH {qf.FRAME_SQL}
SELECT unnest(['kind', 'size']) AS "column", part FROM f WHERE p_partkey % 97 = 5 AND part <> 'train' GROUP BY part""")
def _content_differences(spark, d):
    """Stored and fresh processed tables whose parts differ in some columns."""
    f = qf.frame(spark, d).select("p_partkey", "part", "kind", "size", "word")
    hit = (F.col("p_partkey") % 97 == 5) & (F.col("part") != "train")
    changed = f.withColumns({"kind": F.when(hit, F.upper(F.concat("kind", F.lit("x")))).otherwise(F.col("kind")), "size": F.when(hit, F.col("size") + 1).otherwise(F.col("size"))})
    columns = ["p_partkey", "kind", "size", "word"]
    return ck.digest_differences(ck.content_digests(f, ["part"], columns), ck.content_digests(changed, ["part"], columns), ["part"])


@query("pmi_columns", "V1", f"""WITH {qr.SEC_SQL}
SELECT unnest(['pmi_mean', 'ul_pmi']) AS "column", count(*) AS n FROM rsec HAVING count(*) > 0""")
def _pmi_columns(spark, d):
    sec = qr.radio.radio_seconds(qr.records(spark, d), qr.KPIS)
    return ck.forbidden_columns(sec.withColumns({"pmi_mean": F.col("rate_total"), "ul_pmi": F.lit(1), "pmid": F.lit(2)}), "pmi")


@query("family_coverage", "V2", f"""WITH RECURSIVE {ql.STRAT_SQL}
SELECT DISTINCT split_name, family, part FROM strat WHERE part <> 'val' AND family = (SELECT min(family) FROM strat WHERE family <> 'Benign')
UNION ALL SELECT s.split_name, s.family, p.part FROM (SELECT DISTINCT split_name, family FROM strat) s, (SELECT unnest(['train', 'val', 'test']) AS part) p
WHERE NOT EXISTS (SELECT * FROM strat x WHERE x.split_name = s.split_name AND x.family = s.family AND x.part = p.part)""")
def _family_coverage(spark, d):
    s = settle(ql.stratified(spark, d), "strat")
    hit = s.where("family <> 'Benign'").agg(F.min("family").alias("f")).first()["f"]
    # one family is moved to val as a whole
    moved = s.withColumn("part", F.when(F.col("family") == hit, "val").otherwise(F.col("part")))
    return sp.family_gaps(moved)


@query("check_metrics_finite", "V4", f"""WITH {b.METRICS_SQL} SELECT 'ttd_median' AS "column", count(*) AS bad FROM mrows WHERE ttd_median IS NULL HAVING count(*) > 0""")
def _check_metrics_finite(spark, d):
    return ck.not_finite_counts(b.metric_rows(spark, d))


@query("check_finite_input", "V11", f"""WITH {b.SCORES_SQL} SELECT 'p_net' AS "column", min(doc_id) AS first_bad, count(*) AS bad FROM scores WHERE p_net IS NULL""")
def _check_finite_input(spark, d):
    return ck.first_not_finite(b.scores(spark, d), "doc_id", ["p_net", "p_rad"])


@query("check_ttd_summary", "V5", """
SELECT p_partkey, 'inf_only_without_detection' AS rule FROM part WHERE p_partkey % 7 = 1
UNION ALL SELECT p_partkey, 'ttd_finite_when_detected' FROM part WHERE p_partkey % 7 = 1
UNION ALL SELECT p_partkey, 'delta_rows_hold_delta_only' FROM part WHERE p_partkey % 7 = 2
UNION ALL SELECT p_partkey, 'no_delta_means_blank' FROM part WHERE p_partkey % 7 = 3
UNION ALL SELECT p_partkey, 'delta_finite' FROM part WHERE p_partkey % 7 = 4
UNION ALL SELECT p_partkey, 'ttd_rows_complete' FROM part WHERE p_partkey % 7 = 5
UNION ALL SELECT p_partkey, 'inf_only_in_ttd' FROM part WHERE p_partkey % 7 = 6""")
def _check_ttd_summary(spark, d):
    k = F.col("p_partkey") % 7
    inf, size = F.lit(float("inf")), F.col("p_size").cast("double")
    delta = k.isin(2, 3, 4)
    rows = b.table(spark, d, "part").select(
        "p_partkey", F.when(delta, "delta_window_minus_flow").otherwise("flow_onset").alias("ttd_mode"),
        F.when(k == 2, 5.0).when(~delta & (k != 5), F.when(k == 6, inf).otherwise(size)).alias("n_attack_runs"),
        F.when(~delta, F.when(k.isin(0, 6), 0.0).otherwise(0.5)).alias("detect_rate"),
        *[F.when(~delta, F.when(k.isin(0, 1), inf).otherwise(size)).alias(c) for c in ck.TTD_COLUMNS],
        F.when(delta, F.when(k == 3, 0.0).otherwise(3.0)).alias("n_delta"),
        *[F.when(delta & ~((k == 4) & F.lit(c == "delta_p25")), size).alias(c) for c in ck.DELTA_COLUMNS])
    return ck.ttd_summary_violations(rows, ["p_partkey"])


@query("check_predictions_binary", "V6 K4", f"""WITH {b.SCORES_SQL}
SELECT doc_id, 'score_in_unit_interval' AS rule FROM scores WHERE p_net IS NULL
UNION ALL SELECT doc_id, 'y_true_is_0_or_1' FROM scores WHERE doc_id % 40 = 0""")
def _check_predictions_binary(spark, d):
    s = b.scores(spark, d).withColumn("y_bin", F.when(F.col("doc_id") % 40 == 0, 3).otherwise(F.col("y_bin")))
    return ck.binary_prediction_violations(sinks.binary_predictions(s, ["doc_id"], score="p_net"), ["doc_id"])


@query("check_predictions_multiclass", "V6 K5", f"""WITH {b.MULTI_SQL}
SELECT vec_id, system, 'p_max_is_largest' AS rule FROM mc_best WHERE vec_id % 25 = 0
UNION ALL SELECT vec_id, system, 'labels_present' FROM mc_best WHERE vec_id % 30 = 0""")
def _check_predictions_multiclass(spark, d):
    p = sinks.multiclass_predictions(qs.predicted(spark, d), ["vec_id", "system"], b.FAMILIES)
    names = [c for c in p.columns if c.startswith("p_") and c != "p_max"]
    p = p.withColumns({
        "p_max": F.when(F.col("vec_id") % 25 == 0, 0.999).otherwise(F.col("p_max")),
        "y_pred": F.when(F.col("vec_id") % 30 != 0, F.col("y_pred"))})
    return ck.multiclass_prediction_violations(p, ["vec_id", "system"], names)


@query("table_diff", "J16", """
SELECT '<key>' AS "column", 2 * count(*) FILTER (p_partkey % 100 = 7) AS different, NULL::DOUBLE AS max_diff FROM part
UNION ALL SELECT 'p_size', count(*) FILTER (p_partkey % 10 = 0), 2.0 FROM part
UNION ALL SELECT 'p_retailprice', 0, 0.0 FROM part WHERE p_partkey = 0
UNION ALL SELECT 'p_name', count(*) FILTER (p_partkey % 20 = 1), NULL FROM part""")
def _table_diff(spark, d):
    k = F.col("p_partkey")
    a = b.table(spark, d, "part").select("p_partkey", F.lit(False).alias("moved"), "p_size", "p_retailprice", "p_name")
    other = a.select(
        "p_partkey", (k % 100 == 7).alias("moved"),  # a second key column, so that no moved key meets another one
        F.when(k % 10 == 0, F.col("p_size") + 2).otherwise(F.col("p_size")).alias("p_size"), "p_retailprice",
        F.when(k % 20 == 1, F.upper("p_name")).otherwise(F.col("p_name")).alias("p_name"))
    return ck.table_diff(a, other, ["p_partkey", "moved"])


@query("file_set_diff", "U4", f"""WITH {b.PATHS_SQL}
SELECT family, layer, path, 'only_left' AS side FROM paths WHERE layer = 'radio' AND length(path) % 2 = 0
UNION ALL SELECT family, layer, path || '.new', 'only_right' FROM paths WHERE family = 'SMALL' AND layer = 'network'""")
def _file_set_diff(spark, d):
    p = b.paths(spark, d)
    right = p.where(~((F.col("layer") == "radio") & (F.length("path") % 2 == 0)))
    new = p.where("family = 'SMALL' and layer = 'network'").withColumn("path", F.concat("path", F.lit(".new")))
    return ck.set_diff(p, right.unionByName(new))


@query("check_expected_values", "V8", f"""WITH {b.METRICS_SQL}, g AS (SELECT model, system, avg(roc_auc) AS value FROM test_rows GROUP BY 1, 2)
SELECT model, system, {sql_r4('value + 0.5')} AS expected, {sql_r4('value')} AS value FROM g WHERE system = 'radio_only'""")
def _check_expected_values(spark, d):
    from crosswin.plans import q_reports as qp

    means = qp.rows(spark, d).groupBy("model", "system").agg(F.avg("roc_auc").alias("value"))
    off = F.when(F.col("system") == "radio_only", F.col("value") + 0.5).otherwise(F.col("value"))
    return rounded(ck.expected_value_violations(means, means.withColumn("value", off), ["model", "system"], 0.002))


@query("run_errors", "V10", f"""WITH {b.RUNS_SQL}
SELECT run_id, family, 'no flows' AS message FROM runs WHERE run_id IN ('3', '4') UNION ALL SELECT run_id, family, 'no telemetry records' FROM runs WHERE run_id IN ('4', '5')""")
def _run_errors(spark, d):
    return ck.run_errors(
        b.runs(spark, d), b.flows(spark, d).where("run_id not in ('3', '4')"), b.telemetry(spark, d).where("run_id not in ('4', '5')"))


@query("check_splits", "V2", """
SELECT 'stratified_seed' || seed AS split_name, run_id, rule FROM (SELECT unnest([42, 43]) AS seed), (
  SELECT DISTINCT CAST(user_id AS VARCHAR) AS run_id, 'overlap' AS rule FROM events WHERE user_id IN (1, 2)
  UNION ALL SELECT DISTINCT CAST(user_id AS VARCHAR), 'missing' FROM events WHERE user_id IN (4, 5)
  UNION ALL SELECT DISTINCT 'no-such-run', 'extra' FROM events WHERE user_id = 3)""")
def _check_splits(spark, d):
    s, runs = settle(ql.broken(spark, d), "broken"), b.runs(spark, d)
    return sp.split_overlaps(s).select("split_name", "run_id", F.lit("overlap").alias("rule")).unionByName(
        sp.split_coverage(s, runs).withColumnRenamed("problem", "rule"))


# ---- writers -----------------------------------------------------------------------------


@query("write_stage", "K1 K2", f"""WITH {qn.WIN_SQL}
SELECT CAST(10 AS BIGINT) AS "W", CAST(2 AS BIGINT) AS "S", run_id, count(*) AS n FROM grid GROUP BY run_id
UNION ALL SELECT 5, 2, run_id, CAST(floor((run_end_s - 5) / 2) AS BIGINT) + 1 FROM spans WHERE run_end_s >= 5""")
def _write_stage(spark, d):
    path = fresh(spark, "index")
    w = settle(qn.index(spark, d), "windows")
    sinks.write_window_index(w, path, 10, 2)
    sinks.write_window_index(qn.index(spark, d, 5, 2), path, 5, 2)  # a second setting in the same path
    sinks.write_window_index(w.unionByName(w), path, 10, 2)  # exists, so this one is left out
    return rounded(spark.read.parquet(path).groupBy("W", "S", "run_id").agg(F.count("*").alias("n")))


@query("write_metric_files", "K3", f"""WITH {b.METRICS_SQL}
SELECT model, system, split, CAST(W AS BIGINT) AS "W", part, CAST(time_ordered AS VARCHAR) AS time_ordered, n, {sql_r4('roc_auc')} AS roc_auc, 'csv' AS format FROM mrows
UNION ALL SELECT model, system, split, W, part, CAST(time_ordered AS VARCHAR), n, {sql_r4('roc_auc')}, 'json' FROM mrows""")
def _write_metric_files(spark, d):
    m = b.metric_rows(spark, d).select("model", "system", "split", "W", "part", "time_ordered", "n", "roc_auc")
    csv, js = fresh(spark, "csv"), fresh(spark, "json")
    sinks.write_csv(m, csv, ["part"])
    sinks.write_jsonl(m, js)
    schema = "model string, system string, split string, W int, time_ordered string, n bigint, roc_auc double, part string"
    a = spark.read.schema(schema).option("header", True).csv(csv).withColumn("format", F.lit("csv"))
    z = spark.read.schema(schema).json(js).withColumn("format", F.lit("json"))
    return rounded(a.unionByName(z))


@query("write_predictions_binary", "K4", f"WITH {b.SCORES_SQL} SELECT doc_id, CAST(y_bin AS BIGINT) AS y_true, {sql_r4('p_rad::FLOAT')} AS score FROM scores")
def _write_predictions_binary(spark, d):
    path = fresh(spark, "pred")
    sinks.write_stage(sinks.binary_predictions(b.scores(spark, d), ["doc_id"], score="p_rad"), path)
    return rounded(spark.read.parquet(path))


@query("write_predictions_multiclass", "K5", f"""WITH {b.MULTI_SQL}
SELECT vec_id, system, any_value(p.y_true) AS y_true, any_value(y_pred) AS y_pred, {sql_r4('max(p_max)::FLOAT')} AS p_max,
       {', '.join(f"{sql_r4(f'max(prob) FILTER (j = {i})::FLOAT')} AS p_{c}" for i, c in enumerate(b.FAMILIES))}
FROM mc_p p JOIN mc_best USING (vec_id, system) GROUP BY 1, 2""")
def _write_predictions_multiclass(spark, d):
    path = fresh(spark, "pred")
    sinks.write_stage(sinks.multiclass_predictions(qs.predicted(spark, d), ["vec_id", "system"], b.FAMILIES), path)
    return rounded(spark.read.parquet(path))


@query("write_splits", "K9", f"""WITH RECURSIVE {ql.STRAT_SQL}
SELECT split_name, run_id, part, count(*) OVER (PARTITION BY split_name, part) AS listed FROM strat""")
def _write_splits(spark, d):
    table, export = fresh(spark, "splits"), fresh(spark, "splits-json")
    sinks.write_splits(ql.stratified(spark, d), table, export)
    listed = spark.read.json(export)
    sizes = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.size(f"{p}_run_ids").alias("listed")) for p in sp.PARTS]))
    counts = listed.select("split_name", sizes.alias("_e")).select("split_name", "_e.part", "_e.listed")
    return rounded(spark.read.parquet(table).join(counts, ["split_name", "part"]).select("split_name", "run_id", "part", "listed"))


@query("preprocess_summary", "K10", f"WITH {qf.FRAME_SQL} SELECT part, count(*) AS n, {sql_r4('avg((size > 25)::INT)')} AS y_bin_rate FROM f GROUP BY 1")
def _preprocess_summary(spark, d):
    f = qf.frame(spark, d).withColumn("y_bin", (F.col("size") > 25).cast("int"))
    return rounded(sinks.preprocess_summary(f))


@query("lag_curve_maps", "K11", f"WITH {qa.BEST_SQL} SELECT run_id, CAST(lag AS BIGINT) AS lag, {sql_r4('c')} AS corr FROM coarse")
def _lag_curve_maps(spark, d):
    net, rad = qa.recorded_pair(spark, d)
    curves, _ = al.search_best_lag(net, rad, qa.WIN, qa.STEP, 0, qa.MIN_OV, qa.SMOOTH)
    maps = sinks.lag_curve_maps(curves.where("stage = 0"))
    return maps.select("run_id", F.explode("corr_by_lag").alias("lag", "corr")).select("run_id", "lag", r4("corr"))


@query("run_artifacts", "K7 S14 M32", f"""WITH {b.RUNS_SQL}
SELECT 'rf' AS model, CAST(count(*) AS BIGINT) AS n_runs, 7::BIGINT AS depth, 'full' AS ablation FROM runs""")
def _run_artifacts(spark, d):
    from crosswin.sources import readers

    cfg = md.resolve_config({"depth": 3, "binary": {"depth": 5, "network": {"depth": 7}}, "radio": {"depth": 9}}, "binary", "network")
    path = fresh(spark, "artifact")
    sinks.write_run_artifact(spark, path, {
        "model": "rf", "counts": {"n_runs": b.runs(spark, d).count()}, "config": cfg, "feature_ablation": "full"})
    doc = readers.read_run_artifacts(spark, path)
    return doc.select("model", F.col("counts.n_runs").alias("n_runs"), F.col("config.depth").alias("depth"),
                      F.col("feature_ablation").alias("ablation"))
