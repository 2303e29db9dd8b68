"""Edge rules of alignment, splits, metrics, time to detect, features and checks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from crosswin.functions import expr
from crosswin.operators import alignment as al
from crosswin.operators import features as ft
from crosswin.operators import fusion as fu
from crosswin.operators import metrics as mt
from crosswin.operators import models as md
from crosswin.operators import pairing
from crosswin.operators import splits as sp
from crosswin.operators import ttd


def series_of(spark, runs):
    return spark.createDataFrame(
        [(k, i, float(v)) for k, x in runs.items() for i, v in enumerate(x)], "run_id string, t bigint, v double")


def brute_corr(x, y, lag, smooth, log):
    t = [i for i in range(len(x)) if 0 <= i - lag < len(y)]
    a, b = np.array([x[i] for i in t]), np.array([y[i - lag] for i in t])
    if log:
        a, b = np.log1p(np.maximum(a, 0)), np.log1p(np.maximum(b, 0))
    if smooth > 1 and len(t):
        k = np.ones(smooth) / smooth
        a, b = np.convolve(a, k, "same"), np.convolve(b, k, "same")
    if len(t) < 3 or a.std() == 0 or b.std() == 0:
        return len(t), None
    return len(t), np.corrcoef(a, b)[0, 1]


@pytest.mark.parametrize("smooth,log", [(1, False), (3, True), (4, False)])
def test_lag_search_against_brute_force(spark, smooth, log):
    rng = np.random.default_rng(3)
    # a slowly changing signal, so that the coarse sweep lands near the peak
    x = np.convolve(rng.gamma(2, 10, 110), np.ones(14) / 14, "valid")[:90]
    y = np.concatenate([np.full(7, x[0]), x])[:80] + rng.normal(0, 0.01, 80)
    net = series_of(spark, {"a": x, "flat": np.ones(40)})
    rad = series_of(spark, {"a": y, "flat": np.arange(40.0)})
    curves, plan = al.search_best_lag(net, rad, 20, 5, 4, 30, smooth, log, block=16)
    got = {(r["run_id"], r["lag"]): r for r in curves.collect()}
    for (run, lag), r in got.items():
        n, c = brute_corr(x if run == "a" else np.ones(40), y if run == "a" else np.arange(40.0), lag, smooth, log)
        assert r["overlap"] == n
        if run == "a":
            assert r["corr"] == pytest.approx(c, abs=1e-9)
    best = {r["run_id"]: r for r in al.best_lag(curves, plan, 20, 3).collect()}
    assert best["a"]["best_lag"] == -7
    assert smooth > 1 or best["flat"]["best_corr"] is None and best["flat"]["best_lag"] == -20


def test_acceptance_reasons(spark):
    rng = np.random.default_rng(5)
    x = rng.gamma(2, 10, 200)
    net = series_of(spark, {"good": x, "noise": x, "tiny": x[:2], "short": x[:25]})
    rad = series_of(spark, {"good": x + rng.normal(0, 0.1, 200), "noise": rng.gamma(2, 10, 200), "tiny": x[:2], "short": x[:25]})
    reasons = {}
    for block in (al.NULL_BLOCK, 37):  # runs of one block and of several
        r = al.align_runs(net, rad, 10, 2, 2, 20, 1, False, 3, 60, 0.99, 0.0, null_block=block)
        rows = {q["run_id"]: q for q in r.collect()}
        reasons[block] = {k: (v["reason"], round(v["null_threshold"] or 0, 9)) for k, v in rows.items()}
    assert reasons[al.NULL_BLOCK] == reasons[37]
    got = {k: v[0] for k, v in reasons[37].items()}
    assert got["good"] == "accepted" and got["tiny"] == "no_overlap_for_best_lag" and got["short"] == "too_short"
    assert got["noise"] in ("below_null_threshold", "unstable_halves", "accepted")
    tiers = {q["run_id"]: q["tier"] for q in al.assign_tiers(r).collect()}
    assert tiers["good"] == "strong" and tiers["tiny"] == "rejected"


def test_rotations_leave_out_missing_values(spark):
    rng = np.random.default_rng(9)
    x, y = rng.gamma(2, 10, 150), rng.gamma(2, 10, 150)
    x[[3, 70]], y[[5, 149]] = np.nan, np.nan
    shifts = [11, 40, 75, 139, 40]
    rows = [("gaps", i, None if i == 70 else float(x[i]), float(y[i])) for i in range(150)]
    rows += [("whole", i, float(i % 7), float(i % 5)) for i in range(150)]
    aligned = spark.createDataFrame(rows, "run_id string, i long, x double, y double")
    runs = spark.createDataFrame([("gaps", 150, shifts), ("whole", 150, shifts)], "run_id string, n long, shifts array<bigint>")

    def brute(x, y):
        out = []
        for s in shifts:
            w = np.roll(y, s)
            ok = ~(np.isnan(x) | np.isnan(w))
            out.append(np.corrcoef(x[ok], w[ok])[0, 1])
        return np.quantile(out, 0.9)

    want = {"gaps": brute(x, y), "whole": brute(np.arange(150) % 7.0, np.arange(150) % 5.0)}
    for block in (8192, 150, 64, 7):
        got = {r.run_id: (r.n_null, r.null_threshold) for r in al.circular_shift_null(aligned, runs, 0.9, block).collect()}
        assert {k: n for k, (n, _) in got.items()} == {"gaps": 5, "whole": 5}
        assert all(got[k][1] == pytest.approx(want[k], abs=1e-9) for k in want), block


def test_tcp_alias(spark):
    paths = spark.createDataFrame([
        ("F", "network", "/n/X.pcap"), ("F", "radio", "/r/tcp-X.txt"), ("F", "network", "/n/tcp_Y.pcap"),
        ("F", "network", "/n/Y.pcap"), ("F", "radio", "/r/tcp_Y.txt"), ("F", "radio", "/r/tcp_Z.txt")],
        "family string, layer string, path string")
    stems = pairing.stem_keys(paths)
    got = {r["path"]: (r["canon_stem"], r["aliased"]) for r in pairing.alias_keys(stems).where("layer = 'radio'").collect()}
    assert got == {"/r/tcp-X.txt": ("x", 1), "/r/tcp_Y.txt": ("tcp_y", 0), "/r/tcp_Z.txt": ("tcp_z", 0)}
    assert pairing.alias_keys(stems, "always").where("layer = 'radio'").count() == 6
    assert {r["aliased"] for r in pairing.alias_keys(stems, "off").collect()} == {0}


def expected_allocation(n, vf, tf):
    if n < 4:
        return max(1, n - 2), int(n >= 2), int(n >= 3)
    t, v = max(1, round(n * tf)), max(1, round(n * vf))
    while t + v > n - 1:
        t, v = (t - 1, v) if t >= v else (t, v - 1)
    return n - t - v, v, t


def test_family_allocation(spark):
    df = spark.range(1, 60).withColumnRenamed("id", "n")
    for vf, tf in ((0.15, 0.15), (0.6, 0.45), (0.45, 0.6), (0.9, 0.05), (0.5, 0.5)):
        a, b, c = sp.family_allocation(F.col("n"), vf, tf)
        for r in df.select("n", a.alias("a"), b.alias("b"), c.alias("c")).collect():
            assert (r["a"], r["b"], r["c"]) == expected_allocation(r["n"], vf, tf)


def test_time_ordered_split_is_optimal(spark):
    rng = np.random.default_rng(2)
    for trial in range(3):
        fam = ["Benign" if v < 0.3 else "DoS" for v in rng.random(14)]
        fam[0], fam[-1] = "Benign", "DoS"
        fam[6], fam[7], fam[-2] = "DoS", "Benign", "Benign"
        runs = spark.createDataFrame([(f"r{i}", f, float(i)) for i, f in enumerate(fam)], "run_id string, family string, run_start_ts double")
        got = {r["run_id"]: r["part"] for r in sp.split_time_ordered(runs, 1, 0.2, 0.25).collect()}
        n, v, t = 14, max(1, round(14 * 0.2)), max(1, round(14 * 0.25))
        both = lambda p: {f == "Benign" for f in p} == {True, False}
        cand = [(abs(i - (n - v - t)) + abs(j - i - v) + abs(n - j - t), i, j) for i in range(1, n - 1) for j in range(i + 1, n)
                if both(fam[:i]) and both(fam[i:j]) and both(fam[j:])]
        _, i, j = min(cand)
        assert [got[f"r{k}"] for k in range(n)] == ["train"] * i + ["val"] * (j - i) + ["test"] * (n - j)


def test_stratified_split_covers_runs(spark):
    runs = spark.createDataFrame(
        [(f"r{i}", "Benign" if i % 3 == 0 else "DoS", 10 + (i * 37) % 50) for i in range(90)] + [("s1", "Tiny", 5), ("s2", "Tiny", 5)],
        "run_id string, family string, rows bigint")
    s = sp.split_stratified(runs, [1, 2])
    assert sp.split_overlaps(s).count() == 0 and sp.split_coverage(s, runs).count() == 0
    assert s.where("run_id in ('s1', 's2')").groupBy("part").count().count() == 2


def test_folds_need_two_runs_per_class(spark):
    rows = spark.createDataFrame([("a", "Benign"), ("b", "DoS"), ("c", "DoS")], "run_id string, family string")
    with pytest.raises(ValueError, match="too few runs"):
        sp.run_folds_binary(rows, 3, 1)
    with pytest.raises(ValueError, match="one class"):
        sp.run_folds_binary(rows.where("family = 'DoS'"), 3, 1)


def test_ranking_metrics_edges(spark):
    rows = spark.createDataFrame(
        [("tie", 0.5, 1), ("tie", 0.5, 0), ("one", 0.2, 1), ("one", 0.7, 1), ("nan", float("nan"), 0), ("nan", 1.0, 1), ("nan", 0.0, 1)],
        "g string, score double, y_bin int")
    m = {r["g"]: r for r in mt.binary_metrics(rows, ["g"]).collect()}
    assert m["tie"]["roc_auc"] == 0.5 and m["tie"]["pr_auc"] == 0.5
    assert m["one"]["roc_auc"] is None and m["one"]["pr_auc"] == 1.0
    assert m["nan"]["roc_auc"] == 0.75


def test_calibration_bins(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (1 / 15,), (14 / 15,), (0.5,)], "p double")
    assert [r[0] for r in df.select(mt.ece_bin(F.col("p"))).collect()] == [14, 0, 1, 14, 7]


def test_thresholds_and_missing_ones(spark):
    train = spark.createDataFrame([("s", "DoS", 0.3, 0, 10.0, float("inf"))], "system string, family string, score double, y_bin int, window_end_s double, onset_s double")
    t = mt.benign_thresholds(train, ["system"], ["family_benign", "all_benign"], [0.01])
    got = {r["threshold_policy"]: r["threshold"] for r in t.collect()}
    assert got == {"benign_runs_only": None, "all_benign_labeled": 0.3}
    o = {r["threshold_policy"]: r for r in mt.operating_points(train, t, ["system"], []).collect()}
    assert o["benign_runs_only"]["tn"] == 1 and o["benign_runs_only"]["fp"] == 0 and o["benign_runs_only"]["tpr"] is None
    with pytest.raises(ValueError):
        mt.policy_name("whatever")


def test_time_to_detect(spark):
    rows = spark.createDataFrame([
        ("m", "hit", "DoS", 0, 10, 0, 0.9), ("m", "hit", "DoS", 10, 20, 1, 0.9), ("m", "miss", "DoS", 0, 10, 1, 0.1),
        ("m", "quiet", "DoS", 0, 10, 0, 0.9), ("m", "ok", "Benign", 0, 10, 1, 0.9)],
        "system string, run_id string, family string, window_start_s bigint, window_end_s bigint, y_bin int, score double")
    thr = spark.createDataFrame([("m", "p", 0.01, 0.5)], "system string, threshold_policy string, fpr_target double, threshold double")
    onsets = ttd.onset_map(spark.createDataFrame(
        [("hit", 0, "DoS", 15.0), ("hit", 1, "DoS", 1.0), ("miss", 2, "DoS", 1.0), ("quiet", 3, "DoS", 3.0), ("ok", 4, " benign ", None), ("bad", 5, "DoS", None)],
        "run_id string, ord int, family string, t_first_attack_flow_s double"))
    assert {r["run_id"]: r["valid"] for r in onsets.collect()} == {"hit": True, "miss": True, "quiet": True, "ok": True, "bad": False}
    flow = {r["run_id"]: r for r in ttd.first_detections(rows, ttd.attack_onsets(onsets), thr, ["system"]).collect()}
    assert flow["hit"]["ttd_s"] == 5.0 and flow["quiet"]["ttd_s"] == 7.0 and flow["miss"]["ttd_s"] == float("inf") and "ok" not in flow
    win = ttd.first_detections(rows, ttd.window_onsets(rows), thr, ["system"])
    w = {r["run_id"]: r for r in win.collect()}
    assert w["hit"]["ttd_s"] == 0.0 and w["quiet"]["onset_s"] is None and not w["quiet"]["detected"]
    s = ttd.summarize_ttd(win.where("run_id in ('miss', 'quiet')"), ["system"]).first()
    assert s["detect_rate"] == 0.0 and s["ttd_median"] == float("inf")


def test_probabilities(spark):
    df = spark.createDataFrame([([0.0, -1.0, float("nan")],), ([2.0, 2.0, float("inf")],)], "p array<double>")
    got = [r[0] for r in df.select(expr.sanitize_proba("p")).collect()]
    np.testing.assert_allclose(got[0], [1 / 3] * 3)
    np.testing.assert_allclose(got[1], [0.5, 0.5, 0.0], atol=1e-12)
    assert df.select(expr.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0)))).first()[0] == 1
    two = spark.createDataFrame([(float("nan"), 0.25, [0.0, 0.0], [0.0, 0.0])], "a double, b double, x array<double>, y array<double>")
    r = two.select(fu.fusion_mean_binary("a", "b").alias("m"), fu.fusion_mean_multiclass("x", "y").alias("z")).first()
    assert r["m"] == 0.375 and r["z"] == [0.0, 0.0]


def test_class_columns():
    assert expr.class_column_names(["a b", "a_b", "", "é"]) == ["p_a_b", "p_a_b__2", "p_cls2", "p__"]


def test_transform_edges(spark):
    train = spark.createDataFrame([("x", 1.0, 5.0, None), ("y", 1.0, 100.0, None), (None, 1.0, None, None)], "c string, k double, v double, e double")
    t = ft.fit_transform(train, ["k", "v", "e"], ["c"])
    assert t.log == ["v"] and t.plain == ["k", "e"] and t.categories == {"c": ["x", "y"]} and t.modes == {"c": "x"}
    r = t.apply(spark.createDataFrame([("new", 3.0, -4.0, None)], train.schema), []).first()
    assert r["c_x"] == 0.0 and r["c_y"] == 0.0 and r["k"] == 2.0 and r["e"] == 0.0
    assert r["v__log1p"] == pytest.approx((0 - t.stats["v"][1]) / t.stats["v"][2])


def test_sequences(spark):
    rows = spark.createDataFrame([("a", i, float(i)) for i in range(1, 8)] + [("b", 1, 9.0)], "run_id string, window_start_s bigint, v double")
    got = {(r["run_id"], r["window_start_s"]): r["sequence"] for r in ft.causal_sequences(rows, ["v"], 3, block=2).collect()}
    assert got["a", 1] == [[0, 1], [0, 1], [1, 0]] and got["a", 7] == [[5, 0], [6, 0], [7, 0]] and got["b", 1][2] == [9, 0]


def test_config_and_search_space():
    cfg = {"enabled": True, "d": 1, "e": 1, "binary": {"d": 2, "network": {"d": 3}}, "network": {"d": 9, "e": 9}, "binary__network": {"z": 1}}
    assert md.resolve_config(cfg, "binary", "network") == {"d": 3, "e": 1, "z": 1}
    assert md.resolve_config(cfg, "multiclass", "network") == {"d": 9, "e": 9}
    draws = md.sample_params({"C": (0.1, 10.0, "log"), "n": (1, 3), "s": ["a", "b"]}, 20, 1)
    assert draws == md.sample_params({"C": (0.1, 10.0, "log"), "n": (1, 3), "s": ["a", "b"]}, 20, 1)
    assert all(0.1 <= p["C"] <= 10 and p["n"] in (1, 2, 3) for p in draws)


def test_dealing_in_closed_form_equals_the_greedy_loop():
    from crosswin.operators.splits import dealt, loads_after

    rng = np.random.default_rng(4)
    for _ in range(300):
        k, size, count = int(rng.integers(2, 7)), int(rng.integers(1, 12)), int(rng.integers(1, 60))
        loads = rng.integers(0, 50, k) * rng.integers(0, 2, k)
        now, want = loads.copy(), []
        for _ in range(count):
            f = int(np.argmin(now))
            now[f] += size
            want.append(f)
        got, _ = dealt(np.tile(loads, (count, 1)), np.full(count, size), np.arange(count))
        assert got.tolist() == want and loads_after(loads, size, count).tolist() == now.tolist()


def test_stages_keep_existing_partitions(spark, tmp_path):
    from crosswin.sources import sinks

    path = str(tmp_path / "stage")
    rows = lambda *r: spark.createDataFrame(list(r), "W int, S int, v int")
    read = lambda: sorted((tuple(r) for r in spark.read.parquet(path).select("W", "S", "v").collect()), key=str)
    sinks.write_stage(rows((10, 2, 1), (10, 2, 2)), path, ["W", "S"])
    sinks.write_stage(rows((5, 2, 3), (10, 2, 9)), path, ["W", "S"])
    assert read() == [(10, 2, 1), (10, 2, 2), (5, 2, 3)]
    sinks.write_stage(rows((10, 2, 7)), path, ["W", "S"], force=True)
    sinks.write_stage(rows((None, 2, 8)), path, ["W", "S"])
    sinks.write_stage(rows((None, 2, 9)), path, ["W", "S"])
    assert read() == sorted([(5, 2, 3), (10, 2, 7), (None, 2, 8)], key=str)


def test_columns_of_very_many_categories(spark):
    from crosswin.operators import features as ft

    n = 100_000
    rows = spark.range(n).selectExpr(
        "'a' AS split_name", "CASE WHEN id % 10 = 9 THEN 'val' ELSE 'train' END AS part", "id", "CAST(id AS double) AS x", "concat('v', id % 50000) AS name")
    t = ft.fit_all_splits(rows, ["x"], ["name"])
    out = t.apply(rows, ["id", "part"])
    assert t.dictionary.count() == out.first()["n_features"] - 1 == 45_000  # values that train lacks have no entry
    assert out.where("size(indices) = 2").count() == 90_000 and out.where("part = 'val' AND size(indices) <> 1").count() == 0
    only_numbers = ft.fit_all_splits(rows, ["x"], []).apply(rows, ["id"])
    assert only_numbers.where("size(values) <> 1 OR n_features <> 1").count() == 0


def test_meetings_of_shift_blocks_are_not_broadcast(spark):
    from crosswin.operators.scale import settle

    series = spark.range(64).selectExpr("'a' as run_id", "id as i", "cast(id % 7 as double) as x", "cast(id % 5 as double) as y")
    runs = settle(spark.sql("select 'a' as run_id, 64L as n, array(10L, 20L, 33L) as shifts"), "runs")
    null = al.circular_shift_null(series, runs, 0.9, block=8)
    assert null.first()["n_null"] == 3
    null.collect()
    plan = null._jdf.queryExecution().executedPlan().toString().splitlines()
    joins = [line for line in plan if "Join [run_id#" in line and (", b#" in line or ", yb#" in line)]
    assert joins and not [line for line in joins if "Broadcast" in line], joins


def test_absent_seconds_are_zeros_of_the_series(spark):
    """Runs without rows for idle seconds, whole blocks of them too, align like their dense form."""
    rng = np.random.default_rng(21)
    x = np.where(rng.random(160) < 0.3, rng.gamma(2, 10, 160), 0.0)
    x[60:110], x[0], x[-1] = 0.0, 1.0, 2.0  # no row in blocks of 16 seconds
    y = np.concatenate([x[3:], [4.0, 0.0, 5.0]])
    dense = [series_of(spark, {"a": v, "b": v[::-1].copy()}) for v in (x, y)]
    few = [s.where("v <> 0 OR t = 0 OR t = 159") for s in dense]
    out = []
    for net, rad in (dense, few):
        curves, _ = al.search_best_lag(net, rad, 12, 3, 3, 30, 3, block=16)
        r = al.align_runs(net, rad, 12, 3, 3, 30, 3, False, 3, 40, 0.9, 0.0, block=16, null_block=32)
        out.append([sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in q) for q in df.collect()), key=str) for df in (curves, r)])
    assert out[0] == out[1]
    assert {q[0]: q[4] for q in out[1][1]}["a"] == 3


def test_aligned_blocks_of_missing_values(spark):
    net = spark.createDataFrame([("a", t, None if t in (4, 5) else float(t + 1)) for t in range(9)], "run_id string, t bigint, v double")
    rad = spark.createDataFrame([("a", t, float("nan") if t == 8 else 1.0) for t in range(9)], "run_id string, t bigint, v double")
    best = spark.createDataFrame([("a", 0, 9, 9)], "run_id string, best_lag bigint, n_net bigint, n_rad bigint")
    for block in (100, 4):
        rows = sorted(al.aligned_blocks(net, rad, best, 1, False, block).collect(), key=lambda r: r["b"])
        x = [v for r in rows for v in r["x"]]
        assert [i for i, v in enumerate(x) if v is None] == [4, 5, 8] and x[6] == 7.0
        rows = sorted(al.aligned_blocks(net, rad, best, 2, False, block).collect(), key=lambda r: r["b"])
        x = [v for r in rows for v in r["x"]]  # two points each: nulls alone are missing, a NaN spreads
        assert [i for i, v in enumerate(x) if v is None] == [5, 8] and x[4] == 2.0 and x[6] == 3.5
