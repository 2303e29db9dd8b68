"""Edge rules of the flow and radio windows."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from crosswin.functions import expr
from crosswin.operators import network as net
from crosswin.operators import radio
from crosswin.sources import readers

SCHEMA = ("run_id string, ord bigint, family string, flow_start_ts double, flow_duration double, traffic_type string, "
          "attack_category string, attack_type string, proto string, src_bytes double, dst_bytes double, src_port int")


def flows(spark, rows):
    return net.relative_time(spark.createDataFrame(rows, SCHEMA))


def flow(run, o, t, attack=False, dur=0.0, proto="tcp", b=1.0, port=80):
    return (run, o, "DoS", 1000.0 + t, dur, "Attack" if attack else "Benign", "dos" if attack else None,
            "x" if attack else None, proto, b, None, port)


def test_grid_and_edges(spark):
    f = flows(spark, [flow("a", 0, 0.0), flow("a", 1, 10.0, True), flow("a", 2, 14.0), flow("short", 3, 0.0), flow("short", 4, 9.5)])
    w = {r["window_start_s"]: r for r in net.network_windows(f, 10, 2).where("run_id = 'a'").collect()}
    assert sorted(w) == [0, 2, 4]  # full windows only; the run ends at 14
    assert w[0]["n_flows"] == 1 and w[2]["n_flows"] == 1  # a flow at w0 + W belongs to the next window
    assert w[4]["n_flows"] == 1  # 14 is the open end
    s = {r["run_id"]: r for r in net.run_summary(f, 10, 2).collect()}
    assert s["short"]["n_windows"] == 0 and s["short"]["window_occupancy"] is None
    assert s["a"]["t_first_attack_flow_s"] == 10.0 and s["a"]["window_occupancy"] == 1.0


def test_labels_and_stats(spark):
    f = flows(spark, [flow("a", 0, 0.0, True, b=2.0), flow("a", 1, 1.0, b=4.0), flow("a", 2, 2.0, dur=30.0, b=None, port=-1)])
    r = net.network_windows(f, 2, 2).where("window_start_s = 0").first()
    assert r["traffic_type_win"] == "Attack" and r["attack_flow_frac"] == 0.5  # a tie is an attack
    assert r["src_bytes_sum"] == 6.0 and r["src_bytes_mean"] == 3.0 and r["src_bytes_std"] == 1.0
    assert r["dst_bytes_sum"] == 0.0 and r["dst_bytes_mean"] is None and r["dst_bytes_std"] is None
    assert r["attack_category_win"] == "dos"
    second = net.network_windows(f, 2, 2).where("window_start_s = 2").first()
    assert second["src_bytes_sum"] == 0.0 and second["src_bytes_mean"] is None and second["n_unique_src_port"] == 0
    empty = net.network_windows(f, 2, 2).where("window_start_s = 4").first()
    assert empty["empty_window"] == 1 and empty["proto_mode"] is None and empty["proto_n_unique"] == 0


def test_mode_tie_goes_to_first_seen_in_run(spark):
    f = flows(spark, [flow("a", 0, 0.0, proto="z"), flow("a", 1, 5.0, proto="a"), flow("a", 2, 6.0, proto="z"), flow("a", 3, 9.0),
                      flow("b", 5, 0.0, proto="q"), flow("b", 4, 0.0, proto="r"), flow("b", 6, 9.0)])
    w = net.network_windows(f, 4, 4).where("window_start_s = 4 and run_id = 'a'").first()
    assert w["proto_mode"] == "z"  # 'z' came first in the run, though 'a' comes first in the window
    w = net.network_windows(f, 4, 4).where("window_start_s = 0 and run_id = 'b'").first()
    assert w["proto_mode"] == "r"  # same time: input order decides


def test_constant_column_has_zero_std(spark):
    f = flows(spark, [flow("a", i, float(i), b=0.1) for i in range(12)])
    assert {r["src_bytes_std"] for r in net.network_windows(f, 10, 2).collect()} == {0.0}


def test_windows_match_numpy(spark):
    rng = np.random.default_rng(0)
    t = np.sort(rng.uniform(0, 60, 200))
    t[0] = 0.0
    v = rng.normal(1e6, 3.0, 200)
    f = flows(spark, [flow("a", i, float(a), b=float(x)) for i, (a, x) in enumerate(zip(t, v))])
    for W, S in ((10, 2), (5, 2), (3, 7)):
        for r in net.network_windows(f, W, S).collect():
            x = v[(t >= r["window_start_s"]) & (t < r["window_start_s"] + W)]
            assert r["n_flows"] == x.size
            if x.size:
                np.testing.assert_allclose(r["src_bytes_sum"], x.sum())
                np.testing.assert_allclose(r["src_bytes_std"], x.std(), atol=1e-3)


def test_bad_time_fails(spark):
    f = spark.createDataFrame([("a", 0, "x", float("nan"))], "run_id string, ord bigint, family string, flow_start_ts double")
    with pytest.raises(Exception, match="flow_start_ts"):
        net.relative_time(f).collect()


def test_attack_words(spark):
    df = spark.createDataFrame([("Attack_ ",), (" attack",), ("1",), ("yes",), ("benign",), ("no attack",), (None,)], "t string")
    assert [r[0] for r in df.select(expr.is_attack(df, "t")).collect()] == [True, True, True, True, False, False, False]


def records(spark, rows):
    return spark.createDataFrame(rows, "run_id string, family string, ord bigint, ts_raw bigint, ue_id string, dlBytes double, ulBytes double, sinr double")


def test_radio_seconds_rules(spark):
    rows = [
        ("ms", "f", 0, 1_700_000_000_000, "u", None, None, 1.0), ("ms", "f", 1, 1_700_000_000_900, "v", None, None, 3.0),
        ("ms", "f", 2, 1_700_000_002_000, "u", 5.0, 1.0, None), ("ms", "f", 3, None, "u", 99.0, 1.0, 9.0),
        ("imp", "f", 10, None, "u", 7.0, 0.0, 1.0), ("imp", "f", 14, None, "u", 3.0, 0.0, 1.0),
    ]
    sec = {(r["run_id"], r["t_rel_s"]): r for r in radio.radio_seconds(records(spark, rows), ["sinr"]).collect()}
    assert sorted(sec) == [("imp", 0), ("imp", 1), ("ms", 0), ("ms", 1), ("ms", 2)]
    first = sec["ms", 0]
    assert first["dlBytes"] == 0.0 and first["sinr"] == 2.0 and first["row_count"] == 2 and first["ue_count"] == 2
    assert sec["ms", 1]["sec_missing"] == 1 and sec["ms", 1]["totalBytes_counter_filled"] == 0.0
    assert sec["ms", 2]["rate_total"] == 6.0
    assert sec["imp", 1]["reset_indicator"] == 1 and sec["imp", 1]["rate_total"] == 0.0 and sec["imp", 1]["reset_delta_raw"] == -4.0


def test_radio_windows_clip_and_gap(spark):
    rows = [("a", "f", i, None, "u", float(i), 0.0, 1.0) for i in range(6)]
    sec = radio.radio_seconds(records(spark, rows), ["sinr"])
    index = spark.createDataFrame(
        [(r, "f", s, s + 4, "Benign", None, None, 1, 0.0) for r in ("a", "none") for s in (0, 4, 8)],
        "run_id string, family string, window_start_s bigint, window_end_s bigint, traffic_type_win string, "
        "attack_category_win string, attack_type_win string, n_flows bigint, attack_flow_frac double")
    w = {(r["run_id"], r["window_start_s"]): r for r in radio.radio_windows(sec, index, 4, 4, ["sinr"]).collect()}
    assert w["a", 0]["radio_missing_seconds"] == 0 and w["a", 4]["radio_missing_seconds"] == 2
    assert w["a", 8]["radio_window_missing"] == 1 and w["a", 8]["rate_total_sum"] == 0.0 and w["a", 8]["sinr_mean"] is None
    assert w["none", 0]["radio_window_missing"] == 1 and w["none", 0]["radio_missing_seconds"] is None


def test_lenient_lines(spark):
    lines = ['{"dlBytes": 1, "ulBytes": 2},', "b'{\"DL_BYTES\": 1, \"ul_bytes\": 2, \"ueid\": \"x\"}'", "{'dlBytes': 1, 'ulBytes': 2}",
             "noise {\"dlBytes\": 1, \"ulBytes\": 2} tail", "broken {", "   "]
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate(lines)], "run_id string, ord bigint, value string")
    got = readers.lenient_records(df).orderBy("ord").collect()
    assert [r["parse_error"] for r in got] == [0, 0, 0, 0, 1]
    assert [r["tot_bytes"] for r in got][:4] == [3.0] * 4 and got[1]["ue"] == "x" and got[0]["ue"] == "unknown"


def test_read_telemetry_files(spark, tmp_path):
    (tmp_path / "run1.txt").write_text('{"timestamp": 1700000000000, "dlBytes": 1, "ulBytes": 2, "pmi": 1}\nnot json\n[1]\n'
                                       '{"timestamp": 1700000001000, "dlBytes": 4, "ulBytes": 2}\n')
    (tmp_path / "run2.txt").write_text('{"dlBytes": 1, "ulBytes": 2}\n{"dlBytes": 3, "ulBytes": 2}\n')
    got = readers.read_telemetry(spark, str(tmp_path)).orderBy("run_id", "ord").collect()
    assert [r["run_id"] for r in got] == ["run1", "run1", "run2", "run2"]
    assert [r["dlBytes"] for r in got] == ["1", "4", "1", "3"]
    assert got[0]["ts_raw"] == 1700000000000 and got[2]["ts_raw"] is None and "pmi" not in got[0].asDict()


def test_read_telemetry_keeps_all_keys(spark, tmp_path):
    (tmp_path / "r1.txt").write_text('{"ts": 1, "dlBytes": 2, "ulBytes": 3, "newKpi": 7, "pmi": 1}\n{"ts": 2, "other": "x"}\n')
    got = readers.read_telemetry(spark, str(tmp_path))
    assert {"newKpi", "other"} <= set(got.columns) and "pmi" not in got.columns
    assert [r["newKpi"] for r in got.orderBy("ord").collect()] == ["7", None]


def test_lenient_line_with_one_key_in_two_cases(spark):
    df = spark.createDataFrame([("r", '{"dlBytes": 1, "dlbytes": 5, "ulBytes": 2}')], "run_id string, value string")
    assert readers.lenient_records(df).first()["tot_bytes"] == 7.0


def many_runs(spark, n=40):
    rows = [flow(f"r{i}", 1000 * i + j, 3.0 * j, j % 4 == 0, proto=f"p{j % 3}", port=j % 5) for i in range(n) for j in range(30)]
    return flows(spark, rows)


def executed(df):
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def test_the_grid_is_never_broadcast(spark):
    f = many_runs(spark)
    for df in (net.run_summary(f, 10, 2), net.network_windows(f, 10, 2, keep_empty_windows=False), net.index_windows(f, 10, 2)):
        _, plan = executed(df)
        joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
        assert not [line for line in joins if re.search(r"Join \[run_id#\d+, window_start_s#", line)], joins


def test_values_are_not_shuffled_once_per_window(spark):
    f = many_runs(spark, 5)
    _, plan = executed(net.network_windows(f, 10, 2))
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "window_start_s" in line]
    assert moved and not [line for line in moved if "field" in line or "value" in line], moved


def test_heavy_chunks_give_the_same_windows(spark, monkeypatch):
    f = many_runs(spark, 3).unionByName(flows(spark, [flow("long", j, 7.0 * j, j % 9 == 0, proto=f"p{j % 4}", port=j) for j in range(120)]))
    want = sorted(map(tuple, net.network_windows(f, 10, 2).collect()), key=str)
    monkeypatch.setattr(net, "ROWS_PER_TASK", 60)  # some chunks are above it, others below
    assert sorted(map(tuple, net.network_windows(f, 10, 2).collect()), key=str) == want


def test_index_windows_equals_the_index_of_all_windows(spark):
    f = many_runs(spark, 4)
    for keep in (True, False):
        whole = net.window_index(net.network_windows(f, 10, 4, keep_empty_windows=keep))
        alone = net.index_windows(f, 10, 4, keep_empty_windows=keep)
        assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, alone.collect()), key=str)


def test_radio_panes_meet_in_chunks(spark):
    """Radio panes are shuffled by run and chunk, not once per window they belong to."""
    f = many_runs(spark, 3)
    rows = [(f"r{i}", "DoS", j, 100.0 + j, 1.0 * j, 2.0, 3.0 + j % 4, "u") for i in range(2) for j in range(50)]
    records = spark.createDataFrame(rows, "run_id string, family string, ord bigint, ts_raw double, dlBytes double, ulBytes double, sinr double, ue_id string")
    w = radio.radio_windows(radio.radio_seconds(records, ["sinr"]), net.index_windows(f, 10, 2), 10, 2, ["sinr"])
    got, plan = executed(w)
    fanned = [line for line in plan.splitlines() if "partial_sum(sinr__s" in line]
    assert fanned and all("_c#" in line for line in fanned), fanned
    first = next(r for r in got if r["run_id"] == "r0" and r["window_start_s"] == 0)
    assert first["radio_present_seconds"] == 10 and first["row_count_sum"] == 10
    assert first["sinr_mean"] == pytest.approx(sum(3.0 + j % 4 for j in range(10)) / 10)
    alone = next(r for r in got if r["run_id"] == "r2" and r["window_start_s"] == 0)  # a run without telemetry
    assert alone["radio_window_missing"] == 1 and alone["rate_total_sum"] is None and alone["radio_present_seconds"] is None


def test_measures_and_values_meet_without_a_shuffle_per_window(spark):
    """No exchange by window, also not of results; the tasks grow with the rows, not with the session."""
    _, plan = executed(net.network_windows(many_runs(spark, 5), 10, 2))
    assert "SortMergeJoin" not in plan
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert not [line for line in moved if re.search(r"[ (]window_start_s#", line)], moved
    assert net.meeting_tasks(100 * net.MEETING_ROWS, spark) == 100


def test_families_are_no_sorted_state_of_panes(spark):
    f = many_runs(spark, 3)
    assert "SortAggregate" not in net.pane_measures(f, 10, 2)._jdf.queryExecution().executedPlan().toString()
    two = f.withColumn("family", F.when(F.col("ord") % 2 == 0, "B").otherwise("A"))  # the smallest one counts
    assert {r["family"] for r in net.network_windows(two, 10, 2).collect()} == {"A"}
    strip = lambda df: sorted(map(tuple, df.drop("family").collect()), key=str)
    assert strip(net.network_windows(two, 10, 2)) == strip(net.network_windows(f, 10, 2))


def test_reported_seconds_give_the_windows_of_all_seconds(spark):
    rows = []
    for run, times in (("a", [0, 0, 3, 4, 17, 18, 40]), ("b", [5, 6, 30]), ("c", [2]), ("imp", [None] * 4)):
        rows += [(run, "f", 10 * i, None if t is None else 1000 + t, "u" if i % 2 else "v",
                  None if i % 3 == 2 else float((7 * i) % 5), 2.0 * i, None if i % 4 == 1 else 1.5 * i) for i, t in enumerate(times)]
    recs = records(spark, rows)
    index = spark.createDataFrame(
        [(r, "f", s, s + 10, "Benign", None, None, 1, 0.0) for r in ("a", "b", "c", "imp", "none") for s in range(0, 60, 2)],
        "run_id string, family string, window_start_s bigint, window_end_s bigint, traffic_type_win string, "
        "attack_category_win string, attack_type_win string, n_flows bigint, attack_flow_frac double")
    dense = radio.radio_seconds(recs, ["sinr"])
    sec, lengths = radio.reported_seconds(recs, ["sinr"])
    key = lambda r: (r["run_id"], r["t_rel_s"])
    assert sorted(map(tuple, sec.collect()), key=str) == sorted(map(tuple, dense.where("sec_has_record").select(sec.columns).collect()), key=str)
    assert {key(r) for r in sec.collect()} < {key(r) for r in dense.collect()}
    at = lambda df: {(r["run_id"], r["window_start_s"]): r for r in df.collect()}
    want = at(radio.radio_windows(dense, index, 10, 2, ["sinr"]))
    got = at(radio.radio_windows(sec, index, 10, 2, ["sinr"], lengths))
    assert got.keys() == want.keys()
    for k, r in want.items():
        for c, v in r.asDict().items():
            assert got[k][c] == (pytest.approx(v, abs=1e-9) if isinstance(v, float) else v), (k, c)


def test_a_window_merges_five_numbers_of_a_column(spark):
    panes = net.pane_measures(many_runs(spark, 1), 10, 2)
    state = [c for c in panes.columns if c.startswith("src_bytes__")]
    merged = panes.groupBy("run_id").agg(*net.moment_merge(["src_bytes"])).columns[1:]
    assert merged == state and len(state) == 5
