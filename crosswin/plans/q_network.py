"""Flow records: relative time, window grid, window features, run summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosswin.functions.expr import is_attack
from crosswin.operators import network as net
from crosswin.plans import bindings as b
from crosswin.plans.registry import query, r4, rounded, sql_r4
from crosswin.sources import readers

W, S = 10, 2

REL_SQL = b.FLOWS_SQL + """,
rel AS (SELECT *, flow_start_ts - min(flow_start_ts) OVER (PARTITION BY run_id) AS t FROM flows)"""


def grid_sql(w: int = W, s: int = S) -> str:
    return REL_SQL + f""",
spans AS (
  SELECT run_id, min(family) AS family, count(*) AS n_flows_total,
         max(t + greatest(coalesce(flow_duration, 0), 0)) AS run_end_s, min(CASE WHEN attack THEN t END) AS t_first
  FROM rel GROUP BY run_id),
spans2 AS (
  SELECT *, CASE WHEN run_end_s > 0 AND floor((run_end_s - {w}) / {s}) * {s} >= 0
                 THEN CAST(floor((run_end_s - {w}) / {s}) * {s} AS BIGINT) ELSE -1 END AS last_start_s
  FROM spans),
grid AS (
  SELECT run_id, family, unnest(range(0, last_start_s + 1, {s})) AS w0 FROM spans2 WHERE last_start_s >= 0),
fw AS (
  SELECT g.run_id, g.w0, r.* EXCLUDE (run_id, family)
  FROM grid g JOIN rel r ON r.run_id = g.run_id AND r.t >= g.w0 AND r.t < g.w0 + {w})"""


WIN_SQL = grid_sql()


def timed_flows(spark, d):
    return net.relative_time(b.flows(spark, d))


@query("relative_time", "P3", f"""WITH {REL_SQL}
SELECT run_id, ord, {sql_r4('t')} AS t_rel_s FROM rel""")
def _relative_time(spark, d):
    return timed_flows(spark, d).select("run_id", "ord", r4("t_rel_s"))


@query("is_attack", "P2", f"""WITH {b.FLOWS_SQL}
SELECT traffic_type, k % 2 = 1 AS as_bool, CAST(k % 3 AS BIGINT) AS as_number,
       attack AS text_attack, k % 2 = 1 AS bool_attack, k % 3 > 0 AS number_attack, CAST(count(*) AS BIGINT) AS n
FROM flows GROUP BY ALL""")
def _is_attack(spark, d):
    f = b.flows(spark, d).select(
        "traffic_type", (F.col("src_port") % 2 == 1).alias("as_bool"),
        (F.col("src_port") % 3).cast("bigint").alias("as_number"))
    return f.select(
        "*", is_attack(f, "traffic_type").alias("text_attack"), is_attack(f, "as_bool").alias("bool_attack"),
        is_attack(f, "as_number").alias("number_attack"),
    ).groupBy("traffic_type", "as_bool", "as_number", "text_attack", "bool_attack", "number_attack").agg(
        F.count("*").alias("n"))


@query("attach_family", "J4 S1", f"""WITH {b.FLOWS_SQL}, {b.RUNS_SQL},
kept AS (SELECT run_id, family FROM runs WHERE family <> 'Web')
SELECT f.run_id, k.family, CAST(count(*) AS BIGINT) AS n, {sql_r4('sum(src_bytes)')} AS src_bytes
FROM flows f JOIN kept k USING (run_id) GROUP BY 1, 2""")
def _attach_family(spark, d):
    manifest = b.runs(spark, d).where("family <> 'Web'")
    flows = readers.keep_runs(b.flows(spark, d).drop("family"), manifest, columns=["src_bytes"])
    return net.attach_family(flows, manifest).groupBy("run_id", "family").agg(
        F.count("*").alias("n"), F.sum("src_bytes").alias("src_bytes")).select(
        "run_id", "family", "n", r4("src_bytes"))


@query("runs_without_family", "J4", f"""WITH {b.FLOWS_SQL}, {b.RUNS_SQL}
SELECT DISTINCT run_id FROM flows WHERE run_id NOT IN (SELECT run_id FROM runs WHERE family <> 'Web')""")
def _runs_without_family(spark, d):
    return net.runs_without_family(b.flows(spark, d), b.runs(spark, d).where("family <> 'Web'"))


@query("window_grid", "A8", f"""WITH {WIN_SQL}
SELECT run_id, family, w0 AS window_start_s, w0 + {W} AS window_end_s FROM grid""")
def _window_grid(spark, d):
    return net.window_grid(net.run_spans(timed_flows(spark, d), W, S), W, S)


@query("flows_to_windows", "J5 W11", f"""WITH {WIN_SQL}
SELECT run_id, ord, w0 AS window_start_s, w0 + {W} AS window_end_s FROM fw""")
def _flows_to_windows(spark, d):
    timed = timed_flows(spark, d)
    return net.flows_to_windows(timed.select("run_id", "ord", "t_rel_s"), net.run_spans(timed, W, S), W, S).select(
        "run_id", "ord", "window_start_s", "window_end_s")


LABEL_SQL = f"""SELECT g.run_id, g.family, g.w0 AS window_start_s, count(f.ord) AS n_flows,
       CAST(count(f.ord) = 0 AS BIGINT) AS empty_window,
       count(CASE WHEN f.attack THEN 1 END) AS attack_flow_count,
       count(CASE WHEN NOT f.attack THEN 1 END) AS benign_flow_count,
       {sql_r4('coalesce(count(CASE WHEN f.attack THEN 1 END)::DOUBLE / nullif(count(f.ord), 0), 0)')} AS attack_flow_frac,
       CAST(count(CASE WHEN f.attack THEN 1 END) > 0 AS BIGINT) AS window_has_attack_flow,
       CASE WHEN count(f.ord) > 0 AND count(CASE WHEN f.attack THEN 1 END) * 2 >= count(f.ord) THEN 'Attack' ELSE 'Benign' END AS traffic_type_win"""


@query("window_label_counts", "A1 J6", f"""WITH {WIN_SQL}
{LABEL_SQL} FROM grid g LEFT JOIN fw f USING (run_id, w0) GROUP BY 1, 2, 3""")
def _window_label_counts(spark, d):
    f = timed_flows(spark, d).select("run_id", "family", "ord", "t_rel_s", "flow_duration", "traffic_type")
    return rounded(net.network_windows(f, W, S).select(
        "run_id", "family", "window_start_s", "n_flows", "empty_window", "attack_flow_count",
        "benign_flow_count", "attack_flow_frac", "window_has_attack_flow", "traffic_type_win"))


@query("windows_without_empty", "J6", f"""WITH {WIN_SQL}
{LABEL_SQL} FROM grid g JOIN fw f USING (run_id, w0) GROUP BY 1, 2, 3""")
def _windows_without_empty(spark, d):
    f = timed_flows(spark, d).select("run_id", "family", "ord", "t_rel_s", "flow_duration", "traffic_type")
    return rounded(net.network_windows(f, W, S, keep_empty_windows=False).select(
        "run_id", "family", "window_start_s", "n_flows", "empty_window", "attack_flow_count",
        "benign_flow_count", "attack_flow_frac", "window_has_attack_flow", "traffic_type_win"))


def _stat_sql(c: str) -> str:
    return (f"{sql_r4(f'coalesce(sum(f.{c}), 0)')} AS {c}_sum, {sql_r4(f'avg(f.{c})')} AS {c}_mean, "
            f"{sql_r4(f'stddev_pop(f.{c})')} AS {c}_std")


@query("window_numeric_stats", "A2 A3", f"""WITH {WIN_SQL}
SELECT g.run_id, g.w0 AS window_start_s, {', '.join(_stat_sql(c) for c in net.NUMERIC)},
       {sql_r4('coalesce(sum(f.src_bytes), 0) + coalesce(sum(f.dst_bytes), 0)')} AS total_bytes_sum,
       {sql_r4(f'(coalesce(sum(f.src_bytes), 0) + coalesce(sum(f.dst_bytes), 0)) / {W}')} AS bytes_per_s,
       {sql_r4('coalesce(sum(f.src_pkts), 0) + coalesce(sum(f.dst_pkts), 0)')} AS total_pkts_sum,
       {sql_r4(f'(coalesce(sum(f.src_pkts), 0) + coalesce(sum(f.dst_pkts), 0)) / {W}')} AS pkts_per_s,
       {sql_r4(f'count(f.ord)::DOUBLE / {W}')} AS flows_per_s
FROM grid g LEFT JOIN fw f USING (run_id, w0) GROUP BY 1, 2""")
def _window_numeric_stats(spark, d):
    f = timed_flows(spark, d).select(
        "run_id", "family", "ord", "t_rel_s", "flow_duration", "traffic_type", *net.NUMERIC)
    keep = ["run_id", "window_start_s"]
    keep += [f"{c}_{k}" for c in net.NUMERIC for k in ("sum", "mean", "std")]
    keep += ["total_bytes_sum", "bytes_per_s", "total_pkts_sum", "pkts_per_s", "flows_per_s"]
    return rounded(net.network_windows(f, W, S).select(*keep))


@query("window_flag_stats", "A7", f"""WITH {WIN_SQL}
SELECT g.run_id, g.w0 AS window_start_s, {', '.join(
    f"{sql_r4(f'coalesce(sum(coalesce(f.{c}, 0)), 0)')} AS {c}_sum, "
    f"{sql_r4(f'sum(coalesce(f.{c}, 0))::DOUBLE / nullif(count(f.ord), 0)')} AS {c}_mean" for c in net.FLAGS)}
FROM grid g LEFT JOIN fw f USING (run_id, w0) GROUP BY 1, 2""")
def _window_flag_stats(spark, d):
    f = timed_flows(spark, d).select("run_id", "family", "ord", "t_rel_s", "flow_duration", "traffic_type", *net.FLAGS)
    return rounded(net.network_windows(f, W, S).select(
        "run_id", "window_start_s", *[f"{c}_{k}" for c in net.FLAGS for k in ("sum", "mean")]))


@query("window_distinct_counts", "A4", f"""WITH {WIN_SQL}
SELECT g.run_id, g.w0 AS window_start_s,
       count(DISTINCT f.src_ip) AS n_unique_src_ip, count(DISTINCT f.dst_ip) AS n_unique_dst_ip,
       count(DISTINCT CASE WHEN f.src_port >= 0 THEN f.src_port END) AS n_unique_src_port,
       count(DISTINCT CASE WHEN f.dst_port >= 0 THEN f.dst_port END) AS n_unique_dst_port
FROM grid g LEFT JOIN fw f USING (run_id, w0) GROUP BY 1, 2""")
def _window_distinct_counts(spark, d):
    f = timed_flows(spark, d).select(
        "run_id", "family", "ord", "t_rel_s", "flow_duration", "traffic_type", *net.ADDRESSES, *net.PORTS)
    return net.network_windows(f, W, S).select(
        "run_id", "window_start_s", *[f"n_unique_{c}" for c in (*net.ADDRESSES, *net.PORTS)])


def _mode_sql(field: str, where: str = "TRUE") -> str:
    return f"""
f_{field} AS (
  SELECT run_id, {field} AS v, row_number() OVER (PARTITION BY run_id ORDER BY min((t, ord))) AS pos
  FROM rel WHERE {field} IS NOT NULL GROUP BY 1, 2),
c_{field} AS (
  SELECT run_id, w0, {field} AS v, count(*) AS n FROM fw WHERE {field} IS NOT NULL AND {where} GROUP BY 1, 2, 3),
m_{field} AS (
  SELECT c.run_id, c.w0, arg_max(c.v, (c.n, -p.pos)) AS m, count(*) AS u
  FROM c_{field} c JOIN f_{field} p USING (run_id, v) GROUP BY 1, 2)"""


@query("window_modes", "A5", f"""WITH {WIN_SQL}, {', '.join(_mode_sql(c) for c in net.CATEGORICAL)}
SELECT g.run_id, g.w0 AS window_start_s, {', '.join(
    f'm_{c}.m AS {c}_mode, coalesce(m_{c}.u, 0) AS {c}_n_unique' for c in net.CATEGORICAL)}
FROM grid g {' '.join(f'LEFT JOIN m_{c} USING (run_id, w0)' for c in net.CATEGORICAL)}""")
def _window_modes(spark, d):
    f = timed_flows(spark, d).select(
        "run_id", "family", "ord", "t_rel_s", "flow_duration", "traffic_type", *net.CATEGORICAL)
    return net.network_windows(f, W, S).select(
        "run_id", "window_start_s", *[f"{c}_{k}" for c in net.CATEGORICAL for k in ("mode", "n_unique")])


@query("window_attack_modes", "A6", f"""WITH {WIN_SQL}, {', '.join(_mode_sql(c, 'attack') for c in net.ATTACK_LABELS)}
SELECT g.run_id, g.w0 AS window_start_s, {', '.join(f'm_{c}.m AS {c}_win' for c in net.ATTACK_LABELS)}
FROM grid g {' '.join(f'LEFT JOIN m_{c} USING (run_id, w0)' for c in net.ATTACK_LABELS)}""")
def _window_attack_modes(spark, d):
    f = timed_flows(spark, d).select(
        "run_id", "family", "ord", "t_rel_s", "flow_duration", "traffic_type", *net.ATTACK_LABELS)
    return net.network_windows(f, W, S).select("run_id", "window_start_s", *[f"{c}_win" for c in net.ATTACK_LABELS])


@query("window_index", "K2", f"""WITH {WIN_SQL}, {', '.join(_mode_sql(c, 'attack') for c in net.ATTACK_LABELS)},
lab AS ({LABEL_SQL} FROM grid g LEFT JOIN fw f USING (run_id, w0) GROUP BY 1, 2, 3)
SELECT l.*, l.window_start_s + {W} AS window_end_s, a.m AS attack_category_win, t.m AS attack_type_win
FROM lab l LEFT JOIN m_attack_category a ON a.run_id = l.run_id AND a.w0 = l.window_start_s
LEFT JOIN m_attack_type t ON t.run_id = l.run_id AND t.w0 = l.window_start_s""")
def _window_index(spark, d):
    return rounded(index(spark, d))


def windows(spark, d, w: int = W, s: int = S):
    return net.network_windows(timed_flows(spark, d), w, s)


def index(spark, d, w: int = W, s: int = S):
    return net.index_windows(timed_flows(spark, d), w, s)


@query("network_windows_odd_step", "A1 A2 J5", f"""WITH {grid_sql(5, 2)}
SELECT g.run_id, g.w0 AS window_start_s, count(f.ord) AS n_flows, {_stat_sql('src_bytes')}
FROM grid g LEFT JOIN fw f USING (run_id, w0) GROUP BY 1, 2""")
def _network_windows_odd_step(spark, d):
    f = timed_flows(spark, d).select(
        "run_id", "family", "ord", "t_rel_s", "flow_duration", "traffic_type", "src_bytes")
    return rounded(net.network_windows(f, 5, 2).select(
        "run_id", "window_start_s", "n_flows", "src_bytes_sum", "src_bytes_mean", "src_bytes_std"))


def _summary_sql(w: int, s: int) -> str:
    return f"""SELECT s.run_id, s.family, n_flows_total, {sql_r4('run_end_s')} AS run_end_s,
       coalesce(c.n, 0) AS n_windows, {sql_r4('c.busy::DOUBLE / c.n')} AS window_occupancy,
       CASE WHEN c.n > 0 THEN {sql_r4('t_first')} END AS t_first_attack_flow_s
FROM spans2 s LEFT JOIN (
  SELECT run_id, count(*) AS n, count(CASE WHEN n_flows > 0 THEN 1 END) AS busy
  FROM (SELECT g.run_id, g.w0, count(f.ord) AS n_flows FROM grid g LEFT JOIN fw f USING (run_id, w0) GROUP BY 1, 2)
  GROUP BY 1) c USING (run_id)"""


@query("run_summary", "A9 W8", f"WITH {WIN_SQL} {_summary_sql(W, S)}")
def _run_summary(spark, d):
    return rounded(net.run_summary(timed_flows(spark, d), W, S))


@query("run_summary_all", "A10", f"""WITH a AS (WITH {WIN_SQL} {_summary_sql(W, S)}), b AS (WITH {grid_sql(5, 2)} {_summary_sql(5, 2)}),
u AS (SELECT 10 AS W, 2 AS S, * FROM a UNION ALL SELECT 5, 2, * FROM b)
SELECT * EXCLUDE (rn, W, S), CAST(W AS BIGINT) AS "W", CAST(S AS BIGINT) AS "S" FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY n_windows DESC, W, S) AS rn FROM u) WHERE rn = 1""")
def _run_summary_all(spark, d):
    f = timed_flows(spark, d)
    both = [net.run_summary(f, w, s).withColumns({"W": F.lit(w), "S": F.lit(s)}) for w, s in ((10, 2), (5, 2))]
    return rounded(net.run_summary_all(both[0].unionByName(both[1])))
