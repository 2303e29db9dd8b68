"""Telemetry: time modes, seconds, rates, radio windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosswin.operators import radio, series
from crosswin.plans import bindings as b
from crosswin.plans import q_network as qn
from crosswin.plans.registry import query, r4, rounded, sql_r4
from crosswin.sources import readers

W, S = qn.W, qn.S
KPIS = ["sinr", "rsrp", "ri", "cqi"]


def records(spark, d):
    t = b.telemetry(spark, d)
    return readers.pick_timestamp(t, ("timestamp",))


SEC_SQL = b.TELEMETRY_SQL + """,
mode AS (SELECT run_id, min(family) AS family, CASE WHEN count(ts) > 0 THEN 'timestamp' ELSE 'implicit' END AS time_mode,
                min(ts) AS ts0, count(*) AS n_raw_rows FROM tel GROUP BY run_id),
timed AS (
  SELECT t.*, m.time_mode,
         CASE WHEN m.time_mode = 'implicit' THEN row_number() OVER (PARTITION BY run_id ORDER BY ord) - 1
              WHEN ts0 > 100000000000 THEN greatest((ts - ts0) // 1000, 0) ELSE greatest(ts - ts0, 0) END AS sec
  FROM tel t JOIN mode m USING (run_id) WHERE m.time_mode = 'implicit' OR t.ts IS NOT NULL),
secs AS (
  SELECT run_id, sec, coalesce(sum(dlBytes), 0) AS dlBytes, coalesce(sum(ulBytes), 0) AS ulBytes,
         quantile_cont(sinr, 0.5) AS sinr, quantile_cont(rsrp, 0.5) AS rsrp, quantile_cont(ri, 0.5) AS ri,
         quantile_cont(cqi::DOUBLE, 0.5) AS cqi, count(*) AS row_count, count(DISTINCT ue_id) AS ue_count
  FROM timed GROUP BY 1, 2),
dense AS (
  SELECT g.run_id, g.sec, s.* EXCLUDE (run_id, sec)
  FROM (SELECT run_id, unnest(range(0, max(sec) + 1)) AS sec FROM secs GROUP BY run_id) g LEFT JOIN secs s USING (run_id, sec)),
filled AS (
  SELECT *,
    coalesce(last_value(dlBytes IGNORE NULLS) OVER p, first_value(dlBytes IGNORE NULLS) OVER n, 0)
    + coalesce(last_value(ulBytes IGNORE NULLS) OVER p, first_value(ulBytes IGNORE NULLS) OVER n, 0) AS tot
  FROM dense
  WINDOW p AS (PARTITION BY run_id ORDER BY sec ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         n AS (PARTITION BY run_id ORDER BY sec ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
rated AS (
  SELECT *, tot - lag(tot, 1, tot) OVER (PARTITION BY run_id ORDER BY sec) AS delta FROM filled),
rsec AS (
  SELECT r.run_id, m.family, m.time_mode, sec AS t_rel_s, dlBytes, ulBytes, sinr, rsrp, ri, cqi,
         coalesce(row_count, 0) AS row_count, coalesce(ue_count, 0) AS ue_count,
         row_count IS NOT NULL AS sec_has_record, CAST(row_count IS NULL AS BIGINT) AS sec_missing,
         tot AS totalBytes_counter_filled, greatest(delta, 0) AS rate_total,
         CAST(delta < 0 AS BIGINT) AS reset_indicator, delta AS reset_delta_raw
  FROM rated r JOIN mode m USING (run_id))"""


@query("detect_time_mode", "S5", f"""WITH {SEC_SQL}
SELECT run_id, family, time_mode, ts0, n_raw_rows FROM mode""")
def _detect_time_mode(spark, d):
    return radio.detect_time_mode(records(spark, d))


@query("telemetry_seconds_index", "S6 W1", f"""WITH {SEC_SQL}
SELECT run_id, ord, time_mode, CAST(sec AS BIGINT) AS t_rel_s FROM timed""")
def _telemetry_seconds_index(spark, d):
    return radio.to_seconds_index(records(spark, d)).select("run_id", "ord", "time_mode", "t_rel_s")


@query("second_aggregate", "A11", f"""WITH {SEC_SQL}
SELECT run_id, CAST(sec AS BIGINT) AS t_rel_s, {', '.join(f'{sql_r4(c)} AS {c}' for c in ('dlBytes', 'ulBytes', *KPIS))}, row_count, ue_count
FROM secs""")
def _second_aggregate(spark, d):
    return rounded(radio.aggregate_seconds(radio.to_seconds_index(records(spark, d)), KPIS))


DENSE_COLS = ["dlBytes", "ulBytes", *KPIS, "totalBytes_counter_filled", "rate_total", "reset_delta_raw"]


@query("radio_seconds", "J7 W2 W3", f"""WITH {SEC_SQL}
SELECT run_id, family, time_mode, CAST(t_rel_s AS BIGINT) AS t_rel_s, row_count, ue_count, sec_has_record, sec_missing, reset_indicator,
       {', '.join(f'{sql_r4(c)} AS {c}' for c in DENSE_COLS)}
FROM rsec""")
def _radio_seconds(spark, d):
    return rounded(radio.radio_seconds(records(spark, d), KPIS))


RWIN_SQL = f"""idx AS (WITH {qn.WIN_SQL} SELECT run_id, family, w0 AS window_start_s, w0 + {W} AS window_end_s FROM grid),
jw AS (
  SELECT i.*, s.* EXCLUDE (run_id, family) FROM idx i LEFT JOIN rsec s
  ON s.run_id = i.run_id AND s.t_rel_s >= i.window_start_s AND s.t_rel_s < i.window_end_s),
rw AS (
  SELECT run_id, window_start_s,
         count(CASE WHEN sec_has_record THEN 1 END) AS radio_present_seconds,
         {W} - count(CASE WHEN sec_has_record THEN 1 END) AS radio_missing_seconds,
         ({W} - count(CASE WHEN sec_has_record THEN 1 END))::DOUBLE / {W} AS radio_missing_frac,
         CAST(count(CASE WHEN sec_has_record THEN 1 END) = 0 AS BIGINT) AS radio_window_missing,
         coalesce(sum(rate_total), 0) AS rate_total_sum, CAST(coalesce(sum(reset_indicator), 0) AS BIGINT) AS reset_count,
         CAST(coalesce(sum(row_count), 0) AS BIGINT) AS row_count_sum, CAST(coalesce(sum(ue_count), 0) AS BIGINT) AS ue_count_sum,
         {', '.join(f'avg({c}) AS {c}_mean, stddev_pop({c}) AS {c}_std' for c in (*KPIS, *radio.SECOND_KPIS))}
  FROM jw GROUP BY 1, 2)"""

RW_COLS = ["radio_missing_frac", "rate_total_sum",
           *[f"{c}_{k}" for c in (*KPIS, *radio.SECOND_KPIS) for k in ("mean", "std")]]


def radio_windows(spark, d, with_gap: bool = False):
    sec, lengths = radio.reported_seconds(records(spark, d), KPIS)
    if with_gap:
        sec, lengths = (t.where("run_id not in ('3', '77')") for t in (sec, lengths))
    return radio.radio_windows(sec, qn.index(spark, d), W, S, KPIS, lengths)


@query("radio_windows", "A12 J8", f"""WITH {SEC_SQL}, {RWIN_SQL}
SELECT run_id, window_start_s, radio_present_seconds, radio_missing_seconds, radio_window_missing, reset_count, row_count_sum, ue_count_sum,
       {', '.join(f'{sql_r4(c)} AS {c}' for c in RW_COLS)}
FROM rw""")
def _radio_windows(spark, d):
    return rounded(radio_windows(spark, d).select(
        "run_id", "window_start_s", "radio_present_seconds", "radio_missing_seconds", "radio_window_missing",
        "reset_count", "row_count_sum", "ue_count_sum", *RW_COLS))


@query("carry_labels", "J17", f"""WITH {SEC_SQL}, {RWIN_SQL},
lab AS (WITH {qn.WIN_SQL}, {qn._mode_sql('attack_category', 'attack')}, l AS ({qn.LABEL_SQL} FROM grid g LEFT JOIN fw f USING (run_id, w0) GROUP BY 1, 2, 3)
  SELECT l.*, m.m AS attack_category_win FROM l LEFT JOIN m_attack_category m ON m.run_id = l.run_id AND m.w0 = l.window_start_s)
SELECT l.run_id, l.window_start_s, l.traffic_type_win, l.attack_category_win, l.n_flows, l.attack_flow_frac,
       CASE WHEN run_id IN ('3', '77') THEN 1 ELSE radio_window_missing END AS radio_window_missing,
       CASE WHEN run_id NOT IN ('3', '77') THEN radio_present_seconds END AS radio_present_seconds,
       CASE WHEN run_id NOT IN ('3', '77') THEN {sql_r4('rate_total_sum')} END AS rate_total_sum
FROM lab l JOIN rw USING (run_id, window_start_s)""")
def _carry_labels(spark, d):
    return rounded(radio_windows(spark, d, with_gap=True).select(
        "run_id", "window_start_s", "traffic_type_win", "attack_category_win", "n_flows", "attack_flow_frac",
        "radio_window_missing", "radio_present_seconds", "rate_total_sum"))


@query("radio_run_summary", "A13", f"""WITH {SEC_SQL}
SELECT run_id, family, time_mode, n_seconds, {sql_r4('miss')} AS sec_missing_frac, multi AS multi_rows_same_second, resets AS resets_count, n_raw_rows
FROM (SELECT run_id, min(family) AS family, min(time_mode) AS time_mode, count(*) AS n_seconds, avg(sec_missing) AS miss,
             bool_or(row_count > 1) AS multi, CAST(sum(reset_indicator) AS BIGINT) AS resets FROM rsec GROUP BY 1)
JOIN (SELECT run_id, n_raw_rows FROM mode) USING (run_id)""")
def _radio_run_summary(spark, d):
    r = records(spark, d)
    return rounded(radio.radio_run_summary(radio.radio_seconds(r, KPIS), r))


@query("radio_window_summary", "A14", f"""WITH {SEC_SQL}, {RWIN_SQL}
SELECT CAST({W} AS BIGINT) AS "W", CAST({S} AS BIGINT) AS "S", count(*) AS n_windows, {sql_r4('avg(radio_window_missing)')} AS radio_window_missing_rate,
       {sql_r4('quantile_cont(radio_missing_frac, 0.5)')} AS radio_missing_frac_median FROM rw""")
def _radio_window_summary(spark, d):
    return rounded(radio.radio_window_summary(radio_windows(spark, d), W, S))


@query("moving_average", "W4", f"""WITH {b.SERIES_SQL}
SELECT run_id, t, {sql_r4('sum(v) OVER (PARTITION BY run_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4')} AS v FROM net_d""")
def _moving_average(spark, d):
    net, _ = b.series_pair(spark, d)
    dense = series.densify(net, ["run_id"], "t", {"v": 0.0})
    return series.moving_average(dense, ["run_id"], "t", ["v"], 4, size=128).select("run_id", "t", r4("v"))


@query("telemetry_lines_strict", "S3", """
WITH e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS run_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
SELECT run_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 50 = 25 THEN 1 WHEN event_id % 4 IN (0, 1, 3) THEN NULL ELSE 1 END) AS BIGINT) AS n_records,
       CAST(coalesce(sum(CASE WHEN event_id % 50 IN (0, 25) OR event_id % 4 <> 2 THEN 0 ELSE k END), 0) AS BIGINT) AS dl
FROM e GROUP BY 1""")
def _telemetry_lines_strict(spark, d):
    # single quotes become double ones, so that one line in four is plain JSON
    lines = b.telemetry_lines(spark, d).withColumn(
        "value", F.when(F.col("ord") % 4 == 2, F.translate("value", "'", '"')).otherwise(F.col("value")))
    recs = readers.parse_lines(lines, readers.telemetry_schema(("other",)))
    n = lines.groupBy("run_id").agg(F.count("*").alias("n_lines"))
    got = recs.groupBy("run_id").agg(
        F.count("*").alias("n_records"),
        F.coalesce(F.sum(F.col("dlBytes").try_cast("bigint")), F.lit(0)).alias("dl"))
    zero = F.lit(0).cast("bigint")
    return n.join(got, "run_id", "left").select(
        "run_id", "n_lines", F.coalesce("n_records", zero).alias("n_records"), F.coalesce("dl", zero).alias("dl"))


@query("telemetry_lines_lenient", "S4", f"""
WITH e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS run_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
SELECT run_id, event_id AS ord, CAST(event_id % 50 IN (0, 25) AS BIGINT) AS parse_error,
       CASE WHEN event_id % 50 = 0 THEN 'unknown' WHEN event_id % 50 = 25 THEN 'unknown' ELSE event_type END AS ue,
       CASE WHEN event_id % 50 NOT IN (0, 25) THEN {sql_r4('k * 3.0')} END AS tot_bytes,
       CASE WHEN event_id % 50 NOT IN (0, 25) AND event_id % 6 <> 0 THEN CAST(event_id + 1700000000 AS VARCHAR) END AS ts
FROM e""")
def _telemetry_lines_lenient(spark, d):
    return rounded(readers.lenient_records(b.telemetry_lines(spark, d)))


@query("kpi_columns_per_run", "A11", f"""WITH {b.TELEMETRY_SQL},
x AS (SELECT run_id, cqi::VARCHAR AS cqi, CASE WHEN CAST(run_id AS BIGINT) % 3 = 0 OR ord % 10 = 0 THEN CAST(ord AS VARCHAR) ELSE 'n/a' END AS phr, sinr FROM tel),
s AS (SELECT run_id, count(TRY_CAST(cqi AS DOUBLE))::DOUBLE / count(*) AS c, count(TRY_CAST(phr AS DOUBLE))::DOUBLE / count(*) AS p, count(sinr)::DOUBLE / count(*) AS n FROM x GROUP BY 1)
SELECT run_id, 'cqi' AS kpi, {sql_r4('c')} AS share, c >= 0.2 AS kept FROM s
UNION ALL SELECT run_id, 'phr', {sql_r4('p')}, p >= 0.2 FROM s
UNION ALL SELECT run_id, 'sinr', {sql_r4('n')}, TRUE FROM s""")
def _kpi_columns_per_run(spark, d):
    # a text KPI that some runs carry in every record and others in one of ten
    phr = F.when((F.col("run_id").cast("bigint") % 3 == 0) | (F.col("ord") % 10 == 0), F.col("ord").cast("string")).otherwise("n/a")
    rows = b.telemetry(spark, d).select("run_id", F.col("cqi").cast("string").alias("cqi"), phr.alias("phr"), "sinr")
    return rounded(radio.kpi_columns_per_run(rows))
