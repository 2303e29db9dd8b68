"""Alignment of the two series of every run."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosswin.operators import alignment as al
from crosswin.operators.scale import settle
from crosswin.plans import bindings as b
from crosswin.plans.registry import query, r4, rounded, sql_r4
from crosswin.sources import readers

WIN, STEP, FINE, MIN_OV, SMOOTH, EXCL, ITERS, QUANT, SEED = 24, 4, 6, 300, 3, 4, 40, 0.9, 1337


def dense_pair(spark, d):
    net, rad = b.series_pair(spark, d)
    return settle(al.dense_from_zero(net), "net"), settle(al.dense_from_zero(rad), "rad")


def recorded_pair(spark, d):
    """Only the recorded seconds; absent ones are 0."""
    net, rad = b.series_pair(spark, d)
    return settle(al.from_zero(net), "net"), settle(al.from_zero(rad), "rad")


@query("packets_to_bytes", "S7", f"""WITH {b.PACKETS_SQL}
SELECT run_id, CAST(floor(ts) AS BIGINT) AS t, sum(orig_len)::DOUBLE AS v FROM packets GROUP BY 1, 2""")
def _packets_to_bytes(spark, d):
    return al.packets_to_bytes(b.packets(spark, d))


@query("packet_facts", "S7", f"""WITH {b.PACKETS_SQL}
SELECT run_id, {sql_r4('min(ts)')} AS start_ts, {sql_r4('max(ts)')} AS end_ts, count(*) AS packet_count FROM packets GROUP BY 1""")
def _packet_facts(spark, d):
    return rounded(al.packet_facts(b.packets(spark, d)))


UE_SQL = b.TELEMETRY_SQL + """,
good AS (SELECT run_id, ord, ue_id AS ue, dlBytes + ulBytes AS tot_bytes, CASE WHEN ts > 100000000000 THEN ts // 1000 ELSE ts END AS t0 FROM tel WHERE dlBytes IS NOT NULL),
tm AS (SELECT run_id, count(t0) > 0 AS timed FROM good GROUP BY 1),
rowsel AS (
  SELECT g.run_id, ue, tot_bytes, CASE WHEN timed THEN t0 ELSE row_number() OVER (PARTITION BY g.run_id ORDER BY ord) - 1 END AS t
  FROM good g JOIN tm USING (run_id) WHERE NOT timed OR t0 IS NOT NULL),
ue AS (SELECT run_id, ue, CAST(t AS BIGINT) AS t, max(tot_bytes) AS tot_bytes FROM rowsel GROUP BY 1, 2, 3),
uep AS (SELECT *, lag(tot_bytes) OVER w AS prev FROM ue WINDOW w AS (PARTITION BY run_id, ue ORDER BY t)),
neg AS (
  SELECT run_id, avg(neg) AS neg_share FROM (
    SELECT run_id, ue, avg(CASE WHEN prev IS NOT NULL THEN (tot_bytes < prev)::INT END) AS neg,
           dense_rank() OVER (PARTITION BY run_id ORDER BY ue) AS rk, count(*) AS n FROM uep GROUP BY 1, 2)
  WHERE n >= 3 GROUP BY 1),
bm AS (SELECT run_id, CASE WHEN neg_share > 0.2 THEN 'instantaneous' ELSE 'cumulative' END AS bytes_mode, neg_share
       FROM (SELECT DISTINCT run_id FROM ue) LEFT JOIN neg USING (run_id))"""


def lenient(spark, d):
    t = b.telemetry(spark, d)
    return t.select(
        "run_id", "ord", F.col("dlBytes").isNull().cast("int").alias("parse_error"), F.col("ue_id").alias("ue"),
        (F.col("dlBytes") + F.col("ulBytes")).alias("tot_bytes"), F.col("timestamp").cast("string").alias("ts"))


@query("infer_bytes_mode", "A19", f"WITH {UE_SQL} SELECT run_id, bytes_mode, {sql_r4('neg_share')} AS neg_share FROM bm")
def _infer_bytes_mode(spark, d):
    return rounded(al.infer_bytes_mode(settle(al.ue_series(lenient(spark, d)), "ue")))


@query("telemetry_facts", "A20 S4", f"""WITH {UE_SQL}
SELECT t.run_id, count(CASE WHEN dlBytes IS NULL THEN 1 END) AS parse_errors,
       count(CASE WHEN dlBytes IS NOT NULL AND ts IS NULL THEN 1 END) AS missing_timestamp_rows,
       CASE WHEN count(CASE WHEN dlBytes IS NOT NULL THEN ts END) > 0 THEN 'timestamp' ELSE 'implicit' END AS time_mode,
       count(CASE WHEN dlBytes IS NOT NULL THEN 1 END) AS row_count, count(DISTINCT CASE WHEN dlBytes IS NOT NULL THEN ue_id END) AS ue_count
FROM tel t GROUP BY 1""")
def _telemetry_facts(spark, d):
    return al.telemetry_facts(lenient(spark, d))


RATE_SQL = UE_SQL + """,
st AS (SELECT run_id, min(t) AS t0, max(t) AS t1 FROM ue GROUP BY 1),
ra AS (
  SELECT u.run_id, u.t,
         sum(CASE WHEN bytes_mode = 'instantaneous' THEN tot_bytes
                  WHEN prev IS NULL THEN CASE WHEN t = t0 THEN 0 ELSE tot_bytes END ELSE greatest(tot_bytes - prev, 0) END) AS v,
         count(CASE WHEN bytes_mode = 'cumulative' AND tot_bytes < prev THEN 1 END) AS resets
  FROM uep u JOIN bm USING (run_id) JOIN st USING (run_id) GROUP BY 1, 2)"""


@query("radio_rate_series", "A20", f"""WITH {RATE_SQL}
SELECT g.run_id, g.t, {sql_r4('coalesce(v, 0)')} AS v, coalesce(resets, 0) AS resets
FROM (SELECT run_id, unnest(range(t0, t1 + 1)) AS t FROM st) g LEFT JOIN ra USING (run_id, t)""")
def _radio_rate_series(spark, d):
    ue = settle(al.ue_series(lenient(spark, d)), "ue")
    # every second run is treated as cumulative by the inferred mode
    return rounded(al.radio_rate_series(ue, al.infer_bytes_mode(ue)))


@query("radio_rate_series_cumulative", "A20 W3", f"""WITH {RATE_SQL},
rc AS (
  SELECT u.run_id, u.t, sum(CASE WHEN prev IS NULL THEN CASE WHEN t = t0 THEN 0 ELSE tot_bytes END ELSE greatest(tot_bytes - prev, 0) END) AS v,
         count(CASE WHEN tot_bytes < prev THEN 1 END) AS resets
  FROM uep u JOIN st USING (run_id) GROUP BY 1, 2)
SELECT g.run_id, g.t, {sql_r4('coalesce(v, 0)')} AS v, coalesce(resets, 0) AS resets
FROM (SELECT run_id, unnest(range(t0, t1 + 1)) AS t FROM st) g LEFT JOIN rc USING (run_id, t)""")
def _radio_rate_series_cumulative(spark, d):
    ue = settle(al.ue_series(lenient(spark, d)), "ue")
    modes = ue.select("run_id").distinct().withColumn("bytes_mode", F.lit("cumulative"))
    return rounded(al.radio_rate_series(ue, modes))


@query("densify_series", "J7", f"WITH {b.SERIES_SQL} SELECT run_id, t, v FROM rad_d")
def _densify_series(spark, d):
    return al.dense_from_zero(b.series_pair(spark, d)[1])


@query("lag_join", "J9 U5", f"""WITH {b.SERIES_SQL}
SELECT n.run_id, l.lag, n.t, n.v AS x, r.v AS y FROM net_d n
JOIN (SELECT DISTINCT run_id, CAST(run_id AS BIGINT) % 5 - 2 AS lag FROM net_d) l USING (run_id)
JOIN rad_d r ON r.run_id = n.run_id AND r.t + l.lag = n.t""")
def _lag_join(spark, d):
    net, rad = dense_pair(spark, d)
    lags = net.select("run_id").distinct().withColumn("lag", F.col("run_id").cast("bigint") % 5 - 2)
    return al.align_on_lag(net, rad, lags)


def lag_sql(lags: str, name: str, log: bool = False) -> str:
    """Correlation per (run, lag), averaged over the overlap only."""
    val = "ln(1 + greatest(v, 0))" if log else "v"
    return f"""
{name}_p AS (
  SELECT n.run_id, l.lag, n.t, n.v AS x, r.v AS y FROM (SELECT run_id, t, {val} AS v FROM net_d) n
  JOIN {lags} l ON l.run_id = n.run_id JOIN (SELECT run_id, t, {val} AS v FROM rad_d) r ON r.run_id = n.run_id AND r.t = n.t - l.lag),
{name}_s AS (
  SELECT run_id, lag, sum(x) OVER w / {SMOOTH} AS x, sum(y) OVER w / {SMOOTH} AS y FROM {name}_p
  WINDOW w AS (PARTITION BY run_id, lag ORDER BY t ROWS BETWEEN {SMOOTH // 2} PRECEDING AND {(SMOOTH - 1) // 2} FOLLOWING)),
{name} AS (
  SELECT run_id, lag, count(*) AS overlap,
         CASE WHEN count(*) >= 3 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN corr(x, y) END AS c
  FROM {name}_s JOIN lens USING (run_id) GROUP BY run_id, lag, mo HAVING count(*) >= mo)"""


LENS_SQL = b.SERIES_SQL + f""",
lens AS (
  SELECT run_id, nn, nr, CASE WHEN least(nn, nr, {MIN_OV}) < 3 THEN least(nn, nr) ELSE least(nn, nr, {MIN_OV}) END AS mo
  FROM (SELECT run_id, max(t) + 1 AS nn FROM net_d GROUP BY 1) JOIN (SELECT run_id, max(t) + 1 AS nr FROM rad_d GROUP BY 1) USING (run_id))"""

BEST_SQL = LENS_SQL + f""",
cl AS (SELECT run_id, unnest(range({-WIN}, {WIN + 1}, {STEP})) AS lag FROM lens), {lag_sql('cl', 'coarse')},
cb AS (SELECT run_id, coalesce(arg_max(lag, (round(c, 12), -lag)) FILTER (c IS NOT NULL), {-WIN}) AS lag FROM lens LEFT JOIN coarse USING (run_id) GROUP BY 1),
fl AS (SELECT run_id, f AS lag FROM (SELECT run_id, unnest(range(lag - {FINE}, lag + {FINE + 1})) AS f FROM cb)
       WHERE f < {-WIN} OR f > {WIN} OR (f + {WIN}) % {STEP} <> 0), {lag_sql('fl', 'fine')},
curves AS (SELECT *, 0 AS stage FROM coarse UNION ALL SELECT *, 1 FROM fine),
bst AS (
  SELECT run_id, nn, nr, mo, coalesce(arg_max(lag, (round(c, 12), -stage, -lag)) FILTER (c IS NOT NULL), {-WIN}) AS best_lag, max(c) AS best_corr,
         coalesce(arg_max(overlap, (round(c, 12), -stage, -lag)) FILTER (c IS NOT NULL), 0) AS overlap_seconds
  FROM lens LEFT JOIN curves USING (run_id) GROUP BY 1, 2, 3, 4),
prom AS (
  SELECT b.run_id, max(CASE WHEN abs(lag - best_lag) > {EXCL} THEN c END) AS nxt FROM bst b LEFT JOIN curves USING (run_id) GROUP BY 1)"""


@query("lag_correlation", "A21", f"""WITH {LENS_SQL},
cl AS (SELECT run_id, unnest(range({-WIN}, {WIN + 1}, {STEP})) AS lag FROM lens), {lag_sql('cl', 'coarse', True)}
SELECT run_id, lag, overlap, {sql_r4('c')} AS corr FROM coarse""")
def _lag_correlation(spark, d):
    net, rad = recorded_pair(spark, d)
    plan = settle(al.series_plan(net, rad, MIN_OV, True).withColumns({
        "lags": F.sequence(F.lit(-WIN).cast("bigint"), F.lit(WIN).cast("bigint"), F.lit(STEP).cast("bigint")),
        "lag_lo": F.lit(-WIN).cast("bigint"), "lag_hi": F.lit(WIN).cast("bigint")}), "plan")
    return rounded(al.lag_correlation(net, rad, plan, SMOOTH, True, block=256).select("run_id", "lag", "overlap", "corr"))


@query("lag_curves", "K11 T1", f"WITH {BEST_SQL} SELECT run_id, lag, CAST(stage AS BIGINT) AS stage, overlap, {sql_r4('c')} AS corr FROM curves")
def _lag_curves(spark, d):
    net, rad = recorded_pair(spark, d)
    curves, _ = al.search_best_lag(net, rad, WIN, STEP, FINE, MIN_OV, SMOOTH, block=256)
    return rounded(curves.select("run_id", "lag", "stage", "overlap", "corr"))


@query("best_lag", "T1 T2", f"""WITH {BEST_SQL}
SELECT run_id, nn AS n_net, nr AS n_rad, mo AS min_overlap_search, best_lag, {sql_r4('best_corr')} AS best_corr, overlap_seconds, {sql_r4('best_corr - nxt')} AS peak_prominence
FROM bst JOIN prom USING (run_id)""")
def _best_lag(spark, d):
    net, rad = recorded_pair(spark, d)
    curves, plan = al.search_best_lag(net, rad, WIN, STEP, FINE, MIN_OV, SMOOTH)
    return rounded(al.best_lag(curves, plan, WIN, EXCL))


ACC_SQL = BEST_SQL + f""",
ap AS (
  SELECT n.run_id, n.t, n.v AS x, r.v AS y FROM net_d n JOIN bst b USING (run_id) JOIN rad_d r ON r.run_id = n.run_id AND r.t = n.t - b.best_lag),
al AS (
  SELECT run_id, t - min(t) OVER (PARTITION BY run_id) AS i, count(*) OVER (PARTITION BY run_id) AS n,
         sum(x) OVER w / {SMOOTH} AS x, sum(y) OVER w / {SMOOTH} AS y FROM ap
  WINDOW w AS (PARTITION BY run_id ORDER BY t ROWS BETWEEN {SMOOTH // 2} PRECEDING AND {(SMOOTH - 1) // 2} FOLLOWING)),
ob AS (SELECT run_id, n, CASE WHEN n >= 3 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN corr(x, y) END AS oc FROM al GROUP BY 1, 2),
hv AS (SELECT run_id, min(c) AS half FROM (
  SELECT run_id, i < n // 2 AS f, CASE WHEN count(*) >= 3 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN corr(x, y) END AS c FROM al GROUP BY 1, 2) GROUP BY 1),
rs AS (
  SELECT b.*, coalesce(o.n, 0) AS n, o.oc, h.half,
         greatest(least(CASE WHEN overlap_seconds > 0 THEN overlap_seconds // 10 ELSE 30 END, 60), 10) AS ms
  FROM bst b LEFT JOIN ob o USING (run_id) LEFT JOIN hv h USING (run_id)),
sh AS (
  SELECT run_id, n, j, ms + CAST('0x' || substr(md5(run_id || '|{SEED}|' || j), 1, 8) AS BIGINT) % (n - 2 * ms) AS s
  FROM rs, (SELECT unnest(range(0, {ITERS})) AS j) WHERE n >= {MIN_OV} AND n >= 3 AND oc IS NOT NULL AND n >= 2 * ms + 10),
ax AS MATERIALIZED (SELECT a.run_id, s.j, a.x, (a.i - s.s + s.n) % s.n AS i2 FROM sh s JOIN al a ON a.run_id = s.run_id),
nc AS (
  SELECT a.run_id, a.j, CASE WHEN stddev_pop(a.x) > 0 AND stddev_pop(c.y) > 0 THEN corr(a.x, c.y) END AS c
  FROM ax a JOIN al c ON c.run_id = a.run_id AND c.i = a.i2 GROUP BY 1, 2),
nt AS (SELECT run_id, count(c) AS n_null, quantile_cont(c, {QUANT}) AS thr FROM nc GROUP BY 1),
acc AS (
  SELECT r.*, p.nxt, CASE WHEN n_null >= {max(20, ITERS // 4)} THEN thr END AS thr,
         CASE WHEN n < 3 THEN 'no_overlap_for_best_lag' WHEN n < {MIN_OV} THEN 'below_min_overlap_req' WHEN oc IS NULL THEN 'undefined_corr'
              WHEN n < 2 * ms + 10 THEN 'too_short' WHEN coalesce(n_null, 0) < {max(20, ITERS // 4)} THEN 'null_insufficient'
              WHEN oc < thr THEN 'below_null_threshold' WHEN half IS NULL OR half < 0 THEN 'unstable_halves' ELSE 'accepted' END AS reason
  FROM rs r LEFT JOIN nt USING (run_id) JOIN prom p USING (run_id)),
notes AS (
  SELECT *, CASE WHEN n >= 3 THEN oc ELSE best_corr END AS bc, best_corr - nxt AS pp,
    concat_ws(';', CASE WHEN mo <> {MIN_OV} THEN 'min_overlap_capped=' || mo END,
      CASE WHEN (CASE WHEN n >= 3 THEN oc ELSE best_corr END) IS NULL THEN 'no_defined_corr' END,
      CASE WHEN overlap_seconds < {MIN_OV} THEN 'low_overlap' END,
      CASE WHEN best_corr - nxt < 0.02 THEN 'flat_peak' END, 'accept_reason=' || reason) AS notes,
    {b.FAMILY_SQL}[CAST(CAST(run_id AS BIGINT) % 6 AS INT) + 1] AS family,
    CASE WHEN CAST(run_id AS BIGINT) % 3 = 0 THEN 'implicit' ELSE 'timestamp' END AS time_mode
  FROM acc),
tiers AS (
  SELECT *, notes LIKE '%flat_peak%' AS flat_peak, bc - thr AS corr_margin, reason = 'accepted' AS accepted,
    CASE WHEN reason = 'accepted' AND bc >= 0.8 AND coalesce(pp, 0) >= 0.1 THEN 'strong' WHEN reason = 'accepted' AND bc >= 0.8 THEN 'high_corr_ambiguous'
         WHEN reason = 'accepted' THEN 'accepted_weak' ELSE 'rejected' END AS tier FROM notes)"""


def _once(sql: str) -> str:
    """Compute shared steps of the oracle once."""
    for name in ("raw", "raw0", "net_d", "rad_d", "lens", "coarse", "cb", "fine", "curves", "bst", "al", "ap", "rs", "sh", "nt", "tiers"):
        sql = sql.replace(f"\n{name} AS (", f"\n{name} AS MATERIALIZED (")
    return sql


BEST_SQL, ACC_SQL = _once(BEST_SQL), _once(ACC_SQL)


def results(spark, d, block: int = al.NULL_BLOCK):
    net, rad = recorded_pair(spark, d)
    r = al.align_runs(net, rad, WIN, STEP, FINE, MIN_OV, SMOOTH, False, EXCL, ITERS, QUANT, 0.0, SEED, null_block=block)
    uid = F.col("run_id").cast("bigint")
    return r.withColumns({
        "family": b.family_of(uid), "time_mode": F.when(uid % 3 == 0, "implicit").otherwise("timestamp")})


@query("align_runs", "W5 W6 P19", f"""WITH {ACC_SQL}
SELECT run_id, nn AS n_net, nr AS n_rad, mo AS min_overlap_search, best_lag, {sql_r4('bc')} AS best_corr, overlap_seconds,
       {sql_r4('pp')} AS peak_prominence, {sql_r4('thr')} AS null_threshold,
       CASE WHEN reason IN ('below_min_overlap_req', 'below_null_threshold', 'unstable_halves', 'accepted') THEN {sql_r4('half')} END AS half_corr_min,
       accepted, reason, notes, family, time_mode FROM tiers""")
def _align_runs(spark, d):
    return rounded(results(spark, d))


@query("circular_shift_null_long", "W5", f"""WITH {ACC_SQL}
SELECT run_id, {sql_r4('thr')} AS null_threshold, reason FROM tiers""")
def _circular_shift_null_long(spark, d):
    return rounded(results(spark, d, block=64).select("run_id", "null_threshold", "reason"))


@query("abs_offsets", "P18", f"""WITH {BEST_SQL}
SELECT run_id, best_lag, CASE WHEN CAST(run_id AS BIGINT) % 3 <> 0 THEN 1000.5::DOUBLE - CAST(run_id AS BIGINT) END AS abs_start_diff_seconds,
       CASE WHEN CAST(run_id AS BIGINT) % 3 <> 0 THEN 1000.5::DOUBLE - CAST(run_id AS BIGINT) + best_lag END AS abs_offset_seconds FROM bst""")
def _abs_offsets(spark, d):
    net, rad = recorded_pair(spark, d)
    curves, plan = al.search_best_lag(net, rad, WIN, STEP, FINE, MIN_OV, SMOOTH)
    uid = F.col("run_id").cast("bigint")
    best = al.best_lag(curves, plan, WIN, EXCL).withColumns({
        "net_t0_epoch": F.lit(1000.5), "rad_t0_epoch": uid.cast("double"),
        "rad_time_mode": F.when(uid % 3 == 0, "implicit").otherwise("timestamp")})
    return al.abs_offsets(best).select("run_id", "best_lag", r4("abs_start_diff_seconds"), r4("abs_offset_seconds"))


@query("alignment_tier", "P10 P11", f"WITH {ACC_SQL} SELECT run_id, tier, flat_peak, {sql_r4('corr_margin')} AS corr_margin FROM tiers")
def _alignment_tier(spark, d):
    return rounded(al.assign_tiers(results(spark, d)).select("run_id", "tier", "flat_peak", "corr_margin"))


@query("tier_crosstab", "A17", f"""WITH {ACC_SQL}
SELECT family, {', '.join(f"count(CASE WHEN tier = '{t}' THEN 1 END) AS {t}" for t in al.TIERS)}, count(*) AS total FROM tiers GROUP BY 1""")
def _tier_crosstab(spark, d):
    return al.tier_crosstab(al.assign_tiers(results(spark, d)))


@query("alignment_summary", "A18", f"""WITH {ACC_SQL}
SELECT family, count(*) AS n, count(CASE WHEN accepted THEN 1 END) AS accepted, count(CASE WHEN time_mode = 'timestamp' THEN 1 END) AS n_timestamp,
       count(CASE WHEN time_mode = 'implicit' THEN 1 END) AS n_implicit, {sql_r4('quantile_cont(bc, 0.5)')} AS best_corr_median,
       {sql_r4('count(CASE WHEN accepted THEN 1 END)::DOUBLE / count(*)')} AS acceptance_rate
FROM tiers GROUP BY GROUPING SETS ((family), ())""")
def _alignment_summary(spark, d):
    return rounded(al.alignment_summary(results(spark, d)))


@query("select_runs", "T4", f"""WITH {ACC_SQL}
(SELECT 'top' AS list, run_id FROM tiers WHERE accepted ORDER BY round(bc, 9) DESC, run_id LIMIT 12)
UNION ALL SELECT 'strong', run_id FROM tiers WHERE tier = 'strong'
UNION ALL SELECT 'weak', run_id FROM tiers WHERE tier IN ('high_corr_ambiguous', 'accepted_weak')
UNION ALL SELECT 'rejected', run_id FROM tiers WHERE NOT accepted""")
def _select_runs(spark, d):
    t = settle(al.assign_tiers(results(spark, d)).withColumn("best_corr", F.round("best_corr", 9)), "tiers")
    lists = {
        "top": al.select_runs(t, True, 12), "strong": al.runs_of_tier(t, ("strong",)),
        "weak": al.runs_of_tier(t, ("high_corr_ambiguous", "accepted_weak")), "rejected": al.select_runs(t, False)}
    return readers.union_all([df.select(F.lit(n).alias("list"), "run_id") for n, df in lists.items()])
