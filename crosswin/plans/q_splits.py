"""Run splits and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosswin.operators import splits as sp
from crosswin.plans import bindings as b
from crosswin.plans import q_network as qn
from crosswin.plans.registry import query, rounded, sql_r4

SEEDS = [42, 43]
SEED_SQL = "(SELECT unnest([42, 43]) AS seed)"
ROWS_SQL = b.RUNS_SQL + """,
rr AS (SELECT run_id, family, count(*) AS rows FROM runs JOIN (SELECT CAST(user_id AS VARCHAR) AS run_id FROM events) USING (run_id) GROUP BY 1, 2)"""


def run_rows(spark, d):
    uid = F.col("user_id")
    return b.table(spark, d, "events").groupBy(uid.cast("string").alias("run_id"), b.family_of(uid).alias("family")).agg(
        F.count("*").alias("rows"))


def bround_sql(x: str) -> str:
    return f"CAST(round_even({x}, 0) AS BIGINT)"


def alloc_sql(n: str, vf: float = 0.15, tf: float = 0.15) -> str:
    """Train and val counts where val and test fit beside one train run."""
    return (f"CASE WHEN {n} < 4 THEN greatest(1, {n} - 2) ELSE {n} - greatest(1, {bround_sql(f'{n} * {vf}::DOUBLE')}) - greatest(1, {bround_sql(f'{n} * {tf}::DOUBLE')}) END",
            f"CASE WHEN {n} < 4 THEN CAST({n} >= 2 AS BIGINT) ELSE greatest(1, {bround_sql(f'{n} * {vf}::DOUBLE')}) END")


_TR, _VA = alloc_sql("n")


@query("family_allocation", "M1", """
WITH RECURSIVE g AS (SELECT DISTINCT CAST(p_size AS BIGINT) AS n FROM part),
st AS (
  SELECT n, greatest(1, CAST(round_even(n * 0.45::DOUBLE, 0) AS BIGINT)) AS t, greatest(1, CAST(round_even(n * 0.6::DOUBLE, 0) AS BIGINT)) AS v FROM g WHERE n >= 4
  UNION ALL
  SELECT n, CASE WHEN t >= v AND t > 1 THEN t - 1 ELSE t END, CASE WHEN t >= v AND t > 1 THEN v ELSE v - 1 END FROM st WHERE t + v > n - 1)
SELECT n, n - t - v AS train, v AS val, t AS test FROM st WHERE t + v <= n - 1
UNION ALL SELECT n, greatest(1, n - 2), CAST(n >= 2 AS BIGINT), CAST(n >= 3 AS BIGINT) FROM g WHERE n < 4""")
def _family_allocation(spark, d):
    sizes = b.table(spark, d, "part").select(F.col("p_size").cast("bigint").alias("n")).distinct()
    train, val, test = sp.family_allocation(F.col("n"), 0.6, 0.45)
    return sizes.select("n", train.alias("train"), val.alias("val"), test.alias("test"))


@query("split_by_counts", "M1 M2", f"""WITH {ROWS_SQL},
k AS (SELECT *, row_number() OVER (PARTITION BY seed, family ORDER BY md5(run_id || '|' || seed), run_id) - 1 AS pos, count(*) OVER (PARTITION BY seed, family) AS n FROM rr, {SEED_SQL})
SELECT 'stratified_seed' || seed AS split_name, CAST(seed AS BIGINT) AS seed, run_id, family,
       CASE WHEN pos < {_TR} THEN 'train' WHEN pos < {_TR} + {_VA} THEN 'val' ELSE 'test' END AS part FROM k""")
def _split_by_counts(spark, d):
    return rounded(sp.split_by_counts(b.runs(spark, d), SEEDS))


STRAT_SQL = ROWS_SQL + f""",
k AS (SELECT *, row_number() OVER (PARTITION BY seed, family ORDER BY md5(run_id || '|' || seed), run_id) - 1 AS pos,
             sum(rows) OVER (PARTITION BY seed, family) * 0.15::DOUBLE AS bud FROM rr, {SEED_SQL}),
walk AS (
  SELECT seed, family, run_id, pos, bud, 'train' AS part, 0::BIGINT AS v, 0::BIGINT AS t FROM k WHERE pos = 0
  UNION ALL
  SELECT seed, family, run_id, pos, bud, part, v + CASE WHEN part = 'val' THEN rows ELSE 0 END, t + CASE WHEN part = 'test' THEN rows ELSE 0 END
  FROM (SELECT k.seed, k.family, k.run_id, k.pos, k.bud, k.rows, w.v, w.t,
               CASE WHEN k.pos = 1 THEN 'val' WHEN k.pos = 2 THEN 'test' WHEN k.bud - w.v <= 0 AND k.bud - w.t <= 0 THEN 'train'
                    WHEN k.bud - w.v >= k.bud - w.t THEN 'val' ELSE 'test' END AS part
        FROM walk w JOIN k ON k.seed = w.seed AND k.family = w.family AND k.pos = w.pos + 1)),
strat AS (SELECT 'stratified_seed' || seed AS split_name, CAST(seed AS BIGINT) AS seed, run_id, family, part FROM walk)"""


def stratified(spark, d):
    return sp.split_stratified(run_rows(spark, d), SEEDS)


@query("split_stratified", "M2", f"WITH RECURSIVE {STRAT_SQL} SELECT * FROM strat")
def _split_stratified(spark, d):
    return rounded(stratified(spark, d))


@query("run_starts", "J14", f"""WITH {b.RUNS_SQL}, {b.FLOWS_SQL}
SELECT r.run_id, r.family, {sql_r4('min(f.flow_start_ts)')} AS run_start_ts
FROM (SELECT run_id, family FROM runs UNION ALL SELECT 'idle-' || run_id, family FROM runs WHERE family = 'Benign') r LEFT JOIN flows f USING (run_id) GROUP BY 1, 2""")
def _run_starts(spark, d):
    # for each benign run there is one more that has no flows, and so no start
    runs = b.runs(spark, d).select("run_id", "family")
    idle = runs.where("family = 'Benign'").withColumn("run_id", F.concat(F.lit("idle-"), "run_id"))
    return rounded(sp.run_starts(runs.unionByName(idle), b.flows(spark, d)))


@query("split_time_ordered", "M3", f"""WITH {b.RUNS_SQL},
s AS (SELECT r.*, row_number() OVER (ORDER BY ts0, md5(r.run_id || '|7'), r.run_id) - 1 AS i, count(*) OVER () AS n
      FROM runs r JOIN (SELECT CAST(user_id AS VARCHAR) AS run_id, min(epoch_us(ts)) / 3.6e9 AS ts0 FROM events GROUP BY 1) USING (run_id)),
pre AS (SELECT i, n, sum(CASE WHEN family = 'Benign' THEN 1 ELSE 0 END) OVER (ORDER BY i) - CASE WHEN family = 'Benign' THEN 1 ELSE 0 END AS pb,
               sum(CASE WHEN family = 'Benign' THEN 1 ELSE 0 END) OVER () AS tb FROM s),
c AS (
  SELECT a.i, b.i AS j, abs(a.i - greatest(1, a.n - tv - tt)) + abs(b.i - a.i - tv) + abs(a.n - b.i - tt) AS e
  FROM pre a JOIN pre b ON b.i > a.i, (SELECT greatest(1, {bround_sql('n * 0.15::DOUBLE')}) AS tv, greatest(1, {bround_sql('n * 0.15::DOUBLE')}) AS tt FROM s LIMIT 1)
  WHERE a.i >= 1 AND a.pb > 0 AND a.i - a.pb > 0 AND b.pb - a.pb > 0 AND (b.i - a.i) - (b.pb - a.pb) > 0 AND a.tb - b.pb > 0 AND (a.n - b.i) - (a.tb - b.pb) > 0),
best AS (SELECT i AS bi, j AS bj FROM c ORDER BY e, i, j LIMIT 1)
SELECT 'time_ordered' AS split_name, 7::BIGINT AS seed, run_id, family, CASE WHEN i < bi THEN 'train' WHEN i < bj THEN 'val' ELSE 'test' END AS part FROM s, best""")
def _split_time_ordered(spark, d):
    started = sp.run_starts(b.runs(spark, d), b.flows(spark, d).select("run_id", "flow_start_ts"))
    return rounded(sp.split_time_ordered(started, 7))


@query("split_membership", "J13", f"""WITH RECURSIVE {STRAT_SQL}, {b.FLOWS_SQL}
SELECT split_name, part, run_id, count(*) AS n, {sql_r4('sum(src_bytes)')} AS src_bytes FROM flows JOIN strat USING (run_id) GROUP BY 1, 2, 3""")
def _split_membership(spark, d):
    rows = b.flows(spark, d).select("run_id", "src_bytes")
    return rounded(sp.split_membership(rows, stratified(spark, d)).groupBy("split_name", "part", "run_id").agg(
        F.count("*").alias("n"), F.sum("src_bytes").alias("src_bytes")))


@query("part_family_counts", "A16", f"WITH RECURSIVE {STRAT_SQL} SELECT split_name, part, family, count(*) AS n FROM strat GROUP BY 1, 2, 3")
def _part_family_counts(spark, d):
    return sp.part_family_counts(stratified(spark, d))


def broken(spark, d):
    """A split table with a run in two parts, a missing run and an unknown one."""
    s = sp.split_by_counts(b.runs(spark, d), SEEDS)
    twice = s.where("run_id in ('1', '2')").withColumn(
        "part", F.when(F.col("part") == "train", "val").otherwise("train"))
    unknown = s.where("run_id = '3'").withColumn("run_id", F.lit("no-such-run"))
    return s.where("run_id not in ('4', '5')").unionByName(twice).unionByName(unknown)


@query("split_disjoint", "U2", """SELECT 'stratified_seed' || seed AS split_name, run_id, 2::BIGINT AS parts
FROM (SELECT unnest([42, 43]) AS seed), (SELECT DISTINCT CAST(user_id AS VARCHAR) AS run_id FROM events WHERE user_id IN (1, 2))""")
def _split_disjoint(spark, d):
    return sp.split_overlaps(broken(spark, d))


@query("split_coverage", "U3", """SELECT 'stratified_seed' || seed AS split_name, run_id, problem
FROM (SELECT unnest([42, 43]) AS seed), (
  SELECT DISTINCT CAST(user_id AS VARCHAR) AS run_id, 'missing' AS problem FROM events WHERE user_id IN (4, 5)
  UNION ALL SELECT DISTINCT 'no-such-run', 'extra' FROM events WHERE user_id = 3)""")
def _split_coverage(spark, d):
    return sp.split_coverage(broken(spark, d), b.runs(spark, d))


@query("split_both_classes", "U6", f"""WITH RECURSIVE {STRAT_SQL}
SELECT split_name, part, bool_or(family = 'Benign') AS has_benign, bool_or(family <> 'Benign') AS has_attack,
       bool_or(family = 'Benign') AND bool_or(family <> 'Benign') AS ok
FROM strat WHERE NOT (part = 'val' AND family = 'Benign') GROUP BY 1, 2""")
def _split_both_classes(spark, d):
    return sp.split_class_presence(stratified(spark, d).where("not (part = 'val' and family = 'Benign')"))


FOLD_SQL = b.SCORES_SQL + """,
rl AS (SELECT run_id, count(*) AS rows, CAST(lower(trim(min(family))) <> 'benign' AS INT) AS label FROM scores GROUP BY 1),
kk AS (SELECT least(4, min(n)) AS k FROM (SELECT label, count(*) AS n FROM rl GROUP BY 1)),
o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY rows DESC, md5(run_id || '|11'), run_id) AS pos FROM rl),
fw AS (
  SELECT label, 0::BIGINT AS pos, list_transform(range(0, k), lambda x: 0::BIGINT) AS loads, NULL::VARCHAR AS run_id, 0::BIGINT AS rows, 0::BIGINT AS fold FROM (SELECT DISTINCT label FROM rl), kk
  UNION ALL
  SELECT o.label, o.pos, list_transform(w.loads, lambda x, i: x + CASE WHEN i = list_position(w.loads, list_min(w.loads)) THEN o.rows ELSE 0 END),
         o.run_id, o.rows, list_position(w.loads, list_min(w.loads)) - 1
  FROM fw w JOIN o ON o.label = w.label AND o.pos = w.pos + 1)"""


@query("run_folds_binary", "M4 V9", f"WITH RECURSIVE {FOLD_SQL} SELECT run_id, CAST(label AS BIGINT) AS label, rows, fold FROM fw WHERE pos > 0")
def _run_folds_binary(spark, d):
    return rounded(sp.run_folds_binary(b.scores(spark, d), 4, 11))


@query("run_label_mode", "A33", f"""WITH {b.SCORES_SQL},
c AS (SELECT run_id, toxic AS v, count(*) AS n FROM scores GROUP BY 1, 2)
SELECT run_id, CAST(sum(n) AS BIGINT) AS rows, arg_min(v, (-n, v))::BIGINT AS toxic FROM c GROUP BY 1""")
def _run_label_mode(spark, d):
    return rounded(sp.run_mode(b.scores(spark, d), "toxic"))


@query("run_folds_multiclass", "M5", f"""WITH {b.SCORES_SQL},
c AS (SELECT run_id, family AS v, count(*) AS n FROM scores GROUP BY 1, 2),
m AS (SELECT run_id, CAST(sum(n) AS BIGINT) AS rows, arg_min(v, (-n, v)) AS y_cat FROM c GROUP BY 1),
kk AS (SELECT least(5, min(n)) AS k FROM (SELECT y_cat, count(*) AS n FROM m GROUP BY 1))
SELECT run_id, y_cat, rows, (row_number() OVER (PARTITION BY y_cat ORDER BY md5(run_id || '|3'), run_id) - 1) % k AS fold FROM m, kk""")
def _run_folds_multiclass(spark, d):
    rows = b.scores(spark, d).withColumnRenamed("family", "y_cat")
    return rounded(sp.run_folds_multiclass(rows, 5, 3))


@query("fold_rows", "M6", f"""WITH RECURSIVE {FOLD_SQL}
SELECT s.doc_id, s.run_id, f.fold FROM scores s JOIN (SELECT run_id, fold FROM fw WHERE pos > 0) f USING (run_id)""")
def _fold_rows(spark, d):
    s = b.scores(spark, d).drop("fold")
    return rounded(sp.fold_rows(s, sp.run_folds_binary(s, 4, 11)).select("doc_id", "run_id", "fold"))


@query("group_strata", "M37", f"""WITH {b.SCORES_SQL}
SELECT doc_id, CAST(family <> 'Benign' AS BIGINT) AS by_family, CAST(avg(y_bin) OVER (PARTITION BY run_id) >= 0.5 AS BIGINT) AS by_label FROM scores""")
def _group_strata(spark, d):
    s = b.scores(spark, d).select("doc_id", "run_id", "family", "y_bin")
    by_family = sp.group_strata(s).select("doc_id", F.col("stratum").alias("by_family"))
    by_label = sp.group_strata(s.drop("family")).select("doc_id", F.col("stratum").alias("by_label"))
    return rounded(by_family.join(by_label, "doc_id"))


@query("group_holdout", "M7", f"""WITH {b.SCORES_SQL},
r AS (SELECT run_id, CAST(min(family) <> 'Benign' AS BIGINT) AS stratum FROM scores GROUP BY 1),
k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(run_id || '|5'), run_id) - 1 AS pos, count(*) OVER (PARTITION BY stratum) AS n FROM r)
SELECT run_id, stratum, CASE WHEN n > 1 AND pos < least(greatest({bround_sql('n * 0.2::DOUBLE')}, 1), n - 1) THEN 'val' ELSE 'train' END AS part FROM k""")
def _group_holdout(spark, d):
    return rounded(sp.group_holdout(sp.group_strata(b.scores(spark, d)), 0.2, 5))
