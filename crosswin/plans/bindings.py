"""The given tables seen as recordings. Every Spark view has a SQL twin of the same meaning.

One time unit is one hour, so W = 10 and S = 2 mean hours here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crosswin.functions.expr import hash_number
from crosswin.operators.scale import attach, settle

FAMILIES = ["Benign", "BruteForce", "DDOS", "DoS", "Probe", "Web"]  # fixed values
FAMILY_SQL = "['Benign','BruteForce','DDOS','DoS','Probe','Web']"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # the tables hold times without zone
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    """Microseconds since the epoch."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def family_of(uid: Column) -> Column:
    return F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), (uid % 6 + 1).cast("int"))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    e = e.select(
        "event_id", "user_id", "event_type", "value", k.alias("k"),
        (micros("ts") / 3.6e9).alias("t_abs"),
        family_of(F.col("user_id")).alias("family"),
    )
    k = F.col("k")
    attack = (F.col("user_id") % 6 != 0) & F.col("event_type").isin("error", "purchase", "signup")
    word = F.when(k % 3 == 0, "Attack").when(k % 3 == 1, "attack_x ").otherwise(" ATTACK")
    return e.select(
        F.col("user_id").cast("string").alias("run_id"),
        F.col("event_id").alias("ord"),
        "family",
        F.col("t_abs").alias("flow_start_ts"),
        (F.col("value") / 100).alias("flow_duration"),
        F.when(attack, word).otherwise("Benign").alias("traffic_type"),
        F.when(attack, F.lower("family")).alias("attack_category"),
        F.when(attack & (k % 7 != 0), F.col("event_type")).alias("attack_type"),
        F.col("event_type").alias("proto"),
        F.when(k % 10 != 0, F.concat(F.lit("s"), (k % 4).cast("string"))).alias("service"),
        F.concat(F.lit("c"), (F.col("event_id") % 3).cast("string")).alias("conn_state"),
        F.concat(F.lit("h"), (k % 6).cast("string")).alias("history"),
        F.concat(F.lit("ip"), (k % 7).cast("string")).alias("src_ip"),
        F.concat(F.lit("d"), (k % 3).cast("string")).alias("dst_ip"),
        k.alias("src_port"),
        F.when(k % 9 != 0, k % 50 - 1).alias("dst_port"),
        (F.col("value") / 100).alias("duration"),
        (F.col("value") * 100).alias("src_bytes"),
        F.when(k % 11 != 0, k * 10.0).alias("dst_bytes"),
        (k * 1.0).alias("src_pkts"),
        (F.col("event_id") % 5 * 1.0).alias("dst_pkts"),
        (F.col("value") * 40).alias("src_ip_bytes"),
        F.when(k % 3 != 0, F.col("value")).alias("dst_ip_bytes"),
        F.lit(0.0).alias("missed_bytes"),
        F.when(k % 4 != 0, k % 3 * 1.0).alias("http_trans_depth"),
        (k * k * 1.0).alias("files_total_bytes"),
        (k % 2).alias("is_GET_mthd"),
        F.when(k % 5 != 0, (k % 3 == 0).cast("int")).alias("http_status_error"),
        F.lit(0).alias("is_file_transfered"),
    )


FLOWS_SQL = f"""
ev AS (
  SELECT event_id, user_id, event_type, value, ts, CAST(json_extract_string(props, '$.k') AS INT) AS k,
         epoch_us(ts) / 3.6e9 AS t_abs, {FAMILY_SQL}[CAST(user_id % 6 AS INT) + 1] AS family
  FROM events),
flows0 AS (
  SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS ord, family, t_abs AS flow_start_ts,
         value / 100 AS flow_duration,
         (user_id % 6 <> 0 AND event_type IN ('error','purchase','signup')) AS attack,
         lower(family) AS fam_l, event_type, k, value, event_id,
         event_type AS proto,
         CASE WHEN k % 10 <> 0 THEN 's' || (k % 4) END AS service,
         'c' || (event_id % 3) AS conn_state, 'h' || (k % 6) AS history,
         'ip' || (k % 7) AS src_ip, 'd' || (k % 3) AS dst_ip,
         k AS src_port, CASE WHEN k % 9 <> 0 THEN k % 50 - 1 END AS dst_port,
         value / 100 AS duration, value * 100 AS src_bytes,
         CASE WHEN k % 11 <> 0 THEN k * 10.0::DOUBLE END AS dst_bytes,
         k * 1.0::DOUBLE AS src_pkts, (event_id % 5) * 1.0::DOUBLE AS dst_pkts,
         value * 40 AS src_ip_bytes, CASE WHEN k % 3 <> 0 THEN value END AS dst_ip_bytes,
         0.0::DOUBLE AS missed_bytes,
         CASE WHEN k % 4 <> 0 THEN (k % 3) * 1.0::DOUBLE END AS http_trans_depth,
         k * k * 1.0::DOUBLE AS files_total_bytes,
         k % 2 AS is_GET_mthd, CASE WHEN k % 5 <> 0 THEN CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END END AS http_status_error,
         0 AS is_file_transfered
  FROM ev),
flows AS (
  SELECT *, CASE WHEN attack THEN CASE WHEN k % 3 = 0 THEN 'Attack' WHEN k % 3 = 1 THEN 'attack_x ' ELSE ' ATTACK' END ELSE 'Benign' END AS traffic_type,
         CASE WHEN attack THEN fam_l END AS attack_category,
         CASE WHEN attack AND k % 7 <> 0 THEN event_type END AS attack_type
  FROM flows0)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    uid = F.col("user_id")
    return table(spark, sf_dir, "events").select(
        uid.cast("string").alias("run_id"), family_of(uid).alias("family")).distinct()


RUNS_SQL = f"""
runs AS (
  SELECT DISTINCT CAST(user_id AS VARCHAR) AS run_id, {FAMILY_SQL}[CAST(user_id % 6 AS INT) + 1] AS family
  FROM events)"""


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter records: dlBytes/ulBytes counters with resets, KPIs, some runs without time.

    Time is in milliseconds for even users and in seconds for odd ones, one unit per hour.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    uid, eid = F.col("user_id"), F.col("event_id")
    hours = F.floor(micros("ts") / 3600000000).cast("bigint")
    base = F.lit(1000000000)
    ts = F.when(uid % 5 == 0, None).when(uid % 2 == 0, (base + hours) * 1000 + eid % 1000).otherwise(base + hours)
    return table(spark, sf_dir, "events").select(
        uid.cast("string").alias("run_id"),
        family_of(uid).alias("family"),
        eid.alias("ord"),
        ts.alias("timestamp"),
        F.col("event_type").alias("ue_id"),
        F.when(k % 13 != 0, hours % 50 * 100.0 + F.col("value")).alias("dlBytes"),
        F.when(k % 13 != 0, k * 2.0).alias("ulBytes"),
        F.col("value").alias("sinr"),
        F.when(k % 4 != 0, -80.0 - k).alias("rsrp"),
        F.lit(1.0).alias("ri"),
        (k % 15).alias("cqi"),
    )


TELEMETRY_SQL = f"""
tel AS (
  SELECT CAST(user_id AS VARCHAR) AS run_id, {FAMILY_SQL}[CAST(user_id % 6 AS INT) + 1] AS family,
         event_id AS ord,
         CASE WHEN user_id % 5 = 0 THEN NULL
              WHEN user_id % 2 = 0 THEN (1000000000 + hours) * 1000 + event_id % 1000
              ELSE 1000000000 + hours END AS ts,
         event_type AS ue_id,
         CASE WHEN k % 13 <> 0 THEN (hours % 50) * 100.0::DOUBLE + value END AS dlBytes,
         CASE WHEN k % 13 <> 0 THEN k * 2.0::DOUBLE END AS ulBytes,
         value AS sinr, CASE WHEN k % 4 <> 0 THEN -80.0::DOUBLE - k END AS rsrp, 1.0::DOUBLE AS ri, k % 15 AS cqi
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k, epoch_us(ts) // 3600000000 AS hours FROM events))"""


def telemetry_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw text lines in the shapes found in the field: trailing comma, byte-string wrapper,
    single quotes, other key spellings, and broken lines."""
    k = F.get_json_object("props", "$.k").cast("int")
    eid = F.col("event_id")
    body = F.concat(
        F.lit('{"'), F.when(eid % 4 == 3, "DL_BYTES").otherwise("dlBytes"), F.lit('": '), k.cast("string"),
        F.lit(', "ulBytes": '), (k * 2).cast("string"),
        F.lit(', "'), F.when(eid % 3 == 0, "ueid").otherwise("ue_id"), F.lit('": "'), F.col("event_type"),
        F.when(eid % 6 == 0, F.lit('"}')).otherwise(
            F.concat(F.lit('", "ts": '), (eid + 1700000000).cast("string"), F.lit("}"))),
    )
    line = (
        F.when(eid % 50 == 0, F.lit('{"dlBytes": 1, '))
        .when(eid % 50 == 25, F.lit('{"other": 1}'))
        .when(eid % 4 == 0, F.concat(body, F.lit(",")))
        .when(eid % 4 == 1, F.concat(F.lit("b'"), body, F.lit("'")))
        .when(eid % 4 == 2, F.translate(body, '"', "'"))
        .otherwise(F.concat(F.lit("log: "), body))
    )
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("run_id"), eid.alias("ord"), line.alias("value"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File inventory: family, layer, path."""
    key = F.col("p_partkey")
    stem = F.concat(
        F.when((key % 13 == 0) & (key % 2 == 1), "tcp-").otherwise(""),
        F.regexp_replace("p_brand", "#", "-Npig"), F.lit("__"), F.col("p_size").cast("string"),
    )
    layer = F.when(key % 2 == 0, "network").otherwise("radio")
    suffix = F.when(key % 2 == 0, ".PCAP").otherwise(".txt")
    return table(spark, sf_dir, "part").select(
        F.col("p_type").alias("family"), layer.alias("layer"),
        F.concat(F.lit("/d/"), key.cast("string"), F.lit("/"), stem, suffix).alias("path"),
    )


PATHS_SQL = """
paths AS (
  SELECT p_type AS family, CASE WHEN p_partkey % 2 = 0 THEN 'network' ELSE 'radio' END AS layer,
         '/d/' || p_partkey || '/' || CASE WHEN p_partkey % 13 = 0 AND p_partkey % 2 = 1 THEN 'tcp-' ELSE '' END
         || replace(p_brand, '#', '-Npig') || '__' || p_size
         || CASE WHEN p_partkey % 2 = 0 THEN '.PCAP' ELSE '.txt' END AS path
  FROM part),
stems AS (
  SELECT family, layer, path,
         replace(trim(regexp_replace(replace(lower(regexp_replace(regexp_replace(path, '^.*/', ''), '\\.[^.]*$', '')), '-', '_'), '__+', '_', 'g'), '_'), 'npig', 'nping') AS k
  FROM paths)"""


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("run_id"),
        (micros("l_shipdate") / 86400000000 + F.col("l_discount")).alias("ts"),
        F.col("l_quantity").cast("bigint").alias("orig_len"),
    )


PACKETS_SQL = """
packets AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS run_id, epoch_us(l_shipdate) / 86400000000.0::DOUBLE + l_discount AS ts,
         CAST(l_quantity AS BIGINT) AS orig_len
  FROM lineitem)"""


def series_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two dense series per run, from 0: bytes on the network, the same seen by radio later.

    The radio series lags by ``user_id % 5`` and carries a small disturbance.
    """
    uid = F.col("user_id")
    hour = F.floor(micros("ts") / 3600000000).cast("bigint")
    raw = table(spark, sf_dir, "events").groupBy(uid.cast("string").alias("run_id"), uid, hour.alias("h")).agg(
        F.count("*").alias("c"), F.sum(F.floor("value")).alias("v"))
    raw = settle(raw, "raw-series")  # the events are read once for both series
    raw = attach(raw, raw.groupBy("run_id").agg(F.min("h").alias("h0")), "run_id")
    net = raw.select("run_id", (F.col("h") - F.col("h0")).alias("t"), (F.col("c") * 10.0 + F.col("v") % 7).alias("v"))
    rad = raw.select(
        "run_id", (F.col("h") - F.col("h0") + uid % 5).alias("t"),
        (F.col("c") * 10.0 + F.col("v") % 3).alias("v"))
    return net, rad


SERIES_SQL = """
raw AS (
  SELECT CAST(user_id AS VARCHAR) AS run_id, user_id AS uid, epoch_us(ts) // 3600000000 AS h,
         count(*) AS c, sum(CAST(floor(value) AS BIGINT)) AS v
  FROM events GROUP BY 1, 2, 3),
raw0 AS (SELECT *, h - min(h) OVER (PARTITION BY run_id) AS t FROM raw),
net_s AS (SELECT run_id, CAST(t AS BIGINT) AS t, c * 10.0::DOUBLE + CAST(v AS BIGINT) % 7 AS v FROM raw0),
rad_s AS (SELECT run_id, CAST(t + uid % 5 AS BIGINT) AS t, c * 10.0::DOUBLE + CAST(v AS BIGINT) % 3 AS v FROM raw0),
rad_r AS (SELECT run_id, t - min(t) OVER (PARTITION BY run_id) AS t, v FROM rad_s),
net_d AS (
  SELECT g.run_id, g.t, coalesce(n.v, 0.0) AS v
  FROM (SELECT run_id, unnest(range(0, max(t) + 1)) AS t FROM net_s GROUP BY run_id) g LEFT JOIN net_s n USING (run_id, t)),
rad_d AS (
  SELECT g.run_id, g.t, coalesce(n.v, 0.0) AS v
  FROM (SELECT run_id, unnest(range(0, max(t) + 1)) AS t FROM rad_r GROUP BY run_id) g LEFT JOIN rad_r n USING (run_id, t))"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window-level scores of two detectors: labelled documents of a source form one run."""
    doc = F.col("doc_id")
    h = hash_number(doc.cast("string"))
    p_net = 1.0 / (1.0 + F.exp(-(F.ln(F.col("n_chars").cast("double")) - 6.0)))
    p_rad = F.round((h % 1000) / 1000.0 * 0.6 + F.col("quality") * 0.3, 3)
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return d.join(table(spark, sf_dir, "labels"), "doc_id").select(
        F.concat("source", F.lit("-"), "lang").alias("run_id"),
        F.when(F.col("lang") == "en", "Benign").otherwise(F.col("lang")).alias("family"),
        "doc_id",
        (doc * 2).alias("window_start_s"),
        (doc * 2 + 10).alias("window_end_s"),
        F.col("quality").cast("int").alias("y_bin"),
        F.col("toxic").cast("int").alias("toxic"),
        F.when(h % 97 == 0, float("nan")).otherwise(p_net).alias("p_net"),
        p_rad.alias("p_rad"),
        F.when(h % 10 < 6, "train").when(h % 10 < 8, "val").otherwise("test").alias("part"),
        (h % 5).cast("int").alias("fold"),
    )


SCORES_SQL = """
sc0 AS (
  SELECT d.doc_id, source || '-' || lang AS run_id, CASE WHEN lang = 'en' THEN 'Benign' ELSE lang END AS family,
         doc_id * 2 AS window_start_s, doc_id * 2 + 10 AS window_end_s, quality AS y_bin, toxic,
         1.0 / (1.0 + exp(-(ln(n_chars::DOUBLE) - 6.0))) AS p_raw,
         CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) AS h
  FROM documents d JOIN labels USING (doc_id)),
scores AS (
  SELECT *, CASE WHEN h % 97 = 0 THEN NULL ELSE p_raw END AS p_net,
         round((h % 1000) / 1000.0::DOUBLE * 0.6 + y_bin * 0.3::DOUBLE, 3) AS p_rad,
         CASE WHEN h % 10 < 6 THEN 'train' WHEN h % 10 < 8 THEN 'val' ELSE 'test' END AS part,
         CAST(h % 5 AS INT) AS fold
  FROM sc0)"""


def multiclass_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class scores from fixed slices of the vectors, for three systems and four seeds."""
    e = table(spark, sf_dir, "embeddings")
    x = F.col("embedding")

    def slice_score(j: int, shift: float) -> Column:
        # six slices over all 64 entries; the true class gets a lift so that scores mean something
        low, high = 64 * j // 6, 64 * (j + 1) // 6
        s = F.aggregate(F.slice(x, low + 1, high - low), F.lit(0.0), lambda a, v: a + v.cast("double"))
        return s + F.when(F.col("label") % 6 == j, shift).otherwise(0.0)

    systems = [("network_only", 0.3), ("radio_only", 0.6), ("fusion_mean", 0.9)]
    per_system = F.array(*[
        F.struct(F.lit(n).alias("system"), F.array(*[slice_score(j, s) for j in range(6)]).alias("raw"))
        for n, s in systems
    ])
    return e.select(
        "vec_id", (F.col("vec_id") % 20).cast("string").alias("run_id"),
        (F.col("vec_id") % 4).cast("int").alias("seed"),
        F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), (F.col("label") % 6 + 1).cast("int")).alias("y_true"),
        F.explode(per_system).alias("_s"),
    ).select("vec_id", "run_id", "seed", "y_true", "_s.system", "_s.raw")


MULTI_SQL = f"""
mc_s AS (SELECT unnest(['network_only','radio_only','fusion_mean']) AS system, unnest([0.3, 0.6, 0.9]::DOUBLE[]) AS lift),
mc_j AS (SELECT unnest(range(0, 6)) AS j),
mc_long AS (
  SELECT vec_id, CAST(vec_id % 20 AS VARCHAR) AS run_id, CAST(vec_id % 4 AS INT) AS seed,
         {FAMILY_SQL}[CAST(label % 6 AS INT) + 1] AS y_true, system, j,
         list_sum(list_transform(embedding[CAST(64 * j // 6 + 1 AS INT):CAST(64 * (j + 1) // 6 AS INT)], lambda v: v::DOUBLE))
         + CASE WHEN label % 6 = j THEN lift ELSE 0.0 END AS raw
  FROM embeddings, mc_s, mc_j),
mc_pos AS (SELECT *, greatest(raw, 0.0) AS pos FROM mc_long),
mc_row AS (SELECT vec_id, system, sum(pos) AS tot FROM mc_pos GROUP BY 1, 2),
mc_p AS (
  SELECT p.*, least(greatest(CASE WHEN r.tot > 0 THEN p.pos / r.tot ELSE 1.0 / 6 END, 1e-15), 1.0 - 1e-15) AS prob
  FROM mc_pos p JOIN mc_row r USING (vec_id, system)),
mc_best AS (
  SELECT vec_id, run_id, seed, y_true, system,
         {FAMILY_SQL}[CAST(arg_min(j, (-prob, j)) AS INT) + 1] AS y_pred, max(prob) AS p_max
  FROM mc_p GROUP BY 1, 2, 3, 4, 5)"""


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric rows in the shape a training sweep writes, one per (model, system, seed, W, part)."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").groupBy(
        F.lower("p_type").alias("model"),
        F.element_at(F.array(*[F.lit(s) for s in ("network_only", "radio_only", "fusion_mean", "fusion_stacked")]),
                     (F.col("p_size") % 4 + 1).cast("int")).alias("system"),
        F.concat(F.lit("stratified_seed"), (F.length("p_name") % 5 + 42).cast("string")).alias("split"),
        F.when(key % 3 == 0, 5).otherwise(10).alias("W"),
        F.when(key % 5 == 0, "val").otherwise("test").alias("part"),
        (key % 7 == 0).alias("time_ordered"),
    ).agg(
        (F.sum("p_size") / F.count("*") / 50).alias("roc_auc"),
        (F.sum(F.col("p_size") * F.col("p_size")) / F.count("*") / 2500).alias("f1_macro"),
        (F.sum(key % 100) / F.count("*") / 100).alias("log_loss"),
        (F.sum((F.col("p_size") > 30).cast("int")) / F.count("*")).alias("detect_rate"),
        F.when(F.max("p_size") > 10, F.max("p_size") * 1.0).otherwise(float("inf")).alias("ttd_median"),
        F.sum("p_size").alias("n"),
    )


METRICS_SQL = """
mrows AS (
  SELECT lower(p_type) AS model,
         ['network_only','radio_only','fusion_mean','fusion_stacked'][CAST(p_size % 4 AS INT) + 1] AS system,
         'stratified_seed' || (length(p_name) % 5 + 42) AS split,
         CASE WHEN p_partkey % 3 = 0 THEN 5 ELSE 10 END AS W,
         CASE WHEN p_partkey % 5 = 0 THEN 'val' ELSE 'test' END AS part,
         (p_partkey % 7 = 0) AS time_ordered,
         sum(p_size)::DOUBLE / count(*) / 50 AS roc_auc,
         sum(p_size * p_size)::DOUBLE / count(*) / 2500 AS f1_macro,
         sum(p_partkey % 100)::DOUBLE / count(*) / 100 AS log_loss,
         sum(CASE WHEN p_size > 30 THEN 1 ELSE 0 END)::DOUBLE / count(*) AS detect_rate,
         CASE WHEN max(p_size) > 10 THEN max(p_size)::DOUBLE END AS ttd_median,
         sum(p_size)::BIGINT AS n
  FROM part GROUP BY 1, 2, 3, 4, 5, 6),
test_rows AS (SELECT *, CAST(regexp_extract(split, 'seed(\\d+)', 1) AS INT) AS seed FROM mrows WHERE W = 10 AND part = 'test' AND NOT time_ordered)"""

