"""Labels, feature transforms, sequences, matching of modalities."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosswin.functions.expr import hash_number
from crosswin.operators import features as ft
from crosswin.operators.scale import settle
from crosswin.plans import bindings as b
from crosswin.plans import q_network as qn
from crosswin.plans.registry import query, r4, rounded, sql_r4

NUM = ["size", "price", "offset", "sparse", "constant", "empty"]
CAT = ["kind", "word"]

FRAME_SQL = """
f AS (
  SELECT p_partkey, p_brand AS run_id,
         CASE WHEN CAST('0x' || substr(md5(p_brand), 1, 8) AS BIGINT) % 10 < 6 THEN 'train' WHEN CAST('0x' || substr(md5(p_brand), 1, 8) AS BIGINT) % 10 < 8 THEN 'val' ELSE 'test' END AS part,
         p_size::DOUBLE AS size, p_retailprice AS price, p_size - 25.0::DOUBLE AS "offset",
         CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice / 7 END AS sparse, 3.0::DOUBLE AS constant, NULL::DOUBLE AS empty,
         p_type AS kind, CASE WHEN p_partkey % 9 <> 0 THEN split_part(p_name, ' ', 1) END AS word
  FROM part),
num AS (""" + " UNION ALL ".join(
    f"SELECT p_partkey, part, '{c}' AS c, \"{c}\" AS v FROM f" for c in NUM) + """),
st AS (SELECT c, quantile_cont(v, 0.5) AS med, coalesce(min(v) >= 0 AND max(v) > 10, FALSE) AS lg FROM num WHERE part = 'train' GROUP BY 1),
imp AS (SELECT n.*, lg, CASE WHEN lg THEN ln(1 + greatest(coalesce(v, med, 0), 0)) ELSE coalesce(v, med, 0) END AS x FROM num n JOIN st USING (c)),
ms AS (SELECT c, avg(x) AS m, CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1 END AS s FROM imp WHERE part = 'train' GROUP BY 1)"""


def frame(spark, d):
    h = hash_number(F.col("p_brand")) % 10
    key = F.col("p_partkey")
    return b.table(spark, d, "part").select(
        "p_partkey", F.col("p_brand").alias("run_id"),
        F.when(h < 6, "train").when(h < 8, "val").otherwise("test").alias("part"),
        F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"),
        (F.col("p_size") - 25.0).alias("offset"), F.when(key % 4 != 0, F.col("p_retailprice") / 7).alias("sparse"),
        F.lit(3.0).alias("constant"), F.lit(None).cast("double").alias("empty"), F.col("p_type").alias("kind"),
        F.when(key % 9 != 0, F.split("p_name", " ")[0]).alias("word"))


def long_form(df, keep, columns):
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keep, F.explode(pairs).alias("_e")).select(*keep, "_e.feature", "_e.value")


@query("derive_labels", "P4 P5", f"""WITH {qn.WIN_SQL}, {qn._mode_sql('attack_category', 'attack')},
l AS ({qn.LABEL_SQL} FROM grid g LEFT JOIN fw f USING (run_id, w0) GROUP BY 1, 2, 3)
SELECT l.run_id, l.window_start_s, CAST(traffic_type_win = 'Attack' AS BIGINT) AS y_bin, coalesce(m.m, 'Benign') AS y_cat
FROM l LEFT JOIN m_attack_category m ON m.run_id = l.run_id AND m.w0 = l.window_start_s WHERE n_flows > 0""")
def _derive_labels(spark, d):
    w = ft.derive_labels(ft.drop_empty_windows(qn.index(spark, d)))
    return rounded(w.select("run_id", "window_start_s", "y_bin", "y_cat"))


@query("choose_log_columns", "M8", f"WITH {FRAME_SQL} SELECT c AS \"column\", lg AS is_log, {sql_r4('med')} AS median FROM st")
def _choose_log_columns(spark, d):
    train = frame(spark, d).where("part = 'train'")
    _, log = ft.choose_log_columns(train, NUM)
    names = spark.createDataFrame([(c, c in log) for c in NUM], "column string, is_log boolean")
    return names.join(ft.column_medians(train, NUM), "column", "left").select("column", "is_log", r4("median"))


@query("numeric_transform", "M9 M11", f"""WITH {FRAME_SQL}
SELECT p_partkey, part, CASE WHEN lg THEN c || '__log1p' ELSE c END AS feature, {sql_r4('(x - m) / s')} AS value FROM imp JOIN ms USING (c)""")
def _numeric_transform(spark, d):
    f = frame(spark, d)
    t = ft.fit_transform(f.where("part = 'train'"), NUM, [])
    return rounded(long_form(t.apply(f, ["p_partkey", "part"]), ["p_partkey", "part"], t.names))


@query("categorical_transform", "M10 M11", f"""WITH {FRAME_SQL},
cat AS (SELECT p_partkey, part, 'kind' AS c, kind AS v FROM f UNION ALL SELECT p_partkey, part, 'word', word FROM f),
cc AS (SELECT c, v, count(*) AS n FROM cat WHERE part = 'train' AND v IS NOT NULL GROUP BY 1, 2),
mo AS (SELECT c, arg_min(v, (-n, v)) AS mode FROM cc GROUP BY 1)
SELECT p_partkey, part, cc.c || '_' || cc.v AS feature, (coalesce(cat.v, mode) = cc.v)::INT::DOUBLE AS value
FROM cat JOIN mo USING (c) JOIN cc USING (c)""")
def _categorical_transform(spark, d):
    f = frame(spark, d)
    t = ft.fit_transform(f.where("part = 'train'"), [], CAT)
    t = ft.Transform.from_json(t.to_json())
    return rounded(long_form(t.apply(f, ["p_partkey", "part"]), ["p_partkey", "part"], t.names))


ALL_SPLITS_SQL = """
f AS (
  SELECT 'split' || seed AS split_name, p_partkey,
         CASE WHEN CAST('0x' || substr(md5(p_brand || seed), 1, 8) AS BIGINT) % 10 < 6 THEN 'train' WHEN CAST('0x' || substr(md5(p_brand || seed), 1, 8) AS BIGINT) % 10 < 8 THEN 'val' ELSE 'test' END AS part,
         p_size::DOUBLE AS size, p_retailprice AS price, p_size - 25.0::DOUBLE AS "offset",
         CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice / 7 END AS sparse, 3.0::DOUBLE AS constant, NULL::DOUBLE AS empty,
         p_type AS kind, CASE WHEN p_partkey % 9 <> 0 THEN split_part(p_name, ' ', 1) END AS word
  FROM part, (SELECT unnest([1, 2]) AS seed)),
num AS (""" + " UNION ALL ".join(
    f"SELECT split_name, p_partkey, part, '{c}' AS c, {i} AS place, \"{c}\" AS v FROM f" for i, c in enumerate(NUM)) + f"""),
st AS (SELECT split_name, c, coalesce(quantile_cont(v, 0.5), 0) AS med, coalesce(min(v) >= 0 AND max(v) > 10, FALSE) AS lg FROM num WHERE part = 'train' GROUP BY 1, 2),
imp AS (SELECT n.*, lg, CASE WHEN lg THEN ln(1 + greatest(coalesce(v, med), 0)) ELSE coalesce(v, med) END AS x FROM num n JOIN st USING (split_name, c)),
ms AS (SELECT split_name, c, avg(x) AS m, CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1 END AS s FROM imp WHERE part = 'train' GROUP BY 1, 2),
cat AS (SELECT split_name, p_partkey, part, 'kind' AS c, 0 AS place, kind AS v FROM f UNION ALL SELECT split_name, p_partkey, part, 'word', 1, word FROM f),
cc AS (SELECT split_name, place, c, v, count(*) AS n FROM cat WHERE part = 'train' AND v IS NOT NULL GROUP BY ALL),
mo AS (SELECT split_name, c, arg_min(v, (-n, v)) AS mode FROM cc GROUP BY 1, 2),
dict AS (SELECT split_name, c, v, {len(NUM)} + row_number() OVER (PARTITION BY split_name ORDER BY place, v) - 1 AS i FROM cc)"""


@query("transform_all_splits", "M9 M10 M11", f"""WITH {ALL_SPLITS_SQL}
SELECT split_name, part, p_partkey, CAST(place AS BIGINT) AS "index", CASE WHEN lg THEN c || '__log1p' ELSE c END AS feature, {sql_r4('(x - m) / s')} AS value FROM imp JOIN ms USING (split_name, c)
UNION ALL SELECT cat.split_name, part, p_partkey, i, c || '_' || dict.v, 1.0 FROM cat JOIN mo USING (split_name, c) JOIN dict USING (split_name, c) WHERE dict.v = coalesce(cat.v, mode)""")
def _transform_all_splits(spark, d):
    """Both splits fitted in one pass; categories are a table, vectors are sparse."""
    t, rows = all_splits(spark, d)
    x = t.apply(rows, ["split_name", "part", "p_partkey"])
    entries = x.select("split_name", "part", "p_partkey", F.inline(F.arrays_zip(F.col("indices").alias("index"), F.col("values").alias("value"))))
    return rounded(entries.join(t.names(), ["split_name", "index"]).select("split_name", "part", "p_partkey", "index", "feature", r4("value")))


@query("split_dictionaries", "M10 M11", f"""WITH {ALL_SPLITS_SQL}
SELECT split_name, c AS "column", count(*) AS n_values, min(i) AS first_index, max(i) AS last_index, any_value(mode) AS mode FROM dict JOIN mo USING (split_name, c) GROUP BY 1, 2""")
def _split_dictionaries(spark, d):
    t, _ = all_splits(spark, d)
    sizes = t.dictionary.groupBy("split_name", "column").agg(
        F.count("*").alias("n_values"), F.min("index").alias("first_index"), F.max("index").alias("last_index"))
    return sizes.join(t.modes, ["split_name", "column"])


def all_splits(spark, d):
    each = frame(spark, d).drop("part").withColumn("seed", F.explode(F.array(F.lit("1"), F.lit("2"))))
    h = hash_number(F.concat("run_id", "seed")) % 10
    part = F.when(h < 6, "train").when(h < 8, "val").otherwise("test")
    rows = settle(each.withColumns({"split_name": F.concat(F.lit("split"), "seed"), "part": part}).drop("seed"), "split-rows")
    return ft.fit_all_splits(rows, NUM, CAT), rows


@query("feature_ablation", "P6 P7 P8", """
SELECT 'kept' AS variant, 'size' AS feature, sum(p_size)::DOUBLE AS value FROM part
UNION ALL SELECT 'no_history', 'proto_mode_a', sum(p_size % 2)::DOUBLE FROM part
UNION ALL SELECT 'no_history', 'size', sum(p_size)::DOUBLE FROM part
UNION ALL SELECT 'only_modes', 'proto_mode_a', sum(p_size % 2)::DOUBLE FROM part
UNION ALL SELECT 'only_modes', 'history_mode_b', sum(p_size % 3)::DOUBLE FROM part""")
def _feature_ablation(spark, d):
    p = b.table(spark, d, "part").select(
        F.col("p_brand").alias("run_id"), F.lit(0).alias("window_start_s"), F.lit(1).alias("window_end_s"),
        F.lit("Attack").alias("traffic_type_win"), F.lit(None).cast("string").alias("attack_category_win"),
        F.col("p_size").cast("string").alias("size"), (F.col("p_size") % 2).alias("proto_mode_a"),
        (F.col("p_size") % 3).alias("history_mode_b"), F.col("p_name").alias("words"),
        F.lit(1.0).alias("attack_flow_frac"), F.lit(1.0).alias("ri_mean"))
    columns, _ = ft.feature_columns(ft.drop_constant_radio(p), "network")
    picks = [("kept", "no_mode_onehots"), ("no_history", "drop_history_onehots"), ("only_modes", "mode_onehots_only")]
    entries = [F.struct(F.lit(v).alias("variant"), F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
               for v, variant in picks for c in ft.feature_ablation(columns, "network", variant)]
    return p.select(F.explode(F.array(*entries)).alias("_e")).groupBy("_e.variant", "_e.feature").agg(
        F.sum("_e.value").alias("value"))


@query("load_processed", "S8", f"""WITH {b.SCORES_SQL}
SELECT run_id, window_start_s, y_bin::BIGINT AS y_bin, {sql_r4('coalesce(p_net, 0)::FLOAT')} AS p_net, {sql_r4('p_rad::FLOAT')} AS p_rad FROM scores WHERE part = 'train'""")
def _load_processed(spark, d):
    s = b.scores(spark, d).where("part = 'train'").withColumns({"y_cat": F.col("family"), "ri_mean": F.lit(1.0)})
    loaded, feats = ft.load_processed(s.drop("doc_id", "toxic", "fold"), "network")
    return rounded(loaded.select("run_id", "window_start_s", "y_bin", *feats))


@query("part_summary", "A32 K10", f"""WITH {b.SCORES_SQL}
SELECT part, count(*) AS n, {sql_r4('avg(y_bin)')} AS pos_rate, count(DISTINCT family) AS n_classes FROM scores GROUP BY 1""")
def _part_summary(spark, d):
    return rounded(ft.part_summary(b.scores(spark, d).withColumn("y_cat", F.col("family"))))


@query("causal_sequences", "W7", f"""WITH {b.SCORES_SQL},
s AS (SELECT doc_id, lag(p_rad, 2) OVER w AS a2, lag(p_rad, 1) OVER w AS a1, p_rad AS a0, lag(y_bin, 2) OVER w AS y2, lag(y_bin, 1) OVER w AS y1, y_bin AS y0
      FROM scores WINDOW w AS (PARTITION BY run_id ORDER BY window_start_s))
SELECT doc_id, 0::BIGINT AS step, {sql_r4('coalesce(a2, 0)')} AS p_rad, coalesce(y2, 0)::DOUBLE AS y, (a2 IS NULL)::INT::DOUBLE AS pad FROM s
UNION ALL SELECT doc_id, 1, {sql_r4('coalesce(a1, 0)')}, coalesce(y1, 0)::DOUBLE, (a1 IS NULL)::INT::DOUBLE FROM s
UNION ALL SELECT doc_id, 2, {sql_r4('a0')}, y0::DOUBLE, 0.0 FROM s""")
def _causal_sequences(spark, d):
    s = b.scores(spark, d).select("doc_id", "run_id", "window_start_s", "p_rad", "y_bin")
    seq = ft.causal_sequences(s, ["p_rad", "y_bin"], 3, block=4)
    return seq.select("doc_id", F.posexplode("sequence").alias("step", "v")).select(
        "doc_id", F.col("step").cast("bigint").alias("step"), r4(F.col("v")[0], "p_rad"),
        F.col("v")[1].alias("y"), F.col("v")[2].alias("pad"))


SIDES_SQL = b.SCORES_SQL + """,
a AS (SELECT run_id, window_start_s, window_end_s, family, y_bin, p_raw FROM scores WHERE h % 10 <> 0),
z AS (SELECT run_id, window_start_s, window_end_s, family, CASE WHEN doc_id % 11 = 0 THEN 1 - y_bin ELSE y_bin END AS y_bin, p_rad FROM scores WHERE doc_id % 7 <> 0)"""


def sides(spark, d):
    s = b.scores(spark, d)
    h = hash_number(F.col("doc_id").cast("string"))
    a = s.where(h % 10 != 0).select(*ft.KEYS, "family", "y_bin", (F.col("p_rad") * 2).alias("p_a"))
    y = F.when(F.col("doc_id") % 11 == 0, 1 - F.col("y_bin")).otherwise(F.col("y_bin"))
    return a, s.where("doc_id % 7 <> 0").select(*ft.KEYS, "family", y.alias("y_bin"), "p_rad")


@query("align_modalities", "J10", f"""WITH {SIDES_SQL}
SELECT a.run_id, a.window_start_s, a.window_end_s, a.family, a.y_bin::BIGINT AS y_bin, {sql_r4('z.p_rad * 2')} AS p_a, {sql_r4('z.p_rad')} AS p_rad
FROM a JOIN z USING (run_id, window_start_s, window_end_s)""")
def _align_modalities(spark, d):
    return rounded(ft.align_modalities(*sides(spark, d)))


@query("alignment_violations", "J10", f"""WITH {SIDES_SQL},
j AS (SELECT coalesce(a.run_id, z.run_id) AS run_id, coalesce(a.window_start_s, z.window_start_s) AS window_start_s, coalesce(a.window_end_s, z.window_end_s) AS window_end_s,
             a.y_bin AS ya, z.y_bin AS yz FROM a FULL JOIN z ON a.run_id = z.run_id AND a.window_start_s = z.window_start_s)
SELECT run_id, window_start_s, window_end_s, CASE WHEN yz IS NULL THEN 'missing_right' WHEN ya IS NULL THEN 'missing_left' ELSE 'y_bin_differs' END AS problem
FROM j WHERE ya IS DISTINCT FROM yz""")
def _alignment_violations(spark, d):
    return ft.alignment_violations(*sides(spark, d))


@query("join_meta", "J11", f"""WITH {SIDES_SQL}
SELECT a.run_id, a.window_start_s, a.window_end_s, a.y_bin::BIGINT AS y_bin, z.family, {sql_r4('z.p_rad')} AS p_rad FROM a JOIN z USING (run_id, window_start_s, window_end_s)""")
def _join_meta(spark, d):
    a, z = sides(spark, d)
    return rounded(ft.join_meta(a, z, ft.KEYS, ["y_bin"]))


@query("encode_classes", "M36", f"""WITH {FRAME_SQL}
SELECT kind, row_number() OVER (ORDER BY kind) - 1 AS class_id FROM (SELECT DISTINCT kind FROM f WHERE part = 'train')""")
def _encode_classes(spark, d):
    return rounded(ft.encode_classes(frame(spark, d).where("part = 'train'"), "kind"))


@query("unknown_classes", "M36", f"""WITH {FRAME_SQL}
SELECT DISTINCT run_id FROM f WHERE part = 'test'""")
def _unknown_classes(spark, d):
    f = frame(spark, d)
    classes = ft.encode_classes(f.where("part = 'train'"), "run_id")
    return ft.unknown_classes(f.where("part = 'test'"), classes, "run_id")


@query("class_weights", "M35", f"""WITH {FRAME_SQL},
c AS (SELECT kind, count(*) AS rows FROM f GROUP BY 1)
SELECT kind, rows, {sql_r4('(SELECT sum(rows)::DOUBLE / count(*) FROM c) / rows')} AS weight FROM c""")
def _class_weights(spark, d):
    return rounded(ft.class_weights(frame(spark, d), "kind"))
