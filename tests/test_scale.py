"""The large-input paths give the same rows as the small-input ones."""

import numpy as np
from pyspark.sql import functions as F

from crosswin.operators import scale, series


def skewed(spark, n=3000):
    # one key holds most rows
    return spark.range(n).select(
        F.when(F.col("id") % 10 < 7, "hot").otherwise((F.col("id") % 5).cast("string")).alias("k"),
        F.col("id").alias("o"), ((F.col("id") * 7919) % 101).cast("double").alias("v"))


def test_attach_salted_equals_broadcast(spark):
    big = skewed(spark)
    facts = big.groupBy("k").agg(F.count("*").alias("n")).where("k <> '3'")
    for how in ("left", "inner", "left_semi"):
        a = sorted(map(tuple, scale.attach(big, facts, "k", how).collect()), key=str)
        b = sorted(map(tuple, scale.attach(big, facts, "k", how, limit=0).collect()), key=str)
        assert a == b and a


def test_running_totals_by_ranges(spark):
    df = skewed(spark)
    a = scale.running_totals(df, ["k"], ["o"], {"s": "v"})
    b = scale.running_totals(df, ["k"], ["o"], {"s": "v"}, rows_per_task=100)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    g = scale.running_totals(df, [], [F.col("o").desc()], {"s": "v"}, rows_per_task=100).orderBy("o").collect()
    want = np.cumsum([r["v"] for r in g][::-1])[::-1]
    assert [r["s"] for r in g] == list(want)


def test_exact_quantiles_match_numpy(spark):
    df = skewed(spark)
    rows = df.toPandas()
    for bound in (None, 50):
        q = scale.exact_quantiles(df, ["k"], "v", {"a": 0.25, "b": 0.5, "c": 0.99}, rows_per_task=bound).collect()
        for r in q:
            v = rows[rows.k == r["k"]].v.to_numpy()
            assert r["n_values"] == v.size
            np.testing.assert_allclose([r["a"], r["b"], r["c"]], np.quantile(v, [0.25, 0.5, 0.99]))
    assert scale.exact_quantiles(df.where("false"), ["k"], "v", {"a": 0.5}).count() == 0
    one = scale.exact_quantiles(df, [], "v", {"a": 0.5}, rows_per_task=50).first()
    assert one["a"] == np.quantile(rows.v, 0.5)


def test_ordinal_in_blocks(spark):
    df = skewed(spark)
    got = scale.ordinal(df, ["k"], "o", "p", span=64).toPandas().sort_values("o")
    assert (got.groupby("k").cumcount() == got.p).all()


def test_grid_blocks(spark):
    df = spark.createDataFrame([("a", 10), ("b", 0), ("c", -1)], "k string, last bigint")
    got = sorted(map(tuple, scale.grid(df, "last", "t", 2, block=2).select("k", "t").collect()))
    assert got == [("a", 0), ("a", 2), ("a", 4), ("a", 6), ("a", 8), ("a", 10), ("b", 0)]


def test_fill_and_previous_across_chunks(spark):
    vals = [None, None, 3.0, None, None, 5.0, 2.0, None, None, None, 9.0, None]
    rows = [("a", i, v) for i, v in enumerate(vals)] + [("b", i, None) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, t bigint, x double")
    got = series.fill_both_ways(df, ["k"], "t", ["x"], size=3).orderBy("k", "t").collect()
    filled = [r["x_filled"] for r in got if r["k"] == "a"]
    assert filled == [3, 3, 3, 3, 3, 5, 2, 2, 2, 2, 9, 9]
    assert [r["x_before"] for r in got if r["k"] == "a"] == [filled[0]] + filled[:-1]
    assert {r["x_filled"] for r in got if r["k"] == "b"} == {0.0}
    known = df.where("x is not null")
    prev = series.previous(known, ["k"], "t", "x", "p", size=3).orderBy("t").collect()
    assert [r["p"] for r in prev] == [None, 3, 5, 2]


def test_moving_average_equals_convolution(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=50)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "k string, t bigint, v double")
    for w in (1, 2, 3, 4, 7):
        got = [r["v"] for r in series.moving_average(df, ["k"], "t", ["v"], w, size=8).orderBy("t").collect()]
        np.testing.assert_allclose(got, np.convolve(x, np.ones(w) / w, mode="same") if w > 1 else x)


def test_shared_folder_prefers_the_session_setting(spark):
    class Session:
        def __init__(self, folder, master):
            self.conf = type("C", (), {"get": staticmethod(lambda k, d=None: folder if k == "spark.checkpoint.dir" else d)})
            self.sparkContext = type("S", (), {"master": master, "applicationId": "app-test"})

    assert scale.shared_folder(Session("/shared/x", "yarn")).startswith("/shared/x/")
    local = scale.shared_folder(Session(None, "local[2]"))
    assert local == scale.shared_folder(Session(None, "local[2]"))
    try:
        scale.shared_folder(Session(None, "yarn"))
        raise AssertionError("a cluster without a shared folder must fail")
    except ValueError:
        pass


def _half_null(spark):
    return spark.createDataFrame([(None if i % 2 else "a", i, i % 5) for i in range(20)], "k string, i long, v long")


def test_null_keys_give_the_same_rows_on_both_paths(spark):
    df = _half_null(spark)
    small = scale.running_totals(df, ["k"], ["i"], {"t": "v"})
    large = scale.running_totals(df, ["k"], ["i"], {"t": "v"}, rows_per_task=3)
    assert small.count() == 20 and sorted(map(str, small.collect())) == sorted(map(str, large.collect()))
    for limit in (None, 0):
        met = scale.attach(df, df.groupBy("k").count(), "k", "inner", limit=limit)
        assert met.count() == 20 and met.where("k is null and count = 10").count() == 10
    for rows_per_task in (None, 2):
        q = {r.k: r.m for r in scale.exact_quantiles(df, ["k"], "v", {"m": 0.5}, rows_per_task).collect()}
        assert q == {None: 2.0, "a": 2.0}
    placed = scale.ordinal(df, ["k"], "i", "p", span=4).collect()
    assert sorted((r.k is None, r.p) for r in placed) == sorted((n, p) for n in (False, True) for p in range(10))


def test_series_keep_null_keys(spark):
    from crosswin.operators import series

    df = _half_null(spark).withColumn("v", F.col("v").cast("double"))
    assert series.previous(df, ["k"], "i", "v", "before", size=4).where("k is null").count() == 10
    assert series.fill_both_ways(df, ["k"], "i", ["v"], size=4).where("k is null").count() == 10


def test_metrics_keep_null_keys(spark):
    from crosswin.operators import metrics

    rows = spark.createDataFrame([(None if i % 2 else "a", i / 20, int(i > 9)) for i in range(20)], "k string, score double, y_bin int")
    assert {r.k: r.n for r in metrics.binary_metrics(rows, ["k"]).collect()} == {None: 10, "a": 10}
