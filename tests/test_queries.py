"""Registered queries against their SQL oracles on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import compare

DIR = "/root/testdata/sf0.001"
# one or two queries per area; tests/compare.py runs them all
NAMES = (
    "window_label_counts", "window_modes", "run_summary", "radio_seconds", "pair_groups", "align_runs", "split_stratified",
    "numeric_transform", "binary_metrics", "summarize_ttd", "top_confusions", "table_diff",
)


def test_registry_is_sound():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 120


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, duck, name):
    state, note, _, _ = compare(spark, duck, name, entry.queries()[name], entry.oracle_sql()[name], DIR)
    assert state == "ok", note


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_moved_keys_meet_no_other_key(spark, duck, tmp_path):
    """table_diff over more than a million part keys."""
    spark.read.parquet(f"{DIR}/part.parquet").limit(100).selectExpr(
        "explode(array(p_partkey, p_partkey + 1000000)) as p_partkey", "* except (p_partkey)").write.parquet(str(tmp_path / "part.parquet"))
    con = duck.cursor()
    con.execute(f"CREATE TEMP VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    state, note, _, _ = compare(spark, con, "table_diff", entry.queries()["table_diff"], entry.oracle_sql()["table_diff"], str(tmp_path))
    assert state == "ok", note
