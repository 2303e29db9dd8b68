"""Checks as queries: each returns the rows that break a rule. ``enforce`` raises on any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from crosswin.functions.expr import col, finite
from crosswin.operators.features import KEYS, LEAKAGE

TTD_COLUMNS = ("ttd_median", "ttd_p25", "ttd_p75")
DELTA_COLUMNS = ("delta_median", "delta_p25", "delta_p75")
DELTA_MODE = "delta_window_minus_flow"
SUM_TOL, FRAC_TOL, RATE_TOL = 1e-4, 1e-9, 1e-9  # fixed values
WINDOW_LABELS = ("traffic_type_win", "attack_category_win", "attack_type_win")
WINDOW_COLUMNS = (*KEYS, *WINDOW_LABELS, "radio_present_seconds", "radio_missing_seconds", "radio_missing_frac", "radio_window_missing")


def enforce(violations: DataFrame, what: str) -> None:
    rows = violations.limit(5).collect()  # five examples for the message
    if rows:
        raise ValueError(f"{what}: {[r.asDict() for r in rows]}")


def broken_rules(rows: DataFrame, keep: list[str], rules: dict[str, Column]) -> DataFrame:
    """(kept columns, rule) for every rule that is not true on a row."""
    found = F.array_compact(F.array(*[
        F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select(*keep, F.explode(found).alias("rule"))


def _is(df: DataFrame, c: str, *types: type) -> bool:
    return isinstance(df.schema[c].dataType, types)


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if _is(df, c, T.NumericType)]


def missing_columns(df: DataFrame, required: list[str], forbidden: list[str] | None = None) -> list[str]:
    return [f"missing {c}" for c in required if c not in df.columns] + [
        f"forbidden {c}" for c in (forbidden or []) if c in df.columns]


def window_violations(index: DataFrame, network: DataFrame, radio: DataFrame, W: int) -> DataFrame:
    """Key sets, labels and radio counters of the three window tables: (keys, check, rule)."""
    labels = WINDOW_LABELS

    def sides(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        left = a.select(*KEYS, F.lit(1).alias("_a"), *[F.col(c).alias(f"a_{c}") for c in labels])
        right = b.select(*KEYS, F.lit(1).alias("_b"), *[F.col(c).alias(f"b_{c}") for c in labels])
        j = left.join(right, KEYS, "full")
        both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
        rules = {"key_on_both_sides": both}
        rules |= {f"{c}_equal": ~both | F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in labels}
        return broken_rules(j, KEYS, rules).withColumn("check", F.lit(name))

    present, missing = F.col("radio_present_seconds"), F.col("radio_missing_seconds")
    has = present.isNotNull()
    counters = {
        "missing_in_range": ~has | missing.between(0, W),
        "present_in_range": ~has | present.between(0, W),
        "fraction_fits": ~has | (F.abs(F.col("radio_missing_frac") - missing / W) <= FRAC_TOL),
        "flag_is_0_or_1": F.col("radio_window_missing").isin(0, 1),
        "flag_means_none_present": (F.col("radio_window_missing") != 1) | ~has | (present == 0),
    }
    return sides(index, network, "index_network").unionByName(sides(index, radio, "index_radio")).unionByName(
        broken_rules(radio, KEYS, counters).withColumn("check", F.lit("radio")))


def second_violations(seconds: DataFrame) -> DataFrame:
    rules = {
        "rate_not_negative": F.col("rate_total") >= -RATE_TOL,
        "time_not_negative": F.col("t_rel_s") >= 0,
        "missing_is_0_or_1": F.col("sec_missing").isin(0, 1),
        "reset_is_0_or_1": F.col("reset_indicator").isin(0, 1),
        "missing_fits_record": (F.col("sec_missing") == 1) != F.col("sec_has_record"),
    }
    return broken_rules(seconds, ["run_id", "t_rel_s"], rules)


def run_count_violations(table: DataFrame, expected: int) -> DataFrame:
    """The number of runs when it is not the expected one."""
    return table.agg(F.count_distinct("run_id").alias("runs")).where(F.col("runs") != expected)


def processed_violations(processed: DataFrame, features: list[str]) -> DataFrame:
    """Labels and feature values of a processed table: (keys, rule)."""
    absent = missing_columns(processed, [*KEYS, "y_bin", "y_cat", *features], list(LEAKAGE))
    if absent:
        raise ValueError(f"processed table: {absent}")
    rules = {"y_bin_is_0_or_1": F.col("y_bin").isin(0, 1), "y_cat_not_empty": F.trim("y_cat") != ""}
    rules |= {f"{c}_finite": finite(c) for c in features}
    return broken_rules(processed, KEYS, rules)


def feature_list_violations(parts: dict[str, DataFrame], skip: list[str]) -> DataFrame:
    """(part, feature, rule): how the columns of each part differ from those of the first one.

    ``missing`` and ``extra`` name single features; ``order`` names the first one out of place
    where the sets are equal. Schemas only, no rows are read.
    """
    lists = {name: [c for c in df.columns if c not in skip] for name, df in parts.items()}
    (_, wanted), *others = lists.items()
    found = []
    for name, have in others:
        found += [(name, c, "missing") for c in wanted if c not in have] + [(name, c, "extra") for c in have if c not in wanted]
        if sorted(have) == sorted(wanted) and have != wanted:
            found.append((name, next(w for w, h in zip(wanted, have) if w != h), "order"))
    spark = next(iter(parts.values())).sparkSession
    return spark.createDataFrame(found, "part string, feature string, rule string")


def forbidden_columns(table: DataFrame, word: str) -> DataFrame:
    """(column, n): columns with ``word`` as a whole part of their name, and the table's rows."""
    named = [c for c in table.columns if word in c.lower().split("_")]
    return table.groupBy().agg(F.count("*").alias("n")).where("n > 0").select(
        F.explode(F.array(*[F.lit(c) for c in named]).cast("array<string>")).alias("column"), "n")


def content_digests(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Per key and column: rows, sum and xor of value hashes (column, n, hash_sum, hash_xor).

    The digest does not depend on the rows' order or layout, digests of two disjoint tables add up
    to that of their union, and equal rows count as often as they occur.
    """
    def one(c: str) -> Column:
        text = F.concat(F.lit(f"{c}="), F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("null")))
        return F.struct(F.lit(c).alias("column"), F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint").alias("h"))

    return rows.select(*keys, F.inline(F.array(*[one(c) for c in columns]))).groupBy(*keys, "column").agg(
        F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("hash_sum"), F.bit_xor("h").alias("hash_xor"))


def digest_differences(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """(column, keys) whose digests differ or that only one side has."""
    on = ["column", *keys]
    facts = lambda df, side: df.select(*on, F.struct("n", "hash_sum", "hash_xor").alias(side))
    return facts(stored, "a").join(facts(fresh, "b"), on, "full").where(~F.col("a").eqNullSafe(F.col("b"))).select(*on)


def not_finite_counts(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per numeric column: values that are null, NaN or infinite; only columns that have some."""
    columns = columns or numeric_columns(rows)
    one = rows.agg(*[F.count(F.when(~finite(c), 1)).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("bad")) for c in columns])
    return one.select(F.explode(pairs).alias("_e")).select("_e.column", "_e.bad").where("bad > 0")


def first_not_finite(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per column, the smallest key whose value is not finite."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), finite(c).alias("ok")) for c in columns]))
    return rows.select(key, pairs.alias("_e")).where(~F.col("_e.ok")).groupBy(F.col("_e.column").alias("column")).agg(
        F.min(key).alias("first_bad"), F.count("*").alias("bad"))


def ttd_summary_violations(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rules of the time-to-detect summary: where infinities and nulls may be."""
    def inf(c: str) -> Column:
        return F.coalesce(F.abs(F.col(c)) == float("inf"), F.lit(False))

    def empty(c: str) -> Column:
        return F.col(c).isNull() | F.isnan(F.col(c).cast("double"))

    def every(parts: list[Column]) -> Column:
        out = F.lit(True)
        for p in parts:
            out = out & p
        return out

    is_delta = F.col("ttd_mode") == DELTA_MODE
    any_inf = inf(TTD_COLUMNS[0]) | inf(TTD_COLUMNS[1]) | inf(TTD_COLUMNS[2])
    others = [c for c in numeric_columns(rows) if c not in TTD_COLUMNS and c not in keys]
    no_delta = empty("n_delta") | (F.col("n_delta") == 0)
    blank = every([empty(c) for c in DELTA_COLUMNS])
    rules = {
        "inf_only_in_ttd": every([~inf(c) for c in others]),
        "inf_only_without_detection": ~any_inf | (F.col("detect_rate") == 0),
        "delta_rows_hold_delta_only": ~is_delta | every([empty(c) for c in ("n_attack_runs", "detect_rate", *TTD_COLUMNS)]),
        "ttd_rows_complete": is_delta | ~(empty("n_attack_runs") | empty("detect_rate")),
        "ttd_finite_when_detected": is_delta | F.coalesce(F.col("detect_rate") == 0, F.lit(True)) | every([finite(c) for c in TTD_COLUMNS]),
        "no_delta_means_blank": ~no_delta | blank,
        "delta_finite": no_delta | every([finite(c) for c in DELTA_COLUMNS]),
    }
    return broken_rules(rows, keys, rules)


def binary_prediction_violations(rows: DataFrame, keys: list[str], tol: float = 1e-6) -> DataFrame:
    return broken_rules(rows, keys, {
        "y_true_is_0_or_1": F.col("y_true").isin(0, 1),
        "score_in_unit_interval": finite("score") & F.col("score").between(-tol, 1.0 + tol)})


def multiclass_prediction_violations(rows: DataFrame, keys: list[str], proba: list[str], tol: float = 1e-6) -> DataFrame:
    total = sum((F.col(c).cast("double") for c in proba[1:]), F.col(proba[0]).cast("double"))
    return broken_rules(rows, keys, {
        "labels_present": F.col("y_true").isNotNull() & F.col("y_pred").isNotNull(),
        "p_max_in_unit_interval": finite("p_max") & F.col("p_max").between(-tol, 1.0 + tol),
        "rows_sum_to_one": F.abs(total - 1.0) <= SUM_TOL,
        "p_max_is_largest": F.abs(F.col("p_max") - F.greatest(*[F.col(c) for c in proba])) <= SUM_TOL})


def table_diff(a: DataFrame, b: DataFrame, key: list[str], tol: float = 1e-6) -> DataFrame:
    """Per column: rows that differ, and the largest numeric difference; keys must match.

    Two missing values are equal; one missing value is a difference. Keys on one side only
    are counted under the column name ``<key>``.
    """
    cols = [c for c in a.columns if c not in key and c in b.columns]
    left = a.select(*key, F.lit(1).alias("_a"), *[F.col(c).alias(f"a_{c}") for c in cols])
    right = b.select(*key, F.lit(1).alias("_b"), *[F.col(c).alias(f"b_{c}") for c in cols])
    j = left.join(right, key, "full")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    aggs = [F.count(F.when(~both, 1)).alias("n__key"), F.lit(None).cast("double").alias("d__key")]
    for c in cols:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        if _is(a, c, T.NumericType):
            gap = F.abs(x.cast("double") - y.cast("double"))
            same = F.coalesce(gap <= tol, x.isNull() & y.isNull())
            aggs += [F.count(F.when(both & ~same, 1)).alias(f"n_{c}"), F.max(F.when(both, gap)).alias(f"d_{c}")]
        else:
            aggs += [F.count(F.when(both & ~x.eqNullSafe(y), 1)).alias(f"n_{c}"), F.lit(None).cast("double").alias(f"d_{c}")]
    one = j.agg(*aggs)
    entries = [F.struct(F.lit(name).alias("column"), F.col(f"n_{c}").alias("different"), F.col(f"d_{c}").alias("max_diff"))
               for name, c in [("<key>", "_key"), *[(c, c) for c in cols]]]
    return one.select(F.explode(F.array(*entries)).alias("_e")).select("_e.column", "_e.different", "_e.max_diff")


def set_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one listing that the other lacks."""
    only = F.lit("only_left")
    return a.subtract(b).withColumn("side", only).unionByName(b.subtract(a).withColumn("side", F.lit("only_right")))


def expected_value_violations(values: DataFrame, expected: DataFrame, key: list[str], tol: float) -> DataFrame:
    """Expected numbers that are absent or off by at least the tolerance."""
    j = expected.select(*key, F.col("value").alias("expected")).join(values.select(*key, "value"), key, "left")
    gap = F.abs(col("value") - col("expected"))
    return j.where(F.col("value").isNull() | (gap >= tol))


def run_errors(manifest: DataFrame, flows: DataFrame, records: DataFrame) -> DataFrame:
    """Manifest runs that cannot be processed, with the reason; the others are unaffected."""
    runs = manifest.select("run_id", "family")
    no_flows = runs.join(flows.select("run_id").distinct(), "run_id", "left_anti")
    no_records = runs.join(records.select("run_id").distinct(), "run_id", "left_anti")
    return no_flows.withColumn("message", F.lit("no flows")).unionByName(
        no_records.withColumn("message", F.lit("no telemetry records")))
