"""Telemetry records to per-second series and to radio features of the network windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from crosswin.functions.expr import divide, to_double
from crosswin.operators.network import (
    CHUNK, KEY, chunks_to_windows, moment_aggs, moment_mean, moment_merge, moment_std, pane_seconds, panes_to_chunks, require,
)
from crosswin.operators.scale import attach, ordinal, settle
from crosswin.operators.series import densify, fill_both_ways, previous

COUNTERS = ("dlBytes", "ulBytes")
NOT_KPI = {"run_id", "family", "ord", "ts_raw", "t_rel_s", "ue_id", "rnti", "cellid", "in_sync", "pmi", *COUNTERS}
SECOND_KPIS = ("row_count", "ue_count", "rate_total", "reset_indicator")
MILLIS = 10**11  # epochs above this are milliseconds


def detect_time_mode(records: DataFrame) -> DataFrame:
    """Per run: ``timestamp`` if any record has a usable time, else ``implicit``; first time."""
    family = [F.min("family").alias("family")] if "family" in records.columns else []
    return records.groupBy("run_id").agg(
        F.when(F.count("ts_raw") > 0, "timestamp").otherwise("implicit").alias("time_mode"),
        F.min("ts_raw").alias("ts0"),
        F.count("*").alias("n_raw_rows"),
        *family,
    )


def to_seconds_index(records: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Add ``t_rel_s`` and ``time_mode``.

    Timed runs: seconds since the earliest time, milliseconds recognised by size, records
    without a time dropped. Untimed runs: one record per second, in line order.
    """
    require(records, ["run_id", "ord", "ts_raw", *COUNTERS], "telemetry")
    facts = settle(detect_time_mode(records), "time-mode") if facts is None else facts
    facts = facts.select("run_id", "time_mode", "ts0")
    timed = attach(records.where(F.col("ts_raw").isNotNull()), facts, "run_id", "inner", settled=True)
    since = F.col("ts_raw") - F.col("ts0")
    seconds = F.when(F.col("ts0") > MILLIS, F.floor(since / 1000)).otherwise(since)
    timed = timed.withColumn("t_rel_s", F.greatest(seconds, F.lit(0)).cast("bigint")).drop("ts0")
    untimed = attach(records, facts.where("time_mode = 'implicit'").drop("ts0"), "run_id", "inner", settled=True)
    return timed.unionByName(ordinal(untimed, ["run_id"], "ord", "t_rel_s"))


def kpi_columns_per_run(records: DataFrame, min_share: float = 0.2) -> DataFrame:
    """(run_id, kpi, share, kept): the share of a run's records in which a column reads as a number.

    A run keeps the KPIs whose column is numeric, or text with at least ``min_share`` numbers.
    """
    types = dict(records.dtypes)
    names = [c for c in records.columns if c not in NOT_KPI and c not in ("time_mode", "run_id")]
    share = F.array(*[F.struct(
        F.lit(c).alias("kpi"), (F.count(to_double(c)) / F.count("*")).alias("share"), F.lit(types[c] != "string").alias("number")) for c in names])
    per_run = records.groupBy("run_id").agg(share.alias("_k")).select("run_id", F.explode("_k").alias("_k")).select("run_id", "_k.*")
    return per_run.select("run_id", "kpi", "share", (F.col("number") | (F.col("share") >= min_share)).alias("kept"))


def only_kept_kpis(records: DataFrame, chosen: DataFrame, kpis: list[str]) -> DataFrame:
    """Records in which a run's values of KPIs it does not keep are null."""
    flags = chosen.groupBy("run_id").agg(*[F.max(F.when(F.col("kpi") == c, F.col("kept"))).alias(f"_keep_{c}") for c in kpis])
    out = attach(records, flags, "run_id")
    return out.withColumns({c: F.when(F.col(f"_keep_{c}"), F.col(c)) for c in kpis}).drop(*[f"_keep_{c}" for c in kpis])


def aggregate_seconds(timed: DataFrame, kpis: list[str]) -> DataFrame:
    """One row per (run, second): counter sums (0 when all are missing), KPI medians, counts."""
    ues = F.count_distinct("ue_id") if "ue_id" in timed.columns else F.lit(0).cast("bigint")
    return timed.groupBy("run_id", "t_rel_s").agg(
        *[F.coalesce(F.sum(to_double(c)), F.lit(0.0)).alias(c) for c in COUNTERS],
        *[F.percentile(to_double(c), F.lit(0.5)).alias(c) for c in kpis],
        F.count("*").alias("row_count"),
        ues.alias("ue_count"),
    )


def radio_seconds(records: DataFrame, kpis: list[str] | None = None) -> DataFrame:
    """Dense per-second table of every run, with filled counters, rates and resets."""
    if kpis is None:  # each run's own choice; a KPI that no run keeps has no column
        chosen = settle(kpi_columns_per_run(records), "kpis")
        kpis = sorted(r["kpi"] for r in chosen.where("kept").select("kpi").distinct().collect())  # names of columns
        records = only_kept_kpis(records, chosen, kpis)
    facts = settle(detect_time_mode(records), "time-mode")
    timed = to_seconds_index(records.select(
        "run_id", "ord", "ts_raw", *COUNTERS, *kpis, *[c for c in ("ue_id",) if c in records.columns]), facts)
    seconds = settle(aggregate_seconds(timed, kpis), "seconds")
    dense = settle(densify(seconds, ["run_id"], "t_rel_s"), "dense")  # read twice below
    filled = fill_both_ways(dense, ["run_id"], "t_rel_s", list(COUNTERS))
    total = sum((F.col(f"{c}_filled") for c in COUNTERS[1:]), F.col(f"{COUNTERS[0]}_filled"))
    before = sum((F.col(f"{c}_before") for c in COUNTERS[1:]), F.col(f"{COUNTERS[0]}_before"))
    zero = F.lit(0).cast("bigint")
    delta = total - before
    return attach(filled, facts.select("run_id", "family", "time_mode"), "run_id", settled=True).select(
        "run_id", "family", "time_mode", "t_rel_s", *COUNTERS, *kpis,
        F.coalesce("row_count", zero).alias("row_count"),
        F.coalesce("ue_count", zero).alias("ue_count"),
        F.col("row_count").isNotNull().alias("sec_has_record"),
        F.col("row_count").isNull().cast("int").alias("sec_missing"),
        total.alias("totalBytes_counter_filled"),
        F.greatest(delta, F.lit(0.0)).alias("rate_total"),
        (delta < 0).cast("int").alias("reset_indicator"),
        delta.alias("reset_delta_raw"),
    )


def reported_seconds(records: DataFrame, kpis: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of ``radio_seconds`` that have a record, and per run its number of seconds (settled).

    A second without a record has no KPIs, and 0 rows, devices, bytes per second and resets, since its
    counters are carried: what a window makes of it follows from its number alone.
    """
    timed = to_seconds_index(records.select(
        "run_id", "ord", "ts_raw", *COUNTERS, *kpis, *[c for c in ("ue_id",) if c in records.columns]))
    total = sum((F.col(c) for c in COUNTERS[1:]), F.col(COUNTERS[0]))
    seconds = settle(aggregate_seconds(timed, kpis).withColumn("_total", total), "seconds")
    delta = F.col("_total") - F.coalesce("_before", "_total")
    reported = previous(seconds, ["run_id"], "t_rel_s", "_total", "_before").select(
        "run_id", "t_rel_s", *kpis, "row_count", "ue_count", F.lit(True).alias("sec_has_record"),
        F.greatest(delta, F.lit(0.0)).alias("rate_total"), (delta < 0).cast("int").alias("reset_indicator"))
    return reported, settle(seconds.groupBy("run_id").agg((F.max("t_rel_s") + 1).alias("n_seconds")), "lengths")


def radio_windows(
    seconds: DataFrame, index: DataFrame, W: int, S: int, kpis: list[str], lengths: DataFrame | None = None,
) -> DataFrame:
    """Radio features of the windows in ``index``; labels are carried over from it.

    ``seconds`` are all seconds, or with ``lengths`` (settled: run_id, n_seconds) those with a record.
    Seconds beyond the end of the telemetry count as missing. A run without telemetry keeps
    its index row with ``radio_window_missing`` = 1 and no other radio value.
    """
    require(index, [*KEY, "window_end_s", "traffic_type_win", "attack_category_win", "attack_type_win"], "index")
    names = [*kpis, *SECOND_KPIS]
    panes = seconds.groupBy("run_id", F.floor(F.col("t_rel_s") / pane_seconds(W, S)).alias("pane")).agg(
        F.count(F.when(F.col("sec_has_record"), 1)).alias("present"),
        *moment_aggs({c: F.col(c).cast("double") for c in names}),
    )
    panes = settle(panes, "radio-panes")  # read twice below
    merged = chunks_to_windows(panes_to_chunks(panes, W, S), S).groupBy(*CHUNK, "window_start_s").agg(
        F.sum("present").alias("present"), *moment_merge(names))
    beyond = F.col("n_seconds") - F.col("window_start_s")  # null for a run without telemetry
    here = F.when(beyond >= W, F.lit(W).cast("bigint")).when(beyond > 0, beyond).when(beyond <= 0, 0)
    if lengths is not None:  # the seconds without a record join the moments as zeros
        merged = attach(merged, lengths, "run_id", settled=True)
        some = F.col("present") < here
        merged = merged.withColumns(
            {f"{c}__lo": F.when(some, F.least(f"{c}__lo", F.lit(0.0))).otherwise(F.col(f"{c}__lo")) for c in SECOND_KPIS}
            | {f"{c}__hi": F.when(some, F.greatest(f"{c}__hi", F.lit(0.0))).otherwise(F.col(f"{c}__hi")) for c in SECOND_KPIS}
            | {f"{c}__n": here for c in SECOND_KPIS})
    # only results go on to the join, not the states they are made of
    stats = merged.select(
        *KEY, "present", *[f"{c}__s" for c in SECOND_KPIS],
        *[moment_mean(c).alias(f"{c}_mean") for c in names], *[moment_std(c).alias(f"{c}_std") for c in names])
    known = panes.select("run_id").distinct() if lengths is None else lengths
    known = known.withColumn("_known", F.lit(True))
    labels = [c for c in ("traffic_type_win", "attack_category_win", "attack_type_win", "n_flows", "attack_flow_frac")
              if c in index.columns]
    j = attach(index.select("run_id", "family", "window_start_s", "window_end_s", *labels), known, "run_id")
    j = j.hint("merge").join(stats, KEY, "left")
    zero = F.lit(0).cast("bigint")
    has_run = F.col("_known").isNotNull()
    present = F.coalesce("present", zero)
    missing = W - present

    def total(c: str):
        return F.when(has_run, F.coalesce(F.col(f"{c}__s"), F.lit(0.0)))

    def value(name: str, c: str):
        if lengths is None or c not in SECOND_KPIS:
            return F.col(name)
        return F.coalesce(name, F.when(here > 0, 0.0)).alias(name)  # only seconds without a record

    return j.select(
        "run_id", "family", "window_start_s", "window_end_s", *labels,
        F.when(has_run, present).alias("radio_present_seconds"),
        F.when(has_run, missing).alias("radio_missing_seconds"),
        F.when(has_run, divide(missing, F.lit(W))).alias("radio_missing_frac"),
        F.when(has_run & (present > 0), 0).otherwise(1).alias("radio_window_missing"),
        total("rate_total").alias("rate_total_sum"),
        total("reset_indicator").cast("bigint").alias("reset_count"),
        total("row_count").cast("bigint").alias("row_count_sum"),
        total("ue_count").cast("bigint").alias("ue_count_sum"),
        *[value(f"{c}_mean", c) for c in names],
        *[value(f"{c}_std", c) for c in names],
    )


def radio_run_summary(seconds: DataFrame, records: DataFrame) -> DataFrame:
    """One row per run: raw rows, seconds, missing share, shared seconds, resets."""
    raw = records.groupBy("run_id").agg(F.count("*").alias("n_raw_rows"))
    return seconds.groupBy("run_id").agg(
        F.min("family").alias("family"),
        F.min("time_mode").alias("time_mode"),
        F.count("*").alias("n_seconds"),
        F.avg("sec_missing").alias("sec_missing_frac"),
        F.max(F.col("row_count") > 1).alias("multi_rows_same_second"),
        F.sum("reset_indicator").alias("resets_count"),
    ).join(raw, "run_id")


def radio_window_summary(windows: DataFrame, W: int, S: int) -> DataFrame:
    """One row: windows, share without telemetry, median share of missing seconds."""
    # the missing share takes at most W + 1 values, so the median's value map stays tiny
    return windows.agg(
        F.lit(W).alias("W"), F.lit(S).alias("S"),
        F.count("*").alias("n_windows"),
        F.avg("radio_window_missing").alias("radio_window_missing_rate"),
        F.percentile("radio_missing_frac", F.lit(0.5)).alias("radio_missing_frac_median"),
    )
