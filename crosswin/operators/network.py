"""Flow records to labelled sliding windows.

The window grid starts at the first flow of a run and holds full windows only. Flows are
first folded into panes of gcd(W, S) seconds, the largest unit of which every window is an
exact union, and panes are then fanned out to the windows they belong to. Each flow is thus
read and hashed once, however much the windows overlap, and the fan-out works on pane rows.
Pane rows meet in chunks of windows of a run and are fanned out there, so that no row is
shuffled once per window. Measures and values of a window come from the same split of the chunks,
so that they meet without another shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from crosswin.functions.expr import is_attack, to_double
from crosswin.operators.scale import ROWS_PER_TASK, attach, first_per_key, grid, settle

# fixed values: the flow columns that are aggregated
NUMERIC = (
    "duration", "src_bytes", "dst_bytes", "src_pkts", "dst_pkts",
    "src_ip_bytes", "dst_ip_bytes", "missed_bytes", "http_trans_depth", "files_total_bytes",
)
CATEGORICAL = ("proto", "service", "conn_state", "history")
ADDRESSES = ("src_ip", "dst_ip")
PORTS = ("src_port", "dst_port")
FLAGS = ("is_GET_mthd", "http_status_error", "is_file_transfered")
ATTACK_LABELS = ("attack_category", "attack_type")
INDEX_COLUMNS = (
    "run_id", "family", "window_start_s", "window_end_s", "n_flows", "empty_window",
    "attack_flow_count", "benign_flow_count", "attack_flow_frac", "window_has_attack_flow",
    "traffic_type_win", "attack_category_win", "attack_type_win",
)
KEY = ["run_id", "window_start_s"]
CHUNK = ["run_id", "_c"]
CHUNK_WINDOWS = 64
MEETING = ["run_id", "_chunk_window_start_s"]  # a chunk by its first window
MEETING_ROWS = 200_000  # chunk rows of a task, before they are fanned out


def require(df: DataFrame, columns: list[str], what: str) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks columns: {missing}")


def attach_family(flows: DataFrame, runs: DataFrame) -> DataFrame:
    """Add ``family`` from the run table; flows of unknown runs are left out (see
    ``runs_without_family`` for the check)."""
    facts = runs.select("run_id", "family").dropDuplicates(["run_id"])
    return attach(flows, facts, "run_id", "inner")


def runs_without_family(flows: DataFrame, runs: DataFrame) -> DataFrame:
    """Run ids that appear in flows but not in the run table."""
    return flows.select("run_id").distinct().join(runs.select("run_id"), "run_id", "left_anti")


def relative_time(flows: DataFrame) -> DataFrame:
    """Add ``t_rel_s``, seconds since the first flow of the run.

    Rows whose start time is no number make the job fail, with a clear message.
    """
    require(flows, ["run_id", "flow_start_ts"], "flows")
    ts = to_double("flow_start_ts")
    timed = flows.withColumn(
        "flow_start_ts",
        F.when(ts.isNull(), F.raise_error(F.lit("flow_start_ts is not a number"))).otherwise(ts),
    )
    start = timed.groupBy("run_id").agg(F.min("flow_start_ts").alias("_t0"))
    return attach(timed, start, "run_id").withColumn("t_rel_s", F.col("flow_start_ts") - F.col("_t0")).drop("_t0")


def span_aggs(flows: DataFrame) -> list[Column]:
    """family, n_flows_total, run_end_s and t_first_attack_flow_s of a group of flows."""
    end = F.col("t_rel_s")
    if "flow_duration" in flows.columns:
        end = end + F.greatest(F.coalesce(to_double("flow_duration"), F.lit(0.0)), F.lit(0.0))
    return [
        F.min("family").alias("family"),
        F.count("*").alias("n_flows_total"),
        F.max(end).alias("run_end_s"),
        F.min(F.when(is_attack(flows, "traffic_type"), F.col("t_rel_s"))).alias("t_first_attack_flow_s"),
    ]


def run_spans(flows: DataFrame, W: int, S: int) -> DataFrame:
    """Per run: flow count, run end, last window start (-1 without windows), first attack."""
    return last_starts(flows.groupBy("run_id").agg(*span_aggs(flows)), W, S)


def spans_of_panes(panes: DataFrame, W: int, S: int) -> DataFrame:
    """The same facts of the runs from the state of their panes."""
    facts = [F.sum("n_flows_total").alias("n_flows_total"), F.max("run_end_s").alias("run_end_s"),
             F.min("t_first_attack_flow_s").alias("t_first_attack_flow_s")]
    # numbers first, so that only a row per run and family is sorted for the smallest text
    return last_starts(panes.groupBy("run_id", "family").agg(*facts).groupBy("run_id").agg(
        F.min("family").alias("family"), *facts), W, S)


def last_starts(spans: DataFrame, W: int, S: int) -> DataFrame:
    last = F.floor((F.col("run_end_s") - W) / S) * S
    return spans.withColumn(
        "last_start_s", F.when((F.col("run_end_s") > 0) & (last >= 0), last).otherwise(-1).cast("bigint")
    )


def window_grid(spans: DataFrame, W: int, S: int) -> DataFrame:
    """All windows of all runs."""
    return grid(spans.select("run_id", "family", "last_start_s"), "last_start_s", "window_start_s", S).select(
        "run_id", "family", "window_start_s", (F.col("window_start_s") + W).alias("window_end_s")
    )


def pane_seconds(W: int, S: int) -> int:
    return math.gcd(W, S)


def chunk_windows(W: int, S: int) -> int:
    """Windows of a chunk; so many that most panes belong to one chunk only."""
    return max(CHUNK_WINDOWS, 4 * -(-W // S))


def panes_to_chunks(panes: DataFrame, W: int, S: int, pane: str = "pane") -> DataFrame:
    """Pane rows in the chunks of windows that contain the pane, with the first and last such
    window of the chunk."""
    g, size = pane_seconds(W, S), chunk_windows(W, S)
    lo = F.greatest(F.ceil((F.col(pane) * g + g - W) / S), F.lit(0).cast("bigint"))
    hi = F.floor(F.col(pane) * g / S)
    out = panes.where(hi >= lo).withColumns({"_lo": lo, "_hi": hi}).drop(pane)  # S > W leaves gaps between windows
    out = out.withColumn("_c", F.explode(F.sequence(F.floor(F.col("_lo") / size), F.floor(F.col("_hi") / size))))
    return out.withColumns({
        "_lo": F.greatest(F.col("_lo"), F.col("_c") * size), "_hi": F.least(F.col("_hi"), F.col("_c") * size + size - 1)})


def grid_to_chunks(spans: DataFrame, W: int, S: int) -> DataFrame:
    """One row per run and chunk of its grid, with the first and last window of the chunk."""
    size = chunk_windows(W, S)
    tops = spans.where("last_start_s >= 0").select("run_id", F.floor(F.col("last_start_s") / S).alias("_top"))
    chunks = grid(tops.withColumn("_last", F.floor(F.col("_top") / size)), "_last", "_c")
    return chunks.select(
        *CHUNK, (F.col("_c") * size).alias("_lo"), F.least(F.col("_c") * size + size - 1, F.col("_top")).alias("_hi"))


def meeting_tasks(rows: int, spark) -> int:
    """Tasks over which ``rows`` chunk rows are spread; their number grows with the rows, since a
    fan-out makes a task's work far larger than what it reads."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // MEETING_ROWS))


def meet(chunks: DataFrame, W: int, S: int, tasks: int) -> DataFrame:
    """The rows of every chunk in one task. Tables that meet over the same tasks stay side by side."""
    first = F.col("_c") * (chunk_windows(W, S) * S)
    return chunks.withColumn(MEETING[1], first).drop("_c").repartition(tasks, *MEETING)


def chunks_to_windows(chunks: DataFrame, S: int, meet: bool = True) -> DataFrame:
    """Rows of chunks fanned out to windows. The rows of a chunk meet before, so that grouping by
    chunk, window and more needs no further shuffle."""
    rows = chunks.repartition(*CHUNK) if meet else chunks
    start = F.sequence(F.col("_lo") * S, F.col("_hi") * S, F.lit(S).cast("bigint"))
    return rows.withColumn("window_start_s", F.explode(start)).drop("_lo", "_hi")


def flows_to_windows(flows: DataFrame, spans: DataFrame, W: int, S: int) -> DataFrame:
    """Row-level interval join: one row per (flow, window of the run's grid that contains it)."""
    lo = F.greatest(F.floor((F.col("t_rel_s") - W) / S) + 1, F.lit(0).cast("bigint"))
    hi = F.floor(F.col("t_rel_s") / S)
    first = F.greatest(lo - 1, F.lit(0).cast("bigint")) * S
    start = F.explode(F.filter(
        F.sequence(first, (hi + 1) * S, F.lit(S).cast("bigint")),
        lambda w0: (w0 <= F.col("t_rel_s")) & (F.col("t_rel_s") < w0 + W),
    ))
    out = flows.withColumn("window_start_s", start).withColumn("window_end_s", F.col("window_start_s") + W)
    known = attach(out, spans.select("run_id", F.col("last_start_s").alias("_last")), "run_id", "inner")
    return known.where(F.col("window_start_s") <= F.col("_last")).drop("_last")


# ---- mergeable moments -------------------------------------------------------------------


def moment_aggs(columns: dict[str, Column]) -> list[Column]:
    """Per-pane state of each column: count, sum, square sum, smallest, largest.

    The square sum is made of the centred one here, once per pane and not once per window.
    """
    out = []
    for name, x in columns.items():
        out += [
            F.count(x).alias(f"{name}__n"),
            F.sum(x).alias(f"{name}__s"),
            (F.var_pop(x) * F.count(x) + F.try_divide(F.sum(x) * F.sum(x), F.count(x).cast("double"))).alias(f"{name}__q"),
            F.min(x).alias(f"{name}__lo"),
            F.max(x).alias(f"{name}__hi"),
        ]
    return out


def moment_merge(names: list[str]) -> list[Column]:
    """Merge pane states."""
    out = []
    for name in names:
        out += [
            F.sum(f"{name}__n").alias(f"{name}__n"),
            F.sum(f"{name}__s").alias(f"{name}__s"),
            F.sum(f"{name}__q").alias(f"{name}__q"),
            F.min(f"{name}__lo").alias(f"{name}__lo"),
            F.max(f"{name}__hi").alias(f"{name}__hi"),
        ]
    return out


def moment_mean(name: str) -> Column:
    return F.try_divide(F.col(f"{name}__s"), F.col(f"{name}__n"))


def moment_std(name: str) -> Column:
    """Population standard deviation; exactly 0 for equal values, null for none."""
    n, s = F.col(f"{name}__n"), F.col(f"{name}__s")
    square = F.col(f"{name}__q") - F.try_divide(s * s, n)
    spread = F.sqrt(F.greatest(F.try_divide(square, n), F.lit(0.0)))
    return F.when(F.col(f"{name}__lo") == F.col(f"{name}__hi"), 0.0).when(n > 0, spread)


# ---- the two aggregates ------------------------------------------------------------------


def pane_measures(flows: DataFrame, W: int, S: int) -> DataFrame:
    """State of every pane: facts of the run's span, label counts, moments and flag sums."""
    nums = {c: to_double(c) for c in NUMERIC if c in flows.columns}
    flags = {c: F.coalesce(to_double(c), F.lit(0.0)) for c in FLAGS if c in flows.columns}
    g = pane_seconds(W, S)
    # the family, one per run, is a key: a text among the states would make every pane be sorted
    return flows.groupBy("run_id", "family", F.floor(F.col("t_rel_s") / g).alias("pane")).agg(
        *span_aggs(flows)[1:],
        F.count(F.when(is_attack(flows, "traffic_type"), 1)).alias("attack_flow_count"),
        *moment_aggs(nums),
        *[F.sum(x).alias(f"{c}_sum") for c, x in flags.items()],
    )


def measure_rows(panes: DataFrame, spans: DataFrame, W: int, S: int) -> DataFrame:
    """Chunk rows of the pane states and of the grid.

    A chunk holds at most its windows and the panes they cover, whatever the flows.
    """
    rows = panes_to_chunks(panes.drop("family", "run_end_s", "t_first_attack_flow_s"), W, S)
    slots = grid_to_chunks(spans, W, S).withColumn("_slot", F.lit(1))
    return rows.unionByName(slots, allowMissingColumns=True)


def window_measures(rows: DataFrame, key: list[str]) -> DataFrame:
    """Counts, label counts, numeric statistics and flag sums of the windows of the grid, from rows
    fanned out to windows; ``_slots`` is 0 outside of the grid."""
    nums = [c for c in NUMERIC if f"{c}__n" in rows.columns]
    flags = [c for c in FLAGS if f"{c}_sum" in rows.columns]
    return rows.groupBy(*key, "window_start_s").agg(
        F.count("_slot").alias("_slots"),
        F.sum("n_flows_total").alias("n_flows"),
        F.sum("attack_flow_count").alias("attack_flow_count"),
        *moment_merge(nums),
        *[F.sum(f"{c}_sum").alias(f"{c}_sum") for c in flags],
    )


def sort_position(time: str, order: str) -> Column:
    """(time, input order) packed into one number, so first-seen stays a hash aggregate.

    Times are compared at 2^-32 of a unit, finer than epoch seconds in a double can express.
    """
    ticks = F.floor(F.col(time) * float(2**32)).cast("decimal(19,0)")
    return (ticks * F.lit("1" + "0" * 19).cast("decimal(20,0)") + F.col(order).cast("decimal(19,0)")).cast("decimal(38,0)")


def modal(flows: DataFrame) -> list[str]:
    """Label-like columns of which a window shows the most frequent value."""
    return [c for c in (*CATEGORICAL, *ATTACK_LABELS) if c in flows.columns]


def pane_values(flows: DataFrame, W: int, S: int) -> DataFrame:
    """Counts of every distinct value of the label-like columns per pane (long form)."""
    entries = []
    for c in (*CATEGORICAL, *ADDRESSES, *ATTACK_LABELS):
        if c in flows.columns:
            entries.append(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")))
    for c in PORTS:
        if c in flows.columns:
            port = to_double(c).cast("bigint")
            entries.append(F.struct(
                F.lit(c).alias("field"), F.when(port >= 0, port.cast("string")).alias("value")))
    g = pane_seconds(W, S)
    return (
        flows.select(
            "run_id", F.floor(F.col("t_rel_s") / g).alias("pane"),
            (sort_position("t_rel_s", "ord") if modal(flows) else F.lit(None).cast("decimal(38,0)")).alias("seen"),
            is_attack(flows, "traffic_type").alias("_attack"),
            F.explode(F.filter(F.array(*entries), lambda e: e["value"].isNotNull())).alias("_e"),
        )
        .groupBy("run_id", "pane", F.col("_e.field").alias("field"), F.col("_e.value").alias("value"))
        .agg(
            F.count("*").alias("n"),
            F.count(F.when(F.col("_attack"), 1)).alias("n_attack"),
            F.min("seen").alias("seen"),
        )
    )


def value_rows(flows: DataFrame, W: int, S: int, fields: list[str]) -> tuple[DataFrame, DataFrame, int]:
    """(chunk rows of the values of the fields, chunks with very many of them, pane values).

    Every value carries where it appears first in the run, by time and then input order.
    """
    panes = settle(pane_values(flows, W, S), "pane-values")
    modes = modal(flows)
    ranked = panes.drop("seen").withColumn("first_seen", F.lit(None).cast("decimal(38,0)"))
    if modes:
        key, has_mode = ["run_id", "field", "value"], F.col("field").isin(*modes)
        first = settle(panes.where(has_mode).groupBy(*key).agg(
            F.min("seen").alias("first_seen"), F.count("*").alias("_rows")), "first-seen")
        most = first.agg(F.max("_rows").alias("n")).first()["n"] or 0
        placed = attach(panes.where(has_mode).drop("seen"), first.drop("_rows"), key, settled=True, most=most)
        ranked = placed.unionByName(ranked.where(~has_mode)) if len(modes) < len(fields) else placed
        ranked = ranked.where(~F.col("field").isin(*ATTACK_LABELS) | (F.col("n_attack") > 0))
    heavy = settle(panes_to_chunks(panes.select("run_id", "pane"), W, S).groupBy(*CHUNK).agg(
        F.count("*").alias("n")).where(F.col("n") > ROWS_PER_TASK).select(*CHUNK), "heavy-chunks")
    return panes_to_chunks(ranked, W, S), heavy, panes.count()


def values_of_windows(rows: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Per window: most frequent value or distinct values of the fields, over attack flows for
    attack labels.

    Equal counts go to the value that appears first in the run.
    """
    counts = rows.groupBy(*key, "window_start_s", "field", "value").agg(
        F.sum("n").alias("n"), F.sum("n_attack").alias("n_attack"), F.min("first_seen").alias("first_seen"))
    picks = []
    for f in fields:
        here = F.col("field") == f
        size = "n_attack" if f in ATTACK_LABELS else "n"
        if f in CATEGORICAL or f in ATTACK_LABELS:
            best = F.max(F.when(here, F.struct(F.col(size).alias("n"), (-F.col("first_seen")).alias("p"), F.col("value"))))["value"]
            picks.append(best.alias(f"{f}_mode" if f in CATEGORICAL else f"{f}_win"))
        if f not in ATTACK_LABELS:
            picks.append(F.count(F.when(here, 1)).alias(f"{f}_n_unique" if f in CATEGORICAL else f"n_unique_{f}"))
    return counts.groupBy(*key, "window_start_s").agg(*picks)


def side_by_side(measures: DataFrame, values: DataFrame) -> DataFrame:
    """Measures and values of windows whose chunks met over the same tasks, without a shuffle."""
    both = measures.unionByName(values, allowMissingColumns=True)
    names = [c for c in both.columns if c not in (*MEETING, "window_start_s")]
    return both.groupBy(*MEETING, "window_start_s").agg(*[F.max(c).alias(c) for c in names])


def network_windows(
    flows: DataFrame,
    W: int,
    S: int,
    majority_threshold: float = 0.5,
    keep_empty_windows: bool = True,
) -> DataFrame:
    """All window features and labels of flows that carry ``t_rel_s``, ``ord`` and ``family``."""
    require(flows, ["run_id", "family", "t_rel_s", "traffic_type"], "flows")
    panes = settle(pane_measures(flows, W, S), "panes")  # the first of two reads of the flows
    spans = settle(spans_of_panes(panes, W, S), "spans")
    nums = [c for c in NUMERIC if c in flows.columns]
    flags = [c for c in FLAGS if c in flows.columns]
    fields = [c for c in (*CATEGORICAL, *ADDRESSES, *PORTS, *ATTACK_LABELS) if c in flows.columns]
    rows, size, heavy = measure_rows(panes, spans, W, S), panes.count(), None
    if fields:
        values, chunks, n = value_rows(flows, W, S, fields)
        size, heavy = size + n, None if chunks.isEmpty() else chunks
    tasks = meeting_tasks(size, flows.sparkSession)

    def part(rows: DataFrame, values: DataFrame | None) -> DataFrame:
        out = window_measures(chunks_to_windows(meet(rows, W, S, tasks), S, meet=False), MEETING)
        if values is None:
            return out
        return side_by_side(out, values_of_windows(chunks_to_windows(meet(values, W, S, tasks), S, meet=False), MEETING, fields))

    if heavy is None:
        out = part(rows, values if fields else None).drop(MEETING[1])
    else:
        out = part(*[attach(r, heavy, CHUNK, "left_anti", settled=True) for r in (rows, values)]).drop(MEETING[1])
        # chunks with very many values never meet in a task: their groups are shuffled one by one
        a, z = (chunks_to_windows(attach(r, heavy, CHUNK, "left_semi", settled=True), S, meet=False) for r in (rows, values))
        rest = window_measures(a, CHUNK).hint("merge").join(values_of_windows(z, CHUNK, fields), [*CHUNK, "window_start_s"], "left")
        out = out.unionByName(rest.drop("_c"))
    out = out.where("_slots > 0" if keep_empty_windows else "_slots > 0 AND n_flows > 0")
    out = attach(out, spans.select("run_id", "family"), "run_id", settled=True).withColumn(
        "window_end_s", F.col("window_start_s") + W).drop("_slots")
    return finish_windows(out, W, majority_threshold, nums, flags, fields)


def finish_windows(
    joined: DataFrame, W: int, majority_threshold: float, nums: list[str], flags: list[str], fields: list[str]
) -> DataFrame:
    """Labels, rates and zero fill on top of the joined window aggregates."""
    zero = F.lit(0).cast("bigint")
    n = F.coalesce(F.col("n_flows"), zero)
    attacks = F.coalesce(F.col("attack_flow_count"), zero)
    frac = F.coalesce(F.try_divide(attacks.cast("double"), n.cast("double")), F.lit(0.0))
    total = {c: F.coalesce(F.col(f"{c}__s"), F.lit(0.0)) for c in nums}
    cols: list[Column] = [
        F.col("run_id"), F.col("family"), F.col("window_start_s"), F.col("window_end_s"),
        n.alias("n_flows"),
        (n == 0).cast("int").alias("empty_window"),
        attacks.alias("attack_flow_count"),
        (n - attacks).alias("benign_flow_count"),
        frac.alias("attack_flow_frac"),
        (attacks > 0).cast("int").alias("window_has_attack_flow"),
        F.when((n > 0) & (frac >= majority_threshold), "Attack").otherwise("Benign").alias("traffic_type_win"),
    ]
    for c in ATTACK_LABELS:
        label = F.col(f"{c}_win") if c in fields else F.lit(None).cast("string")
        cols.append(label.alias(f"{c}_win"))
    for c in nums:
        cols += [total[c].alias(f"{c}_sum"), moment_mean(c).alias(f"{c}_mean"), moment_std(c).alias(f"{c}_std")]
    if {"src_bytes", "dst_bytes"} <= set(nums):
        both = total["src_bytes"] + total["dst_bytes"]
        cols += [both.alias("total_bytes_sum"), (both / W).alias("bytes_per_s")]
    if {"src_pkts", "dst_pkts"} <= set(nums):
        both = total["src_pkts"] + total["dst_pkts"]
        cols += [both.alias("total_pkts_sum"), (both / W).alias("pkts_per_s")]
    cols.append((n / W).alias("flows_per_s"))
    for c in fields:
        if c in CATEGORICAL:
            cols += [F.col(f"{c}_mode"), F.coalesce(F.col(f"{c}_n_unique"), zero).alias(f"{c}_n_unique")]
        elif c not in ATTACK_LABELS:
            cols.append(F.coalesce(F.col(f"n_unique_{c}"), zero).alias(f"n_unique_{c}"))
    for c in flags:
        cols += [
            F.coalesce(F.col(f"{c}_sum"), F.lit(0.0)).alias(f"{c}_sum"),
            F.try_divide(F.col(f"{c}_sum"), n.cast("double")).alias(f"{c}_mean"),
        ]
    return joined.select(*cols)


def window_index(windows: DataFrame) -> DataFrame:
    """Key, label and count columns only."""
    return windows.select(*INDEX_COLUMNS)


def index_windows(flows: DataFrame, W: int, S: int, majority_threshold: float = 0.5, keep_empty_windows: bool = True) -> DataFrame:
    """The index alone: of the flows' columns only those it is made of are read."""
    used = ("run_id", "ord", "family", "t_rel_s", "flow_duration", "traffic_type", *ATTACK_LABELS)
    return window_index(network_windows(
        flows.select(*[c for c in used if c in flows.columns]), W, S, majority_threshold, keep_empty_windows))


def run_summary(flows: DataFrame, W: int, S: int, keep_empty_windows: bool = True) -> DataFrame:
    """One row per run; runs without windows have neither occupancy nor onset."""
    spans = settle(run_spans(flows, W, S), "spans")
    g = pane_seconds(W, S)
    panes = flows.select("run_id", F.floor(F.col("t_rel_s") / g).alias("pane")).distinct()
    busy = chunks_to_windows(panes_to_chunks(panes, W, S), S).distinct()
    occupied = (
        attach(busy, spans.select("run_id", "last_start_s"), "run_id", "inner", settled=True)
        .where(F.col("window_start_s") <= F.col("last_start_s"))
        .groupBy("run_id")
        .agg(F.count("*").alias("_busy"))
    )
    slots = F.when(F.col("last_start_s") >= 0, F.floor(F.col("last_start_s") / S) + 1).otherwise(0)
    busy = F.coalesce(F.col("_busy"), F.lit(0).cast("bigint"))
    n = (slots if keep_empty_windows else busy).cast("bigint")
    has = slots > 0
    share = F.try_divide(busy.cast("double"), n.cast("double"))
    return spans.hint("merge").join(occupied, "run_id", "left").select(
        "run_id", "family", "n_flows_total", "run_end_s",
        n.alias("n_windows"),
        F.when(has, share).alias("window_occupancy"),
        F.when(has, F.col("t_first_attack_flow_s")).alias("t_first_attack_flow_s"),
    )


def run_summary_all(summaries: DataFrame) -> DataFrame:
    """Per run, the row of the window setting (W, S) with the most windows."""
    ranked = summaries.withColumn("_neg", -F.col("n_windows"))
    return first_per_key(ranked, ["run_id"], ["_neg", "W", "S"]).drop("_neg")
