"""Run-level splits and folds. A run is never divided.

Shuffles are seeded by md5(run | seed), so every engine gives the same order. Rankings over
runs use the prefix-sum helper. Folds are packed from the histogram of run sizes. The stratified
split is sequential by definition, since each choice depends on the budgets left: it reads the
runs it is open for as a sorted stream and keeps only two counts in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from crosswin.functions.expr import norm, order_hash
from crosswin.operators.scale import attach, running_totals, settle

PARTS = ("train", "val", "test")
BENIGN = "Benign"  # fixed value


def is_benign(c: str = "family", name: str = BENIGN) -> Column:
    return norm(c) == name.strip().lower()


def family_allocation(n: Column, val_frac: float, test_frac: float) -> tuple[Column, Column, Column]:
    """Run counts (train, val, test) for a family of n runs.

    Rounds half to even; at least one run per part from four runs on. When val and test leave
    no run for train, the larger of them gives way, test first when they are equal.
    """
    t = F.greatest(F.bround(n * F.lit(test_frac)), F.lit(1)).cast("bigint")
    v = F.greatest(F.bround(n * F.lit(val_frac)), F.lit(1)).cast("bigint")
    over = F.greatest(t + v - (n - 1), F.lit(0))
    gap = F.abs(t - v)
    # steps the larger one takes alone, then both in turn
    alone = F.least(over, F.when(t >= v, gap + 1).otherwise(gap))
    rest = over - alone
    more, less = F.ceil(rest / 2), F.floor(rest / 2)
    t2 = F.when(t >= v, t - alone - less).otherwise(t - more)
    v2 = F.when(t >= v, v - more).otherwise(v - alone - less)
    small = n < 4
    train = F.when(small, F.greatest(n - 2, F.lit(1))).otherwise(n - t2 - v2)
    val = F.when(small, (n >= 2).cast("bigint")).otherwise(v2)
    test = F.when(small, (n >= 3).cast("bigint")).otherwise(t2)
    return train.cast("bigint"), val.cast("bigint"), test.cast("bigint")


def shuffled(runs: DataFrame, part: list[str], seeds: list[int]) -> DataFrame:
    """Runs repeated per seed, with ``pos``, their 0-based place in the seeded order."""
    each = runs.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    each = each.withColumns({"_h": order_hash("run_id", F.col("seed")), "_one": F.lit(1).cast("bigint")})
    ranked = running_totals(each, ["seed", *part], ["_h", "run_id"], {"_rank": "_one"})
    return ranked.withColumn("pos", F.col("_rank") - 1).drop("_h", "_one", "_rank")


def split_name(seed: Column) -> Column:
    return F.concat(F.lit("stratified_seed"), seed.cast("string"))


def split_by_counts(runs: DataFrame, seeds: list[int], val_frac: float = 0.15, test_frac: float = 0.15) -> DataFrame:
    """Stratified split by run counts: (split_name, seed, run_id, family, part)."""
    ranked = settle(shuffled(runs.select("run_id", "family"), ["family"], seeds), "shuffled")
    sizes = ranked.groupBy("seed", "family").agg(F.count("*").alias("n"))
    train, val, _ = family_allocation(F.col("n"), val_frac, test_frac)
    part = F.when(F.col("pos") < train, "train").when(F.col("pos") < train + val, "val").otherwise("test")
    return attach(ranked, sizes, ["seed", "family"]).select(
        split_name(F.col("seed")).alias("split_name"), "seed", "run_id", "family", part.alias("part"))


def _pack_parts(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Give each run of one family, in order, to the part furthest below its budget."""
    val = test = 0
    last = -1
    for pdf in batches:
        out = []
        for pos, n, vb, tb in zip(pdf["pos"], pdf["rows"], pdf["val_budget"], pdf["test_budget"]):
            if pos <= last:
                raise ValueError("runs must arrive in shuffled order")
            last = pos
            need_val, need_test = vb - val, tb - test
            if pos < 3:
                part = PARTS[pos]
            elif need_val <= 0 and need_test <= 0:
                part = "train"
            else:
                part = "val" if need_val >= need_test else "test"
            val += n if part == "val" else 0
            test += n if part == "test" else 0
            out.append(part)
        yield pdf[["seed", "run_id", "family"]].assign(part=out)


def split_stratified(
    runs: DataFrame, seeds: list[int], val_frac: float = 0.15, test_frac: float = 0.15
) -> DataFrame:
    """Row-aware stratified split of runs (run_id, family, rows), for all seeds at once.

    Families below four runs are split by counts. In larger ones the first three shuffled
    runs seed the parts and the others go where the row budget is least filled, until both
    budgets are full and train takes the rest. A part never exceeds its budget by more than
    one run, so runs beyond budgets + two largest runs are train for certain and stay out of
    the sequential pass.
    """
    ranked = settle(shuffled(runs.select("run_id", "family", "rows"), ["family"], seeds), "shuffled")
    ranked = running_totals(ranked, ["seed", "family"], ["pos"], {"rows_so_far": "rows"})
    ranked = settle(ranked, "ranked")
    sizes = ranked.groupBy("seed", "family").agg(
        F.count("*").alias("n"), F.sum("rows").alias("_total"), F.max("rows").alias("_largest"))
    sized = attach(ranked, sizes, ["seed", "family"]).withColumns({
        "val_budget": F.col("_total") * F.lit(val_frac), "test_budget": F.col("_total") * F.lit(test_frac)})
    train, val, _ = family_allocation(F.col("n"), val_frac, test_frac)
    counted = F.when(F.col("pos") < train, "train").when(F.col("pos") < train + val, "val").otherwise("test")
    certain = (F.col("pos") >= 3) & (
        F.col("rows_so_far") - F.col("rows") > F.col("val_budget") + F.col("test_budget") + 3 * F.col("_largest"))
    keep = ["seed", "run_id", "family"]
    small = sized.where("n < 4").select(*keep, counted.alias("part"))
    rest = sized.where((F.col("n") >= 4) & certain).select(*keep, F.lit("train").alias("part"))
    open_runs = (
        sized.where((F.col("n") >= 4) & ~certain)
        .select(*keep, "pos", "rows", "val_budget", "test_budget")
        .repartition("seed", "family")
        .sortWithinPartitions("seed", "family", "pos")
    )
    packed = open_runs.groupBy("seed", "family").applyInPandas(
        _pack_parts, "seed int, run_id string, family string, part string")
    return small.unionByName(rest).unionByName(packed).select(
        split_name(F.col("seed")).alias("split_name"), *keep, "part")


def run_starts(runs: DataFrame, flows: DataFrame) -> DataFrame:
    """Runs with the time of their first flow (null when a run has none)."""
    return runs.join(flows.groupBy("run_id").agg(F.min("flow_start_ts").alias("run_start_ts")), "run_id", "left")


def missing_starts(started: DataFrame) -> DataFrame:
    return started.where(F.col("run_start_ts").isNull()).select("run_id")


def split_time_ordered(started: DataFrame, seed: int, val_frac: float = 0.15, test_frac: float = 0.15) -> DataFrame:
    """Split runs by start time so that part sizes come closest to their targets while every
    part holds benign and attack runs.

    With the first boundary i fixed, the size error is convex in the second one, so the best j
    is the target clamped to the feasible range. That leaves one candidate per i instead of
    one per (i, j), and the next benign and attack run after i come from joins on counts.
    """
    tagged = started.select("run_id", "family", "run_start_ts", is_benign().cast("bigint").alias("b")).withColumns({
        "_h": order_hash("run_id", seed), "a": 1 - F.col("b"), "_one": F.lit(1).cast("bigint")})
    ranked = running_totals(
        tagged, [], ["run_start_ts", "_h", "run_id"], {"_rank": "_one", "_nb": "b", "_na": "a"})
    ranked = settle(ranked.select(
        "run_id", "family", "b", "a", (F.col("_rank") - 1).alias("i"),
        (F.col("_nb") - F.col("b")).alias("b_before"), (F.col("_na") - F.col("a")).alias("a_before")), "time-ranked")
    ends = ranked.agg(
        F.count("*").alias("n"), F.max(F.when(F.col("b") == 1, F.col("i"))).alias("lb"),
        F.max(F.when(F.col("a") == 1, F.col("i"))).alias("la")).first()
    if ends["lb"] is None or ends["la"] is None:
        raise ValueError("a time-ordered split needs benign and attack runs")
    n, j_max = ends["n"], min(ends["lb"], ends["la"])
    test, val = max(1, round(n * test_frac)), max(1, round(n * val_frac))
    train = max(1, n - val - test)
    # the benign run that follows b_before others is the next one at or after i
    next_b = ranked.where("b = 1").select(F.col("b_before"), F.col("i").alias("next_b"))
    next_a = ranked.where("a = 1").select(F.col("a_before"), F.col("i").alias("next_a"))
    cuts = ranked.where("i >= 1 and b_before > 0 and a_before > 0").select("i", "b_before", "a_before")
    cuts = cuts.join(next_b, "b_before").join(next_a, "a_before")
    lo = F.greatest("next_b", "next_a") + 1
    j = F.least(F.greatest(F.least(F.col("i") + val, F.lit(n - test)), lo), F.lit(j_max))
    error = F.abs(F.col("i") - train) + F.abs(j - F.col("i") - val) + F.abs(F.lit(n) - j - test)
    best = cuts.where(lo <= j_max).agg(F.min(F.struct(error.alias("e"), F.col("i"), j.alias("j"))).alias("m")).first()["m"]
    if best is None:
        raise ValueError("no time-ordered split gives every part benign and attack runs")
    part = F.when(F.col("i") < best["i"], "train").when(F.col("i") < best["j"], "val").otherwise("test")
    return ranked.select(
        F.lit("time_ordered").alias("split_name"), F.lit(seed).alias("seed"), "run_id", "family", part.alias("part"))


def split_membership(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Rows with the split and part of their run, for all splits in one pass."""
    return attach(rows, splits.select("run_id", "split_name", "part"), "run_id", "inner")


def part_family_counts(splits: DataFrame) -> DataFrame:
    return splits.groupBy("split_name", "part", "family").agg(F.count("*").alias("n"))


# ---- checks ------------------------------------------------------------------------------


def split_overlaps(splits: DataFrame) -> DataFrame:
    """Runs that sit in more than one part of a split."""
    return splits.groupBy("split_name", "run_id").agg(F.count_distinct("part").alias("parts")).where("parts > 1")


def split_coverage(splits: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs a split misses, and runs it has that do not exist.

    Every run is copied once per split name, which is the size of a complete split table.
    """
    names = splits.agg(F.array_sort(F.collect_set("split_name")).alias("names")).first()["names"]  # a few names
    wanted = runs.select("run_id").distinct().withColumn("split_name", F.explode(F.array(*[F.lit(n) for n in names])))
    have = splits.select("split_name", "run_id").distinct()
    missing = wanted.select("split_name", "run_id").join(have, ["split_name", "run_id"], "left_anti")
    extra = have.join(runs.select("run_id"), "run_id", "left_anti").select("split_name", "run_id")
    return missing.withColumn("problem", F.lit("missing")).unionByName(extra.withColumn("problem", F.lit("extra")))


def split_class_presence(splits: DataFrame) -> DataFrame:
    """Per split and part: does it hold benign runs, attack runs, both?"""
    g = splits.groupBy("split_name", "part").agg(
        F.max(is_benign()).alias("has_benign"), F.max(~is_benign()).alias("has_attack"))
    return g.withColumn("ok", F.col("has_benign") & F.col("has_attack"))


def family_gaps(splits: DataFrame) -> DataFrame:
    """(split_name, family, part) of parts that lack a family of the split."""
    have = splits.groupBy("split_name", "family").agg(F.collect_set("part").alias("_have"))  # three parts at most
    every = F.array(*[F.lit(p) for p in PARTS])
    return have.select("split_name", "family", F.explode(F.array_except(every, F.col("_have"))).alias("part"))


# ---- folds -------------------------------------------------------------------------------


def run_labels(rows: DataFrame, benign: str = BENIGN) -> DataFrame:
    """Per run: rows and binary label, from the family or else from the mean of y_bin."""
    if "family" in rows.columns:
        label = (~(norm(F.min("family")) == benign.strip().lower())).cast("int")
    else:
        label = (F.avg("y_bin") >= 0.5).cast("int")
    return rows.groupBy("run_id").agg(F.count("*").alias("rows"), label.alias("label"))


def run_mode(rows: DataFrame, column: str) -> DataFrame:
    """Per run: rows and most frequent value of a column, the smaller value on ties."""
    counts = rows.where(F.col(column).isNotNull()).groupBy("run_id", column).agg(F.count("*").alias("c"))
    # max over (count, inverted order) would need a string inverse; min over (-count, value) does it
    return counts.groupBy("run_id").agg(
        F.sum("c").alias("rows"), F.min(F.struct((-F.col("c")).alias("c"), F.col(column).alias("v")))["v"].alias(column))


def fold_count(labelled: DataFrame, label: str, n_splits: int) -> int:
    """Folds the smallest class allows; fails below two classes or two folds."""
    low = labelled.groupBy(label).agg(F.count("*").alias("n")).agg(
        F.count("*").alias("k"), F.min("n").alias("m")).first()
    if low["k"] < 2:
        raise ValueError("the training runs hold one class only")
    k = min(n_splits, low["m"])
    if k < 2:
        raise ValueError(f"too few runs for folds: the smallest class has {low['m']}")
    return k


def dealt(loads: np.ndarray, size: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fold, level) of the place-th (from 0) of equal runs dealt to the least loaded fold.

    Row i has the folds' loads before its group, the size of the group's runs, and a place in it.
    Fold f takes runs when its load is loads[f], loads[f] + size, ...; the choices are these levels
    merged in order, the lower fold first on ties. So the place is found by a search for its level.
    """
    def below(level: np.ndarray) -> np.ndarray:
        return np.maximum(0, -(-(level[:, None] - loads) // size[:, None]))

    low = loads.min(axis=1)
    high = low + (place + 1) * size  # the least loaded fold alone has more than ``place`` levels below
    while (open_ := high - low > 1).any():
        middle = (low + high) // 2
        enough = below(middle).sum(axis=1) <= place
        low = np.where(open_ & enough, middle, low)
        high = np.where(open_ & ~enough, middle, high)
    at_level = (low[:, None] >= loads) & ((low[:, None] - loads) % size[:, None] == 0)
    nth = place - below(low).sum(axis=1)
    fold = np.argmax(np.cumsum(at_level, axis=1) > nth[:, None], axis=1)
    return fold, low


def loads_after(loads: np.ndarray, size: int, count: int) -> np.ndarray:
    """Loads once ``count`` runs of one size were dealt."""
    fold, level = dealt(loads[None, :], np.array([size]), np.array([count - 1]))
    upto = np.arange(len(loads)) <= fold[0]
    given = np.maximum(0, -(-(level[0] - loads) // size)) + ((level[0] >= loads) & ((level[0] - loads) % size == 0) & upto)
    return loads + given * size


def run_folds_binary(rows: DataFrame, n_splits: int, seed: int, benign: str = BENIGN) -> DataFrame:
    """Row-balanced folds of runs: (run_id, label, rows, fold).

    Each class is dealt largest run first, equal ones in seeded order, to the fold with the fewest
    rows so far. What a run gets depends only on the runs' sizes and its place among equals: the
    histogram of sizes is walked once with k loads per class, and every run's fold follows in closed
    form. The histogram has as many rows as there are different sizes; no task holds a class.
    """
    labelled = settle(run_labels(rows, benign), "run-labels")
    k = fold_count(labelled, "label", n_splits)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: dict[int, np.ndarray] = {}
        for pdf in batches:
            before = []
            for label, size, n in zip(pdf["label"], pdf["rows"], pdf["n"]):
                loads = now.setdefault(label, np.zeros(k, np.int64))
                before.append(loads.tolist())
                now[label] = loads_after(loads, int(size), int(n))
            yield pdf[["label", "rows"]].assign(loads=before)

    sizes = labelled.groupBy("label", "rows").agg(F.count("*").alias("n"))
    sizes = sizes.repartition("label").sortWithinPartitions("label", F.col("rows").desc())
    states = sizes.mapInPandas(walk, "label int, rows bigint, loads array<bigint>")
    each = labelled.withColumns({"_h": order_hash("run_id", seed), "_one": F.lit(1).cast("bigint")})
    ranked = running_totals(each, ["label", "rows"], ["_h", "run_id"], {"_rank": "_one"})

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                fold, _ = dealt(np.stack(pdf["loads"].to_list()).astype(np.int64), pdf["rows"].to_numpy(), pdf["_rank"].to_numpy() - 1)
                yield pdf[["run_id", "label", "rows"]].assign(fold=fold.astype(np.int32))

    placed = attach(ranked.select("run_id", "label", "rows", "_rank"), states, ["label", "rows"], "inner")
    return placed.mapInPandas(place, "run_id string, label int, rows bigint, fold int")


def run_folds_multiclass(rows: DataFrame, n_splits: int, seed: int) -> DataFrame:
    """Stratified folds of runs by their most frequent class."""
    labelled = settle(run_mode(rows, "y_cat"), "run-classes")
    k = fold_count(labelled, "y_cat", n_splits)
    ranked = shuffled(labelled, ["y_cat"], [seed])
    return ranked.select("run_id", "y_cat", "rows", (F.col("pos") % k).cast("int").alias("fold"))


def fold_rows(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows with the fold that holds them out."""
    return attach(rows, folds.select("run_id", "fold"), "run_id", "inner")


def group_strata(rows: DataFrame, benign: str = BENIGN) -> DataFrame:
    """Rows with ``stratum``: 0 for benign runs, 1 for others."""
    if "family" in rows.columns:
        return rows.withColumn("stratum", (~is_benign("family", benign)).cast("int"))
    mean = rows.groupBy("run_id").agg((F.avg("y_bin") >= 0.5).cast("int").alias("stratum"))
    return attach(rows, mean, "run_id")


def group_holdout(rows: DataFrame, val_frac: float, seed: int) -> DataFrame:
    """Per run: ``train`` or ``val``, held out per stratum; a stratum of one run stays in train.

    The stratum of a run is its most frequent ``stratum`` value.
    """
    runs = settle(run_mode(rows, "stratum").select("run_id", "stratum"), "strata")
    ranked = settle(shuffled(runs, ["stratum"], [seed]), "holdout")
    sizes = ranked.groupBy("stratum").agg(F.count("*").alias("n"))
    n_val = F.least(F.greatest(F.bround(F.col("n") * F.lit(val_frac)), F.lit(1)), F.col("n") - 1)
    is_val = (F.col("n") > 1) & (F.col("pos") < n_val)
    if not 0.0 < val_frac < 1.0:
        is_val = F.lit(False)
    return attach(ranked, sizes, "stratum").select(
        "run_id", "stratum", F.when(is_val, "val").otherwise("train").alias("part"))
