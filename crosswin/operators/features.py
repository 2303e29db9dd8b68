"""Labels, feature selection and train-fitted transforms of window tables."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from crosswin.functions.expr import norm, to_double
from crosswin.operators.network import require
from crosswin.operators.scale import attach, exact_quantiles, ordinal, running_totals, settle

# fixed values
META = ("run_id", "family", "window_start_s", "window_end_s")
LABELS = ("traffic_type_win", "attack_category_win", "attack_type_win")
LEAKAGE = ("attack_flow_count", "benign_flow_count", "attack_flow_frac", "window_has_attack_flow")
NOT_FEATURES = {*META, *LABELS, *LEAKAGE, "y_bin", "y_cat", "split_name", "part"}
LOADED_META = (*META, "y_bin", "y_cat", "n_flows", "empty_window", "window_start_ts", "window_end_ts")
CONSTANT_RADIO = ("ri_mean", "ri_std", "pmi_0_mean", "pmi_0_std", "pmi_1_mean", "pmi_1_std")
MODE_PREFIXES = ("proto_mode_", "service_mode_", "conn_state_mode_", "history_mode_")
ABLATIONS = {
    "full": "full", "none": "full", "baseline": "full",
    "drop_history_onehots": "no_history", "no_history_onehots": "no_history",
    "no_mode_onehots": "no_modes", "drop_mode_onehots": "no_modes",
    "mode_onehots_only": "only_modes", "only_mode_onehots": "only_modes",
}


def derive_labels(windows: DataFrame) -> DataFrame:
    """y_bin from the majority label, y_cat from the attack category (they may disagree)."""
    return windows.withColumns({
        "y_bin": F.coalesce(norm("traffic_type_win").startswith("attack"), F.lit(False)).cast("int"),
        "y_cat": F.coalesce("attack_category_win", F.lit("Benign"))})


def drop_empty_windows(windows: DataFrame) -> DataFrame:
    return windows.where("n_flows > 0") if "n_flows" in windows.columns else windows


def feature_columns(windows: DataFrame, modality: str, min_share: float = 0.9) -> tuple[list[str], list[str]]:
    """(numeric, categorical) feature names of a window table.

    Text columns count as numeric when more than ``min_share`` of all rows read as numbers.
    """
    require(windows, ["run_id", "window_start_s", "window_end_s", "traffic_type_win", "attack_category_win"], modality)
    drop = set(NOT_FEATURES) | ({"n_flows"} if modality == "radio" else set())
    names = [f for f in windows.schema.fields if f.name not in drop]
    cats = [f.name for f in names if f.name.endswith("_mode")] if modality == "network" else []
    numeric = {f.name for f in names if isinstance(f.dataType, (T.NumericType, T.BooleanType))}
    text = [f.name for f in names if f.name not in numeric and f.name not in cats]
    if text:
        # one row with one share per text column
        share = windows.agg(*[(F.count(to_double(c)) / F.count("*")).alias(c) for c in text]).first().asDict()
        numeric |= {c for c in text if (share[c] or 0.0) > min_share}
    return [f.name for f in names if f.name in numeric and f.name not in cats], cats


def feature_ablation(
    columns: list[str], modality: str, variant: str = "full", modalities: tuple[str, ...] = ("network",),
    prefixes: tuple[str, ...] = MODE_PREFIXES,
) -> list[str]:
    """Feature names kept by an ablation variant, in the given order."""
    kind = ABLATIONS.get(variant.strip().lower())
    if kind is None:
        raise ValueError(f"unknown ablation {variant!r}; known: {sorted(ABLATIONS)}")
    if kind == "full" or modality.strip().lower() not in modalities:
        return list(columns)
    if kind == "no_history":
        return [c for c in columns if not c.startswith("history_mode_")]
    return [c for c in columns if c.startswith(tuple(prefixes)) == (kind == "only_modes")]


def drop_constant_radio(df: DataFrame) -> DataFrame:
    return df.drop(*CONSTANT_RADIO)


def load_processed(processed: DataFrame, modality: str, variant: str = "full") -> tuple[DataFrame, list[str]]:
    """Meta, labels and clean numeric features of a processed table, with the feature names.

    NaN, infinities and nulls become 0. No order is imposed; rows are matched by key.
    """
    require(processed, ["run_id", "y_bin", "y_cat", "window_start_s", "window_end_s"], "processed table")
    skip = {*LOADED_META, *CONSTANT_RADIO, "split_name", "part"}
    kept = feature_ablation([c for c in processed.columns if c not in skip], modality, variant)
    types = {f.name: f.dataType for f in processed.schema.fields}
    feats = [c for c in kept if isinstance(types[c], (T.NumericType, T.BooleanType))]
    if not feats:
        raise ValueError("no numeric features are left")
    meta = [c for c in (*LOADED_META, "split_name", "part") if c in processed.columns]
    return processed.select(
        *meta, *[F.coalesce(to_double(c), F.lit(0.0)).cast("float").alias(c) for c in feats]), feats


# ---- fitted transform --------------------------------------------------------------------


@dataclass
class Transform:
    """Statistics of the train rows: a few numbers per feature column."""

    plain: list[str]
    log: list[str]
    stats: dict[str, tuple[float, float, float]]  # median, mean, divisor
    categories: dict[str, list[str]]
    modes: dict[str, str] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        out = [*self.plain, *[f"{c}__log1p" for c in self.log]]
        out += [f"{c}_{v}" for c, vs in self.categories.items() for v in vs]
        twice = sorted({n for n in out if out.count(n) > 1})
        if twice:
            raise ValueError(f"feature names occur twice: {twice[:20]}")
        return out

    def apply(self, df: DataFrame, keep: list[str]) -> DataFrame:
        cols = []
        for c in (*self.plain, *self.log):
            median, mean, divisor = self.stats[c]
            x = impute(c, F.lit(median), c in self.log)
            cols.append(((x - mean) / divisor).alias(f"{c}__log1p" if c in self.log else c))
        for c, values in self.categories.items():
            v = F.coalesce(F.col(c), F.lit(self.modes[c]))
            cols += [(v == value).cast("double").alias(f"{c}_{value}") for value in values]
        self.names  # noqa: B018 - fails on duplicates
        return df.select(*keep, *cols)

    def to_json(self) -> str:
        return json.dumps(self.__dict__)

    @classmethod
    def from_json(cls, text: str) -> Transform:
        d = json.loads(text)
        d["stats"] = {k: tuple(v) for k, v in d["stats"].items()}
        return cls(**d)


def impute(c: str, median: Column, log: bool) -> Column:
    x = F.coalesce(to_double(c), median)
    return F.log1p(F.greatest(x, F.lit(0.0))) if log else x


def choose_log_columns(train: DataFrame, columns: list[str]) -> tuple[list[str], list[str]]:
    """(plain, log): log for columns that are never negative in train and exceed 10."""
    row = train.agg(
        *[F.min(to_double(c)).alias(f"lo_{c}") for c in columns],
        *[F.max(to_double(c)).alias(f"hi_{c}") for c in columns]).first()
    log = [c for c in columns if row[f"lo_{c}"] is not None and row[f"lo_{c}"] >= 0.0 and row[f"hi_{c}"] > 10.0]
    return [c for c in columns if c not in log], log


def column_medians(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Exact median of every column (per key) as rows (column, median)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), to_double(c).alias("v")) for c in columns]))
    long = df.select(*(keys or []), pairs.alias("_e")).select(*(keys or []), F.col("_e.c").alias("column"), "_e.v")
    return exact_quantiles(long, [*(keys or []), "column"], "v", {"median": 0.5}).drop("n_values")


def fit_transform(train: DataFrame, numeric: list[str], categorical: list[str]) -> Transform:
    """Fit on the rows of the train part only. What reaches the driver is one number set per
    feature column and the category names, which become columns themselves."""
    train = settle(train.select(*numeric, *categorical), "train")
    plain, log = choose_log_columns(train, numeric) if numeric else ([], [])
    medians = {r["column"]: r["median"] for r in column_medians(train, numeric).toLocalIterator()} if numeric else {}
    stats = {}
    if numeric:
        x = {c: impute(c, F.lit(float(medians.get(c, 0.0))), c in log) for c in numeric}
        row = train.agg(
            *[F.avg(v).alias(f"m_{c}") for c, v in x.items()],
            *[F.stddev_pop(v).alias(f"s_{c}") for c, v in x.items()]).first()
        for c in numeric:
            spread = row[f"s_{c}"] or 0.0
            stats[c] = (float(medians.get(c, 0.0)), row[f"m_{c}"] or 0.0, spread if spread > 0 else 1.0)
    categories, modes = {}, {}
    if categorical:
        pairs = F.explode(F.array(*[
            F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in categorical]))
        counts = train.select(pairs.alias("_e")).select("_e.c", "_e.v").where("v is not null").groupBy("c", "v").count()
        for r in counts.groupBy("c").agg(
            F.array_sort(F.collect_list("v")).alias("vs"),
            F.min(F.struct((-F.col("count")).alias("n"), "v"))["v"].alias("mode"),
        ).toLocalIterator():
            categories[r["c"]], modes[r["c"]] = list(r["vs"]), r["mode"]
        categories = {c: categories.get(c, []) for c in categorical}
        modes = {c: modes.get(c) for c in categorical}
    return Transform(plain, log, stats, categories, modes)


@dataclass
class SplitTransforms:
    """Fitted transforms of all splits as tables; nothing of them is on the driver.

    ``numbers``: split_name, medians, logs, means, divisors (arrays in column order), n_features.
    ``dictionary``: split_name, column, value, index of every category of the train rows.
    ``modes``: split_name, column, mode.
    """

    numeric: list[str]
    categorical: list[str]
    numbers: DataFrame
    dictionary: DataFrame
    modes: DataFrame

    def names(self) -> DataFrame:
        """(split_name, index, feature): what stands at each place of the vectors."""
        labels = F.transform(F.sequence(F.lit(1), F.lit(len(self.numeric))), lambda i: F.element_at(F.array(*[F.lit(c) for c in self.numeric]), i))
        at = F.posexplode(F.zip_with(labels, "logs", lambda c, log: F.concat(c, F.when(log, "__log1p").otherwise("")))).alias("index", "feature")
        of_categories = self.dictionary.select("split_name", "index", F.concat_ws("_", "column", "value").alias("feature"))
        if not self.numeric:
            return of_categories
        return self.numbers.select("split_name", at).select("split_name", F.col("index").cast("bigint").alias("index"), "feature").unionByName(of_categories)

    def apply(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """Rows (with split_name) as sparse vectors: ``keep``, n_features, indices, values.

        Numbers come first, then one entry for each categorical column whose value train knows.
        """
        x = attach(rows, self.numbers, "split_name", "inner", settled=True)
        values = F.array(*[to_double(c) for c in self.numeric]).cast("array<double>")
        facts = F.arrays_zip(values.alias("v"), "medians", "logs", "means", "divisors")

        def one(e: Column) -> Column:
            v = F.coalesce(e["v"], e["medians"])
            return (F.when(e["logs"], F.log1p(F.greatest(v, F.lit(0.0)))).otherwise(v) - e["means"]) / e["divisors"]

        x = x.withColumn("_values", F.transform(facts, one) if self.numeric else F.array().cast("array<double>"))
        for i, c in enumerate(self.categorical):
            mode = self.modes.where(F.col("column") == c).select("split_name", F.col("mode").alias("_mode"))
            known = self.dictionary.where(F.col("column") == c).select("split_name", F.col("value").alias("_value"), F.col("index").alias(f"_at{i}"))
            x = attach(x, mode, "split_name").withColumn("_value", F.coalesce(F.col(c).cast("string"), F.col("_mode")))
            x = attach(x, known, ["split_name", "_value"]).drop("_mode", "_value")
        at = F.array_compact(F.array(*[F.col(f"_at{i}") for i in range(len(self.categorical))])).cast("array<bigint>")
        x = x.withColumn("_at", F.array_sort(at))
        places = F.concat(F.sequence(F.lit(0), F.lit(len(self.numeric) - 1)).cast("array<bigint>") if self.numeric else F.array().cast("array<bigint>"), F.col("_at"))
        return x.select(
            *keep, "n_features", places.alias("indices"), F.concat("_values", F.transform("_at", lambda i: F.lit(1.0))).alias("values"))


def fit_all_splits(rows: DataFrame, numeric: list[str], categorical: list[str]) -> SplitTransforms:
    """Fit every split in one pass over rows tagged with (split_name, part); train rows decide.

    Ranges, medians, means and spreads are aggregates by split; categories are rows of a
    dictionary with a running number, however many there are.
    """
    train = settle(rows.where("part = 'train'").select("split_name", *numeric, *categorical), "train")
    array = lambda columns: F.array(*columns).cast("array<double>")
    splits = train.select("split_name").distinct()
    if numeric:
        spans = train.groupBy("split_name").agg(
            array([F.min(to_double(c)) for c in numeric]).alias("_lo"), array([F.max(to_double(c)) for c in numeric]).alias("_hi"))
        medians = column_medians(train, numeric, ["split_name"]).groupBy("split_name").agg(
            array([F.coalesce(F.max(F.when(F.col("column") == c, F.col("median"))), F.lit(0.0)) for c in numeric]).alias("medians"))
        logs = F.zip_with("_lo", "_hi", lambda lo, hi: F.coalesce((lo >= 0.0) & (hi > 10.0), F.lit(False))).alias("logs")
        base = settle(spans.join(medians, "split_name").select("split_name", "medians", logs), "split-medians")
        x = attach(train, base, "split_name", settled=True)
        filled = []
        for i, c in enumerate(numeric):
            v = F.coalesce(to_double(c), F.col("medians")[i])
            filled.append(F.when(F.col("logs")[i], F.log1p(F.greatest(v, F.lit(0.0)))).otherwise(v))
        spread = x.groupBy("split_name").agg(
            array([F.avg(v) for v in filled]).alias("means"),
            array([F.when(F.stddev_pop(v) > 0, F.stddev_pop(v)).otherwise(1.0) for v in filled]).alias("divisors"))
        numbers = base.join(spread, "split_name")
    else:
        none = F.array()
        numbers = splits.select("split_name", *[none.cast("array<double>").alias(c) for c in ("medians", "means", "divisors")], none.cast("array<boolean>").alias("logs"))
    pairs = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for i, c in enumerate(categorical)])
    if categorical:
        counts = train.select("split_name", F.inline(pairs)).where("value is not null").groupBy("split_name", "place", "column", "value").agg(F.count("*").alias("n"))
    else:
        counts = splits.select("split_name", F.lit(0).alias("place"), F.lit("").alias("column"), F.lit("").alias("value"), F.lit(0).cast("bigint").alias("n")).where("false")
    counts = settle(counts, "categories")
    modes = settle(counts.groupBy("split_name", "column").agg(F.min(F.struct((-F.col("n")).alias("less"), "value"))["value"].alias("mode")), "modes")
    numbered = running_totals(counts.withColumn("_one", F.lit(1).cast("bigint")), ["split_name"], ["place", "value"], {"_rank": "_one"})
    dictionary = settle(numbered.select("split_name", "column", "value", (F.col("_rank") - 1 + len(numeric)).alias("index")), "dictionary")
    sizes = dictionary.groupBy("split_name").agg(F.count("*").alias("_n"))
    numbers = settle(numbers.join(sizes, "split_name", "left").select(
        "split_name", "medians", "logs", "means", "divisors", (F.coalesce("_n", F.lit(0)) + len(numeric)).cast("bigint").alias("n_features")), "numbers")
    return SplitTransforms(numeric, categorical, numbers, dictionary, modes)


def part_summary(rows: DataFrame) -> DataFrame:
    """Rows, positive rate and number of classes per split and part."""
    keys = [c for c in ("split_name", "part") if c in rows.columns]
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("y_bin").alias("pos_rate"), F.count_distinct("y_cat").alias("n_classes"))


def causal_sequences(
    rows: DataFrame, columns: list[str], length: int, order: str = "window_start_s",
    pad_indicator: bool = True, block: int = 4096, out: str = "sequence",
) -> DataFrame:
    """Add, per window, the feature rows of the last ``length`` windows of its run.

    Runs are cut into blocks of positions; the last length - 1 rows of a block are copied to
    the next one, so the window function never holds a whole run. Missing earlier windows are
    zero rows on the left, marked by 1 in the last entry.
    """
    n = length - 1
    placed = ordinal(rows, ["run_id"], order, "_p")
    spread = placed.withColumn("_b", F.explode(F.sequence(
        F.floor(F.col("_p") / block), F.floor((F.col("_p") + n) / block))))
    item = F.array(*[F.col(c).cast("double") for c in columns], *([F.lit(0.0)] if pad_indicator else []))
    pad = F.array(*[F.lit(0.0)] * len(columns), *([F.lit(1.0)] if pad_indicator else []))
    w = Window.partitionBy("run_id", "_b").orderBy("_p").rowsBetween(-n, 0)
    got = spread.withColumn("_s", F.collect_list(item).over(w)).where(F.col("_b") == F.floor(F.col("_p") / block))
    return got.select(
        *rows.columns, F.concat(F.array_repeat(pad, F.lit(length) - F.size("_s")), F.col("_s")).alias(out))


# ---- matching the two modalities ---------------------------------------------------------

KEYS = ["run_id", "window_start_s", "window_end_s"]


def align_modalities(a: DataFrame, b: DataFrame) -> DataFrame:
    """Windows both sides have, with the features of both; labels come from the first."""
    shared = [c for c in b.columns if c in a.columns and c not in KEYS]
    return a.join(b.drop(*shared), KEYS)


def alignment_violations(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys on one side only, and keys whose labels or families differ."""
    checked = [c for c in ("y_bin", "y_cat", "family") if c in a.columns and c in b.columns]
    left = a.select(*KEYS, *[F.col(c).alias(f"a_{c}") for c in checked], F.lit(1).alias("_a"))
    right = b.select(*KEYS, *[F.col(c).alias(f"b_{c}") for c in checked], F.lit(1).alias("_b"))
    both = left.join(right, KEYS, "full")
    problems = F.array(
        F.when(F.col("_b").isNull(), "missing_right"), F.when(F.col("_a").isNull(), "missing_left"),
        *[F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull() & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")),
                 f"{c}_differs") for c in checked])
    return both.select(*KEYS, F.explode(F.array_compact(problems)).alias("problem"))


def join_meta(left: DataFrame, right: DataFrame, on: list[str], keep: list[str]) -> DataFrame:
    """Inner join on the key that keeps chosen meta columns of the left side."""
    meta = left.select(*on, *[c for c in keep if c not in on])
    return meta.join(right.drop(*[c for c in keep if c not in on]), on)


def encode_classes(train: DataFrame, label: str = "y_cat") -> DataFrame:
    """Class numbers 0..K-1 by sorted label of the train rows."""
    names = train.select(label).distinct().agg(F.array_sort(F.collect_set(label)).alias("c"))  # class names only
    return names.select(F.posexplode("c").alias("class_id", label))


def unknown_classes(rows: DataFrame, classes: DataFrame, label: str = "y_cat") -> DataFrame:
    """Labels of rows that train does not have."""
    return rows.select(label).distinct().join(classes.select(label), label, "left_anti")


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """Balanced weight per class: n / (classes * rows of the class)."""
    counts = rows.groupBy(label).agg(F.count("*").alias("rows"))
    total = counts.agg(F.sum("rows").alias("n"), F.count("*").alias("k")).first()
    return counts.withColumn("weight", F.lit(total["n"] / total["k"]) / F.col("rows"))


def with_weights(rows: DataFrame, label: str, out: str = "weight") -> DataFrame:
    return attach(rows, class_weights(rows, label).select(label, F.col("weight").alias(out)), label)
