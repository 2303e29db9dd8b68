"""Building blocks that keep hot groups out of single tasks.

* ``settle``           cuts lineage by writing a table to the shared folder
* ``attach``           joins per-key facts to a big table: broadcast behind a measured size,
                       salted beyond it
* ``running_totals``   ordered prefix sums, by range chunks once the input is large
* ``exact_quantiles``  exact interpolated quantiles from a value histogram
* ``ordinal``          0-based row position per key, in bounded blocks
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

BROADCAST_BYTES = 64 * 1024 * 1024
ROWS_PER_TASK = 1_000_000
SALTS = 32
_PRIVATE: dict[str, str] = {}  # application id to the folder of a local session without a shared one


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach; a private one only for a local session without any."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        app = spark.sparkContext.applicationId
        folder = _PRIVATE.setdefault(app, "") or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        _PRIVATE[app] = folder
    return os.path.join(folder, f"crosswin-{spark.sparkContext.applicationId}")


def settle(df: DataFrame, label: str = "table") -> DataFrame:
    """Write df once to the shared folder and read it back.

    The written files survive lost executors and carry real sizes for later join planning.
    """
    path = os.path.join(shared_folder(df.sparkSession), f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_width(schema: T.StructType) -> Column:
    """Upper estimate of a row's bytes in memory."""
    fixed, variable = 16, []
    for field in schema.fields:
        kind = field.dataType
        fixed += 16
        if isinstance(kind, (T.StringType, T.BinaryType)):
            variable.append(F.coalesce(F.octet_length(field.name), F.lit(0)))
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.NumericType, T.BooleanType)):
            variable.append(F.coalesce(F.size(field.name), F.lit(0)) * 16)
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            variable.append(F.coalesce(F.octet_length(F.to_json(F.struct(field.name))), F.lit(0)) * 4)
        else:
            fixed -= 8
    return sum(variable, F.lit(fixed)).cast("bigint")


def measured(df: DataFrame) -> tuple[int, int]:
    """(rows, upper estimate of bytes in memory) of a settled table, asked for once per DataFrame.

    An Observation on the write would spare this job, but a session that has used one can no longer
    ship MLlib's logistic models to tasks.
    """
    known = df.__dict__.get("_measured")
    if known is None:
        row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row_width(df.schema)), F.lit(0)).alias("b")).first()
        known = df._measured = row["n"], row["b"]
    return known


def table_bytes(df: DataFrame) -> int:
    return measured(df)[1]


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join by key columns of the same names, in which null keys meet null keys."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # a group of everything: one row
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    joined = left.join(renamed, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_r_{k}" for k in keys])


def attach(
    big: DataFrame,
    facts: DataFrame,
    on: list[str] | str,
    how: str = "left",
    settled: bool = False,
    limit: int | None = None,
    most: int | None = None,
) -> DataFrame:
    """Join per-key facts (one row per key) to a table whose keys may be badly skewed.

    Rows with a null key meet the facts of the null key, on every path.

    The facts are written once and measured. Below the limit they are broadcast, so the big
    side is not shuffled at all. Beyond it every fact row is copied to SALTS sub-keys and the
    big side is spread over them, so that no sub-key holds more than a sliver of a hot key.
    ``most``, the rows of the largest key where known, spares copies that no key needs.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if not settled:
        facts = settle(facts, "facts")
    if table_bytes(facts) <= (BROADCAST_BYTES if limit is None else limit):
        return join_keys(big, F.broadcast(facts), keys, how)
    salts = SALTS if most is None else max(1, min(SALTS, -(-most // ROWS_PER_TASK)))
    if salts == 1:
        return join_keys(big.hint("merge"), facts, keys, how)
    spread = [c for c, t in big.dtypes if c not in keys and not t.startswith("map")]
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)) if spread else F.lit(0)
    salted = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread_out, copies = big.withColumn("_salt", salt.cast("int")), salted.withColumn("_salt", F.col("_salt").cast("int"))
    # a merge: the copies look no larger than the facts' file, but are never broadcast
    return join_keys(spread_out.hint("merge"), copies, [*keys, "_salt"], how).drop("_salt")


def running_totals(
    df: DataFrame,
    part: list[str],
    order: list[Column | str],
    sums: dict[str, str],
    rows_per_task: int | None = None,
) -> DataFrame:
    """Add inclusive running sums ``{output: input column}`` along ``order`` within ``part``.

    ``order`` must be unique within ``part``. Up to ROWS_PER_TASK input rows one window is
    used; beyond that rows are range-partitioned, summed inside each range, and shifted by
    the totals of the ranges before it, so no task ever sees a whole group.
    """
    bound = ROWS_PER_TASK if rows_per_task is None else rows_per_task
    df = settle(df, "ordered")
    rows = df.count()  # from the files' footers
    if rows <= bound:
        w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(c).over(w).alias(o) for o, c in sums.items()])
    n = max(2, -(-rows // max(bound, 1)) * 2)
    ranged = settle(
        df.repartitionByRange(n, *[F.col(p) for p in part], *order).withColumn(
            "_range", F.spark_partition_id()
        ),
        "ranged",
    )
    local = Window.partitionBy(*part, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*part).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # one row per (group, range): at most ranges + groups rows in all
    offsets = (
        ranged.groupBy(*part, "_range")
        .agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
        .select(
            *part, "_range",
            *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_o_{o}") for o in sums],
        )
    )
    out = ranged.select("*", *[F.sum(c).over(local).alias(f"_l_{o}") for o, c in sums.items()])
    out = attach(out, offsets, [*part, "_range"], "inner")
    return out.select(*df.columns, *[(F.col(f"_l_{o}") + F.col(f"_o_{o}")).alias(o) for o in sums])


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: dict[str, float],
    rows_per_task: int | None = None,
) -> DataFrame:
    """Linearly interpolated exact quantiles per key; nulls are ignored.

    Rows are first collapsed to (key, value, count); positions come from running counts, so
    a key that holds most rows costs no more than its distinct values, spread over ranges.
    """
    hist = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count("*").alias("_c"))
    )
    steps = running_totals(hist, keys, ["_v"], {"_hi": "_c"}, rows_per_task)
    sizes = steps.groupBy(*keys).agg(F.max("_hi").alias("_n"))
    steps = attach(steps, sizes, keys, "inner") if keys else join_keys(steps, sizes, [])
    picks = []
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("_n") - 1)
        lo = F.floor(pos)
        hi = F.least(lo + 1, F.col("_n") - 1)
        picks += [
            F.min(F.when(F.col("_hi") > lo, F.col("_v"))).alias(f"_lo_{name}"),
            F.min(F.when(F.col("_hi") > hi, F.col("_v"))).alias(f"_hi_{name}"),
            F.max(pos - lo).alias(f"_f_{name}"),
        ]
    return (
        steps.groupBy(*keys)
        .agg(F.max("_n").alias("_n"), *picks)
        .select(
            *keys,
            F.col("_n").alias("n_values"),
            *[
                (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n)
                for n in probs
            ],
        )
    )


def ordinal(df: DataFrame, keys: list[str], order: str, out: str, span: int = 65536) -> DataFrame:
    """0-based position of every row inside its key, by a unique integer ``order`` column.

    Rows are numbered inside blocks of ``span`` order values and shifted by the row counts of
    the blocks before, so a key with a third of all rows is still spread over many tasks.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / span))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocked.groupBy(*keys, "_block")
        .agg(F.count("*").alias("_m"))
        .select(*keys, "_block", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"))
    )
    local = Window.partitionBy(*keys, "_block").orderBy(order)
    return (
        join_keys(blocked.withColumn("_pos", F.row_number().over(local) - 1), offsets, [*keys, "_block"])
        .withColumn(out, (F.col("_pos") + F.col("_before")).cast("bigint"))
        .drop("_block", "_pos", "_before")
    )


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row that comes first by ``order`` for each key, by aggregation (no sort)."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.min(F.struct(*order, *rest)).alias("_r")
    return df.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in [*order, *rest]])


def grid(df: DataFrame, last: str, out: str, step: int = 1, block: int = 4096) -> DataFrame:
    """One row per value 0, step, ... , up to ``last`` (inclusive; none when it is negative).

    Built as blocks first, so a very long run never needs one huge array; the blocks are spread
    over all tasks before they grow into rows.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = F.floor(F.col(last) / step)
    blocks = df.where(F.col(last) >= 0).withColumn(
        "_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(n / block)))
    )
    blocks = blocks.repartition(tasks, *[c for c in df.columns if c != last], "_b")
    top = F.least((F.col("_b") + 1) * block - 1, n)
    values = F.sequence(F.col("_b") * block * step, top * step, F.lit(step).cast("bigint"))
    return blocks.withColumn(out, F.explode(values)).drop("_b")
