"""Ordered work on long per-run series, cut into time chunks.

A run may hold a third of all seconds. Windows therefore run inside (run, chunk) partitions
of a fixed number of time steps; what a chunk needs from its neighbours comes from one small
row per chunk (carried values) or from copied edge rows (halo).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from crosswin.operators.scale import attach, grid, join_keys

CHUNK = 4096


def _chunk(df: DataFrame, t: str, size: int) -> DataFrame:
    return df.withColumn("_c", F.floor(F.col(t) / size))


def densify(series: DataFrame, keys: list[str], t: str, fill: dict[str, float] | None = None, start: str = "zero") -> DataFrame:
    """Every integer step of the series becomes a row; absent steps get ``fill`` or null.

    ``start`` is "zero" (grid from 0) or "first" (grid from the first step).
    """
    ends = series.groupBy(*keys).agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    base = F.lit(0).cast("bigint") if start == "zero" else F.col("_lo")
    ends = ends.withColumn("_base", base).withColumn("_last", F.col("_hi") - F.col("_base"))
    steps = grid(ends, "_last", "_step").select(*keys, (F.col("_base") + F.col("_step")).alias(t))
    out = join_keys(steps, series, [*keys, t], "left")
    return out.fillna(fill) if fill else out


def previous(df: DataFrame, keys: list[str], t: str, value: str, out: str, size: int = CHUNK) -> DataFrame:
    """Value of the row before, along ``t``; null on the first row of a key."""
    d = _chunk(df, t, size)
    local = Window.partitionBy(*keys, "_c").orderBy(t)
    before = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        d.groupBy(*keys, "_c")
        .agg(F.max_by(value, t).alias("_last"))
        .select(*keys, "_c", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    )
    return (
        join_keys(d.withColumn("_lag", F.lag(value).over(local)), carry, [*keys, "_c"])
        .withColumn(out, F.coalesce("_lag", "_carry"))
        .drop("_c", "_lag", "_carry")
    )


def fill_both_ways(df: DataFrame, keys: list[str], t: str, columns: list[str], size: int = CHUNK) -> DataFrame:
    """Fill the gaps of dense columns: last known value, before the first one the next known,
    else 0. Adds ``<column>_filled`` and ``<column>_before``, the filled value one step earlier
    (the value itself on the first step).

    Only the steps before the first known value are filled backwards, and all of them from
    that value. One forward pass and one row per chunk therefore suffice.
    """
    d = _chunk(df, t, size)
    order = Window.partitionBy(*keys, "_c").orderBy(t)
    back = order.rowsBetween(Window.unboundedPreceding, 0)
    chunks = Window.partitionBy(*keys).orderBy("_c")
    earlier = chunks.rowsBetween(Window.unboundedPreceding, -1)
    whole = chunks.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = {c: F.when(F.col(c).isNotNull(), F.col(t)) for c in columns}
    edges = d.groupBy(*keys, "_c").agg(
        *[F.max_by(c, k).alias(f"_l_{c}") for c, k in known.items()],
        *[F.min_by(c, k).alias(f"_f_{c}") for c, k in known.items()],
    )
    carry = edges.select(
        *keys, "_c",
        *[F.last(f"_l_{c}", ignorenulls=True).over(earlier).alias(f"_p_{c}") for c in columns],
        *[F.first(f"_f_{c}", ignorenulls=True).over(whole).alias(f"_n_{c}") for c in columns],
    )
    local = d.select("*", *[F.last(c, ignorenulls=True).over(back).alias(f"_b_{c}") for c in columns])
    local = local.select("*", *[F.lag(f"_b_{c}").over(order).alias(f"_q_{c}") for c in columns])
    zero = F.lit(0.0)
    filled = [F.coalesce(f"_b_{c}", f"_p_{c}", f"_n_{c}", zero).alias(f"{c}_filled") for c in columns]
    before = [F.coalesce(f"_q_{c}", f"_p_{c}", f"_n_{c}", zero).alias(f"{c}_before") for c in columns]
    return join_keys(local, carry, [*keys, "_c"]).select(*df.columns, *filled, *before)


def moving_average(
    df: DataFrame, keys: list[str], t: str, columns: list[str], width: int, size: int = CHUNK
) -> DataFrame:
    """Centred moving average of a dense series: zeros beyond the ends, divisor always width.

    An even width reaches one step further back than ahead.
    """
    if width <= 1:
        return df
    back, ahead = width // 2, (width - 1) // 2
    lo = F.floor((F.col(t) - ahead) / size)
    hi = F.floor((F.col(t) + back) / size)
    spread = df.withColumn("_c", F.explode(F.sequence(lo, hi)))
    w = Window.partitionBy(*keys, "_c").orderBy(t).rowsBetween(-back, ahead)
    averaged = [(F.sum(c).over(w) / width).alias(f"_m_{c}") for c in columns]
    return (
        spread.select("*", *averaged)
        .where(F.floor(F.col(t) / size) == F.col("_c"))
        .select(*[c for c in df.columns if c not in columns], *[F.col(f"_m_{c}").alias(c) for c in columns])
    )


def rebase(df: DataFrame, keys: list[str], t: str) -> DataFrame:
    """Shift ``t`` so that each key starts at 0."""
    lo = df.groupBy(*keys).agg(F.min(t).alias("_lo"))
    return attach(df, lo, keys).withColumn(t, F.col(t) - F.col("_lo")).drop("_lo")
