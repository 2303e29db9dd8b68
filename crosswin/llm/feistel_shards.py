"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered by one range-partitioned, sorted table of narrow keys: a row's number is the count
of rows in the ranges before it plus its place in its range. The number n is split into (n div b,
n mod b) of a grid a x b that is barely larger than the table; rounds add a keyed function of one
half to the other, so the grid is permuted. A number that leaves the table is permuted again until
it is back inside. Position p then has shard p mod shards and slot p div shards: counts differ by one
at most, slots have no gaps, and both can be computed, and inverted, from the row number alone.

Everything is column arithmetic; nothing but the narrow keys is shuffled, and no group is gathered,
however many rows share a doc_id, text or source.
"""

from __future__ import annotations

import hashlib
import os
from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from crosswin.llm.tables import Scratch, look_up, tasks

PRIME = (1 << 31) - 1
ROUNDS = 6
ROW_BYTES = 16


def round_keys(seed: int) -> list[tuple[int, int]]:
    """Two numbers below PRIME for every round."""
    out = []
    for i in range(ROUNDS):
        digest = hashlib.sha256(f"{seed}|{i}".encode()).digest()
        out.append((int.from_bytes(digest[:8], "big") % PRIME, int.from_bytes(digest[8:16], "big") % PRIME))
    return out


def sides(n: int) -> tuple[int, int]:
    """a, b with a * b >= n and fewer than a places too many."""
    a = max(1, isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def scrambled(half: Column, key: Column, size: int) -> Column:
    """A keyed function of one half, below ``size``; products stay below 2 ** 62."""
    once = (half + key["add"]) % PRIME
    twice = (once * once + key["then"]) % PRIME
    return twice * twice % PRIME % size


def feistel(place: Column, n: int, seed: int, back: bool = False) -> Column:
    """``place`` permuted within the grid of n, or permuted back."""
    a, b = sides(n)
    keys = [F.struct(F.lit(k).cast("bigint").alias("add"), F.lit(m).cast("bigint").alias("then"), F.lit(i % 2 == 0).alias("even")) for i, (k, m) in enumerate(round_keys(seed))]
    sign = -1 if back else 1

    def one_round(at: Column, key: Column) -> Column:
        left = F.when(key["even"], F.pmod(at["l"] + sign * scrambled(at["r"], key, a), F.lit(a))).otherwise(at["l"])
        right = F.when(key["even"], at["r"]).otherwise(F.pmod(at["r"] + sign * scrambled(at["l"], key, b), F.lit(b)))
        return F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))

    place = place.cast("bigint")
    start = F.struct(F.call_function("div", place, F.lit(b).cast("bigint")).alias("l"), (place % b).alias("r"))
    return F.aggregate(F.array(*(reversed(keys) if back else keys)), start, one_round, lambda at: at["l"] * b + at["r"])


def walks(spark: SparkSession, n: int, seed: int) -> int:
    """The longest way any row takes outside the table: the places too many, about sqrt(n), are followed
    until they are back. Places that only lead to each other never are, and no row leads to them."""
    a, b = sides(n)
    limit = 8
    while True:
        start = F.struct(F.col("id").alias("v"), F.lit(0).alias("k"))
        step = lambda at, _: F.when(at["v"] < n, at).otherwise(F.struct(feistel(at["v"], n, seed).alias("v"), (at["k"] + 1).alias("k")))
        way = F.aggregate(F.array_repeat(F.lit(0), limit), start, step)
        ends = spark.range(n, a * b).select(way.alias("at")).agg(
            F.max(F.when(F.col("at.v") < n, F.col("at.k"))).alias("k"), F.max(F.col("at.v") >= n).alias("outside")).first()
        if not ends["outside"] or limit > a * b - n:
            return ends["k"] or 0
        limit *= 2


def permuted(place: Column, n: int, seed: int, steps: int, back: bool = False) -> Column:
    """Whole numbers from 0 to n - 1 in shuffled order (or put back), ``steps`` from walks()."""
    once = feistel(place, n, seed, back)
    if not steps:
        return once
    return F.aggregate(F.array_repeat(F.lit(0), steps), once, lambda v, _: F.when(v < n, v).otherwise(feistel(v, n, seed, back)))


def number_rows(rows: DataFrame, order: list[str], scratch: Scratch) -> tuple[DataFrame, int]:
    """The written rows with ``row``, their place from 0 in the order of the columns, and their number.

    Rows equal in ``order`` are spread over ranges by where they were read.
    """
    tied = scratch.put(rows.withColumn("_read", F.monotonically_increasing_id()), "unordered")
    keys = [*order, "_read"]
    ranged = tied.repartitionByRange(tasks(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    placed = scratch.put(ranged.drop("_read").withColumn("_at", F.monotonically_increasing_id()), "ordered")
    scratch.drop("unordered")
    # the upper bits of _at are the range, the lower 33 the place in it
    placed = placed.withColumn("_range", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))  # one row per range
    offsets = scratch.put(sizes.select("_range", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "offsets")
    total = offsets.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()["n"]
    numbered = look_up(placed, offsets.drop("_n"), ["_range"], "inner")
    return numbered.withColumn("row", F.col("_at") + F.col("_before")).drop("_at", "_range", "_before"), total


def assign(docs: DataFrame, shards: int = 40, seed: int = 1, carry: bool = False) -> DataFrame:
    """(doc_id, size, text_crc32, row, position, shard, slot), one row per document.

    ``size`` is the text's bytes in UTF-8 plus 16; a null text has none and the checksum of an empty
    one. ``row`` numbers the rows by doc_id (nulls first), then text; ``position`` is its shuffled
    place, shard = position mod shards, slot = position div shards. The same rows, ``shards`` and
    ``seed`` give the same result whatever the files' layout; equal rows are interchangeable. With
    ``carry`` all columns of ``docs`` come along as well, but for those named like an output.
    An empty table gives an empty one; with fewer rows than shards the last shards stay empty.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    names = ["doc_id", "size", "text_crc32", "row", "position", "shard", "slot"]
    extra = [c for c in docs.columns if carry and c not in names]
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("_hash"), *extra)
    numbered, n = number_rows(rows, ["doc_id", "_hash", "text_crc32", "size"], scratch)
    placed = numbered.withColumn("position", permuted(F.col("row"), max(n, 1), seed, walks(spark, max(n, 1), seed)))
    return placed.select(
        *names[:5], (F.col("position") % shards).cast("int").alias("shard"), F.call_function("div", F.col("position"), F.lit(shards)).alias("slot"), *extra)


def rows_at(places: DataFrame, n: int, shards: int, seed: int = 1) -> DataFrame:
    """``places`` (shard, slot) of a table of n rows with the ``row`` that stands there; null outside the table."""
    position = F.col("slot") * shards + F.col("shard")
    inside = (F.col("shard").between(0, shards - 1)) & (F.col("slot") >= 0) & (position < n)
    row = permuted(position, max(n, 1), seed, walks(places.sparkSession, max(n, 1), seed), back=True)
    return places.withColumn("row", F.when(inside, row))


def write_shards(docs: DataFrame, path: str, shards: int = 40, seed: int = 1) -> None:
    """Parquet folders shard=0, 1, ... with all columns; a shard's files hold its slots in order, file after file."""
    placed = Scratch(docs.sparkSession, "placed").put(assign(docs, shards, seed, carry=True), "rows")
    n = max(shards, tasks(docs.sparkSession))
    placed.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(os.path.join(path))
