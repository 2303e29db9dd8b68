"""Connected components by alternating star contractions, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from crosswin.llm.tables import Scratch, look_up


def connected_components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(node, component): for every node of ``edges`` (a, b), the smallest node it reaches.

    Each round points all larger neighbours of a node, then the node and its smaller ones, at
    the smallest of them, until the edges form stars. Self loops keep single nodes. A hot
    node's edges are never gathered: its minimum is a partial aggregate that is joined back.
    """
    loops = edges.where("a = b").select(F.col("a").alias("node")).distinct()
    loops = scratch.put(loops, f"{label}-loops")
    now = scratch.put(edges.where("a <> b").select("a", "b").distinct(), f"{label}-0")
    before, n = None, 0
    while (seen := fingerprint(now)) != before:
        before, n = seen, n + 1
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = scratch.put(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), f"{label}-low-{n}")
        large = look_up(both.where("b > a"), low, ["a"], "inner").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.put(large.where("a <> b").distinct(), f"{label}-large-{n}")
        # every edge now leads from a node to a smaller one
        least = scratch.put(large.groupBy("a").agg(F.min("b").alias("m")), f"{label}-least-{n}")
        down = look_up(large, least, ["a"], "inner")
        small = down.select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b")))
        now = scratch.put(small.where("a <> b").distinct(), f"{label}-{n}")
        scratch.drop(f"{label}-{n - 1}", f"{label}-low-{n}", f"{label}-large-{n}", f"{label}-least-{n}")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    alone = loops.select("node", F.col("node").alias("component"))
    return stars.union(roots).union(alone).groupBy("node").agg(F.min("component").alias("component"))


def fingerprint(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(mixed.cast("decimal(38,0)")), F.bit_xor(mixed)).first())
