"""URL filter over a sorted array of 64-bit xxhash digests.

Spark sorts the digests of all listed addresses and rules into shards: ascending digests, the full
strings behind them, and their verdicts, as flat bytes. Tasks memory-map a shard, find a batch of
digests by vectorised binary search and compare the stored strings, so a collision never decides.
A small index goes to every task; a larger one is met shard by shard by the distinct addresses.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from crosswin.llm.tables import BROADCAST_BYTES, Scratch, look_up

SHARD_ROWS = 500_000
PROBE_ROWS = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHARDS = "shard int, low bigint, n bigint, digests binary, ends binary, strings binary, allows binary"


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    allow: bool
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: str) -> Column:
    found = F.regexp_extract(url, "://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def addresses(pages: DataFrame) -> DataFrame:
    """page_id, host, path of each row; null or without '://': both empty."""
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), host_of("url").alias("host"), path_of("url").alias("path"))


def build_index(entries: DataFrame, scratch: Scratch) -> DataFrame:
    """Written shards of (key, allow): range-partitioned by digest, one row of flat bytes each."""
    keyed = scratch.put(entries.groupBy("key").agg(F.max("allow").alias("allow")).withColumn("digest", F.xxhash64("key")), "entries")
    n = max(1, -(-keyed.count() // SHARD_ROWS))
    ordered = keyed.repartitionByRange(n, "digest").sortWithinPartitions("digest", "key").withColumn("shard", F.spark_partition_id())
    return scratch.put(ordered.mapInArrow(pack, SHARDS), "shards")


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [b for b in batches if b.num_rows]  # SHARD_ROWS rows or so
    if not parts:
        return
    table = pa.Table.from_batches(parts)
    digests = table.column("digest").to_numpy()
    keys = [k.encode() for k in table.column("key").to_pylist()]
    row = [
        int(table.column("shard")[0].as_py()), int(digests[0]), len(keys), digests.tobytes(),
        np.cumsum([len(k) for k in keys], dtype=np.int64).tobytes(), b"".join(keys), table.column("allow").to_numpy().astype(np.uint8).tobytes(),
    ]
    names = ["shard", "low", "n", "digests", "ends", "strings", "allows"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)


class Shard:
    """A memory-mapped part of the array."""

    def __init__(self, row: dict):
        self.file = tempfile.TemporaryFile()  # no name, gone with the task's process
        for part in ("digests", "ends", "strings", "allows"):
            self.file.write(row[part])
        self.file.flush()
        n, size = row["n"], len(row["strings"])
        self.digests = np.memmap(self.file, np.int64, "r", 0, (n,))
        self.ends = np.memmap(self.file, np.int64, "r", 8 * n, (n,))
        self.strings = np.memmap(self.file, np.uint8, "r", 16 * n, (size,)) if size else np.empty(0, np.uint8)
        self.allows = np.memmap(self.file, np.uint8, "r", 16 * n + size, (n,))

    def find(self, keys: list[bytes], digests: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        at = np.searchsorted(self.digests, digests)
        out = np.full(len(keys), -1, np.int64)
        for i in np.flatnonzero((at < len(self.digests)) & (self.digests[np.minimum(at, len(self.digests) - 1)] == digests)):
            j = at[i]
            while j < len(self.digests) and self.digests[j] == digests[i]:  # strings decide
                if self.strings[self.ends[j - 1] if j else 0:self.ends[j]].tobytes() == keys[i]:
                    out[i] = j
                    break
                j += 1
        return out


def digest(keys: list[bytes]) -> np.ndarray:
    """The same 64-bit xxhash as Spark's xxhash64."""
    return np.fromiter((xxhash.xxh64_intdigest(k, 42) for k in keys), np.uint64, len(keys)).view(np.int64)


_OPEN: dict[str, list[Shard]] = {}  # one index per worker process


def look_in(shards: list[Shard], lows: np.ndarray, keys: list[bytes]) -> np.ndarray:
    """1 allow, 0 block, -1 absent, for each key."""
    out = np.full(len(keys), -1, np.int8)
    if not shards or not keys:
        return out
    digests = digest(keys)
    which = np.maximum(np.searchsorted(lows, digests, side="right") - 1, 0)
    for s in np.unique(which):
        at = np.flatnonzero(which == s)
        found = shards[s].find([keys[i] for i in at], digests[at])
        hit = found >= 0
        out[at[hit]] = shards[s].allows[found[hit]]
    return out


def candidates(host: str, path: str, lengths: list[int]) -> list[str]:
    """The address itself, then every rule text that would fit it, longest first."""
    labels = host.split(".")
    hosts = [".".join(labels[i:]) for i in range(len(labels))] if host else []
    fits = [(h, path[:n]) for h in hosts for n in lengths if n <= len(path)]
    fits.sort(key=lambda x: (len(x[0]) + len(x[1]), len(x[0])), reverse=True)
    return ["u:" + host + path, *("r:" + h + "\n" + p for h, p in fits)]


def decide(found: list[tuple[str, int]]) -> tuple[str | None, str]:
    """(rule, verdict) from looked-up candidates, in their order."""
    for key, state in found[1:]:
        if state >= 0:
            return key[2:].replace("\n", "", 1), "allow" if state else "block"
    return None, "allow" if found[0][1] else "block" if found[0][1] == 0 else "allow"


def filter_pages(pages: DataFrame, listed: DataFrame, rules: list[Rule], broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(page_id, host, path, rule, verdict), one row per page.

    ``listed`` has one column key: host followed by path of blocked addresses. The longest
    fitting rule decides; else a listed address is blocked and any other allowed. Null urls
    and urls without '://' have empty host and path, fit no rule, and are allowed, since
    empty and null keys are not listed. Repeated pages get equal rows; empty tables give none.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    lengths = sorted({len(r.path) for r in rules})
    entries = listed.where("key <> ''").select(F.concat(F.lit("u:"), "key").alias("key"), F.lit(False).alias("allow"))
    if rules:
        entries = entries.union(spark.createDataFrame([(f"r:{r.host}\n{r.path}", r.allow) for r in rules], "key string, allow boolean"))
    index = build_index(entries, scratch)
    size = index.agg(F.coalesce(F.sum(F.length("digests") * 2 + F.length("strings") + F.length("allows")), F.lit(0)).alias("b")).first()["b"]
    rows = addresses(pages)
    if size <= broadcast_bytes:
        return probe_everywhere(rows, index, lengths)
    return probe_by_shard(rows, index, lengths, scratch)


def probe_everywhere(rows: DataFrame, index: DataFrame, lengths: list[int]) -> DataFrame:
    """The whole index goes to every task."""
    shards = sorted((r.asDict() for r in index.collect()), key=lambda r: r["low"])  # size checked by the caller
    lows, name = np.array([s["low"] for s in shards], np.int64), index.inputFiles()[0] if shards else ""
    shared = rows.sparkSession.sparkContext.broadcast(shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _OPEN:
            _OPEN.clear()
            _OPEN[name] = [Shard({k: bytes(v) if isinstance(v, bytearray) else v for k, v in s.items()}) for s in shared.value]
        for batch in batches:
            keys = [candidates(h, p, lengths) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]
            states = look_in(_OPEN[name], lows, [k.encode() for ks in keys for k in ks]).tolist()
            rules, verdicts, at = [], [], 0
            for ks in keys:
                rule, verdict = decide(list(zip(ks, states[at:at + len(ks)])))
                at += len(ks)
                rules.append(rule)
                verdicts.append(verdict)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return rows.mapInArrow(run, "page_id bigint, host string, path string, rule string, verdict string")


def probe_by_shard(rows: DataFrame, index: DataFrame, lengths: list[int], scratch: Scratch) -> DataFrame:
    """Distinct candidate keys meet the shard they belong to; the pages' text stays where it is."""
    lows = sorted((r.low, r.shard) for r in index.select("low", "shard").collect())

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            keys = [candidates(h, p, lengths) for h, p in zip(hosts, paths)]
            flat = [(h, p, i, k) for h, p, ks in zip(hosts, paths, keys) for i, k in enumerate(ks)]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in flat], t) for c, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.string()))], ["host", "path", "place", "key"])

    distinct = scratch.put(rows.select("host", "path").distinct(), "addresses")
    wanted = scratch.put(distinct.mapInArrow(expand, "host string, path string, place int, key string"), "wanted")
    keys = scratch.put(wanted.select("key").distinct().withColumn("digest", F.xxhash64("key")), "keys")
    edges = F.array(*[F.lit(low) for low, _ in lows])
    place = F.greatest(F.size(F.filter(edges, lambda x: x <= F.col("digest"))), F.lit(1))
    salts = max(1, -(-keys.count() // (PROBE_ROWS * len(lows))))  # digests are even, so are the groups
    probes = keys.select("key", F.element_at(F.array(*[F.lit(s) for _, s in lows]), place).alias("shard"), F.pmod(F.hash("key"), F.lit(salts)).alias("salt"))
    copies = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = left.column("key").to_pylist()
        shards = [Shard(r) for r in right.to_pylist()]
        state = look_in(shards, np.array(right.column("low").to_pylist(), np.int64), [k.encode() for k in keys])
        return pa.table({"key": pa.array(keys, pa.string()), "state": pa.array(state, pa.int32())}).filter(pa.array(state >= 0))

    found = probes.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInArrow(meet, "key string, state int")
    hits = wanted.join(scratch.put(found, "found"), "key")
    best = hits.groupBy("host", "path").agg(
        F.min(F.when(F.col("place") > 0, F.struct("place", "key", "state"))).alias("rule"), F.max(F.col("place") == 0).alias("listed"))
    best = scratch.put(best, "best")
    out = look_up(rows, best, ["host", "path"])
    verdict = F.when(F.col("rule").isNotNull(), F.when(F.col("rule.state") == 1, "allow").otherwise("block"))
    return out.select(
        "page_id", "host", "path", F.replace(F.substring(F.col("rule.key"), 3, 2**31 - 1), F.lit("\n"), F.lit("")).alias("rule"),
        F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))
