"""Exact set-similarity join on word shingles by parity sketches.

A document is the set of its distinct ``width``-word shingles. XOR-ing one code per shingle gives
a parity sketch: equal shingles cancel, so two sketches differ in no more places than the sets do
(the Hamming distance is a lower bound of the symmetric difference).

Size bands overlap so that any two sets that can reach the threshold share one. A band whose sets
hold at most T shingles allows D = floor((100 - t) * 2T / (100 + t)) differing shingles. Its sketch
is cut into k > D slices (a shingle's hash picks the slice); each differing shingle spoils one
slice. A set of n shingles differs from any partner in the band by at most d shingles, d from n and
the largest size such a partner can have, so both agree on at least k - d slices. Every set leaves
out its k - d - 1 emptiest slices - the order depends on the slice alone, hence the fullest common
slice is always sent by both - and joins on the remaining d + 1. Sets with d = 0 can only be equal
and need no join. Pairs are tested against three 1024-bit sketches, then exactly.

Only connected sets matter. A slice's documents are first paired with its smallest document and
with their neighbour; links found so contract documents into components, and only pairs of
documents that still lie in different components are tested after that, until none is left. A
slice that would still give many such pairs - near copies just below the threshold, or a passage
that many documents share - is cut into blocks of documents whose sketches are compared block by
block inside tasks; only pairs that the sketches let through become rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from crosswin.llm.components import connected_components
from crosswin.llm.tables import BROADCAST_BYTES, Scratch, look_up, tasks, text_rows
from crosswin.llm.text import chunks, column_of, list_array, mix, signed, split_words, window_hashes
from crosswin.operators.scale import table_bytes

SKETCH_BITS = 1024
SKETCHES_KEPT = 3
LANES = SKETCH_BITS // 64
BAND_RATIO = 1.6
OPEN_PAIRS = 64  # pairs between components from which a slice is compared in blocks
BLOCK = 1024  # documents of a block
BATCH = 4 << 20  # bytes of a batch of texts
CHUNK_BYTES = 1 << 20  # text a task turns into shingles at once: some twenty bytes of arrays each


def bands(percent: int, largest: int) -> list[tuple[int, int, int]]:
    """(smallest size, largest size, slices k) of each band."""
    out, low = [], 1
    while not out or out[-1][1] < largest:
        top = max(low, int(low * BAND_RATIO))
        differing = (100 - percent) * 2 * top // (100 + percent)
        out.append((low, top, differing + 1 + max(1, (differing + 1) // 8)))
        low = -(-percent * (top + 1) // 100)
    return out


def most_differing(n: np.ndarray, top: np.ndarray, percent: int) -> np.ndarray:
    """Largest symmetric difference of a set of n with a linked set of the same band."""
    return (100 - percent) * (n + np.minimum(top, 100 * n // percent)) // (100 + percent)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, flat, and offsets."""
    words = split_words(pc.ascii_lower(texts))
    values = words.hashes()
    hashed, start = window_hashes(values, words.offset, width)
    row = np.searchsorted(words.offset, start, side="right") - 1
    few = np.flatnonzero((words.lengths > 0) & (words.lengths < width))
    if len(few):  # the whole sequence as one shingle
        whole = np.empty(len(few), np.uint64)
        for n in range(1, width):
            of = np.flatnonzero(words.lengths[few] == n)
            acc = np.full(len(of), np.uint64(n))
            for i in range(n):
                acc = mix(acc + values[words.offset[few[of]] + i] * np.uint64(0x9E3779B97F4A7C15))
            whole[of] = acc
        hashed, row = np.concatenate([hashed, whole]), np.concatenate([row, few])
        order = np.argsort(row, kind="stable")
        hashed, row = hashed[order], row[order]
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts)), dtype=np.int64)])
    sets = [np.unique(hashed[a:b]) for a, b in zip(ends[:-1], ends[1:])]
    offset = np.concatenate([[0], np.cumsum([len(s) for s in sets], dtype=np.int64)])
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), offset


def slice_keys(items: np.ndarray, row: np.ndarray, n: np.ndarray, band: np.ndarray, plan: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the slices that each set sends in its band; band -1 sends none."""
    differing = most_differing(n, plan[band, 1], percent)
    in_band = (band >= 0) & (differing > 0)
    count = np.where(in_band, plan[band, 2], 0)
    spare = count - differing - 1
    base = np.concatenate([[0], np.cumsum(count)])
    used = in_band[row]
    items, row = items[used], row[used]
    part = ((items >> np.uint64(20)) % count[row].astype(np.uint64)).astype(np.int64)
    slot = base[row] + part
    weight = np.bincount(slot, minlength=base[-1])
    parity = np.zeros(base[-1], np.uint64)
    np.bitwise_xor.at(parity, slot, mix(items))
    owner = np.repeat(np.arange(len(n)), count)
    place = (np.arange(base[-1]) - base[owner]).astype(np.uint64)
    tag = band[owner].astype(np.uint64) << np.uint64(48) | place << np.uint64(24) | np.minimum(weight, 0xFFFFFF).astype(np.uint64)
    key = mix(parity + mix(tag))
    order = np.lexsort((key, weight, owner))
    rank = np.arange(base[-1]) - base[owner]  # owner is sorted, so ranks inside it are places
    sent = order[rank >= spare[owner]]
    return owner[sent], key[sent]


def sketch(width: int, percent: int):
    """Function for mapInArrow: set size, 128-bit set identity, sketch and slice keys of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=CHUNK_BYTES):
            items, offset = shingle_sets(column_of(batch, "text"), width)
            pa.default_memory_pool().release_unused()
            n = np.diff(offset)
            row = np.repeat(np.arange(len(n)), n)
            plan = np.array(bands(percent, 2 * int(n.max(initial=1))), dtype=np.int64)  # and the band after the last one
            upper = np.searchsorted(plan[:, 1], n)  # first band with n <= its top
            also = np.minimum(upper + 1, len(plan) - 1)
            also = np.where((n > 0) & (also > upper) & (plan[also, 0] <= n), also, -1)
            upper = np.where(n > 0, upper, -1)
            sent = [slice_keys(items, row, n, b, plan, percent) for b in (upper, also)]
            owner, key = (np.concatenate(x) for x in zip(*sent))
            order = np.argsort(owner, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(n)))])
            h1, h2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            full = np.flatnonzero(n > 0)
            if len(full):
                h1[full] = np.add.reduceat(items, offset[full])
                h2[full] = np.bitwise_xor.reduceat(mix(items), offset[full])
            width_bits = LANES * SKETCHES_KEPT
            bits = np.zeros(len(n) * width_bits, np.uint64)
            for k in range(SKETCHES_KEPT):
                bit = mix(items + np.uint64(k)) % np.uint64(SKETCH_BITS)
                lane = row * width_bits + k * LANES + (bit >> np.uint64(6)).astype(np.int64)
                np.bitwise_xor.at(bits, lane, np.uint64(1) << (bit & np.uint64(63)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(signed(h1)), pa.array(signed(h2)),
                    list_array(pa.array(signed(bits)), np.arange(len(n) + 1) * width_bits),
                    list_array(pa.array(signed(key[order])), ends),
                ],
                ["doc_id", "n", "h1", "h2", "bits", "keys"])

    return run


SKETCHES = "doc_id bigint, n bigint, h1 bigint, h2 bigint, bits array<bigint>, keys array<bigint>"


def linked(width: int, percent: int):
    """Function for mapInArrow over (a, b, text_a, text_b): the pairs whose sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for wide in chunks(batches, "text_a", CHUNK_BYTES):
            for batch in chunks(iter([wide]), "text_b", CHUNK_BYTES):
                both = pa.concat_arrays([column_of(batch, "text_a"), column_of(batch, "text_b")]).dictionary_encode()
                items, offset = shingle_sets(both.dictionary, width)
                code = both.indices.to_numpy(zero_copy_only=False)
                m, keep = batch.num_rows, []
                for i in range(m):
                    x, y = (items[offset[c]:offset[c + 1]] for c in (code[i], code[m + i]))
                    small, large = (x, y) if len(x) < len(y) else (y, x)
                    at = np.searchsorted(large, small)
                    shared = int((large[np.minimum(at, len(large) - 1)] == small).sum()) if len(large) else 0
                    keep.append(shared > 0 and 100 * shared >= percent * (len(x) + len(y) - shared))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def verify(pairs: DataFrame, facts: DataFrame, texts: DataFrame, width: int, percent: int, scratch: Scratch, label: str) -> DataFrame:
    """Written links (a, b) among candidate pairs: sizes and sketches first, then whole sets."""
    of = {s: facts.select(F.col("doc_id").alias(s), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}")) for s in "ab"}
    seen = look_up(look_up(pairs, of["a"], ["a"], "inner"), of["b"], ["b"], "inner")
    differ = F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    distance = F.greatest(*[
        F.aggregate(F.slice(differ, 1 + k * LANES, LANES), F.lit(0), lambda s, x: s + x) for k in range(SKETCHES_KEPT)])
    allowed = F.floor((100 - percent) * (F.col("n_a") + F.col("n_b")) / (100 + percent))
    near = seen.where(
        (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (distance <= allowed)).select("a", "b").distinct()
    near = scratch.put(near, f"{label}-near")
    sides = [with_text(texts, near, s) for s in "ab"]
    joined = sides[0].join(sides[1], ["a", "b"])
    return scratch.put(joined.mapInArrow(linked(width, percent), "a bigint, b bigint").distinct(), f"{label}-links", BATCH)


def with_text(texts: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """Pairs and the text of one side; small tables of pairs are broadcast to the texts."""
    wanted = pairs.select("a", "b", F.col(side).alias("doc_id"))
    if table_bytes(pairs) <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted)
    return texts.withColumnRenamed("text", f"text_{side}").join(wanted, "doc_id").drop("doc_id")


def compare_blocks(percent: int):
    """Function for mapInArrow over rows sorted by (key, lo, hi): pairs of documents of block lo
    and block hi that lie in different components and whose sizes and sketches allow a link.
    """

    def close(x: dict[str, np.ndarray], y: dict[str, np.ndarray], within: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(x["n"]), 128):
            n, m = x["n"][at:at + 128, None], y["n"][None, :]
            allowed = (100 - percent) * (n + m) // (100 + percent)
            ok = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (x["component"][at:at + 128, None] != y["component"][None, :])
            if within:
                ok &= np.arange(at, at + len(n))[:, None] < np.arange(len(y["n"]))[None, :]
            i, j = np.nonzero(ok)
            for k in range(SKETCHES_KEPT):
                for part in range(0, max(len(i), 1), 1 << 17) if len(i) else ():
                    some = slice(part, part + (1 << 17))
                    lanes = slice(k * LANES, (k + 1) * LANES)
                    far = np.bitwise_count(x["bits"][at + i[some], lanes] ^ y["bits"][j[some], lanes]).sum(axis=1, dtype=np.int64)
                    ok[i[some], j[some]] = far <= allowed[i[some], j[some]]
                i, j = np.nonzero(ok)
            yield x["rep"][at + i], y["rep"][j]

    def compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        one = {c: rows.column(c).to_numpy() for c in ("rep", "component", "n", "block", "lo", "hi")}
        one["bits"] = rows.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, LANES * SKETCHES_KEPT)
        lo, hi = one["lo"][0], one["hi"][0]
        x, y = ({c: v[one["block"] == b] for c, v in one.items()} for b in (lo, hi))
        for a, b in close(x, y, lo == hi):
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of one group: two blocks at most
        for batch in batches:
            where = [batch.column(c).to_numpy() for c in ("key", "lo", "hi")]
            cuts = np.flatnonzero(np.any([w[1:] != w[:-1] for w in where], axis=0)) + 1
            edges = [0, *cuts.tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                piece = batch.slice(a, b - a)
                if held and any(held[0].column(c)[0] != piece.column(c)[0] for c in ("key", "lo", "hi")):
                    yield from compare(pa.Table.from_batches(held))
                    held = []
                held.append(piece)
        if held:
            yield from compare(pa.Table.from_batches(held))

    return run


def open_pairs(left: DataFrame, facts: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b): pairs in different components that share a slice and may be linked."""
    sizes = left.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(
        F.sum("n").alias("g"), F.sum(F.col("n") * F.col("n")).alias("same"))
    many = scratch.put(sizes.where((F.col("g") * F.col("g") - F.col("same")) / 2 > OPEN_PAIRS).select("key", "g"), "rest-many")
    marked = scratch.put(look_up(left, many, ["key"]), "rest-marked")
    few = marked.where("g is null").select("key", "rep", "component")
    other = few.select("key", F.col("rep").alias("other"), F.col("component").alias("oc"))
    met = few.join(other, "key").where("component <> oc AND rep < other").select(F.col("rep").alias("a"), F.col("other").alias("b"))

    blocks = F.ceil(F.col("g") / BLOCK).cast("int")
    placed = marked.where("g is not null").withColumn("blocks", blocks).withColumn("block", F.pmod(F.hash("rep"), F.col("blocks")))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, "block").alias("lo"), F.greatest(x, "block").alias("hi")))
    spread = placed.select("key", "rep", "component", "block", F.explode(pairs).alias("p")).select("key", "rep", "component", "block", "p.lo", "p.hi")
    spread = look_up(spread, facts.withColumnRenamed("doc_id", "rep"), ["rep"], "inner")
    dealt = spread.repartition(tasks(left.sparkSession), "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return met.union(dealt.mapInArrow(compare_blocks(percent), "a bigint, b bigint"))


def similar_documents(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per document.

    Two documents link when 100 * shared shingles >= percent * shingles of either. component_id
    is the smallest doc_id reachable by links, itself included. A text of fewer than ``width``
    words is one shingle; a text without words links with nothing. Rows of one doc_id are one
    node. A null doc_id links with nothing and has a null component. Equal sets count once, so
    copies cost one comparison; empty tables give no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    texts = text_rows(docs)
    all_rows = scratch.put(texts.mapInArrow(sketch(width, percent), SKETCHES), "sketches", BATCH)
    identity = ["n", "h1", "h2"]
    usable = all_rows.where("doc_id is not null and n > 0")
    groups = usable.groupBy(*identity).agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"))
    groups = scratch.put(groups.where("rep <> last").drop("last"), "groups")
    rows = look_up(all_rows.drop("bits", "keys"), groups, identity)
    rows = scratch.put(rows.withColumn("rep", F.when(F.col("n") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id"))), "rows")
    marked = look_up(usable, groups, identity).where(F.coalesce("rep", "doc_id") == F.col("doc_id"))
    facts = scratch.put(marked.select("doc_id", "n", "h1", "bits").dropDuplicates(["doc_id", "n", "h1"]).drop("h1"), "facts")

    w = Window.partitionBy("key").orderBy("rep")
    slices = marked.select(F.col("doc_id").alias("rep"), F.explode("keys").alias("key"))
    live = slices.select(
        "key", "rep", F.first("rep").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("first"),
        F.lag("rep").over(w).alias("prev"), F.lead("rep").over(w).alias("next"))
    live = scratch.put(live.where("first <> rep or rep <> next").drop("next"), "live")
    scratch.drop("sketches")

    pairs = live.where("first <> rep").select(F.col("first").alias("a"), F.col("rep").alias("b"))
    pairs = pairs.union(live.where("prev <> rep").select(F.col("prev").alias("a"), F.col("rep").alias("b")))
    tested = scratch.put(pairs.distinct(), "pairs-1")
    # a doc_id with several texts is one node, so its sets' groups are one component
    several = rows.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high")
    ties = rows.join(several, "doc_id").select(F.col("low").alias("a"), F.col("rep").alias("b"))
    links = verify(tested, facts, texts, width, percent, scratch, "star").union(ties)
    comp = scratch.put(connected_components(links, scratch, "comp-1"), "components-1")

    for step in ("hashed", "rest"):
        open_ = look_up(live.select("key", "rep"), comp.withColumnRenamed("node", "rep"), ["rep"])
        open_ = scratch.put(open_.withColumn("component", F.coalesce("component", "rep")), f"{step}-open")
        split = open_.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
        split = scratch.put(split.select("key"), f"{step}-split")
        left = scratch.put(look_up(open_, split, ["key"], "inner"), f"{step}-left")
        scratch.drop(f"{step}-open")
        if step == "hashed":  # another centre and other neighbours, so that components grow before the rest is compared
            v = Window.partitionBy("key").orderBy(F.xxhash64("rep"), "rep")
            around = left.select(
                "rep", "component", F.lag("rep").over(v).alias("p"), F.lag("component").over(v).alias("pc"),
                F.first("rep").over(v.rowsBetween(Window.unboundedPreceding, 0)).alias("f"),
                F.first("component").over(v.rowsBetween(Window.unboundedPreceding, 0)).alias("fc"))
            found = around.where("pc <> component").select("rep", F.col("p").alias("other"))
            found = found.union(around.where("fc <> component").select("rep", F.col("f").alias("other")))
            found = found.select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b"))
        else:
            found = open_pairs(left, facts, percent, scratch)
        fresh = scratch.put(found.distinct().join(tested, ["a", "b"], "left_anti"), f"{step}-pairs")
        more = verify(fresh, facts, texts, width, percent, scratch, step)
        tested, links = tested.union(fresh), links.union(more)
        if more.isEmpty():
            continue
        comp = scratch.put(connected_components(links, scratch, f"comp-{step}"), f"components-{step}")
    scratch.drop("facts", "groups", "live", "pairs-1", "rest-many", "rest-marked", *[f"{s}-{t}" for s in ("star", "hashed", "rest") for t in ("left", "pairs", "near", "links")])
    out = look_up(rows, comp.withColumnRenamed("node", "rep"), ["rep"])
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id")).alias("component_id"))
