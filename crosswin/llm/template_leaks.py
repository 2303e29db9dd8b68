"""Benchmark decontamination by template canonicalisation.

Words become templates: numbers, units and names turn into typed placeholders, everything else
stays as its lower-case self. Windows of eight template words (short benchmark items: all their
words) are hash-joined between benchmark and documents, so a question is found again after its
numbers and names were changed. Names are told by their capital, so a second view has placeholders
for numbers and units only and finds text whose case was changed, too; windows of which numbers
fill over half are looked for as they are.

Items of one template share its windows, but each is judged by its own words. At every place in a
document that lines up with an item, placeholder values must map one to one. Where they do not,
windows with the values that break the mapping are coincidences of form and are dropped; windows
that equal the item's own words always count.

A bitmap of fixed size, made of the benchmark's window hashes, spares documents' windows that
cannot match; the join itself is exact at any size of either side.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from crosswin.llm.tables import BROADCAST_BYTES, Scratch, text_rows
from crosswin.llm.text import chunks, column_of, list_array, mix, signed, split_words, word_hashes
from crosswin.operators.scale import table_bytes

WIDTH = 8
LEAST_WORDS = 4  # shorter items say too little to be looked for
FILTER_BITS = 1 << 24
EDGES = ".,;:!?\"'()[]{}<>*#$%&|-_“”‘’«»¿¡…"
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:%|st|nd|rd|th)?|\d+[a-z]{1,3}\d*")
# fixed values: words for numbers and units of measure
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
UNITS = frozenset("mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ton tons ounce ounces pound pounds lb lbs ml l liter liters litre litres gallon gallons second seconds sec minute minutes min hour hours hr day days week weeks month months year years cent cents dollar dollars euro euros usd eur percent degree degrees meter meters metre metres kilometer kilometers kmh mph hz khz mhz w kw v".split())
NUM, UNIT, NAME = np.uint64(0x6E756D), np.uint64(0x756E6974), np.uint64(0x6E616D65)
BASE = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
JUDGED_AT_ONCE = 256  # rows, so that memory stays flat
LEAST_COVERAGE, LEAST_COVERED, LEAST_CONSISTENT = 0.5, 20, 0.8


def kind(word: str) -> np.uint64 | None:
    """Placeholder of a word without edge marks, None for a literal."""
    low = word.lower()
    if NUMBER.fullmatch(low) or low in NUMBER_WORDS:
        return NUM
    if low in UNITS:
        return UNIT
    if word[:1].isupper() and word[1:].islower():
        return NAME
    return None


class Templates:
    """Canonical words of a batch of texts: literal and template hashes, slots, row offsets."""

    def __init__(self, texts: pa.Array):
        words = split_words(texts)
        bare = [w.strip(EDGES) for w in words.listed]
        literal = word_hashes([w.lower() for w in bare])
        kinds = [kind(w) for w in bare]
        template = np.array([h if k is None else k for h, k in zip(literal, kinds)], np.uint64)
        real = np.array([bool(w) for w in bare], bool)[words.code]
        upto = np.concatenate([[0], np.cumsum(real)])
        code = words.code[real]
        self.offset = upto[words.offset]
        self.literal, self.template = literal[code], template[code]
        self.slot = np.array([0 if k is None else 2 if k == NAME else 1 for k in kinds], np.int8)[code]

    def windows(self, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(view, start, hash) of windows inside one text.

        View 0 has placeholders for numbers, units and names, 1 for numbers and units, 2 for none.
        Windows with number and unit placeholders only need literals for half their words; with a
        name, two literals are enough, or half of a short window: whether it is the item is told by
        its slots. View 0 holds windows with a name (others are in view 1), view 2 those that
        view 1 leaves out: equal words always meet.
        """
        lengths = np.diff(self.offset)
        n = len(self.slot)
        left = np.repeat(self.offset[1:], lengths) - np.arange(n)
        every = np.flatnonzero(left >= width)
        fixed, names = (np.concatenate([[0], np.cumsum(self.slot == k)]) for k in (1, 2))
        n_fixed, n_names = fixed[every + width] - fixed[every], names[every + width] - names[every]
        half = np.where(self.slot == 1, self.template, self.literal)
        up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, BASE))])
        down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, BACK))])
        for view, values, take in (
            (0, self.template, (n_names > 0) & (n_fixed + n_names <= max(width - 2, width // 2))), (1, half, 2 * n_fixed <= width), (2, self.literal, 2 * n_fixed > width)):
            start = every[take]
            sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(values) * up[:n])])
            yield view, start, mix((sums[start + width] - sums[start]) * down[start] + np.uint64(4 * width + view))


def window_rows(texts: pa.Array, widths: list[int], chosen: np.ndarray | None = None) -> tuple[np.ndarray, list[pa.Array]]:
    """Row of each window, and (pos, width, view, hash, words) of it; ``chosen`` is the bitmap to pass."""
    t = Templates(texts)
    parts = []
    for width in widths:
        for view, start, h in t.windows(width):
            if chosen is not None:
                bit = h % np.uint64(FILTER_BITS)
                hit = (chosen[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1
                start, h = start[hit == 1], h[hit == 1]
            row = np.searchsorted(t.offset, start, side="right") - 1
            words = signed(t.literal[(start[:, None] + np.arange(width)).ravel()])
            parts.append((row, start - t.offset[row], np.full(len(start), width), np.full(len(start), view), signed(h), words))
    row, pos, size, view, h, words = (np.concatenate([p[k] for p in parts]) for k in range(6))
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
    return row, [*(pa.array(x, t) for x, t in zip((pos, size, view, h), kinds)), list_array(pa.array(words, pa.int64()), np.concatenate([[0], np.cumsum(size)]))]


def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words, slots and template of each item."""
    for batch in chunks(batches):
        t = Templates(column_of(batch, "text"))
        spans = list(zip(t.offset[:-1], t.offset[1:]))
        out = [(int(b - a), hash_of(t.template[a:b]), hash_of(t.literal[a:b][t.slot[a:b] == 0])) for a, b in spans]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("item_id"), batch.column("text"), *(pa.array([o[k] for o in out], pa.int64()) for k in range(3)),
                list_array(pa.array(signed(t.literal), pa.int64()), t.offset), list_array(pa.array(t.slot.astype(np.int32)), t.offset),
            ],
            ["item_id", "text", "n_words", "t1", "t2", "item_words", "item_slots"])


def hash_of(values: np.ndarray) -> int:
    acc = mix(values + mix(np.arange(len(values), dtype=np.uint64)))
    return int(np.bitwise_xor.reduce(acc, initial=np.uint64(len(values))).astype(np.int64))


def one_to_one(pairs: list[tuple[int, int]]) -> set[tuple[int, int]]:
    """Of (item value, document value) by slot position, the pairs of a mapping; the most frequent, then the first go first."""
    ahead: dict[int, int] = {}
    back: dict[int, int] = {}
    for (x, y), _ in Counter(pairs).most_common():  # equal counts keep their order
        if x not in ahead and y not in back:
            ahead[x], back[y] = y, x
    return set(ahead.items())


def judge_item(found: list[dict], words: list[int], slots: list[int]) -> tuple[int, int, int, int, int]:
    """(covered, n_places, n_slots, n_consistent, n_unchanged) of one document and item."""
    places: dict[int, list[tuple[int, int, dict[int, int], bool]]] = {}
    for f in found:
        at, width = f["item_pos"], f["width"]
        own, kinds = words[at:at + width], slots[at:at + width]
        changed = [k for x, y, k in zip(own, f["words"], kinds) if x != y]
        if any(k == 0 or k == 2 and f["view"] or f["view"] == 2 for k in changed):
            continue  # another item of the template
        values = {at + i: y for i, (k, y) in enumerate(zip(kinds, f["words"])) if k}
        places.setdefault(f["diagonal"], []).append((at, width, values, not changed))
    covered: set[int] = set()
    n_slots = n_good = n_same = n_places = 0
    for windows in places.values():
        at_slot = {p: y for w in windows for p, y in w[2].items()}
        pairs = [(words[p], at_slot[p]) for p in sorted(at_slot)]
        kept = one_to_one(pairs)
        ahead: dict[int, set[int]] = {}
        back: dict[int, set[int]] = {}
        for x, y in pairs:
            ahead.setdefault(x, set()).add(y)
            back.setdefault(y, set()).add(x)
        single = sum(len(ys) == 1 and len(back[next(iter(ys))]) == 1 for ys in ahead.values())
        whole = single >= LEAST_CONSISTENT * len(ahead)
        counted = [w for w in windows if whole or w[3] or all((words[p], y) in kept for p, y in w[2].items())]
        if not counted:
            continue
        n_places += 1
        n_slots, n_good, n_same = n_slots + len(pairs), n_good + sum(p in kept for p in pairs), n_same + sum(x == y for x, y in pairs)
        for at, width, _, _ in counted:
            covered.update(range(at, at + width))
    return len(covered), n_places, n_slots, n_good, n_same


def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Coverage and slot consistency of each (document, item) from the windows joined by template."""
    for whole in batches:
        for start in range(0, whole.num_rows, JUDGED_AT_ONCE):
            batch = whole.slice(start, JUDGED_AT_ONCE)
            out = [judge_item(*r) for r in zip(*(batch.column(c).to_pylist() for c in ("found", "item_words", "item_slots")))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "item_id", "n_words")), *(pa.array([o[k] for o in out], pa.int64()) for k in range(5))],
                ["doc_id", "item_id", "n_words", "covered", "n_places", "n_slots", "n_consistent", "n_unchanged"])


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, item_id, n_words, covered, coverage, n_places, n_slots, n_consistent, leak), one row per leak.

    A document leaks an item when windows with consistent slots, or equal to the item's words,
    cover half of the item's words, or twenty of them. leak is 'verbatim' when no placeholder
    value changed, else 'reparameterised'. n_slots and n_consistent count slot positions. Every
    item has its own rows, also where items share a template; an item_id with several texts is
    an item for each. Items of fewer than four words, null or empty texts and null ids give no
    rows; repeated rows give what one of them gives, different texts of one doc_id are judged
    apart and each may have a row; empty tables give no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "leaks")
    source = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    source = source.where("item_id is not null").distinct()
    kinds = "item_id bigint, text string, n_words bigint, t1 bigint, t2 bigint, item_words array<bigint>, item_slots array<int>"
    listed = scratch.put(source.mapInArrow(items, kinds).where(F.col("n_words") >= LEAST_WORDS), "items")
    widths = sorted(r.w for r in listed.select(F.least(F.lit(width), "n_words").alias("w")).distinct().collect()) or [width]

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            row, columns = window_rows(column_of(batch, "text"), widths)
            keys = [batch.column(c).take(pa.array(row)) for c in ("t1", "t2", "n_words")]
            yield pa.RecordBatch.from_arrays([*keys, *columns[:4]], ["t1", "t2", "n_words", "item_pos", "width", "view", "h"])

    cuts = listed.select("text", "t1", "t2", "n_words").mapInArrow(of_items, "t1 bigint, t2 bigint, n_words bigint, item_pos int, width int, view int, h bigint")
    cuts = cuts.where(F.col("width") == F.least(F.lit(width), "n_words")).drop("n_words").distinct()  # once a template
    cuts = scratch.put(cuts, "windows")
    bits = cuts.select(F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1)).cast("int").alias("bit"))
    octets = bits.selectExpr("bit div 8 AS at", "shiftleft(1, bit % 8) AS b").groupBy("at").agg(F.bit_or("b").alias("b"))
    chosen = np.zeros(FILTER_BITS // 8, np.uint8)  # fixed size, whatever the benchmark's
    filled = octets.toArrow()
    chosen[filled.column("at").to_numpy()] = filled.column("b").to_numpy().astype(np.uint8)
    shared = spark.sparkContext.broadcast(chosen)

    def of_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            row, columns = window_rows(column_of(batch, "text"), widths, shared.value)
            ids = [batch.column(c).take(pa.array(row)) for c in ("doc_id", "row_hash")]
            yield pa.RecordBatch.from_arrays([*ids, *columns], ["doc_id", "row_hash", "pos", "doc_width", "doc_view", "doc_h", "words"])

    rows = text_rows(docs).where("doc_id is not null").withColumn("row_hash", F.xxhash64("text"))
    hits = rows.mapInArrow(of_documents, "doc_id bigint, row_hash bigint, pos int, doc_width int, doc_view int, doc_h bigint, words array<bigint>")
    known = F.broadcast(cuts) if table_bytes(cuts) <= BROADCAST_BYTES else cuts
    joined = hits.join(known, (F.col("doc_h") == F.col("h")) & (F.col("doc_width") == F.col("width")) & (F.col("doc_view") == F.col("view")))
    one = F.struct((F.col("pos") - F.col("item_pos")).alias("diagonal"), "item_pos", "width", "view", "words")
    # each text of a doc_id on its own; its windows times the places of the template that look alike
    per_template = joined.groupBy("doc_id", "row_hash", "t1", "t2").agg(F.collect_set(one).alias("found"))
    members = listed.select("item_id", "n_words", "t1", "t2", "item_words", "item_slots")
    members = F.broadcast(members) if table_bytes(listed) <= BROADCAST_BYTES else members
    judged = per_template.join(members, ["t1", "t2"]).select("doc_id", "item_id", "n_words", "found", "item_words", "item_slots")
    judged = judged.mapInArrow(judge, "doc_id bigint, item_id bigint, n_words bigint, covered bigint, n_places bigint, n_slots bigint, n_consistent bigint, n_unchanged bigint")
    out = judged.withColumn("coverage", F.col("covered") / F.col("n_words"))
    out = out.where((F.col("coverage") >= LEAST_COVERAGE) | (F.col("covered") >= LEAST_COVERED))
    label = F.when(F.col("n_unchanged") == F.col("n_slots"), "verbatim").otherwise("reparameterised")
    return out.select("doc_id", "item_id", "n_words", "covered", "coverage", "n_places", "n_slots", "n_consistent", label.alias("leak"))
