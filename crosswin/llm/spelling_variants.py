"""Spelling variants: words one edit apart, each pointed at its most frequent neighbour.

A word's letters are a multiset, written as a binary vector with one place per (letter, how many-th
of its kind). One inserted, deleted or replaced letter changes at most two places. The places fall
into four parts, so two near words agree on two whole parts at least; every choice of two parts is
a signature (partition and enumerate), and equal signatures are found by an equi-join, never by
comparing words with each other.

Syllables make many anagrams, so a signature also holds what an edit leaves where it was: of a pair
whose shorter word has m letters, either the first two thirds of m agree, or the last two, or the first
and the last one. A word sends its signatures for m as long as itself and for m one shorter, where
it is the longer word. What meets is verified by edit distance.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from crosswin.llm.tables import Scratch, look_up, text_rows
from crosswin.llm.text import buffers_of, chunks, column_of, mix, signed, split_words

PARTS, KEPT = 4, 2  # two differing places spoil two parts of four
CRC_BYTES = np.zeros(256, np.uint32)
for _i in range(256):
    _c = _i
    for _ in range(8):
        _c = _c >> 1 ^ 0xEDB88320 if _c & 1 else _c >> 1  # the polynomial of CRC-32
    CRC_BYTES[_i] = _c
LONG = 64  # bytes from which a checksum is computed directly


def letter_runs(texts: pa.Array) -> pa.Array:
    """Texts with A-Z in lower case and all but a-z and U+00C0 to U+00FF as blanks."""
    at, octets = buffers_of(texts)
    low = octets | np.where((octets >= 65) & (octets <= 90), 32, 0).astype(np.uint8)
    latin = octets == 0xC3  # leads U+00C0 to U+00FF
    follows = np.concatenate([[False], latin[:-1]])[:len(octets)]
    keep = (low >= 97) & (low <= 122) | latin | follows
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.where(keep, low, 32).astype(np.uint8)))


class Shift:
    """What ``length`` further zero bytes make of a CRC-32: tables for its four bytes, per length."""

    def __init__(self):
        self.tables: dict[int, np.ndarray] = {}

    def __call__(self, crc: np.ndarray, length: int) -> np.ndarray:
        if length not in self.tables:
            state = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
            for _ in range(length):
                state = state >> np.uint32(8) ^ CRC_BYTES[state & np.uint32(255)]
            self.tables[length] = state
        t = self.tables[length]
        return t[0][crc & 255] ^ t[1][crc >> 8 & 255] ^ t[2][crc >> 16 & 255] ^ t[3][crc >> 24]


def word_counts(min_length: int, modulus: int):
    """Function for mapInArrow over (doc_id, text): (word, n) per chunk of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = Shift()
        for batch in chunks(batches, limit=2 << 20):
            words = split_words(letter_runs(column_of(batch, "text")))
            points = pc.utf8_length(words.vocab).to_numpy()
            row = np.repeat(np.arange(batch.num_rows), words.lengths)
            long_enough = points[words.code] >= min_length  # an edit shortens
            size = max(len(words.vocab), 1)
            pair, times = np.unique(row[long_enough] * size + words.code[long_enough], return_counts=True)
            if not len(pair):
                continue
            row, code = pair // size, pair % size
            heads = [b"%d:" % i if i is not None else b":" for i in batch.column("doc_id").to_pylist()]
            listed = words.listed
            spelled = [w.encode() if points[k] >= min_length else b"" for k, w in enumerate(listed)]
            head = np.array([zlib.crc32(h) for h in heads], np.uint32)
            own = np.array([zlib.crc32(w) for w in spelled], np.uint32)
            lengths = np.array([len(w) for w in spelled])[code]
            h = np.empty(len(pair), np.uint32)
            order = np.argsort(lengths, kind="stable")
            cuts = np.flatnonzero(np.diff(lengths[order])) + 1
            for of in np.split(order, cuts):
                n = int(lengths[of[0]])
                if n < LONG:
                    h[of] = shift(head[row[of]], n) ^ own[code[of]]
                else:
                    h[of] = [zlib.crc32(spelled[c], int(head[r])) for r, c in zip(row[of], code[of])]
            hit = h % modulus == 0
            counts = np.bincount(code[~hit], weights=times[~hit], minlength=size).astype(np.int64)
            some = np.flatnonzero(counts)
            new = []
            for c, at in zip(code[hit], h[hit].tolist()):
                at %= int(points[c])
                new.append(listed[c][:at] + listed[c][at + 1:])
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([words.vocab.take(pa.array(some)), pa.array(new, pa.string())]), pa.array(np.concatenate([counts[some], times[hit]]).astype(np.int64))],
                ["word", "n"])

    return run


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (word, n): (sig, word, n, own); ``own`` when the word is as long as the shorter of a pair."""
    places: dict[tuple[str, int], tuple[int, int]] = {}

    def place(letter: str, nth: int) -> tuple[int, int]:
        key = (letter, nth)
        if key not in places:
            digest = xxhash.xxh64_intdigest(f"{letter}{nth}")
            places[key] = digest % PARTS, digest >> 1
        return places[key]

    for batch in batches:
        words = batch.column("word").to_pylist()
        parts = np.zeros((len(words), PARTS), np.uint64)
        kept = np.zeros((len(words), 2, 3), np.uint64)
        for i, word in enumerate(words):
            seen: dict[str, int] = {}
            sums = [0] * PARTS
            for letter in word:
                seen[letter] = nth = seen.get(letter, 0) + 1
                part, value = place(letter, nth)
                sums[part] += value
            parts[i] = [s & 0xFFFFFFFFFFFFFFFF for s in sums]
            for longer in (0, 1):
                m, n = len(word) - longer, len(word)
                third, two = m // 3, 2 * m // 3
                for k, stays in enumerate((word[:two], word[n - two:], word[:m - two] + "|" + word[n - (m - two):])):
                    kept[i, longer, k] = xxhash.xxh64_intdigest(f"{m}{'<>|'[k]}{stays}")
        sigs = []
        for choice in combinations(range(PARTS), KEPT):
            chosen = np.full(len(words), sum(1 << p for p in choice), np.uint64)
            for p in choice:
                chosen = mix(chosen + parts[:, p])
            sigs.append(mix(chosen[:, None, None] + kept))
        sig = np.stack(sigs, axis=1).reshape(len(words), -1)  # word, choice, longer, kind
        own = np.tile(np.repeat([True, False], 3), len(sigs))
        at = np.repeat(np.arange(len(words)), sig.shape[1])
        for start in range(0, len(at), 1 << 16):
            some = slice(start, start + (1 << 16))
            which = pa.array(at[some])
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(sig.reshape(-1)[some])), batch.column("word").take(which), batch.column("n").take(which), pa.array(np.tile(own, len(words))[some])],
                ["sig", "word", "n", "own"])


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """Written (word, n, other, other_n): both directions of all pairs one edit apart."""
    sent = scratch.put(words.mapInArrow(signatures, "sig bigint, word string, n bigint, own boolean"), "signatures")
    short = sent.where("own").select("sig", "word", "n")
    met = sent.select("sig", F.col("word").alias("other"), F.col("n").alias("other_n"), "own")
    pairs = short.join(met, "sig").where("(NOT own OR word < other)").where(F.levenshtein("word", "other", 1) == 1)
    pairs = pairs.select("word", "n", "other", "other_n").distinct()
    both = pairs.select(F.inline(F.array(
        F.struct("word", "n", "other", "other_n"),
        F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))))
    out = scratch.put(both, "near")
    scratch.drop("signatures")
    return out


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root): the end of the forms from each word that has one. Every round doubles the way
    gone; frequencies grow along it, so the rounds are few."""
    now, n = scratch.put(forms.select("word", F.col("form").alias("root")), "roots-0"), 0
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = look_up(now, ahead, ["root"]).select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        n += 1
        new = scratch.put(new, f"roots-{n}")
        scratch.drop(f"roots-{n - 1}")
        now = new.select("word", "root")
        if new.where("moved").isEmpty():
            return now


def group_variants(docs: DataFrame, min_length: int = 6, min_count: int = 5, ratio: int = 5, modulus: int = 199) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per word of ``min_length`` code points and
    ``min_count`` occurrences in the whole texts.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, only A-Z lower-cased. Where ``modulus`` divides
    h = crc32('<doc_id>:<run>'), the run loses its code point h mod length; a null doc_id is written
    as nothing, so is a null text. Two words are near if one inserted, deleted or replaced code point
    makes one the other. ``form`` is the near word with the largest n (ties: the first by code
    points) if that n is at least ``ratio`` times the word's, ``root`` the end of the forms from the
    word on, itself without one. Repeated rows count again; an empty table gives none.
    """
    scratch = Scratch(docs.sparkSession, "variants")
    counted = text_rows(docs).mapInArrow(word_counts(min_length, modulus), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    words = scratch.put(counted.where((F.col("n") >= min_count) & (F.length("word") >= min_length)), "words")
    near = near_words(words, scratch)
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    around = near.groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    enough = -F.col("best.less") >= ratio * F.col("n")
    around = around.select(
        "word", "n_near", F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))
    around = scratch.put(around, "around")
    scratch.drop("near")
    ends = roots(around.where("form IS NOT NULL"), scratch)
    out = look_up(look_up(words, around, ["word"]), ends, ["word"])
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")
