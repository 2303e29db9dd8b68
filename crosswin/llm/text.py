"""Arrow and numpy helpers that work on whole batches of text inside a task."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLANKS = " \t\n\x0b\x0c\r"
CHUNK_BYTES = 6 << 20  # text handled at once, so that memory stays flat whatever Spark's batches hold


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, before + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column with nulls as empty strings."""
    return pc.fill_null(batch.column(name), "")


def buffers_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and bytes of a text column without nulls."""
    if not len(texts):
        return np.zeros(1, np.int32), np.empty(0, np.uint8)
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int32)[texts.offset:texts.offset + len(texts) + 1]
    octets = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.empty(0, np.uint8)
    return at - at[0], octets


def bytewise(texts: pa.Array, table: np.ndarray) -> pa.Array:
    """Texts with every byte replaced by its entry in a table of 256; bytes of longer characters must stay."""
    at, octets = buffers_of(texts)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(table[octets]))


@dataclass
class Words:
    """Words of a batch: ``code`` indexes ``vocab``; row i holds words offset[i] to offset[i + 1]."""

    code: np.ndarray
    offset: np.ndarray
    vocab: pa.Array

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.offset)

    @cached_property
    def listed(self) -> list[str]:
        return self.vocab.to_pylist()

    def hashes(self) -> np.ndarray:
        """64-bit hash of every word, in text order."""
        return array_hashes(self.vocab)[self.code]


def array_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes: a scrambled number for every byte and its place, added up."""
    at, octets = buffers_of(words)
    lengths = np.diff(at)
    out = np.zeros(len(words), np.uint64)
    if len(octets):
        place = np.arange(len(octets)) - np.repeat(at[:-1], lengths)
        some = np.flatnonzero(lengths)
        out[some] = np.add.reduceat(mix(place.astype(np.uint64) << np.uint64(8) | octets), at[some])
    return mix(out + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_hashes(vocab: list[str], seed: int = 0) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w.encode("utf-8", "surrogatepass"), seed) for w in vocab), dtype=np.uint64, count=len(vocab))


def split_words(texts: pa.Array) -> Words:
    """Maximal runs of characters other than space and U+0009 to U+000D."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten().dictionary_encode()
    code = flat.indices.to_numpy(zero_copy_only=False)
    vocab = flat.dictionary
    offset = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)])
    empty = pc.index(vocab, "").as_py()
    if empty >= 0:  # at the ends of a text
        real = code != empty
        kept = np.concatenate([[0], np.cumsum(real, dtype=np.int64)])
        code, offset = code[real], kept[offset]
    return Words(code, offset, vocab)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(values: np.ndarray, offset: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``width`` values that lies inside one row, and where each run starts."""
    lengths = np.diff(offset)
    left = np.repeat(offset[1:], lengths) - np.arange(len(values))
    start = np.flatnonzero(left >= width)
    acc = np.full(len(start), np.uint64(width))
    for i in range(width):
        acc = mix(acc + values[start + i] * np.uint64(0x9E3779B97F4A7C15))
    return acc, start


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's long."""
    return x.astype(np.uint64, copy=False).view(np.int64)


def list_array(values: pa.Array, offset: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offset.astype(np.int32)), values)
