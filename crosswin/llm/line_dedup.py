"""Line dedup over a range-partitioned, secondarily sorted table of line hashes.

Every document sends one row per distinct line key: a 128-bit hash, its document, and the
positions of its lines. Rows are range-partitioned by (hash, document) and sorted by position too, so
a hot line is cut into several ranges between its documents, never within one. Each range is streamed once with constant
state and tells, per run of equal hashes, how many documents it saw and the first occurrence; only
runs that are frequent, or that touch a range's ends and may go on next door, are passed on and
added up. Frequent keys then mark lines, and each document gets a zlib-compressed bitmap of the
lines it keeps. Text is never shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from crosswin.llm.tables import Scratch, look_up, tasks, text_rows
from crosswin.llm.text import BLANKS, chunks, column_of

KEYS = "doc_id bigint, row_hash bigint, n_lines int, h bigint, g bigint, at array<int>"
RUNS = "h bigint, g bigint, n_docs bigint, doc_id bigint, row_hash bigint, first_at int"


def identified(docs: DataFrame) -> DataFrame:
    return text_rows(docs).withColumn("row_hash", F.xxhash64("doc_id", "text"))


def line_keys(min_chars: int):
    """Function for mapInArrow: one row per document and distinct line key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            out: list[list] = [[] for _ in range(6)]
            lists = pc.split_pattern(column_of(batch, "text"), "\n")
            keys = pc.ascii_lower(pc.ascii_trim(lists.flatten(), characters=BLANKS))
            long_enough = pc.greater_equal(pc.utf8_length(keys), min_chars).to_numpy(zero_copy_only=False)
            keys, start = keys.to_pylist(), 0
            ids, rows = batch.column("doc_id").to_pylist(), batch.column("row_hash").to_pylist()
            for i, n in enumerate(pc.list_value_length(lists).to_pylist()):
                at: dict[str, list[int]] = {}
                for j in range(n):
                    if long_enough[start + j]:
                        at.setdefault(keys[start + j], []).append(j)
                start += n
                for key, places in at.items():
                    digest = xxhash.xxh3_128_digest(key.encode())
                    for column, v in zip(out, (ids[i], rows[i], n, int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True), places)):
                        column.append(v)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, types)], ["doc_id", "row_hash", "n_lines", "h", "g", "at"])

    return run


def stream_runs(min_docs: int):
    """Function for mapInArrow over one sorted range: runs of equal hashes that matter beyond it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, count, first, is_edge = None, None, 0, None, True
        for batch in batches:
            out: list[tuple] = []
            h, g = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "g"))
            ids, rows = batch.column("doc_id").to_pylist(), batch.column("row_hash").to_pylist()
            starts = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])]))
            first_at = batch.column("first_at").to_pylist()
            for a, b in zip(starts, [*starts[1:], len(h)]):
                if (h[a], g[a]) != key:
                    if key is not None and (is_edge or count >= min_docs):
                        out.append((int(key[0]), int(key[1]), count, *first))
                    is_edge = key is None
                    key, last, count = (h[a], g[a]), object(), 0
                    first = (ids[a], rows[a], first_at[a])
                for i in range(a, b):  # repeated rows of a document are neighbours
                    if ids[i] != last:
                        count, last = count + 1, ids[i]
            yield as_runs(out)
        if key is not None:
            yield as_runs([(int(key[0]), int(key[1]), count, *first)])

    return run


def as_runs(rows: list[tuple]) -> pa.RecordBatch:
    names = ["h", "g", "n_docs", "doc_id", "row_hash", "first_at"]
    types = [pa.int64()] * 5 + [pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = []
        for n, dropped in zip(batch.column("n_lines").to_pylist(), batch.column("dropped").to_pylist()):
            keep = np.ones(n, dtype=np.uint8)
            keep[dropped] = 0
            packed.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row_hash"), pa.array(packed, pa.binary())], ["doc_id", "row_hash", "keep"])


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, row_hash, keep) for every document that loses lines; others keep all.

    A line's key is the line without blanks at its ends, A-Z lower-cased. Keys of at least
    ``min_chars`` code points in at least ``min_docs`` different doc_ids lose all their lines;
    with ``keep_first`` the occurrence first by (doc_id, position) stays. ``keep`` holds one
    bit per line, zlib-compressed. Null text is one empty line; rows with a null doc_id count
    as one document; repeated rows get equal bitmaps; an empty table gives an empty one.
    """
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    keys = scratch.put(identified(docs).mapInArrow(line_keys(min_chars), KEYS), "keys")
    ordered = ["h", "g", "doc_id", "row_hash"]
    slim = keys.select(*ordered, F.col("at")[0].alias("first_at"))
    # a doc_id with several texts must not lie on both sides of a range's end, or it counts twice
    ranged = slim.repartitionByRange(tasks(docs.sparkSession), "h", "g", "doc_id").sortWithinPartitions(*ordered, "first_at")
    runs = scratch.put(ranged.mapInArrow(stream_runs(min_docs), RUNS), "runs")
    first = F.min(F.struct(F.col("doc_id").alias("first_doc"), F.col("row_hash").alias("first_row"), "first_at"))
    frequent = runs.groupBy("h", "g").agg(F.sum("n_docs").alias("n_docs"), first.alias("first"))
    frequent = scratch.put(frequent.where(F.col("n_docs") >= min_docs).select("h", "g", "first"), "frequent")
    hits = look_up(keys, frequent if keep_first else frequent.drop("first"), ["h", "g"], "inner")
    if keep_first:
        is_first = F.col("doc_id").eqNullSafe(F.col("first.first_doc")) & (F.col("row_hash") == F.col("first.first_row"))
        hits = hits.withColumn("at", F.when(is_first, F.filter("at", lambda x: x != F.col("first.first_at"))).otherwise(F.col("at")))
    dropped = hits.groupBy("doc_id", "row_hash", "n_lines").agg(F.flatten(F.collect_set("at")).alias("dropped"))
    kept = scratch.put(dropped.mapInArrow(bitmaps, "doc_id bigint, row_hash bigint, keep binary"), "bitmaps")
    scratch.drop("keys", "runs", "frequent")
    return kept


@F.pandas_udf(StringType())
def kept_text(text: pd.Series, keep: pd.Series) -> pd.Series:
    """The lines of each text that its bitmap keeps; a null bitmap gives null."""
    out = []
    for t, packed in zip(text, keep):
        if packed is None:
            out.append(None)
            continue
        lines = (t or "").split("\n")
        bits = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), count=len(lines))
        out.append("\n".join(lines[i] for i in np.flatnonzero(bits)))
    return pd.Series(out, dtype=object)


def keep_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        out, n_lines, n_dropped = [], [], []
        for text, packed in zip(column_of(batch, "text").to_pylist(), batch.column("keep").to_pylist()):
            lines = text.split("\n")
            n, kept = len(lines), lines
            if packed is not None:
                keep = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), count=n)
                kept = [lines[i] for i in np.flatnonzero(keep)]
            out.append("\n".join(kept))
            n_lines.append(n)
            n_dropped.append(n - len(kept))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row_hash"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(out, pa.string())],
            ["doc_id", "row_hash", "n_lines", "n_dropped", "kept_text"])


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """(doc_id, row_hash, n_lines, n_dropped, kept_text), one row per document. See keep_bitmaps."""
    kept = keep_bitmaps(docs, min_docs, min_chars, keep_first)
    with_bits = look_up(identified(docs), kept, ["doc_id", "row_hash"])
    return with_bits.mapInArrow(keep_lines, "doc_id bigint, row_hash bigint, n_lines bigint, n_dropped bigint, kept_text string")
