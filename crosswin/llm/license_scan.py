"""Licences of files by sparse TF-IDF cosine to templates, and by the nearest directory above.

Terms are words and word pairs of the templates. Their document frequencies are counted over the
lines of all files. Every line of every whole text that shares rare enough terms is compared with
all templates in one sparse product, and every span of as many words as a template has, across
lines and comment marks, with that template; the best line or span decides. Files without a licence
of their own inherit that of the nearest ancestor directory that has a licence file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from crosswin.llm.tables import Scratch, look_up
from crosswin.llm.text import chunks, column_of, split_words

# fixed values: notices by which licences are recognised
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version."),
    ("LGPL-2.1", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0, dedicated to the public domain."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
EDGES = ".,;:!?\"'()[]{}<>*#$%&|/"
LEAST_COSINE = 0.75
LEAST_SHARE = 0.5  # of the words of a line or span that the template vocabulary must hold


def bare(word: str) -> str:
    return word.strip(EDGES).lower()


@cache
def vocabulary() -> tuple[dict[str, int], dict[tuple[int, int], int]]:
    """Numbers of the templates' words, and of their word pairs after them."""
    words: dict[str, int] = {}
    pairs: dict[tuple[int, int], int] = {}
    lists = [[bare(w) for w in re.split(r"\s+", t)] for _, t in TEMPLATES]
    for ws in lists:
        for w in ws:
            words.setdefault(w, len(words))
    for ws in lists:
        for a, b in zip(ws, ws[1:]):
            pairs.setdefault((words[a], words[b]), len(words) + len(pairs))
    return words, pairs


def line_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line, term) of all occurrences of vocabulary terms, row of each line, words of each line."""
    words, pairs = vocabulary()
    lists = pc.split_pattern(texts, "\n")
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    split = split_words(lists.flatten())
    stripped = [bare(w) for w in split.listed]
    number = np.array([words.get(w, -1) for w in stripped], np.int64)
    empty = np.array([not w for w in stripped], bool)
    line = np.repeat(np.arange(len(row)), split.lengths)
    code = number[split.code]
    n_words = np.bincount(line[~empty[split.code]], minlength=len(row))
    size = len(words)
    table = np.full(size * size, -1, np.int64)
    for (a, b), k in pairs.items():
        table[a * size + b] = k
    both = np.flatnonzero((code[:-1] >= 0) & (code[1:] >= 0) & (line[:-1] == line[1:]))
    pair = table[code[both] * size + code[both + 1]]
    known = code >= 0
    return (
        np.concatenate([line[known], line[both][pair >= 0]]), np.concatenate([code[known], pair[pair >= 0]]), row, n_words)


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines that hold each term, and (as term -1) all lines with a word, summed over the task."""
    words, pairs = vocabulary()
    n_terms, lines = len(words) + len(pairs), 0
    counts = np.zeros(n_terms, np.int64)
    for batch in chunks(batches):
        line, term, _, n_words = line_terms(column_of(batch, "text"))
        lines += int((n_words > 0).sum())
        counts += np.bincount(np.unique(line * n_terms + term) % n_terms, minlength=n_terms)
    yield pa.RecordBatch.from_arrays([pa.array(range(-1, n_terms), pa.int64()), pa.array([lines, *counts.tolist()], pa.int64())], ["term", "n"])


def template_matrix(idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors of the templates."""
    line, term, _, _ = line_terms(pa.array([t for _, t in TEMPLATES]))
    out = np.zeros((len(TEMPLATES), len(idf)))
    np.add.at(out, (line, term), 1.0)
    out *= idf
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def spans(texts: pa.Array, idf: np.ndarray, matrix: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(template, row, cosine) of the spans near a template, each as long as it or a whole shorter text."""
    words, pairs = vocabulary()
    size, n_terms = len(words), len(idf)
    split = split_words(texts)
    stripped = [bare(w) for w in split.listed]
    real = np.array([bool(w) for w in stripped], bool)[split.code]  # marks of comments are no words
    offset = np.concatenate([[0], np.cumsum(real)])[split.offset]
    code = np.array([words.get(w, -1) for w in stripped], np.int64)[split.code[real]]
    n = len(code)
    table = np.full(size * size, -1, np.int64)
    for (a, b), k in pairs.items():
        table[a * size + b] = k
    pair = np.full(n, -1, np.int64)  # of a word and the next
    both = np.flatnonzero((code[:-1] >= 0) & (code[1:] >= 0))
    pair[both] = table[code[both] * size + code[both + 1]]
    end = np.repeat(offset[1:], np.diff(offset))  # of the text around each word
    first = np.zeros(n, bool)
    first[offset[:-1][np.diff(offset) > 0]] = True
    known = np.concatenate([[0], np.cumsum(code >= 0)])
    summed = lambda values, of: np.concatenate([[0.0], np.cumsum(np.append(values, 0.0)[of])])
    least = [summed(idf**2, of) for of in (code, pair)]  # of the squared norm: counts are at least one
    lengths = [len([w for w in t.split() if bare(w)]) for _, t in TEMPLATES]
    for width in sorted(set(lengths)):
        stop = np.minimum(np.arange(n) + width, end)
        start = np.flatnonzero(((stop - np.arange(n) == width) | first) & (known[stop] - known[:-1] >= LEAST_SHARE * (stop - np.arange(n))))
        stop = stop[start]
        norm = np.sqrt(least[0][stop] - least[0][start] + least[1][stop - 1] - least[1][start])
        for k in (k for k, length in enumerate(lengths) if length == width and len(start)):
            one, two = (summed(idf * matrix[k], of) for of in (code, pair))
            near = np.flatnonzero(one[stop] - one[start] + two[stop - 1] - two[start] >= (LEAST_COSINE - 1e-6) * norm)
            for a in range(0, len(near), 2048):
                some, till = start[near[a:a + 2048], None], stop[near[a:a + 2048], None]
                at = some + np.arange(width)
                inner = np.minimum(at, n - 1)
                held = np.concatenate([np.where(at < till, code[inner], -1), np.where(at < till - 1, pair[inner], -1)], axis=1)
                keys = (np.arange(len(some))[:, None] * n_terms + held)[held >= 0]
                vectors = np.bincount(keys, minlength=len(some) * n_terms).reshape(len(some), n_terms) * idf
                cosine = vectors @ matrix[k] / np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)
                good = cosine >= LEAST_COSINE
                yield k, np.searchsorted(offset, some[good, 0], side="right") - 1, cosine[good]


def scan(files: DataFrame, scratch: Scratch) -> DataFrame:
    """path, license and cosine of each file; license is null where no line or span comes near a template."""
    rows = files.select("path", "text")
    counts = rows.mapInArrow(count_terms, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r.term: r.n for r in counts.collect()}  # as long as the templates' vocabulary
    words, pairs = vocabulary()
    n_terms = len(words) + len(pairs)
    total = found.get(-1, 0)
    idf = np.log((1 + total) / (1 + np.array([found.get(k, 0) for k in range(n_terms)]))) + 1
    matrix = template_matrix(idf)
    names = [n for n, _ in TEMPLATES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            line, term, row, n_words = line_terms(column_of(batch, "text"))
            best, which = np.zeros(batch.num_rows), np.full(batch.num_rows, -1)
            share = np.bincount(line[term < len(words)], minlength=len(row)) >= LEAST_SHARE * n_words
            take = share[line]  # most lines of plain text share few words with any template
            lines, at = np.unique(line[take], return_inverse=True)
            for a in range(0, len(lines), 4096):
                some = (at >= a) & (at < a + 4096) if len(lines) > 4096 else slice(None)
                dense = np.zeros((min(4096, len(lines) - a), n_terms))
                np.add.at(dense, (at[some] - a, term[take][some]), 1.0)
                dense *= idf
                cosine = dense @ matrix.T / np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-12)
                top, of = cosine.argmax(axis=1), row[lines[a:a + 4096]]
                for i in np.flatnonzero(cosine.max(axis=1) >= LEAST_COSINE):
                    if cosine[i, top[i]] > best[of[i]]:
                        best[of[i]], which[of[i]] = cosine[i, top[i]], top[i]
            for k, of, cosine in spans(column_of(batch, "text"), idf, matrix):
                for i, c in zip(of, cosine):
                    if c > best[i] + 1e-9:  # equal but for rounding: the first stays
                        best[i], which[i] = c, k
            yield pa.RecordBatch.from_arrays(
                [batch.column("path"), pa.array([names[k] if k >= 0 else None for k in which], pa.string()), pa.array(best)], ["path", "license", "cosine"])

    return scratch.put(rows.mapInArrow(run, "path string, license string, cosine double"), "scanned")


def directory(path: str) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def scan_licenses(files: DataFrame, license_names: str = "LICENSE|LICENCE|COPYING|NOTICE") -> DataFrame:
    """(path, own_license, cosine, license, license_dir), one row per file.

    ``files`` has path and text. ``license`` is the file's own, else that of the nearest ancestor
    directory whose licence file (by name, before any extension) was recognised; of several in
    one directory the first by path counts. '' is the root directory. Null texts have none of
    their own, null paths inherit nothing; repeated rows repeat; an empty table gives none.
    """
    scratch = Scratch(files.sparkSession, "licenses")
    scanned = scan(files.select(F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text")), scratch)
    scanned = scanned.withColumn("dir", directory("path"))
    name = F.regexp_extract("path", r"([^/.]*)[^/]*$", 1)
    named = scanned.where(F.col("license").isNotNull() & F.upper(name).rlike(f"^({license_names})$"))
    of_dir = scratch.put(named.groupBy("dir").agg(F.min_by("license", "path").alias("found")), "directories")
    # every directory once, with each of its ancestors: a row a level
    dirs = scanned.where("path is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth"), parts.alias("parts"))
    above = above.select("dir", "depth", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("ancestor"))
    met = look_up(above, of_dir.withColumnRenamed("dir", "ancestor"), ["ancestor"], "inner")
    nearest = met.groupBy("dir").agg(F.max_by(F.struct("found", "ancestor"), "depth").alias("near"))
    nearest = scratch.put(nearest, "nearest")
    out = look_up(scanned, nearest, ["dir"])
    return out.select(
        "path", F.col("license").alias("own_license"), "cosine", F.coalesce("license", "near.found").alias("license"),
        F.when(F.col("license").isNull(), F.col("near.ancestor")).alias("license_dir"))
