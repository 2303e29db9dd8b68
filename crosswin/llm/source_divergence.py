"""How far the sources of each language lie apart in their words, in exact whole numbers.

Identical texts of a language are one text with a multiplicity per source, so a text with thousands
of copies is tokenised once: texts that occur once are counted where they are read, repeated ones are
brought together first and their counts are weighted by the copies of each source. Only digests and
counts of terms are shuffled, and of repeated texts one copy per task.

A term that a source lacks has the same probability as every other one it lacks. So a pair (A, B) of
sources needs no dense vectors: its sum starts as if all terms were lacking, a histogram of A's
probabilities and one of B's add what terms of one source change, and the terms that both have are
corrected term by term, by numpy in tasks that hold whole terms and pass on sums per pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from crosswin.llm.tables import Scratch, look_up, tasks
from crosswin.llm.text import bytewise, chunks, column_of, split_words

SCALE = 1_000_000_000
# ASCII letters in lower case, other ASCII as blanks, everything else as it is
TERM_BYTES = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256)], np.uint8)


def term_counts(key: str) -> Callable:
    """Function for mapInArrow over (lang, key, text): per chunk of text, occurrences and texts of each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=2 << 20):
            words = split_words(bytewise(column_of(batch, "text"), TERM_BYTES))
            if not len(words.code):
                continue
            lang, of = (batch.column(c).dictionary_encode() for c in ("lang", key))
            group = lang.indices.to_numpy().astype(np.int64) * len(of.dictionary) + of.indices.to_numpy()
            size = len(words.vocab)
            row = np.repeat(np.arange(batch.num_rows), words.lengths)
            in_text, tf = np.unique(row * size + words.code, return_counts=True)
            pair, at = np.unique(group[in_text // size] * size + in_text % size, return_inverse=True)
            total = np.bincount(at, weights=tf).astype(np.int64)
            group = pair // size
            yield pa.RecordBatch.from_arrays(
                [
                    lang.dictionary.take(pa.array(group // len(of.dictionary))), of.dictionary.take(pa.array(group % len(of.dictionary))),
                    words.vocab.take(pa.array(pair % size)), pa.array(total), pa.array(np.bincount(at).astype(np.int64)),
                ], ["lang", key, "term", "count", "docs"])

    return run


def frequencies(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Written (lang, source, term, count, docs), and (lang, source) of all documents."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(as_text("lang"), as_text("source"), as_text("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    copies = scratch.put(rows.groupBy("lang", "digest", "source").agg(F.count("*").alias("n")), "copies")
    groups = scratch.put(copies.select("lang", "source").distinct(), "groups")
    repeated = copies.groupBy("lang", "digest").agg(F.sum("n").alias("n")).where("n > 1").select("lang", "digest", F.lit(True).alias("again"))
    repeated = scratch.put(repeated, "repeated")
    marked = look_up(rows, repeated, ["lang", "digest"])
    once = marked.where("again IS NULL").select("lang", "source", "text")
    once = once.mapInArrow(term_counts("source"), "lang string, source string, term string, count bigint, docs bigint")
    texts = marked.where("again").dropDuplicates(["lang", "digest"]).select("lang", "digest", "text")
    counted = texts.mapInArrow(term_counts("digest"), "lang string, digest binary, term string, count bigint, docs bigint")
    weights = look_up(copies, repeated, ["lang", "digest"], "left_semi")
    weighted = counted.join(weights, ["lang", "digest"]).select("lang", "source", "term", (F.col("count") * F.col("n")).alias("count"), F.col("n").alias("docs"))
    both = once.unionByName(weighted).groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    return scratch.put(both, "frequencies"), groups


def share(count: str, total: str, terms: str = "v") -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)) in decimals; null without terms."""
    return F.expr(f"1 + cast(({count} + 1) as decimal(20,0)) * cast({SCALE} as decimal(10,0)) div nullif(cast(({total} + {terms}) as decimal(20,0)), 0)")


def gap(p: str, q: str) -> Column:
    """floor((p - q) ** 2 / q)."""
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})")


def both_have(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (lang, term, source, p, p0) sorted by lang and term: per pair of sources, what
    the terms of both change against the sums that treat them as terms of one source."""

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) * (p - q) // q

    def sums(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lang, source = (rows.column(c).dictionary_encode() for c in ("lang", "source"))
        of_lang, of_source = (x.indices.to_numpy().astype(np.int64) for x in (lang, source))
        new = np.concatenate([[True], changes(rows)])
        term, n = np.cumsum(new), len(source.dictionary)
        p, p0 = (rows.column(c).to_numpy() for c in ("p", "p0"))
        keys, values, held = [], [], 0
        widest = int(np.bincount(term).max())
        for step in range(1, widest):
            i = np.flatnonzero(term[step:] == term[:-step])
            for a, b in ((i, i + step), (i + step, i)):
                keys.append((of_lang[a] * n + of_source[a]) * n + of_source[b])
                values.append(f(p[a], p[b]) - f(p[a], p0[b]) - f(p0[a], p[b]) + f(p0[a], p0[b]))
            held += 2 * len(i)
            if held > 1 << 20 or step == widest - 1:
                pair, at = np.unique(np.concatenate(keys), return_inverse=True)
                total = np.zeros(len(pair), np.int64)
                np.add.at(total, at, np.concatenate(values))
                keys, values, held = [pair], [total], 0
        if keys:
            pair, total = keys[0], values[0]
            yield pa.RecordBatch.from_arrays(
                [lang.dictionary.take(pa.array(pair // n // n)), source.dictionary.take(pa.array(pair // n % n)), source.dictionary.take(pa.array(pair % n)), pa.array(total)],
                ["lang", "source", "item", "value"])

    def changes(rows: pa.RecordBatch) -> np.ndarray:
        cut = [pc.not_equal(rows.column(c).slice(1), rows.column(c).slice(0, max(rows.num_rows - 1, 0))).to_numpy(zero_copy_only=False) for c in ("lang", "term")]
        return cut[0] | cut[1]

    kept: list[pa.RecordBatch] = []  # rows whose last term may go on: at most a batch and one term
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*kept, batch]).combine_chunks().to_batches()[0]
        cuts = np.flatnonzero(changes(table))
        if not len(cuts):
            kept = [table]
            continue
        end = int(cuts[-1]) + 1
        yield from sums(table.slice(0, end))
        kept = [table.slice(end)]
    for rest in kept:
        yield from sums(rest)


def ranked(rows: DataFrame, part: str, most: int | None) -> DataFrame:
    """Rows (lang, source, item, value) with part and rank, up to ``most`` of each group."""
    w = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    out = rows.withColumn("rank", F.row_number().over(w))
    out = out if most is None else out.where(F.col("rank") <= most)
    return out.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))


def audit_sources(docs: DataFrame, min_docs: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): for each source of a language, every other one by its
    distance (part ``pair``) and the ``top`` terms it has beyond the language's share (part ``term``).

    Terms are runs of ASCII letters and non-ASCII characters, only A-Z lower-cased; a language keeps
    those of at least ``min_docs`` of its documents. Null lang, source and text are ''. Rows are
    documents, so repeated rows count. A source without kept terms takes part with counts of 0; in
    a language without kept terms all pairs have the value 0. Ties go by item. An empty table gives
    no rows.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    freq, groups = frequencies(docs, scratch)
    of_term = Window.partitionBy("lang", "term")
    entries = freq.select(
        "lang", "source", "term", "count", F.sum("docs").over(of_term).alias("docs"), F.sum("count").over(of_term).alias("total"),
        (F.row_number().over(of_term.orderBy("source")) == 1).alias("first"))
    entries = scratch.put(entries.where(F.col("docs") >= min_docs).drop("docs"), "entries")
    scratch.drop("frequencies", "copies", "repeated")
    langs = scratch.put(entries.where("first").groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("nl")), "langs")
    sizes = scratch.put(entries.groupBy("lang", "source").agg(F.sum("count").alias("ng")), "sizes")
    known = look_up(look_up(groups, sizes, ["lang", "source"]), langs, ["lang"])
    known = known.select("lang", "source", F.coalesce("ng", F.lit(0)).alias("ng"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("nl", F.lit(0)).alias("nl"))
    known = scratch.put(known.withColumn("p0", share("0", "ng")), "known")

    shares = look_up(entries, known, ["lang", "source"], "inner").withColumn("p", share("count", "ng"))
    shares = shares.select("lang", "source", "term", "p", "p0", share("total", "nl").alias("q"))
    shares = scratch.put(shares, "shares")
    terms = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), gap("p", "q").alias("value"))

    by_term = shares.select("lang", "term", "source", "p", "p0").repartition(tasks(docs.sparkSession), "lang", "term").sortWithinPartitions("lang", "term")
    shared = by_term.mapInArrow(both_have, "lang string, source string, item string, value bigint")
    others = scratch.put(known.select("lang", F.col("source").alias("other"), F.col("p0").alias("o0")), "others")
    levels = scratch.put(shares.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("m")), "levels")
    met = look_up(levels, others, ["lang"], "inner").where("source <> other")
    one_has = met.select("lang", F.inline(F.array(
        F.struct(F.col("source"), F.col("other").alias("item"), (F.col("m") * (gap("p", "o0") - gap("p0", "o0"))).alias("value")),
        F.struct(F.col("other").alias("source"), F.col("source").alias("item"), (F.col("m") * (gap("o0", "p") - gap("o0", "p0"))).alias("value")))))
    neither = look_up(known, others, ["lang"], "inner").where("source <> other")
    neither = neither.select("lang", "source", F.col("other").alias("item"), F.coalesce(F.col("v") * gap("p0", "o0"), F.lit(0)).alias("value"))
    pairs = neither.unionByName(one_has).unionByName(shared).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return ranked(pairs, "pair", None).unionByName(ranked(terms, "term", top))
