"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all other training documents are unlabelled text that
may hold toxic ones too. Features are the distinct words and four-character pieces of words of a
whole text, and how many of its distinct words begin with the same five characters, hashed into
2**18 buckets. Their document counts over all training rows pick the
buckets that positives hold most significantly more often. A linear numpy classifier then minimises

    prior * E_p[loss(+g)] + max(0, E_u[loss(-g)] - prior * E_p[loss(-g)])

and the decision bound minimises the same estimate of the zero-one loss, both on a sample of at most ``MAX_POSITIVE`` positives and ``MAX_UNLABELLED`` unlabelled rows. The bound
holds for fitting only: counts, and the scores of every document, cover all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from crosswin.llm.tables import Scratch, look_up, text_rows
from crosswin.llm.text import chunks, column_of, list_array, mix, split_words, word_hashes

BUCKETS = 1 << 18
PIECE = 4
STEM = 5
STEM_LEVELS = (1, 2, 3, 5, 8)  # at least so many distinct words with one stem
LEAST_Z = 4.0  # standard errors by which positives must hold a selected bucket more often
MAX_POSITIVE = 5_000
MAX_UNLABELLED = 20_000
FOLDS = 5
EDGES = ".,;:!?\"'()[]{}*#$%&|<>-_"


def held_out(doc_id: str) -> Column:
    """Rows that no label is ever learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def document_features(texts: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the distinct features of each text, by row; ``wanted`` maps buckets to features or -1."""
    words = split_words(pc.utf8_lower(texts))
    n = len(words.vocab)
    vocab = [w.strip(EDGES) for w in words.listed]
    whole = (word_hashes(vocab, 7) % np.uint64(BUCKETS)).astype(np.int64)
    points = np.frombuffer("".join(vocab).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(w) for w in vocab], np.int64)
    owner = np.repeat(np.arange(n), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(points))
    at = np.flatnonzero(left >= PIECE)
    code = np.zeros(len(at), np.uint64)
    for k in range(PIECE):
        code = mix(code * np.uint64(31) + points[at + k])
    stem = np.zeros(n, np.uint64)
    long_enough = lengths >= STEM
    begin = (np.cumsum(lengths) - lengths)[long_enough]
    for k in range(STEM):
        stem[long_enough] = mix(stem[long_enough] * np.uint64(37) + points[begin + k])
    owner = np.concatenate([np.arange(n), owner[at]])
    bucket = np.concatenate([whole, (code % np.uint64(BUCKETS)).astype(np.int64)])
    if wanted is not None:
        bucket = wanted[bucket]
        owner, bucket = owner[bucket >= 0], bucket[bucket >= 0]
    order = np.argsort(owner, kind="stable")
    bucket = bucket[order]
    upto = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
    row = np.repeat(np.arange(len(texts)), words.lengths)
    pairs = np.unique(row * max(n, 1) + words.code)  # each word once a text
    row, word = pairs // max(n, 1), pairs % max(n, 1)
    count = np.diff(upto)[word]
    ends = np.cumsum(count)
    found = bucket[np.repeat(upto[:-1][word] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]
    stemmed = np.flatnonzero(long_enough[word])
    kind = (stem[word[stemmed]] >> np.uint64(24)).astype(np.int64)  # 40 bits name a stem
    order = np.lexsort((kind, row[stemmed]))
    r, s = row[stemmed][order], kind[order]
    new = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (s[1:] != s[:-1]))) if len(r) else np.empty(0, np.int64)
    times = np.diff(np.append(new, len(r)))
    rows, features = [np.repeat(row, count)], [found]
    for level in STEM_LEVELS:
        some = new[times >= level]
        bucket = (mix(s[some].astype(np.uint64) + np.uint64(level << 48)) % np.uint64(BUCKETS)).astype(np.int64)
        bucket = bucket if wanted is None else wanted[bucket]
        rows.append(r[some][bucket >= 0])
        features.append(bucket[bucket >= 0])
    both = np.unique(np.concatenate(rows) * BUCKETS + np.concatenate(features))
    return both // BUCKETS, both % BUCKETS


def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each bucket, among positives and among all, summed over the task."""
    counts = np.zeros((2, BUCKETS), np.int64)
    for batch in chunks(batches):
        row, bucket = document_features(column_of(batch, "text"))
        positive = batch.column("positive").to_numpy(zero_copy_only=False).astype(bool)
        counts[0] += np.bincount(bucket[positive[row]], minlength=BUCKETS)
        counts[1] += np.bincount(bucket, minlength=BUCKETS)
    at = np.flatnonzero(counts[1])
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0][at]), pa.array(counts[1][at])], ["bucket", "p", "u"])


@dataclass
class Classifier:
    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def wanted(self) -> np.ndarray:
        out = np.full(BUCKETS, -1, np.int64)
        out[self.buckets] = np.arange(len(self.buckets))
        return out


def margins(weights: np.ndarray, bias: float, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, weights=weights[feature], minlength=n) + bias


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, n_features: int, epochs: int = 60, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on minibatches of the non-negative risk with logistic loss.

    Each row is the list of its features. The bias is shifted so that the decision bound is 0.
    """
    rng = np.random.default_rng(seed)
    lists = [*positive, *unlabelled]
    p, u = np.arange(len(positive)), len(positive) + np.arange(len(unlabelled))
    theta = np.zeros(n_features + 1)
    theta[-1] = np.log(prior / (1 - prior))
    m, v, step = np.zeros_like(theta), np.zeros_like(theta), 0
    size = max(1, -(-len(u) // 20))
    for _ in range(epochs):
        rng.shuffle(p)
        rng.shuffle(u)
        for k in range(0, len(u), size):
            some_u = u[k:k + size]
            some_p = p[np.arange(k, k + size) % len(p)]
            rows = np.concatenate([some_p, some_u])
            sizes = [len(lists[i]) for i in rows]
            row = np.repeat(np.arange(len(rows)), sizes)
            feature = np.concatenate([lists[i] for i in rows]).astype(np.int64)
            g = margins(theta[:-1], theta[-1], row, feature, len(rows))
            prob = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
            is_p = np.arange(len(rows)) < len(some_p)
            loss_minus = np.logaddexp(0, g)  # the loss of calling a row clean
            negative = loss_minus[~is_p].mean() - prior * loss_minus[is_p].mean()
            up = np.where(is_p, prob / len(some_p), 0.0)
            d_negative = np.where(is_p, -prior * up, prob / len(some_u))
            d_positive = np.where(is_p, prior * (prob - 1) / len(some_p), 0.0)
            # below zero the estimate is overfitted: step back from it instead
            d = d_positive + d_negative if negative >= 0 else -d_negative
            grad = np.append(np.bincount(feature, weights=d[row], minlength=n_features), d.sum()) + np.append(1e-4 * theta[:-1], 0)
            step += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            theta -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    g = margins(theta[:-1], theta[-1], np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists).astype(np.int64), len(lists))
    return theta[:-1], float(theta[-1]) - decision_bound(g[:len(positive)], g[len(positive):], prior)


def decision_bound(g_p: np.ndarray, g_u: np.ndarray, prior: float) -> float:
    """Margin with the least prior-corrected zero-one risk; of equals, the one that flags fewest.

    Risk: prior * missed positives + max(0, flagged unlabelled share - prior * found positives).
    """
    bounds = np.unique(np.concatenate([g_p, g_u]))[::-1]
    bounds = np.concatenate([[bounds[0] + 1], bounds])  # or flag nothing
    found = 1 - np.searchsorted(np.sort(g_p), bounds) / len(g_p)
    flagged = 1 - np.searchsorted(np.sort(g_u), bounds) / len(g_u)
    risk = prior * (1 - found) + np.maximum(0, flagged - prior * found)
    k = int(np.argmin(np.round(risk, 12)))
    return float((bounds[k] + (bounds[k + 1] if k + 1 < len(bounds) else bounds[k] - 1)) / 2)


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Classifier:
    """Fit on labelled toxic documents and unlabelled text outside the held-out fold."""
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marks = marks.where("doc_id is not null and toxic is not null").where(~held_out("doc_id"))
    marks = scratch.put(marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "marks")
    known = marks.agg(F.count("*").alias("n"), F.sum("toxic").alias("p")).first()
    nothing = Classifier(np.empty(0, np.int64), np.empty(0), -30.0)
    if not known.n or not known.p:
        return nothing
    prior = min(0.9, known.p / known.n)
    rows = text_rows(docs).where(~held_out("doc_id"))
    positive = marks.where("toxic = 1").select("doc_id", F.lit(True).alias("positive"))
    rows = look_up(rows, scratch.put(positive, "positive"), ["doc_id"]).withColumn("positive", F.coalesce("positive", F.lit(False)))
    counts = rows.select("text", "positive").mapInArrow(count_features, "bucket bigint, p bigint, u bigint")
    counts = scratch.put(counts.groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("u").alias("u")), "counts")  # at most BUCKETS rows
    sizes = rows.agg(F.count("*").alias("u"), F.sum(F.col("positive").cast("int")).alias("p")).first()
    if not sizes.p:
        return nothing
    share, base = (F.col("p") / F.lit(sizes.p)), (F.col("u") + 1) / F.lit(sizes.u + 2)
    z = (share - base) / F.sqrt(base * (1 - base) / F.lit(sizes.p))
    best = counts.where(z >= LEAST_Z).select("bucket").collect()  # all that pass the test, BUCKETS at most
    buckets = np.array(sorted(r.bucket for r in best), np.int64)
    wanted = Classifier(buckets, np.empty(0), 0.0).wanted()

    def selected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            row, feature = document_features(column_of(batch, "text"), wanted)
            offset = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))])
            names = ["role", "lot", "hash"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), list_array(pa.array(feature, pa.int32()), offset)], [*names, "features"])

    def part(of: DataFrame, n: int, most: int, role: str) -> DataFrame:
        lot = F.pmod(F.xxhash64("doc_id", "text", F.lit("fit")), F.lit(1_000_000))
        rows = of.select("text", F.lit(role).alias("role"), lot.alias("lot"), F.xxhash64("text").alias("hash"))
        drawn = rows.where(F.col("lot") < F.lit(min(1_000_000, int(1_100_000 * most / max(n, 1)) + 100)))
        # the lowest lots, as lists of features, not texts; equal whatever the files' layout
        return drawn.mapInArrow(selected, "role string, lot bigint, hash bigint, features array<int>").orderBy("lot", "hash").limit(most)

    taken = part(rows.where("positive"), sizes.p, max_positive, "p").union(part(rows, sizes.u, max_unlabelled, "u")).toArrow()
    taken = taken.sort_by([("role", "ascending"), ("lot", "ascending"), ("hash", "ascending")])
    lists = {"p": [], "u": []}
    for role, features in zip(taken.column("role").to_pylist(), taken.column("features").to_pylist()):
        lists[role].append(np.asarray(features, np.int32))
    if not lists["p"] or not lists["u"]:
        return nothing
    return Classifier(buckets, *fit(lists["p"], lists["u"], prior, len(buckets)))


def score_toxicity(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per document; predicted is score >= 0.5.

    The classifier is fitted on at most ``max_positive`` labelled toxic documents and
    ``max_unlabelled`` others, drawn by hash; which features it has is decided over all rows.
    The result does not depend on the rows' order or layout.

    Null and empty texts are scored by the bias alone. Rows without doc_id are scored, never
    learnt from and not held out. Labels of one doc_id count as toxic if any is. Without
    toxic labels every score is near 0. Repeated rows get equal scores; an empty table gives
    no rows.
    """
    model = train(docs, labels, Scratch(docs.sparkSession, "toxicity"), max_positive, max_unlabelled)
    wanted = model.wanted()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            row, feature = document_features(column_of(batch, "text"), wanted)
            g = margins(model.weights, model.bias, row, feature, batch.num_rows) if len(model.weights) else np.full(batch.num_rows, model.bias)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(g, -700, 700))))], ["doc_id", "score"])

    scored = text_rows(docs).mapInArrow(score, "doc_id bigint, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
