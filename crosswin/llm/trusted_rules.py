"""Quality rules and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Words and word pairs are hashed into a fixed number of buckets. Two multinomials over the buckets,
one of the documents marked as trusted and one of the whole corpus, give each bucket the log of
its probability ratio, kept as whole millionths so that sums don't depend on their order. A
document's score is the mean over its n-grams, and one threshold decides on every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from crosswin.llm.tables import Scratch, look_up, text_rows

BUCKETS = 1 << 16
MILLION = 1_000_000
OTHER_BLANKS = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
THRESHOLD = -0.1
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def word_array(text: Column) -> Column:
    spaced = F.translate(text, OTHER_BLANKS, " " * len(OTHER_BLANKS))
    return F.array_remove(F.split(spaced, " "), "")


def windows(words: Column) -> Column:
    """Hashes of all runs of five words; none for shorter texts."""
    one = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])
    places = F.sequence(F.lit(0), F.size(words) - WINDOW)
    return F.when(F.size(words) >= WINDOW, F.transform(places, one)).otherwise(F.array().cast("array<bigint>"))


def rule_features(docs: DataFrame) -> DataFrame:
    """doc_id, text, words, and the five counts of the base rules for every row.

    Each array is a column of its own that the next step uses more than once, so the optimizer
    keeps the steps apart and nothing is computed again inside a lambda.
    """
    text = F.coalesce("text", F.lit(""))
    rows = text_rows(docs).select("doc_id", text.alias("text"))
    rows = rows.withColumn("words", word_array(F.col("text"))).withColumn("lines", F.split("text", "\n"))
    worded = F.filter("lines", lambda x: F.length(F.translate(x, " " + OTHER_BLANKS, "")) > 0)
    rows = rows.select("doc_id", "text", "words", windows(F.col("words")).alias("grams"), worded.alias("worded"))
    pairs = F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))
    again = F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.sort_array(pairs))
    rows = rows.select(
        "doc_id", "text", "words", again.alias("again"),
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.translate("text", " " + OTHER_BLANKS, "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("bigint").alias("n_dup_lines"))
    s = F.col("again")
    twice = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["g"] == x["g"], F.lit(False)))
    starts = F.when(s.isNotNull(), F.sort_array(F.transform(twice, lambda x: x["i"])))
    rows = rows.withColumn("starts", starts).drop("again")
    covered = F.aggregate(
        "starts", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"])
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint")).drop("starts")


def buckets(words: Column) -> Column:
    """Bucket of every word and of every pair of neighbours."""
    single = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)))
    pair = F.transform(words, lambda w, i: F.pmod(F.xxhash64(w, F.get(words, i + 1)), F.lit(BUCKETS)))
    return F.concat(single, pair)


def bucket_weights(docs: DataFrame, trusted: DataFrame, scratch: Scratch) -> DataFrame:
    """(bucket, weight): log ratio of trusted to raw probability in millionths, add-one smoothed.

    ``trusted`` holds the distinct doc_ids of the target corpus; the raw corpus is all rows.
    """
    marked = scratch.put(trusted.select("doc_id", F.lit(1).alias("in_target")).distinct(), "trusted")
    rows = look_up(text_rows(docs), marked, ["doc_id"])
    rows = rows.select("in_target", word_array(F.coalesce("text", F.lit(""))).alias("words"))
    grams = rows.select("in_target", F.explode(buckets(F.col("words"))).alias("bucket"), F.size("words"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("in_target").alias("target"))
    counts = scratch.put(counts, "counts")  # at most BUCKETS rows
    total = counts.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).first()
    raw = (F.col("raw") + 1) / F.lit(float((total.raw or 0) + BUCKETS))
    target = (F.col("target") + 1) / F.lit(float((total.target or 0) + BUCKETS))
    return counts.select("bucket", F.round(F.log(target / raw) * MILLION).cast("bigint").alias("weight"))


def weight_list(weights: DataFrame) -> str:
    """The written weights as BUCKETS numbers with commas: folded to a literal of fixed size, so that no row needs a join."""
    every = weights.sparkSession.range(BUCKETS).withColumnRenamed("id", "bucket").join(F.broadcast(weights), "bucket", "left")
    pairs = F.array_sort(F.collect_list(F.struct("bucket", F.coalesce("weight", F.lit(0)).alias("weight"))))
    return every.select("bucket", "weight").agg(F.array_join(F.transform(pairs, lambda p: p["weight"].cast("string")), ",").alias("list")).first()["list"]


def judge_quality(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, features, score, base_failed, kept), one row per document.

    base_failed: fewer than 10 words, or more than a fifth of the words in repeated five-word
    windows. Other documents are kept when the mean log ratio of their n-grams is at least
    ``threshold``. Null text counts as empty and fails, score is null without words. Without
    trusted documents all ratios favour common buckets equally. Repeated rows get a row each
    with equal results; an empty table gives none.
    """
    scratch = Scratch(docs.sparkSession, "trusted")
    weights = F.split(F.lit(weight_list(scratch.put(bucket_weights(docs, trusted, scratch), "weights"))), ",").cast("array<bigint>")
    scratch.drop("trusted", "counts", "weights")
    rows = rule_features(docs).withColumn("buckets", buckets(F.col("words"))).drop("words", "text")
    total = F.aggregate("buckets", F.lit(0).cast("bigint"), lambda total, b: total + F.get(weights, b))
    rows = rows.select("doc_id", *FEATURES, F.when(F.size("buckets") > 0, total).alias("total"), F.size("buckets").cast("bigint").alias("n"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    fits = F.coalesce(F.col("total") >= F.lit(round(threshold * MILLION)) * F.col("n"), F.lit(False))
    return rows.select(
        "doc_id", *FEATURES, (F.col("total") / F.col("n") / MILLION).alias("score"),
        failed.alias("base_failed"), (~failed & fits).alias("kept"))
