"""Spelling variants, Feistel shards and source divergence against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from conftest_odd import ODD
from crosswin.llm import feistel_shards, source_divergence, spelling_variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def brute_variants(rows, min_length=6, min_count=5, ratio=5, modulus=199):
    n = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % modulus == 0 else run] += 1
    words = {w: c for w, c in n.items() if len(w) >= min_length and c >= min_count}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, c in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= ratio * c else None
    out = set()
    for w, c in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, c, len(near[w]), words[form[w]] if form[w] else None))
    return out


def test_variants_equal_brute_force(make_docs):
    r = random.Random(31)
    stems = ["".join(r.choice("abcdeéÀ×") for _ in range(r.randint(5, 11))) for _ in range(25)] + ["x" * 90]
    stems += ["analyse", "anal" + "ize", "wordword", "wordwor", "wordwordw", "drowword"]
    slips = []
    for w in stems:
        for _ in range(6):
            k = r.randrange(len(w))
            slips.append(r.choice([w[:k] + w[k + 1:], w[:k] + r.choice("abé") + w[k:], w[:k] + r.choice("abé") + w[k + 1:]]))
    pool = stems * 12 + [s for s in slips for _ in range(r.choice([1, 3, 7]))]
    rows = [(k, "; ".join(r.choice([w, w.upper(), w]) for w in r.choices(pool, k=150))) for k in range(60)]
    rows += [(200 + k, "zchaina " * 8 + "zchainab " * (k < 40) + "zchainabc" * (k < 6)) for k in range(60)]  # forms of forms
    rows += [*ODD, (3, None), (61, "漢" + "abcdeé" * 3)]
    got = spelling_variants.group_variants(make_docs(rows), modulus=7).collect()
    want = brute_variants(rows, modulus=7)
    assert len(got) == len(want) and {tuple(x) for x in got} == want
    assert sum(f is not None for _, f, *_ in want) > 5 and any(f and root != f for _, f, root, *_ in want)


def test_variants_of_nothing(make_docs):
    assert spelling_variants.group_variants(make_docs([])).count() == 0
    assert spelling_variants.group_variants(make_docs([(1, None), (2, ""), (None, "short words")])).count() == 0
    got = spelling_variants.group_variants(make_docs([(None, "same words of length " * 6)] * 2)).collect()
    assert {(x.word, x.n, x.n_near, x.form, x.root) for x in got} == {("length", 12, 0, None, "length")}


def test_checksums_of_joined_parts():
    import numpy as np

    shift = spelling_variants.Shift()
    for head, tail in ((b"12:", b"word"), (b":", b""), (b"-7:", "é".encode() * 20)):
        joined = shift(np.array([zlib.crc32(head)], np.uint32), len(tail))[0] ^ np.uint32(zlib.crc32(tail))
        assert int(joined) == zlib.crc32(head + tail)


@pytest.mark.parametrize("n", (1, 2, 3, 10, 97, 1000))
def test_places_are_permuted_and_computable(spark, n):
    from pyspark.sql import functions as F

    steps = feistel_shards.walks(spark, n, 5)
    got = spark.range(n).select("id", feistel_shards.permuted(F.col("id"), n, 5, steps).alias("p")).collect()
    assert sorted(x.p for x in got) == list(range(n))
    places = spark.createDataFrame([(x.p % 7, x.p // 7, x.id) for x in got] + [(7, 0, None), (0, n, None), (None, 0, None)], "shard int, slot long, want long")
    assert all(x.row == x.want for x in feistel_shards.rows_at(places, n, 7, 5).collect())


def test_shards_are_even_and_the_layout_does_not_matter(spark, make_docs, tmp_path):
    rows = [*ODD, *[(None, "same")] * 9, *[(20, "hot")] * 50, *[(k, f"text {k}") for k in range(30, 90)]]
    runs = []
    for n, order in ((1, rows), (5, rows[::-1])):
        got = feistel_shards.assign(make_docs(order).repartition(n), shards=7, seed=3).collect()
        assert len(got) == len(rows) and sorted(x.row for x in got) == list(range(len(rows)))
        for shard in range(7):
            slots = sorted(x.slot for x in got if x.shard == shard)
            assert slots == list(range(len(slots))) and len(slots) in (len(rows) // 7, len(rows) // 7 + 1)
        runs.append(Counter((x.doc_id, x.size, x.text_crc32, x.shard, x.slot) for x in got))
    assert runs[0] == runs[1]
    assert Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows) == Counter(x[:3] for x in runs[0].elements())
    other = feistel_shards.assign(make_docs(rows), shards=7, seed=4).collect()
    assert Counter((x.doc_id, x.size, x.text_crc32, x.shard, x.slot) for x in other) != runs[0]
    assert feistel_shards.assign(make_docs([])).count() == 0
    path = str(tmp_path / "shards")
    feistel_shards.write_shards(make_docs(rows), path, shards=7, seed=3)
    back = spark.read.parquet(path)
    assert {"text", "lang", "h", "words"} <= set(back.columns)
    assert Counter((x.doc_id, x.size, x.text_crc32, x.shard, x.slot) for x in back.collect()) == runs[0]


def brute_audit(rows, min_docs, top):
    rows = [tuple(v or "" for v in r) for r in rows]
    out = set()
    for lang in {x for x, _, _ in rows}:
        docs, counts = Counter(), {s: Counter() for x, s, _ in rows if x == lang}
        for x, s, text in rows:
            if x == lang:
                terms = [t.translate(LOWER) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
                docs.update(set(terms))
                counts[s].update(terms)
        kept = [t for t, n in docs.items() if n >= min_docs]
        total = Counter()
        for c in counts.values():
            total.update(c)

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(total)
        f = lambda x, y: (x - y) * (x - y) // y
        for s in counts:
            pairs = {o: sum(f(p[s][t], p[o][t]) for t in kept) for o in counts if o != s}
            terms = {t: f(p[s][t], q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]}
            for part, values, most in (("pair", pairs, None), ("term", terms, top)):
                order = sorted(values, key=lambda k: (-values[k], k.encode()))[:most]
                out |= {(lang, s, part, k, values[k], i + 1) for i, k in enumerate(order)}
    return out


def test_audit_equals_brute_force(spark):
    r = random.Random(32)
    words = "the cat SAT on Ein é漢字 mat x-y 7up don't Ünder".split()
    rows = []
    for k in range(120):
        rows.append((r.choice(["en", "de", None]), r.choice(["a", "b", "c", None, "é"]), " ".join(r.choice(words + [f"w{r.randrange(12)}q"]) for _ in range(r.randint(0, 25)))))
    rows += [("en", r.choice("ab"), "one text with many copies, the cat")] * 40 + [("en", "d", None), ("en", "e", "123 ..."), ("fr", "a", "rare"), ("fr", "b", "")]
    rows += [("xx", "solo", "alone " * 5)]
    docs = spark.createDataFrame([(k, t, lang, s, 1, 2) for k, (lang, s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n int, p int")
    got = source_divergence.audit_sources(docs.repartition(3), min_docs=3, top=4).collect()
    want = brute_audit(rows, 3, 4)
    assert len(got) == len(want) and {tuple(x) for x in got} == want
    assert any(part == "pair" and v == 0 for _, _, part, _, v, _ in want)
    assert source_divergence.audit_sources(docs.where("false")).count() == 0


def test_terms_of_batches_cut_anywhere():
    import pyarrow as pa

    names = ["lang", "term", "source", "p", "p0"]
    rows = [("en", t, s, 10 + 7 * i, 3 + i) for t in "abcd" for i, s in enumerate("xyz")] + [("fr", "d", "x", 9, 2), ("fr", "d", "y", 4, 3)]

    def run(cuts):
        batches = [pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows[a:b]]) for a, b in zip([0, *cuts], [*cuts, len(rows)]) if a < b]
        out = Counter()
        for b in source_divergence.both_have(iter(batches)):
            for x in b.to_pylist():
                out[x["lang"], x["source"], x["item"]] += x["value"]
        return out

    assert run([]) == run([1]) == run([2, 5, 6]) == run(list(range(1, len(rows)))) and len(run([])) == 8
