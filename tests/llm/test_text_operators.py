import hashlib
import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
import xxhash

from conftest_odd import ODD
from crosswin.llm import line_dedup, piece_codec, pu_toxicity, stages, template_leaks, trusted_rules

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def line_rows():
    r = random.Random(5)
    lines = [f"line {k} of many" for k in range(12)] + ["  Padded LINE 1 ", "line 1 of many", ""]
    return [(100 + k, "\n".join(r.choice(lines) for _ in range(r.randint(1, 9)))) for k in range(40)] + ODD


def brute_lines(rows, min_docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    seen = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            seen.setdefault(key(x), set()).add(i)
    bad = {k for k, ids in seen.items() if k and len(ids) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in bad]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def test_line_dedup_equals_brute_force(make_docs):
    rows = line_rows()
    got = line_dedup.dedup_lines(make_docs(rows), min_docs=10)
    assert Counter(tuple(r) for r in got.drop("row_hash").collect()) == brute_lines(rows, 10)
    staged = stages.with_deduped_lines(make_docs(rows))
    assert Counter((r.doc_id, r.text or "") for r in staged.collect()) == Counter((i, t) for i, _, _, t in brute_lines(rows, 10).elements())


def test_line_dedup_keeps_first_occurrence(make_docs):
    rows = [(k, "a\nb\na" if k % 2 else "B \nc") for k in range(1, 7)]
    got = {r.doc_id: r.kept_text for r in line_dedup.dedup_lines(make_docs(rows), min_docs=2, keep_first=True).collect()}
    assert got == {1: "a\nb", 2: "c", 3: "", 4: "", 5: "", 6: ""}
    assert line_dedup.dedup_lines(make_docs([])).count() == 0


def fuzz_texts():
    r = random.Random(7)
    alphabet = "ab cd  eé漢字\n\t😀▁.,!?0123 the and     "
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(400)] + [" " * 3000, "ab" * 1500, "<s> </s> <0x41>", "a\x00b"]


def test_round_trip_equals_the_library(make_docs):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [*ODD, *enumerate(fuzz_texts(), 100)]
    got = {}
    for r in piece_codec.round_trip(make_docs(rows), MODEL).collect():
        got.setdefault(r.doc_id, (r.n_tokens, r.ids_sha256, r.decoded_sha256))
    for i, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        assert got[i] == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert piece_codec.round_trip(make_docs([]), MODEL).count() == 0


def test_decode_equals_the_library_on_any_ids():
    library, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), piece_codec.PieceCodec(piece_codec.read_model(MODEL))
    import numpy as np

    r = random.Random(9)
    for _ in range(200):
        ids = [r.randrange(1, 400) if r.random() < 0.5 else r.randrange(3, 32000) for _ in range(r.randint(0, 12))]
        assert own.decode(np.array(ids, np.int32), np.array([0, len(ids)])) == [library.decode(ids)]


def test_documents_encode_and_decode(make_docs):
    docs = make_docs([(1, "Hello world"), (2, None), (3, "漢 ab")])
    encoded = piece_codec.encode_documents(docs, MODEL)
    assert {r.doc_id: r.text for r in piece_codec.decode_documents(encoded, MODEL).collect()} == {1: "Hello world", 2: "", 3: "漢 ab"}


def base_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    times, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if times[g] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_rules_and_ratio(spark, make_docs):
    r = random.Random(11)
    good = [(k, " ".join(r.choice("the cat sat on a mat near one big old tree".split()) + str(r.randrange(9)) for _ in range(40))) for k in range(50, 90)]
    junk = [(k, " ".join("#|" + r.choice("xyzw") + str(r.randrange(99)) for _ in range(40))) for k in range(90, 100)]
    rows = [*ODD, *good, *junk, (200, "a b c d e f g a b c d e f g"), (201, "r s\nr s\n\nt # $ t t t t t t t")]
    trusted = spark.createDataFrame([(k,) for k, _ in good[:30]], "doc_id long")
    got = {x.doc_id: x for x in trusted_rules.judge_quality(make_docs(rows), trusted).collect()}
    for i, t in rows:
        want = base_rules(t)
        x = got[i]
        assert tuple(x[f] for f in trusted_rules.FEATURES) == want
        assert x.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (x.kept and x.base_failed)
    assert all(got[k].kept for k, _ in good if not got[k].base_failed) and not any(got[k].kept for k, _ in junk)
    assert trusted_rules.judge_quality(make_docs([]), trusted).count() == 0


def test_toxicity_is_learnt_outside_the_fold(spark, make_docs):
    r = random.Random(13)
    words = ["".join(r.choice("etaoinshr") for _ in range(r.randint(2, 6))) for _ in range(400)]
    rows, labels = [*ODD], []
    for k in range(20, 620):
        toxic = k % 8 == 0
        text = [r.choice(words) for _ in range(60)] + (["nasty", "vilest"] if toxic else [])
        r.shuffle(text)
        rows.append((k, " ".join(text)))
        if k % 3:
            labels.append((k, int(toxic)))
    table = spark.createDataFrame([*labels, (None, 1), (40, None)], "doc_id long, toxic int")
    got = pu_toxicity.score_toxicity(make_docs(rows), table).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got)
    for x in got:
        assert x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 5 == 0)
    fold = [x for x in got if x.held_out and x.doc_id >= 20]
    assert sum(x.predicted == int(x.doc_id % 8 == 0) for x in fold) >= 0.95 * len(fold)
    none = pu_toxicity.score_toxicity(make_docs(rows[:12]), table.where("false")).collect()
    assert len(none) == 12 and not any(x.predicted for x in none)
    assert pu_toxicity.score_toxicity(make_docs([]), table).count() == 0


ITEMS = [
    (0, "Maria bought 12 apples for 3 dollars each and sold 12 apples to a friend of the family on the market square"),
    (1, "Which river flows through the old town before it meets the northern sea"),
    (2, None), (3, ""), (4, "yes no"), (5, "seven words stand in this short line"),
]


def test_leaks(spark, make_docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [
        *ODD, (10, "before this. " + ITEMS[0][1] + " and after."),
        (11, "Now Peter bought 47 apples for 9 euros each and sold 47 apples to a friend of the family on the market square"),
        (12, "Now Peter bought 47 apples for 9 euros each and sold 99 apples to a friend of nobody else anywhere near"),
        (13, "WHICH RIVER FLOWS THROUGH THE OLD TOWN BEFORE IT MEETS THE NORTHERN SEA"), (14, "a river flows through an old town in the south"),
        (15, "so, seven words stand in this short line, indeed"), (16, "1 2 3 4 5 6 7 8 9 10 11 12"),
    ]
    got = {(x.doc_id, x.item_id): x for x in template_leaks.find_leaks(make_docs(rows), bench).collect()}
    assert set(got) == {(10, 0), (11, 0), (13, 1), (15, 5)}
    assert got[10, 0].leak == "verbatim" and got[11, 0].leak == "reparameterised" and got[10, 0].coverage == 1.0
    assert template_leaks.find_leaks(make_docs([]), bench).count() == 0
    assert template_leaks.find_leaks(make_docs(rows), bench.where("false")).count() == 0


def test_items_of_one_template_are_judged_apart(spark, make_docs):
    shop = "Tom has {} red apples in his basket and buys {} green ones from us"
    sums = "add 1 2 3 4 5 to 6 {} 8 9 10 then stop"  # over half are slots
    bench = spark.createDataFrame([(50, shop.format(5, 5)), (51, shop.format(3, 7)), (52, sums.format(7)), (53, sums.format(70)), (54, sums.format(7))], "item_id long, text string")
    rows = [(20, shop.format(3, 7)), (21, sums.format(70)), (22, shop.format(5, 5)), (23, shop.format(4, 9).replace("Tom", "Eve")), (24, sums.format(7))]
    got = {(x.doc_id, x.item_id): x.leak for x in template_leaks.find_leaks(make_docs(rows), bench).collect()}
    assert got[20, 51] == got[21, 53] == got[22, 50] == got[24, 52] == got[24, 54] == "verbatim"
    assert got[23, 51] == "reparameterised" and got.get((20, 50)) != "verbatim" and not {(21, 50), (22, 52), (24, 50)} & set(got)


def test_one_value_in_two_roles_and_changed_case(spark, make_docs):
    tail = "that the old keeper of the house by the long river had left there for the children of the village in the autumn"
    bench = spark.createDataFrame([
        (60, "He took 12 apples and paid 12 coins for all the things " + tail),
        (61, "Maria bought 12 apples for 3 dollars each and sold 7 pears at 2 cents every day"),
    ], "item_id long, text string")
    rows = [
        (20, "He took 47 apples and paid 99 coins for all the things " + tail),
        (21, "MARIA BOUGHT 47 APPLES FOR 9 EUROS EACH AND SOLD 8 PEARS AT 5 POUNDS EVERY DAY"),
        (22, "maria bought 47 apples for 9 euros each and sold 8 pears at 5 pounds every day"),
        (23, "He took 47 apples and paid 99 coins for all the rest"),
    ]
    got = {(x.doc_id, x.item_id): x for x in template_leaks.find_leaks(make_docs(rows), bench).collect()}
    assert set(got) == {(20, 60), (21, 61), (22, 61)} and all(x.leak == "reparameterised" for x in got.values())
    assert got[20, 60].covered >= 20 and got[21, 61].coverage == 1.0


def spark_hash(words, seed=42):
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed)
    return seed % (1 << 64)


def brute_ratio(rows, trusted):
    """doc_id to (score, kept)."""
    grams = {}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams[i] = [spark_hash(g) % trusted_rules.BUCKETS for g in [(w,) for w in words] + [tuple(words[k:k + 2]) for k in range(len(words))]]
    raw = Counter(b for g in grams.values() for b in g)
    target = Counter(b for i, g in grams.items() if i in trusted for b in g)
    n_raw, n_target = (sum(c.values()) + trusted_rules.BUCKETS for c in (raw, target))
    out = {}
    for i, t in rows:
        logs = [math.log((target[b] + 1) / n_target / ((raw[b] + 1) / n_raw)) for b in grams[i]]
        score, want = sum(logs) / len(logs) if logs else None, base_rules(t)
        out[i] = score, bool(logs) and score >= trusted_rules.THRESHOLD and want[0] >= 10 and 5 * want[4] <= want[0]
    return out


def test_ratio_equals_brute_force(spark, make_docs):
    r = random.Random(12)
    rows = [(k, " ".join(r.choice("the cat sat on a mat é # |x".split() + [str(r.randrange(k))]) for _ in range(r.randint(5, 40)))) for k in range(50, 120)]
    rows += [(1, None), (2, ""), (3, "one"), (None, "no id but more than ten words stand in this text here now")]
    rows += [(k, " ".join("own" + str(r.randrange(99)) for _ in range(30))) for k in range(200, 206)]
    ids = set(range(50, 118))
    want = brute_ratio(rows, ids)
    got = trusted_rules.judge_quality(make_docs(rows), spark.createDataFrame([(k,) for k in ids], "doc_id long")).collect()
    assert len(got) == len(rows) and len({x.kept for x in got}) == 2
    for x in got:
        score, kept = want[x.doc_id]
        assert x.score == (None if score is None else pytest.approx(score, abs=2e-6)) and x.kept == kept


def brute_leaks(rows, items):
    """(doc_id, item_id) to (covered, leak), by comparing all windows of all pairs."""
    def words(text):
        bare = [w.strip(template_leaks.EDGES) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        return [(w.lower(), template_leaks.kind(w)) for w in bare if w]

    out, name = {}, template_leaks.NAME
    for i, text in rows:
        for j, item in items:
            a, b = words(text), words(item)
            width, places = min(8, len(b)), {}
            if i is None or len(b) < 4:
                continue
            for p in range(len(a) - width + 1):
                for q in range(len(b) - width + 1):
                    x, y = a[p:p + width], b[q:q + width]
                    fits = x_equal = [u[0] for u in x] == [v[0] for v in y]
                    for kinds in ({template_leaks.NUM, template_leaks.UNIT, name}, {template_leaks.NUM, template_leaks.UNIT}):
                        shape = [[k if k in kinds else w for w, k in side] for side in (x, y)]
                        slots, dense = sum(k in kinds for _, k in x), name in kinds and any(k == name for _, k in x)
                        fits |= shape[0] == shape[1] and (slots <= max(width - 2, width // 2) if dense else 2 * slots <= width)
                    if fits:
                        places.setdefault(p - q, []).append((q, x_equal))
            covered, changed = set(), False
            for d, found in places.items():
                slots = sorted({k for q, _ in found for k in range(q, q + width) if b[k][1] is not None})
                pairs = [(b[k][0], a[k + d][0]) for k in slots]
                distinct, mapping = set(pairs), []
                for pair in sorted(distinct, key=lambda z: (-pairs.count(z), pairs.index(z))):
                    if all(pair[0] != m[0] and pair[1] != m[1] for m in mapping):
                        mapping.append(pair)
                single = [x for x in {x for x, _ in distinct} if len(ys := [y for u, y in distinct if u == x]) == 1 and len([u for u, y in distinct if y == ys[0]]) == 1]
                whole = len(single) >= 0.8 * len({x for x, _ in distinct})
                kept = [q for q, same in found if whole or same or all((b[k][0], a[k + d][0]) in mapping for k in range(q, q + width) if k in slots)]
                covered.update(k for q in kept for k in range(q, q + width))
                changed |= bool(kept) and any(x != y for x, y in pairs)
            if 2 * len(covered) >= len(b) or len(covered) >= 20:
                out[i, j] = len(covered), "reparameterised" if changed else "verbatim"
    return out


def test_leaks_equal_brute_force(spark, make_docs):
    r = random.Random(13)
    pool = "the old house by a river had apples for Maria Tom Eve 3 5 7 12 dollars cents and then".split()
    items = [(k, " ".join(r.choice(pool) for _ in range(r.randint(3, 24)))) for k in range(25)]
    rows = []
    for k in range(60):
        text = r.choice(items)[1]
        for _ in range(r.randint(0, 3)):
            old, new = r.choice([("3", "9"), ("5", "7"), ("Tom", "Ann"), ("Maria", "Tom"), ("cents", "dollars"), ("12", "5"), ("the", "this")])
            text = text.replace(old, new, r.choice([1, -1]))
        rows.append((k, " ".join(["so it is", r.choice([text, text, text.upper(), text.lower()]), "at last"])))
    want = brute_leaks(rows, items)
    found = template_leaks.find_leaks(make_docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id): (x.covered, x.leak) for x in found} == want and len(want) > 30


def test_pipeline_equals_brute_force(spark, make_docs, tmp_path):
    import corpus_pipeline
    from test_jaccard_join import brute

    r = random.Random(14)
    pool = [f"w{k}" for k in range(60)]
    rows = [(k, "\n".join([" ".join(r.choice(pool) for _ in range(24)), r.choice(["shared footer line", f"own line {k}"])])) for k in range(1, 61)]
    rows += [(100 + k, rows[k][1] + r.choice(["", " end"])) for k in range(12)]  # near copies
    rows += [(120 + k, f"vile nasty words{k % 3} " * 6) for k in range(12)]
    rows += [(140, "so " + ITEMS[0][1] + " end"), (141, ITEMS[0][1].replace("12", "47").replace("Maria", "Peter")), (142, None), (143, "")]
    make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(120 <= i < 140)) for i, _ in rows], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, labels = (stages.table(spark, str(tmp_path), n) for n in ("documents", "labels"))
    toxic = {x.doc_id for x in pu_toxicity.score_toxicity(docs, labels).collect() if x.predicted}
    rest = [(i, t) for i, _, _, t in brute_lines([x for x in rows if x[0] not in toxic], 10).elements()]
    firsts = {i for i, n, first in brute(rest, 5, 80) if n == 0 or i == first}
    rest = [x for x in rest if x[0] in firsts]
    leaked = {i for i, _ in brute_leaks(rest, ITEMS)}
    library, want = sentencepiece.SentencePieceProcessor(model_file=MODEL), {}
    for i, t in rest:
        if i not in leaked:
            ids = library.encode(t, add_bos=True, add_eos=True)
            raw = b"".join(x.to_bytes(4, "little") for x in ids)
            want[i] = len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()
    got = {x.doc_id: (x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want and leaked == {140, 141} and toxic and len(firsts) < len(rows) - len(toxic)


def test_dense_items_are_found_again(spark, make_docs):
    item = "Alice gave Bob 5 and Carol 7 while Dave gave Erin 9 and Frank 3 coins"
    changed = "Mary gave Paul 6 and Susan 8 while Peter gave Anna 11 and Henry 4 coins"
    docs = make_docs([(1, "so " + item + " end"), (2, changed), (2, "another text of the same number: " + item), (3, "Alice gave Bob a book")])
    found = template_leaks.find_leaks(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert sorted((x.doc_id, x.leak) for x in found) == [(1, "verbatim"), (2, "reparameterised"), (2, "verbatim")]


def test_lines_below_the_bound_stay_where_ids_repeat(spark, make_docs):
    rows = [(k, f"text {n} of {k}\nthe same line") for k in range(9) for n in range(300)]
    got = line_dedup.dedup_lines(make_docs(rows).repartition(6), min_docs=10).collect()
    assert len(got) == 2700 and not any(x.n_dropped for x in got)
    got = line_dedup.dedup_lines(make_docs([*rows, (9, "the same line")]), min_docs=10).collect()
    assert all(x.n_dropped == 1 for x in got)


def test_scores_do_not_depend_on_the_layout(spark, make_docs):
    r = random.Random(21)
    plain = "the river runs past old houses and quiet fields where people walk every day in spring".split()
    rows = [(k, " ".join(r.choice(plain + ["vile", "nasty"] * (k % 6 == 0)) for _ in range(30))) for k in range(240)]
    labels = spark.createDataFrame([(k, int(k % 6 == 0)) for k in range(0, 240, 2)], "doc_id long, toxic int")
    runs = []
    for n, order in ((1, rows), (7, rows[::-1])):
        got = pu_toxicity.score_toxicity(make_docs(order).repartition(n), labels, max_positive=12, max_unlabelled=60).collect()
        runs.append(sorted((x.doc_id, x.score, x.predicted) for x in got))
    assert runs[0] == runs[1] and len({p for _, _, p in runs[0]}) == 2


def test_risk_equals_plain_python():
    """One step from zero weights: the first gradient sign decides every weight's direction."""
    import numpy as np

    positive, unlabelled = [np.array([0, 1])] * 6, [np.array([1])] * 14 + [np.array([0, 1])] * 6
    weights, bias = pu_toxicity.fit(positive, unlabelled, 0.3, 2, epochs=60)
    score = lambda features: 1 / (1 + math.exp(-(sum(weights[f] for f in features) + bias)))
    assert score([0, 1]) > 0.5 > score([1])
    g_p, g_u = np.array([2.0, 1.0, -1.0]), np.array([2.0, 0.5, -0.5, -1.0, -2.0])
    risks = {}
    for b in (-3, -1.5, -0.75, 0, 0.75, 1.5, 3):
        found, flagged = (g_p > b).mean(), (g_u > b).mean()
        risks[b] = 0.3 * (1 - found) + max(0, flagged - 0.3 * found)
    bound = pu_toxicity.decision_bound(g_p, g_u, 0.3)
    found, flagged = (g_p > bound).mean(), (g_u > bound).mean()
    assert 0.3 * (1 - found) + max(0, flagged - 0.3 * found) <= min(risks.values()) + 1e-12


def test_repeated_rows_are_judged_one_by_one(spark, make_docs):
    rows = [(4, "one two three four five six seven eight nine ten eleven")] * 2 + [(None, None), (5, "")]
    got = trusted_rules.judge_quality(make_docs(rows), spark.createDataFrame([(4,)], "doc_id long")).collect()
    assert Counter(x.doc_id for x in got) == {4: 2, None: 1, 5: 1}
    assert trusted_rules.judge_quality(make_docs([]), spark.createDataFrame([], "doc_id long")).count() == 0
