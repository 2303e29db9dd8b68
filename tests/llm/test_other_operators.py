import gzip
import re

import pytest

from conftest_odd import ODD
from crosswin.llm import digest_filter as D, feistel_pii as P, license_scan, stages, warc_derive as W
from crosswin.llm.queries import ORACLES, QUERIES
from compare import compare

KEY = b"sixteen byte key"
DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    state, note, _, _ = compare(spark, duck, name, QUERIES[name], ORACLES[name], DIR)
    assert state == "ok", note


def test_permutation_is_one_to_one():
    for size in (2, 3, 10, 97, 1000):
        assert sorted(P.permute(v, size, KEY, "k") for v in range(size)) == list(range(size))
    assert P.permute(5, 1000, KEY, "a") != P.permute(5, 1000, KEY, "b") or P.permute(6, 1000, KEY, "a") != P.permute(6, 1000, KEY, "b")


def test_findings_keep_format_and_link_values():
    text = "card 4111 1111 1111 1111, 4111-1111-1111-1111 not 4111111111111112; on 2024-02-29 not 2023-02-29, 29.02.2024; ip 10.0.0.7 8.8.8.8 300.1.1.1; a.b1@x.example.com; +1 (212) 555-0100; DE89370400440532013000"
    found = P.find(text, KEY)
    kinds = [k for _, _, k, _ in found]
    assert kinds == ["card", "card", "date", "date", "ip", "ip", "mail", "phone", "account"]
    new = {text[a:b]: n for a, b, _, n in found}
    for old, pseudonym in new.items():
        assert re.sub(r"\d", "0", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", old))).count("-") == pseudonym.count("-") and old != pseudonym
    cards = [re.sub(r"\D", "", n) for a, b, k, n in found if k == "card"]
    assert cards[0] == cards[1] and P.luhn(cards[0][:-1]) == cards[0][-1]
    y, m, d = new["2024-02-29"].split("-")
    assert new["29.02.2024"] == f"{d}.{m}.{y}"
    assert P.is_private(int.from_bytes(bytes(map(int, new["10.0.0.7"].split("."))), "big"))
    assert P.account(new["DE89370400440532013000"], KEY) is not None
    assert P.find(text, b"another 16 bytes")[0][3] != found[0][3]


def test_numbers_before_other_numbers_are_found():
    card, bank = "4111 1111 1111 1111", "DE89 3704 0044 0532 0130 00"
    for text, want in [
        (f"card {card} 12/25", card), ("4111111111111111 123 x", "4111111111111111"), (f"{bank} EUR", bank), (f"GB12 {bank} COBADEFF", bank),
        ("DE89370400440532013000 2024 paid", "DE89370400440532013000"), (f"7 12 {card}", card), (f"12-34-56 {card} 7", card), (f"99-{card.replace(' ', '-')}-1", card.replace(" ", "-")),
        (f"{card} 29.02.2024", card), ("MT84 MALT 0110 0001 2345 MTLC AST0 01S", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"), ("GR1601101250000000012300695 AB", "GR1601101250000000012300695"),
    ]:
        assert want in [text[a:b] for a, b, k, _ in P.find(text, KEY) if k in ("card", "account")], text
    assert [k for _, _, k, _ in P.find("1111 1111 1111 1111 and 1234 5678 and DE00 3704 0044 0532 0130 00 EUR", KEY)] == []


def test_pseudonymise_rows(make_docs):
    rows = [*ODD, (20, "mail me at jo.doe@mail.example.org today"), (21, "jo.doe@mail.example.org")]
    got = {r.doc_id: r for r in P.pseudonymise(make_docs(rows), KEY).collect()}
    assert got[1].new_text is None and got[2].new_text == "" and not got[5].found
    f = got[20].found[0]
    assert rows[-2][1][:f.start] + f.pseudonym + rows[-2][1][f.start + f.length:] == got[20].new_text and got[21].new_text == f.pseudonym
    assert P.findings(make_docs([]), KEY).count() == 0
    with pytest.raises(ValueError):
        P.pseudonymise(make_docs(rows), b"short")


def test_every_kind_reaches_the_search(make_docs):
    rows = [(1, "token=" + "abcdef" * 4), (2, "on \u0662\u0660\u0662\u0664-\u0660\u0661-\u0660\u0662 it was"), (3, "API_KEY: " + "ABCDEF" * 5), (4, "nothing here"), (5, "a.b@c.example")]
    got = P.findings(make_docs(rows), KEY).collect()
    assert sorted((r.doc_id, r.kind) for r in got) == sorted((i, k) for i, t in rows for _, _, k, _ in P.find(t, KEY))
    assert {r.doc_id for r in got} >= {1, 3, 5}


def test_phones_keep_their_country_and_link():
    new = lambda text: P.find(text, KEY)[0][3]
    assert new("+49 30 1234567").startswith("+49 ") and new("+380 44 123 4567").startswith("+380 ")
    plain = [re.sub(r"\D", "", new(t))[-10:] for t in ("+1 (212) 555-0100", "(212) 555-0100", "212-555-0100")]
    assert len(set(plain)) == 1 and plain[0] != "2125550100"


def test_find_equals_brute_force():
    """Every span of a text that a kind's pattern matches whole and its check accepts is found, or overlaps one that is."""
    import random

    r = random.Random(3)
    pieces = ["4111 1111 1111 1111", "5500005555555559", "2024-02-29", "31/12/1999", "123-45-6789", "8.8.8.8", "DE89370400440532013000", "jo@x.example.org", "+49 30 1234567", "12", "999", "AB", "of", "token=" + "0af" * 9]
    for _ in range(150):
        text = " ".join(r.choice(pieces) for _ in range(r.randint(1, 7)))
        found = P.find(text, KEY)
        taken = {k for a, b, _, _ in found for k in range(a, b)}
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:]))
        for kind, pattern, replace in P.KINDS:
            for m in pattern.finditer(text):
                if replace(m.group(), KEY) is not None:
                    assert taken & set(range(*m.span())), (kind, m.group(), text)


PAGES = [
    (1, "http://a.example.org/es/x?q#f"), (2, "https://WWW.Example.ORG/en/15"), (3, "http://example.org.evil.net/es/"), (4, None), (5, "no scheme"),
    (6, "x://b.com/de/1"), (6, "x://b.com/de/1"), (7, "x://bad.net/spam?u=http://org/"), (8, "x://bad.net/spam"), (9, "x://org"), (10, "://"), (None, "x://fine.net/"),
]
RULES = [D.Rule(True, "org", "/"), D.Rule(False, "example.org", "/es/"), D.Rule(False, "example.org", "/en/1"), D.Rule(False, "com", "/de/")]


def test_url_filter_small_and_sharded(spark, monkeypatch):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in PAGES], "page_id long, url string, key string")
    listed = spark.createDataFrame([("bad.net/spam",), ("",), (None,), ("other.net/",), ("bad.net/spam",)], "key string")
    want = {1: ("example.org/es/", "block"), 2: ("example.org/en/1", "block"), 3: (None, "allow"), 4: (None, "allow"), 5: (None, "allow"), 6: ("com/de/", "block"), 7: (None, "block"), 8: (None, "block"), 9: (None, "allow"), 10: (None, "allow"), None: (None, "allow")}
    monkeypatch.setattr(D, "SHARD_ROWS", 2)
    monkeypatch.setattr(D, "PROBE_ROWS", 3)
    for limit in (1 << 20, 0):
        got = D.filter_pages(pages, listed, RULES, limit).collect()
        assert len(got) == len(PAGES) and {r.page_id: (r.rule, r.verdict) for r in got} == want
    assert {r.verdict for r in D.filter_pages(pages, listed.where("false"), [], 1 << 20).collect()} == {"allow"}
    assert D.filter_pages(pages.where("false"), listed, RULES).count() == 0


def test_equal_digests_are_told_apart():
    shard = D.Shard({"digests": b"\0" * 16, "ends": (3).to_bytes(8, "little") + (6).to_bytes(8, "little"), "strings": b"abcdef", "allows": b"\0\1", "n": 2})
    import numpy as np

    assert shard.find([b"def", b"xyz", b"abc"], np.zeros(3, np.int64)).tolist() == [1, -1, 0]


def test_warc_records(spark, tmp_path):
    http = "HTTP/1.1 200 OK\r\nServer: x\r\nSet-Cookie: a=b\r\n\r\n"
    html = "<html><head><title>A &amp; B</title><style>p{}</style></head><body><!-- no --><p>One<br>two &lt;3</p><script>var x='</p>';</script><a href=\"/l?a=1&amp;b=2\">go</a>"
    rows = [("<urn:uuid:1>", "http://x/", "2024-01-01T00:00:00Z", http + html, 7), ("<urn:uuid:2>", None, None, None, 8), ("<urn:uuid:3>", "u", "d", "no headers here", 9)]
    responses = spark.createDataFrame(rows, "record_id string, target_uri string, warc_date string, block string, headers int")
    got = {(r.refers_to, r.record_type): r for r in W.derive(responses).collect()}
    assert len(got) == 6
    meta, text = got["<urn:uuid:1>", "metadata"], got["<urn:uuid:1>", "conversion"]
    assert meta.block == "http-status-line: HTTP/1.1 200 OK\r\ntitle: A & B\r\nhttp-header: Server: x\r\nhttp-header: Set-Cookie: a=b\r\noutlink: /l?a=1&b=2\r\n"
    assert text.block == "One\ntwo <3\ngo" and f"Content-Length: {len(text.block)}" in text.headers and "WARC-Refers-To: <urn:uuid:1>" in text.headers
    assert got["<urn:uuid:2>", "conversion"].block == "" and "Target" not in got["<urn:uuid:2>", "conversion"].headers
    assert got["<urn:uuid:3>", "conversion"].block == "no headers here" and got["<urn:uuid:3>", "metadata"].block == ""
    W.write_warc(W.derive(responses), str(tmp_path / "w"))
    raw = b"".join(gzip.open(p).read() for p in sorted((tmp_path / "w").glob("part-*")))
    seen = 0
    while raw:  # every record ends where its length says
        head, _, rest = raw.partition(b"\r\n\r\n")
        n = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert head.startswith(b"WARC/1.1") and rest[n:n + 4] == b"\r\n\r\n"
        raw, seen = rest[n + 4:], seen + 1
    assert seen == 6 and W.derive(responses.where("false")).count() == 0


def test_licenses_are_inherited(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    plain = "some text about nothing\nand more of it\n"
    rows = [
        ("LICENSE", gpl), ("a/LICENSE.txt", plain + mit), ("a/b/LICENSE", plain), ("a/b/x.py", plain), ("a/b/y.py", "# " + gpl + "\n" + plain),
        ("c/z.py", plain), ("c/d/e/f.py", None), ("c/d/NOTICES", mit), ("c/d/g.py", ""), (None, plain), ("a/b/x.py", plain),
    ]
    got = license_scan.scan_licenses(spark.createDataFrame([(p, t, 1) for p, t in rows], "path string, text string, dir int")).collect()
    assert len(got) == len(rows)
    want = {"LICENSE": ("GPL-3.0", None), "a/LICENSE.txt": ("MIT", None), "a/b/LICENSE": ("MIT", "a"), "a/b/x.py": ("MIT", "a"), "a/b/y.py": ("GPL-3.0", None), "c/z.py": ("GPL-3.0", ""), "c/d/e/f.py": ("GPL-3.0", ""), "c/d/NOTICES": ("MIT", None), "c/d/g.py": ("GPL-3.0", ""), None: (None, None)}
    assert {r.path: (r.license, r.license_dir) for r in got} == want
    assert license_scan.scan_licenses(spark.createDataFrame([], "path string, text string")).count() == 0


def test_wrapped_notices_are_found(spark):
    plain = "some text about nothing\nand more of it\n"
    gpl = """/*
 * This program is free software{} you can redistribute it and/or modify
 * it under the terms of the GNU {}General Public License as published by
 * the Free Software Foundation{} either version {} of the License, or
 * (at your option) any later version.
 */
"""
    mit = """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software.
"""
    inside = "We wrote many words of our own here about the weather " * 3 + "Licensed under the Apache License, Version 2.0 and then again " + "we wrote many other words " * 5
    rows = [
        ("LICENSE", mit), ("a/x.c", gpl.format(":", "", ",", "3") + plain), ("b/LICENSE", gpl.format(";", "", ";", "2")), ("b/y.c", plain), ("c/x.c", gpl.format(":", "Affero ", ",", "3")),
        ("c/one.txt", inside), ("c/two.txt", "Released under\nthe MIT License."), ("c/z.c", plain), ("c/w.c", "you can modify the terms of this program under\nany other version of the software " * 9),
    ]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()
    want = {"LICENSE": ("MIT", None), "a/x.c": ("GPL-3.0", None), "b/LICENSE": ("GPL-2.0", None), "b/y.c": ("GPL-2.0", "b"), "c/x.c": ("AGPL-3.0", None)}
    want |= {"c/one.txt": ("Apache-2.0", None), "c/two.txt": ("MIT", None), "c/z.c": ("MIT", ""), "c/w.c": ("MIT", "")}
    assert {r.path: (r.license, r.license_dir) for r in got} == want


def test_pipeline_keeps_columns_and_clean_documents(spark, make_docs):
    import corpus_pipeline

    words = [f"w{k}" for k in range(200)]
    same = " ".join(words[:60])
    docs = make_docs([*ODD, (30, same), (31, same), (32, same + " more"), (33, " ".join(words[100:180]))])
    near = stages.one_of_each_group(docs)
    assert near.columns == docs.columns
    ids = {r.doc_id for r in near.collect()}
    assert {30, 33, 1, 2, 3, 8, None} <= ids and not ids & {31, 32}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "sentencepiece"]
    out = corpus_pipeline.run(spark, DIR)
    assert 0 < out.count() < 200
