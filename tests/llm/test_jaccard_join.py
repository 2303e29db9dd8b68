import random
import re

import pytest

from crosswin.llm import jaccard_join as J
from conftest_odd import ODD

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if i is not None)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {(i, len(s), find(i) if i is not None else None) for i, s in sets.items()}


def corpus():
    """Copies, chains of near copies about the bound, and a passage most short documents share."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdef") for _ in range(4))
    passage = [word() for _ in range(40)]
    rows, k = [], 0
    for _ in range(60):
        rows.append((k := k + 1, " ".join([*passage, *(word() for _ in range(r.randint(5, 60)))])))
    for n in (3, 5, 8, 20, 60, 300):
        base = [word() for _ in range(n)]
        for _ in range(14):
            rows.append((k := k + 1, " ".join(base)))
            for _ in range(r.randint(0, max(1, n // 40))):
                base[r.randrange(n)] = word()
    return rows


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_components_equal_brute_force(make_docs, width, percent, monkeypatch):
    monkeypatch.setattr(J, "OPEN_PAIRS", 1)  # so that crowded slices are compared in blocks here too
    monkeypatch.setattr(J, "BLOCK", 5)
    rows = [*corpus(), *[(1000 + i, t) if i is not None else (i, t) for i, t in ODD]]
    got = {tuple(r) for r in J.similar_documents(make_docs(rows), width, percent).collect()}
    assert got == brute(rows, width, percent)


def test_bands_hold_every_pair_and_common_slices():
    import numpy as np

    for percent in (80, 85):
        plan = J.bands(percent, 5000)
        for b in range(1, 2000):
            a = -(-percent * b // 100)
            shared = [(top, k) for low, top, k in plan if low <= a and b <= top]
            assert shared
            differing = (100 - percent) * (a + b) // (100 + percent)
            for top, k in shared:  # what both leave out can't hold all common slices
                for n in (a, b):
                    d = int(J.most_differing(np.array(n), np.array(top), percent))
                    assert differing <= d < k


def test_empty_table(make_docs):
    assert J.similar_documents(make_docs([])).count() == 0
