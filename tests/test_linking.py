"""The gram index loses no pair, and linked rows are one group however long the chain."""

import random
from collections import Counter
from itertools import combinations

import pytest

from reportlake.functions.similarity import ratio
from reportlake.operators import linking as L
from reportlake.operators import matching as X


def mixed_texts(rng, n):
    base = ["".join(rng.choices("abcdé -", k=k)) for k in (1, 2, 3, 5, 9, 20, 45, 90)]
    return ["".join(c if rng.random() > 0.1 else rng.choice("xyzab") for c in rng.choice(base)) + rng.choice(["", "q", " "]) for _ in range(n)]


@pytest.mark.parametrize("least", [0.6, 0.7, 0.8, 0.9, 0.985, 1.0])
def test_gram_index_loses_no_pair(spark, least):
    rng = random.Random(int(least * 1000))
    left = [(rng.choice([1, 1, 2, None]), t) for t in mixed_texts(rng, 110)] + [(1, None), (1, "  ")]
    right = [(rng.choice([1, 1, 2, None]), t) for t in mixed_texts(rng, 110)] + left[:20]
    want = {(k, a, b) for k, a in left for m, b in right if k is not None and k == m and (a or "").strip(" ") and (b or "").strip(" ") and ratio(a, b) >= least}
    a = spark.createDataFrame(left, "scan_id long, text string")
    b = spark.createDataFrame(right, "scan_id long, matched string")
    got = L.alike_pairs(a, b, "scan_id", least).collect()
    assert {(r["scan_id"], r["text"], r["matched"]) for r in got} == want and len(got) == len(want) and want
    assert all(r["sim"] == ratio(r["text"], r["matched"]) for r in got)


@pytest.mark.parametrize("least", [0.5, 0.65, 0.72, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0])
def test_offers_meet_for_all_alike(least):
    """The index itself, without Spark, over many short and long texts."""
    rng = random.Random(int(least * 100))
    q = L.gram_size(least)
    texts = sorted({t.strip().lower() for t in mixed_texts(rng, 400)} - {""})
    offers = {t: set(L.offered(t, q, least, {})) for t in texts}
    for a, b in combinations(texts, 2):
        assert offers[a] & offers[b] or ratio(a, b) < least
    assert all(offers.values())


def test_gram_index_spares_pairs():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=12)) for _ in range(120)]
    common = Counter(g for t in texts for g in L.grams(t, 3))
    offers = [set(L.offered(t, 3, 0.95, common)) for t in texts]
    met = sum(bool(a & b) for a, b in combinations(offers, 2))
    assert met < 0.2 * len(texts) * (len(texts) - 1) / 2


@pytest.mark.parametrize("n", [1, 2, 200])
def test_chain_of_near_copies_is_one_group(spark, n):
    """Neighbours differ in one letter, the ends in all."""
    rng = random.Random(3)
    text = [rng.choice("abcdefghij") for _ in range(60)]
    rows = []
    for k in range(n):
        rows.append((1000 + (k * 77) % 211, 1, "".join(text)))
        text[k % 60] = rng.choice([c for c in "klmnopqrst" if c != text[k % 60]])
    rows += [(1, 2, rows[0][2]), (2, 1, None), (3, 1, " . "), (4, None, rows[0][2]), (5, None, "other words here")]
    got = X.consolidate_cuecs(spark.createDataFrame(rows, "id long, scan_id long, cuec_description string"), least=0.98).collect()
    by = {r["id"]: (r["scan_id"], r["group_id"], r["n"]) for r in got}
    assert len(got) == len(rows)
    assert {by[i] for i, s, _ in rows if s == 1 and i >= 1000} == {(1, min(r[0] for r in rows if r[0] >= 1000), n)}
    assert by[1] == (2, 1, 1) and by[2] == by[3] == (1, 2, 2) and by[4] == (None, 4, 1) and by[5] == (None, 5, 1)


def test_groups_by_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([1, 2]), t) for i, t in enumerate(mixed_texts(rng, 150))]
    norm = lambda t: " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in t.strip().lower()).split())
    name = {i: i for i, _, _ in rows}
    changed = True
    while changed:
        changed = False
        for (i, s, a), (j, r, b) in combinations(rows, 2):
            x, y = norm(a), norm(b)
            if s == r and name[i] != name[j] and (x == y or (x and y and ratio(x, y) >= 0.85)):
                name[i] = name[j] = min(name[i], name[j])
                changed = True
    got = {r["id"]: r["group_id"] for r in X.consolidate_cuecs(spark.createDataFrame(rows, "id long, scan_id long, cuec_description string"), least=0.85).collect()}
    assert got == name and len(set(name.values())) < len(name)
