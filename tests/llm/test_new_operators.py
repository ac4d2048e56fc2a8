"""Positional index, whitening and collocations against brute force."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from reportlake.llm import collocations, positional_index, queries, spectrum, whitening


def ascii_lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def index_words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", ascii_lower(t))


ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog, and then the quick brown fox sleeps a while longer."),
    (2, "Short item ÄÖ"), (3, None), (4, "  ... "), (5, "the the the the the the the the the the the the"), (5, "single"), (None, "no id item here"),
]


def index_docs():
    rng = random.Random(2)
    vocab = index_words(" ".join(t or "" for _, t in ITEMS)) + [f"f{i}" for i in range(30)]
    rows = []
    for i in range(80):
        w = rng.choices(vocab, k=rng.randrange(60))
        if i % 3 == 0:
            cut = index_words(ITEMS[i % 2][1])
            k = rng.randrange(len(cut))
            w[len(w) // 2 : len(w) // 2] = cut[k : k + 4 + i % 14]
        rows.append((i, ", ".join(x.upper() if rng.random() < 0.2 and x.isascii() else x for x in w)))
    rows += [(200, ITEMS[0][1]), (200, ITEMS[0][1]), (200, "x " + ITEMS[0][1]), (None, ITEMS[1][1]), (201, None), (202, ""), (203, "the " * 25 + "Single"), (204, "w " * 20000 + ITEMS[0][1])]
    return rows


def occurrences(w, g):
    return [s for s in range(len(w) - len(g) + 1) if w[s : s + len(g)] == g]


def test_decontaminate_by_brute_force(spark, none):
    docs = spark.createDataFrame(index_docs(), "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("pos", F.lit("x")).withColumn("win", F.lit(2))
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("terms", F.lit(0))
    want = []
    for d, t in index_docs():
        w, hit, own = index_words(t), set(), set()
        for item, text in ITEMS:
            iw = index_words(text)
            for k in range(max(1, len(iw) - 9) if iw else 0):
                g = iw[k : k + 10]
                for s in occurrences(w, g):
                    hit |= set(range(s, s + len(g)))
                    own.add("" if item is None else str(item))
        want.append((str(d), len(w), len(hit), len(own), ",".join(sorted(own))))
    got = [(str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], ",".join(r["items"])) for r in positional_index.decontaminate(docs, items).collect()]
    assert sorted(got) == sorted(want) and sum(x[2] > 0 for x in want) > 10
    assert positional_index.decontaminate(none, items).count() == 0
    assert {r["n_hit"] for r in positional_index.decontaminate(docs, items.limit(0)).collect()} == {0}


@pytest.mark.parametrize("slop", [0, 1, 2])
def test_proximity_by_brute_force(spark, slop):
    rng = random.Random(slop)
    rows = [(i, " ".join(rng.choices("abcdef", k=40))) for i in range(30)]
    phrases = [["a", "b", "c", "d"], ["e", "a"], ["f"], ["a", "b", "a", "c"], ["a", "zz"]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    windows = spark.createDataFrame(list(enumerate(phrases)), "win long, terms array<string>")
    index = positional_index.build_index(docs)
    freq = {r["term"]: (r["n"], r["term_id"]) for r in index.terms.collect()}
    want = set()
    for d, t in rows:
        w = t.split()
        for k, g in enumerate(phrases):
            if all(x in freq for x in g):
                o = min(range(len(g)), key=lambda j: (*freq[g[j]], j))
                for p in (p for p in range(len(w)) if w[p] == g[o]):
                    s = p - o
                    if all(any(0 <= q < len(w) and w[q] == x for q in range(s + j - slop, s + j + slop + 1)) for j, x in enumerate(g) if j != o):
                        want.add((d, s, k))
    keys = docs.select("doc_id", *positional_index.doc_key(F.col("doc_id"), F.col("text")))
    got = positional_index.matches(index, windows, slop).join(keys, positional_index.DOC).select("doc_id", "start", "win").collect()
    assert sorted(map(tuple, got)) == sorted(want) and want


def eigen_cases():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    spread = [np.linspace(1, 9, 40), np.r_[np.full(20, 5.0), np.linspace(1, 4, 20)], np.r_[5, 5 - 1e-10, np.linspace(1, 4, 38)], np.r_[1e6, 1e3, 1, np.zeros(37)]]
    return [q @ np.diag(s) @ q.T for s in spread] + [np.eye(3), np.zeros((4, 4)), np.array([[2.0]]), np.zeros((0, 0))]


@pytest.mark.parametrize("case", range(8))
def test_spectrum_slicing(case):
    v = eigen_cases()[case]
    e, u = spectrum.leading_eigenpairs(v, 16)
    want = np.linalg.eigvalsh(v)[::-1] if len(v) else np.zeros(0)
    top = want[0] if len(want) else 0.0
    assert len(e) == min(16, (want > 1e-12 * top).sum())
    assert np.allclose(e, want[: len(e)], atol=1e-13 * top) and np.allclose(v @ u, u * e, atol=1e-12 * top) and np.allclose(u.T @ u, np.eye(len(e)), atol=1e-12)
    for s in (-1.0, 0.37 * top + 0.1, 1.01 * top + 1):
        assert spectrum.count_above(v, s) == (want > s).sum()


def test_whitening_by_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(5, [float(c) for c in x[7]]), (None, [0.5] * 6)]
    bad = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5), (904, []), (905, [1.0]), (906, [1e30] * 6)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("x", F.lit("clash")).withColumn("n", F.lit(1))
    got = whitening.whiten(df, components=4).collect()
    own = [np.floor(64 * np.array(v)).astype(int) + 1_000_000 for _, v in rows]
    fit = np.unique(np.array(own), axis=0)
    n, s = len(fit), fit.sum(axis=0)
    cov = np.cov(fit.T, bias=True)
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    assert len(got) == 4 * len(rows) and {r["n"] for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["deviation"]), {})[r["component"]] = r
    for (i, _), v in zip(rows, own, strict=True):
        dev = sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s, strict=True))
        for k in range(4):
            r = by[i, dev][k + 1]
            assert abs(abs(r["whitened"]) - abs((v - s / n) @ u[:, k] / e[k] ** 0.5)) < 1e-9
            assert abs(r["explained"] - e[k] / e.sum()) < 1e-9 and r["identity_error"] < 1e-9
    for k in range(4):  # one sign for all rows
        signs = {np.sign(by[i, sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s, strict=True))][k + 1]["whitened"] * ((v - s / n) @ u[:, k])) for (i, _), v in zip(rows, own, strict=True)}
        assert len(signs) == 1
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.where("vec_id = 3")).count() == 0


def brute_collocations(rows, top):
    f, n = Counter(), Counter()
    for lang, t in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", ascii_lower(t)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= 10}
    out = []
    for p, a in cand.items():
        if any(len(q) > len(p) and q[0] == p[0] and 100 * b >= 50 * a and any(q[i : i + len(p) - 1] == p[1:] for i in range(1, len(q))) for q, b in cand.items()):
            continue
        cuts = [(1_000_000 * a * a // (f[p[: k + 1]] * f[(p[0], *p[k + 1 :])]), k) for k in range(1, len(p) - 1)]
        score, k = min(cuts)
        out.append((p[0], " ".join(p[1:]), a, f[p[: k + 1]], f[(p[0], *p[k + 1 :])], n[p[0]], score))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(x[0], r + 1, *x[1:]) for r, x in enumerate(own[:top])]
    return sorted(ranked)


@pytest.mark.parametrize(("head_words", "head_pairs", "dense"), [(1 << 17, 1 << 20, 1 << 14), (6, 4, 1), (0, 0, 1)])
def test_collocations_by_brute_force(spark, monkeypatch, head_words, head_pairs, dense):
    rng = random.Random(8)
    fixed = ["New York City", "over and over", "ÄÖ\xa0ü x", "the cat", "a b c. d", "naïve\tidea"]
    vocab = ["the", "cat", "a", "B", "c.", "York", "rare" + "x"] + [f"u{i}" for i in range(8)]
    rows = []
    for i in range(160):
        w = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(vocab) for _ in range(rng.randrange(40))]
        rows.append((["en", "de", None, "und"][i % 4], " ".join(w).replace("a b", "a,b") if i % 9 == 0 else "  ".join(w)))
    rows += [("en", None), (None, ""), ("en", "go " * 20000), ("fr", "one two three"), ("en", " . , \n")] + [("es", "uno dos tres cuatro")] * 12
    monkeypatch.setattr(collocations, "DENSE", dense)
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("n", F.lit(1)).withColumn("code", F.lit("x")).withColumn("word", F.lit(None).cast("string"))
    for top in (2000, 5):
        got = collocations.collocations(df, top=top, head_words=head_words, head_pairs=head_pairs).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
        assert sorted(map(tuple, got.collect())) == brute_collocations(rows, top)
    assert collocations.collocations(df.limit(0)).count() == 0


def test_tiles_count_like_a_dictionary():
    rng = np.random.default_rng(3)
    a = np.minimum(rng.zipf(1.3, 200_000), 200_000).astype(np.int64) - 1
    codes = a[:-1] << collocations.BITS | a[1:]
    found, n = collocations.counted_codes(codes)
    assert dict(zip(found.tolist(), n.tolist(), strict=True)) == Counter(codes.tolist()) and len(found) == len(set(found.tolist()))


def test_twins(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    for name in ("op11_positional_index", "op13_collocations"):
        df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        want = con.execute(queries.ORACLES[name])
        at = [c[0] for c in want.description]
        assert sorted(map(str, map(tuple, df.select(*at).collect()))) == sorted(map(str, want.fetchall()))
