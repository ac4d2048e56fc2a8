"""Failed texts found again: exact, fuzzy, in the lines of the source, recovered; against brute force."""

import random
from difflib import SequenceMatcher

import pytest

from reportlake.operators import matching as X


def score(a, b):
    a, b = a.strip().lower(), b.strip().lower()
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def brute(bad, good, lines):
    out = {}
    for d, t in bad:
        if d is None or not (t or "").strip():
            out[d, t] = ("unmatched", None, None)
            continue
        own = [g for e, g in good if e == d and (g or "").strip()]
        equal = [g for g in own if g.strip() == t.strip()]
        if equal:
            out[d, t] = ("exact", max(equal), 1.0)
            continue
        sims = [(score(t, g), g) for g in own]
        if sims and max(sims)[0] > 0.7:
            out[d, t] = ("fuzzy", max(sims)[1], max(sims)[0])
            continue
        src = {n: x.strip() for e, n, x in lines if e == d and x is not None}
        plain, best = t.strip().replace("\n", " "), None
        for n in src:
            for k in (1, 2, 3):
                if all(n + i in src for i in range(k)):
                    w = " ".join(src[n + i] for i in range(k)).replace("\n", " ").strip()
                    if w:
                        best = max(best or (False, 0.0, 0, 0, ""), (plain == w, score(plain, w), -n, -k, w))
        out[d, t] = ("output_txt_exact" if best[0] else "output_txt_fuzzy", best[4], best[1]) if best and best[1] > 0.7 else ("unmatched", None, None)
    return out


@pytest.mark.parametrize("pack", [X.PACK, 4])
def test_rescue_report_by_brute_force(spark, monkeypatch, pack):
    monkeypatch.setattr(X, "PACK", pack)
    rng = random.Random(4)
    words = "user entities must ensure access logs keys are reviewed monthly by staff".split()
    sentence = lambda: " ".join(rng.choices(words, k=rng.randrange(2, 9)))
    worn = lambda t: "".join(c if rng.random() > 0.08 else "#" for c in t)
    lines = [(d, n, sentence() if rng.random() > 0.1 else rng.choice(["", "  ", None])) for d in (1, 2) for n in range(1, 30) if n % 13]
    good = [(d, sentence()) for d in (1, 2, 3) for _ in range(5)] + [(1, None), (2, " "), (None, "user entities")]
    at = {(d, n): t for d, n, t in lines}
    bad = [(1, None), (2, ""), (None, "user entities"), (3, sentence()), (9, sentence())]
    for d in (1, 2):
        bad += [(d, f" {good[d * 5 - 5][1]}\n"), (d, worn(good[d * 5 - 4][1])), (d, good[d * 5 - 3][1].upper())]
        for n in range(1, 28, 3):
            own = [at.get((d, n + i)) or "" for i in range(1 + n % 3)]
            bad += [(d, "\n".join(own)), (d, worn(" ".join(own)))]
    bad += bad[:9]
    df = lambda rows, s: spark.createDataFrame(rows, s)
    got = X.rescue_report(df(bad, "doc_id long, text string"), df(good, "doc_id long, text string"), df(lines, "doc_id long, line_no long, line string")).collect()
    want = brute(set(bad), good, lines)
    assert {(r["doc_id"], r["text"]): (r["rescue_type"], r["matched"], r["score"]) for r in got} == want and len(got) == len(want)
    assert {w[0] for w in want.values()} == {"exact", "fuzzy", "output_txt_exact", "output_txt_fuzzy", "unmatched"}
    assert all(r["confidence_pct"] == (None if r["score"] is None else round(r["score"] * 100)) for r in got)


def test_recovered_rows(spark):
    duty = "User entities are responsible for removing access of leavers within a day"
    report = [
        (1, "a", "output_txt_fuzzy", duty + ".", 0.96), (1, "b", "output_txt_exact", duty + ".", 1.0), (1, "c", "output_txt_fuzzy", duty + ".", 0.94),
        (2, "a", "output_txt_exact", duty, 1.0), (2, "b", "output_txt_exact", duty + " and for telling the service desk of it", 0.97),
        (3, "a", "output_txt_exact", "The system must be configured by those who run it, and watched.", 1.0), (3, "b", "output_txt_exact", "must do.", 1.0),
        (3, "c", "fuzzy", duty + ".", 1.0), (4, "a", "output_txt_exact", duty + ";", 1.0), (5, "a", "output_txt_exact", "Logs are kept for one year and are read by those who own them.", 1.0), (6, "a", "unmatched", None, None),
    ]
    r = spark.createDataFrame(report, "doc_id long, text string, rescue_type string, matched string, score double")
    good = spark.createDataFrame([(4, f" {duty}; ")], "doc_id long, text string")
    got = sorted((x["doc_id"], x["cuec_description"], x["cuec_confidence"], x["cuec_source"], x["justification"][0]) for x in X.recovered_rows(r, good).collect())
    assert got == [
        (1, duty + ".", 0.6, "recovered_from_output_txt", "Recovered from output.txt with 100.0% fuzzy match"),
        (2, duty + " and for telling the service desk of it", 0.6, "recovered_from_output_txt", "Recovered from output.txt with 97.0% fuzzy match"),
    ]


def test_texts_equal_to_a_run_are_not_compared(spark, monkeypatch):
    """They meet it in a join, whatever their case; the similarity sees the others only."""
    lines = [(1, k, f"User entities should review the access of user {k}.") for k in range(40)]
    bad = [(1, lines[3][2]), (1, lines[5][2].upper()), (1, lines[8][2] + " " + lines[9][2]), (1, lines[11][2][2:])]
    shape = "doc_id long, line_no long, line string"
    found = {r["text"]: r for r in X.best_windows(spark.createDataFrame(bad, "doc_id long, text string"), spark.createDataFrame(lines, shape), 0.7).collect()}
    assert [(found[t]["exact"], found[t]["matched"]) for _, t in bad[:3]] == [(True, bad[0][1]), (False, lines[5][2]), (True, bad[2][1])]
    assert found[bad[3][1]]["matched"] == lines[11][2] and found[bad[3][1]]["sim"] < 1
    monkeypatch.setattr(X, "alike", lambda *a: 1 / 0)
    same = X.best_windows(spark.createDataFrame(bad[:3], "doc_id long, text string"), spark.createDataFrame(lines, shape), 0.7).collect()
    assert sorted(r["text"] for r in same) == sorted(t for _, t in bad[:3])
