"""Queries without a twin against brute force over whole tables."""

import random
from collections import defaultdict

from reportlake.functions.similarity import alike, ratio
from reportlake.plans import catalog
from reportlake.plans.views import view

SF = "/root/testdata/sf0.001"


def test_alike_loses_no_pair():
    rng = random.Random(7)
    base = ["".join(rng.choices("abcdé ", k=rng.choice([3, 20, 60, 64, 65, 130, 220]))) for _ in range(12)]
    texts = [None, "", " ", "Ab"] + base + ["".join(c if rng.random() > 0.12 else rng.choice("xyz") for c in rng.choice(base)) for _ in range(60)]
    for least in (0.7, 0.8):
        want = {(i, j): r for i, a in enumerate(texts) for j, b in enumerate(texts) if (r := ratio(a, b)) >= least}
        assert {(i, j): r for i, j, r in alike(texts, texts, least)} == want
        for j, b in enumerate(texts):
            assert {i for i, _, _ in alike(texts, [b], least)} == {i for i, k in want if k == j}


def test_fuzzy_upsert_reads_every_row(spark):
    rows = view(spark, SF, "v_controls").select("id", "scan_id", "control_desc", "control_confidence").collect()
    old = defaultdict(list)
    for r in rows:
        if r["id"] % 2 == 0:
            old[r["scan_id"]].append((r["id"], r["control_desc"]))
    hit, want = set(), []
    for r in rows:
        if r["id"] % 2:
            sims = [(ratio(r["control_desc"], t), -i) for i, t in old[r["scan_id"]]]
            if sims and max(sims)[0] >= 0.8:
                hit.add(-max(sims)[1])
            else:
                want.append((None, r["scan_id"], r["control_desc"], r["control_confidence"], "inserted"))
    for r in rows:
        if r["id"] % 2 == 0:
            c = r["control_confidence"]
            want.append((r["id"], r["scan_id"], r["control_desc"], min(1.0, c + 0.2) if r["id"] in hit else c, "updated" if r["id"] in hit else "kept"))
    got = [tuple(r) for r in catalog.QUERIES["j07_fuzzy_upsert"](spark, SF).collect()]
    assert hit and sorted(got, key=repr) == sorted(want, key=repr)


def test_rescue_reads_lines_of_every_length(spark):
    lines = view(spark, SF, "v_lines").selectExpr("doc_id", "line", "xxhash64(line) % 20 = 0 as bad").collect()
    good = defaultdict(set)
    for r in lines:
        if not r["bad"]:
            good[r["doc_id"]].add(r["line"])
    want = []
    for r in lines:
        if r["bad"]:
            sim, text = max(((ratio(r["line"], t), t) for t in good[r["doc_id"]]), default=(0.0, None))
            want.append((r["doc_id"], r["line"], text, sim, "exact" if sim == 1 else "fuzzy") if sim > 0.7 else (r["doc_id"], r["line"], None, None, "unmatched"))
    got = [(r["doc_id"], r["text"], r["matched"], r["sim"], r["kind"]) for r in catalog.QUERIES["j13_rescue_bad_chunks"](spark, SF).collect()]
    assert any(len(w[1]) < 10 or len(w[1]) > 200 for w in want) and sorted(got, key=repr) == sorted(want, key=repr)


def test_continuations_of_all_controls(spark):
    rows = view(spark, SF, "v_controls").orderBy("scan_id", "id").collect()
    want, last = [], None
    for r in rows:
        x = [r["scan_id"], r["id"], r["control_id"] or "", r["control_desc"], r["id"] % 7 == 0, r["page_last"], r["control_confidence"]]
        if last and last[0] == x[0] and (last[4] or (last[2] and last[2] == x[2])):
            last[2:] = [last[2] or x[2], f"{last[3]} {x[3]}", False, max(last[5], x[5]), (last[6] + x[6]) / 2]
        else:
            last = x
            want.append(last)
    got = [list(r) for r in catalog.QUERIES["w04_merge_continuations"](spark, SF).collect()]
    assert len(want) < len(rows) and sorted(got, key=repr) == sorted(want, key=repr)
