"""Boundary-seeking chunks and edge lines."""

import random

from pyspark.sql import functions as F

from reportlake.functions import similarity
from reportlake.operators import contents, matching
from reportlake.operators import headings as H


def test_boundary_chunks_lose_nothing(spark):
    text = "One sentence here. Another one follows.\n\nA paragraph " + "x" * 700 + " end"
    pieces = H.boundary_chunks(spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string"), 300, 50).orderBy("chunk_id").collect()
    assert {p["doc_id"] for p in pieces} == {1} and all(0 < len(p["text"]) <= 300 for p in pieces)
    whole = ""
    for p in pieces:
        assert text[p["start"] :].startswith(p["text"]) and p["start"] <= len(whole)
        whole = whole[: p["start"]] + p["text"]
    assert whole == text


def test_repeated_edge_lines(spark):
    pages = spark.createDataFrame([(1, i, f"ACME AUDIT\nbody {i}\nmore\npage {i}") for i in range(1, 5)], "doc_id long, page_no long, text string")
    assert sorted((r["line"], r["n"]) for r in H.repeated_edge_lines(pages).collect()) == [("acme audit", 4), ("more", 4)]


def test_the_most_alike_is_found_after_few_comparisons(monkeypatch):
    # 1,500 long texts of the same letters, of which only a few are worth a comparison
    rng, asked = random.Random(3), []
    right = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=200)) for _ in range(1500)]
    left = [x[:50] + x[51:] for x in right[::100]] + ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=200))]
    want = [(i, *max((similarity.indel(x, y), -j) for j, y in enumerate(right))) for i, x in enumerate(left)]
    real = similarity.indel
    monkeypatch.setattr(similarity, "indel", lambda a, b: asked.append(1) or real(a, b))
    assert list(similarity.most_alike(left, right, 85.0)) == [(i, -j, s) for i, s, j in want if s > 85]
    assert len(asked) < 100


def test_runs_that_begin_with_a_label_and_runs_over_packs(spark, monkeypatch):
    monkeypatch.setattr(matching, "PACK", 2)
    lines = ["Section", "4 - Tests", "iv.", "Section 5:", "B. Σ of ΟΔΟΣ", "next ΟΔΟΣ", "12", "mild words"]
    rows = [(1, k, s) for k, s in enumerate(lines, 1)]
    table = matching.line_packs(spark.createDataFrame(rows, "doc_id long, line_no long, line string"), 3)
    got = sorted(tuple(r) for r in table.select(F.explode(matching.run_keys(3)).alias("r")).select("r.*").collect())
    runs = [(k, n, " ".join(lines[k - 1 : k - 1 + n])) for k in range(1, 9) for n in (1, 2, 3) if k - 1 + n <= 8]
    whole = spark.createDataFrame(runs, "k long, n int, s string").select("k", "n", contents.core_heading(F.col("s")).alias("key"))
    assert got == sorted(tuple(r) for r in whole.where("key <> ''").collect())


def test_only_the_lines_themselves_are_shuffled(spark):
    """What is made of a line (letters and digits, label) is made after the one shuffle, and headings go to their join once."""
    lines = spark.createDataFrame([(1, k, s) for k, s in enumerate(["Section 1", "A. Scope", "", "words"], 1)], "doc_id long, line_no long, line string")
    plan = matching.line_packs(lines, 3)._jdf.queryExecution().executedPlan().toString()
    above, below = plan[: plan.rindex("Exchange hashpartitioning")], plan[plan.rindex("Exchange hashpartitioning") :]
    assert "regexp_replace" in above and "regexp_replace" not in below


def test_match_heading_over_several_packs(spark, monkeypatch):
    """Headings meet each pack of their document; equal ones take the first line, the others the most alike run."""
    monkeypatch.setattr(matching, "PACK", 2)
    text = ["Alpha beta gamma delta", "second part of it", "Section 2", "overview of controls", "Alpha beta gamma delta", "last words of all"]
    lines = [(d, k, s) for d in (1, 2) for k, s in enumerate(text, 1)]
    heads = [(1, "1. alpha BETA gamma delta"), (1, "overview of contrls"), (1, "econd part of it Section 2"), (1, "nothing"), (2, "last wrds of all"), (2, "last wrds of all"), (3, "second part of it"), (None, "x")]
    got = matching.match_heading(spark.createDataFrame(heads, "doc_id long, heading string"), spark.createDataFrame(lines, "doc_id long, line_no long, line string"))
    assert sorted((r["doc_id"], r["heading"][:5], r["line_no"], r["n_lines"]) for r in got.collect()) == [(1, "1. al", 1, 1), (1, "econd", 2, 2), (1, "overv", 3, 2), (2, "last ", 6, 1)]
