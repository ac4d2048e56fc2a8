"""The automaton finds what plain scans find."""

import random
import re

import pytest
from pyspark.sql import functions as F

from reportlake.operators import spellings as N


def plain_count(text, spelling, whole):
    n, at = 0, 0
    edge = lambda k: re.compile(r"\b", re.ASCII).match(text, k) is not None
    while (at := text.find(spelling, at)) >= 0:
        if whole and not (edge(at) and edge(at + len(spelling))):
            at += 1
            continue
        n += 1
        at += len(spelling)
    return n


@pytest.mark.parametrize("most", [N.MOST, 7])
def test_found_spellings_by_brute_force(spark, most):
    rng = random.Random(1)
    texts = ["".join(rng.choices("aab cé.-1", k=rng.randrange(60))) for _ in range(120)] + [None, "", "aaaa", "a" * 20000]
    names = {"".join(rng.choices("ab c.1é", k=rng.randrange(1, 5))): rng.random() < 0.5 for _ in range(40)} | {"aa": False, "a": True}
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "ab a")], "doc_id long, text string")
    listed = spark.createDataFrame([*names.items(), ("aa", True), ("", False), (None, True)], "spelling string, whole boolean")
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["spelling"], r["n"]) for r in N.found_spellings(docs, listed, most).collect()))
    want = [(d, s, n) for d, t in [*enumerate(texts), (-1, "ab a")] for s, w in names.items() if (n := plain_count(t or "", s, w))]
    assert got == sorted(want) and len(want) > 100
    assert N.found_spellings(docs, listed.limit(0)).count() == 0 and N.found_spellings(docs.limit(0), listed).count() == 0


def test_ids_in_any_spelling(spark):
    ids = ["CC1.1", "CC1.11", "A-5", "Art. 32(1)", "---", None, "x"]
    rng = random.Random(2)
    rows = [(k, "".join(rng.choices(["CC", "cc", "1", "1", ".", " ", "-", "a", "5", "art", "32", "x", "_"], k=12))) for k in range(300)]
    rows += [(900, "see cc 1-1, not acc1.1"), (901, "ART.32-1"), (902, None)]
    got = {(r["doc_id"], r["id"]) for r in N.ids_in_text(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i,) for i in ids], "id string")).collect()}
    pattern = {i: re.compile(r"\b" + r"[. \-]?".join(re.findall(r"[A-Za-z]+|\d+", i)) + r"\b", re.I | re.A) for i in ids if i and i != "---"}
    assert got == {(d, i) for d, t in rows for i, p in pattern.items() if t and p.search(t)}
    assert {i for d, i in got if d == 900} == {"CC1.1"} and (901, "Art. 32(1)") in got


def test_ten_thousand_ids_take_one_pass(spark):
    """All ids are found in one plan without a join of texts with ids."""
    ids = spark.range(10_000).selectExpr("concat('K', id) as id")
    docs = spark.createDataFrame([(k, f"k-{k} and K.{k * 7} then k {k}{k}") for k in range(50)], "doc_id long, text string")
    got = N.ids_in_text(docs, ids)
    want = {(k, f"K{v}") for k in range(50) for v in (k, k * 7, int(f"{k}{k}")) if v < 10_000}
    assert {(r["doc_id"], r["id"]) for r in got.collect()} == want
    plan = N.found_spellings(docs, N.spelled_ids(ids))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan


def test_texts_are_read_from_arrow_one_at_a_time(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "Σ kpmg kpmg").when(F.col("id") % 3 == 1, F.lit(None).cast("string")).otherwise("none").alias("text"))
    found = N.found_spellings(docs, spark.createDataFrame([("kpmg", False), ("Σ", True)], "spelling string, whole boolean"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan
    assert sorted(tuple(r) for r in found.collect()) == [(k, "kpmg", 2) for k in range(0, 3000, 3)]
