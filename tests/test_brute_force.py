"""Queries and patterns that SQL cannot express, against plain Python over whole tables."""

import random
import re
import unicodedata
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from reportlake.functions.similarity import common_subsequence, indel_ratio, ratio
from reportlake.operators import contents as K
from reportlake.operators import batching
from reportlake.operators import documents as D
from reportlake.operators import headings as H
from reportlake.operators import matching as X
from reportlake.plans import catalog
from reportlake.plans.views import view

SF = "/root/testdata/sf0.001"


def shape(s):
    known = re.fullmatch(r"[A-Z]{2,5}-\d+-\d+|[A-Z]\.\d+\.\d+|[A-Z]\.\d+", s)
    return re.sub(r"\d", "X", s) if known else None


def alike(a, b):
    sep = lambda p: "-" if "-" in p else "." if "." in p else None
    if a == b:
        return 1.0
    x, y = (p.split(sep(p)) if sep(p) else [p] for p in (a, b))
    if sep(a) != sep(b) or len(x) != len(y):
        return 0.0
    share = sum(p == q for p, q in zip(x[1:], y[1:], strict=True)) / len(x[1:]) if len(x) > 1 else 1.0
    return 0.7 * SequenceMatcher(None, x[0].lower(), y[0].lower()).ratio() + 0.3 * share


def test_pattern_similarity(spark):
    pairs = [("AB-XX-XX", "AC-XX-XX"), ("AB-XX-XX", "AB-XX"), ("AB-XX", "AB.XX"), ("ABC", "ABD"), ("A.X", "A.X"), ("AB-X-XX", "AB-XX-XX")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = {(r["a"], r["b"]): r["s"] for r in df.select("a", "b", X.pattern_similarity(F.col("a"), F.col("b")).alias("s")).collect()}
    assert all(abs(got[p] - alike(*p)) < 1e-9 for p in pairs)


def test_control_ids_are_scored_over_all_rows(spark):
    learned = {}
    rows = view(spark, SF, "v_controls").select("id", "organization", "control_id", "control_confidence").collect()
    for r in rows:
        if r["control_confidence"] >= 0.9 and (p := shape(r["control_id"])):
            learned.setdefault(r["organization"], {}).setdefault(p, 0)
            learned[r["organization"]][p] += 1
    want = {}
    for r in rows:
        c, k = r["control_id"], r["id"] % 6
        c = "Q" + c if k == 0 else c.replace("-", ".") if k == 1 else "ZZ-1-1" if k == 2 else c
        p, known = shape(c), learned.get(r["organization"])
        if not c.strip():
            score = 0.0
        elif p is None:
            score = 0.3
        elif known is None:
            score = 0.5
        elif p in known:
            f = known[p]
            score = 0.95 if f >= 20 else 0.8 + (f - 10) * 0.015 if f >= 10 else 0.7 + (f - 5) * 0.02
        else:
            best = max(alike(p, q) for q in known)
            score = 0.75 if best >= 0.9 else 0.6 if best >= 0.7 else 0.5 if best >= 0.5 else 0.3
        want[r["id"]] = round(score, 6)
    got = {r["id"]: round(r["score"], 6) for r in catalog.QUERIES["f06_score_control_ids"](spark, SF).collect()}
    assert got == want and len(set(want.values())) >= 4


def test_ratios_of_whole_tables(spark):
    rows = spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", "p_name", "p_type").collect()
    got = {r["p_partkey"]: r["ratio"] for r in catalog.QUERIES["x01_seq_ratio"](spark, SF).collect()}
    assert all(abs(got[r["p_partkey"]] - ratio(r["p_name"], r["p_type"])) < 1e-9 for r in rows) and len(got) == len(rows)
    indel = spark.createDataFrame([("kitten", "sitting"), ("a", ""), ("same", "same")], "a string, b string").select(indel_ratio("a", "b").alias("r")).collect()
    assert [round(r["r"], 3) for r in indel] == [61.538, 0.0, 100.0]


def plain_chunks(text, size, overlap):
    """By looking at every place from the end: the last one of the best kind."""
    out, i = [], 0
    while i < len(text):
        end = min(i + size, len(text))
        if end < len(text):
            low = max(i, end - 200)
            places = range(end - 1, low - 1, -1)
            inside = lambda k, mark: text.startswith(mark, k) and k + len(mark) <= end
            kinds = [
                lambda k: inside(k, "\n\n"), lambda k: any(inside(k, "\n" + b) for b in "•-*") and k + 3 <= end and text[k + 2].isspace(),
                lambda k: inside(k, ".\n") or inside(k, ". "), lambda k: inside(k, "\n"),
            ]
            best = next((k for kind in kinds for k in places if kind(k)), None)
            if best is not None and best > low:
                end = best + 1
        out.append((i, text[i:end]))
        if i + size >= len(text):
            return out
        i = end - overlap
    return out


def test_boundary_chunks_of_whole_texts(spark):
    texts = {r["doc_id"]: r["text"] for r in view(spark, SF, "v_docs").collect()}
    got = {}
    for r in catalog.QUERIES["w07_boundary_chunks"](spark, SF).orderBy("chunk_id").collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["text"]))
    assert got == {d: plain_chunks(t, 1000, 200) for d, t in texts.items() if t} and max(map(len, got.values())) > 5


def test_boundary_chunks_by_brute_force(spark):
    rng = random.Random(6)
    parts = ["word ", "ends. ", "ends.\n", "\n\n", "\n• item", "\n- item", "\n* it", "\n-x", "\n", "é" * 70]
    rows = [(k, "".join(rng.choices(parts, k=rng.randrange(200)))) for k in range(60)] + [(100, None), (101, ""), (102, "y" * 1500), (103, "\n" * 1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(0)).withColumn("size", F.lit(9))
    for size, overlap in ((400, 100), (1000, 200), (201, 2), (50, 1)):
        got = {}
        for r in H.boundary_chunks(df, size, overlap).orderBy("chunk_id").collect():
            got.setdefault(r["doc_id"], []).append((r["start"], r["text"]))
        assert got == {d: plain_chunks(t, size, overlap) for d, t in rows if t}
    for size, overlap in ((400, 202), (100, 2), (100, -1)):
        with pytest.raises(ValueError):
            H.boundary_chunks(df, size, overlap)


TOC = ["Section I Overview .... 5 SECTION 2 Results .. 17", "A. Scope 3 B. Limits 4", "12. Terms 300", "no number", "  ", "Appendix 2024 III. Notes 7", "7", "Control 1.1 ..... 9"]


def test_toc_entries_like_a_plain_scan(spark):
    entry = re.compile(r"(.*?)(\d{1,4})\s*(?=(?:SECTION|[IVXLC0-9]+\.|\d+\.|[A-Z]\.|$))", re.IGNORECASE)
    want = []
    for k, line in enumerate(TOC):
        found = list(entry.finditer(line.strip()))
        pairs = [(m.group(1).strip(" ."), int(m.group(2))) for m in found if m.group(1).strip(" .")] if found else [(line.strip(), None)] if line.strip() else []
        want += [(k, j, *p) for j, p in enumerate(pairs)]
    df = spark.createDataFrame([(1, k, s) for k, s in enumerate(TOC)], "doc_id long, line_no long, line string")
    assert sorted((r["line_no"], r["pos"], r["heading"], r["page"]) for r in K.parse_toc_lines(df).collect()) == sorted(want)


def test_headings_beyond_ascii(spark):
    df = spark.createDataFrame([(1, "Ｓｅｃｔｉｏｎ　ＩＶ － Übersicht ﬁn"), (2, "2. B. Scope"), (3, None)], "k int, line string")
    got = {r["k"]: r["h"] for r in K.nfkc(df, "line").select("k", K.core_heading(F.col("line")).alias("h")).collect()}
    assert got == {1: "übersichtfin", 2: "scope", 3: None}


def test_agreement_wording(spark):
    rows = [("I AGREE to this", True), ("notice: confidential", False), ("notice confidential as is, sole risk", True), ("nothing", False), (None, None)]
    df = spark.createDataFrame(rows, "t string, want boolean")
    assert all(r["got"] == r["want"] for r in df.select("want", D.is_agreement_page(F.col("t")).alias("got")).collect())


def test_token_batches_by_a_plain_fold(spark):
    rows = [(g, k, (k * 37 + len(g or "")) % 900) for g in ("a", "bb", None) for k in range(200)]
    got = {(r["g"], r["k"]): r["batch"] for r in batching.token_batches(spark.createDataFrame(rows, "g string, k long, t long"), "g", "k", "t", 1500).collect()}
    want = {}
    for g in ("a", "bb", None):
        batch = used = 0
        for _, k, t in [r for r in rows if r[0] == g]:
            if used and used + t > 1500:
                batch, used = batch + 1, 0
            used += t
            want[(g, k)] = batch
    assert got == want


def test_occurrences_overlap(spark):
    texts = ["aXaxaXa", "none", "", "aaaa", "xAXAx"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r["doc_id"], r["pos"]) for r in D.find_occurrences(df, "AxA", 2).collect())
    assert got == [(0, 1), (0, 3), (0, 5), (4, 2)]


def test_char_chunks_of_odd_texts(spark):
    texts = ["", "x" * 1600, "é\n" * 1001, "🙂" * 801]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["chunk_id"]): (r["start"], r["start_line"], r["text"]) for r in D.char_chunks(df, 1000, 200).collect()}
    want = {(d, s // 800): (s, 1 + t[:s].count("\n"), t[s : s + 1000]) for d, t in enumerate(texts) for s in range(0, max(len(t), 1), 800)}
    assert got == want


def core(s):
    s = unicodedata.normalize("NFKC", s)
    for p in (r"^section\s*[ivxlcdm0-9]+\s*[\-–—:]?\s*", r"^[ivxlcdm]+\.?\s*", r"^[0-9]+\.?\s*", r"^[a-zA-Z]\.\s*"):
        s = re.sub(p, "", s, flags=re.IGNORECASE if p != r"^[a-zA-Z]\.\s*" else 0)
    return re.sub(r"[^\w]", "", s).lower()


def test_headings_of_one_to_three_lines(spark):
    lines = ["Section I - Independent Service", "", "Auditor's Report", "body text of the report goes on here", "2. Management", "Assertion of Acme", "Holdings", "Descrption of the Systen", "tail"]
    toc = ["SECTION I Independent Service Auditor's Report", "II. Management Assertion of Acme Holdings", "3. Description of the System", "Nothing like it at all", "tail"]
    rows = [(d, k, s) for d in (1, 2) for k, s in enumerate(lines, 1)]
    df = spark.createDataFrame(rows, "doc_id long, line_no long, line string")
    heads = spark.createDataFrame([(1, h) for h in toc] + [(1, "tail"), (3, "tail")], "doc_id long, heading string")
    got = {r["heading"]: (r["line_no"], r["n_lines"], round(r["score"], 6)) for r in X.match_heading(heads, df).collect()}
    own = [(k, s) for k, s in enumerate(lines, 1) if s.strip()]
    want = {}
    for h in toc:
        best = []
        for i, (k, _) in enumerate(own):
            for n in range(1, min(3, len(own) - i) + 1):
                key = core(" ".join(s for _, s in own[i : i + n]))
                if core(h) and key:
                    score = 100.0 if key == core(h) else 200 * common_subsequence(core(h), key) / (len(key) + len(core(h)))
                    best.append((-round(score, 6), k, n))
        if best and -min(best)[0] > 85:
            want[h] = (min(best)[1], min(best)[2], -min(best)[0])
    assert got == want and len(want) == 4
