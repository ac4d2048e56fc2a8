"""Scalar functions and matching on hand-made cases."""

from difflib import SequenceMatcher

from pyspark.sql import functions as F

from reportlake.functions import similarity as S
from reportlake.functions import text as T
from reportlake.operators import documents as D
from reportlake.operators import matching as X
from reportlake.operators import orgs as O


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


def test_page_ranges(spark):
    assert one(spark, T.parse_page_ranges(F.col("s")), s="5, 7-9") == [5, 7, 8, 9]
    for bad in ("9-2", "0", "a", "", "3,,4"):
        assert one(spark, T.parse_page_ranges(F.col("s")), s=bad) is None
    assert one(spark, T.parse_page_refs(F.col("s")), s="[3, x, 1, 3]") == [1, 3]


def test_percent(spark):
    for s, want in (("95%", 0.95), ("95", 0.95), ("0.95", 0.95), ("0.5%", 0.005), ("x", None)):
        assert one(spark, T.normalize_percent(F.col("s")), s=s) == want


def test_patterns(spark):
    assert one(spark, T.id_pattern(F.col("s")), s="CTL-12-3") == "CTL-XX-X"
    assert one(spark, T.id_pattern(F.col("s")), s="A.1.22") == "A.X.XX" and one(spark, T.id_pattern(F.col("s")), s="x") is None
    assert one(spark, T.merged_pattern(F.col("a"), F.col("b")), a="ACTL-XX", b="BCTL-XXX") == "XCTL-XXX"
    assert one(spark, T.positional_match(F.col("a"), F.col("b")), a="abc", b="abd") == 2 / 3


def test_canonical_names(spark):
    assert one(spark, T.canonical_key(F.col("s")), s="Acme Cloud, Inc. (ACL)") == "acme cloud"
    assert one(spark, T.keyword_distance(F.col("s"), ["user entity"]), s="The user entitx must") == 1
    assert one(spark, T.keyword_distance(F.col("s"), ["a b c d"]), s="one two") == 999


def test_similarities_equal_the_standard_library(spark):
    pairs = [("review of access", "Review of acces "), ("", "x"), ("abc", "cba"), (None, "a")]
    for a, b in pairs:
        x, y = (a or "").strip().lower(), (b or "").strip().lower()
        assert S.ratio(a, b) == (SequenceMatcher(None, x, y).ratio() if x and y else 0.0)
    assert S.common_subsequence("abcbdab", "bdcaba") == 4 and S.indel("", "") == 100.0 and S.indel("ab", "ac") == 50.0


def test_model_answers(spark):
    cases = ['{"a": 1}', "text ```json\n{\"a\": 1}\n``` more", 'so {"a": 1} it is', '{"a": 1,}', "nothing", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, s string")
    got = [r["a"] for r in df.select("i", X.parse_model_json(F.col("s"), "a int")["a"].alias("a")).orderBy("i").collect()]
    assert got == [1, 1, 1, 1, None, None]


def test_line_chunks_cover_all_lines(spark):
    lines = spark.createDataFrame([(1, i, f"l{i}") for i in range(1, 12)], "doc_id long, line_no long, line string")
    got = {r["chunk_id"]: r["text"].split("\n") for r in D.line_chunks(lines, 4, 1).collect()}
    assert got[0] == ["l1", "l2", "l3", "l4"] and got[1] == ["l4", "l5", "l6", "l7"] and got[3] == ["l10", "l11"]


def test_guarded_chunks_end_at_a_blank_window(spark):
    ls = [f"l{i}" for i in range(1, 21)]
    docs = spark.createDataFrame([(1, "\n".join(ls)), (2, "a\n" + "\n" * 19 + "b"), (3, None), (4, ""), (5, "one")], "doc_id long, text string").withColumn("ls", F.lit(0))
    got = sorted(map(tuple, D.guarded_chunks(docs, 1, 6, 2, 1).collect()))
    assert got == [(1, s, "\n".join(ls[s - 1 : s + 6])) for s in (1, 5, 9, 13, 17)] + [(2, 1, "a" + "\n" * 6), (5, 1, "one")]
    assert [r["start_line"] for r in D.guarded_chunks(docs, 15, 6, 2, 1).where("doc_id = 1").collect()] == [15, 19]
    assert D.guarded_chunks(docs, 99).count() == 0


def test_fuzzy_upsert(spark):
    old = spark.createDataFrame([(1, 5, "review access rights", 0.5), (2, 5, "review backups", 0.5)], "id long, scan_id long, text string, confidence double")
    new = spark.createDataFrame([(5, "review acces rights", 0.9), (5, "encrypt disks", 0.9)], "scan_id long, text string, confidence double")
    got = {(r["text"], r["action"], round(r["confidence"], 2)) for r in X.fuzzy_upsert(new, old).collect()}
    assert got == {("review access rights", "updated", 0.7), ("review backups", "kept", 0.5), ("encrypt disks", "inserted", 0.9)}


def test_final_adjust(spark):
    assert one(spark, O.final_adjust(F.col("c"), F.lit("Yes"), F.lit("Yes"), F.lit(1)), c=0.5) == 0.8
    assert one(spark, O.final_adjust(F.col("c"), F.lit("No"), F.lit(None), F.lit(12)), c=0.1) == 0.0


def test_dates_of_stored_rows(spark):
    noon = {
        "2023-10-31": "2023-10-31", "2023/10/31": "2023-10-31", "10/31/2023": "2023-10-31", "31/10/2023": "2023-10-31", "1/2/2023": "2023-01-02", "October 31, 2023": "2023-10-31", "oct 5, 2023": "2023-10-05",
        "31 October 2023": "2023-10-31", " 31  Oct 2023 ": "2023-10-31", "2023-10-31T00:00:00": "2023-10-31", "2023-10-31 00:00:00Z": "2023-10-31", "5 MAY 2023": "2023-05-05",
    }
    want = {k: f"{v} 12:00:00" for k, v in noon.items()} | {"2023-10-31T05:00:00": "2023-10-31 05:00:00", "2023-10-31 05:06:07.123456": "2023-10-31 05:06:07.123456", "2023-10-31T05:00": "2023-10-31 05:00:00"}
    want |= dict.fromkeys(["31.10.2023", "{}", "", " ", "soon", "2023-02-30", "13/32/2023", "23-10-31", None])
    rows = spark.createDataFrame([(k,) for k in want], "s string").select("s", T.parse_date_any(F.col("s")).cast("string").alias("d")).collect()
    assert {r["s"]: r["d"] for r in rows} == want
