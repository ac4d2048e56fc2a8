"""Streams equal their batch forms; files round-trip."""

import json

from pyspark.sql import functions as F

from reportlake.operators import controls as C
from reportlake.plans.views import view
from reportlake.sources import files as S
from reportlake.streaming import jobs as R

SF = "/root/testdata/sf0.001"


def replay(spark, df, path, build, mode="complete"):
    rows = df.orderBy("ts")
    rows.limit(300).coalesce(1).write.mode("overwrite").json(f"{path}/a")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).json(f"{path}/a")
    q = build(source).writeStream.outputMode(mode).format("memory").queryName("replayed").option("checkpointLocation", f"{path}/c").start()
    q.processAllAvailable()
    q.stop()
    return spark.sql("select * from replayed"), spark.read.schema(rows.schema).json(f"{path}/a")


def test_progress_and_usage_streams_equal_batch(spark, tmp_path):
    jobs = view(spark, SF, "v_jobs").withColumn("ts", F.col("ts").cast("timestamp"))
    got, again = replay(spark, jobs, str(tmp_path / "p"), R.progress_rollup)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, R.progress_rollup(again).collect()))
    usage = view(spark, SF, "v_usage").withColumn("ts", F.col("ts").cast("timestamp"))
    got, again = replay(spark, usage, str(tmp_path / "u"), R.usage_stream)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, R.usage_stream(again).collect()))


def test_uploads_with_one_hash_pass_once(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:00:00", "h"), ("2024-01-20 00:00:00", "h"), ("2024-01-21 00:00:00", "g")], "ts string, hash string").withColumn("ts", F.col("ts").cast("timestamp"))
    got, _ = replay(spark, rows, str(tmp_path / "d"), R.dedup_by_hash, "append")
    assert sorted(r["hash"] for r in got.collect()) == ["g", "h"]


def test_pattern_sink_is_idempotent(spark, tmp_path):
    c = view(spark, SF, "v_controls")
    fold = R.learn_patterns_sink(str(tmp_path / "patterns"))
    fold(c.where("id % 2 = 0"), 0)
    fold(c.where("id % 2 = 1"), 1)
    fold(c.where("id % 2 = 1"), 1)
    stored = R.stored_patterns(spark.read.parquet(str(tmp_path / "patterns")).drop("batch"))
    want = C.learn_patterns(c).select("organization", "pattern", "frequency")
    assert sorted(map(tuple, stored.select("organization", "pattern", "frequency").collect())) == sorted(map(tuple, want.collect()))


def test_partial_result_lines(spark, tmp_path):
    (tmp_path / "part.json").write_text('[\n{"k": "a"},\n{"k": "b"}\n,{"k": "a"},\n{"k": "br\n]')
    raw = spark.read.text(str(tmp_path / "part.json"))
    assert {r["k"]: r["n"] for r in R.tail_counts(raw, "k string", "k").collect()} == {"a": 2, "b": 1}


def test_files(spark, tmp_path):
    (tmp_path / "r.txt").write_text("one\ntwo")
    assert [(r["line_no"], r["line"]) for r in S.read_report_lines(spark, str(tmp_path / "r.txt")).orderBy("line_no").collect()] == [(1, "one"), (2, "two")]
    (tmp_path / "firms.txt").write_text("# list\nAB|A and B LLP\n\nCD\n")
    assert [tuple(r) for r in S.read_lookup_list(spark, str(tmp_path / "firms.txt")).collect()] == [("AB", "A and B LLP"), ("CD", "CD")]
    (tmp_path / "res").mkdir()
    (tmp_path / "res/x.json").write_text(json.dumps({"cuecs": [{"cuec_seq": 1}, {"cuec_seq": 2}]}))
    (tmp_path / "res/y.json").write_text(json.dumps({"other": 1}))
    assert S.read_result_json(spark, str(tmp_path / "res/*.json"), "cuecs", "cuec_seq: int").count() == 2
    rows = spark.createDataFrame([(1, "a", "1.5"), (1, None, "2"), (2, "b", "x")], "scan_id int, name string, score string")
    S.write_entity_table(rows, str(tmp_path / "t"), ["name"], ["score"])
    assert spark.read.parquet(str(tmp_path / "t/rows")).count() == 1 and spark.read.json(str(tmp_path / "t/errors")).count() == 2


def test_deep_merge_of_maps(spark):
    a = spark.createDataFrame([(1, {"x": 1, "y": 2}, "old")], "id int, m map<string,int>, s string")
    b = spark.createDataFrame([(1, {"y": 3}, None), (2, {"z": 1}, "new")], "id int, m map<string,int>, s string")
    got = {r["id"]: (r["m"], r["s"]) for r in S.deep_merge(a, b, "id", ["m"]).collect()}
    assert got == {1: ({"x": 1, "y": 3}, "old"), 2: ({"z": 1}, "new")}
