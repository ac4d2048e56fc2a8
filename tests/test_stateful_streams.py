"""Stateful streams equal their batch forms after each file and over a restart; repeated batches change nothing."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from reportlake.plans import catalog
from reportlake.plans.views import view
from reportlake.streaming import jobs as R
from reportlake.streaming import sinks as K
from reportlake.streaming import stateful as P

BEGIN = datetime(2024, 1, 1)
EVENTS = "job_id long, extractor string, ts timestamp, event_id long, extracted long, estimated long, progress long"


def three_files(spark, seed=1):
    rng = random.Random(seed)
    rows, parts = [], []
    for i in range(240):
        at = BEGIN + timedelta(seconds=i * 60 + rng.randrange(50), microseconds=rng.randrange(10**6))
        rows.append((rng.randrange(6), rng.choice("ab"), at, i, rng.choice([None, i, i * 2]), rng.choice([None, 0, 50, 400]), rng.randrange(60, 101)))
    # job 77 stops for good after the first file, 78 far too early, 79 speaks again too late
    rows[5] = (77, "a", rows[5][2], 5, 10, 20, 99)
    rows[6] = (78, "a", rows[6][2], 6, 10, None, 40)
    rows[7], rows[235] = (79, "b", rows[7][2], 7, 1, 2, 97), (79, "b", rows[235][2], 235, 2, 2, 98)
    for k in range(3):
        parts.append(spark.createDataFrame(rows[k * 80 : (k + 1) * 80], EVENTS))
    return parts


def run(spark, path, out, mode, build, keep):
    stream = build(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"))
    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()


def near(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


def test_progress_equals_batch_after_each_file_and_restart(spark, tmp_path):
    path, out = str(tmp_path), str(tmp_path / "out")
    seen = None
    for part in three_files(spark):
        part.coalesce(1).write.mode("append").parquet(f"{path}/in")
        run(spark, path, out, "update", P.extractor_progress_stream, K.update_sink(out))
        seen = part if seen is None else seen.unionByName(part)
        want = P.extractor_progress(seen)
        assert near(K.latest_rows(spark, out, ["job_id", "extractor"]).select(*want.columns).collect()) == near(want.collect())
    by = {(r["job_id"], r["extractor"]): r for r in want.collect()}
    assert by[77, "a"]["percent"] == 50 and by[78, "a"]["percent"] is None and by[78, "a"]["per_minute"] is None
    assert max(r["percent"] or 0 for r in want.collect()) == 100


def test_progress_of_many_jobs_needs_no_call_for_each(spark, tmp_path):
    """State is kept by Spark's own aggregation, late rows included: no key goes to a Python worker and back."""
    rows = [(i % 500, "a", BEGIN + timedelta(days=-i), i, i, 50, 1) for i in range(1500)]
    for k in range(3):
        spark.createDataFrame(rows[k * 500 : (k + 1) * 500], EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    plan = P.extractor_progress_stream(spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in"))._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" not in plan and "Aggregate" in plan
    run(spark, str(tmp_path), "", "update", P.extractor_progress_stream, K.update_sink(f"{tmp_path}/out"))
    want = P.extractor_progress(spark.createDataFrame(rows, EVENTS))
    assert near(K.latest_rows(spark, f"{tmp_path}/out", ["job_id", "extractor"]).select(*want.columns).collect()) == near(want.collect())


def test_silent_job_is_closed_once_by_a_timer(spark, tmp_path):
    path, out = str(tmp_path), str(tmp_path / "out")
    closed_after, seen = [], None
    for part in three_files(spark):
        part.coalesce(1).write.mode("append").parquet(f"{path}/in")
        run(spark, path, out, "append", lambda df: P.idle_jobs_stream(df, 1800, 95), K.update_sink(out))
        seen = part if seen is None else seen.unionByName(part)
        got = spark.read.schema(P.CLOSED).parquet(f"{out}/batch=*").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, P.idle_jobs(seen, 1800, 95).collect()))
        closed_after.append({r["job_id"] for r in got})
    # 77 never spoke again, and was closed while only others did
    assert 77 in closed_after[0] and 78 not in closed_after[2] and 79 in closed_after[0]
    run(spark, path, out, "append", lambda df: P.idle_jobs_stream(df, 1800, 95), K.update_sink(out))
    again = spark.read.schema(P.CLOSED).parquet(f"{out}/batch=*").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got)) and len({r["job_id"] for r in again}) == len(again)


def test_long_silence_forgets_nothing(spark, tmp_path):
    """Job 1 is silent for more than a week while another one goes on over several files, and then speaks again."""
    days = [(1, 0.0, 99), (2, 0.1, 1), (2, 9.0, 2), (2, 18.0, 3), (2, 27.0, 4), (1, 28.0, 98), (1, 28.2, 97), (2, 29.0, 5)]
    rows = [(job, "a", BEGIN + timedelta(days=d), i, i, 50, p) for i, (job, d, p) in enumerate(days)]
    path, seen = str(tmp_path), spark.createDataFrame(rows, EVENTS)
    for k in range(4):
        spark.createDataFrame(rows[2 * k : 2 * k + 2], EVENTS).coalesce(1).write.mode("append").parquet(f"{path}/in")
        run(spark, path, "", "update", P.extractor_progress_stream, K.update_sink(f"{path}/out"))
    want = P.extractor_progress(seen)
    assert near(K.latest_rows(spark, f"{path}/out", ["job_id", "extractor"]).select(*want.columns).collect()) == near(want.collect())
    for k in range(4):
        spark.createDataFrame(rows[2 * k : 2 * k + 2], EVENTS).coalesce(1).write.mode("append").parquet(f"{path}/b/in")
        run(spark, f"{path}/b", "", "append", lambda df: P.idle_jobs_stream(df, 1800, 95), K.update_sink(f"{path}/closed"))
    closed = spark.read.schema(P.CLOSED).parquet(f"{path}/closed/batch=*").collect()
    assert sorted(map(tuple, closed)) == sorted(map(tuple, P.idle_jobs(seen, 1800, 95).collect())) and len(closed) == 1


def test_files_of_one_time_are_one_batch(spark, tmp_path):
    """The oldest third lies in the larger file alone; of the middle one, each file holds later rows of some jobs than the other."""
    rng = random.Random(5)
    rows = [(i, BEGIN + timedelta(minutes=i * 3, microseconds=rng.randrange(10**6)), i % 12, "ab"[i % 2], 60.0 if i <= 120 else 70.0 + i % 30) for i in range(360)]
    large = lambda r: r[0] <= 120 or (r[0] <= 240 and r[2] % 2 == (r[0] <= 180))
    for part in ([(*r, str(rng.random())) for r in rows if large(r)], [(*r, "") for r in rows if not large(r)]):
        spark.createDataFrame(part, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    got = catalog.QUERIES["r03_idle_closeout"](spark, str(tmp_path)).collect()
    seen = view(spark, str(tmp_path), "v_jobs").withColumn("ts", F.col("ts").cast("timestamp"))
    want = P.idle_jobs(seen, 1800, 70).withColumn("last", F.col("last").cast("timestamp_ntz")).withColumn("closed", F.col("closed").cast("timestamp_ntz")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 12


def controls(spark, rows):
    df = spark.createDataFrame([(*r, 0.95, BEGIN + timedelta(days=k)) for k, r in enumerate(rows)], "organization string, scan_id long, control_id string, control_confidence double, updated_at timestamp")
    return df


BATCHES = [
    [("o", 1, "ABC-01-02"), ("o", 1, "ABC-01-03"), ("p", 9, "A.1")],
    [("o", 2, "AQW-01-02"), ("o", 2, "ABC-04-04")],
    [("o", 3, "AQW-05-06"), ("p", 9, "A.2")],
    [("q", 4, "ABC-01-02"), ("q", 4, "AQW-01-01")],
    [("o", 5, "AVV-01-02")],
]


@pytest.mark.parametrize("every", [2, 10])
def test_pattern_table_survives_repeated_batches(spark, tmp_path, every):
    table = K.PatternTable(str(tmp_path / "t"), every=every)
    for k, rows in enumerate(BATCHES):
        table.fold(controls(spark, rows), k)
        first = sorted(map(tuple, table.patterns(spark).collect())), sorted(map(tuple, table.reviews(spark).collect()))
        table.fold(controls(spark, rows), k)
        assert (sorted(map(tuple, table.patterns(spark).collect())), sorted(map(tuple, table.reviews(spark).collect()))) == first
    got = {(r["organization"], r["pattern"]): r["frequency"] for r in table.patterns(spark).collect()}
    assert got == {("o", "ABC-XX-XX"): 3, ("o", "AQW-XX-XX"): 2, ("o", "AVV-XX-XX"): 1, ("p", "A.X"): 2, ("q", "ABC-XX-XX"): 1, ("q", "AQW-XX-XX"): 1}
    queued = sorted((r["organization"], r["pattern"], r["other"]) for r in table.reviews(spark).collect())
    assert queued == [("o", "ABC-XX-XX", "AQW-XX-XX"), ("o", "ABC-XX-XX", "AVV-XX-XX"), ("o", "AQW-XX-XX", "AVV-XX-XX"), ("q", "ABC-XX-XX", "AQW-XX-XX")]
    if every == 2:
        assert K.numbered(spark, f"{tmp_path}/t/bases") == [1, 3] and K.numbered(spark, f"{tmp_path}/t/deltas") == [2, 3, 4]
    assert K.PatternTable(str(tmp_path / "none")).patterns(spark).count() == 0


def test_running_cost_equals_batch_after_each_file(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice("xyz"), rng.choice([None, rng.randrange(9000)]), rng.randrange(900)) for _ in range(90)]
    schema = "model string, prompt_tokens long, completion_tokens long"
    for k in range(3):
        spark.createDataFrame(rows[k * 30 : k * 30 + 30], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = R.running_cost(spark.readStream.schema(schema).json(str(tmp_path / "in")))
        stream.writeStream.outputMode("update").foreachBatch(K.update_sink(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        want = R.running_cost(spark.createDataFrame(rows[: k * 30 + 30], schema))
        assert near(K.latest_rows(spark, str(tmp_path / "out"), ["model"]).select(*want.columns).collect()) == near(want.collect())
    assert {r["model"]: r["cost"] for r in want.collect()}["x"] == pytest.approx(sum((p or 0) * 0.15 + c * 0.6 for m, p, c in rows if m == "x") / 1e6)
