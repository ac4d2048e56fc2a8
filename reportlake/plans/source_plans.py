"""Queries that write with the library's writers, or let a stream write, and read back with its readers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.sources import files as S
from reportlake.streaming import jobs as R

from .catalog import query
from .control_plans import LEARNED
from .views import table, view


def texts(lines: DataFrame, name: str) -> str:
    """Path of the lines (value) written as text files."""
    path = S.scratch(lines.sparkSession, name)
    lines.select("value").write.text(path)
    return path


def streamed(rows: DataFrame, build, mode: str = "append") -> DataFrame:
    """rows, written as files, through build() as a stream of all that is there; what the sink holds at the end."""
    spark = rows.sparkSession
    source, sink = S.scratch(spark, "stream-in"), S.scratch(spark, "stream-out")
    rows.write.parquet(source)
    out = build(spark.readStream.schema(rows.schema).parquet(source))
    out.writeStream.outputMode(mode).format("parquet").option("path", sink).option("checkpointLocation", S.scratch(spark, "stream-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(sink)


@query("s02_read_result_json", "select id, cuec_description from v_cuecs")
def s02(spark, d):
    path = S.scratch(spark, "results")
    u = view(spark, d, "v_cuecs").select("scan_id", "id", "cuec_description")
    nested = u.groupBy("scan_id").agg(F.collect_list(F.struct("id", "cuec_description")).alias("cuecs"))
    other = nested.select((F.col("scan_id") + 1_000_000).alias("scan_id"), F.lit(None).cast(nested.schema["cuecs"].dataType).alias("cuecs"))
    nested.unionByName(other).repartition("scan_id").write.partitionBy("scan_id").json(path)
    return S.read_result_json(spark, f"{path}/*/*.json", "cuecs", "id: long, cuec_description: string")


def partial_lines(spark, d):
    """Controls as a result file that is still being written: brackets, commas on either side, broken ends."""
    c, k = view(spark, d, "v_controls"), F.col("id") % 5
    whole = F.to_json(F.struct("id", "organization"))
    line = F.when(F.col("id") % 10 == 0, F.substring(whole, 1, 12)).when(k == 1, F.concat(F.lit("  "), whole, F.lit(","))).when(k == 2, F.concat(F.lit(","), whole)).when(k == 3, F.concat(F.lit("["), whole, F.lit("]"))).otherwise(whole)
    marks = c.where("id % 50 = 7").select(F.explode(F.array(F.lit("["), F.lit("[]"), F.lit(""), F.lit("]"))).alias("value"))
    return spark.read.text(texts(c.select(line.alias("value")).unionByName(marks), "partial"))


@query("s03_partial_json_lines", "select id, organization from v_controls where id % 10 <> 0")
def s03(spark, d):
    return R.parse_partial_lines(partial_lines(spark, d), "id long, organization string")


@query("r02_tail_counts", "select organization, count(*) as n from v_controls where id % 10 <> 0 group by 1")
def r02(spark, d):
    return R.tail_counts(partial_lines(spark, d), "id long, organization string", "organization")


@query("s04_criteria_catalog", "select framework, section, id, description, id as name from v_criteria union all select 'TSC', 'Common', 'CC1.' || n_regionkey::varchar, n_name, n_name from nation")
def s04(spark, d):
    path = S.scratch(spark, "criteria")
    c = view(spark, d, "v_criteria").select("framework", "section", "id", "description")
    c.repartition("framework").write.partitionBy("framework").json(path)
    built_in = table(spark, d, "nation").select(F.lit("TSC").alias("framework"), F.concat(F.lit("CC1."), F.col("n_regionkey").cast("string")).alias("id"), F.lit("Common").alias("component"), F.col("n_name").alias("principle"), F.col("n_name").alias("name"))
    return S.read_criteria(spark, path, built_in, whole_files=False)


@query("s05_lookup_list", "select s_name as short, case when s_suppkey % 3 = 0 then s_name else s_name || ' LLP' end as legal from supplier where s_suppkey % 5 <> 0")
def s05(spark, d):
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    line = F.when(k % 5 == 0, F.concat(F.lit(" # "), "s_name")).when(k % 3 == 0, F.col("s_name")).otherwise(F.concat("s_name", F.lit(" | "), "s_name", F.lit(" LLP")))
    blank = s.where("s_suppkey % 5 = 1").select(F.lit("   ").alias("value"))
    return S.read_lookup_list(spark, texts(s.select(line.alias("value")).unionByName(blank), "firms"))


@query("s09_append_audit_log", "select model, cast(ts as date) as day, count(*) as n from v_usage group by 1, 2")
def s09(spark, d):
    path = S.scratch(spark, "audit")
    u = view(spark, d, "v_usage").select("call_id", "ts", "model")
    for part in (0, 1):
        S.append_audit_log(u.where(F.col("call_id") % 2 == part), path)
    log = S.read_audit_log(spark, path, "call_id long, ts timestamp, model string")
    return log.groupBy("model", "day").agg(F.count(F.lit(1)).alias("n"))


@query("s09_audit_rows", "select call_id, ts, model, cast(ts as date) as day from v_usage")
def s09b(spark, d):
    path = S.scratch(spark, "audit-rows")
    S.append_audit_log(view(spark, d, "v_usage").select("call_id", "ts", "model"), path)
    log = S.read_audit_log(spark, path, "call_id long, ts timestamp, model string")
    return log.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("s11_baselines", """with m as (select scan_id, count(*) as total from v_controls group by 1), b as (select 'report ' || (scan_id % 4)::varchar as report_name, 'v' || (scan_id % 2)::varchar as extractor_version, scan_id, total, scan_id // 4 as created_at from m)
select scan_id, total, created_at, created_at = max(created_at) over (partition by report_name) as newest from b""")  # fmt: skip
def s11(spark, d):
    path = S.scratch(spark, "baselines")
    c = view(spark, d, "v_controls").groupBy("scan_id").agg(F.count(F.lit(1)).alias("total"))
    S.write_baseline(c.withColumn("report_name", F.concat(F.lit("report "), (F.col("scan_id") % 4).cast("string"))).withColumn("extractor_version", F.concat(F.lit("v"), (F.col("scan_id") % 2).cast("string"))).withColumn("created_at", F.floor(F.col("scan_id") / 4)), path)
    newest = None
    for k in range(4):
        one = S.read_baseline(spark, path, f"report {k}").select("scan_id", F.lit(True).alias("newest"))
        newest = one if newest is None else newest.unionByName(one)
    return S.list_baselines(spark, path).join(newest, "scan_id", "left").select("scan_id", "total", "created_at", F.coalesce("newest", F.lit(False)).alias("newest"))


@query("s12_usage_log", "select model, extractor, count(*) as calls, sum(prompt_tokens)::bigint as prompt_tokens, max(ts) as last from v_usage group by 1, 2")
def s12(spark, d):
    path = S.scratch(spark, "usage")
    u = view(spark, d, "v_usage")
    S.append_usage_log(u.withColumn("cost", F.lit(0.01)).withColumnRenamed("duration_seconds", "seconds"), path)
    log = S.read_usage_log(spark, path)
    return log.groupBy("model", "extractor").agg(F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.max("ts").cast("timestamp_ntz").alias("last"))


@query("r01_progress_stream", "select job_id, date_trunc('minute', ts) as minute, count(*) as n, max(progress) as progress from v_jobs group by 1, 2")
def r01b(spark, d):
    jobs = view(spark, d, "v_jobs").withColumn("ts", F.col("ts").cast("timestamp"))
    return R.progress_rollup(jobs).withColumn("minute", F.col("minute").cast("timestamp_ntz"))


@query("r04_dedup_by_hash", "select distinct md5(job_id::varchar) as hash from v_jobs")
def r04(spark, d):
    uploads = view(spark, d, "v_jobs").select(F.col("ts").cast("timestamp").alias("ts"), F.md5(F.col("job_id").cast("string")).alias("hash"))
    # all rows come in one batch, so each hash passes once
    return streamed(uploads.coalesce(1), R.dedup_by_hash).select("hash")


@query("r06_learn_patterns_stream", f"select organization, pattern, frequency from ({LEARNED})")
def r06(spark, d):
    source, stored = S.scratch(spark, "controls"), S.scratch(spark, "patterns")
    c = view(spark, d, "v_controls").select("organization", "scan_id", "control_id", "control_confidence", "updated_at")
    c.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 2).parquet(source)
    stream.writeStream.foreachBatch(R.learn_patterns_sink(stored)).option("checkpointLocation", S.scratch(spark, "patterns-state")).trigger(availableNow=True).start().awaitTermination()
    return R.stored_patterns(spark.read.parquet(stored).drop("batch")).select("organization", "pattern", "frequency")
