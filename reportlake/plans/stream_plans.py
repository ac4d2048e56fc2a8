"""Queries whose rows come from a running stream: the table is written as files, read by readStream part by part with state
in between, and what the sinks hold at the end is the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.sources import files as S
from reportlake.streaming import jobs as R
from reportlake.streaming import sinks as K
from reportlake.streaming import stateful as P

from .catalog import query
from .control_plans import PATTERN
from .views import view

PARTS = 3


def in_time(rows: DataFrame, ts: str = "ts") -> list[DataFrame]:
    """rows in PARTS parts, older ones first."""
    cuts = rows.select(F.expr(f"percentile_approx({ts}, array({', '.join(str(k / PARTS) for k in range(1, PARTS))}))").alias("c")).first()["c"] or []
    part = F.lit(0)
    for c in cuts:
        part = part + F.when(F.col(ts) > F.lit(c), 1).otherwise(0)
    return [rows.where(part == k) for k in range(PARTS)]


def settled(stream: DataFrame, mode: str, keep: Callable[[DataFrame, int], None], state: str | None = None) -> None:
    """Runs a stream over all that is there, or, with the `state` of a run before, over what has come since."""
    state = state or S.scratch(stream.sparkSession, "stream-state")
    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def settled_in_time(rows: DataFrame, build: Callable[[DataFrame], DataFrame], mode: str, keep: Callable[[DataFrame, int], None]) -> None:
    """Runs the stream that build() makes of rows, part after part in the order of time. A part is one batch, in however many
    files and whatever order it is written, so no row comes a batch after a later one that another file of its part held."""
    spark = rows.sparkSession
    path, state = S.scratch(spark, "stream-in"), S.scratch(spark, "stream-state")
    for part in in_time(rows):
        part.write.mode("append").parquet(path)
        settled(build(spark.readStream.schema(rows.schema).parquet(path)), mode, keep, state)


def updated(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row of each key that a stream in update mode gave."""
    path = S.scratch(stream.sparkSession, "stream-out")
    settled(stream, "update", K.update_sink(path))
    return K.latest_rows(stream.sparkSession, path, keys)


def updated_in_time(rows: DataFrame, build: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    path = S.scratch(rows.sparkSession, "stream-out")
    settled_in_time(rows, build, "update", K.update_sink(path))
    return K.latest_rows(rows.sparkSession, path, keys)


def job_events(spark, d):
    jobs = view(spark, d, "v_jobs").withColumn("ts", F.col("ts").cast("timestamp"))
    guess = F.when(F.col("event_id") % 5 == 0, None).when(F.col("event_id") % 7 == 0, 0).otherwise(50 + F.col("event_id") % 51)
    return jobs.select("job_id", F.col("status").alias("extractor"), "ts", "event_id", F.col("progress").alias("extracted"), guess.cast("long").alias("estimated"))


PROGRESS_SQL = """with e as (select job_id, status as extractor, ts, event_id, progress as extracted, case when event_id % 5 = 0 then null when event_id % 7 = 0 then 0 else 50 + event_id % 51 end as estimated from v_jobs),
g as (select job_id, extractor, count(*) as n_events, max(ts) as last, epoch_us(max(ts)) - epoch_us(min(ts)) as us from e group by 1, 2),
x as (select job_id, extractor, extracted from e qualify row_number() over (partition by job_id, extractor order by ts desc, event_id desc) = 1),
y as (select job_id, extractor, estimated from e where estimated > 0 qualify row_number() over (partition by job_id, extractor order by ts desc, event_id desc) = 1)
select job_id, extractor, n_events, extracted, estimated, case when estimated is not null then least(100, extracted * 100 // estimated)::integer end as percent, case when us > 0 then round(extracted / (us / 60e6), 6) end as per_minute, last
from g join x using (job_id, extractor) left join y using (job_id, extractor)"""


@query("r01_extractor_progress", PROGRESS_SQL)
def r01c(spark, d):
    out = updated_in_time(job_events(spark, d), P.extractor_progress_stream, ["job_id", "extractor"])
    return out.withColumn("per_minute", F.round("per_minute", 6)).withColumn("last", F.col("last").cast("timestamp_ntz"))


@query("r03_idle_closeout", """with w as (select max(ts) - interval '10 minutes' as now from v_jobs),
l as (select job_id, ts, progress, lead(ts) over (partition by job_id order by ts, event_id) as after from v_jobs),
c as (select job_id, ts, progress from l, w where progress >= 70 and case when after is null then ts + interval '30 minutes' <= now else after > ts + interval '30 minutes' end)
select job_id, min(ts) as last, arg_min(progress, ts) as progress, min(ts) + interval '30 minutes' as closed from c group by 1""")  # fmt: skip
def r03b(spark, d):
    """With 70 percent as the bound, since few of the jobs come to 95."""
    path = S.scratch(spark, "closed")
    events = view(spark, d, "v_jobs").select("job_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "progress")
    settled_in_time(events, lambda df: P.idle_jobs_stream(df, 1800, 70), "append", K.update_sink(path))
    out = spark.read.schema(P.CLOSED).parquet(f"{path}/batch=*")
    return out.select("job_id", F.col("last").cast("timestamp_ntz").alias("last"), "progress", F.col("closed").cast("timestamp_ntz").alias("closed"))


@query("r02_tail_stream", "select organization, count(*) as n from v_controls where id % 10 <> 0 group by 1")
def r02b(spark, d):
    """Result lines come in files while they are counted; every tenth line is broken off."""
    c = view(spark, d, "v_controls")
    whole = F.to_json(F.struct("id", "organization"))
    lines = c.select(F.when(F.col("id") % 10 == 0, F.substring(whole, 1, 12)).otherwise(F.concat(whole, F.lit(","))).alias("value"))
    path = S.scratch(spark, "tail")
    lines.repartition(4).write.text(path)
    raw = spark.readStream.option("maxFilesPerTrigger", 1).text(path)
    return updated(R.tail_counts(raw, "id long, organization string", "organization"), ["organization"])


@query("r05_running_cost", """select model, count(*) as calls, sum(prompt_tokens)::bigint as prompt_tokens, sum(completion_tokens)::bigint as completion_tokens,
round(sum(cast((prompt_tokens * 150000 + completion_tokens * 600000) as decimal(38, 0))) / 1e12, 6) as cost from v_usage group by 1""")  # fmt: skip
def r05b(spark, d):
    usage = view(spark, d, "v_usage").withColumn("ts", F.col("ts").cast("timestamp"))
    return updated_in_time(usage, R.running_cost, ["model"]).withColumn("cost", F.round("cost", 6))


def finished_scans(spark, d):
    """Controls by organization, as they come in four files, with patterns that are near to others of their organization."""
    c = view(spark, d, "v_controls").select("organization", "scan_id", "control_id", "control_confidence", "updated_at")
    near = c.where("scan_id % 2 = 0").withColumn("control_id", F.expr("concat(substr(control_id, 1, 1), 'QW', substr(control_id, 4))"))
    source = S.scratch(spark, "scans")
    c.unionByName(near).repartition(4).write.parquet(source)
    return spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).parquet(source)


def learned_table(spark, d) -> K.PatternTable:
    table = K.PatternTable(S.scratch(spark, "pattern-table"), every=2)
    settled(finished_scans(spark, d), "append", table.fold)
    return table


SCANS_SQL = f"""c as (select organization, scan_id, control_id, control_confidence from v_controls union all
  select organization, scan_id, substr(control_id, 1, 1) || 'QW' || substr(control_id, 4), control_confidence from v_controls where scan_id % 2 = 0),
p as (select organization, {PATTERN} as pattern, count(*) as frequency from c where control_confidence >= 0.9 and {PATTERN} is not null group by 1, 2)"""


@query("r06_pattern_table", f"with {SCANS_SQL} select organization, pattern, frequency from p")
def r06b(spark, d):
    return learned_table(spark, d).patterns(spark).select("organization", "pattern", "frequency")


@query("r06_review_queue", f"with {SCANS_SQL} select a.organization, a.pattern, b.pattern as other, round(0.7E0 / 3 + 0.3E0, 6) as similarity from p a join p b on a.organization = b.organization and a.pattern < b.pattern")
def r06c(spark, d):
    return learned_table(spark, d).reviews(spark).select("organization", "pattern", "other", F.round("similarity", 6).alias("similarity"))
