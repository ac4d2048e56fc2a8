"""Structured Streaming operators over job events, usage records and changes. Watermarks bound the state: WATERMARK for
event windows, 90 days for uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.operators.controls import fold_patterns, learn_patterns
from reportlake.operators.jobs import OTHER_PRICES

WATERMARK = "10 minutes"


def progress_rollup(events: DataFrame) -> DataFrame:
    """Per job and minute: events and the latest progress."""
    return events.withWatermark("ts", WATERMARK).groupBy(F.window("ts", "1 minute").alias("w"), "job_id").agg(F.count(F.lit(1)).alias("n"), F.max("progress").alias("progress")).select("job_id", F.col("w.start").alias("minute"), "n", "progress")


def idle_watchdog(events: DataFrame, gap: str = "30 minutes", least: int = 90) -> DataFrame:
    """Sessions of a job that ended by idling, with whether it had come far enough to be closed out."""
    return events.withWatermark("ts", WATERMARK).groupBy(F.session_window("ts", gap).alias("w"), "job_id").agg(F.max("progress").alias("progress"), F.count(F.lit(1)).alias("n")).select("job_id", F.col("w.start").alias("started"), "n", (F.col("progress") >= least).alias("close"))


def dedup_by_hash(uploads: DataFrame, keep_for: str = "90 days") -> DataFrame:
    return uploads.withWatermark("ts", keep_for).dropDuplicatesWithinWatermark(["hash"])


def usage_stream(calls: DataFrame) -> DataFrame:
    """Hourly view sliding by a quarter of an hour, per model."""
    return calls.withWatermark("ts", WATERMARK).groupBy(F.window("ts", "1 hour", "15 minutes").alias("w"), "model").agg(F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens")).select("model", F.col("w.start").alias("start"), "calls", "prompt_tokens")


def running_cost(calls: DataFrame) -> DataFrame:
    """Calls, tokens and cost per model so far, at the prices of an unlisted model; for update or complete mode. Tokens are
    summed whole and priced once, so the order of calls does not show."""
    i, o = OTHER_PRICES
    sums = calls.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
    return sums.withColumn("cost", (F.coalesce("prompt_tokens", F.lit(0)) * i + F.coalesce("completion_tokens", F.lit(0)) * o) / 1e6)


def parse_partial_lines(raw: DataFrame, schema: str) -> DataFrame:
    """Rows of a JSON file that is still being written: brackets and commas around a line go, broken rows are dropped."""
    line = F.regexp_replace(F.trim("value"), r"^[\[,\s]+|[\],\s]+$", "")
    return raw.select(F.when(F.try_parse_json(F.nullif(line, F.lit(""))).isNotNull(), F.from_json(line, schema)).alias("r")).where("r is not null").select("r.*")


def tail_counts(raw: DataFrame, schema: str, key: str) -> DataFrame:
    return parse_partial_lines(raw, schema).groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def learn_patterns_sink(path: str):
    """foreachBatch function: folds a batch's patterns into the table at path, one folder per batch, so that a batch
    that is run again overwrites what it wrote and nothing else."""

    def fold(batch: DataFrame, batch_id: int) -> None:
        learned = learn_patterns(batch).select("organization", "pattern", "frequency", "first_seen", "last_seen")
        learned.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return fold


def stored_patterns(parts: DataFrame) -> DataFrame:
    """The folded table over all batches."""
    return fold_patterns(parts.limit(0), parts)


def stale_scans(changes: DataFrame, summaries: DataFrame) -> DataFrame:
    """(scan_id, stale): whether a report changed after its summary. changes: scan_id, updated_at; summaries: scan_id,
    summary_at."""
    last = changes.groupBy("scan_id").agg(F.max("updated_at").alias("updated_at"))
    return last.join(summaries, "scan_id", "left").select("scan_id", (F.col("summary_at").isNull() | (F.col("updated_at") > F.col("summary_at"))).alias("stale"))
