"""Scans over time, queues of jobs, model calls and chats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reportlake.functions import text as T


def queue_positions(jobs: DataFrame, slot: str = "hour") -> DataFrame:
    """jobs (status, priority, ts, event_id) with `position` from 1 within the status, by priority, time and id.

    Jobs are counted per slot of time first; the counts of the slots before, and the place within the own slot, add up to
    the position, so that a status is not sorted in one task.
    """
    own = jobs.withColumn("_slot", F.date_trunc(slot, "ts"))
    sizes = own.groupBy("status", "priority", "_slot").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy("status").orderBy("priority", "_slot").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("status").alias("_s"), F.col("priority").alias("_p"), F.col("_slot").alias("_t"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("status", "priority", "_slot").orderBy("ts", "event_id"))
    same = F.col("status").eqNullSafe(F.col("_s")) & F.col("priority").eqNullSafe(F.col("_p")) & F.col("_slot").eqNullSafe(F.col("_t"))
    return own.withColumn("_place", place).join(sizes, same).withColumn("position", F.col("_before") + F.col("_place")).drop("_slot", "_place", "_s", "_p", "_t", "_before")


def queue_stats(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def best_company(scans: DataFrame) -> DataFrame:
    """(id, company): the name of the highest confidence, ties by the larger company id."""
    return scans.groupBy("id").agg(F.max_by("company", F.struct("company_confidence", "company_id")).alias("company"))


def recent_scans(scans: DataFrame, n: int = 500) -> DataFrame:
    """The newest scans, 1 to 500 of them."""
    return scans.orderBy(F.desc("scan_date"), F.desc("id")).limit(max(1, min(500, n)))


def retain_newest(scans: DataFrame, keep: int = 20) -> DataFrame:
    newest = Window.partitionBy("company_id").orderBy(F.desc("scan_date"), F.desc("id"))
    return scans.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= keep).drop("_r")


def estimate_duration(scans: DataFrame, last: int = 10, spread: float = 2.0, weight: float = 0.7) -> DataFrame:
    """(report_type, estimate): the last durations without those more than `spread` deviations off, smoothed from the newest
    back; at most `last` rows of a type are held."""
    newest = Window.partitionBy("report_type").orderBy(F.desc("id"))
    few = scans.select("report_type", "id", "elapsed_seconds").withColumn("r", F.row_number().over(newest)).where(F.col("r") <= last)
    own = Window.partitionBy("report_type")
    near = few.withColumn("m", F.avg("elapsed_seconds").over(own)).withColumn("s", F.stddev_pop("elapsed_seconds").over(own)).where(F.abs(F.col("elapsed_seconds") - F.col("m")) <= spread * F.col("s"))
    xs = near.groupBy("report_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "elapsed_seconds"))), lambda x: x["elapsed_seconds"]).alias("xs"))
    fold = F.aggregate(F.slice("xs", 2, last), F.get("xs", F.lit(0)), lambda a, x: weight * x + (1 - weight) * a)
    return xs.select("report_type", F.round(fold, 1).alias("estimate"))


#: Seconds that a scan takes where too little is known, by the start of its type; and how much is enough.
BASE_SECONDS = {"SOC1": 1200.0, "": 2100.0}
LEAST_SAMPLES = 5


def estimate_or_base(scans: DataFrame, last: int = 10, least: int = LEAST_SAMPLES) -> DataFrame:
    """(report_type, estimated_seconds, based_on_scans, is_fixed_estimate): as estimate_duration, but the base seconds of the type
    where fewer than `least` of its last scans have a duration, or are left without outliers. Durations of 0 count as none."""
    newest = Window.partitionBy("report_type").orderBy(F.desc("id"))
    timed = scans.select("report_type", "id", "elapsed_seconds", F.row_number().over(newest).alias("r")).where(F.col("r") <= last)
    some = timed.where(F.coalesce("elapsed_seconds", F.lit(0.0)) != 0)
    own = Window.partitionBy("report_type")
    near = F.abs(F.col("elapsed_seconds") - F.avg("elapsed_seconds").over(own)) <= 2 * F.stddev_pop("elapsed_seconds").over(own)
    left = some.withColumn("near", near).groupBy("report_type").agg(F.count(F.lit(1)).alias("timed"), F.count_if("near").alias("near"))
    types = timed.groupBy("report_type").agg(F.count(F.lit(1)).alias("found")).join(left, "report_type", "left")
    timed_n, near_n = F.coalesce("timed", F.lit(0)), F.coalesce("near", F.lit(0))
    basis = F.when(F.col("found") < least, F.col("found")).when(timed_n < least, timed_n).otherwise(near_n)
    base = F.lit(BASE_SECONDS[""])
    for start, seconds in BASE_SECONDS.items():
        base = F.when(F.col("report_type").startswith(start), seconds).otherwise(base) if start else base
    fixed = (F.col("found") < least) | (timed_n < least) | (near_n < least)
    known = estimate_duration(timed.where(F.coalesce("elapsed_seconds", F.lit(0.0)) != 0), last)
    return types.join(known, "report_type", "left").select("report_type", F.when(fixed, base).otherwise(F.col("estimate")).alias("estimated_seconds"), basis.cast("long").alias("based_on_scans"), fixed.alias("is_fixed_estimate"))


def usage_summary(calls: DataFrame) -> DataFrame:
    """Calls and tokens per model, and in all (model null)."""
    return calls.rollup("model").agg(F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))


#: Prices of a million prompt and completion tokens of a model that is not listed.
OTHER_PRICES = (0.15, 0.6)


def call_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls with cost. prices: model, i, o (per million prompt and completion tokens)."""
    i, o = (F.coalesce(c, F.lit(v)) for c, v in zip(("i", "o"), OTHER_PRICES, strict=True))
    cost = (F.col("prompt_tokens") * i + F.col("completion_tokens") * o) / 1e6
    return calls.join(T.small(prices), "model", "left").withColumn("cost", F.round(cost, 9)).drop("i", "o")


def latest_audit(calls: DataFrame, extractor: str, n: int = 50) -> DataFrame:
    return calls.where(F.col("extractor") == extractor).orderBy(F.desc("ts"), F.desc("call_id")).limit(n)


def last_messages(messages: DataFrame, n: int = 20) -> DataFrame:
    """(conv_id, rendered): the last messages of each chat in order, a line each."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("text"))
    last = messages.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= n)
    line = lambda x: F.concat(F.coalesce(x["role"], F.lit("")), F.lit(": "), F.coalesce(x["text"], F.lit("")))
    return last.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), line), "\n").alias("rendered"))
