"""Answers about organizations and low scores applied to rows, each with the sentence that says why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jobs import OTHER_PRICES

NO_REASON = "No reason provided"


def noted(notes: Column, text: Column) -> Column:
    """Notes (an array, null for none) with one more, if there is one."""
    own = F.coalesce(notes, F.array().cast("array<string>"))
    return F.when(text.isNull(), own).otherwise(F.array_append(own, text))


def verify_orgs(orgs: DataFrame, verdicts: DataFrame, least: float = 0.9, step: float = 0.2, reviewer: str = "GPT-4o") -> DataFrame:
    """orgs (org_key, third_party_confidence, confidence_justification array) after a second look at those of `least` or more:
    `step` up to 1 if confirmed, down to 0 if not, 3 digits, with the reason. verdicts: org_key, is_likely_subservice_org,
    reason, error; one a key. An answer that failed (error) leaves the score and says so; a row without an answer stays."""
    v = verdicts.select("org_key", F.struct("is_likely_subservice_org", "reason", "error").alias("_v"))
    j = orgs.join(v, "org_key", "left")
    asked = (F.col("third_party_confidence") >= least) & F.col("_v").isNotNull()
    failed, yes = F.col("_v.error").isNotNull(), F.coalesce(F.col("_v.is_likely_subservice_org"), F.lit(False))
    score = F.col("third_party_confidence")
    new = F.when(yes, F.least(F.lit(1.0), F.round(score + step, 3))).otherwise(F.greatest(F.lit(0.0), F.round(score - step, 3)))
    said = F.when(yes, f"confirmed as subservice org (+{step})").otherwise(f"NOT a subservice org (-{step})")
    note = F.when(failed, F.concat(F.lit(f"{reviewer} review failed: "), "_v.error")).otherwise(F.concat(F.lit(f"{reviewer} review: "), said, F.lit(". Reason: "), F.coalesce("_v.reason", F.lit(NO_REASON))))
    out = j.withColumn("confidence_justification", noted(F.col("confidence_justification"), F.when(asked, note)))
    return out.withColumn("third_party_confidence", F.when(asked & ~failed, new).otherwise(score)).drop("_v")


def reject_orgs(orgs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """orgs with score 0 and the reason where an answer (verdicts: org_key, keep, reason; one a key) says not to keep them. Missing
    and unreadable answers (keep null) keep a row as it is."""
    v = verdicts.select("org_key", F.struct("keep", "reason").alias("_v"))
    out = F.coalesce(F.col("_v.keep") == F.lit(False), F.lit(False))
    note = F.when(out, F.concat(F.lit("Filtered by GPT: "), F.coalesce("_v.reason", F.lit(NO_REASON))))
    j = orgs.join(v, "org_key", "left").withColumn("confidence_justification", noted(F.col("confidence_justification"), note))
    return j.withColumn("third_party_confidence", F.when(out, 0.0).otherwise(F.col("third_party_confidence"))).drop("_v")


def flag_low(rows: DataFrame, score: str, notes: str, kind: str, below: float = 0.5) -> DataFrame:
    """rows with a sentence added to their notes (a text) where the score is below `below`, not 0, and not noted yet, and
    `flagged`. kind is what the sentence calls a row. Applied twice it changes nothing more."""
    low = (F.col(score) < below) & (F.col(score) != 0) & ~F.contains(F.lower(F.coalesce(notes, F.lit(""))), F.lit("low confidence"))
    flagged = F.coalesce(low, F.lit(False))
    sentence = F.concat(F.coalesce(notes, F.lit("")), F.format_string(f"\\nAutomated cleanup: Low confidence {kind} (confidence: %.2f)", F.col(score)))
    return rows.withColumn("flagged", flagged).withColumn(notes, F.when(F.col("flagged"), sentence).otherwise(F.col(notes)))


def flag_counts(flagged: DataFrame, by: str = "scan_id") -> DataFrame:
    return flagged.groupBy(by).agg(F.count_if("flagged").alias("flagged"))


def usage_totals(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """One row: gpt_cost (4 digits), gpt_model (`model (n calls)` of each, by name), total_calls and total_tokens of calls (model,
    prompt_tokens, completion_tokens). prices: model, i, o per million tokens, each model once; others at OTHER_PRICES. Calls
    are summed by model first. No calls: zeros and an empty list."""
    n = lambda c: F.coalesce(F.sum(c), F.lit(0))
    by = calls.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), n("prompt_tokens").alias("p"), n("completion_tokens").alias("c"))
    priced = by.join(prices, "model", "left").withColumn("cost", (F.col("p") * F.coalesce("i", F.lit(OTHER_PRICES[0])) + F.col("c") * F.coalesce("o", F.lit(OTHER_PRICES[1]))) / 1e6)
    said = F.transform(F.array_sort(F.collect_list(F.struct("model", "calls"))), lambda x: F.format_string("%s (%d calls)", x["model"], x["calls"]))
    return priced.agg(F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 4).alias("gpt_cost"), F.array_join(said, ", ").alias("gpt_model"), n("calls").alias("total_calls"), n(F.col("p") + F.col("c")).alias("total_tokens"))
