"""Operators over controls: selection, quality flags, duplicates, merging, statistics. Keys carry the report (scan_id),
so each operator covers any number of reports at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportlake.functions import text as T

INSTANCE = "DUPLICATE_INSTANCE"
#: Thresholds and weights of the duplicate scores.
PAGE_BONUS, INCOMPLETE_PENALTY = 0.05, 0.20


def pages(first: Column, last: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array(first, last)))


def active_controls(controls: DataFrame) -> DataFrame:
    return controls.where(F.col("merged_to_control_id").isNull() | (F.col("merged_to_control_id") == INSTANCE))


def filter_by_confidence(df: DataFrame, column: str, least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected); a missing confidence counts as 0."""
    c = F.coalesce(F.col(column), F.lit(0.0))
    return df.where(c >= least), df.where(c < least)


def high_low_split(df: DataFrame, column: str, threshold: float = 0.75) -> DataFrame:
    """df with `band`: high needs the threshold (missing counts as 1) and no merge mark."""
    high = (F.coalesce(F.col(column), F.lit(1.0)) >= threshold) & F.col("merged_to_control_id").isNull()
    return df.withColumn("band", F.when(high, "high").otherwise("low"))


def exclude_ignored(df: DataFrame, ignored: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ignored.select(key).distinct(), key, "left_anti")


def list_deviations(controls: DataFrame, least: float = 0.75) -> DataFrame:
    return controls.where(F.col("has_deviation") & (F.col("control_confidence") >= least)).withColumn("page", F.col("page_first"))


def column_contains(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    for c, v in wanted.items():
        df = df.where(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(v.lower()))
    return df


def validate_controls(controls: DataFrame) -> DataFrame:
    """Rows with a description, markers stripped and defaults filled in."""
    desc = F.trim(T.strip_line_markers(F.col("control_desc")))
    out = controls.withColumn("control_desc", desc).where(F.coalesce(desc, F.lit("")) != "")
    note = F.when(F.col("control_confidence").isNull(), F.lit("default confidence"))
    return out.withColumn("confidence_note", note).withColumn("control_confidence", F.coalesce("control_confidence", F.lit(0.5))).withColumn("has_deviation", F.coalesce("has_deviation", F.lit(False)))


def flag_blank_ids(controls: DataFrame, cap: float = 0.1) -> DataFrame:
    blank = F.trim(F.coalesce("control_id", F.lit(""))) == ""
    return controls.withColumn("note", F.when(blank, F.lit("blank control id"))).withColumn("control_confidence", F.when(blank, F.least("control_confidence", F.lit(cap))).otherwise(F.col("control_confidence")))


def penalize_incomplete(controls: DataFrame, penalty: float = INCOMPLETE_PENALTY) -> DataFrame:
    """Active rows lose the penalty (floor 0) if any of four fields is blank; missing_fields lists them."""
    fields = ["control_id", "control_desc", "control_test", "control_test_results"]
    missing = F.array_compact(F.array(*[F.when(F.trim(F.coalesce(F.col(f), F.lit(""))) == "", F.lit(f)) for f in fields]))
    active = F.col("merged_to_control_id").isNull() | (F.col("merged_to_control_id") == INSTANCE)
    out = controls.withColumn("missing_fields", F.when(active, F.array_join(missing, ", ")).otherwise(""))
    return out.withColumn("control_confidence", F.when(F.col("missing_fields") != "", F.greatest(F.lit(0.0), F.col("control_confidence") - penalty)).otherwise(F.col("control_confidence")))


def backfill_deviation(controls: DataFrame) -> DataFrame:
    after = F.nullif(F.trim(F.regexp_extract(F.col("control_test_results"), r"(?i)deviation noted\.\s*(.*)", 1)), F.lit(""))
    mentions = F.lower("control_test_results").contains("deviation") | F.lower("control_test_results").contains("exception")
    return controls.withColumn("deviation_desc", F.when(F.col("has_deviation"), F.coalesce(after, F.when(mentions, F.substring("control_test_results", 1, 300)))))


def pick_primary(controls: DataFrame) -> DataFrame:
    """Rank within (scan_id, trimmed id): confidence (missing as 0), then order. Blank ids form no group."""
    keyed = controls.withColumn("key", F.trim("control_id")).where("key <> ''")
    w = Window.partitionBy("scan_id", "key").orderBy(F.desc(F.coalesce("control_confidence", F.lit(0.0))), "control_seq", "id")
    return keyed.withColumn("rn", F.row_number().over(w))


def pick_merge_primary(controls: DataFrame) -> DataFrame:
    keyed = controls.withColumn("key", F.trim("control_id")).where("key <> ''")
    w = Window.partitionBy("scan_id", "key").orderBy(F.desc(F.length("control_desc")), F.desc(F.coalesce("control_confidence", F.lit(0.0))), "id")
    return keyed.withColumn("rn", F.row_number().over(w))


PAIR_FIELDS = ["id", "control_desc", "control_test", "has_deviation", "page_first", "page_last", "criterion"]


def duplicate_pairs(controls: DataFrame) -> DataFrame:
    """Each further row of an id group next to the group's primary (columns a_* and b_*). One window makes the pairs, so
    the group is shuffled once."""
    keyed = controls.withColumn("key", F.trim("control_id")).where("key <> ''")
    w = Window.partitionBy("scan_id", "key").orderBy(F.desc(F.coalesce("control_confidence", F.lit(0.0))), "control_seq", "id")
    own = F.struct(*PAIR_FIELDS)
    ranked = keyed.select("scan_id", "key", own.alias("b"), F.first(own).over(w).alias("a"), F.row_number().over(w).alias("rn")).where("rn > 1")
    return ranked.select("scan_id", "key", *[F.col(f"a.{c}").alias(f"a_{c}") for c in PAIR_FIELDS], *[F.col(f"b.{c}").alias(f"b_{c}") for c in PAIR_FIELDS])


def fallback_similarity(a: Column, b: Column) -> Column:
    """Text equality gives 1, anything else 0.6."""
    return F.when(F.lower(F.trim(a)) == F.lower(F.trim(b)), 1.0).otherwise(0.6)


def _test_score() -> Column:
    a, b = F.lower(F.trim(F.coalesce("a_control_test", F.lit("")))), F.lower(F.trim(F.coalesce("b_control_test", F.lit(""))))
    both = (a != "") & (b != "")
    return F.when(both & (a == b), 0.10).when(both & (F.length(a) > 20) & (F.length(b) > 20) & (F.substring(a, 1, 50) == F.substring(b, 1, 50)), 0.07).otherwise(0.0)


def _tests_differ() -> Column:
    a, b = F.lower(F.trim(F.coalesce("a_control_test", F.lit("")))), F.lower(F.trim(F.coalesce("b_control_test", F.lit(""))))
    return (a != "") & (b != "") & (a != b)


def _pair_pages() -> tuple[Column, Column]:
    return pages(F.col("a_page_first"), F.col("a_page_last")), pages(F.col("b_page_first"), F.col("b_page_last"))


def duplicate_class(pairs: DataFrame, similarity=fallback_similarity) -> DataFrame:
    """pairs with score, class and page_distance; `similarity` may be replaced by any column of the two descriptions."""
    a, b = _pair_pages()
    crit_same = F.coalesce(F.col("a_criterion") == F.col("b_criterion"), F.lit(False))
    crit_differ = F.coalesce(F.col("a_criterion") != F.col("b_criterion"), F.lit(False))
    dev_differ = F.col("a_has_deviation") != F.col("b_has_deviation")
    out = pairs.withColumn("sim", similarity(F.col("a_control_desc"), F.col("b_control_desc"))).withColumn("page_distance", T.page_distance(a, b))
    bonus = F.when(F.col("page_distance") <= 1, PAGE_BONUS).otherwise(0.0)
    base = 0.70 * F.col("sim") + F.when(crit_same, 0.15).otherwise(0.0) + _test_score() + F.when(dev_differ, 0.0).otherwise(0.05) + bonus
    out = out.withColumn("base", base).withColumn("crit_differ", crit_differ).withColumn("varies", _tests_differ() | dev_differ)
    high, mid = F.col("sim") >= 0.85, F.col("sim") >= 0.70
    kind = F.when(high & F.col("crit_differ"), "CRITERIA_VARIANT").when(high & F.col("varies"), "TEST_VARIANT").when(high, "IDENTICAL").when(mid & ~F.col("crit_differ") & ~F.col("varies"), "IDENTICAL").otherwise("AMBIGUOUS")
    score = F.when(high & F.col("crit_differ"), F.least("base", F.lit(0.95))).when(high & F.col("varies"), F.least("base", F.lit(0.90))).when(high, F.col("base"))
    score = score.when(mid & ~F.col("crit_differ") & ~F.col("varies"), F.col("base")).when(mid, F.least(F.col("base") * 0.85, F.lit(0.80))).otherwise(F.least(F.col("base") * 0.80, F.lit(0.75)))
    return out.withColumn("class", kind).withColumn("score", F.round(score, 6)).drop("base", "crit_differ", "varies")


def auto_merge_decision(pairs: DataFrame, similarity=fallback_similarity, merge_at: float = 0.70, error_below: float = 0.60) -> DataFrame:
    near = (F.abs(F.col("a_page_last") - F.col("b_page_first")) <= 1) | (F.abs(F.col("b_page_last") - F.col("a_page_first")) <= 1)
    crit_same = F.coalesce(F.col("a_criterion") == F.col("b_criterion"), F.lit(False))
    base = 0.65 * similarity(F.col("a_control_desc"), F.col("b_control_desc")) + F.when(crit_same, 0.15).otherwise(0.0) + _test_score() + F.when(F.col("a_has_deviation") == F.col("b_has_deviation"), 0.05).otherwise(0.0) + F.when(near, PAGE_BONUS).otherwise(0.0)
    out = pairs.withColumn("merge_score", F.round(base, 6))
    return out.withColumn("decision", F.when(F.col("merge_score") >= merge_at, "merge").when(F.col("merge_score") < error_below, "cap").otherwise("keep"))


def top_suggestions(pairs: DataFrame, least: float = 0.50, n: int = 50) -> DataFrame:
    return pairs.where(F.col("score") >= least).orderBy(F.desc("score"), "a_id", "b_id").limit(n)


def suggestion_actions(pairs: DataFrame) -> DataFrame:
    action = F.when(F.col("class") == "IDENTICAL", "merge").when(F.col("class").isin("CRITERIA_VARIANT", "TEST_VARIANT"), "link_as_instances").otherwise("review_manually")
    return pairs.groupBy(action.alias("action")).agg(F.count(F.lit(1)).alias("n"))


def consolidate_group(controls: DataFrame) -> DataFrame:
    """One merged row per (scan_id, key) group of two or more."""
    keyed = controls.withColumn("key", F.trim("control_id")).where("key <> ''")
    longest = lambda c: F.max_by(F.col(c), F.struct(F.length(F.col(c)), -F.col("id")))
    out = keyed.groupBy("scan_id", "key").agg(
        F.count(F.lit(1)).alias("n"), longest("control_desc").alias("control_desc"), longest("control_test").alias("control_test"),
        F.bool_or("has_deviation").alias("has_deviation"), F.max("control_confidence").alias("control_confidence"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("page_first", "page_last"))))), ",").alias("pages"),
        F.array_join(F.array_sort(F.collect_list("id")), ",").alias("merged_ids"),
    )
    return out.where("n > 1")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.coalesce(F.trim(F.col(key)), F.lit("")) != "").groupBy(F.lower(F.trim(F.col(key))).alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def number_instances(controls: DataFrame) -> DataFrame:
    keyed = controls.withColumn("key", F.trim("control_id")).where("key <> ''")
    w = Window.partitionBy("scan_id", "key")
    return keyed.withColumn("instance_number", F.row_number().over(w.orderBy("control_seq", "id")).cast("long")).withColumn("total_instances", F.count(F.lit(1)).over(w))


def duplicate_groups(controls: DataFrame) -> DataFrame:
    keyed = controls.withColumn("key", F.trim("control_id")).where("key <> ''")
    members = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("control_seq", "id"))), lambda x: x["id"].cast("string")), ",")
    return keyed.groupBy("scan_id", "key").agg(members.alias("members"), F.count(F.lit(1)).alias("n")).where("n > 1")


def learn_patterns(controls: DataFrame, least: float = 0.9) -> DataFrame:
    """(organization, pattern) with frequency, first and last sighting and number of reports."""
    seen = controls.where(F.col("control_confidence") >= least).withColumn("pattern", T.id_pattern(F.col("control_id"))).where("pattern is not null")
    return seen.groupBy("organization", "pattern").agg(F.count(F.lit(1)).alias("frequency"), F.min("updated_at").alias("first_seen"), F.max("updated_at").alias("last_seen"), F.countDistinct("scan_id").alias("n_scans"))


def fold_patterns(state: DataFrame, learned: DataFrame) -> DataFrame:
    """Stored frequencies and newly learned ones as one table."""
    both = state.select("organization", "pattern", "frequency", "first_seen", "last_seen").unionByName(learned.select("organization", "pattern", "frequency", "first_seen", "last_seen"))
    return both.groupBy("organization", "pattern").agg(F.sum("frequency").alias("frequency"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def org_profile(patterns: DataFrame) -> DataFrame:
    w = Window.partitionBy("organization")
    total = F.sum("frequency").over(w)
    return patterns.select("organization", "pattern", "frequency", F.count(F.lit(1)).over(w).alias("total_patterns"), total.alias("total_occurrences"), F.round(F.col("frequency") / total * 100, 1).alias("pct"))


def prune_patterns(patterns: DataFrame, least: int = 5) -> DataFrame:
    return patterns.where(F.col("frequency") >= least)


def id_consensus(controls: DataFrame) -> DataFrame:
    """Most common id signature per report, each id's positional score against it and the anomaly flag."""
    sig = controls.where(F.coalesce("control_id", F.lit("")) != "").withColumn("signature", T.id_signature(F.col("control_id")))
    counts = sig.groupBy("scan_id", "signature").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("scan_id").agg(F.max_by("signature", F.struct("n", "signature")).alias("consensus"), F.max("n").alias("consensus_n"), F.sum("n").alias("ids"))
    scored = sig.join(best, "scan_id").withColumn("score", F.round(T.positional_match(F.col("signature"), F.col("consensus")), 6))
    enough = F.col("consensus_n") >= F.greatest(F.lit(20.0), F.col("ids") * 0.1)
    return scored.withColumn("anomaly", (F.col("score") < 0.5) & enough)


def baseline_metrics(controls: DataFrame) -> DataFrame:
    """Per report: counts that a stored run is compared by."""
    return controls.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("control_test").isNotNull()).alias("with_test"),
        F.count_if("has_deviation").alias("deviations"), F.round(F.avg("control_confidence"), 4).alias("avg_confidence"),
        F.count_if(F.col("control_confidence") < 0.5).alias("ambiguous"), F.count_if(F.col("control_test_results").isNull()).alias("partial"),
    )


def baseline_regressions(current: DataFrame, baseline: DataFrame) -> DataFrame:
    b = baseline.select("scan_id", *[F.col(c).alias(f"b_{c}") for c in ("total", "with_test", "ambiguous", "partial")])
    j = current.join(b, "scan_id")
    pct = F.when(F.col("b_total") > 0, (F.col("total") - F.col("b_total")) / F.col("b_total") * 100).otherwise(0.0)
    tests = F.when(F.col("b_with_test") > 0, (F.col("with_test") - F.col("b_with_test")) / F.col("b_with_test") * 100).otherwise(0.0)
    flags = F.array_compact(F.array(F.when(pct < -5, F.lit("controls")), F.when(F.col("ambiguous") > 1.5 * F.col("b_ambiguous"), F.lit("ambiguous")), F.when(F.col("partial") > 0, F.lit("partial")), F.when(tests < -10, F.lit("tests"))))
    return j.select("scan_id", (F.col("total") - F.col("b_total")).alias("delta"), F.round(pct, 4).alias("pct"), F.array_join(flags, ",").alias("flags"))


def recall_against_source(truth: DataFrame, extracted: DataFrame, key: str = "control_id") -> DataFrame:
    t, e = truth.select("scan_id", key).distinct().withColumn("t", F.lit(1)), extracted.select("scan_id", key).distinct().withColumn("e", F.lit(1))
    both = t.join(e, ["scan_id", key], "full_outer")
    found, missing, extra = F.count_if(F.col("t").isNotNull() & F.col("e").isNotNull()), F.count_if(F.col("e").isNull()), F.count_if(F.col("t").isNull())
    return both.groupBy("scan_id").agg(found.alias("found"), missing.alias("missing"), extra.alias("extra")).withColumn("rate", F.when(F.col("found") + F.col("missing") > 0, F.round(F.col("found") / (F.col("found") + F.col("missing")), 4)))


def snapshot_diff(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, before, after) of every field that differs; a missing row differs in all its fields."""
    left = a.select(F.col(key), F.struct(*fields).alias("x"), F.lit(True).alias("in_a"))
    right = b.select(F.col(key), F.struct(*fields).alias("y"), F.lit(True).alias("in_b"))
    j = left.join(right, key, "full_outer")
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"x.{f}").cast("string").alias("before"), F.col(f"y.{f}").cast("string").alias("after")) for f in fields])
    return j.select(key, F.explode(each).alias("d")).select(key, "d.*").where(~F.col("before").eqNullSafe(F.col("after")))


def overlapping_ranges(controls: DataFrame) -> DataFrame:
    w = Window.partitionBy("scan_id").orderBy("page_first", "page_last", "id")
    nxt = controls.withColumn("next_first", F.lead("page_first").over(w)).withColumn("next_id", F.lead("id").over(w))
    return nxt.where("page_last > next_first")


def budgeted_results(controls: DataFrame, n: int = 15) -> DataFrame:
    w = Window.partitionBy("scan_id").orderBy(F.desc("has_deviation"), "control_seq", "id")
    return controls.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def invalidate_off_pages(controls: DataFrame, wanted: list[int], least: float = 0.75) -> DataFrame:
    off = ~F.arrays_overlap(pages(F.col("page_first"), F.col("page_last")), F.array(*[F.lit(p) for p in wanted])) & (F.col("control_confidence") >= least)
    return controls.withColumn("control_confidence", F.when(off, 0.0).otherwise(F.col("control_confidence"))).withColumn("log", F.when(off, T.append_log(F.lit(None).cast("string"), F.lit("not on the given pages"))))


def link_instances(controls: DataFrame) -> DataFrame:
    """Group id from the sorted member ids, so that it is the same in every run, and the instance mark."""
    groups = duplicate_groups(controls).select("scan_id", "key", F.sha1("members").alias("duplicate_group_id"))
    return controls.withColumn("key", F.trim("control_id")).join(groups, ["scan_id", "key"], "left").withColumn("marker", F.when(F.col("duplicate_group_id").isNotNull(), INSTANCE))


HISTORY = "array<struct<type:string,confidence:double,merged_from_ids:array<string>,reason:string>>"
NO_SAVED_CONFIDENCE = 0.5


def record_merges(primaries: DataFrame, merged: DataFrame, kind: str = "manual", reason: str = "Manual merge via UI") -> DataFrame:
    """primaries (id, merge_history of type HISTORY) with one event appended for the controls (id, merged_to) that were
    merged into each; others stay as they are."""
    ids = merged.groupBy(F.col("merged_to").alias("id")).agg(F.array_sort(F.collect_set(F.col("id").cast("string"))).alias("_ids"))
    event = F.struct(F.lit(kind).alias("type"), F.lit(None).cast("double").alias("confidence"), F.col("_ids").alias("merged_from_ids"), F.lit(reason).alias("reason"))
    old = F.coalesce("merge_history", F.array().cast(HISTORY))
    return primaries.join(ids, "id", "left").withColumn("merge_history", F.when(F.col("_ids").isNotNull(), F.array_append(old, event)).otherwise(F.col("merge_history"))).drop("_ids")


def merged_away(controls: DataFrame) -> DataFrame:
    """Merged controls with confidence 0 and the old one saved as a line of JSON in the annotation."""
    gone = F.col("merged_to_control_id").isNotNull()
    saved = F.to_json(F.struct(F.col("control_confidence").alias("original_confidence")))
    return controls.withColumn("annotation", F.when(gone, F.concat_ws("\n", "annotation", saved)).otherwise(F.col("annotation"))).withColumn("control_confidence", F.when(gone, 0.0).otherwise(F.col("control_confidence")))


def split_controls(controls: DataFrame, wanted: DataFrame) -> DataFrame:
    """controls with the merges of the wanted ids undone: the mark goes, the first saved confidence of the annotation comes
    back (0.5 without one), and a note is added. Ids that are not merged stay as they are."""
    lines = F.filter(F.split(F.coalesce("annotation", F.lit("")), "\n"), lambda x: F.startswith(F.trim(x), F.lit("{")))
    saved = F.filter(F.transform(lines, lambda x: F.from_json(x, "original_confidence double")["original_confidence"]), lambda v: v.isNotNull())
    confidence = F.coalesce(F.get(saved, F.lit(0)), F.lit(NO_SAVED_CONFIDENCE))
    j = controls.join(wanted.select("id").distinct().withColumn("_split", F.lit(True)), "id", "left")
    hit = F.coalesce("_split", F.lit(False)) & F.col("merged_to_control_id").isNotNull()
    j = j.withColumn("_split", hit).withColumn("control_confidence", F.when(hit, confidence).otherwise(F.col("control_confidence")))
    note = F.concat(F.lit("Split, confidence restored to "), F.col("control_confidence").cast("string"))
    return j.withColumn("annotation", F.when(F.col("_split"), F.concat_ws("\n", "annotation", note)).otherwise(F.col("annotation"))).withColumn("merged_to_control_id", F.when(~F.col("_split"), F.col("merged_to_control_id"))).drop("_split")


def partial_extraction(desc: Column, assertions: Column, least: int = 50) -> Column:
    """A long description without assertions, or a single assertion."""
    n = F.coalesce(F.size(assertions), F.lit(0))
    n = F.when(n < 0, 0).otherwise(n)
    return ((F.length(F.trim(F.coalesce(desc, F.lit("")))) > least) & (n == 0)) | (n == 1)


def partial_controls(parsed: DataFrame, estimates: DataFrame, limit: int = 0, min_pct: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(minimal rows of what is parsed so far, at most `limit` per report if that is set; per report the numbers shown and
    parsed, completion in percent of the estimate, or of 100 controls without one, and whether it reaches min_pct).
    estimates: scan_id, estimate."""
    named = (F.coalesce("control_id", F.lit("")) != "") | (F.coalesce("control_desc", F.lit("")) != "")
    rows = parsed.where(named).select("scan_id", "control_seq", "control_id", "control_desc", "has_deviation")
    if limit > 0:
        order = Window.partitionBy("scan_id").orderBy("control_seq", "control_id", "control_desc")
        rows = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")
    shown = F.count_if(named)
    per = parsed.groupBy("scan_id").agg(F.count(F.lit(1)).alias("total_parsed"), (F.least(shown, F.lit(limit)) if limit > 0 else shown).cast("long").alias("count"))
    known = F.coalesce("estimate", F.lit(0)) > 0
    pct = F.when(known, F.round(100.0 * F.col("total_parsed") / F.col("estimate"), 2)).otherwise(F.least(F.lit(100.0), F.col("total_parsed").cast("double")))
    per = per.join(estimates, "scan_id", "left").withColumn("completion_pct", pct).withColumn("threshold_met", F.col("completion_pct") >= min_pct)
    return rows, per


def context_counts(scans: DataFrame, controls: DataFrame, cuecs: DataFrame, orgs: DataFrame, high: float = 0.7) -> DataFrame:
    """Totals per report, 0 where it has none; user-entity controls with a confidence are split at `high`."""
    c = controls.groupBy("scan_id").agg(F.count(F.lit(1)).alias("controls"), F.count_if("has_deviation").alias("deviations"))
    scored = F.coalesce("cuec_confidence", F.lit(0.0)) != 0
    u = cuecs.groupBy("scan_id").agg(F.count(F.lit(1)).alias("cuecs"), F.count_if(scored & (F.col("cuec_confidence") >= high)).alias("cuecs_high"), F.count_if(scored & (F.col("cuec_confidence") < high)).alias("cuecs_low"))
    o = orgs.groupBy("scan_id").agg(F.count(F.lit(1)).alias("orgs"))
    out = scans.select("scan_id").distinct().join(c, "scan_id", "left").join(u, "scan_id", "left").join(o, "scan_id", "left")
    return out.fillna(0)


def extraction_diagnostics(raw: DataFrame, merged: DataFrame, least: float = 0.5) -> DataFrame:
    """Counts per report over the stages of an extraction. raw: scan_id, continuation; merged: scan_id, control_confidence,
    has_deviation, assertions."""
    r = raw.groupBy("scan_id").agg(F.count(F.lit(1)).alias("raw"), F.count_if("continuation").alias("continuations"))
    c = F.coalesce("control_confidence", F.lit(0.0))
    good = c >= least
    m = merged.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("after_merge"), F.count_if(~good).alias("rejected"), F.count_if(good).alias("final"), F.round(F.coalesce(F.avg(F.when(good, c)), F.lit(0.0)), 3).alias("avg_confidence"),
        F.count_if(good & F.coalesce("has_deviation", F.lit(False))).alias("deviations"), F.count_if(good & (F.size("assertions") > 0)).alias("with_assertions"),
    )
    return r.join(m, "scan_id", "left").fillna(0).withColumn("merged_away", F.col("raw") - F.col("after_merge"))


def low_confidence_notes(cuecs: DataFrame, below: float = 0.5) -> DataFrame:
    """(id, note) of rows with a confidence under the bound; 0 and none mean that there is no verdict."""
    c = F.col("cuec_confidence")
    return cuecs.where((c != 0) & (c < below)).select("id", F.lit("low confidence").alias("note"))


#: Wording of a description with wording of a test that does not go with it.
CONTRADICTIONS = [("security policy", "background check")]


def logically_consistent(desc: Column, test: Column) -> Column:
    low = [F.lower(F.coalesce(c, F.lit(""))) for c in (desc, test)]
    bad = F.lit(False)
    for a, b in CONTRADICTIONS:
        bad = bad | (F.contains(low[0], F.lit(a)) & F.contains(low[1], F.lit(b)))
    return ~bad
