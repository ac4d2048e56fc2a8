"""Framework mapping and coverage."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reportlake.functions import text as T


def validate_matches(matches: DataFrame, criteria: DataFrame, least: float = 0.6) -> DataFrame:
    """Matches whose criterion exists in the framework. Criteria are a catalogue of fixed size, so they may be broadcast."""
    known = criteria.select("framework", F.col("id").alias("criterion_id")).distinct()
    return matches.where(F.coalesce("confidence", F.lit(0.0)) >= least).join(known, ["framework", "criterion_id"], "left_semi")


def top_k_matches(matches: DataFrame, k: int = 5) -> DataFrame:
    w = Window.partitionBy("control_db_id", "framework").orderBy(F.desc("confidence"), "criterion_id")
    return matches.withColumn("pos", F.row_number().over(w).cast("long")).where(F.col("pos") <= k)


def primary_mapping(matches: DataFrame) -> DataFrame:
    """Best match of an entity; ties go to the smaller framework, then criterion."""
    order = F.struct((-F.col("confidence")).alias("c"), F.col("framework"), F.col("criterion_id"))
    best = matches.groupBy("control_db_id").agg(F.min(order).alias("m"))
    return best.select("control_db_id", F.col("m.framework").alias("primary_framework"), F.col("m.criterion_id").alias("primary_criterion"), (-F.col("m.c")).alias("primary_confidence"))


def framework_coverage(criteria: DataFrame, control_ids: DataFrame, cuec_ids: DataFrame, text_ids: DataFrame | None = None) -> DataFrame:
    """Per criterion: control before cuec before likely (named in the text) before missed."""
    key = ["framework", "id"]
    out = criteria.join(control_ids.select(*key).distinct().withColumn("by_control", F.lit(True)), key, "left").join(cuec_ids.select(*key).distinct().withColumn("by_cuec", F.lit(True)), key, "left")
    out = out.join(text_ids.select(*key).distinct().withColumn("in_text", F.lit(True)), key, "left") if text_ids is not None else out.withColumn("in_text", F.lit(None).cast("boolean"))
    return out.withColumn("coverage", F.when(F.col("by_control"), "control").when(F.col("by_cuec"), "cuec").when(F.col("in_text"), "likely").otherwise("missed"))


def coverage_totals(covered: DataFrame) -> DataFrame:
    n = lambda kind: F.count_if(F.col("coverage") == kind).alias(kind)
    return covered.groupBy("framework").agg(F.count(F.lit(1)).alias("total"), n("control"), n("cuec"), n("likely"), n("missed"))


def coverage_rollup(covered: DataFrame) -> DataFrame:
    mapped = F.count_if(F.col("coverage") != "missed").alias("mapped")
    return covered.rollup("framework", "section").agg(F.count(F.lit(1)).alias("total"), mapped, F.grouping_id().cast("long").alias("level"))


def criteria_by_section(criteria: DataFrame) -> DataFrame:
    ids = F.array_join(F.array_sort(F.collect_list("id")), ",")
    return criteria.groupBy("framework", F.coalesce("section", F.lit("Unspecified")).alias("section")).agg(ids.alias("ids"), F.count(F.lit(1)).alias("n"))


def mapped_controls_per_criterion(criteria: DataFrame, mappings: DataFrame, controls: DataFrame) -> DataFrame:
    used = mappings.join(controls.select(F.col("id").alias("control_db_id"), "has_deviation"), "control_db_id")
    agg = used.groupBy("framework", F.col("criterion_id").alias("id")).agg(F.countDistinct("control_db_id").alias("n_controls"), F.bool_or("has_deviation").alias("any_deviation"))
    return criteria.join(agg, ["framework", "id"], "left").select("framework", "id", F.coalesce("n_controls", F.lit(0)).alias("n_controls"), F.coalesce("any_deviation", F.lit(False)).alias("any_deviation"))


def framework_usage(controls: DataFrame, mappings: DataFrame) -> DataFrame:
    return mappings.groupBy("framework").agg(F.countDistinct("control_db_id").alias("controls"), F.count(F.lit(1)).alias("mappings"), F.round(F.avg("confidence"), 4).alias("avg_confidence"))


def unexpected_frameworks(mappings: DataFrame, expected: list[str]) -> DataFrame:
    used = mappings.groupBy("control_db_id").agg(F.array_sort(F.collect_set("framework")).alias("used"))
    return used.select("control_db_id", F.array_join(F.array_except("used", F.array(*map(F.lit, expected))), ",").alias("unexpected")).where("unexpected <> ''")


def rejoin_answers(controls: DataFrame, answers: DataFrame) -> DataFrame:
    """First answer of each control, else a failure note."""
    first = answers.groupBy(F.col("control_db_id").alias("id")).agg(F.min_by("framework", F.struct("framework", "criterion_id")).alias("framework"))
    return controls.join(first, "id", "left").withColumn("note", F.when(F.col("framework").isNull(), "mapping failed"))


#: Frameworks with the report types and the standards that they go with, and what a report of a type is
#: mapped to by default.
REGISTRY = {
    "TSC": (["SOC2", "COMBINED"], ["SSAE 18", "AT-C 105", "AT-C 205"]),
    "COSO": (["SOC1", "SOC2", "COMBINED"], ["COSO 2013"]),
    "FINANCIAL_ASSERTIONS": (["SOC1", "COMBINED"], ["SSAE 18", "AT-C 320"]),
    "COSO_ICFR": (["SOC1", "COMBINED"], ["COSO 2013", "PCAOB AS 2201"]),
    "ISAE3402": (["SOC1", "COMBINED"], ["ISAE 3402", "IAASB"]),
    "CSAE3416": (["SOC1", "SOC2", "COMBINED"], ["CSAE 3416", "CPA Canada"]),
    "AAF0106": (["SOC1", "SOC2", "COMBINED"], ["AAF 01/06", "AUASB"]),
    "GS007": (["SOC1", "SOC2", "COMBINED"], ["GS 007", "IDW"]),
    "ISO27001": (["SOC2", "COMBINED"], ["ISO/IEC 27001:2013", "ISO/IEC 27001:2022"]),
    "NIST": (["SOC2", "COMBINED"], ["NIST CSF 1.1", "NIST CSF 2.0"]),
}
DEFAULT_FRAMEWORKS = {"SOC1": ["FINANCIAL_ASSERTIONS", "COSO_ICFR", "COSO"], "SOC2": ["TSC", "COSO"], "COMBINED": ["TSC", "COSO", "FINANCIAL_ASSERTIONS", "COSO_ICFR"]}
#: How further standards are named in a text, in capitals.
STANDARD_PATTERNS = {
    "ISAE3402": r"ISAE\s*3402|INTERNATIONAL STANDARD ON ASSURANCE ENGAGEMENTS",
    "CSAE3416": r"CSAE\s*3416|CANADIAN STANDARD ON ASSURANCE",
    "AAF0106": r"AAF\s*01/?06|AUSTRALIAN AUDITING FRAMEWORK",
    "GS007": r"GS\s*007|IDW\s*PS\s*951|GERMAN AUDITING STANDARD",
    "ISO27001": r"ISO\s*/?27001|ISO/IEC\s*27001",
    "NIST": r"NIST\s*CSF|NIST CYBERSECURITY FRAMEWORK|NIST\s*800",
}


def detect_standards(text: Column, report_type: Column) -> Column:
    """Array of frameworks: the defaults of the report type (none if it is null), then those whose standards are named."""
    default = F.array(*map(F.lit, DEFAULT_FRAMEWORKS["SOC2"]))
    by_type = F.when(report_type.isNull(), F.array().cast("array<string>"))
    for kind, names in DEFAULT_FRAMEWORKS.items():
        by_type = by_type.when(report_type == kind, F.array(*map(F.lit, names)))
    upper = F.upper(text)
    named = F.array_compact(F.array(*[F.when(upper.rlike(p), F.lit(name)) for name, p in STANDARD_PATTERNS.items()]))
    return F.array_distinct(F.concat(by_type.otherwise(default), named))


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in REGISTRY.items()], "framework string, report_types array<string>, standards array<string>")


def frameworks_for(reports: DataFrame, known: DataFrame, criteria: DataFrame) -> DataFrame:
    """(id, framework): frameworks that list the report's type (SOC2 if it is unknown), and those of which a standard
    contains one that was detected, as far as they have criteria. reports: id, report_type, standards (array). Types and
    distinct standards are matched with the registry, not reports."""
    types = [t for t in DEFAULT_FRAMEWORKS]
    kind = F.when(F.col("report_type").isin(*types), F.col("report_type")).otherwise("SOC2")
    live = known.join(criteria.select("framework").distinct(), "framework", "left_semi")
    by_type = live.select("framework", F.explode("report_types").alias("kind"))
    first = reports.select("id", kind.alias("kind")).join(by_type, "kind").select("id", "framework")
    asked = reports.select("id", F.explode("standards").alias("standard")).where("standard is not null")
    listed = live.select("framework", F.explode("standards").alias("own"))
    match = T.small(listed).join(asked.select("standard").distinct(), F.contains(F.upper("own"), F.upper("standard"))).select("standard", "framework").distinct()
    return first.union(asked.join(match, "standard").select("id", "framework")).distinct()


#: The note on a deviation in a prompt, and the length at which its wording is cut.
DEVIATION_NOTE = "\nNOTE: This control has a documented deviation/exception: {}\nConsider criteria related to monitoring, deficiency reporting, or control evaluation."
DEVIATION_CHARS = 80


def render_prompt(template: str, desc: Column, criteria: Column, has_deviation: Column, deviation: Column) -> Column:
    """template with {control_desc}, {criteria_list} and {deviation_context} filled in. criteria: array of structs with id
    and description, principle and name, of which the first that is set is shown. The parts are joined, so braces inside
    the values stay as they are."""
    shown = lambda c: F.coalesce(c["description"], c["principle"], c["name"], F.lit("N/A"))
    listed = F.array_join(F.transform(criteria, lambda c: F.concat(F.lit("- "), F.coalesce(c["id"], F.lit("N/A")), F.lit(": "), shown(c))), "\n")
    short = F.when(F.length(deviation) > DEVIATION_CHARS, F.concat(F.substring(deviation, 1, DEVIATION_CHARS), F.lit("..."))).otherwise(deviation)
    head, tail = DEVIATION_NOTE.split("{}")
    note = F.when(has_deviation & (F.coalesce(deviation, F.lit("")) != ""), F.concat(F.lit(head), short, F.lit(tail))).otherwise("")
    values = {"control_desc": F.coalesce(desc, F.lit("")), "criteria_list": listed, "deviation_context": note}
    parts = re.split(r"\{(control_desc|criteria_list|deviation_context)\}", template)
    return F.concat(*[values[p] if k % 2 else F.lit(p) for k, p in enumerate(parts)])


#: Words of a domain's name, in the order in which they are tried, with the prefixes of its criteria.
DOMAIN_PREFIXES = {"confidential": ["Conf"], "availability": ["A"], "privacy": ["P"], "processing": ["PI"]}
OTHER_PREFIXES = ["C", "CC"]


def domain_criteria(domains: DataFrame, criteria: DataFrame) -> DataFrame:
    """(domain, id) of the criteria whose id begins with a prefix of the domain; a missing domain gives all. Prefixes are
    joined on equal beginnings."""
    low = F.lower("domain")
    prefixes = F.when(F.coalesce("domain", F.lit("")) == "", F.array(F.lit("")))
    for word, found in DOMAIN_PREFIXES.items():
        prefixes = prefixes.when(F.contains(low, F.lit(word)), F.array(*map(F.lit, found)))
    asked = domains.select("domain", F.explode(prefixes.otherwise(F.array(*map(F.lit, OTHER_PREFIXES)))).alias("prefix")).distinct()
    sizes = sorted({len(p) for ps in DOMAIN_PREFIXES.values() for p in ps} | {len(p) for p in OTHER_PREFIXES} | {0})
    heads = F.filter(F.array(*[F.substring("id", 1, n) for n in sizes]), lambda h: F.length(h) >= 0)
    return asked.join(criteria.select("id", F.explode(F.array_distinct(heads)).alias("prefix")), "prefix").select("domain", "id").distinct()
