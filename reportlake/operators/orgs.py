"""Subservice organizations: names, scores, summaries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportlake.functions import text as T
from reportlake.functions.similarity import any_alike

from . import linking
from .spellings import found_spellings

#: Texts, or companies, of a report that are compared in one go.
PACK = 8192

#: Words that tell infrastructure providers and tools.
INFRASTRUCTURE = ["infrastructure", "cloud hosting", "colocation", "data center", "iaas", "paas"]
TOOLS = ["monitoring", "logging", "ticketing", "alert", "hr", "business application", "it service management", "endpoint detection", "vulnerability assessment"]


def with_canonical(orgs: DataFrame) -> DataFrame:
    return orgs.withColumn("canonical_name", T.canonical_key(F.col("third_party_name")))


def canonicalize_orgs(orgs: DataFrame, aliases: DataFrame) -> DataFrame:
    """Alias of the cleaned name, else of the abbreviation in parentheses, else the cleaned name."""
    keyed = orgs.withColumn("k1", T.canonical_key(F.col("third_party_name"))).withColumn("k2", F.lower(F.trim(F.regexp_extract("third_party_name", r"\(([^)]+)\)", 1))))
    one = aliases.select(F.col("alias").alias("k1"), F.col("canonical").alias("c1"))
    two = aliases.select(F.col("alias").alias("k2"), F.col("canonical").alias("c2"))
    return keyed.join(one, "k1", "left").join(two, "k2", "left").withColumn("canonical_name", F.coalesce("c1", "c2", "k1")).drop("k1", "k2", "c1", "c2")


def dedup_orgs_by_name(orgs: DataFrame) -> DataFrame:
    refs = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("org_key", "third_party_page_ref", "third_party_description"))), lambda x: x["third_party_page_ref"]), ",")
    return orgs.groupBy("scan_id", F.lower("third_party_name").alias("name_key")).agg(F.min("org_key").alias("org_key"), refs.alias("page_refs"))


def canonical_summaries(orgs: DataFrame) -> DataFrame:
    """Pages, spellings and best confidence per canonical name. Rows are reduced to distinct (name, page) pairs once; the
    canonical key is worked out after that, and spellings and pages of a name are counted without further exchanges."""
    pairs = orgs.groupBy("scan_id", "third_party_name", "third_party_page_ref").agg(F.max(F.col("third_party_confidence") + 0.0).alias("best"))
    names = with_canonical(pairs).groupBy("scan_id", "canonical_name").agg(F.collect_set("third_party_page_ref").alias("pages"), F.collect_set("third_party_name").alias("aliases"), F.max("best").alias("best"))
    return names.select("scan_id", "canonical_name", F.size("pages").cast("long").alias("pages"), F.size("aliases").cast("long").alias("aliases"), F.round("best", 3).alias("max_confidence"))


#: Wordings of which any in a name or description tells that no company is meant. Names of standards bodies and
#: wordings of several words are found by these words alone (`os`, `org`, `team`, `review` with any of them, and so on).
GENERIC_WORDS = [
    "framework", "operating system", "standard", "library", "project", "distribution", "kernel", "open source",
    "node", "container", "image", "instance", "os", "component", "platform", "software", "tool", "plugin", "module",
    "trusted certificate authority", "certificate authority", "independent auditor", "independent service auditor",
    "third-party specialist", "third party specialist", "specialist", "consultant", "contractor", "team", "group",
    "staff", "employee", "personnel", "resource", "service", "support", "department", "division", "unit", "office",
    "committee", "board", "agency", "organization", "org", "entity", "provider", "vendor", "supplier", "partner",
    "outsourcer", "outsourcing", "affiliate", "subsidiary", "internal", "external", "party", "parties", "individual",
    "role", "function", "subject", "category", "type", "system", "infrastructure", "environment", "solution",
    "process", "procedure", "practice", "policy", "program", "initiative", "activity", "operation", "operations",
    "network", "site", "location", "facility", "facilities", "asset", "assets", "application", "applications",
    "platforms", "technologies", "technology", "hardware", "cloud", "cloud service", "cloud provider", "cloud platform",
    "managed service", "managed services", "hosting", "host", "maintenance", "support team", "support staff",
    "task force", "working group", "advisory group", "review group", "review team", "review board",
]
ALIKE = 0.85


def own_named(texts: DataFrame, companies: DataFrame, alike: float | None = None) -> DataFrame:
    """(scan_id, text), each once, of texts (scan_id, text) that hold a company of their report (companies: scan_id, company) or
    are more than `alike` similar to one; None leaves the similarity out. Case counts for holding only.

    Companies are looked for by one automaton of all of them, so a text is read once however many there are. Only texts that
    hold none and are about as long as a company of their report are compared, in packs of a report's texts and companies, each
    up to the first company that is alike.
    """
    told = linking.written(texts.where("scan_id is not null and text <> ''").select("scan_id", "text").distinct(), "told")
    own = linking.written(companies.where("scan_id is not null and company <> ''").select("scan_id", "company").distinct(), "companies")
    found = found_spellings(told.select(F.col("text").alias("doc_id"), "text").distinct(), own.select(F.col("company").alias("spelling"), F.lit(False).alias("whole")))
    held = found.select(F.col("doc_id").alias("text"), F.col("spelling").alias("company")).join(told, "text").join(own, ["scan_id", "company"], "left_semi").select("scan_id", "text").distinct()
    held = linking.written(held, "held")
    if alike is None:
        return held

    def packed(df: DataFrame, column: str, name: str) -> DataFrame:
        packs = df.groupBy("scan_id").agg(F.ceil(F.count(F.lit(1)) / PACK).alias("packs"))
        return df.join(packs, "scan_id").groupBy("scan_id", F.pmod(F.xxhash64(column), "packs").alias(f"{name}_no")).agg(F.collect_list(column).alias(name))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for scan, ls, rs in zip(b["scan_id"], b["ls"], b["rs"], strict=True):
                hits = [(scan, x) for x, hit in zip(ls, any_alike(list(ls), list(rs), alike), strict=True) if hit]
                if hits:
                    yield pd.DataFrame(hits, columns=["scan_id", "text"])

    kind = told.schema["scan_id"].dataType.simpleString()

    def sized(df: DataFrame, column: str) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b.assign(size=[len(x.strip().lower()) for x in b[column]])

        return df.select("scan_id", column).mapInPandas(run, f"scan_id {kind}, {column} string, size int")

    spans = sized(own, "company").where("size > 0").groupBy("scan_id").agg(F.min("size").alias("shortest"), F.max("size").alias("longest"))
    size, shortest, longest = F.col("size"), F.col("shortest"), F.col("longest")
    like = lambda a, b: 2 * F.least(a, b) >= F.lit(alike - 1e-9) * (a + b)
    rest = sized(told.join(held, ["scan_id", "text"], "left_anti"), "text").where("size > 0").join(spans, "scan_id")
    rest = rest.where(((size > shortest) | like(size, shortest)) & ((size < longest) | like(size, longest))).select("scan_id", "text")
    met = packed(linking.written(rest, "compared"), "text", "ls").join(packed(own, "company", "rs"), "scan_id")
    met = linking.apart(met, "scan_id", "ls_no", "rs_no").select("scan_id", "ls", "rs")
    near = met.mapInPandas(run, f"scan_id {kind}, text string")
    return held.unionByName(linking.written(near.distinct(), "near"))


def with_own(rows: DataFrame, named: DataFrame, mark: str) -> DataFrame:
    """rows (with scan_id, _name, _desc) with a boolean `mark`: whether named (scan_id, text) has the name or the description."""
    by = lambda c, m: named.select("scan_id", F.col("text").alias(c), F.lit(True).alias(m))
    met = rows.join(by("_name", "_n"), ["scan_id", "_name"], "left").join(by("_desc", "_d"), ["scan_id", "_desc"], "left")
    return met.withColumn(mark, F.coalesce("_n", "_d", F.lit(False))).drop("_n", "_d")


def names_and_descriptions(rows: DataFrame) -> DataFrame:
    return rows.select("scan_id", F.col("_name").alias("text")).unionByName(rows.select("scan_id", F.col("_desc").alias("text")))


def heuristic_excluded(orgs: DataFrame, companies: DataFrame, words: list[str] = GENERIC_WORDS, alike: float = ALIKE) -> DataFrame:
    """orgs with `excluded`: a generic word in name or description, or one of the report's own names (companies: scan_id,
    company) contained in one of them or more than `alike` similar to it. Excluded rows stay, with confidence 0.

    Each distinct name and each distinct description of a report is looked at once.
    """
    name, desc = (F.lower(F.coalesce(c, F.lit(""))) for c in ("third_party_name", "third_party_description"))
    own = companies.select("scan_id", F.lower("company").alias("company"))
    rows = orgs.withColumn("_name", name).withColumn("_desc", desc)
    rows = rows.withColumn("_generic", T.any_of(F.col("_name"), words) | T.any_of(F.col("_desc"), words))
    marked = with_own(rows, own_named(names_and_descriptions(rows.where("not _generic")), own, alike), "_self")
    marked = marked.withColumn("excluded", F.col("_generic") | F.col("_self")).drop("_name", "_desc", "_generic", "_self")
    return marked.withColumn("third_party_confidence", F.when(F.col("excluded"), 0.0).otherwise(F.col("third_party_confidence")))


def mark_common(orgs: DataFrame, common: DataFrame) -> DataFrame:
    """orgs with canonical_name and common_so: Yes where the name or the canonical name is in common (name), else No. A Yes also
    makes likely_so Yes, which is kept as it is otherwise, or null where orgs has none. Case and outer blanks do not count."""
    listed = common.select(F.lower(F.trim("name")).alias("_listed")).where("_listed <> ''").distinct().withColumn("_yes", F.lit(True))
    own = with_canonical(orgs)
    own = own if "likely_so" in own.columns else own.withColumn("likely_so", F.lit(None).cast("string"))
    by = lambda c, n: listed.select(F.col("_listed").alias(c), F.col("_yes").alias(n))
    own = own.withColumn("_k1", F.lower(F.trim("third_party_name"))).withColumn("_k2", F.lower(F.trim("canonical_name")))
    hit = own.join(by("_k1", "_y1"), "_k1", "left").join(by("_k2", "_y2"), "_k2", "left").withColumn("_hit", F.coalesce("_y1", "_y2", F.lit(False)))
    marked = hit.withColumn("common_so", F.when(F.col("_hit"), "Yes").otherwise("No")).withColumn("likely_so", F.when(F.col("_hit"), "Yes").otherwise(F.col("likely_so")))
    return marked.drop("_k1", "_k2", "_y1", "_y2", "_hit")


def mark_self_orgs(orgs: DataFrame, companies: DataFrame, alike: float | None = ALIKE) -> DataFrame:
    """orgs with likely_so No where a company of the report (companies: scan_id, company; without legal form, dots and commas)
    is part of the name or description, or more than `alike` similar to one of them; else as it was, null where there was none.
    Each distinct name and description of a report is compared once; `alike` None leaves the similarity out."""
    bare = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[.,]", "")
    own = orgs if "likely_so" in orgs.columns else orgs.withColumn("likely_so", F.lit(None).cast("string"))
    own = own.withColumn("_name", bare(F.col("third_party_name"))).withColumn("_desc", bare(F.col("third_party_description")))
    named = companies.select("scan_id", F.trim(F.regexp_replace(bare(F.col("company")), rf"\b({T.LEGAL_FORMS})\b", "")).alias("company"))
    marked = with_own(own, own_named(names_and_descriptions(own), named, alike), "_hit")
    return marked.withColumn("likely_so", F.when(F.col("_hit"), "No").otherwise(F.col("likely_so"))).drop("_name", "_desc", "_hit")


def drop_self_references(orgs: DataFrame, companies: DataFrame) -> DataFrame:
    """orgs without those whose name holds a company of their report (companies: scan_id, company), in any case."""
    rows = orgs.withColumn("_low", F.lower("third_party_name"))
    held = own_named(rows.select("scan_id", F.col("_low").alias("text")), companies.select("scan_id", F.lower("company").alias("company")))
    return rows.join(held.withColumnRenamed("text", "_low"), ["scan_id", "_low"], "left_anti").select(orgs.columns)


def apply_keep_verdict(orgs: DataFrame, verdicts: DataFrame) -> DataFrame:
    j = orgs.join(verdicts, "org_key", "left")
    return j.withColumn("third_party_confidence", F.when(F.col("keep") == F.lit(False), 0.0).otherwise(F.col("third_party_confidence")))


def nearest_two(orgs: DataFrame, distance: Column) -> DataFrame:
    w = Window.partitionBy("scan_id").orderBy("distance", "org_key", "third_party_name", "third_party_description", "third_party_page_ref", "third_party_confidence")
    return orgs.withColumn("distance", distance).withColumn("rn", F.row_number().over(w)).where("rn <= 2")


def org_confidence(orgs: DataFrame) -> DataFrame:
    """Score from is_company, common, likely_so, provider and near columns; clamped to 0..1."""
    desc = F.lower(F.coalesce("third_party_description", F.lit("")))
    infra = T.any_of(desc, INFRASTRUCTURE) | F.col("common")
    score = F.lit(0.0)
    for test, w in ((F.col("is_company"), -0.8), (~F.col("is_company") & F.col("common"), 0.5), (F.col("likely_so") == "Yes", 0.2), (F.col("likely_so") == "No", -0.1), (F.col("near"), 0.1), (~infra & T.any_of(desc, TOOLS), -0.2)):
        score = score + F.when(test, w).otherwise(0.0)
    score = score + F.when(F.col("provider") > 0.5, F.round(0.4 * F.col("provider"), 3)).otherwise(0.0)
    return orgs.withColumn("score", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 6))


def final_adjust(confidence: Column, likely: Column, common: Column, distance: Column) -> Column:
    step = F.when(likely == "No", -0.2).when(likely == "Yes", 0.1).otherwise(0.0) + F.when(common == "Yes", 0.1).otherwise(0.0) + F.when(distance <= 2, 0.1).when(distance >= 10, -0.1).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence + step)), 3)


def verify_verdict(confidence: Column, verdict: Column) -> Column:
    moved = F.when(verdict == "confirmed", F.least(F.lit(1.0), confidence + 0.2)).when(verdict == "rejected", F.greatest(F.lit(0.0), confidence - 0.2)).otherwise(confidence)
    return F.round(F.when(confidence >= 0.9, moved).otherwise(confidence), 3)


def cuec_confidence(cuecs: DataFrame) -> DataFrame:
    """Base 0.3 with bonuses and penalties; capped at 1, no floor. Needs distance and is_company."""
    desc = F.trim("cuec_description")
    low = F.lower(desc)
    fragment = (F.length(desc) < 30) | (~F.endswith(desc, F.lit(".")) & ~F.endswith(desc, F.lit(";")) & (F.length(desc) < 80))
    #: Wording of system descriptions.
    system = T.any_of(low, ["core capabilities", "extends the power", "configuration management", "utilized to provision", "data is captured", "maintained historically", "internal audit function", "identity as a service"])
    opinion = F.when(F.col("cuec_gpt_opinion") == "yes", 0.1).when(F.col("cuec_gpt_opinion") == "no", -0.3).when(F.col("cuec_gpt_opinion") == "maybe", -0.2).otherwise(0.0)
    score = 0.3 + opinion
    for test, w in ((F.col("distance") < 2, 0.2), (T.responsibility(low), 0.15), (T.any_of(low, T.OBLIGATIONS), 0.1), (F.col("is_company"), -0.4), (fragment, -0.3), (system, -0.3)):
        score = score + F.when(test, w).otherwise(0.0)
    return cuecs.withColumn("score", F.round(F.least(score, F.lit(1.0)), 3))
