"""Confidence factors, period deduction, continuation folds and further report-level operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportlake.functions import text as T

#: Weights of the six confidence factors (five stored ones and the id format), and bounds of stored weights.
FACTOR_WEIGHTS = {"model": 0.30, "pattern": 0.20, "fields": 0.20, "mapping": 0.15, "deviation": 0.15, "id_format": 0.10}
WEIGHT_LOW, WEIGHT_HIGH = 0.05, 0.60


def multi_factor(factors: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted mean of the factors, divided by the sum of the weights; 3 decimals."""
    w = weights or FACTOR_WEIGHTS
    total = F.lit(0.0)
    for name, c in factors.items():
        total = total + F.lit(w[name]) * c
    return F.round(total / sum(w[n] for n in factors), 3)


def framework_category(tsc_confidence: Column, tsc_density: Column, other_confidence: Column, n_assertions: Column) -> Column:
    """The side with the larger 0.6 confidence + 0.4 density, AMBIGUOUS below 0.70."""
    a = 0.6 * tsc_confidence + 0.4 * tsc_density
    b = 0.6 * other_confidence + 0.4 * n_assertions / 22.0
    return F.when(F.greatest(a, b) < 0.70, "AMBIGUOUS").when(a >= b, "TSC").otherwise("COSO")


def deduce_period(dates: Column) -> Column:
    """Struct (kind, start, end) from a sorted array of distinct dates: one date: Type 1; two: Type 2 if 6 to 12 months
    apart, an inferred start half a year back if within 30 days, else Type 1; more: earliest start, latest report, and
    the latest date between that lies 6 to 12 months after the start."""
    months = lambda a, b: (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    first, last = F.get(dates, F.lit(0)), F.element_at(dates, -1)
    made = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("start"), b.alias("end"))
    none = F.lit(None).cast("date")
    two = F.when(months(first, last).between(6, 12), made("Type 2", first, last)).when(F.datediff(last, first) <= 30, made("Type 2", F.add_months(first, -6), first)).otherwise(made("Type 1", none, last))
    middle = F.filter(F.slice(dates, F.lit(2), F.greatest(F.size(dates) - 2, F.lit(0))), lambda x: months(first, x).between(6, 12))
    more = F.when(F.size(middle) > 0, made("Type 2", first, F.element_at(F.when(F.size(middle) > 0, middle), -1))).otherwise(made("Type 1", none, last))
    return F.when(F.size(dates) == 1, made("Type 1", none, first)).when(F.size(dates) == 2, two).when(F.size(dates) > 2, more)


def drop_frequent(dates: DataFrame, most: int = 8) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "date"))
    return dates.withColumn("n", n).where(F.col("n") <= most).drop("n")


def weights_with_fallback(orgs: DataFrame, weights: DataFrame, constant: float) -> DataFrame:
    """Own weight, else the global one (organization null), else the constant. One row is global."""
    own = weights.where("organization is not null").select("organization", F.col("weight").alias("own"))
    whole = weights.where("organization is null").agg(F.max("weight").alias("whole"))
    return orgs.join(own, "organization", "left").crossJoin(F.broadcast(whole)).select("organization", F.coalesce("own", "whole", F.lit(constant)).alias("weight"))


def validate_weights(w: DataFrame, columns: list[str]) -> DataFrame:
    bad = F.array_compact(F.array(*[F.when(~F.col(c).between(WEIGHT_LOW, WEIGHT_HIGH), F.lit(c)) for c in columns]))
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    return w.withColumn("errors", F.array_join(F.concat(bad, F.when(F.abs(total - 1) > 0.001, F.array(F.lit("sum"))).otherwise(F.array().cast("array<string>"))), ","))


def pages_near(controls: DataFrame, pages: DataFrame, window: int) -> DataFrame:
    """(id, page_no) with page_no in page_first .. page_first + window, by an equi join on the page itself: the window is
    spread out, so that no range is scanned."""
    spread = controls.select("id", F.col("scan_id").alias("doc_id"), F.explode(F.sequence("page_first", F.col("page_first") + window)).alias("page_no"))
    return spread.withColumn("page_no", F.col("page_no").cast("long")).join(pages.select("doc_id", "page_no"), ["doc_id", "page_no"]).select("id", "page_no")


def apply_dedup_groups(orgs: DataFrame, groups: DataFrame, cap: float = 0.2) -> DataFrame:
    """Variants of a group take its canonical name; all but the canonical one are capped. groups: canonical, variations."""
    v = groups.select("canonical", F.explode("variations").alias("v")).select(F.lower(F.trim("v")).alias("k"), "canonical").dropDuplicates(["k"])
    j = orgs.withColumn("k", F.lower(F.trim("third_party_name"))).join(v, "k", "left")
    capped = F.col("canonical").isNotNull() & (F.col("k") != F.lower("canonical"))
    return j.withColumn("third_party_confidence", F.when(capped, F.least("third_party_confidence", F.lit(cap))).otherwise(F.col("third_party_confidence"))).drop("k")


def apply_adjustments(orgs: DataFrame, adjustments: DataFrame, least: float = 0.8) -> DataFrame:
    """New confidence of confident rows whose adjustment, by raw and else by canonical name, says so."""
    a = adjustments.select(F.col("name").alias("third_party_name"), F.struct("should_reduce", "confidence").alias("by_name"))
    b = adjustments.select(F.col("name").alias("canonical_name"), F.struct("should_reduce", "confidence").alias("by_canonical"))
    j = orgs.join(a, "third_party_name", "left").join(b, "canonical_name", "left").withColumn("adj", F.coalesce("by_name", "by_canonical"))
    hit = (F.col("third_party_confidence") >= least) & F.coalesce(F.col("adj.should_reduce"), F.lit(False))
    return j.withColumn("third_party_confidence", F.when(hit, F.col("adj.confidence")).otherwise(F.col("third_party_confidence"))).drop("adj", "by_name", "by_canonical")


def resolve_type(scans: DataFrame, detections: DataFrame, now: Column) -> DataFrame:
    """Report type by content hash: the user's word before the detected one, unless expired."""
    live = detections.where(F.col("expires_at") > now).select("hash", F.coalesce("user_confirmed", "detected").alias("found"))
    return scans.join(live, "hash", "left")


def report_projection(scans: DataFrame, controls: DataFrame, cuecs: DataFrame, orgs: DataFrame, bad_chunks: DataFrame | None = None, results: DataFrame | None = None) -> DataFrame:
    """One row per report: its header, with company, auditor and product taken from the stored results (scan_id and those
    columns) where the header lacks them, and its children as arrays of structs in stable order; empty arrays without any."""
    out = scans
    if results is not None:
        fields = [c for c in results.columns if c != "scan_id"]
        stored = results.select("scan_id", *[F.col(c).alias(f"_{c}") for c in fields])
        out = out.join(stored, "scan_id", "left")
        for c in fields:
            out = out.withColumn(c, F.coalesce(F.nullif(F.trim(c), F.lit("")), f"_{c}") if c in scans.columns else F.col(f"_{c}")).drop(f"_{c}")
    for df, name in ((controls, "controls"), (cuecs, "cuecs"), (orgs, "orgs"), (bad_chunks, "bad_chunks")):
        if df is None:
            continue
        items = F.struct(*[c for c in df.columns if c != "scan_id"])
        nested = df.groupBy("scan_id").agg(F.array_sort(F.collect_list(items)).alias(name))
        out = out.join(nested, "scan_id", "left").withColumn(name, F.coalesce(name, F.array().cast(nested.schema[name].dataType)))
    return out


def group_control_ids(orgs: DataFrame) -> DataFrame:
    """Sorted distinct references of an organization in a report, joined by commas; instruction leftovers go."""
    refs = F.array_join(F.array_sort(F.filter(F.collect_set("third_party_page_ref"), lambda x: ~F.lower(x).contains("list of"))), ",")
    return orgs.groupBy("scan_id", "org_key").agg(refs.alias("refs"))


def choose_heading(headings: DataFrame, keyword: str) -> DataFrame:
    """Of headings with the keyword: numbered ones first, then the longest, then the lowest line."""
    main = F.col("line").rlike(r"^\s*(section\s+)?([IVX]+|\d+)[.):]")
    w = Window.partitionBy("doc_id").orderBy(F.desc(main), F.desc(F.length("line")), "line_no")
    return headings.where(F.lower("line").contains(keyword.lower())).withColumn("r", F.row_number().over(w)).where("r = 1")
