"""Readers and writers of report texts, results, catalogues, audit logs and baselines."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RESULTS = {"controls": "controls", "cuecs": "cuecs", "subservice_orgs": "third_parties"}


def read_report_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of text files, one report each."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return whole.select("path", F.posexplode(F.split("value", "\n")).alias("p", "line")).select("path", (F.col("p") + 1).cast("long").alias("line_no"), "line")


def read_result_json(spark: SparkSession, pattern: str, inner: str, item_schema: str) -> DataFrame:
    """The items of one entity's result files; files without the key give nothing."""
    read = spark.read.schema(f"{inner} array<struct<{item_schema}>>").option("multiLine", True).json(pattern)
    return read.select(F.explode(inner).alias("x")).select("x.*")


CRITERION = "id string, section string, category string, component string, description string, principle string, name string"


def read_criteria(spark: SparkSession, path: str, literal: DataFrame | None = None, whole_files: bool = True) -> DataFrame:
    """(framework, section, id, description, name): the literal catalogues (framework and fields of CRITERION) of frameworks
    built in, and those under path: one JSON array per file, named by the framework, or (not whole_files) lines of JSON in
    folders framework=NAME. A framework without criteria does not appear."""
    read = spark.read.schema(CRITERION).option("multiLine", whole_files)
    file = F.input_file_name()
    by_file = F.upper(F.regexp_extract(file, r"([^/]+)\.json$", 1))
    name = by_file if whole_files else F.url_decode(F.regexp_extract(file, r"framework=([^/]+)/", 1))
    read = read.option("recursiveFileLookup", not whole_files).json(path).withColumn("framework", name)
    both = read if literal is None else literal.unionByName(read, allowMissingColumns=True)
    text = F.coalesce("description", "principle", "name")
    return both.where("id is not null").select("framework", F.coalesce("section", "component", "category", F.lit("Unspecified")).alias("section"), "id", text.alias("description"), F.coalesce("name", "id").alias("name"))


def read_lookup_list(spark: SparkSession, path: str) -> DataFrame:
    """(short, legal) of a pipe-parted list; comments and blank lines are skipped."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    parts = F.split("value", r"\|")
    return lines.select(F.trim(parts[0]).alias("short"), F.trim(F.coalesce(F.get(parts, F.lit(1)), parts[0])).alias("legal"))


def write_combined_result(controls: DataFrame, cuecs: DataFrame, orgs: DataFrame, path: str) -> None:
    """One nested JSON document per report."""
    combined(controls, cuecs, orgs).write.mode("overwrite").json(path)


def combined(controls: DataFrame, cuecs: DataFrame, orgs: DataFrame) -> DataFrame:
    nest = lambda df, name: df.groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c != "scan_id"]))).alias(name))
    out = nest(controls, "controls")
    return out.join(nest(cuecs, "cuecs"), "scan_id", "full_outer").join(nest(orgs, "subservice_orgs"), "scan_id", "full_outer")


def split_valid(rows: DataFrame, required: list[str], numeric: list[str]) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined with `error`): required fields present and numeric ones castable."""
    bad = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(f"{c} missing")) for c in required], *[F.when(F.col(c).isNotNull() & F.col(c).cast("string").try_cast("double").isNull(), F.lit(f"{c} not a number")) for c in numeric]))
    marked = rows.withColumn("error", F.array_join(bad, "; "))
    return marked.where("error = ''").drop("error"), marked.where("error <> ''")


def write_entity_table(rows: DataFrame, path: str, required: list[str], numeric: list[str]) -> None:
    good, bad = split_valid(rows, required, numeric)
    good.write.mode("append").partitionBy("scan_id").parquet(f"{path}/rows")
    bad.write.mode("append").json(f"{path}/errors")


def export_tables(controls: DataFrame, cuecs: DataFrame, orgs: DataFrame | None = None, summaries: DataFrame | None = None, least: float = 0.7) -> dict[str, DataFrame]:
    """The sheets of a report's workbook: objectives and exceptions of controls, user-entity controls, and where given orgs and
    conclusion (see export_orgs, export_conclusion). Missing confidences count as 0."""
    out = {
        "objectives": controls.where(F.col("control_confidence") >= least).orderBy("scan_id", "control_seq"),
        "exceptions": controls.where("has_deviation").orderBy("scan_id", "control_seq"),
        "cuecs": cuecs.where(F.col("cuec_confidence") >= least).orderBy("scan_id", "cuec_seq"),
    }
    if orgs is not None:
        out["orgs"] = export_orgs(orgs, least)
    if summaries is not None:
        out["conclusion"] = export_conclusion(summaries)
    return out


#: First row of a sheet's data, and the line between confident and other organizations.
FIRST_ROW, LOW_MARK = 9, "--- Low Confidence Orgs ---"
#: Rows of the organization sheets that one task puts in order.
PART_ROWS = 250_000


def export_orgs(orgs: DataFrame, least: float = 0.7) -> DataFrame:
    """(scan_id, row, name, description, confidence) of the organization sheet: confident ones from FIRST_ROW on, then, if there
    are others, an empty row, a line that says so, and those, each by org_key and name. Confidences have two digits, null where
    they are missing or 0."""
    c = F.coalesce("third_party_confidence", F.lit(0.0))
    low = c < least
    own = orgs.select("scan_id", low.alias("low"), "org_key", F.coalesce("third_party_name", F.lit("")).alias("name"), F.coalesce("third_party_description", F.lit("")).alias("description"), F.round(F.nullif(c, F.lit(0.0)), 2).alias("confidence"))
    # a report may hold very many: rows are dealt by ranges of the order, numbered in their part, and moved on by the parts before
    order = ["low", "org_key", "name", "description", "confidence"]
    path = scratch(orgs.sparkSession, "sheet-parts")
    own.repartitionByRange(max(1, -(-own.count() // PART_ROWS)), "scan_id", *order).withColumn("part", F.spark_partition_id()).write.parquet(path)
    dealt = orgs.sparkSession.read.parquet(path)
    sizes = dealt.groupBy("scan_id", "part").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("low")).alias("some"))
    whole = Window.partitionBy("scan_id")
    before = F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col("scan_id").alias("_scan"), F.col("part").alias("_part"), before.alias("before"), F.sum("some").over(whole).alias("high"))
    within = dealt.withColumn("k", F.row_number().over(Window.partitionBy("scan_id", "part").orderBy(*order)))
    placed = within.join(sizes, F.col("scan_id").eqNullSafe(F.col("_scan")) & (F.col("part") == F.col("_part"))).withColumn("no", F.col("before") + F.col("k"))
    gap = F.when(F.col("low"), 2).otherwise(0)
    rows = placed.select("scan_id", (F.lit(FIRST_ROW - 1) + F.col("no") + gap).cast("long").alias("row"), "name", "description", "confidence")
    marks = placed.where("low").groupBy("scan_id").agg(F.min(F.lit(FIRST_ROW + 1) + F.col("high")).cast("long").alias("row"))
    return rows.unionByName(marks.select("scan_id", "row", F.lit(LOW_MARK).alias("name"), F.lit("").alias("description"), F.lit(None).cast("double").alias("confidence")))


def export_conclusion(summaries: DataFrame) -> DataFrame:
    """(scan_id, conclusion) from (scan_id, executive_summary), a text or a JSON object with `summary`; empty for null."""
    s = F.col("executive_summary")
    inner = F.when(F.trim(s).startswith("{") & F.try_parse_json(s).isNotNull(), F.get_json_object(s, "$.summary"))
    return summaries.select("scan_id", F.coalesce(inner, s, F.lit("")).alias("conclusion"))


#: Times in JSON with all of their six digits, which Spark cuts to three unless told otherwise.
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS[XXX]", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def append_audit_log(events: DataFrame, path: str) -> None:
    """Adds events (with ts) to the log, a folder a day."""
    events.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").options(**TIMES).json(path)


def read_audit_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The log with its day; schema of the fields, without day."""
    return spark.read.schema(f"{schema}, day date").options(**TIMES).json(path)


def deep_merge(existing: DataFrame, update: DataFrame, key: str, maps: list[str]) -> DataFrame:
    """Key-wise merge: the update wins, maps are merged entry by entry, other values stay."""
    cols = [c for c in existing.columns if c != key]
    u = update.select(key, *[F.col(c).alias(f"u_{c}") for c in cols])
    j = existing.join(u, key, "full_outer")
    both = lambda c: F.when(F.col(c).isNotNull() & F.col(f"u_{c}").isNotNull(), F.map_zip_with(c, f"u_{c}", lambda k, a, b: F.coalesce(b, a))).otherwise(F.coalesce(f"u_{c}", c))
    return j.select(key, *[(both(c) if c in maps else F.coalesce(f"u_{c}", c)).alias(c) for c in cols])


def write_baseline(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("append").partitionBy("report_name", "extractor_version").parquet(path)


def list_baselines(spark: SparkSession, path: str, report: str | None = None) -> DataFrame:
    """All baselines, newest first; of one report if it is named."""
    rows = spark.read.parquet(path)
    return (rows if report is None else rows.where(F.col("report_name") == report)).orderBy(F.desc("created_at"))


def read_baseline(spark: SparkSession, path: str, report: str, version: str | None = None) -> DataFrame:
    """The newest baseline of a report (of one extractor version); its partition is all that is read."""
    rows = spark.read.parquet(path).where(F.col("report_name") == report)
    if version is not None:
        rows = rows.where(F.col("extractor_version") == version)
    last = rows.agg(F.max("created_at").alias("_last"))
    return rows.join(F.broadcast(last), F.col("created_at") == F.col("_last")).drop("_last")  # one row


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table: below spark.checkpoint.dir, or in local mode below a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-reports-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


USAGE = "model string, extractor string, prompt_tokens long, completion_tokens long, cost double, seconds double, ts timestamp"


def append_usage_log(calls: DataFrame, path: str) -> None:
    """Adds model calls to the log; fields that the log does not have are left out."""
    fields = [f.split()[0] for f in USAGE.split(", ")]
    calls.select(*fields).withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").options(**TIMES).json(path)


def read_usage_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(USAGE).options(**TIMES).json(path)
