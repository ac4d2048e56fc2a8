"""Tables of contents: where they stand, their entries, and headings as comparable keys."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Page markers, entries with page numbers, numerals, labels of a table of contents.
PAGE_MARKER = r"^=== PAGE\s+(\d+)\b"
TOC_ENTRY = r"(?i)(.*?)(\d{1,4})\s*(?=(?:SECTION|[IVXLC0-9]+\.|\d+\.|[A-Z]\.|$))"
NUMERAL = "[ivxlcdm0-9]+"
TOC_LABEL = r"(?i)^((the\s*)?table\s*of\s*contents|table\s*of\s*content|table\s+of|table|of|of\s*contents|contents|toc)$"
ENTRY_START = rf"(\.{{2,}}|\s)\d{{1,4}}$|^\p{{Lu}}.*\d$|(?i)^(section\s*{NUMERAL}|{NUMERAL}\.|\d|[a-z]\.)"
MAIN_HEADING = rf"(?i)^(section\s*{NUMERAL}|{NUMERAL}\s*[-–—])"
LONG_HEADING = 40


def page_marks(lines: DataFrame) -> DataFrame:
    """lines (doc_id, line_no, line) with mark (page number of a marker line) and page, that of the last marker before
    the line, 1 before any."""
    mark = F.regexp_extract("line", PAGE_MARKER, 1).try_cast("long")
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("mark", mark).withColumn("page", F.coalesce(F.last("mark", ignorenulls=True).over(before), F.lit(1).cast("long")))


def toc_page(lines: DataFrame, max_pages: int = 5) -> DataFrame:
    """(doc_id, line_no, page, method): where the table of contents begins; page 1 and 'not-found' without one.

    Looked for before the marker of the fifth page (or of the last one): a line that names it, a lone 'contents', or
    'table', 'of' and 'contents' on lines with nothing but blank ones between.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no")
    marked = page_marks(lines).withColumn("nth", F.count("mark").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("doc_id")
    last = F.least(F.max("nth").over(whole), F.lit(max_pages))
    limit = F.min(F.when(F.col("mark").isNotNull() & (F.col("nth") == F.col("last")), F.col("line_no"))).over(whole)
    near = marked.withColumn("last", last).withColumn("limit", limit).where("limit is null or line_no < limit")
    text = near.withColumn("low", F.lower(F.trim("line"))).where("low <> ''")
    text = text.withColumn("second", F.lead("low", 1).over(order)).withColumn("third", F.lead("low", 2).over(order))
    parted = (F.col("low") == "table") & (F.col("second") == "of") & (F.col("third") == "contents")
    method = F.when(F.contains("low", F.lit("table of contents")), "single-line").when(F.col("low") == "contents", "contents-alone").when(parted, "multi-line")
    hits = text.withColumn("method", method).where("method is not null").groupBy("doc_id").agg(F.min(F.struct("line_no", "page", "method")).alias("at"))
    return lines.select("doc_id").distinct().join(hits, "doc_id", "left").select("doc_id", F.col("at.line_no").alias("line_no"), F.coalesce("at.page", F.lit(1).cast("long")).alias("page"), F.coalesce("at.method", F.lit("not-found")).alias("method"))


def toc_entries(line: Column) -> Column:
    """Array of (heading, page) of all entries on a line; the line itself with page null if it has no number."""
    s = F.trim(line)
    pairs = F.zip_with(F.regexp_extract_all(s, F.lit(TOC_ENTRY), F.lit(1)), F.regexp_extract_all(s, F.lit(TOC_ENTRY), F.lit(2)), lambda h, p: F.struct(F.btrim(h, F.lit(" .")).alias("heading"), p.cast("int").alias("page")))
    alone = F.array(F.struct(s.alias("heading"), F.lit(None).cast("int").alias("page")))
    return F.when(s == "", F.array().cast("array<struct<heading:string,page:int>>")).when(F.size(pairs) == 0, alone).otherwise(F.filter(pairs, lambda x: x["heading"] != ""))


def parse_toc_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, pos, heading, page) of the entries of table-of-contents lines."""
    each = lines.select("doc_id", "line_no", F.posexplode(toc_entries(F.col("line"))).alias("pos", "e"))
    return each.select("doc_id", "line_no", F.col("pos").cast("long").alias("pos"), "e.heading", "e.page")


def is_main_heading(line: Column) -> Column:
    """A section label, a numeral with a dash, or a long line in capitals."""
    return line.rlike(MAIN_HEADING) | ((F.length(line) >= LONG_HEADING) & (line == F.upper(line)))


def join_toc_entries(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, entry): table-of-contents lines, a main heading with all that follow it until a blank line, a
    label or the start of another entry; other lines alone. Blank lines and labels go. One pass over a document's lines."""
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.select("doc_id", "line_no", F.trim("line").alias("s"))
    rows = rows.withColumn("dead", (F.col("s") == "") | F.col("s").rlike(TOC_LABEL))
    rows = rows.withColumn("stretch", F.sum((F.col("dead") | F.col("s").rlike(ENTRY_START)).cast("long")).over(order))
    stretch = Window.partitionBy("doc_id", "stretch").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("head", F.min(F.when(~F.col("dead") & is_main_heading(F.col("s")), F.col("line_no"))).over(stretch))
    entry = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "s"))), lambda x: x["s"]), " ")
    grouped = rows.where("not dead").groupBy("doc_id", "stretch", F.coalesce("head", "line_no").alias("first")).agg(entry.alias("entry"))
    return grouped.select("doc_id", F.col("first").alias("line_no"), "entry")


def nfkc(lines: DataFrame, column: str) -> DataFrame:
    """lines with `column` in compatibility form. Only rows beyond ASCII pass through Python, in Arrow batches."""
    plain = F.col(column).rlike(r"^\p{ASCII}*$")

    @F.pandas_udf("string")
    def compatible(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")

    return lines.withColumn(column, F.coalesce(compatible(F.when(~plain, F.col(column))), F.col(column)))


def without_label(s: Column) -> Column:
    """Heading without section label, leading numerals and one-letter label."""
    for pattern in (rf"(?i)^section\s*{NUMERAL}\s*[\-–—:]?\s*", r"(?i)^[ivxlcdm]+\.?\s*", r"^[0-9]+\.?\s*", r"^[a-zA-Z]\.\s*"):
        s = F.regexp_replace(s, pattern, "")
    return s


def bare(s: Column) -> Column:
    return F.regexp_replace(s, r"[^\p{L}\p{N}_]", "")


def core_heading(s: Column) -> Column:
    """Heading in compatibility form without section label, leading numerals, one-letter label, blanks and punctuation."""
    return F.lower(bare(without_label(s)))
