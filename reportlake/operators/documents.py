"""Operators over report text: lines, pages, sections, chunks, dates, headings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportlake.functions import text as T

#: How watermarks and repeated page strings look.
WATERMARK = r"(?i)digitally signed by"
MONTH_WORD = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
PAGE_STRINGS = {
    "date": rf"\b(?:\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}|{MONTH_WORD}\s+\d{{1,2}},\s+\d{{4}})\b",
    "email": r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+",
    "time": r"\b\d{1,2}:\d{2}(?::\d{2})?\s?(?:AM|PM|am|pm)?\b",
}


def page_of_line(lines: DataFrame, marker: Column) -> DataFrame:
    """Page of the last marker at or before each line, 1 before any. marker: page number on marker lines, else null."""
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("page", F.coalesce(F.last(marker, ignorenulls=True).over(w), F.lit(1).cast("long")))


def lines_in_section(lines: DataFrame, sections: DataFrame) -> DataFrame:
    """An equi join by document with the interval as residual, so that the plan is never a nested loop."""
    s = sections.select(F.col("doc_id").alias("sd"), "topic", "start_line", "end_line")
    return lines.join(s, (F.col("doc_id") == F.col("sd")) & F.col("line_no").between(F.col("start_line"), F.col("end_line")))


def section_ends(sections: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("start_line", "topic")
    return sections.withColumn("end_line", F.greatest("start_line", F.coalesce(F.lead("start_line").over(w) - 1, F.col("last_line"))))


def line_chunks(lines: DataFrame, size: int, overlap: int) -> DataFrame:
    """(doc_id, chunk_id, start_line, text): overlapping windows of lines, each line joined to the windows it falls in."""
    step = size - overlap
    # window k covers lines k*step+1 .. k*step+size
    last = F.floor((F.col("line_no") - 1) / step)
    first = F.greatest(F.lit(0), F.ceil((F.col("line_no") - size) / step))
    spread = lines.select("doc_id", "line_no", "line", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("chunk_id"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return spread.groupBy("doc_id", "chunk_id").agg(F.min("line_no").alias("start_line"), text.alias("text"))


def guarded_chunks(docs: DataFrame, start_line: int = 1, size: int = 140, overlap: int = 40, guard: int = 8) -> DataFrame:
    """(doc_id, start_line, text) of each text (doc_id, text): windows of `size` lines that overlap, each with `guard` more at its
    end so that a conclusion is not cut off; up to the first blank window. Lines are sliced where they are, nothing is
    shuffled. A null text has no windows, and a start below 1 counts as 1."""
    step, first = max(1, size - max(0, overlap)), max(1, start_line)
    ls = F.split(F.coalesce("text", F.lit("")), "\n")
    starts = F.when(F.size("ls") >= first, F.sequence(F.lit(first), F.size("ls"), F.lit(step))).otherwise(F.array().cast("array<int>"))
    window = lambda i: F.struct(i.cast("long").alias("start_line"), F.array_join(F.slice("ls", i, size + max(0, guard)), "\n").alias("text"))
    rows = docs.select("doc_id", ls.alias("ls")).select("doc_id", F.transform(starts, window).alias("ws"))
    blank = F.array_position(F.transform("ws", lambda w: ~w["text"].rlike(r"\S")), True)
    kept = F.when(blank > 0, F.slice("ws", F.lit(1), (blank - 1).cast("int"))).otherwise(F.col("ws"))
    return rows.select("doc_id", F.explode(kept).alias("w")).select("doc_id", "w.start_line", "w.text")


def char_chunks(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """(doc_id, chunk_id, start, start_line, text): overlapping windows of characters, overlap at most half of size.

    A text is cut into blocks of one step once; a chunk is a block and the head of the next one, so that rows carry their
    own piece only, and line numbers come from newline counts added up over the blocks.
    """
    step = size - overlap
    blocks = F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{step}}}"), F.lit(0)))
    newlines = lambda b: F.length(b) - F.length(F.replace(b, F.lit("\n"), F.lit("")))
    before = F.aggregate("blocks", F.array(F.lit(1)), lambda acc, b: F.array_append(acc, F.element_at(acc, -1) + newlines(b)))
    rows = docs.select("doc_id", blocks.alias("blocks")).select("doc_id", "blocks", before.alias("lines"))
    piece = lambda b, i: F.struct(F.get("lines", i).cast("long").alias("start_line"), F.concat(b, F.substring(F.coalesce(F.get("blocks", i + 1), F.lit("")), 1, overlap)).alias("text"))
    rows = rows.select("doc_id", F.posexplode(F.transform("blocks", piece)).alias("k", "c"))
    return rows.select("doc_id", F.col("k").cast("long").alias("chunk_id"), (F.col("k") * step).cast("long").alias("start"), "c.start_line", "c.text")


def drop_watermark_lines(lines: DataFrame, frequent: DataFrame | None = None) -> DataFrame:
    """Lines without a watermark, and without those that consist of a string of frequent_page_strings (doc_id, s) and
    perhaps a full stop."""
    left = lines.where(~F.col("line").rlike(WATERMARK))
    if frequent is None:
        return left
    bare = F.regexp_replace(F.trim("line"), r"\.+$", "")
    forms = frequent.select("doc_id", F.explode(F.array("s", F.regexp_replace("s", ",+$", ""))).alias("_bare")).distinct()
    return left.withColumn("_bare", bare).join(forms, ["doc_id", "_bare"], "left_anti").drop("_bare")


def frequent_page_strings(pages: DataFrame, share: float = 0.8) -> DataFrame:
    found = F.concat(*[F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in PAGE_STRINGS.values()])
    found = pages.select("doc_id", "page_no", F.explode(F.array_distinct(F.transform(found, lambda x: F.trim(x)))).alias("s"))
    seen = found.groupBy("doc_id", "s").agg(F.countDistinct("page_no").alias("n"))
    total = pages.groupBy("doc_id").agg(F.countDistinct("page_no").alias("pages"))
    return seen.join(total, "doc_id").where(F.col("n") > share * F.col("pages")).select("doc_id", "s")


#: Wording of legal agreement pages, phrases of which one is enough and pairs of which two are.
AGREEMENT_STRONG = ["i agree", "i do not agree", "limits on report access and distribution", "solely for the benefit and use of", "not intended to be used by anyone other than"]
AGREEMENT_PAIRS = [("notice", "confidential"), ("recipient agrees", "report"), ("ownership", "property of"), ("dissemination", "prohibited"), ("as is", "sole risk")]


def is_agreement_page(text: Column) -> Column:
    low = F.lower(text)
    pairs = [(F.contains(low, F.lit(a)) & F.contains(low, F.lit(b))).cast("int") for a, b in AGREEMENT_PAIRS]
    return T.any_of(text, AGREEMENT_STRONG) | (sum(pairs[1:], pairs[0]) >= 2)


def skip_leading_agreements(pages: DataFrame, flag: Column) -> DataFrame:
    """Pages without the leading run of flagged ones among the first five; if all five are flagged all stay."""
    head = pages.withColumn("flag", flag & (F.col("page_no") <= 5))
    w = Window.partitionBy("doc_id").orderBy("page_no")
    leading = F.min(F.col("flag").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1
    n = F.sum(F.col("flag").cast("int")).over(Window.partitionBy("doc_id"))
    return head.withColumn("skip", leading & (n < 5)).where(~F.col("skip")).drop("flag", "skip")


def group_same_response(rows: DataFrame) -> DataFrame:
    ids = F.array_join(F.array_sort(F.collect_set("line_no")), ",")
    return rows.groupBy("doc_id", F.md5("line").alias("hash")).agg(ids.alias("ids"))


def tail_lines(lines: DataFrame, n: int = 500) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy(F.desc("line_no"))
    return lines.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r")


def find_occurrences(docs: DataFrame, term: str, around: int = 2000) -> DataFrame:
    """All case-insensitive, overlapping hits with their surroundings; more than three in a document raise `many`.

    A text is split once before every hit; the lengths of the parts, added up, are the positions.
    """
    low, t = F.lower("text"), term.lower()
    parts = docs.where(F.contains(low, F.lit(t))).select("doc_id", "text", F.split(low, f"(?={re.escape(t)})", -1).alias("parts"), F.startswith(low, F.lit(t)).alias("at_start"))
    starts = F.aggregate("parts", F.array(F.lit(1)), lambda acc, p: F.array_append(acc, F.element_at(acc, -1) + F.length(p)))
    # every part but perhaps the first begins with a hit
    hits = F.filter(F.slice(starts, F.lit(1), F.size("parts")), lambda s: (s > 1) | F.col("at_start"))
    rows = parts.select("doc_id", "text", hits.alias("at"))
    rows = rows.select("doc_id", "text", (F.size("at") > 3).alias("many"), F.explode("at").alias("pos"))
    start = F.greatest(F.col("pos") - around, F.lit(1))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "many", F.substring(F.col("text"), start, F.col("pos") - start + len(t) + around).alias("context"))


def union_page_spans(lines: DataFrame, sections: DataFrame, first_lines: int) -> DataFrame:
    head = lines.where(F.col("line_no") <= first_lines).select("doc_id", "line_no")
    return head.union(lines_in_section(lines, sections).select("doc_id", "line_no")).distinct()


#: Audit firms in the order in which they are looked for; the short ones count as whole words only.
KNOWN_FIRMS = [
    "BDO USA, P.C.", "BDO USA", "KPMG LLP", "Deloitte & Touche LLP", "PricewaterhouseCoopers", "Ernst & Young LLP", "Grant Thornton LLP", "RSM US LLP", "Crowe LLP", "Moss Adams LLP", "CliftonLarsonAllen LLP",
    "Schellman & Company, LLC", "KPMG", "Deloitte", "PwC", "BDO", "Grant Thornton", "RSM", "Crowe", "Moss Adams", "CliftonLarsonAllen", "Schellman",
]
SHORT_FIRMS = ["EY", "PwC", "RSM", "BDO"]


def known_firm(text: Column) -> Column:
    """The first of the known firms that a text names, null if none."""
    out = None
    for name in KNOWN_FIRMS:
        test = text.rlike(rf"(?i)\b{re.escape(name)}\b") if name in SHORT_FIRMS else F.contains(F.lower(text), F.lit(name.lower()))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def split_combined(segments: DataFrame) -> DataFrame:
    """Ordered (type, text) segments as records; each id segment starts one. segments: doc_id, pos, kind, body."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    numbered = segments.withColumn("record", F.sum((F.col("kind") == "id").cast("long")).over(w))
    rest = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") != "id", F.struct("pos", "body")))), lambda x: x["body"]), "\n")
    return numbered.groupBy("doc_id", "record").agg(F.max(F.when(F.col("kind") == "id", F.col("body"))).alias("id_text"), rest.alias("body"))
