"""Dates in text, period phrases, response sections, repeated header and footer lines, boundary-seeking chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportlake.functions import text as T

from .matching import pattern_similarity

#: How dates with month names look, and the headings that open a response section.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
MONTH_DATE = r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4}\b"
ANY_DATE = r"[A-Za-z]+\s+\d{1,2},?\s+\d{4}"
RESPONSE_HEADINGS = [r"management[\s']?s?\s+response", r"corrective\s+action", r"remediation\s+plan", r"management\s+action\s+plan"]


def to_day(s: Column, exact: bool = True) -> Column:
    """Date of 'Month d, yyyy'. exact: the month is a full name, its first three letters or Sept; else its first three
    letters decide."""
    word = F.lower(F.regexp_extract(s, r"^([A-Za-z]+)", 1))
    names = {m[:3].lower(): m.lower() for m in MONTHS}
    month = F.lit(None).cast("int")
    for k, (short, full) in enumerate(names.items()):
        accepted = [short, full] + (["sept"] if short == "sep" else [])
        month = F.when(word.isin(*accepted) if exact else F.startswith(word, F.lit(short)), k + 1).otherwise(month)
    day, year = F.regexp_extract(s, r"\s(\d{1,2}),?\s", 1), F.regexp_extract(s, r"(\d{4})\s*$", 1)
    return F.try_to_timestamp(F.concat_ws("-", year, month.cast("string"), day), F.lit("yyyy-M-d")).cast("date")


def find_dates(text: Column) -> Column:
    """Distinct sorted dates written with month names."""
    raw = F.regexp_extract_all(text, F.lit(f"(?i){MONTH_DATE}"), F.lit(0))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(raw, lambda x: to_day(x)))))


def explicit_period(text: Column) -> Column:
    """Struct (start, end) of 'for the period A through B', or, where that wording is absent, (null, A) of 'as of A'."""
    span = rf"(?i)for the period\s+({ANY_DATE})\s+(?:to|through|thru|-)\s+({ANY_DATE})"
    start, end = (to_day(F.regexp_extract(text, span, k), exact=False) for k in (1, 2))
    at = to_day(F.regexp_extract(text, rf"(?i)as of\s+({ANY_DATE})", 1), exact=False)
    whole = F.when(end.isNotNull(), F.struct(start.alias("start"), end.alias("end")))
    return F.when(text.rlike(span), whole).when(at.isNotNull(), F.struct(F.lit(None).cast("date").alias("start"), at.alias("end")))


def response_section(lines: DataFrame, last_pages: int = 10) -> DataFrame:
    """(doc_id, start_page, end_page, start_line, end_line): the first short line of the last pages that names a response;
    the section is taken to be five pages and 500 lines long. lines: doc_id, line_no, line, page."""
    pages = F.max("page").over(Window.partitionBy("doc_id"))
    hit = (F.length(F.trim("line")) < 100) & F.lower("line").rlike("|".join(RESPONSE_HEADINGS))
    near = lines.withColumn("pages", pages).where(hit & (F.col("page") >= F.greatest(F.lit(1), F.col("pages") - last_pages)))
    first = near.groupBy("doc_id").agg(F.min(F.struct("line_no", "page", "pages")).alias("f"))
    return first.select("doc_id", F.col("f.page").alias("start_page"), F.least(F.col("f.page") + 5, F.col("f.pages")).alias("end_page"), F.col("f.line_no").alias("start_line"), (F.col("f.line_no") + 500).alias("end_line"))


def edge_lines(pages: DataFrame, first_pages: int = 5, edge: int = 2) -> DataFrame:
    """(doc_id, page_no, foot, pos, line): the first and the last non-blank lines of the first pages, lower case. Pages with
    fewer lines than `edge` have none; a line may be both."""
    own = F.filter(F.transform(F.split("text", "\n"), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    rows = pages.where(F.col("page_no") <= first_pages).select("doc_id", "page_no", own.alias("own")).where(F.size("own") >= edge)
    side = lambda at, foot: rows.select("doc_id", "page_no", F.lit(foot).alias("foot"), F.posexplode(F.slice("own", at, F.lit(edge))).alias("pos", "line"))
    return side(F.lit(1), False).unionByName(side(F.lit(-edge), True))


def repeated_edge_lines(pages: DataFrame, first_pages: int = 5, edge: int = 2, least: int = 3) -> DataFrame:
    """(doc_id, line, n, first): edge lines that repeat, with the place of the first one (headers before footers)."""
    rows = edge_lines(pages, first_pages, edge)
    return rows.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("foot", "page_no", "pos")).alias("first")).where(F.col("n") >= least)


#: The answer that stands for no auditor, and the scores of the vote.
NO_AUDITOR, VOTE_BOOST, VOTE_ALONE = "Auditor Could Not Be Identified", 0.20, 0.70


def header_footer_vote(pages: DataFrame, firms: DataFrame, answers: DataFrame, least: int = 3) -> DataFrame:
    """answers (doc_id, auditor, confidence) after the vote of repeated edge lines: the first firm of the list that the
    first such line names raises the confidence of an equal answer, stands in for a missing one, and leaves another one
    alone (`voted` holds it). firms: pos, short, legal."""
    named = repeated_edge_lines(pages, least=least).join(T.small(firms), F.contains(F.col("line"), F.lower("short")))
    vote = named.groupBy("doc_id").agg(F.min(F.struct("first", "pos", "legal")).alias("v")).select("doc_id", F.col("v.legal").alias("voted"))
    j = answers.join(vote, "doc_id", "left")
    missing = F.col("auditor").isNull() | (F.trim("auditor") == "") | (F.col("auditor") == NO_AUDITOR)
    equal = F.lower("voted") == F.lower("auditor")
    score = F.when(missing & F.col("voted").isNotNull(), VOTE_ALONE).when(~missing & equal, F.least(F.lit(1.0), F.col("confidence") + VOTE_BOOST)).otherwise(F.col("confidence"))
    return j.select("doc_id", F.when(missing, F.coalesce("voted", "auditor")).otherwise(F.col("auditor")).alias("auditor"), F.round(score, 6).alias("confidence"), "voted")


def pattern_score(frequency: Column) -> Column:
    """Score of an id whose shape an organization has used so often."""
    f = frequency
    return F.round(F.when(f >= 20, 0.95).when(f >= 10, 0.8 + (f - 10) * 0.015).otherwise(0.7 + (f - 5) * 0.02), 6)


def score_control_ids(controls: DataFrame, patterns: DataFrame) -> DataFrame:
    """controls (id, organization, control_id, pattern) with a score: 0 blank, 0.3 no shape, 0.5 no stored shapes of the
    organization, by frequency if stored, else by the most similar stored shape (0.75, 0.6, 0.5 or 0.3). Shapes are
    compared once for each distinct shape of an organization."""
    stored = patterns.select("organization", "pattern", "frequency")
    asked = controls.where(F.col("pattern").isNotNull()).select("organization", "pattern").distinct().join(stored, ["organization", "pattern"], "left_anti")
    near = asked.join(stored.select("organization", F.col("pattern").alias("known")), "organization")
    near = near.withColumn("sim", pattern_similarity(F.col("pattern"), F.col("known"))).groupBy("organization", "pattern").agg(F.max("sim").alias("sim"))
    has = patterns.select("organization").distinct().withColumn("has", F.lit(True))
    j = controls.join(stored, ["organization", "pattern"], "left").join(near, ["organization", "pattern"], "left").join(has, "organization", "left")
    blank = F.trim(F.coalesce("control_id", F.lit(""))) == ""
    alike = F.when(F.col("sim") >= 0.9, 0.75).when(F.col("sim") >= 0.7, 0.6).when(F.col("sim") >= 0.5, 0.5).otherwise(0.3)
    by = F.when(F.col("frequency").isNotNull(), pattern_score(F.col("frequency"))).otherwise(alike)
    return j.withColumn("score", F.when(blank, 0.0).when(F.col("pattern").isNull(), 0.3).when(F.col("has").isNull(), 0.5).otherwise(by)).drop("sim", "has", "frequency")


#: Where a chunk may end, best first: before the second line feed of a paragraph, before a bullet, after a full stop, at a line end.
SEEK = 200


def last_break(tail: str) -> int:
    """Place in tail at which a chunk best ends (that character is its last), -1 for none."""
    paragraph = tail.rfind("\n\n")
    if paragraph >= 0:
        return paragraph
    bullets = [m.start() for m in re.finditer(r"\n[•*-]\s", tail)]
    if bullets:
        return bullets[-1]
    sentence = max(tail.rfind(".\n"), tail.rfind(". "))
    return sentence if sentence >= 0 else tail.rfind("\n")


@F.udtf(returnType="chunk_id long, start long, text string")
class BoundaryChunks:
    """Rows of one text: chunks of at most `size` characters, each begun `overlap` before the end of the one before."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, int, str]]:
        start, k = 0, 0
        while text and start < len(text):
            chunk = text[start : start + size]
            last = start + size >= len(text)
            if not last:
                tail = max(0, size - SEEK)
                at = last_break(chunk[tail:])
                if at > 0:
                    chunk = chunk[: tail + at + 1]
            yield k, start, chunk
            if last:
                return
            start, k = start + len(chunk) - overlap, k + 1


def boundary_chunks(docs: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """(doc_id, chunk_id, start, text) of each text, by a lateral join with a table function: the cut of a chunk depends on the
    one before, so a text is one loop, and nothing is shuffled. A null or empty text has no chunks.

    The overlap must leave every chunk something new: it is under size - 200, or under 2 where size is 200 or less.
    """
    if not 0 <= overlap < max(size - SEEK, 0) + 2:
        raise ValueError("the overlap would keep chunks from moving on")
    cut = BoundaryChunks(F.col("text").outer(), F.lit(size), F.lit(overlap))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).lateralJoin(cut.alias("c")).select("doc_id", "c.chunk_id", "c.start", "c.text")
