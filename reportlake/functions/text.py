"""Scalar functions over identifiers, text, page lists, confidences and dates, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_pattern(s: Column) -> Column:
    """Shape of a control id with each digit as X; null for ids of no known shape."""
    known = s.rlike(r"^[A-Z]{2,5}-\d+-\d+$") | s.rlike(r"^[A-Z]\.\d+\.\d+$") | s.rlike(r"^[A-Z]\.\d+$")
    return F.when(known, F.regexp_replace(s, r"\d", "X"))


def id_signature(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, r"\d", "#"), r"\p{L}", "L")


def positional_match(a: Column, b: Column) -> Column:
    """Share of positions with equal characters; 0 for two empty strings."""
    hits = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.isNotNull() & y.isNotNull() & (x == y)), lambda v: v))
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 0.0).otherwise(hits / longest)


def merged_pattern(a: Column, b: Column) -> Column:
    """Dash-parted patterns merged part by part: equal parts stay; a common ending of 2 or more gives X and it; else X
    as often as the longer part is long."""

    def part(x: Column, y: Column) -> Column:
        sizes = F.sequence(F.least(F.length(x), F.length(y)), F.lit(1), F.lit(-1))
        tails = F.filter(sizes, lambda n: F.right(x, n) == F.right(y, n))
        best = F.coalesce(F.get(tails, F.lit(0)), F.lit(0))
        return F.when(x == y, x).when(best >= 2, F.concat(F.lit("X"), F.right(x, best))).otherwise(F.repeat(F.lit("X"), F.greatest(F.length(x), F.length(y))))

    return F.array_join(F.zip_with(F.split(a, "-"), F.split(b, "-"), part), "-")


def strip_line_markers(s: Column) -> Column:
    """Text without line numbers between double bars."""
    return F.regexp_replace(s, r"║\d+║\s*", "")


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A list marked for broadcast if it is small, by count; else as it is, for a distributed join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Legal forms that do not tell companies apart.
LEGAL_FORMS = "inc|llc|ltd|corp|corporation|incorporated|plc|gmbh|sarl|sa|bv|lp|llp|co"


def canonical_key(name: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(name), r"\([^)]*\)", ""), "[.,]", "")
    return F.trim(F.regexp_replace(bare, rf"\b({LEGAL_FORMS})\b", ""))


def keyword_distance(text: Column, keywords: list[str]) -> Column:
    """Least edit distance of a keyword to any run of as many words of the text; 999 without one."""
    words = F.split(F.lower(text), " ")

    def nearest(k: str) -> Column:
        n = len(k.split(" "))
        runs = F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " ")))
        return F.array_min(F.transform(runs, lambda r: F.levenshtein(r, F.lit(k))))

    each = [nearest(k) for k in keywords]
    return F.coalesce(F.least(*each) if len(each) > 1 else each[0], F.lit(999)).cast("long")


def parse_page_refs(s: Column) -> Column:
    """Sorted distinct integers of a comma string, bad parts skipped."""
    parts = F.transform(F.split(F.regexp_replace(s, r"[\[\]\s]", ""), ","), lambda p: p.try_cast("int"))
    return F.array_sort(F.array_distinct(F.array_compact(parts)))


def parse_page_ranges(s: Column) -> Column:
    """'5, 7-9' as sorted distinct integers; null if any part is empty, not positive or reversed."""
    part = r"^[1-9]\d*(-[1-9]\d*)?$"
    parts = F.transform(F.split(s, ","), lambda p: F.trim(p))
    low = lambda p: F.split(p, "-")[0].try_cast("int")
    high = lambda p: F.element_at(F.split(p, "-"), -1).try_cast("int")
    good = F.forall(parts, lambda p: p.rlike(part) & (low(p) <= high(p)))
    spread = F.transform(parts, lambda p: F.when(p.rlike(part) & (low(p) <= high(p)), F.sequence(low(p), high(p))).otherwise(F.array(F.lit(0))))
    return F.when(good, F.array_sort(F.array_distinct(F.flatten(spread))))


def normalize_percent(s: Column) -> Column:
    """'95%', 95 and 0.95 as 0.95; a % sign always divides."""
    n = F.rtrim(F.regexp_replace(F.trim(s), "%", "")).try_cast("double")
    return F.when(s.contains("%") | (n > 1), n / 100).otherwise(n)


def calendar_months(a: Column, b: Column) -> Column:
    return ((F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)).cast("long")


#: Date formats in the order in which they are tried; month before day where both could be meant.
DATE_FORMATS = ["yyyy-M-d", "yyyy/M/d", "M/d/yyyy", "d/M/yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy"]


def parse_date_any(s: Column) -> Column:
    """First format that fits, standing at noon; else an ISO date and time (T or blank, with or without Z), at noon if it says
    midnight. Null for anything else, blanks and `{}`."""
    bare = F.trim(F.regexp_replace(s, r"\s+", " "))
    noon = F.expr("interval 12 hours")
    days = [F.try_to_timestamp(bare, F.lit(f)) + noon for f in DATE_FORMATS]
    iso = F.rtrim(F.regexp_replace(F.replace(bare, F.lit("T"), F.lit(" ")), "Z+$", ""))
    time = F.when(iso.rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d(:\d\d(\.\d{1,6})?)?([+-]\d\d:\d\d)?$"), iso.try_cast("timestamp"))
    midnight = (F.hour(time) == 0) & (F.minute(time) == 0) & (F.second(time) == 0)
    return F.coalesce(*days, F.when(midnight, time + noon).otherwise(time))


def text_snippet(s: Column, n: int = 150) -> Column:
    flat = F.trim(F.regexp_replace(s, r"[ \t\n\r\f]+", " "))
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("..."))).otherwise(flat)


#: How ids look in the text of a control, in the order in which they are tried.
SNIPPET_IDS = [r"CC\d+\.\d+", r"Control\s+\d+\.\d+", r"\d+\.\d+", r"Control\s+ID:\s*\w+-\d+", r"Ref:\s*\d+\.\d+\.\d+"]


def id_snippet(s: Column) -> Column:
    """An id and the sentence after it, up to 200 characters; else the first 150 of the text. Null for a blank text."""
    flat = F.trim(F.regexp_replace(s, r"\s+", " "))
    found = []
    for p in SNIPPET_IDS:
        whole = rf"(?is)^.*?({p})\s*([^.!?]*[.!?])"
        both = F.trim(F.concat_ws(" ", F.regexp_extract(flat, whole, 1), F.regexp_extract(flat, whole, 2)))
        found.append(F.when(flat.rlike(whole), F.when(F.length(both) > 200, F.concat(F.substring(both, 1, 197), F.lit("..."))).otherwise(both)))
    return F.when(flat == "", None).otherwise(F.coalesce(*found, text_snippet(s)))


def collapse_blank_lines(s: Column, most: int = 2) -> Column:
    return F.regexp_replace(s, rf"\n{{{most + 2},}}", "\n" * (most + 1))


def normalize_heading(s: Column) -> Column:
    """ASCII headings: section label, numerals, white space and punctuation go."""
    bare = F.regexp_replace(F.lower(s), r"^(section|part|chapter)\s+([ivx]+|\d+|[a-z])\b", "")
    return F.regexp_replace(F.regexp_replace(bare, r"^[\s\d.ivx]+[.):]", ""), r"[^a-z0-9]+", "")


def explicit_criteria(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\b(CC\d\.\d{1,2}|[AC]\d\.\d|PI\d\.\d)\b"), F.lit(1))


def token_estimate(s: Column) -> Column:
    return F.floor(F.length(s) / 4).cast("long")


def offset_to_line(text: Column, offset: Column) -> Column:
    head = F.substring(text, F.lit(1), offset)
    return (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).cast("long")


#: Who has a duty, and how a duty is worded.
ENTITY_NOUNS = ["user entity", "user entities", "customer", "client", "customers", "clients"]
DUTY_PHRASES = ["responsible for", "must ensure", "shall ensure", "is required to", "should", "must", "needs to", "are expected to"]
OBLIGATIONS = ["should", "must", "shall", "ensure", "required to", "controls are in place", "are expected to"]


def any_of(text: Column, phrases: list[str]) -> Column:
    # the text is an element of an array, or Spark would work it out again for each phrase
    return F.exists(F.array(F.lower(text)), lambda low: F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(low, p)))


def responsibility(text: Column) -> Column:
    return any_of(text, ENTITY_NOUNS) & any_of(text, DUTY_PHRASES)


def page_distance(a: Column, b: Column) -> Column:
    return F.array_min(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.abs(x - y))))).cast("long")


def format_confidence(c: Column) -> Column:
    return F.concat(F.round(c * 100).cast("int").cast("string"), F.lit("%"))


def parse_json_array(s: Column) -> Column:
    listed = F.filter(F.transform(F.split(s, "[,\n]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.from_json(s, "array<string>", {"mode": "PERMISSIVE"}), listed)


def append_log(log: Column, message: Column) -> Column:
    return F.when(F.coalesce(log, F.lit("")) == "", F.concat(F.lit("[SYSTEM] "), message)).otherwise(F.concat(log, F.lit(" | [SYSTEM] "), message))


def overall_progress(upload: Column, sections: Column, content: list[Column], finish: Column) -> Column:
    mean = sum(content[1:], content[0]) / len(content)
    return F.floor(0.20 * upload + 0.10 * sections + 0.65 * mean + 0.05 * finish).cast("long")


def percent_complete(elapsed: Column, estimate: Column, done: Column) -> Column:
    return F.when(done, F.lit(100.0)).otherwise(F.least(F.lit(90.0), F.when(estimate > 0, elapsed / estimate * 100).otherwise(0.0)))


def section_topic(heading: Column) -> Column:
    has = lambda w: F.contains(F.lower(heading), F.lit(w))
    return (
        F.when(has("auditor") & has("report"), "Service_Auditor_Report")
        .when(has("management") & (has("assertion") | has("statement")), "Management_Assertion")
        .when(has("description") & has("system"), "Description_of_System")
        .when(has("control"), "Control_Descriptions")
        .otherwise("Unknown")
    )
