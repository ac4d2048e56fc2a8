"""Very many names looked for in texts at once, with one automaton (Aho-Corasick) of all their spellings per task.

A text is read once, however many spellings there are. Names are counted before they are sent to the tasks: beyond MOST
spellings they go in shares of a bounded size, each of which reads the texts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spellings of one automaton; some hundred bytes each.
MOST = 200_000
#: Texts of a batch whose finds go out together.
PART = 500
WORD = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(s: Column) -> Column:
    return F.translate(s, UPPER, LOWER)


def automaton(names: list[tuple[str, bool]]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for k, (spelling, whole) in enumerate(names):
        out.add_word(spelling, (k, len(spelling), whole))
    out.make_automaton()
    return out


def bounded(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] stands between word boundaries (of ASCII words), as \\b sees it."""
    before = (start > 0 and text[start - 1] in WORD) != (text[start] in WORD)
    return before and (end < len(text) and text[end] in WORD) != (text[end - 1] in WORD)


def found_spellings(docs: DataFrame, spellings: DataFrame, most: int = MOST) -> DataFrame:
    """(doc_id, spelling, n) of each row of docs (doc_id, text) and each spelling in its text, n being how often, from left to
    right without overlap with itself. spellings: spelling, whole (only between word boundaries); case counts on both sides.

    Empty and null spellings are found nowhere; repeated ones are one, and as `whole` as all of them. Repeated rows of docs
    are each reported.
    """
    spark = docs.sparkSession
    listed = spellings.where("spelling <> ''").groupBy("spelling").agg(F.bool_and(F.coalesce("whole", F.lit(False))).alias("whole"))
    n = listed.count()
    shares = max(1, -(-n // most))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def of_share(k: int) -> DataFrame:
        own = listed.where(F.pmod(F.xxhash64("spelling"), F.lit(shares)) == k).collect()
        shared = spark.sparkContext.broadcast([(r["spelling"], r["whole"]) for r in own])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = shared.value
            find = automaton(names) if names else None
            for b in batches:
                # one text at a time becomes a string, and what is found goes out in bounded parts
                for at in range(0, b.num_rows, PART):
                    part = b.slice(at, PART)
                    row, which, n = [], [], []
                    for k, held in enumerate(part.column(1)):
                        text = held.as_py()
                        counts: dict[int, int] = {}
                        free: dict[int, int] = {}
                        for last, (i, size, whole) in find.iter(text) if find and text else ():
                            start = last + 1 - size
                            if start >= free.get(i, 0) and (not whole or bounded(text, start, last + 1)):
                                counts[i] = counts.get(i, 0) + 1
                                free[i] = last + 1
                        row += [k] * len(counts)
                        which += counts.keys()
                        n += counts.values()
                    if row:
                        found = pa.array([names[i][0] for i in which], pa.string())
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), found, pa.array(n, pa.int64())], ["doc_id", "spelling", "n"])

        return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, spelling string, n long")

    out = of_share(0)
    for k in range(1, shares):
        out = out.unionByName(of_share(k))
    return out


def id_spellings(criterion: Column) -> Column:
    """The spellings of an id, in lower case: its letters and numbers parted by nothing, a dot, a blank or a dash; 4^(n-1) for n
    such parts. Null for an id without any."""
    parts = F.regexp_extract_all(ascii_lower(criterion), F.lit("[a-z]+|[0-9]+"), F.lit(0))
    seps = F.array(*map(F.lit, ("", ".", " ", "-")))
    longer = lambda forms, part: F.flatten(F.transform(forms, lambda f: F.transform(seps, lambda s: F.concat(f, s, part))))
    return F.when(F.size(parts) > 0, F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array(F.get(parts, F.lit(0))), longer))


def spelled_ids(criteria: DataFrame) -> DataFrame:
    """(id, spelling, whole) of criteria (id)."""
    return criteria.select("id").distinct().select("id", F.explode(id_spellings(F.col("id"))).alias("spelling")).withColumn("whole", F.lit(True))


def ids_in_text(docs: DataFrame, criteria: DataFrame) -> DataFrame:
    """(doc_id, id), each once, of criteria (id) that a text names in one of their spellings, in any case."""
    names = spelled_ids(criteria)
    hits = found_spellings(docs.select("doc_id", ascii_lower(F.col("text")).alias("text")), names).select("doc_id", "spelling").distinct()
    return hits.join(names.select("id", "spelling"), "spelling").select("doc_id", "id").distinct()


def keyword_assertions(docs: DataFrame, keywords: DataFrame, least: float = 0.60) -> DataFrame:
    """(doc_id, assertion, m, confidence): m different keywords of an assertion in a text, at least enough for `least`.
    keywords: assertion, keyword; case does not count."""
    names = keywords.select("assertion", F.lower("keyword").alias("spelling")).distinct()
    hits = found_spellings(docs.select("doc_id", F.lower("text").alias("text")), names.withColumn("whole", F.lit(False)))
    m = hits.select("doc_id", "spelling").distinct().join(names, "spelling").groupBy("doc_id", "assertion").agg(F.count(F.lit(1)).alias("m"))
    confidence = F.least(F.lit(0.95), 0.5 + F.least(F.lit(0.4), 0.1 * F.col("m")))
    return m.withColumn("confidence", F.round(confidence, 6)).where(F.col("confidence") >= least)


def match_known_firms(docs: DataFrame, firms: DataFrame) -> DataFrame:
    """(doc_id, firm, n): the legal name met most often in each text, possessive forms counting twice; ties go to the
    firm that is listed first. firms: pos, short, legal."""
    forms = firms.select("pos", "legal", F.explode(F.array(*[F.concat(F.lower("short"), F.lit(s)) for s in ("", "'s", "’s")])).alias("spelling"))
    hits = found_spellings(docs.select("doc_id", F.lower("text").alias("text")), forms.select("spelling", F.lit(False).alias("whole")))
    each = hits.join(forms, "spelling").groupBy("doc_id", "legal").agg(F.sum("n").alias("n"), F.min("pos").alias("pos"))
    best = each.groupBy("doc_id").agg(F.max_by(F.struct("legal", "n"), F.struct("n", -F.col("pos"))).alias("b"))
    return best.select("doc_id", F.col("b.legal").alias("firm"), F.col("b.n").alias("n"))
