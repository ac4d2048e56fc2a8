"""Positional inverted index of training texts, and exact phrase and proximity matches of test items in it.

Functions of DataFrames only. The index has a posting (document, position, term) for each word. A test item is cut into
windows of consecutive words, equal ones once. A posting at position p of the term at offset o of a window says that the
window may start at p - o: such offset-adjusted lists are intersected, those of the two rarest terms of a window first,
and what is left of them with those of the other terms. Windows that share their two rarest terms, at the same distance,
are one at the first step, and a window with a term that no document has goes before it. No list of a frequent term is
ever multiplied by the windows that hold it, and all keys are single places of a document, so no term is a hot group.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written

WINDOW = 10
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DOC = ["d1", "d2"]


class Index(NamedTuple):
    """postings: d1, d2, pos, term_id; terms: term, term_id, n (postings)."""

    postings: DataFrame
    terms: DataFrame


def raw_words(text: Column) -> Column:
    """Runs of ASCII letters and digits and of characters beyond ASCII; none for null."""
    return F.array_remove(F.split(text_or_empty(text), GAPS), "")


def lowered(word: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def doc_key(doc_id: Column, text: Column) -> list[Column]:
    """Two hashes by which a row is known: equal rows share them, and rows that share an id but not the text do not."""
    return [F.xxhash64(doc_id, text).alias("d1"), F.xxhash64(text, F.lit("row"), doc_id).alias("d2")]


def item_windows(items: DataFrame, width: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(win, terms) of the distinct windows of the items (item_id, text), and (win, item_id). An item of fewer than `width`
    words is one window, an item without words none. Items are few, as a rule; nothing here is collected, though."""
    bare = items.select("item_id", F.transform(raw_words(F.col("text")), lowered).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    own = bare.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s, width))).alias("terms")).distinct()
    windows = written(own.select("terms").distinct().withColumn("win", F.monotonically_increasing_id()), "windows")
    return windows, written(own.join(windows, "terms").select("win", "item_id"), "window-items")


def build_index(docs: DataFrame, terms: DataFrame | None = None) -> Index:
    """The index of docs (doc_id, text), written to the shared folder. With `terms` (term) only their postings are stored:
    a posting of any other term has no part in a match of windows made of these terms alone."""
    places = docs.select(*doc_key(F.col("doc_id"), F.col("text")), F.posexplode(raw_words(F.col("text"))).alias("pos", "word"))
    places = places.select(*DOC, "pos", lowered(F.col("word")).alias("term"))
    named = (places if terms is None else terms).select("term").distinct()
    named = written(named.withColumn("term_id", F.monotonically_increasing_id()), "terms")
    postings = written(places.join(named, "term").select(*DOC, "pos", "term_id"), "postings")
    counts = postings.groupBy("term_id").agg(F.count(F.lit(1)).alias("n"))
    return Index(postings, written(named.join(counts, "term_id"), "term-counts"))


def matches(index: Index, windows: DataFrame, slop: int = 0) -> DataFrame:
    """(d1, d2, start, n_terms, win): where windows (win, terms) occur, start being the place of the first word, from 0.

    With slop 0 these are the exact phrases. With more they are proximity matches: each term lies within `slop` words of its
    place in the phrase as set by the window's rarest term. Windows have at most 62 terms.
    """
    each = windows.select("win", F.size("terms").alias("n_terms"), F.posexplode("terms").alias("off", "term")).join(index.terms, "term")
    lists = each.groupBy("win", "n_terms").agg(F.sort_array(F.collect_list(F.struct("n", "term_id", "off"))).alias("ls")).where(F.size("ls") == F.col("n_terms"))
    a, b = F.get("ls", F.lit(0)), F.get("ls", F.lit(1))
    live = lists.select("win", "n_terms", "ls", a["term_id"].alias("t1"), a["off"].alias("o1"), b["term_id"].alias("t2"), (b["off"] - a["off"]).alias("gap"))
    live = written(live, "live-windows")
    pairs = written(live.select("t1", "t2", "gap").distinct().withColumn("pair", F.monotonically_increasing_id()), "pairs")

    # the two rarest: adjusted lists meet at the rarest term's place
    shifts = F.sequence(F.lit(-slop), F.lit(slop))
    first = F.array(F.struct(F.col("t1").alias("term_id"), F.lit(0).alias("shift"), F.lit(1).alias("bit")))
    second = F.transform(shifts, lambda s: F.struct(F.col("t2").alias("term_id"), (F.col("gap") + s).alias("shift"), F.lit(2).alias("bit")))
    both = F.when(F.col("t2").isNull(), first).otherwise(F.concat(first, second))
    probes = pairs.select("pair", F.when(F.col("t2").isNull(), 1).otherwise(3).alias("all"), F.explode(both).alias("x")).select("pair", "all", "x.*")
    adjusted = index.postings.join(written(probes, "probes"), "term_id").select(*DOC, (F.col("pos") - F.col("shift")).alias("at"), "pair", "all", "bit")
    met = adjusted.groupBy(*DOC, "at", "pair", "all").agg(F.bit_or("bit").alias("bits")).where(F.col("bits") == F.col("all"))
    named = live.join(pairs, live["t1"].eqNullSafe(pairs["t1"]) & live["t2"].eqNullSafe(pairs["t2"]) & live["gap"].eqNullSafe(pairs["gap"]))
    named = named.select("pair", "win", "n_terms", "o1", F.slice("ls", F.lit(3), 62).alias("rest"))
    open_ = met.join(written(named, "pair-windows"), "pair").select(*DOC, (F.col("at") - F.col("o1")).alias("start"), "n_terms", "win", "rest")
    open_ = written(open_.where((F.col("start") >= 0) | F.lit(slop > 0)), "candidates")

    # the others: each is looked up at its place; only documents with candidates are read for that
    wanted = open_.where(F.size("rest") > 0).select(*DOC, "start", "n_terms", "win", F.explode("rest").alias("r"))
    wanted = wanted.select(*DOC, "start", "n_terms", "win", F.col("r.term_id").alias("term_id"), F.col("r.off").alias("off"))
    wanted = wanted.withColumn("pos", F.explode(F.transform(shifts, lambda s: F.col("start") + F.col("off") + s)) if slop else F.col("start") + F.col("off"))
    held = index.postings.join(written(open_.select(*DOC).distinct(), "candidate-documents"), DOC, "left_semi")
    found = wanted.join(held, [*DOC, "pos", "term_id"]).groupBy(*DOC, "start", "n_terms", "win").agg(F.bit_or(F.expr("shiftleft(1L, off)")).alias("bits"))
    whole = found.where(F.bit_count("bits") == F.col("n_terms") - 2)
    columns = [*DOC, "start", "n_terms", "win"]
    return written(open_.where(F.size("rest") == 0).select(*columns).unionByName(whole.select(*columns)), "matches")


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit (words inside an occurrence of an item's window), n_items, items (array of the ids of items with
    such windows, as sorted strings) of each row of docs (doc_id, text).

    A null or empty text has no words; items (item_id, text) without words match nothing; a null item_id counts as the empty
    string. Rows that are equal in id and text get equal results, rows that share or lack an id are judged each by its own
    text. Empty docs give no rows, empty items no hits. Other columns, whatever their names, are not looked at.
    """
    docs = docs.select("doc_id", "text")
    windows, holders = item_windows(items.select("item_id", "text"), width)
    index = build_index(docs, windows.select(F.explode("terms").alias("term")))
    found = matches(index, windows)

    spans = found.groupBy(*DOC, "start").agg(F.max(F.col("start") + F.col("n_terms")).alias("end"))
    seen = F.expr("max(end) over (partition by d1, d2 order by start rows between unbounded preceding and 1 preceding)")
    new = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(seen, F.col("start"))))
    hits = spans.select(*DOC, new.alias("new")).groupBy(*DOC).agg(F.sum("new").alias("n_hit"))
    named = found.select(*DOC, "win").distinct().join(holders, "win").select(*DOC, F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")).distinct()
    owners = named.groupBy(*DOC).agg(F.sort_array(F.collect_list("item")).alias("items"))
    marks = written(hits.join(owners, DOC), "marks")

    rows = docs.select("doc_id", *doc_key(F.col("doc_id"), F.col("text")), F.size(raw_words(F.col("text"))).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    return rows.join(marks, DOC, "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"),
    )
