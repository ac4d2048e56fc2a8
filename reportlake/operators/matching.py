"""Fuzzy matching and model-shaped operators. Similarities are computed inside reports or blocks only."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportlake.functions import text as T
from reportlake.functions.similarity import alike, most_alike, seq_ratio

from . import contents, linking

#: Texts of one side that are compared in one go.
PACK = 512


def alike_pairs(left: DataFrame, right: DataFrame, key: str, least: float) -> DataFrame:
    """(key, text, matched, sim): all pairs of different rows' texts with an equal key and a ratio of at least `least`.
    left: key, text; right: key, matched. The texts of a key are dealt into packs of about PACK, and each pack of one side
    meets each of the other, so a large key spreads over many tasks."""

    def packed(df: DataFrame, column: str, name: str) -> DataFrame:
        d = df.select(key, column).where(F.col(key).isNotNull() & (F.trim(column) != "")).distinct()
        packs = d.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / PACK).alias("packs"))
        dealt = d.join(packs, key).groupBy(key, F.pmod(F.xxhash64(column), "packs").alias(f"{name}_no"))
        return dealt.agg(F.collect_list(column).alias(name))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, ls, rs in zip(b[key], b["ls"], b["rs"], strict=True):
                found = [(k, ls[i], rs[j], sim) for i, j, sim in alike(list(ls), list(rs), least)]
                if found:
                    yield pd.DataFrame(found, columns=[key, "text", "matched", "sim"])

    met = linking.apart(packed(left, "text", "ls").join(packed(right, "matched", "rs"), key), key, "ls_no", "rs_no").select(key, "ls", "rs")
    return met.mapInPandas(run, f"{key} {left.schema[key].dataType.simpleString()}, text string, matched string, sim double")


def fuzzy_upsert(extracted: DataFrame, existing: DataFrame, least: float = 0.80, boost: float = 0.2) -> DataFrame:
    """Existing rows with raised confidence where an extracted text of the report matches, and unmatched ones as new
    rows. Both: scan_id, text, confidence; existing has id too. Each text is matched within its whole report."""
    old = existing.where("text is not null").groupBy("scan_id", F.col("text").alias("matched")).agg(F.min("id").alias("id"))
    pairs = linking.alike_pairs(extracted, old, "scan_id", least).join(old, ["scan_id", "matched"])
    best = pairs.groupBy("scan_id", "text").agg(F.max_by("id", F.struct("sim", -F.col("id"))).alias("id"))
    hit = best.select("id").distinct().withColumn("hit", F.lit(True))
    updated = existing.join(hit, "id", "left").withColumn("confidence", F.when(F.col("hit"), F.least(F.lit(1.0), F.col("confidence") + boost)).otherwise(F.col("confidence"))).withColumn("action", F.when(F.col("hit"), "updated").otherwise("kept")).drop("hit")
    fresh = extracted.join(best, ["scan_id", "text"], "left_anti").select(F.lit(None).cast("long").alias("id"), "scan_id", "text", "confidence", F.lit("inserted").alias("action"))
    return updated.select("id", "scan_id", "text", "confidence", "action").unionByName(fresh)


def rescue_bad_chunks(bad: DataFrame, good: DataFrame, least: float = 0.7) -> DataFrame:
    """(doc_id, text, kind, matched): exact, fuzzy or unmatched. Each text is matched within its whole document."""
    g = good.select("doc_id", F.col("text").alias("matched")).distinct()
    equal = bad.select("doc_id", "text").distinct().join(g.withColumn("text", F.col("matched")), ["doc_id", "text"]).withColumn("sim", F.lit(1.0))
    sims = alike_pairs(bad, g, "doc_id", least).unionByName(equal)
    best = sims.where(F.col("sim") > least).groupBy("doc_id", "text").agg(F.max_by("matched", F.struct("sim", "matched")).alias("matched"), F.max("sim").alias("sim"))
    out = bad.select("doc_id", "text").join(best, ["doc_id", "text"], "left")
    return out.withColumn("kind", F.when(F.col("sim") == 1.0, "exact").when(F.col("sim").isNotNull(), "fuzzy").otherwise("unmatched"))


#: Wordings of a user entity's duty, and wordings of a system description that is none.
DUTY_SIGNS = ["responsible for", "must ", "shall ", "should ", "ensure", "required to", "user entity", "client ", "customer ", "organization should", "user organization"]
SYSTEM_SIGNS = ["configuration management", "chef –", "utilized to provision", "core capabilities", "the system", "internal audit function", "is assigned the responsibility", "maintained historically"]
SPACE = " \t\n\r\x0b\x0c"


def best_windows(bad: DataFrame, lines: DataFrame, least: float, joined: int = 3) -> DataFrame:
    """(doc_id, text, matched, sim) of the best run of 1 to `joined` lines for each text: over `least`, ties to the earlier
    and then the shorter run. bad: doc_id, text. lines: doc_id, line_no, line. A document's lines go in packs of PACK with the
    few lines that runs reach into. Texts equal to a run but for case meet it in a join; only the others are compared with all
    runs of their document, which are put together where they are compared."""
    kind = bad.schema["doc_id"].dataType.simpleString()
    texts = linking.written(bad.where(F.btrim("text", F.lit(SPACE)) != "").select("doc_id", "text").distinct(), "bad-texts")
    sizes = texts.groupBy("doc_id").agg(F.ceil(F.count(F.lit(1)) / PACK).alias("packs"))
    pack = F.floor(F.col("line_no") / PACK)
    # a line is also the tail of the pack before it
    packs = F.when(F.col("line_no") % PACK < joined - 1, F.array(pack, pack - 1)).otherwise(F.array(pack))
    right = lines.where("line is not null").join(sizes.select("doc_id"), "doc_id", "left_semi").select("doc_id", "line_no", "line", F.explode(packs).alias("pack"))
    right = right.groupBy("doc_id", "pack").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("rs"))

    right = linking.written(right, "line-packs")

    def runs_of(no: int, rs) -> list[tuple[int, int, str]]:
        """(line_no, n, text) of the runs that begin in pack `no`."""
        own, at = [(r["line_no"], r["line"].strip()) for r in rs], []
        for i, (line_no, _) in enumerate(own):
            if line_no // PACK == no:
                for n in range(1, joined + 1):
                    # a run ends at a gap in the numbers
                    if i + n <= len(own) and own[i + n - 1][0] == line_no + n - 1:
                        text = " ".join(t for _, t in own[i : i + n]).replace("\n", " ").strip()
                        if text:
                            at.append((line_no, n, text))
        return at

    plain = lambda x: x.strip().replace("\n", " ")
    low = lambda x: x.strip().lower()

    def spelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [plain(x) for x in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": b["text"], "plain": texts, "low": [low(x) for x in texts]})

    def put_together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for doc, no, rs in zip(b["doc_id"], b["pack"], b["rs"], strict=True):
                rows = [(doc, low(text), -line_no, -n, text) for line_no, n, text in runs_of(no, rs)]
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "low", "before", "fewer", "matched"])

    exact = (F.col("plain") == F.col("matched")).alias("exact")
    keyed = texts.mapInPandas(spelled, f"doc_id {kind}, text string, plain string, low string").where(F.lit(least < 1))
    runs = linking.apart(right, "doc_id", "pack").mapInPandas(put_together, f"doc_id {kind}, low string, before long, fewer long, matched string")
    equal = keyed.join(runs, ["doc_id", "low"]).groupBy("doc_id", "text").agg(F.max(F.struct(exact, F.lit(1.0).alias("sim"), "before", "fewer", "matched")).alias("b"))
    equal = linking.written(equal, "equal-runs")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for doc, no, ls, rs in zip(b["doc_id"], b["pack"], b["ls"], b["rs"], strict=True):
                at = runs_of(no, rs)
                best: dict[int, tuple] = {}
                for i, j, sim in alike([plain(x) for x in ls], [t for _, _, t in at], least):
                    line_no, n, text = at[j]
                    best[i] = max(best.get(i, ()), (sim, -line_no, -n, text))
                rows = [(doc, ls[i], False, *x) for i, x in best.items() if x[0] > least]
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "text", "exact", "sim", "before", "fewer", "matched"])

    rest = texts.join(equal, ["doc_id", "text"], "left_anti")
    left = rest.join(rest.groupBy("doc_id").agg(F.ceil(F.count(F.lit(1)) / PACK).alias("packs")), "doc_id")
    left = left.groupBy("doc_id", F.pmod(F.xxhash64("text"), "packs").alias("left_no")).agg(F.collect_list("text").alias("ls"))
    met = linking.apart(left.join(right, "doc_id"), "doc_id", "left_no", "pack").select("doc_id", "pack", "ls", "rs")
    found = met.mapInPandas(run, f"doc_id {kind}, text string, exact boolean, sim double, before long, fewer long, matched string")
    best = found.groupBy("doc_id", "text").agg(F.max(F.struct("exact", "sim", "before", "fewer", "matched")).alias("b")).unionByName(equal)
    return best.select("doc_id", "text", "b.matched", "b.sim", "b.exact")


def rescue_report(bad: DataFrame, good: DataFrame, lines: DataFrame, least: float = 0.7) -> DataFrame:
    """(doc_id, text, rescue_type, matched, confidence_pct, score) of each distinct failed text of a document: equal to a good
    one (exact), else like one (fuzzy), else found in one to three lines of the source (output_txt_exact, output_txt_fuzzy),
    else unmatched. bad, good: doc_id, text; lines: doc_id, line_no, line.

    A match has a ratio over `least`; equal scores go to the greater good text, or the earlier and shorter run of lines. Space
    around a text does not count; blank and null texts and rows without a document are unmatched.
    """
    bare = lambda c: F.btrim(c, F.lit(SPACE))
    b = bad.select("doc_id", "text").distinct()
    g = good.where(bare(F.col("text")) != "").select("doc_id", F.col("text").alias("matched")).distinct()
    equal = b.withColumn("k", bare(F.col("text"))).join(g.withColumn("k", bare(F.col("matched"))), ["doc_id", "k"])
    equal = equal.groupBy("doc_id", "text").agg(F.max("matched").alias("matched")).select("doc_id", "text", "matched", F.lit(1.0).alias("score"), F.lit("exact").alias("rescue_type"))
    equal = linking.written(equal, "rescued-equal")
    rest = b.join(equal, ["doc_id", "text"], "left_anti")
    sims = alike_pairs(rest, g, "doc_id", least).where(F.col("sim") > least)
    near = sims.groupBy("doc_id", "text").agg(F.max(F.struct("sim", "matched")).alias("m")).select("doc_id", "text", "m.matched", F.col("m.sim").alias("score"), F.lit("fuzzy").alias("rescue_type"))
    near = linking.written(near, "rescued-near")
    rest = rest.join(near, ["doc_id", "text"], "left_anti")
    kind = F.when(F.col("exact"), "output_txt_exact").otherwise("output_txt_fuzzy")
    source = best_windows(rest, lines, least).select("doc_id", "text", "matched", F.col("sim").alias("score"), kind.alias("rescue_type"))
    found = equal.unionByName(near).unionByName(source)
    out = b.join(found, ["doc_id", "text"], "left")
    return out.select("doc_id", "text", F.coalesce("rescue_type", F.lit("unmatched")).alias("rescue_type"), "matched", F.bround(F.col("score") * 100).cast("int").alias("confidence_pct"), "score")


def recovered_rows(report: DataFrame, good: DataFrame, least: float = 0.95, cap: float = 0.7) -> DataFrame:
    """(doc_id, cuec_description, cuec_source, cuec_confidence, justification) of texts found in the source that read like a
    whole duty of the user entity and are not among the good ones yet; each once per document."""
    said = F.lower("matched")
    any_of = lambda signs: F.greatest(*[F.contains(said, F.lit(s)) for s in signs])
    whole = (F.length("matched") >= 50) & (F.rtrim("matched").rlike(r"[.;]$") | (F.length("matched") >= 100))
    real = report.where(F.col("rescue_type").startswith("output_txt") & (F.col("score") >= least) & any_of(DUTY_SIGNS) & whole & ~any_of(SYSTEM_SIGNS))
    one = real.groupBy("doc_id", F.col("matched").alias("cuec_description")).agg(F.max("score").alias("score"))
    known = good.select("doc_id", F.btrim("text", F.lit(SPACE)).alias("cuec_description"))
    fresh = one.join(known, ["doc_id", "cuec_description"], "left_anti")
    value = min(cap, 0.3 + 0.2 + 0.1)
    notes = F.array(
        F.format_string("Recovered from output.txt with %.1f%% fuzzy match", F.col("score") * 100), F.lit(f"Base confidence: {value:.1f} (capped at {cap} for manual review)"),
        F.lit("+0.2: Contains CUEC responsibility indicators"), F.lit("+0.1: Complete sentence structure"),
    )
    return fresh.select("doc_id", "cuec_description", F.lit("recovered_from_output_txt").alias("cuec_source"), F.lit(round(value, 3)).alias("cuec_confidence"), notes.alias("justification"))


#: Pairs of a heading and a line that a task should at least be worth.
TASK_PAIRS = 20_000


def line_packs(lines: DataFrame, joined: int) -> DataFrame:
    """The non-blank lines (doc_id, line_no, line), trimmed and in compatibility form: PACK in a pack, in their order, with the
    few lines after them that runs of `joined` reach into.

    (doc_id, pack, begun, line_no, body, skip, odd): how many lines are the pack's own, and arrays by line: its number, its
    letters and digits, and how many of them core_heading() takes for a label in front. A line that may be a label as a whole
    has the keys of its runs in `odd` instead, since what follows decides.
    """
    own = contents.nfkc(lines.where(F.trim("line") != "").select("doc_id", "line_no", F.trim("line").alias("line")), "line")
    order = Window.partitionBy("doc_id").orderBy("line_no")
    text = contents.without_label(F.col("line"))
    body = contents.bare(F.col("line"))
    ahead = F.array("line", *[F.lead("line", k).over(order) for k in range(1, joined)])
    # what is made of a line is made after the shuffle
    rows = own.select("doc_id", "line_no", "line", (F.row_number().over(order) - 1).alias("nth"), ahead.alias("ls"))
    rows = rows.withColumns({"body": body, "text": text})
    odd = F.array(*[contents.core_heading(F.array_join(F.slice("ls", F.lit(1), F.lit(n)), " ")) for n in range(1, joined + 1)])
    rows = rows.withColumn("odd", F.when((F.col("text") == "") | F.col("line").rlike(r"(?i)^section\s*$"), odd)).withColumn("skip", F.length("body") - F.length(contents.bare(F.col("text"))))
    pack = F.floor(F.col("nth") / PACK)
    # a line is also the tail of the pack before it
    packs = F.when((F.col("nth") % PACK < joined - 1) & (pack > 0), F.array(pack, pack - 1)).otherwise(F.array(pack))
    each = rows.select("doc_id", pack.alias("home"), F.explode(packs).alias("pack"), F.struct("nth", "line_no", "body", "skip", "odd").alias("l"))
    grouped = each.groupBy("doc_id", "pack").agg(F.count_if(F.col("home") == F.col("pack")).cast("int").alias("begun"), F.array_sort(F.collect_list("l")).alias("ls"))
    return grouped.select("doc_id", "pack", "begun", *[F.col(f"ls.{c}").alias(c) for c in ("line_no", "body", "skip", "odd")])


def run_keys(joined: int) -> Column:
    """Of a row of line_packs(): array of (line_no, n_lines, key) of the runs of 1 to `joined` lines that begin in the pack, in
    the order of line_no and n_lines, with the core heading of each; those with an empty one are left out."""

    def run(i: Column, n: Column) -> Column:
        plain = F.concat(F.substr(F.get("body", i), F.get("skip", i) + 1), F.array_join(F.slice("body", i + 2, n - 1), ""))
        return F.struct(F.get("line_no", i).alias("line_no"), n.alias("n_lines"), F.coalesce(F.get(F.get("odd", i), n - 1), F.lower(plain)).alias("key"))

    each = F.transform(F.sequence(F.lit(0), F.col("begun") - 1), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(joined), F.size("body") - i)), lambda n: run(i, n)))
    return F.filter(F.flatten(each), lambda r: r["key"] != "")


def match_heading(toc: DataFrame, lines: DataFrame, least: float = 85.0, joined: int = 3) -> DataFrame:
    """(doc_id, heading, line_no, n_lines, score): where each heading (doc_id, heading) of a table of contents stands.

    Candidates are up to `joined` non-blank lines in a row (doc_id, line_no, line; give those after the table itself). Equal
    core headings come first, by an equi join on their digests, with score 100 and the first line. The other headings take the
    best indel ratio above `least`, ties to the first line and then the shorter run, each among all runs of its document: packs
    of headings meet packs of lines, and inside a pair the runs with the highest bound are compared first, until no other can
    be better. Lines and headings are each shuffled twice, and written once.
    """
    kind = lines.schema["doc_id"].dataType.simpleString()
    keyed = lambda df: contents.nfkc(df.select("doc_id", "heading", F.col("heading").alias("key")), "key").withColumn("key", contents.core_heading(F.col("key")))
    packed = linking.written(line_packs(lines.where("doc_id is not null"), joined), "line-packs")
    digest = lambda c: F.unhex(F.md5(c))
    # outer, or the keys would be worked out a second time to see that there are any
    found = packed.select("doc_id", F.explode_outer(run_keys(joined)).alias("r")).select("doc_id", digest(F.col("r.key")).alias("digest"), F.struct("r.line_no", "r.n_lines").alias("at"))
    first = found.groupBy("doc_id", "digest").agg(F.min("at").alias("at"))
    # headings go to where they are joined once, as they are: the keys of those that are left over are made again
    t = keyed(toc).where("doc_id is not null and key <> ''").select("doc_id", digest(F.col("key")).alias("digest"), "heading").repartition("doc_id", "digest").distinct()
    judged = linking.written(t.join(first, ["doc_id", "digest"], "left").select("doc_id", "heading", "at"), "headings")
    open_ = judged.where("at is null")
    sizes = open_.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).join(packed.groupBy("doc_id").agg(F.sum("begun").alias("lines")), "doc_id")
    work = sizes.agg(F.sum(F.col("n") * F.col("lines"))).first()[0] or 0
    tasks = max(1, min(work // TASK_PAIRS + 1, 2000))
    # headings of a document of several packs go to each of them
    several = packed.where("pack > 0").groupBy("doc_id").agg(F.max("pack").alias("last"))
    left = keyed(open_).join(T.small(several), "doc_id", "left").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("last", F.lit(0).cast("long")))).alias("pack"), "heading", "key")
    nth = F.row_number().over(Window.partitionBy("doc_id", "pack").orderBy("heading"))
    left = left.repartition(tasks, "doc_id", "pack").withColumn("left_no", F.floor((nth - 1) / PACK))
    left = left.groupBy("doc_id", "pack", "left_no").agg(F.collect_list(F.struct("heading", "key")).alias("h"), F.min(F.length("key")).alias("shortest"), F.max(F.length("key")).alias("longest"))
    met = left.join(packed.repartition(tasks, "doc_id", "pack"), ["doc_id", "pack"])
    # a run can only be a match if its length is like that of some heading
    like = lambda a, b: 200 * F.least(a, b) > least * (a + b)
    size = lambda r: F.length(r["key"])
    shortest, longest = F.col("shortest"), F.col("longest")
    near = F.filter(run_keys(joined), lambda r: (like(size(r), shortest) | (size(r) > shortest)) & (like(size(r), longest) | (size(r) < longest)))
    met = met.select("doc_id", "h", near.alias("r")).select("doc_id", "h.heading", "h.key", "r.line_no", "r.n_lines", F.col("r.key").alias("line_key"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, heads, keys, at, n, line_keys in zip(*(b[c] for c in ("doc_id", "heading", "key", "line_no", "n_lines", "line_key")), strict=True):
                rows += [(doc, heads[i], at[j], n[j], score) for i, j, score in most_alike(list(keys), list(line_keys), least)]
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "heading", "line_no", "n_lines", "score"])

    scored = met.mapInPandas(run, f"doc_id {kind}, heading string, line_no {lines.schema['line_no'].dataType.simpleString()}, n_lines int, score double")
    best = scored.groupBy("doc_id", "heading").agg(F.min(F.struct((-F.col("score")).alias("s"), "line_no", "n_lines")).alias("b"))
    equal = judged.where("at is not null").select("doc_id", "heading", "at.line_no", "at.n_lines", F.lit(100.0).alias("score"))
    return equal.unionByName(best.select("doc_id", "heading", "b.line_no", "b.n_lines", (-F.col("b.s")).alias("score")))


def separator(p: Column) -> Column:
    return F.when(F.contains(p, F.lit("-")), "-").when(F.contains(p, F.lit(".")), ".")


def pattern_similarity(a: Column, b: Column) -> Column:
    """1 if equal; 0 if the separator or the number of parts differs; else 0.7 * ratio of the first parts + 0.3 * share of
    equal parts among the others (1 if there are none)."""
    parts = lambda p: F.when(separator(p) == "-", F.split(p, "-")).when(separator(p) == ".", F.split(p, r"\.")).otherwise(F.array(p))
    x, y = parts(a), parts(b)
    rest = F.size(x) - 1
    same = F.size(F.filter(F.zip_with(F.slice(x, F.lit(2), rest), F.slice(y, F.lit(2), rest), lambda p, q: p == q), lambda v: v))
    share = F.when(rest > 0, same / rest).otherwise(1.0)
    differ = ~separator(a).eqNullSafe(separator(b)) | (F.size(x) != F.size(y))
    return F.when(a == b, 1.0).when(differ, 0.0).otherwise(0.7 * seq_ratio(F.get(x, F.lit(0)), F.get(y, F.lit(0))) + 0.3 * share)


def pattern_pairs(patterns: DataFrame) -> DataFrame:
    """Pairs of an organization's patterns with equal part counts that are alike enough to merge or review."""
    p = patterns.withColumn("parts", F.concat_ws("/", separator(F.col("pattern")), F.size(F.split("pattern", r"[-.]")).cast("string")))
    q = p.select("organization", "parts", F.col("pattern").alias("other"), F.col("frequency").alias("other_frequency"))
    pairs = p.join(q, ["organization", "parts"]).where(F.col("pattern") < F.col("other"))
    scored = pairs.withColumn("similarity", pattern_similarity(F.col("pattern"), F.col("other"))).where("similarity >= 0.5")
    return scored.select("organization", "pattern", "other", "similarity", (F.col("frequency") + F.col("other_frequency")).alias("frequency"), F.when(F.col("similarity") >= 0.7, "auto_merge").otherwise("needs_review").alias("action"))


def score_batch(rows: DataFrame, scorer: Callable[[str, str], float] | None = None) -> DataFrame:
    """(id, score) of prompt rows (id, a, b); by default 1.0 for equal texts, else 0.6. Answers can also come as a table."""
    score = scorer or (lambda a, b: 1.0 if (a or "").strip().lower() == (b or "").strip().lower() else 0.6)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "score": [float(score(x, y)) for x, y in zip(b["a"], b["b"], strict=True)]})

    return rows.select("id", "a", "b").mapInPandas(run, "id long, score double")


def normal_wording(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9]+", " "))


def consolidate_cuecs(cuecs: DataFrame, least: float | None = None) -> DataFrame:
    """(id, scan_id, group_id, n): groups of equal normalised wording per report, named by their smallest id, with their
    size. With `least`, groups that are linked by wordings at least that alike, over any number of links, are one group.
    Blank wordings of a report are one group and linked to nothing; rows without a report are one group per wording."""
    key = normal_wording(F.coalesce("cuec_description", F.lit("")))
    w = Window.partitionBy("scan_id", key)
    same = cuecs.select("id", "scan_id", F.min("id").over(w).alias("group_id"), F.count(F.lit(1)).over(w).alias("n"))
    if least is None:
        return same
    heads = linking.written(cuecs.where("scan_id is not null").groupBy("scan_id", key.alias("text")).agg(F.min("id").alias("group_id")).where("text <> ''"), "wordings")
    pairs = linking.alike_pairs(heads.select("scan_id", "text"), heads.select("scan_id", F.col("text").alias("matched")), "scan_id", least).where("text < matched")
    a = heads.select("scan_id", "text", F.col("group_id").alias("a"))
    b = heads.select("scan_id", F.col("text").alias("matched"), F.col("group_id").alias("b"))
    label = linking.linked_groups(pairs.join(a, ["scan_id", "text"]).join(b, ["scan_id", "matched"]).select("a", "b"))
    merged = same.join(label.select(F.col("node").alias("group_id"), "name"), "group_id", "left").select("id", "scan_id", F.coalesce("name", "group_id").alias("group_id"), "n")
    sizes = merged.groupBy("scan_id", "group_id").agg(F.count(F.lit(1)).alias("n"))
    # counted rather than windowed: a group may hold most rows of a report
    both = merged.drop("n").withColumnRenamed("scan_id", "s").withColumnRenamed("group_id", "g")
    return both.join(sizes, both["s"].eqNullSafe(sizes["scan_id"]) & (both["g"] == sizes["group_id"])).select("id", "scan_id", "group_id", "n")


def parse_model_json(s: Column, schema: str) -> Column:
    """A model's answer as a struct: as it is, out of a fenced block, out of its outer braces, or without trailing
    commas; null marks a bad chunk."""
    fenced = F.regexp_extract(s, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(s, r"(?s)(\{.*\})", 1)
    repaired = F.regexp_replace(braces, r",\s*([}\]])", "$1")
    tries = [F.when(F.try_parse_json(F.nullif(x, F.lit(""))).isNotNull(), F.from_json(x, schema)) for x in (s, fenced, braces, repaired)]
    return F.coalesce(*tries)
