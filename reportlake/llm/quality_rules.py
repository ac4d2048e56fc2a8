"""Host-level quality rules in DataFrame functions only.

Each document gets its rule counts in one pass over its own row. Rule failures are summed by host; each host's failure
rate is shrunk towards the corpus by a beta prior fitted to the hosts themselves; the verdict on a host is joined back
to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, let, text_or_empty, words, written

SYMBOLS = "#*$%&|<>"
WINDOW = 5


def repeated_words(w: Column, n: Column) -> Column:
    """Words inside 5-word windows found twice or more in the text, first occurrence included.

    Window hashes decide the common case (all different); only otherwise are the windows themselves sorted, so equal
    hashes of different windows cannot change the count.
    """
    starts = F.sequence(F.lit(0), n - F.lit(WINDOW))
    at = lambda i: [F.get(w, i + k) for k in range(WINDOW)]

    def covered(s: Column) -> Column:
        twins = F.filter(s, lambda x, k: (F.get(s, k - 1)["g"] == x["g"]) | F.coalesce(F.get(s, k + 1)["g"] == x["g"], F.lit(False)))
        first = lambda p: F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.get(p, k + 1) - x))
        return let(
            F.sort_array(F.transform(twins, lambda x: x["i"])),
            lambda p: F.aggregate(first(p), F.lit(0).cast("long"), lambda a, x: a + x),
        )

    exact = let(F.sort_array(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", *at(i)).alias("g"), i.alias("i")))), covered)
    counted = let(F.transform(starts, lambda i: F.xxhash64(*at(i))), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(exact))
    return F.when(n <= WINDOW, F.lit(0).cast("long")).otherwise(counted)


def rule_counts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """One row per document: `keep`, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    A null text counts as empty. Other columns are dropped, so clashing names do no harm.
    """
    body = text_or_empty(F.col(text))
    split = docs.select(*keep, body.alias("_text"), words(F.col(text)).alias("_words"))
    n = F.size("_words")
    lines = F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    counts = split.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(F.translate("_text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words"), n).alias("n_repeat_words"),
    )
    return counts.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """(alpha, beta) by the method of moments over hosts with n documents of which f failed.

    The spread of the rates beyond binomial noise gives the prior's weight; where there is none (or one host only), the
    weight is at its upper limit; no documents at all: the flat prior (1, 1). One row reaches the driver.
    """
    r = hosts.agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("f").alias("f"),
        F.sum(F.col("n") * F.col("n")).cast("double").alias("nn"), F.sum(F.col("f") * F.col("f") / F.col("n")).alias("ff"),
    ).first()
    if not r["n"]:
        return 1.0, 1.0
    mean = min(max(r["f"] / r["n"], 1e-6), 1 - 1e-6)
    noise = mean * (1 - mean)
    spread = r["ff"] - r["f"] * r["f"] / r["n"]
    room = noise * (r["n"] - r["nn"] / r["n"] - (r["k"] - 1))
    rho = (spread - (r["k"] - 1) * noise) / room if room > 0 else 0.0
    weight = 1 / min(max(rho, 1e-4), 0.5) - 1
    return mean * weight, (1 - mean) * weight


def host_verdicts(counts: DataFrame, host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """One row per host: n, f, its shrunk failure rate and host_failed (rate above max_rate)."""
    hosts = counts.groupBy(host).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("f"))
    a, b = beta_prior(hosts)
    rate = (F.col("f") + F.lit(a)) / (F.col("n") + F.lit(a + b))
    return hosts.withColumn("host_rate", rate).withColumn("host_failed", rate > max_rate)


def quality_rules(docs: DataFrame, host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """Rule counts, base_failed, host_failed and kept per document.

    Null hosts form one host of their own. Repeated rows are each judged and returned. An empty table gives an empty
    result. The counts are written once and read for both the host sums and the join, so texts are scanned once. The
    join is a plain equi join on the host: Spark broadcasts the host table when its measured size allows and splits a
    hot host's rows otherwise.
    """
    counts = written(rule_counts(docs, keep=("doc_id", host)).withColumn("_host", F.coalesce(F.concat(F.lit("h"), F.col(host)), F.lit("n"))), "rules")
    hosts = host_verdicts(counts, "_host", max_rate).select("_host", "host_failed")
    joined = counts.join(hosts, "_host", "left").drop("_host")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False)))
