"""Temperature mixing of sources, realised as budgeted block permutations.

Source token shares p are exponentiated, w = p^t / sum(p^t); the exponent t is bisected to the largest one whose entropy
meets the target, then raised if the repetition limit asks for it. A source with T tokens gets r*T tokens: floor(r)
whole passes, each in a permutation of its own, and of the next permutation the documents up to the rest of the budget.
Where a permutation is cut is found by blocks of it (prefixes of the permutation key): sums per block first, then the
documents of the one block in which the budget ends.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import words, written

BROADCAST_SOURCES = 100_000
BLOCK_DOCS = 4096


def source_key(source: Column) -> Column:
    """Null sources form one source of their own."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def permutation_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def bisected_exponent(sources: DataFrame, entropy_share: float | None, max_repeats: float | None, rounds: int = 5, fan: int = 24) -> tuple[float, dict]:
    """(t, totals of the sources). Each round evaluates `fan` exponents in one aggregate and keeps the bracket around
    the target; only these sums reach the driver, however many sources there are.

    Sources without tokens take no part. Totals hold k sources, their sum, least and most tokens.
    """
    live = sources.where("tokens > 0")
    r = live.agg(F.count(F.lit(1)).alias("k"), F.sum("tokens").alias("total"), F.min("tokens").alias("least"), F.max("tokens").alias("most")).first()
    totals = r.asDict()
    if not r["k"] or r["k"] == 1:
        return 1.0, totals
    log_p = F.log(F.col("tokens") / F.lit(float(r["total"])))
    low, high = 0.0, 1.0
    if entropy_share is not None:
        goal = entropy_share * math.log(r["k"])
        for _ in range(rounds):
            at = [low + (high - low) * (i + 1) / (fan + 1) for i in range(fan)]
            cols = [c for i, t in enumerate(at) for c in (F.sum(F.exp(t * log_p)).alias(f"z{i}"), F.sum(F.exp(t * log_p) * log_p).alias(f"s{i}"))]
            s = live.agg(*cols).first()
            flat = [math.log(s[f"z{i}"]) - t * s[f"s{i}"] / s[f"z{i}"] >= goal for i, t in enumerate(at)]
            met = sum(flat)  # entropy falls as t grows, so these come first
            low, high = ([low] + at)[met], (at + [high])[met]
        exponent = low
    else:
        exponent = 0.0 if max_repeats is not None else 1.0
    if max_repeats is not None and r["most"] > r["least"]:
        exponent = max(exponent, 1 - math.log(max_repeats) / math.log(r["most"] / r["least"]))
    return exponent, totals


def mixing_plan(counted: DataFrame, entropy_share: float | None = 0.95, max_repeats: float | None = 2.0, seed: int = 0) -> DataFrame:
    """One row per source: _src, tokens, n_docs, weight, repeats, epochs (whole passes), rest (tokens of the last,
    partial pass) and cut_key (the last permutation key inside it, null: none).

    counted: _src, doc_id, n_tokens. The total budget is the least that gives the largest source one whole pass, so no
    document is lost; repeats = (largest / own tokens)^(1 - t). Sources without tokens pass once.
    """
    sources = written(counted.groupBy("_src").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs")), "sources")
    t, totals = bisected_exponent(sources, entropy_share, max_repeats)
    most = float(totals["most"] or 1)
    relative = F.pow(F.col("tokens") / most, F.lit(t))
    norm = sources.where("tokens > 0").agg(F.sum(relative)).first()[0] or 1.0
    repeats = F.when(F.col("tokens") > 0, F.pow(most / F.col("tokens"), F.lit(1 - t))).otherwise(1.0)
    plan = sources.withColumn("weight", F.when(F.col("tokens") > 0, relative / norm).otherwise(0.0)).withColumn("repeats", F.round(repeats, 9))
    plan = plan.withColumn("epochs", F.floor("repeats")).withColumn("rest", F.round((F.col("repeats") - F.col("epochs")) * F.col("tokens")).cast("long"))
    plan = plan.withColumn("_digits", F.ceil(F.log(16.0, F.greatest(F.col("n_docs") / BLOCK_DOCS, F.lit(1.0)))).cast("int"))
    keyed = with_plan(counted, plan.where("rest > 0"), "inner", totals["k"] or 0)
    keyed = keyed.select("_src", "n_tokens", "rest", permutation_key(seed, F.col("epochs"), F.col("doc_id")).alias("_key"), F.col("_digits"))
    keyed = keyed.withColumn("_block", F.substring(F.col("_key"), F.lit(1), F.col("_digits")))
    blocks = keyed.groupBy("_src", "_block").agg(F.sum("n_tokens").alias("_n"), F.first("rest").alias("rest"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_src").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = blocks.withColumn("_before", before).where((F.col("_before") < F.col("rest")) & (F.col("_before") + F.col("_n") >= F.col("rest")))
    ends = ends.select("_src", "_block", "_before").withColumnRenamed("_src", "_s2").withColumnRenamed("_block", "_b2")
    last = keyed.join(ends, (F.col("_src") == F.col("_s2")) & (F.col("_block") == F.col("_b2")))
    ahead = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("_src", "_block").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = last.withColumn("_ahead", F.col("_before") + ahead).where("_ahead < rest").groupBy(F.col("_src").alias("_s3")).agg(F.max("_key").alias("cut_key"))
    return plan.join(cuts, F.col("_src") == F.col("_s3"), "left").select("_src", "tokens", "n_docs", "weight", "repeats", "epochs", "rest", "cut_key", "_digits")


def with_plan(docs: DataFrame, plan: DataFrame, how: str, n_sources: int) -> DataFrame:
    """docs with their source's plan, broadcast only if it is known to be small."""
    return docs.join(F.broadcast(plan) if n_sources <= BROADCAST_SOURCES else plan, "_src", how)


def mix(docs: DataFrame, entropy_share: float | None = 0.95, max_repeats: float | None = 2.0, seed: int = 0, source: str = "source", text: str = "text") -> DataFrame:
    """docs, each row as often as the mixture takes it, with _epoch (from 0), _mix_key (sorts an epoch of a source into
    its permutation) and _n_tokens (words). Equal doc_ids share a key and are taken together; null texts have no tokens,
    null sources are one source; an empty table stays empty. Columns named _epoch, _mix_key, _n_tokens, _src or _plan are
    replaced or dropped, all others stay. Documents are not shuffled unless there are very many sources.
    """
    counted = written(docs.select(source_key(F.col(source)).alias("_src"), "doc_id", F.size(words(F.col(text))).cast("long").alias("n_tokens")), "mix-counts")
    plan = written(mixing_plan(counted, entropy_share, max_repeats, seed), "mix-plan")
    n_sources = plan.count()
    plan = plan.select("_src", F.struct("epochs", "cut_key").alias("_plan"))
    own = docs.drop("_plan").withColumn("_src", source_key(F.col(source))).withColumn("_n_tokens", F.size(words(F.col(text))).cast("long"))
    rows = with_plan(own, plan, "left", n_sources)
    extra = F.coalesce(permutation_key(seed, F.col("_plan.epochs"), F.col("doc_id")) <= F.col("_plan.cut_key"), F.lit(False))
    passes = F.sequence(F.lit(0).cast("long"), F.col("_plan.epochs") - 1 + extra.cast("long"))
    out = rows.withColumn("_epoch", F.explode(passes))
    return out.withColumn("_mix_key", permutation_key(seed, F.col("_epoch"), F.col("doc_id"))).drop("_src", "_plan")
