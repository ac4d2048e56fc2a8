"""Quality classifier: Bradley-Terry scores learned from preference pairs, cut at a quantile of the scores.

A labelled good document is preferred to a labelled bad one; the weights minimise the logistic loss on the difference
of the two documents' features. Features are DataFrame expressions over the whole text and nothing else, so scoring is
row-local. The labelled rows used are at most MAX_LABELLED, those of the smallest id hashes.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, let, text_or_empty, words, written

MAX_LABELLED = 20_000
CUT = 0.3


def feature_columns() -> dict[str, Column]:
    """Features over _text and _w (its words); each is finite for any text, and 0 for an empty one."""
    n, size = F.greatest(F.size("_w"), F.lit(1)), F.greatest(F.length("_text"), F.lit(1))
    chars = lambda some: F.length("_text") - F.length(F.translate("_text", some, ""))
    upper = F.length("_text") - F.length(F.regexp_replace("_text", r"\p{Lu}+", ""))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    grams = lambda k: F.transform(F.sequence(F.lit(0), F.size("_w") - k), lambda i: F.xxhash64(*[F.get(F.col("_w"), i + j) for j in range(k)]))
    again = lambda k: F.when(F.size("_w") > k, let(grams(k), lambda g: 1 - F.size(F.array_distinct(g)) / F.size(g))).otherwise(0.0)
    return {
        "length": F.log1p(F.size("_w")),
        "short": F.exp(-F.size("_w") / 20.0),
        "upper": upper / size,
        "bang": chars("!?") / n,
        "marks": chars("#$%&*") / n,
        "bars": chars("|<>{}") / n,
        "digits": chars("0123456789") / size,
        "again3": again(3),
        "doubled": F.size(F.filter("_w", lambda x, i: x == F.get(F.col("_w"), i - 1))) / n,
        "distinct": F.size(F.array_distinct("_w")) / F.sqrt(n.cast("double")) / 10.0,
        "word_chars": F.length(F.translate("_text", BLANKS, "")) / n / 10.0,
        "lines_again": let(lines, lambda x: 1 - F.size(F.array_distinct(x)) / F.greatest(F.size(x), F.lit(1))) * F.when(F.size("_w") > 0, 1.0).otherwise(0.0),
        "line_words": F.log1p(n / F.greatest(F.size(lines), F.lit(1))),
    }


#: Ratios that mean junk from small values on get a saturating twin.
SATURATED = {"upper": 5.0, "bang": 3.0, "marks": 3.0, "bars": 3.0, "digits": 5.0, "again3": 5.0, "doubled": 5.0, "lines_again": 5.0}


def features(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep plus x, an array of doubles."""
    base = docs.select(*keep, text_or_empty(F.col(text)).alias("_text"), words(F.col(text)).alias("_w"))
    cols = feature_columns()
    base = base.select(*keep, *[c.cast("double").alias(f"f_{k}") for k, c in cols.items()])
    twins = [1 - F.exp(-k * F.col(f"f_{name}")) for name, k in SATURATED.items()]
    return base.select(*keep, F.array(*[F.col(f"f_{k}") for k in cols], *twins).alias("x"))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, x, y) of at most `max_labelled` labelled documents outside the held-out fold.

    Several labels of a document count by majority, ties as 1; null labels and ids are left out. A repeated doc_id trains
    with one of its rows. Empty tables give no rows; other columns do not matter.
    """
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = chosen.groupBy("doc_id").agg(F.when(F.avg("quality") >= 0.5, 1).otherwise(0).alias("y"))
    # the smallest id hashes: about as many as wanted are let through, so that no task sends more than its share of them
    share = min(1.0, 1.2 * max_labelled / max(1, chosen.count()))
    chosen = chosen.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) <= int(share * (1 << 31)))
    chosen = chosen.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)), "doc_id").limit(max_labelled)
    # at most max_labelled rows of two integers
    return features(docs.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]), keep=("doc_id", "y"))


def preference_pairs(rows: DataFrame, n_bad: int, rounds: int = 4) -> DataFrame:
    """Feature differences: each good document meets about `rounds` bad ones, by hash buckets of which there are as many
    as bad documents. Every second pair is turned round, with the label turned too."""
    bucket = lambda r: F.pmod(F.xxhash64(F.col("doc_id"), F.lit(r)), F.lit(n_bad))
    sides = [F.explode(F.array(*[F.struct(F.lit(r).alias("r"), bucket(r + shift).alias("b")) for r in range(rounds)])).alias("k") for shift in (0, 1000)]
    good = rows.where("y = 1").select("x", "doc_id", sides[0])
    bad = rows.where("y = 0").select(F.col("x").alias("z"), sides[1])
    pairs = good.join(bad, "k")
    sign = F.when(F.xxhash64("doc_id", "k") % 2 == 0, 1.0).otherwise(-1.0)
    return pairs.select(F.transform(F.arrays_zip("x", "z"), lambda p: (p["x"] - p["z"]) * sign).alias("d"), F.when(sign > 0, 1.0).otherwise(0.0).alias("label"))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> dict:
    """Weights, threshold (a quantile of the training scores) and that quantile.

    The quantile is the one of a fixed grid that best parts the labelled rows by balanced accuracy. Without documents of
    both labels there is nothing to learn: weights 0, so that every document scores the cut itself and is predicted 1.
    """
    rows = written(training_rows(docs.select("doc_id", "text"), labels.select("doc_id", "quality"), max_labelled), "labelled")
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return {"weights": [], "threshold": 0.0, "quantile": 0.0}
    pairs = preference_pairs(rows, n[0]).select(array_to_vector("d").alias("features"), "label")
    pairs = written(pairs, "pairs")
    if pairs.select("label").distinct().count() < 2:
        return {"weights": [], "threshold": 0.0, "quantile": 0.0}
    model = LogisticRegression(fitIntercept=False, regParam=1e-4, maxIter=60).fit(pairs)
    weights = [float(w) for w in model.coefficients]
    scored = rows.select("y", raw_score(weights).alias("s"))
    grid = [q / 400 for q in range(1, 400)]
    cuts = scored.agg(F.percentile_approx("s", grid, 10_000)).first()[0]
    hits = scored.agg(*[F.sum(((F.col("s") < c) & (F.col("y") == 0)).cast("int") / n[0] + ((F.col("s") >= c) & (F.col("y") == 1)).cast("int") / n[1]).alias(f"h{k}") for k, c in enumerate(cuts)]).first()
    best = max(range(len(cuts)), key=lambda k: (hits[k], -k))
    above = scored.where(F.col("s") >= cuts[best]).agg(F.min("s")).first()[0]
    under = scored.where(F.col("s") < cuts[best]).agg(F.max("s")).first()[0]
    threshold = cuts[best] if under is None else (above + under) / 2
    return {"weights": weights, "threshold": float(threshold), "quantile": grid[best]}


def raw_score(weights: list[float]) -> Column:
    total = F.lit(0.0)
    for k, w in enumerate(weights):
        total = total + F.lit(w) * F.get("x", F.lit(k))
    return total


def score(docs: DataFrame, model: dict, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep plus score in 0..1; the model's threshold lands on CUT, just above in rounding.

    Null texts score as empty ones, each repeated row alike; an empty table stays empty. `keep` columns must not be named
    x, score, _text, _w or f_ and a feature.
    """
    shift = math.log(CUT / (1 - CUT)) + 1e-9
    z = raw_score(model["weights"]) - F.lit(model["threshold"]) + F.lit(shift)
    return features(docs, text, keep).select(*keep, (1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))).alias("score"))


def predicted(column: str = "score") -> Column:
    return (F.col(column) >= CUT).cast("int")
