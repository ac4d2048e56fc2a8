"""Near copies without comparing all pairs: a lossless index of character grams, and groups of linked rows.

Two texts of Ratcliff-Obershelp ratio t or more have M = t * (la + lb) / 2 characters or more in matching blocks, and at
most la + lb - 2 M + 1 blocks, so they share at least M - (q - 1) * blocks grams of q characters. Each text therefore offers
its rarest grams only, just so many that a pair that reaches the bound must meet in one of them (prefix filter). Pairs so
short that the bound says nothing meet in single characters, of which they share M. Grams are numbered by occurrence, so
that repeated ones count.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.functions.similarity import alike
from reportlake.sources.files import scratch

#: Frequent grams that are put last; the order only decides how many pairs are looked at.
COMMON = 4096


def written(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def apart(packs: DataFrame, *keys: str) -> DataFrame:
    """Pairs of packs, written and dealt to as many tasks as there are pairs, up to 2,000. Packs are few bytes and much work, so
    Spark would put very many into one task if it were left to choose the number by size."""
    held = written(packs, "packs")
    return held.repartition(max(1, min(held.count(), 2000)), *keys)


def gram_size(least: float) -> int:
    return 3 if least >= 0.9 else 2 if least >= 0.72 else 1


def shared_grams(la: int, lb: int, q: int, least: float) -> int:
    """Grams that texts of these lengths share at least if their ratio is `least` or more; may be below 1."""
    m = math.ceil(least * (la + lb) / 2 - 1e-9)
    return m - (q - 1) * (la + lb - 2 * m + 1)


def grams(x: str, q: int) -> list[int]:
    """Signed 64-bit hashes of the grams of x and their number of occurrence."""
    seen: Counter = Counter()
    out = []
    for k in range(len(x) - q + 1):
        g = x[k : k + q]
        seen[g] += 1
        h = xxhash.xxh64_intdigest(g.encode("utf-8", "surrogatepass"), seed=q << 32 | seen[g])
        out.append(h - (1 << 64) if h >> 63 else h)
    return out


@lru_cache(maxsize=4096)
def prefixes(la: int, q: int, least: float) -> tuple[int | None, int | None]:
    """Of a text of this length: how many grams of q, and of 1, a pair needs to share at least, over all lengths of the other
    text; None if no pair is found by them. Rounding makes the needs rise and fall with the other length, so each is looked at."""
    low, high = math.ceil(la * least / (2 - least) - 1e-9), math.floor(la * (2 - least) / least + 1e-9)
    needs = [(shared_grams(la, lb, q, least), shared_grams(la, lb, 1, least)) for lb in range(low, high + 1)]
    long = [n for n, _ in needs if n >= 1 and q > 1]
    short = [one for n, one in needs if n < 1 or q == 1]
    return min(long, default=None), min(short, default=None)


def offered(x: str, q: int, least: float, common: dict[int, int]) -> list[int]:
    """The grams by which x can be found, rarest first."""
    out = []
    for size, need in zip((q, 1), prefixes(len(x), q, least), strict=True):
        if need is not None:
            own = sorted(grams(x, size), key=lambda g: (common.get(g, 0), g))
            out += own[: len(own) - max(1, need) + 1]
    return out


def alike_pairs(left: DataFrame, right: DataFrame, key: str, least: float) -> DataFrame:
    """(key, text, matched, sim): all pairs with an equal key and a ratio of at least `least` (over 0).

    left: key, text; right: key, matched. Null keys and blank texts have no pairs; repeated rows give one. A gram that very
    many texts of one report offer is a key of a join, which Spark splits; each pair is worked out once.
    """
    q = gram_size(least)
    kind = left.schema[key].dataType.simpleString()

    def named(df: DataFrame, column: str) -> DataFrame:
        return written(df.select(key, F.col(column).alias("x")).where(F.col(key).isNotNull() & (F.trim("x") != "")).distinct().withColumn("no", F.monotonically_increasing_id()), "texts")

    def exploded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = [(g,) for x in b["x"] for g in grams(x.strip().lower(), q) + (grams(x.strip().lower(), 1) if q > 1 else [])]
            yield pd.DataFrame(own, columns=["gram"])

    a, b = named(left, "text"), named(right, "matched")
    counts = a.select("x").unionByName(b.select("x")).mapInPandas(exploded, "gram long").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    common = {r["gram"]: r["n"] for r in counts.orderBy(F.desc("n"), "gram").limit(COMMON).collect()}

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, no, len(s), g) for k, no, s in zip(batch[key], batch["no"], (x.strip().lower() for x in batch["x"]), strict=True) for g in offered(s, q, least, common)]
            yield pd.DataFrame(rows, columns=[key, "no", "size", "gram"])

    postings = lambda d: d.mapInPandas(index, f"{key} {kind}, no long, size long, gram long")
    p = postings(a).withColumnRenamed("no", "i").withColumnRenamed("size", "la")
    r = postings(b).withColumnRenamed("no", "j").withColumnRenamed("size", "lb")
    near = 2 * F.least("la", "lb") >= F.lit(least - 1e-9) * (F.col("la") + F.col("lb"))
    met = p.join(r, [key, "gram"]).where(near).select("i", "j").distinct()

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for x, own in batch.groupby("text", sort=False):
                others = own["matched"].tolist()
                out += [(own[key].iloc[k], x, others[k], sim) for _, k, sim in alike([x], others, least)]
            yield pd.DataFrame(out, columns=[key, "text", "matched", "sim"])

    both = met.join(a.select(F.col("no").alias("i"), key, F.col("x").alias("text")), "i").join(b.select(F.col("no").alias("j"), F.col("x").alias("matched")), "j")
    return both.select(key, "text", "matched").mapInPandas(judged, f"{key} {kind}, text string, matched string, sim double")


def linked_groups(links: DataFrame) -> DataFrame:
    """(node, name) of all nodes of links (a, b): the smallest node that can be reached.

    A node takes the least name among its neighbours, the node it was named by learns of that, too (hooking), and then each
    takes its name's name (jumping), until nothing changes: the rounds grow with the logarithm of a group's diameter, and
    there is no bound of them. Each round is a written table, so a lost executor costs a stage.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = written(both, "links")
    names = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("name")), "names")
    while True:
        heard = both.join(names.select(F.col("node").alias("b"), "name"), "b").groupBy(F.col("a").alias("node")).agg(F.min("name").alias("heard"))
        taken = names.join(heard, "node").select("node", F.col("name").alias("old"), F.least("name", "heard").alias("own"))
        told = taken.groupBy(F.col("old").alias("node")).agg(F.min("own").alias("told"))
        hooked = written(taken.join(told, "node", "left").select("node", "old", F.least("own", F.coalesce("told", "own")).alias("own")), "hooked")
        over = hooked.select(F.col("node").alias("own"), F.col("own").alias("further"))
        moved = written(hooked.join(over, "own", "left").select("node", "old", F.coalesce("further", "own").alias("name")), "names")
        names = moved.select("node", "name")
        if moved.where("name < old").isEmpty():
            return names
