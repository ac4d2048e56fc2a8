"""Jaccard self-join of documents on word shingles (4 words unless told otherwise), with a count-vector R-tree.

A document's set is its distinct shingles, as 64-bit hashes. Documents with equal sets are one class. Two sets of
Jaccard t or more share a shingle among the first n - ceil(t*n) + 1 of each in any fixed order, which routes every
possible pair into a bucket; the order puts shingles that very many documents hold last (they are counted over all
documents, and order alone depends on the counts). Inside buckets, shingles are hashed into GROUPS groups; a set's group
counts are a point, points are packed into trees of bounding boxes, and the overlap of two sets, or of any two below two
boxes, is at most the sum of the coordinates' minima. Pairs that survive are verified on the sets themselves.

Where only components are asked for, a pair whose sides are already connected need not be looked at: first each class meets
the most central class of each of its buckets, and then, bucket by bucket, only classes of different components meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import most_frequent, text_or_empty, written
from .components import components
from .substring_dedup import WordHashes

SHINGLE, GROUPS, LEAF, FAN, BLOCK = 4, 256, 32, 8, 1024
#: A sketch has 2^SKETCH to 2^(SKETCH + 1) bits for each shingle, a sixteenth of the set's size or less.
SKETCH = 1
HEAVY_LIMIT = 200_000
BROADCAST_IDS = 1_000_000
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(text: str, hashes: WordHashes, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes; A-Z are lower-cased; a text of fewer words is one shingle, a blank one none."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, U)
    h = np.fromiter(map(hashes.__getitem__, words), U, len(words))
    wide = min(width, len(h))
    g = np.full(len(h) - wide + 1, wide, U)
    for k in range(wide):
        g *= U(0x9E3779B97F4A7C15)
        g += h[k : k + len(g)]
    return np.unique(mixed(g))


def group_counts(s: np.ndarray) -> bytes:
    """Shingles per group, a byte each; 255 stands for 255 or more."""
    return np.minimum(np.bincount((s >> U(56)).astype(np.int64), minlength=GROUPS), 255).astype(np.uint8).tobytes()


class Naming(NamedTuple):
    """How sets and classes are named: shingle width, bits of the first hash of a set, and the first hashes that belong to
    unlike sets, whose classes go by the second hash."""

    width: int = SHINGLE
    bits: int = 64
    shared: frozenset[int] = frozenset()


def class_hashes(s: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """Two independent numbers for a whole set; of the first only so many bits."""
    with np.errstate(over="ignore"):
        first = mixed(np.array([np.sum(mixed(s)) * U(3) + np.bitwise_xor.reduce(mixed(s + U(1))) + U(len(s))], U))
        second = mixed(np.array([np.sum(mixed(s + U(2))) * U(5) + np.bitwise_xor.reduce(mixed(s + U(3))) + U(len(s))], U))
    return int((first >> U(64 - bits)).view(np.int64)[0]), int(second.view(np.int64)[0])


def class_name(s: np.ndarray, naming: Naming) -> int:
    first, second = class_hashes(s, naming.bits)
    return second if first in naming.shared else first


def row_key(text: str = "text") -> Column:
    """One name for all rows of equal id and text, null ids included: the id and 96 bits of hashes of the text."""
    body = text_or_empty(F.col(text))
    return F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.xxhash64(body).cast("string"), F.hash(body).cast("string"))


def classified(docs: DataFrame, naming: Naming) -> tuple[DataFrame, DataFrame, Naming]:
    """((doc_id, key, cls, n, counts) per row of docs, the shingles that come last in the order, the naming with the first
    hashes of unlike sets filled in: a handful among billions of sets). docs: doc_id, key, text.

    Tasks count shingles batch by batch and pass on those found twice or more and in a five-hundredth of the batch;
    the most frequent after summing, about HEAVY_LIMIT at most, are the heavy ones. That bounds what is broadcast.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            sets = [shingles(t, hashes, naming.width) for t in b["text"]]
            n = [len(s) for s in sets]
            names = [class_hashes(s, naming.bits) if len(s) else (None, None) for s in sets]
            yield pd.DataFrame({"kind": 0, "doc_id": b["doc_id"].astype("Int64"), "key": b["key"], "cls": pd.array([x[0] for x in names], "Int64"), "cls2": pd.array([x[1] for x in names], "Int64"), "n": n, "counts": [group_counts(s) for s in sets]})
            seen, count = np.unique(np.concatenate([*sets, np.empty(0, U)]), return_counts=True)
            often = count >= max(2, len(b) // 500)
            yield pd.DataFrame({"kind": 1, "doc_id": pd.array([None] * int(often.sum()), "Int64"), "key": None, "cls": pd.array(seen[often].view(np.int64), "Int64"), "cls2": pd.array([None] * int(often.sum()), "Int64"), "n": count[often], "counts": None})

    both = written(docs.select("doc_id", "key", "text").mapInPandas(run, "kind int, doc_id long, key string, cls long, cls2 long, n long, counts binary"), "classes")
    rows = both.where("kind = 0").select("doc_id", "key", "cls", "cls2", "n", "counts")
    unlike = rows.where("cls is not null").groupBy("cls").agg(F.min("cls2").alias("lo"), F.max("cls2").alias("hi")).where("lo <> hi")
    naming = naming._replace(shared=frozenset(r["cls"] for r in unlike.select("cls").collect()))
    rows = rows.withColumn("cls", F.when(F.col("cls").isin(*naming.shared), F.col("cls2")).otherwise(F.col("cls")) if naming.shared else F.col("cls")).drop("cls2")
    total = rows.count()
    heavy = both.where("kind = 1").groupBy("cls").agg(F.sum("n").alias("n")).where(F.col("n") >= max(8, total // 2000))
    return rows, most_frequent(heavy, "cls", HEAVY_LIMIT).select("cls"), naming


def prefix_length(n: int, percent: int) -> int:
    return n + (-percent * n // 100) + 1


def prefixes(docs: DataFrame, heavy: np.ndarray, percent: int, naming: Naming) -> DataFrame:
    """(shingle, cls) of each document's prefix. heavy: sorted hashes, at most HEAVY_LIMIT."""
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, last = WordHashes(), shared.value
        for b in batches:
            keys, out = [], []
            for t in b["text"]:
                s = shingles(t, hashes, naming.width)
                if not len(s):
                    continue
                p = prefix_length(len(s), percent)
                if len(last):
                    at = np.minimum(np.searchsorted(last, s), len(last) - 1)
                    common = last[at] == s
                    first = s[~common][:p]
                    if len(first) < p:
                        first = np.concatenate([first, s[common][: p - len(first)]])
                else:
                    first = s[:p]
                keys.append(class_name(s, naming))
                out.append(first)
            yield pd.DataFrame({"shingle": np.concatenate([*out, np.empty(0, U)]).view(np.int64), "cls": np.repeat(np.array(keys, np.int64), [len(x) for x in out])})

    return docs.select("text").mapInPandas(run, "shingle long, cls long")


def sketch(s: np.ndarray) -> bytes:
    """A bit for each of some ranges of hashes, two to four times as many as shingles; set where s has one."""
    bits = max(3, int(max(len(s), 1) - 1).bit_length()) + SKETCH
    held = np.zeros(1 << bits, bool)
    held[(s >> U(64 - bits)).astype(np.int64)] = True
    return np.packbits(held).tobytes()


def shared_at_most(x: bytes, y: bytes, nx: int, ny: int) -> int:
    """Bound of the overlap of sets with these sketches and sizes: a range that only one of them has is a shingle that the
    other lacks."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    size = min(len(a), len(b))
    a, b = (np.packbits(np.unpackbits(z).reshape(8 * size, -1).any(1)) for z in (a, b))
    return min(nx - int(np.bitwise_count(a & ~b).sum()), ny - int(np.bitwise_count(b & ~a).sum()))


def loaded(docs: DataFrame, wanted: DataFrame, classes: DataFrame, naming: Naming, form) -> DataFrame:
    """(cls, items) of the wanted classes; items: the sorted set of the class's smallest document, or its form(set). Few ids
    (counted) are broadcast, so that texts are not shuffled; many are joined. Classes without any id are found by their row's
    key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            out = []
            for cls, text in zip(b["cls"].tolist(), b["text"], strict=True):
                s = shingles(text, hashes, naming.width)
                if len(s) and class_name(s, naming) == cls:  # a repeated id may bring another text
                    out.append((cls, form(s)))
            yield pd.DataFrame(out, columns=["cls", "items"])

    ids = written(classes.join(wanted, "cls", "left_semi").select(F.col("rep").alias("doc_id"), F.col("rep_key").alias("key"), "cls"), "wanted")

    def met(rows: DataFrame, ids: DataFrame, on: str) -> DataFrame:
        few = ids.count() <= BROADCAST_IDS
        return rows.join(F.broadcast(ids) if few else ids, on).select("cls", "text").mapInPandas(run, "cls long, items binary")

    found = met(docs, ids.where("doc_id is not null").select("doc_id", "cls"), "doc_id")
    nameless = ids.where("doc_id is null").select("key", "cls")
    if nameless.isEmpty():
        return found
    # copies share a key, and one of them is enough
    return found.unionByName(met(docs.where("doc_id is null"), nameless, "key").groupBy("cls").agg(F.first("items").alias("items")))


def needed(na: np.ndarray | int, nb: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The least overlap of sets of these sizes at the threshold."""
    return -(-percent * (na + nb) // (100 + percent))


class CountTree:
    """Points of group counts, packed by size; each node has a box (largest counts), least and largest set size, and
    the one component of its points, if it is one."""

    def __init__(self, n: np.ndarray, points: np.ndarray, comp: np.ndarray):
        self.order = np.lexsort((points[:, 0], n))
        self.n, self.points, self.comp = n[self.order], points[self.order], comp[self.order]
        self.levels = []
        size = LEAF
        spans = [(a, min(a + size, len(n))) for a in range(0, len(n), size)]
        self.levels.append([self._node(a, b) for a, b in spans])
        while len(self.levels[-1]) > 1:
            low = self.levels[-1]
            self.levels.append([self._node(low[a][0], low[min(a + FAN, len(low)) - 1][1]) for a in range(0, len(low), FAN)])

    def _node(self, a: int, b: int) -> tuple:
        one = self.comp[a] if (self.comp[a:b] == self.comp[a]).all() else None
        return a, b, self.points[a:b].max(0), int(self.n[a:b].min()), int(self.n[a:b].max()), one


def surviving(left: CountTree, right: CountTree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (of the trees' input) of different components whose bound reaches the needed overlap."""
    stack = [(len(left.levels) - 1, i, len(right.levels) - 1, j) for i in range(len(left.levels[-1])) for j in range(len(right.levels[-1]))]
    while stack:
        la, i, lb, j = stack.pop()
        a0, a1, abox, alow, ahigh, acomp = left.levels[la][i]
        b0, b1, bbox, blow, bhigh, bcomp = right.levels[lb][j]
        if left is right and b1 <= a0:
            continue
        if (acomp is not None and acomp == bcomp) or 100 * ahigh < percent * blow or 100 * bhigh < percent * alow or np.minimum(abox, bbox).sum() < needed(alow, blow, percent):
            continue
        if la or lb:
            down_a = range(i * FAN, min((i + 1) * FAN, len(left.levels[la - 1]))) if la >= lb else None
            if down_a is not None:
                stack += [(la - 1, x, lb, j) for x in down_a]
            else:
                stack += [(la, i, lb - 1, y) for y in range(j * FAN, min((j + 1) * FAN, len(right.levels[lb - 1])))]
            continue
        bound = np.minimum(left.points[a0:a1, None, :], right.points[None, b0:b1, :]).sum(2)
        fits = (bound >= needed(left.n[a0:a1, None], right.n[None, b0:b1], percent)) & (left.comp[a0:a1, None] != right.comp[None, b0:b1])
        x, y = np.nonzero(fits)
        yield left.order[a0 + x], right.order[b0 + y]


def points_of(counts: pd.Series) -> np.ndarray:
    """A full byte may stand for any larger count, so it counts as one that no bound can rule out."""
    m = np.frombuffer(b"".join(counts), np.uint8).reshape(-1, GROUPS).astype(np.int32)
    m[m == 255] = 1 << 20
    return m


def tree_join(percent: int):
    """Pairs of a bucket's (pair of) blocks that the trees cannot rule out, for rows sorted by bucket and blocks.

    A bucket that fits one leaf is compared as that leaf, many buckets in one go; larger ones are joined as trees. At
    most one bucket's pair of blocks and a batch are held.
    """

    def small(b: pd.DataFrame, bucket: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        points, n, comp, ids = points_of(b["counts"]), b["n"].to_numpy(), b["comp"].to_numpy(), b["cls"].to_numpy()
        for d in range(1, LEAF):
            i = np.flatnonzero(bucket[:-d] == bucket[d:])
            if not len(i):
                return
            j = i + d
            fits = (comp[i] != comp[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
            i, j = i[fits], j[fits]
            fits = np.minimum(points[i], points[j]).sum(1) >= needed(n[i], n[j], percent)
            yield ids[i[fits]], ids[j[fits]]

    def large(b: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sides = [b[b["side"] != 1], b[b["side"] != 0]]
        if not len(sides[0]) or not len(sides[1]):
            return
        alone = bool((b["side"] == 2).all())
        trees = [CountTree(s["n"].to_numpy(), points_of(s["counts"]), s["comp"].to_numpy()) for s in (sides[:1] if alone else sides)]
        for x, y in surviving(trees[0], trees[-1], percent):
            yield sides[0]["cls"].to_numpy()[x], sides[1]["cls"].to_numpy()[y]

    def pairs(b: pd.DataFrame) -> pd.DataFrame:
        """Of whole buckets."""
        key = b["shingle"].to_numpy(), b["b1"].to_numpy(), b["b2"].to_numpy()
        new = np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in key])]
        bucket = np.cumsum(new)
        fits = (np.bincount(bucket)[bucket] <= LEAF) & (b["side"].to_numpy() == 2)
        out = list(small(b[fits], bucket[fits]))
        for which in np.unique(bucket[~fits]):
            out += large(b[bucket == which])
        a = np.concatenate([np.minimum(x, y) for x, y in out] + [np.empty(0, np.int64)])
        z = np.concatenate([np.maximum(x, y) for x, y in out] + [np.empty(0, np.int64)])
        return pd.DataFrame({"a": a, "b": z}).drop_duplicates()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last = None
        for b in batches:
            if not len(b):
                continue
            keys = list(zip(b["shingle"], b["b1"], b["b2"], strict=True))
            cut = next((k for k in range(len(keys) - 1, -1, -1) if keys[k] != keys[-1]), -1) + 1
            if cut == 0 and (last is None or keys[0] == last):
                held.append(b)
            else:
                if cut == 0:
                    yield pairs(pd.concat(held, ignore_index=True))
                    held = [b]
                else:
                    yield pairs(pd.concat([*held, b.iloc[:cut]], ignore_index=True))
                    held = [b.iloc[cut:]]
            last = keys[-1]
        if held:
            yield pairs(pd.concat(held, ignore_index=True))

    return run


def bounded_pairs(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose summed minima reach the needed overlap."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                bound = np.minimum(points_of(b["ca"]), points_of(b["cb"])).sum(1)
                b = b[bound >= needed(b["na"].to_numpy(), b["nb"].to_numpy(), percent)]
            yield b[["a", "b"]]

    side = lambda k: points.select(F.col("cls").alias(k), F.col("n").alias(f"n{k}"), F.col("counts").alias(f"c{k}"))
    sized = pairs.join(points.select(F.col("cls").alias("a"), F.col("n").alias("_x")), "a").join(points.select(F.col("cls").alias("b"), F.col("n").alias("_y")), "b")
    sized = sized.where(100 * F.least("_x", "_y") >= percent * F.greatest("_x", "_y")).select("a", "b")
    return sized.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ca", "cb").mapInPandas(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, percent: int, naming: Naming) -> DataFrame:
    """The pairs whose sets really reach the threshold. What travels pair by pair first is a sketch, a fraction of a set; only
    sets of pairs that it cannot rule out follow."""

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            good = [shared_at_most(x, y, nx, ny) >= needed(nx, ny, percent) for x, y, nx, ny in zip(b["ia"], b["ib"], b["na"].tolist(), b["nb"].tolist(), strict=True)]
            yield b.loc[np.array(good, bool), ["a", "b"]] if len(b) else b[["a", "b"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            good = []
            for x, y in zip(b["ia"], b["ib"], strict=True):
                s, t = np.frombuffer(x, U), np.frombuffer(y, U)
                both = len(np.intersect1d(s, t, assume_unique=True))
                good.append(100 * both >= percent * (len(s) + len(t) - both))
            yield b.loc[np.array(good, bool), ["a", "b"]] if len(b) else b[["a", "b"]]

    def met(pairs: DataFrame, form, name: str) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
        items = written(loaded(docs, wanted, classes, naming, form).join(classes.select("cls", "n"), "cls"), name)
        side = lambda k: items.select(F.col("cls").alias(k), F.col("n").alias(f"n{k}"), F.col("items").alias(f"i{k}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ia", "ib")

    pairs = written(pairs, "candidates")
    pairs = written(met(pairs, sketch, "sketches").mapInPandas(near, "a long, b long").distinct(), "near-candidates")
    return met(pairs, np.ndarray.tobytes, "sets").mapInPandas(run, "a long, b long").distinct()


def unlike_buckets(members: DataFrame) -> DataFrame:
    """members (shingle, cls) of one bucket of each group of buckets with equal members, told by size and two sums."""
    prints = members.groupBy("shingle").agg(F.count(F.lit(1)).alias("k"), F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("p"), F.sum(F.hash("cls").cast("long")).alias("q"))
    one = prints.where("k > 1").groupBy("k", "p", "q").agg(F.min("shingle").alias("shingle")).select("shingle")
    return members.join(one, "shingle")


def cross_pairs(members: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of different components inside buckets. members: shingle, cls, comp.

    A bucket is cut into blocks: those of one large component and those of all small ones; a pair of blocks is one tree
    join. Blocks of the same large component do not meet, so a resolved bucket of any size costs nothing.
    """
    open_ = members.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("shingle")
    members = unlike_buckets(members.join(open_, "shingle").select("shingle", "cls")).join(members, ["shingle", "cls"])
    sizes = members.groupBy("shingle", "comp").agg(F.count(F.lit(1)).alias("k"))
    sizes = sizes.withColumn("part", F.when(F.col("k") >= BLOCK // 2, F.col("comp")).otherwise(F.lit(None).cast("long")))
    total = sizes.groupBy("shingle", "part").agg(F.ceil(F.sum("k") / BLOCK).alias("blocks"))
    placed = members.join(sizes.drop("k"), ["shingle", "comp"]).join(total.withColumnRenamed("part", "p2").withColumnRenamed("shingle", "s2"), (F.col("shingle") == F.col("s2")) & F.col("part").eqNullSafe(F.col("p2"))).drop("s2", "p2")
    name = lambda part, no: F.concat_ws("/", F.coalesce(part.cast("string"), F.lit("-")), no.cast("string"))
    placed = written(placed.select("shingle", "cls", "comp", name(F.col("part"), F.pmod(F.xxhash64("cls"), "blocks")).alias("block")), "placed")
    blocks = placed.select("shingle", "block").distinct()
    other = blocks.select("shingle", F.col("block").alias("b2"))
    same = F.substring_index("block", "/", 1) == F.substring_index("b2", "/", 1)
    meets = blocks.join(other, "shingle").where((F.col("block") <= F.col("b2")) & ~(same & (F.substring_index("block", "/", 1) != "-")))
    meets = written(meets, "meets")
    first = placed.join(meets, ["shingle", "block"]).select("shingle", F.col("block").alias("b1"), "b2", "cls", "comp", F.when(F.col("block") == F.col("b2"), 2).otherwise(0).alias("side"))
    second = placed.join(meets.where("block <> b2").select("shingle", F.col("block").alias("b1"), F.col("b2").alias("block")), ["shingle", "block"]).select("shingle", "b1", F.col("block").alias("b2"), "cls", "comp", F.lit(1).alias("side"))
    rows = first.unionByName(second).join(points.select("cls", "n", "counts"), "cls")
    rows = rows.select("shingle", "b1", "b2", "cls", "comp", "side", "n", "counts").repartition("shingle", "b1", "b2").sortWithinPartitions("shingle", "b1", "b2")
    return rows.mapInPandas(tree_join(percent), "a long, b long").distinct()


def first_row(doc_id: str, key: str) -> Column:
    """The least row of a group: the smallest id, a null one last, then the smallest key."""
    return F.min(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("rep"), F.col(key).alias("rep_key")))


def routed(docs: DataFrame, percent: int, text: str, naming: Naming) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, Naming]:
    """(documents with their keys, their rows classified, a row per class, the (shingle, cls) of shared prefixes, the
    naming)."""
    own = docs.select("doc_id", text_or_empty(F.col(text)).alias("text")).withColumn("key", row_key())
    rows, heavy, naming = classified(own, naming)
    last = np.sort(np.array([r["cls"] for r in heavy.collect()], np.int64).view(U))  # at most HEAVY_LIMIT
    # dealt by shingle once, for both the count and the join
    first = prefixes(own, last, percent, naming).repartition("shingle")
    shared = first.groupBy("shingle").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi").select("shingle")
    buckets = written(first.join(shared, "shingle").distinct(), "buckets")
    some = rows.where("cls is not null").groupBy("cls").agg(first_row("doc_id", "key").alias("first"), F.count(F.lit(1)).alias("n_rows"), F.first("n").alias("n"), F.first("counts").alias("counts"))
    classes = written(some.select("cls", "first.rep", "first.rep_key", "n_rows", "n", "counts"), "reps")
    return own, rows, classes, buckets, naming


def jaccard_rows(docs: DataFrame, percent: int = 85, text: str = "text", width: int = SHINGLE, bits: int = 64) -> DataFrame:
    """doc_id, key, n_shingles, component_id and first_key per row of docs: row_key() of the row and of the first row of
    its component, whose id is component_id. Rows without a set have no first_key. Rows that share an id, or have none,
    are members each by its own text. The result does not depend on `bits`."""
    own, rows, classes, buckets, naming = routed(docs, percent, text, Naming(width, bits))
    members = written(unlike_buckets(buckets), "members")
    points = classes.select("cls", "n", "counts")
    degree = buckets.groupBy("cls").agg(F.count(F.lit(1)).alias("degree"))
    leader = members.join(degree, "cls").groupBy("shingle").agg(F.max_by("cls", F.struct("degree", "cls")).alias("lead"))
    stars = members.join(leader, "shingle").where("cls <> lead").select(F.least("cls", "lead").alias("a"), F.greatest("cls", "lead").alias("b")).distinct()
    links = written(verified(bounded_pairs(stars, points, percent), own, classes, percent, naming), "near-links")
    comp = components(links)
    labelled = members.join(comp.withColumnRenamed("id", "cls"), "cls", "left").select("shingle", "cls", F.coalesce("component", "cls").alias("comp"))
    rest = cross_pairs(written(labelled, "labelled"), points, percent)
    links = links.unionByName(written(verified(rest, own, classes, percent, naming), "near-links"))
    comp = components(links)
    named = classes.select("cls", "rep", "rep_key").join(comp.withColumnRenamed("id", "cls"), "cls", "left").select("cls", "rep", "rep_key", F.coalesce("component", "cls").alias("comp"))
    names = named.groupBy("comp").agg(first_row("rep", "rep_key").alias("first")).select("comp", F.col("first.rep").alias("component_id"), F.col("first.rep_key").alias("first_key"))
    by_class = named.join(names, "comp").select("cls", "component_id", "first_key")
    out = rows.join(by_class, "cls", "left")
    return out.select("doc_id", "key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "first_key")


def jaccard_components(docs: DataFrame, percent: int = 85, text: str = "text", width: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles and component_id per row of docs: the smallest doc_id reachable by links.

    Null and blank texts have no set and link with nothing. Rows that repeat an id are judged each by its own text. A
    null doc_id is never a component's name unless there is no other. Other columns are dropped.
    """
    return jaccard_rows(docs, percent, text, width).select("doc_id", "n_shingles", "component_id")


def jaccard_links(docs: DataFrame, percent: int = 85, text: str = "text", width: int = SHINGLE, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """All links, not only those that components need: ((a, b, rows_a, rows_b) of every pair of linked classes, and
    (doc_id, key, cls, n_links) per row of docs). Each row of a links with each of b, and rows of one class with one
    another; n_links counts a row's links."""
    own, rows, classes, buckets, naming = routed(docs, percent, text, Naming(width, bits))
    apart = buckets.withColumn("comp", F.col("cls"))
    pairs = written(verified(cross_pairs(apart, classes.select("cls", "n", "counts"), percent), own, classes, percent, naming), "all-links")
    side = lambda k: classes.select(F.col("cls").alias(k), F.col("n_rows").alias(f"rows_{k}"))
    pairs = written(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "rows_a", "rows_b"), "all-links")
    both = pairs.select(F.col("a").alias("cls"), F.col("rows_b").alias("k")).unionByName(pairs.select(F.col("b").alias("cls"), F.col("rows_a").alias("k")))
    near = both.groupBy("cls").agg(F.sum("k").alias("near"))
    per_class = classes.join(near, "cls", "left").select("cls", (F.col("n_rows") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    return pairs, rows.join(per_class, "cls", "left").select("doc_id", "key", "cls", F.coalesce("n_links", F.lit(0)).alias("n_links"))
