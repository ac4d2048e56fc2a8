"""Phrase collocations: frequent phrases of two and three words and how strongly their parts hold together.

Words are ranked by frequency, and the ids of the most frequent ones (a bounded number) make a square of word pairs that is
split into tiles. A task counts a tile with many pairs by direct address (a dense bincount over its cells) and the pairs of
all other tiles as sorted coordinates; Spark adds up what the tasks found, so no tile is a hot group. Frequent pairs are
ranked again, and a triple is the pair of a ranked pair and a word, counted in tiles in the same way.

What lies beyond the ranks is counted exactly, too, by its words in an ordinary aggregation. To keep that small, words and
pairs that are not frequent are left out there by a bit table of fixed size, which may let some of them pass but holds back
no frequent one: a phrase is only frequent if its parts are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import most_frequent, text_or_empty, written
from .positional_index import lowered

LEAST, TOP, SUBSUMED_PERCENT = 10, 2000, 50
HEAD_WORDS, HEAD_PAIRS = 1 << 17, 1 << 19
#: Bits of a word id in a code; the head is a little smaller than they allow.
BITS = 18
SIDE, GRID, DENSE = 9, 16, 1 << 14
BUFFER = 1 << 21
#: Bytes of word ids that a task spreads out at a time.
SLICE = 1 << 20
#: Size of the bit table in bits, a prime.
SLOTS = 67_108_859
SALTS = 64
BREAK, TAIL = -1, -2

#: Bytes of a text with A-Z in lower case and all ends of pieces as line feeds.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9)
COUNTED = "code long, lang string, phrase string, n long"


def counted_codes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes (first id, second id in BITS bits) and their counts: dense tiles by bincount, the rest sorted."""
    a, b = codes >> BITS, codes & ((1 << BITS) - 1)
    near = ((a >> SIDE) < GRID) & ((b >> SIDE) < GRID)
    at = ((a[near] >> SIDE) * GRID + (b[near] >> SIDE)).astype(np.uint8 if GRID <= 16 else np.uint16)
    sizes = np.bincount(at, minlength=GRID * GRID)
    order = np.argsort(at, kind="stable")
    tiled = codes[near][order]
    ends = np.cumsum(sizes)
    found, counts, sparse = [], [], [codes[~near]]
    for t in np.flatnonzero(sizes):
        own = tiled[ends[t] - sizes[t] : ends[t]]
        if sizes[t] < DENSE:
            sparse.append(own)
            continue
        cell = ((own >> BITS) & ((1 << SIDE) - 1)) << SIDE | (own & ((1 << SIDE) - 1))
        tile = np.bincount(cell, minlength=1 << 2 * SIDE)
        held = np.flatnonzero(tile)
        first = ((t // GRID) << SIDE) + (held >> SIDE)
        found.append(first << BITS | ((t % GRID) << SIDE) + (held & ((1 << SIDE) - 1)))
        counts.append(tile[held])
    rest = np.sort(np.concatenate(sparse))
    if len(rest):
        starts = np.flatnonzero(np.r_[True, rest[1:] != rest[:-1]])
        found.append(rest[starts])
        counts.append(np.diff(np.r_[starts, len(rest)]))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found]), np.concatenate([none, *counts])


class Counter:
    """Collects codes and phrases of a task and gives them as rows, counted whenever the buffer is full. `first` says what
    the first halves of the codes stand for, if not for themselves."""

    def __init__(self, first: np.ndarray | None = None):
        self.codes, self.held, self.first = [], 0, first

    def rows(self, codes: np.ndarray, langs: list[str], phrases: list[bytes], last: bool = False) -> Iterator[pa.RecordBatch]:
        if len(codes):
            self.codes.append(codes.astype(np.int64))
            self.held += len(codes)
        if self.held and (last or self.held >= BUFFER):
            found, n = counted_codes(np.concatenate(self.codes))
            self.codes, self.held = [], 0
            if self.first is not None:
                found = self.first[found >> BITS] << BITS | found & ((1 << BITS) - 1)
            for k in range(0, len(found), 1 << 16):
                m = len(found[k : k + (1 << 16)])
                yield self._batch(pa.array(found[k : k + m], pa.int64()), pa.nulls(m, pa.string()), pa.nulls(m, pa.string()), pa.array(n[k : k + m], pa.int64()))
        if phrases:
            m = len(phrases)
            yield self._batch(pa.nulls(m, pa.int64()), pa.array(langs, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(np.ones(m, np.int64)))

    @staticmethod
    def _batch(*columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(list(columns), ["code", "lang", "phrase", "n"])


def slot(lang: str, phrase: bytes) -> int:
    """Place in the bit table; as slot_column."""
    h = xxhash.xxh64_intdigest(phrase, xxhash.xxh64_intdigest(lang, 42))
    return (h - (1 << 64) if h >> 63 else h) % SLOTS


def slot_column(lang: Column, phrase: Column) -> Column:
    return F.pmod(F.xxhash64(lang, phrase), F.lit(SLOTS))


def bit_table(slots: DataFrame) -> np.ndarray:
    """Bytes of bits with those of slots (slot) set. Not more than SLOTS / 64 rows reach the driver, whatever the input."""
    groups = slots.groupBy(F.expr("slot div 64").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")).toPandas()
    table = np.zeros(SLOTS // 64 + 1, np.int64)
    table[groups["at"].to_numpy()] = groups["bits"].to_numpy()
    return table.view(np.uint8)


def has(table: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (table[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 > 0


class Words(dict):
    """Ids of a language's ranked words; TAIL for any other."""

    def __missing__(self, word: bytes) -> int:
        return TAIL


def encoded(docs: DataFrame, ids: dict[str, dict[bytes, int]], table: np.ndarray) -> DataFrame:
    """(lang, ids, tails): word ids of each text as packed 32-bit numbers, with breaks where a piece ends or a word stands
    that cannot be frequent, and the other words beyond the ranks in order, joined by blanks."""
    shared = docs.sparkSession.sparkContext.broadcast((ids, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, bits = shared.value
        known = {lang: Words(w) for lang, w in own.items()}
        for b in batches:
            langs, coded, tails = b.column(0).to_pylist(), [], []
            for lang, text in zip(langs, b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                get = known.setdefault(lang, Words()).__getitem__
                out, rest = [], []
                for piece in text.translate(FOLD).split(b"\n"):
                    w = piece.split()
                    if len(w) > 1:
                        got = list(map(get, w))
                        if TAIL in got:
                            for k, (i, word) in enumerate(zip(got, w, strict=True)):
                                if i == TAIL:
                                    s = slot(lang, word)
                                    if bits[s >> 3] >> (s & 7) & 1:
                                        rest.append(word)
                                    else:
                                        got[k] = BREAK
                        out += got
                        out.append(BREAK)
                coded.append(np.array(out, np.int32).tobytes())
                tails.append(b" ".join(rest))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(coded, pa.binary()), pa.array(tails, pa.binary())], ["lang", "ids", "tails"])

    return written(docs.mapInArrow(run, "lang string, ids binary, tails binary"), "coded-texts")


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about SLICE bytes of ids (a single text may have more), so that memory is bounded."""
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column("ids")).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < b.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + SLICE, "right")))
            yield b.slice(start, stop - start)
            start = stop


class Tokens:
    """The words of a batch of coded texts in a row: ids, and what it takes to spell one out."""

    def __init__(self, batch: pa.RecordBatch, spelling: list[bytes]):
        parts = [np.frombuffer(x, np.int32) for x in batch.column("ids").to_pylist()]
        self.ids = np.concatenate([np.zeros(0, np.int32), *parts])
        self.langs = batch.column("lang").to_pylist()
        self.doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        self.tails = [w for x in batch.column("tails").to_pylist() for w in x.split()]
        self.nth = np.cumsum(self.ids == TAIL) - 1
        self.spelling = spelling

    def lang(self, k: int) -> str:
        return self.langs[self.doc[k]]

    def phrase(self, k: int, n: int) -> bytes:
        return b" ".join(self.spelling[i] if i >= 0 else self.tails[self.nth[k + d]] for d, i in enumerate(self.ids[k : k + n]))


def pair_counts(coded: DataFrame, spelling: list[bytes]) -> DataFrame:
    """(code, lang, phrase, n) of all pairs of words: by code where both words are ranked, else by language and words."""
    shared = coded.sparkSession.sparkContext.broadcast(spelling)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for b in slices(batches):
            t = Tokens(b, shared.value)
            i, j = t.ids[:-1].astype(np.int64), t.ids[1:].astype(np.int64)
            ranked = (i >= 0) & (j >= 0)
            other = np.flatnonzero(~ranked & (i != BREAK) & (j != BREAK))
            yield from counter.rows(i[ranked] << BITS | j[ranked], [t.lang(k) for k in other], [t.phrase(k, 2) for k in other])
        yield from counter.rows(np.zeros(0, np.int64), [], [], last=True)

    return summed(coded.mapInArrow(run, COUNTED))


def triple_counts(coded: DataFrame, spelling: list[bytes], pairs: np.ndarray, table: np.ndarray) -> DataFrame:
    """(code, lang, phrase, n) of triples both of whose pairs may be frequent. pairs: codes of ranked pairs, by rank; a triple
    of a ranked pair and a ranked word is counted by rank and id, and named by the pair's code and the id."""
    shared = coded.sparkSession.sparkContext.broadcast((spelling, pairs, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, by_rank, bits = shared.value
        rank = np.argsort(by_rank)
        codes = by_rank[rank]
        counter = Counter(by_rank)
        for b in slices(batches):
            t = Tokens(b, words)
            i, j = t.ids[:-1].astype(np.int64), t.ids[1:].astype(np.int64)
            both = (i >= 0) & (j >= 0)
            code = np.where(both, i << BITS | j, 0)
            at = np.minimum(np.searchsorted(codes, code), max(len(codes) - 1, 0))
            known = both & (codes[at] == code) if len(codes) else np.zeros(len(code), bool)
            own = np.where(known, rank[at], BREAK) if len(codes) else np.full(len(code), BREAK)
            may = known | (both & has(bits, code % SLOTS))
            for k in np.flatnonzero(~both & (i != BREAK) & (j != BREAK)):
                s = slot(t.lang(k), t.phrase(k, 2))
                may[k] = bits[s >> 3] >> (s & 7) & 1
            live = may[:-1] & may[1:]
            ranked = live & (own[:-1] >= 0) & (t.ids[2:] >= 0)
            other = np.flatnonzero(live & ~ranked)
            third = t.ids[2:].astype(np.int64)
            yield from counter.rows(own[:-1][ranked] << BITS | third[ranked], [t.lang(k) for k in other], [t.phrase(k, 3) for k in other])
        yield from counter.rows(np.zeros(0, np.int64), [], [], last=True)

    return summed(coded.mapInArrow(run, COUNTED))


def summed(parts: DataFrame) -> DataFrame:
    """Counts of LEAST or more. Ranked phrases travel as numbers only."""
    return parts.groupBy("code", "lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


def scored(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)), exact for counts of up to 10^15."""
    d = lambda c: f"cast({c} as decimal(38, 0))"
    return F.expr(f"({d(a)} * {d(a)} * 1000000) div ({d(left)} * {d(right)})")


def collocations(docs: DataFrame, top: int = TOP, head_words: int = HEAD_WORDS, head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language the `top` strongest phrases of two and three words that
    occur LEAST times or more; l and r count the parts at the weakest cut.

    Phrases do not reach over the ends of pieces (.,;:!? and line ends). A phrase of two words goes if one of three that
    holds it has at least half its occurrences. Null texts have no words, a null language is `und`; repeated rows count as often
    as they stand; ties go to the larger a, then to the smaller phrase by its bytes. An empty table, or one without frequent
    phrases, gives no rows. Other columns are not looked at. head_words and head_pairs bound what is ranked, not the result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty(F.col("text")).alias("text"))
    each = docs.select("lang", F.explode(F.array_remove(F.split("text", r"[\x20\x09-\x0D.,;:!?]+"), "")).alias("word")).select("lang", lowered(F.col("word")).alias("word"))
    every = written(each.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "word-counts")
    totals = every.groupBy("lang").agg(F.sum("n").alias("n"))
    words = every.where(F.col("n") >= LEAST)

    head = most_frequent(words, "word", head_words).toPandas()
    head = head.sort_values(["n", "lang", "word"], ascending=[False, True, True], ignore_index=True)
    spelling = [w.encode() for w in head["word"]]
    ids: dict[str, dict[bytes, int]] = {}
    for k, (lang, word) in enumerate(zip(head["lang"], spelling, strict=True)):
        ids.setdefault(lang, {})[word] = k
    named = written(spark.createDataFrame(head.assign(id=range(len(head)))[["id", "lang", "word"]], "id long, lang string, word string"), "ranked-words")
    beyond = words.join(named.select("lang", "word"), ["lang", "word"], "left_anti")
    coded = encoded(docs, ids, bit_table(beyond.select(slot_column(F.col("lang"), F.col("word")).alias("slot"))))

    pairs = written(pair_counts(coded, spelling), "pair-counts")
    ranked = most_frequent(pairs.where("code is not null"), "code", head_pairs)
    best = ranked.select("code", "n").toPandas().sort_values(["n", "code"], ascending=[False, True])["code"].to_numpy(np.int64)
    beyond = pairs.join(ranked.select("code"), "code", "left_anti")
    table = bit_table(beyond.select(F.coalesce(F.pmod("code", F.lit(SLOTS)), slot_column(F.col("lang"), F.col("phrase"))).alias("slot")))
    triples = written(triple_counts(coded, spelling, best, table), "triple-counts")

    def spelled(df: DataFrame, columns: list[str]) -> DataFrame:
        for k, c in enumerate(columns):
            df = df.join(named.select(F.col("id").alias(c), F.col("lang").alias(f"lang{k}"), F.col("word").alias(f"w{k + 1}")), c)
        return df.withColumn("lang", F.col("lang0"))

    low = F.lit((1 << BITS) - 1)
    halves = [F.shiftright("code", BITS).alias("i"), F.col("code").bitwiseAND(low).alias("j")]
    part = lambda k: F.get(F.split("phrase", " "), F.lit(k)).alias(f"w{k + 1}")
    two = spelled(pairs.where("code is not null").select(*halves, F.col("n").alias("a")), ["i", "j"]).select("lang", "w1", "w2", "a")
    two = written(two.unionByName(pairs.where("code is null").select("lang", part(0), part(1), F.col("n").alias("a"))), "pairs")
    coded3 = triples.where("code is not null").select(F.shiftright("code", BITS).alias("code"), F.col("code").bitwiseAND(low).alias("k"), F.col("n").alias("a"))
    three = spelled(coded3.select(*halves, "k", "a"), ["i", "j", "k"]).select("lang", "w1", "w2", "w3", "a")
    three = written(three.unionByName(triples.where("code is null").select("lang", part(0), part(1), part(2), F.col("n").alias("a"))), "triples")

    one = lambda w, n: words.select("lang", F.col("word").alias(w), F.col("n").alias(n))
    pair = lambda x, y, n: two.select("lang", F.col("w1").alias(x), F.col("w2").alias(y), F.col("a").alias(n))
    held = three.select("lang", "w1", "w2", "a").unionByName(three.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    held = held.groupBy("lang", "w1", "w2").agg(F.max("a").alias("longer"))
    free = two.join(held, ["lang", "w1", "w2"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < SUBSUMED_PERCENT * F.col("a")))
    free = free.join(one("w1", "l"), ["lang", "w1"]).join(one("w2", "r"), ["lang", "w2"])
    free = free.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", scored("a", "l", "r").alias("score"))
    cuts = three.join(one("w1", "l1"), ["lang", "w1"]).join(pair("w2", "w3", "r1"), ["lang", "w2", "w3"]).join(pair("w1", "w2", "l2"), ["lang", "w1", "w2"]).join(one("w3", "r2"), ["lang", "w3"])
    cut = F.least(*[F.struct(scored("a", f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in (1, 2)])
    cuts = cuts.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", cut.alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")

    # the best of each of many shares of a language first, so that no task ranks a whole language
    order = "order by score desc, a desc, phrase"
    some = free.unionByName(cuts).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = some.withColumn("rank", F.expr(f"row_number() over (partition by lang, salt {order})")).where(F.col("rank") <= top)
    some = some.withColumn("rank", F.expr(f"row_number() over (partition by lang {order})").cast("long")).where(F.col("rank") <= top)
    return some.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
