"""Substring deduplication with suffix automata of reference shards.

Passages that can recur are found first: every 13-word window is named by the least hash of its 5-word groups, so equal
windows get equal names and neighbours mostly share one. The runs of windows of one name are dealt out by name once; names
met in two documents or more mark the runs worth matching. Each distinct run of words is a reference passage, sent once,
by the smallest document that holds it, to the shard of its name. A shard's passages are compiled into one suffix
automaton over words and streamed through it; the matching statistics give for each window the smallest document that
holds its exact words. Names and prints only route and identify; a match is of the words.

A name with more than MAX_PASSAGES distinct passages (counted over all documents) is split further: its windows travel
one by one under the hash of all their words, so that no shard grows with the corpus. Texts that equal one of a smaller
doc_id word for word need no matching: all their windows go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written

WINDOW, GROUP = 13, 5
SHARD_WORDS = 50_000
MAX_PASSAGES = 20_000
CHUNK_RUNS = 400_000
MEMO = 1 << 18
U = np.uint64
NONE = np.iinfo(np.int64).max
EDGE = np.ones(1, bool)


class WordHashes(dict):
    """Word to 64-bit hash, the same in every process; forgets when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U, len(words))


def window_names(h: np.ndarray, window: int = WINDOW, group: int = GROUP) -> np.ndarray:
    """The name of each window of words with hashes h: the least mixed hash among its groups. Empty for short texts."""
    if len(h) < window:
        return np.empty(0, np.int64)
    g = np.zeros(len(h) - group + 1, U)
    for k in range(group):
        g = g * U(0x9E3779B97F4A7C15) + h[k : k + len(g)]
    g ^= g >> U(31)
    g *= U(0xBF58476D1CE4E5B9)
    g ^= g >> U(29)
    m = g[: len(h) - window + 1].copy()
    for k in range(1, window - group + 1):
        np.minimum(m, g[k : k + len(m)], out=m)
    return m.view(np.int64)


class Prints:
    """64-bit prints of any stretches of one text, from prefix sums of its words' hashes."""

    STEP = 0xD6E8FEB86659FD93
    BACK = pow(STEP, -1, 1 << 64)
    ups, downs = np.ones(1, U), np.ones(1, U)

    @classmethod
    def powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.ups) < n:
            size = max(n, 2 * len(cls.ups))
            up, down = np.full(size, cls.STEP, U), np.full(size, cls.BACK, U)
            up[0] = down[0] = 1
            cls.ups, cls.downs = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return cls.ups, cls.downs

    def __init__(self, h: np.ndarray):
        ups, self.downs = self.powers(len(h) + 1)
        self.sums = np.zeros(len(h) + 1, U)
        np.cumsum(h * ups[: len(h)], out=self.sums[1:])

    def of(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        p = (self.sums[stops] - self.sums[starts]) * self.downs[starts] + (stops - starts).astype(U)
        p ^= p >> U(32)
        p *= U(0xD6E8FEB86659FD93)
        p ^= p >> U(29)
        return p.view(np.int64)


def runs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, print, first window, number of windows) of each run of windows of one name."""
    own = window_names(h)
    if not len(own):
        return own, own, own, own
    edges = np.flatnonzero(np.concatenate((EDGE, own[1:] != own[:-1], EDGE)))
    starts, sizes = edges[:-1], edges[1:] - edges[:-1]
    return own[starts], Prints(h).of(starts, starts + sizes + WINDOW - 1), starts, sizes


def occurrences(docs: DataFrame) -> DataFrame:
    """(deal, name, print, doc_id, start, size, known) of the runs of all documents.

    Tasks look at their runs in chunks. A name that a chunk already finds in two documents is known to recur: its rows are
    dealt at random, and one probe (size 0) tells the other chunks of it, so that a very common name is no hot key. Of
    texts that are equal within a chunk one of the smallest doc_id speaks.
    """

    def settled(held: list[tuple]) -> Iterator[pd.DataFrame]:
        name, print_, start, size, doc = (np.concatenate([x[k] for x in held] + [np.empty(0, np.int64)]) for k in range(5))
        order = np.argsort(name, kind="stable")
        name, print_, start, size, doc = name[order], print_[order], start[order], size[order], doc[order]
        if not len(name):
            return
        first = np.r_[0, np.flatnonzero(np.diff(name)) + 1]
        low, high = np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first)
        known = np.repeat(low < high, np.diff(np.r_[first, len(name)]))
        deal = np.where(known, name ^ (doc * np.int64(0x9E3779B97F4A7C15 - (1 << 64))), name)
        probe, zero = name[first][low < high], np.zeros(int((low < high).sum()), np.int64)
        out = pd.DataFrame({
            "deal": np.r_[deal, probe], "name": np.r_[name, probe], "print": np.r_[print_, zero], "doc_id": np.r_[doc, low[low < high]],
            "start": np.r_[start, zero].astype(np.int32), "size": np.r_[size, zero].astype(np.int32), "known": np.r_[known, zero > 0],
        })
        for k in range(0, len(out), 50_000):
            yield out.iloc[k : k + 50_000]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, held, n, speaks = WordHashes(), [], 0, {}
        for batch in batches:
            for doc, text in zip(batch["doc_id"].tolist(), batch["text"], strict=True):
                raw = text.encode()
                whole = xxhash.xxh3_128_digest(raw)
                if speaks.get(whole, doc + 1) < doc:
                    continue
                speaks[whole] = doc
                found = runs(hashes.of(raw.split()))
                held.append((*found, np.full(len(found[0]), doc, np.int64)))
                n += len(found[0])
                if n >= CHUNK_RUNS:
                    yield from settled(held)
                    held, n, speaks = [], 0, {}
        yield from settled(held)

    return docs.mapInPandas(run, "deal long, name long, print long, doc_id long, start int, size int, known boolean")


def recurring(docs: DataFrame) -> DataFrame:
    """(name, print, doc_id, start, size) of the runs whose name is met in two documents or more."""
    together = Window.partitionBy("deal", "name")
    met = occurrences(docs).withColumn("low", F.min("doc_id").over(together)).withColumn("high", F.max("doc_id").over(together))
    return met.where("size > 0 and (known or low < high)").select("name", "print", "doc_id", "start", "size")


WANTED = ("name", "print", "start", "size", "hot")


def pieces(asked: DataFrame) -> DataFrame:
    """(route, piece, name, print, k, passage, doc) of the wanted runs. asked: doc_id, text, and an array of each of WANTED.

    A run is one piece under its name and print; a run of a hot name is a piece per window (k counts them), under the
    hash of its words, and equal ones of a chunk but the one of the smallest document are sent without their text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            # plain pieces by column, those of hot names by row
            whole: list[tuple] = []
            passages: list[bytes] = []
            out: list[tuple] = []
            sent: dict[int, int] = {}
            for doc, text, name, own, start, size, hot in zip(batch["doc_id"].tolist(), batch["text"], *(batch[c] for c in WANTED), strict=True):
                words = text.encode().split()
                prints = Prints(hashes.of(words))
                start, stop = np.asarray(start, np.int64), np.asarray(start, np.int64) + size + WINDOW - 1
                own, hot = np.asarray(own, np.int64), np.asarray(hot, bool)
                fits = stop <= len(words)  # else, or with another print, of another row with the same doc_id
                mine = fits & (prints.of(np.where(fits, start, 0), np.where(fits, stop, 0)) == own)
                one = mine & ~hot
                whole.append((np.asarray(name, np.int64)[one], own[one], np.full(int(one.sum()), doc, np.int64)))
                passages += [b" ".join(words[a:z]) for a, z in zip(start[one].tolist(), stop[one].tolist(), strict=True)]
                for j in np.flatnonzero(mine & hot):
                    at = np.arange(start[j], stop[j] - WINDOW + 1)
                    for k, each in enumerate(prints.of(at, at + WINDOW).tolist()):
                        first = sent.get(each, doc + 1) > doc
                        sent[each] = min(doc, sent.get(each, doc))
                        out.append((each, each, int(name[j]), int(own[j]), k, b" ".join(words[at[k] : at[k] + WINDOW]) if first else None, doc))
            if passages:
                n, p, d = (np.concatenate([x[k] for x in whole]) for k in range(3))
                yield pd.DataFrame({"route": n, "piece": p, "name": n, "print": p, "k": np.full(len(n), -1, np.int32), "passage": passages, "doc": d})
            if out:
                yield pd.DataFrame(out, columns=["route", "piece", "name", "print", "k", "passage", "doc"])

    return asked.select("doc_id", "text", *WANTED).mapInPandas(run, "route long, piece long, name long, print long, k int, passage binary, doc long")


class SuffixAutomaton:
    """Of several word sequences; each state knows the smallest document in which its sequences end."""

    def __init__(self) -> None:
        self.length, self.link, self.arcs, self.doc = [0], [-1], [{}], [np.iinfo(np.int64).max]

    def _state(self, length: int, link: int, arcs: dict, doc: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.arcs.append(arcs)
        self.doc.append(doc)
        return len(self.length) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.arcs[q]), self.doc[q])
        while p >= 0 and self.arcs[p].get(word) == q:
            self.arcs[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, words: list[bytes], doc: int) -> None:
        length, link, arcs, docs = self.length, self.link, self.arcs, self.doc
        last = 0
        for w in words:
            q = arcs[last].get(w)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, w, q)
            else:
                cur, p = len(length), last
                length.append(length[last] + 1)
                link.append(0)
                arcs.append({})
                docs.append(doc)
                while p >= 0 and w not in arcs[p]:
                    arcs[p][w] = cur
                    p = link[p]
                if p >= 0:
                    q = arcs[p][w]
                    link[cur] = q if length[q] == length[p] + 1 else self._split(p, w, q)
                last = cur
            if doc < docs[last]:
                docs[last] = doc

    def settle(self) -> None:
        """Hands each state's smallest document to its suffixes; once, after the last add()."""
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            up = self.link[s]
            self.doc[up] = min(self.doc[up], self.doc[s])

    def first_docs(self, words: list[bytes], window: int = WINDOW) -> list[int]:
        """For each window of `words` the smallest document that holds it; the largest integer if none does."""
        length, link, arcs, docs = self.length, self.link, self.arcs, self.doc
        out, s, n = [], 0, 0
        for k, w in enumerate(words, 1):
            to = arcs[s].get(w)
            while to is None and s:
                s = link[s]
                n = length[s]
                to = arcs[s].get(w)
            if to is not None:
                s, n = to, n + 1
                if n >= window:
                    n = window
                    while length[link[s]] >= window:
                        s = link[s]
            if k >= window:
                out.append(docs[s] if n >= window else NONE)
        return out


def matched(routed: DataFrame) -> DataFrame:
    """(route, piece, hot, first_docs) of the passages (route, piece, hot, passage, doc), which come sorted by route."""

    def flush(held: dict[tuple, int]) -> pd.DataFrame:
        """One shard, or a few if one name has more passages than a shard holds; MAX_PASSAGES bounds them."""
        split, docs = [p.split(b" ") for *_, p in held], list(held.values())
        found: list = [None] * len(split)
        at = 0
        while at < len(split):
            shard, size = SuffixAutomaton(), 0
            while at < len(split) and (size == 0 or size + len(split[at]) <= 2 * SHARD_WORDS):
                shard.add(split[at], docs[at])
                size += len(split[at])
                at += 1
            shard.settle()
            for k, words in enumerate(split):
                own = shard.first_docs(words)
                found[k] = own if found[k] is None else list(map(min, found[k], own))
        return pd.DataFrame({"route": [k[0] for k in held], "piece": [k[1] for k in held], "hot": [k[2] for k in held], "first_docs": found})

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, int] = {}
        size, last = 0, None
        for batch in batches:
            for route, piece, hot, passage, doc in zip(*(batch[c].tolist() for c in ("route", "piece", "hot", "passage", "doc")), strict=True):
                if size >= SHARD_WORDS and route != last:
                    yield flush(held)
                    held, size = {}, 0
                last, key = route, (route, piece, hot, passage)
                if key not in held:
                    size += passage.count(b" ") + 1
                    held[key] = doc
                elif doc < held[key]:
                    held[key] = doc
        if held:
            yield flush(held)

    return routed.mapInPandas(stream, "route long, piece long, hot boolean, first_docs array<long>")


def removable(own: DataFrame, max_passages: int) -> DataFrame:
    """(doc_id, start, size, print, gone) of the runs with windows to remove; gone: their offsets from start."""
    places = written(recurring(own), "places")
    distinct = places.groupBy("name", "print").agg(F.min(F.struct("doc_id", "start", "size")).alias("at")).select("name", "print", "at.*")
    crowded = distinct.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_passages).select("name", F.lit(True).alias("hot"))
    distinct = written(distinct.join(crowded, "name", "left").withColumn("hot", F.coalesce("hot", F.lit(False))), "passages")
    listed = lambda rows: rows.groupBy("doc_id").agg(F.collect_list(F.struct(*WANTED)).alias("w"))
    wanted = lambda rows: listed(rows).select("doc_id", *[F.col(f"w.{c}").alias(c) for c in WANTED])
    sent = pieces(own.join(wanted(distinct), "doc_id")).where("passage is not null").select("route", "piece", (F.col("k") >= 0).alias("hot"), "passage", "doc")
    shards = matched(sent.repartition("route").sortWithinPartitions("route"))
    shards = written(shards, "matched")
    plain = shards.where("not hot").select(F.col("route").alias("name"), F.col("piece").alias("print"), F.lit(0).alias("k"), "first_docs")
    links = pieces(own.join(wanted(distinct.where("hot")), "doc_id")).select("route", "piece", "name", "print", "k")
    hot = links.join(shards.where("hot"), ["route", "piece"]).select("name", "print", "k", "first_docs")
    hits = places.join(plain.unionByName(hot), ["name", "print"])
    gone = F.filter(F.transform("first_docs", lambda d, i: F.when(d < F.col("doc_id"), F.col("k") + i)), lambda x: x.isNotNull())
    return hits.select("doc_id", "start", "size", "print", gone.alias("gone")).where(F.size("gone") > 0)


def substring_dedup(docs: DataFrame, text: str = "text", max_passages: int = MAX_PASSAGES) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space), a row per row of docs.

    A word goes if a 13-word window over it also starts in a document with a smaller doc_id. Null and empty texts have no
    words; rows with a null doc_id lose nothing and take nothing from others; rows with the same doc_id do not affect each
    other and are judged each by its own text; an empty table stays empty; other columns are dropped. The result does not
    depend on max_passages.
    """
    every = docs.select("doc_id", text_or_empty(F.col(text)).alias("text"))
    # the same scan and exchange by doc_id serve the reference passages and the last join
    own = every.where("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("long"))
    hits = removable(own, max_passages).select("doc_id", F.struct("start", "size", "print", "gone").alias("hit"), F.lit(None).cast("string").alias("digest"))
    firsts = own.groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit(None).cast(hits.schema["hit"].dataType).alias("hit"), "digest")
    notes = hits.unionByName(firsts).groupBy("doc_id").agg(F.collect_list("hit").alias("hits"), F.collect_set("digest").alias("digests"))
    copy = ~F.coalesce(F.array_contains("digests", F.md5("text")), F.lit(False))
    flat = [F.col("hits.start").alias("start"), F.col("hits.size").alias("size"), F.col("hits.print").alias("print"), F.flatten(F.transform("hits", lambda h: F.transform(h["gone"], lambda k: h["start"] + k))).alias("gone"), F.transform("hits", lambda h: F.size(h["gone"])).alias("many")]
    rows = own.join(notes, "doc_id", "left").select("doc_id", "text", copy.alias("copy"), *flat)
    nameless = every.where("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(False).alias("copy"))
    rows = rows.unionByName(nameless, allowMissingColumns=True)

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            out = []
            for text, copy, *hits in zip(*(batch[c] for c in ("text", "copy", "start", "size", "print", "gone", "many")), strict=True):
                words = text.encode().split()
                if copy and len(words) >= WINDOW:
                    out.append((len(words), len(words), ""))
                    continue
                if copy or hits[0] is None or not len(hits[0]):
                    out.append((len(words), 0, b" ".join(words).decode()))
                    continue
                start, size, want, at, many = (np.asarray(x, np.int64) for x in hits)
                stop = start + size + WINDOW - 1
                fits = stop <= len(words)
                mine = fits & (Prints(hashes.of(words)).of(np.where(fits, start, 0), np.where(fits, stop, 0)) == want)
                at = np.unique(at[np.repeat(mine, many)])
                edge = np.zeros(len(words) + 1, np.int64)
                edge[at] += 1
                edge[at + WINDOW] -= 1
                gone = np.cumsum(edge)[:-1] > 0
                out.append((len(words), int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode()))
            n, removed, left = zip(*out, strict=True) if out else ((), (), ())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_words": pd.Series(n, dtype="int64"), "n_removed": pd.Series(removed, dtype="int64"), "kept": pd.Series(left, dtype=object)})

    return rows.mapInPandas(kept, "doc_id long, n_words long, n_removed long, kept string")
