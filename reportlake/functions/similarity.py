"""Similarity of strings where Spark has no built-in: Arrow-batched, always after an equi join."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def ratio(a: str | None, b: str | None) -> float:
    """Ratcliff-Obershelp ratio of lower, trimmed texts; 0 if either is blank."""
    x, y = (a or "").strip().lower(), (b or "").strip().lower()
    return SequenceMatcher(None, x, y).ratio() if x and y else 0.0


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows; equal beginnings and ends are part of it."""
    n, begin, end = min(len(a), len(b)), 0, 0
    while begin < n and a[begin] == b[begin]:
        begin += 1
    while end < n - begin and a[-1 - end] == b[-1 - end]:
        end += 1
    if begin + end == n:
        return n
    a, b = a[begin : len(a) - end], b[begin : len(b) - end]
    where: dict[str, int] = {}
    for k, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << k
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return begin + end + len(a) - row.bit_count()


def common_subsequences(a: str, codes: np.ndarray, where: dict[str, int]) -> np.ndarray:
    """common_subsequence of a, of at most 64 characters, with each row of codes; 0 there is no character."""
    masks = np.zeros(len(where) + 1, np.uint64)
    for k, ch in enumerate(a):
        if ch in where:
            masks[where[ch]] |= np.uint64(1 << k)
    full = np.uint64((1 << len(a)) - 1)
    row = np.full(len(codes), full)
    for step in codes.T:
        hit = row & masks[step]
        row = ((row + hit) | (row - hit)) & full
    return len(a) - np.bitwise_count(row).astype(np.int64)


class Texts:
    """Texts, stripped and in lower case, that many others are compared with."""

    def __init__(self, texts: list[str]):
        self.own = [(x or "").strip().lower() for x in texts]
        self.size = np.array([len(x) for x in self.own], np.int64)
        self.bags = np.array([self.bag(x) for x in self.own]).reshape(-1, 64).astype(np.int32)
        short = np.flatnonzero(self.size <= 128)
        self.where = {ch: k for k, ch in enumerate(sorted(set("".join(self.own[j] for j in short))), 1)}
        self.codes = np.zeros((len(self.own), int(self.size[short].max(initial=0))), np.int32)
        for j in short:
            self.codes[j, : self.size[j]] = [self.where[ch] for ch in self.own[j]]

    @staticmethod
    def bag(x: str) -> np.ndarray:
        return np.bincount(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) % 64, minlength=64)

    def near(self, x: str, least: float) -> Iterator[int]:
        """Places of texts whose ratio with x may be `least` or more. Three upper bounds of the ratio, by lengths, by common
        characters and by the longest common subsequence, spare most pairs the ratio itself."""
        if not x:
            return
        need = least * (len(x) + self.size) / 2 - 1e-6
        j = np.flatnonzero((np.minimum(len(x), self.size) >= need) & (self.size > 0))
        if len(j):
            j = j[np.minimum(self.bag(x), self.bags[j]).sum(1) >= need[j]]
        if len(j) >= 8 and len(x) <= 64 and (self.size[j] <= 128).all():
            j = j[common_subsequences(x, self.codes[j], self.where) >= need[j]]
        for k in j.tolist():
            if x == self.own[k] or common_subsequence(x, self.own[k]) >= need[k]:
                yield k


def alike(left: list[str], right: list[str], least: float) -> Iterator[tuple[int, int, float]]:
    """(i, j, ratio) of all pairs of at least this ratio, `least` being positive."""
    others = Texts(right)
    for i, x in enumerate((x or "").strip().lower() for x in left):
        for k in others.near(x, least):
            if x == others.own[k]:
                yield i, k, 1.0
            elif (sim := SequenceMatcher(None, x, others.own[k]).ratio()) >= least:
                yield i, k, sim


def marks(texts: list[str], q: int, seed: int = 0) -> np.ndarray:
    """A word for each text, with a bit, by hash, for each of its grams of q characters and the number of its occurrence. As many
    bits of one text as another one lacks, so many grams of it at least the other one lacks. Grams that share a bit do so for one
    seed only."""
    out = np.zeros(len(texts), np.uint64)
    size = np.array([len(x) for x in texts], np.int64)
    for n in np.unique(size[size >= q]):
        at = np.flatnonzero(size == n)
        code = np.frombuffer("".join(texts[k] for k in at).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(at), n).astype(np.uint64)
        gram = np.sort(code if q == 1 else code[:, :-1] << np.uint64(32) | code[:, 1:], axis=1)
        place = np.arange(gram.shape[1])
        first = np.zeros(gram.shape, np.int64)
        first[:, 1:] = np.where(gram[:, 1:] != gram[:, :-1], place[1:], 0)
        nth = (place - np.maximum.accumulate(first, axis=1)).astype(np.uint64)
        mixed = (gram + np.uint64(seed << 48) + nth * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
        out[at] = np.bitwise_or.reduce(np.uint64(1) << (mixed >> np.uint64(58)), axis=1)
    return out


def least_matching(total: np.ndarray, over: float) -> np.ndarray:
    """The fewest characters that texts of this length together must have in common for a ratio of more than `over`."""
    m = np.maximum(np.floor(over * total / 2).astype(np.int64) - 1, 0)
    for _ in range(3):
        m = np.where(2.0 * m / total > over, m, m + 1)
    return m


class Names:
    """Names, stripped and in lower case, that very many texts are held against.

    Of a name of which m characters are matched, at most its size less m characters are missing in the text; and so of its last
    quarter, which can only be matched from its own place less these characters on. Matching blocks are at most la + lb - 2 m + 1,
    so at least m less these pairs of characters are in common. All three are counted in words of 64 bits (see marks()) for all
    names of fitting sizes at once, so that few are left to be compared.
    """

    #: Names that are compared one by one before the others are compared at once.
    FIRST = 16

    def __init__(self, names: list[str], over: float):
        self.over = over
        self.own = sorted({(x or "").strip().lower() for x in names} - {""}, key=len)
        self.order = sorted(range(len(self.own)), key=self.own.__getitem__)
        self.sorted = [self.own[k] for k in self.order]
        self.size = np.array([len(x) for x in self.own], np.int64)
        self.chars, self.pairs = (marks(self.own, q) for q in (1, 2))
        self.tails = marks([y[len(y) - len(y) // 4 :] for y in self.own], 1, seed=1)
        self.by_size: dict[int, tuple | None] = {}
        self.codes: np.ndarray | None = None

    def bounds(self, n: int) -> tuple | None:
        """For a text of n characters: the names from lo to hi that may be alike by size, and for each of them how many
        characters are needed and how many characters and pairs of the name may be missing."""
        if n not in self.by_size:
            m = least_matching(n + self.size, self.over)
            fit = np.flatnonzero(m <= np.minimum(n, self.size))
            lo, hi = (int(fit[0]), int(fit[-1]) + 1) if len(fit) else (0, 0)
            m, size = m[lo:hi], self.size[lo:hi]
            less = [np.minimum(x, 64).astype(np.uint8) for x in (size - m, 2 * size + n - 3 * m)]
            self.by_size[n] = (lo, hi, m, *less) if len(fit) else None
        return self.by_size[n]

    def matched(self, x: str, rest: np.ndarray, need: np.ndarray) -> np.ndarray:
        """Those of the names `rest` whose longest common subsequence with x is as long as needed."""
        if len(x) > 64 or self.size[rest[-1]] > 128 or len(rest) < self.FIRST:
            return rest
        if self.codes is None:
            short = [y for y in self.own if len(y) <= 128]
            self.where = {ch: k for k, ch in enumerate(sorted(set("".join(short))), 1)}
            self.codes = np.zeros((len(short), len(short[-1])), np.int32)
            for k, y in enumerate(short):
                self.codes[k, : len(y)] = [self.where[ch] for ch in y]
        return rest[common_subsequences(x, self.codes[rest], self.where) >= need]

    def lacking(self, texts: list[str]) -> Iterator[tuple[int, np.uint64, np.uint64, np.ndarray]]:
        """For the places of all texts that are as long as some name: the bits that are not in the words of their characters and
        pairs of characters, and, for each size from that of name lo on, of the part that holds the last quarter of a name."""
        by_size: dict[int, list[int]] = {}
        for i, x in enumerate(texts):
            by_size.setdefault(len(x), []).append(i)
        for n, at in by_size.items():
            if n and (bounds := self.bounds(n)):
                lo, hi, m, *_ = bounds
                own = [texts[i] for i in at]
                tails = np.zeros((len(own), int(self.size[hi - 1] - self.size[lo]) + 1), np.uint64)
                for k in np.unique(self.size[lo:hi], return_index=True)[1].tolist():
                    size = int(self.size[lo + k])
                    begin = max(0, size - size // 4 - (size - int(m[k])))
                    tails[:, size - self.size[lo]] = ~marks([x[begin:] for x in own], 1, seed=1)
                yield from zip(at, ~marks(own, 1), ~marks(own, 2), tails, strict=True)

    def has_alike(self, x: str, no_chars: np.uint64, no_pairs: np.uint64, no_tails: np.ndarray) -> bool:
        """Whether x, of which lacking() tells the rest, has a ratio of more than `over` with a name."""
        lo, hi, m, less_chars, less_pairs = self.bounds(len(x))

        def is_alike(k: int) -> bool:
            y = self.own[lo + k]
            return x == y or (common_subsequence(x, y) >= m[k] and SequenceMatcher(None, x, y).ratio() > self.over)

        # names that begin like x are tried first
        at = bisect_left(self.sorted, x)
        if any(lo <= k < hi and is_alike(k - lo) for k in self.order[max(0, at - 1) : at + 1]):
            return True
        missing = np.bitwise_count(self.chars[lo:hi] & no_chars)
        near = np.flatnonzero(missing <= less_chars)
        missing = missing[near]
        for words, absent, less in ((self.tails, no_tails, less_chars), (self.pairs, no_pairs, less_pairs)):
            if not len(near):
                return False
            bits = absent if words is self.pairs else absent[self.size[lo + near] - self.size[lo]]
            more = np.bitwise_count(words[lo + near] & bits)
            kept = more <= less[near]
            near, missing = near[kept], missing[kept] + more[kept]
        if not len(near):
            return False
        if is_alike(int(near[missing.argmin()])):
            return True
        if len(near) == 1:
            return False
        near = near[np.argsort(missing, kind="stable")][1:]
        if any(is_alike(k) for k in near[: self.FIRST].tolist()):
            return True
        rest = np.sort(near[self.FIRST :])
        return bool(len(rest)) and any(is_alike(k - lo) for k in self.matched(x, rest + lo, m[rest]).tolist())


def any_alike(left: list[str], right: list[str], over: float) -> list[bool]:
    """Whether each text of left has a ratio of more than `over` (0 or more) with any of right; the first one found ends the search."""
    names = Names(right, over)
    texts = [(x or "").strip().lower() for x in left]
    out = [False] * len(texts)
    for i, *lacks in names.lacking(texts):
        out[i] = names.has_alike(texts[i], *lacks)
    return out


def indel(a: str | None, b: str | None) -> float:
    """100 * (1 - insertions and deletions / total length); 100 for two empty strings."""
    x, y = a or "", b or ""
    total = len(x) + len(y)
    return 100.0 * 2 * common_subsequence(x, y) / total if total else 100.0


def gram_bags(texts: list[str], q: int, size: int) -> np.ndarray:
    """How often each text has grams of q characters, by hash in `size` places; a row a text."""
    out = np.zeros((len(texts), size), np.int32)
    for k, x in enumerate(texts):
        code = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(code) >= q:
            out[k] = np.bincount((code if q == 1 else code[:-1] * np.uint32(31) + code[1:]) % size, minlength=size)
    return out


def most_alike(left: list[str], right: list[str], least: float) -> Iterator[tuple[int, int, float]]:
    """(i, j, indel) of each left text and the right one with the highest indel, if that is over `least` (0 or more); the first of
    equal ones. No text is empty.

    A text is compared with the others in the order of an upper bound, which ends the search: characters in common, and where
    that leaves many, pairs of characters in common. Of P such pairs, a common subsequence of m leaves at least m - (la + lb - 2 m + 1),
    since la + lb - 2 m characters are outside it, and each parts it at most once more.
    """
    place = {x: j for j, x in reversed(list(enumerate(right)))}
    names, at = list(place)[::-1], np.array(list(place.values())[::-1], np.int64)
    size, bags = np.array([len(x) for x in names], np.int64), gram_bags(names, 1, 64)
    for i, (x, bag) in enumerate(zip(left, gram_bags(left, 1, 64), strict=True)):
        near = np.flatnonzero(200 * np.minimum(len(x), size) > least * (len(x) + size))
        bound = 200.0 * np.minimum(bag, bags[near]).sum(1) / (len(x) + size[near])
        best, one = least, -1
        for narrowed in (False, True):
            order = np.lexsort((at[near], -bound))
            for k in order if narrowed else order[:1]:
                if bound[k] < best or (bound[k] == best and (one < 0 or at[near[k]] > one)):
                    if bound[k] < best:
                        break
                    continue
                score = indel(x, names[near[k]])
                if score > best or (score == best and 0 <= at[near[k]] < one):
                    best, one = score, int(at[near[k]])
            if not narrowed:
                rest = bound >= best
                rest[order[:1]] = False
                near, bound = near[rest], bound[rest]
                if len(near) > 2:
                    pairs = np.minimum(gram_bags([x], 2, 512), gram_bags([names[k] for k in near], 2, 512)).sum(1)
                    total = len(x) + size[near]
                    bound = np.minimum(bound, 200.0 * ((pairs + total + 1) // 3) / total)
        if one >= 0:
            yield i, one, best


@F.pandas_udf(DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
