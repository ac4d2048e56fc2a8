"""Greedy batches under a budget over groups of any size: where a batch begins depends on the one before, yet a group spreads
over many tasks.

Rows are dealt by ranges of (group, order) into parts. For its first group, which may go on from the part before, a part works
out what it would make of every fill level of the batch that is open when it begins: only rows within one budget of the
part's start can end that batch, so this is a short table, and from each of them the chain of later batches is known by
pointers to next starts. One pass over these tables, a few rows for each part, gives each part its true level and batch
number, and then all parts number their rows at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linking import written

ROWS = 100_000


def next_starts(total: np.ndarray, most: int) -> np.ndarray:
    """Row at which the batch begun at each row ends (their number for none). total: running sums with 0 in front."""
    n = len(total) - 1
    over = np.searchsorted(total[1:], total[:-1] + most, "right")
    # a batch keeps its first row that has any tokens, however many
    first = np.searchsorted(total[1:], total[:-1], "right")
    return np.minimum(np.maximum(over, first + 1), n)


def reactions(tokens: np.ndarray, most: int) -> tuple[list[int], list[int], list[int]]:
    """What a part makes of an open batch of fill u > 0: (bounds, fills, counts). For the first k with u > bounds[k] the batch
    ends here, and the part leaves an open batch of fills[k], counts[k] batches on; without one, it is u plus all tokens."""
    total = np.concatenate([[0], np.cumsum(tokens)])
    n = len(tokens)
    after = next_starts(total, most)
    fill, count = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    sums, nxt = total.tolist(), after.tolist()
    for j in range(n - 1, -1, -1):
        k = nxt[j]
        fill[j], count[j] = (sums[n] - sums[j], 1) if k == n else (fill[k], count[k] + 1)
    may = np.flatnonzero(total[:-1] <= most)
    bounds = most - total[1:][may]
    new = np.r_[True, bounds[1:] < bounds[:-1]] if len(may) else np.zeros(0, bool)
    may, bounds = may[new], bounds[new]
    return bounds.tolist(), fill[may].tolist(), count[may].tolist()


def greedy(tokens: np.ndarray, most: int, used: int = 0, batch: int = 0) -> tuple[np.ndarray, int, int]:
    """Batch numbers of a group's rows that go on from an open batch, and the fill and number of the last one."""
    out = np.empty(len(tokens), np.int64)
    for k, t in enumerate(tokens.tolist()):
        if used > 0 and used + t > most:
            batch, used = batch + 1, 0
        used += t
        out[k] = batch
    return out, used, batch


def whole_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames of one part each; rows come sorted by part."""
    held: list[pd.DataFrame] = []
    for b in batches:
        for no, own in b.groupby("part", sort=True):
            if held and held[0]["part"].iloc[0] != no:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(own)
    if held:
        yield pd.concat(held, ignore_index=True)


def group_ends(keys: list) -> list[int]:
    """Row after the last one of each run of equal keys."""
    same = lambda a, b: a is b or a == b
    return [k for k in range(1, len(keys)) if not same(keys[k - 1], keys[k])] + [len(keys)]


def token_batches(rows: DataFrame, group: str, order: str, tokens: str, most: int, part_rows: int = ROWS) -> DataFrame:
    """(group, order, batch): batches in order, from 0 in each group, as many rows as fit into `most` tokens; a row that is
    too large alone is a batch with nothing but rows without tokens before it. Null tokens count as none, a null group is one
    group, ties go by tokens. An empty table stays empty."""
    kind = rows.schema[group].dataType.simpleString()
    size = F.coalesce(F.col(tokens).cast("long"), F.lit(0))
    own = rows.select(F.col(group).alias("key"), F.col(order).cast("long").alias("at"), size.alias("tokens"))
    parts = max(1, -(-own.count() // part_rows))
    dealt = own.repartitionByRange(parts, "key", "at").withColumn("part", F.spark_partition_id())
    dealt = written(dealt, "token-parts")
    by_part = dealt.repartition("part").sortWithinPartitions("part", "key", "at", "tokens")

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One row of each part: its first and last key, the table of its first group, and how its last group ends, if that
        begins here; else how its first one does, begun afresh."""
        for b in whole_parts(batches):
            keys, t = b["key"].astype(object).where(b["key"].notna(), None).tolist(), b["tokens"].to_numpy(np.int64)
            ends = group_ends(keys)
            bounds, fills, counts = reactions(t[: ends[0]], most)
            start = ends[-2] if len(ends) > 1 else 0
            _, used, batch = greedy(t[start:], most)
            yield pd.DataFrame({"part": [int(b["part"].iloc[0])], "lo": [keys[0]], "hi": [keys[-1]], "one": [len(ends) == 1], "tokens": [int(t[: ends[0]].sum())], "bounds": [bounds], "fills": [fills], "counts": [counts], "used": [used], "batch": [batch]})

    shape = f"part int, lo {kind}, hi {kind}, one boolean, tokens long, bounds array<long>, fills array<long>, counts array<long>, used long, batch long"
    table = written(by_part.mapInPandas(tables, shape), "token-tables")

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, used, batch, begun = None, 0, 0, False
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                lo = None if pd.isna(r.lo) else r.lo
                goes_on = begun and (lo is key or lo == key)
                u, m = (used, batch) if goes_on else (0, 0)
                out.append((r.part, u, m))
                if not r.one or u == 0:
                    # the last group begins here, or the open batch of the first one is empty, which is as good as none
                    used, batch = r.used, r.batch + (m if r.one else 0)
                else:
                    hit = next((k for k, bound in enumerate(r.bounds) if u > bound), None)
                    used, batch = (u + r.tokens, m) if hit is None else (r.fills[hit], m + r.counts[hit])
                key, begun = None if pd.isna(r.hi) else r.hi, True
            yield pd.DataFrame(out, columns=["part", "used_in", "batch_in"])

    # a short row for each part, in order
    entry = written(table.coalesce(1).sortWithinPartitions("part").mapInPandas(entries, "part int, used_in long, batch_in long"), "token-entries")

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in whole_parts(batches):
            keys, t = b["key"].astype(object).where(b["key"].notna(), None).tolist(), b["tokens"].to_numpy(np.int64)
            out, start = [], 0
            for end in group_ends(keys):
                used, batch = (int(b["used_in"].iloc[0]), int(b["batch_in"].iloc[0])) if start == 0 else (0, 0)
                out.append(greedy(t[start:end], most, used, batch)[0])
                start = end
            yield pd.DataFrame({"key": b["key"], "at": b["at"], "batch": np.concatenate(out)})

    ready = dealt.join(entry, "part").repartition("part").sortWithinPartitions("part", "key", "at", "tokens")
    done = ready.select("part", "key", "at", "tokens", "used_in", "batch_in").mapInPandas(numbered, f"key {kind}, at long, batch long")
    return done.select(F.col("key").alias(group), F.col("at").alias(order), "batch")
