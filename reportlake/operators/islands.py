"""Rows that go on into the next ones, merged in order, over reports of any size.

Whether a row joins the running one depends on what that one has become, so this looks like a fold; but once a row starts
anew, all that follows is settled by it. A part of a report (rows are dealt by ranges) therefore needs to know little of the
row that is open when it begins: that row takes in none of the part's rows, or the first, or a run of equal ids after them,
and what follows from each of these few places is known by pointers to next starts. One pass over a short row for each part
settles what is open where; then all parts name the start of each row's island at once, and islands are put together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batching import ROWS, group_ends, whole_parts
from .linking import written

ORDER = ["pos", "control_id", "body", "continues", "end_line", "confidence"]
#: Rows of a part in the name of an island's start.
WIDE = 1 << 33


class Report:
    """Rows of one report within a part: ids, whether they go on, and where their islands end."""

    def __init__(self, ids: list[str], goes_on: list[bool]):
        self.ids, self.goes_on, self.n = ids, goes_on, len(ids)
        self.run = list(range(1, self.n + 1))
        for k in range(self.n - 2, -1, -1):
            if ids[k] and ids[k] == ids[k + 1]:
                self.run[k] = self.run[k + 1]

    def taken(self, k: int, goes_on: bool, own: str) -> tuple[int, bool, str]:
        """First row from k on that a row open before k does not take in, and what that row has become."""
        if goes_on and k < self.n:
            k, goes_on, own = k + 1, False, own or self.ids[k]
        if not goes_on and own and k < self.n and self.ids[k] == own:
            k = self.run[k]
        return k, goes_on, own

    def starts(self, k: int) -> tuple[list[int], bool, str]:
        """Starts of the islands from row k on, and what the last one has become at the end."""
        out, state = [], (False, "")
        while k < self.n:
            out.append(k)
            k, *state = self.taken(k + 1, self.goes_on[k], self.ids[k])
        return out, *state

    def lasts(self) -> tuple[list[int], list[bool], list[str]]:
        """For a start at each row: the last island that follows from it, and what that has become at the end."""
        last, on, own = list(range(self.n)), [False] * self.n, [""] * self.n
        for k in range(self.n - 1, -1, -1):
            nxt, on[k], own[k] = self.taken(k + 1, self.goes_on[k], self.ids[k])
            if nxt < self.n:
                last[k], on[k], own[k] = last[nxt], on[nxt], own[nxt]
        return last, on, own


def merge_continuations(chunks: DataFrame, part_rows: int = ROWS) -> DataFrame:
    """Rows of a report in order (by pos and then all columns): a row joins the running one if that continues or both have the
    same id. Texts are joined by blanks, the end is the largest, the confidence the pairwise mean, null if one is; the first id
    counts; a merged row no longer continues.

    chunks: scan_id, pos, control_id, body, continues, end_line, confidence; null ids and texts count as empty, a null
    `continues` as false, rows without a report as one report. Other columns are dropped. An empty table stays empty.
    """
    kind = chunks.schema["scan_id"].dataType.simpleString()
    own = chunks.select(
        "scan_id", F.col("pos").cast("long").alias("pos"), F.coalesce("control_id", F.lit("")).alias("control_id"), F.coalesce("body", F.lit("")).alias("body"),
        F.coalesce("continues", F.lit(False)).alias("continues"), F.col("end_line").cast("long").alias("end_line"), F.col("confidence").cast("double").alias("confidence"),
    )
    parts = max(1, -(-own.count() // part_rows))
    dealt = own.repartitionByRange(parts, "scan_id", "pos").withColumn("part", F.spark_partition_id())
    dealt = written(dealt, "continuation-parts")
    # texts stay behind until islands are known; a row is its place in the part's order
    place = F.expr(f"row_number() over (partition by part order by scan_id, {', '.join(ORDER)})") - 1
    dealt = written(dealt.withColumn("no", place), "continuation-rows")
    slim = dealt.select("part", "no", "scan_id", "control_id", "continues")
    by_part = slim.repartition("part").sortWithinPartitions("part", "no")

    def reports(b: pd.DataFrame) -> Iterator[tuple[int, Report]]:
        keys = b["scan_id"].astype(object).where(b["scan_id"].notna(), None).tolist()
        ids, on, start = b["control_id"].tolist(), b["continues"].tolist(), 0
        for end in group_ends(keys):
            yield start, Report(ids[start:end], on[start:end])
            start = end

    def summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in whole_parts(batches):
            all_reports = list(reports(b))
            start, end_report = all_reports[-1]
            starts, on, own = end_report.starts(0)
            first = all_reports[0][1]
            last, ons, owns = first.lasts()
            places = sorted({k for k in (0, 1, first.run[0], first.run[1] if first.n > 1 else 1) if k < first.n})
            keys = b["scan_id"].astype(object).where(b["scan_id"].notna(), None)
            yield pd.DataFrame({
                "part": [int(b["part"].iloc[0])], "lo": [keys.iloc[0]], "hi": [keys.iloc[-1]], "one": [len(all_reports) == 1], "n": [first.n],
                "ids": [first.ids[:2]], "runs": [first.run[:2]], "places": [places], "last": [[last[k] for k in places]], "ons": [[ons[k] for k in places]], "owns": [[owns[k] for k in places]],
                "end_last": [start + starts[-1]], "end_on": [on], "end_own": [own],
            })

    shape = f"part int, lo {kind}, hi {kind}, one boolean, n long, ids array<string>, runs array<long>, places array<long>, last array<long>, ons array<boolean>, owns array<string>, end_last long, end_on boolean, end_own string"
    table = written(by_part.mapInPandas(summaries, shape), "continuation-tables")

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, open_ = None, None
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                lo = None if pd.isna(r.lo) else r.lo
                if open_ and not (lo is key or lo == key):
                    open_ = None
                out.append((r.part, *(open_ or (None, None, None))))
                if open_ and r.one:
                    name, on, own = open_
                    k = 0
                    if on:
                        k, on, own = 1, False, own or r.ids[0]
                    if own and k < r.n and r.ids[k] == own:
                        k = r.runs[k]
                    at = list(r.places).index(k) if k < r.n else None
                    open_ = (name, on, own) if at is None else (r.part * WIDE + int(r.last[at]), bool(r.ons[at]), r.owns[at])
                else:
                    open_ = (r.part * WIDE + r.end_last, bool(r.end_on), r.end_own)
                key = None if pd.isna(r.hi) else r.hi
            yield pd.DataFrame(out, columns=["part", "open", "open_on", "open_own"]).astype({"open": "Int64", "open_on": "boolean"})

    # a short row for each part, in order
    entry = written(table.coalesce(1).sortWithinPartitions("part").mapInPandas(entries, "part int, open long, open_on boolean, open_own string"), "continuation-entries")

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in whole_parts(batches):
            part, name = int(b["part"].iloc[0]), []
            for start, report in reports(b):
                k = 0
                if start == 0 and not pd.isna(b["open"].iloc[0]):
                    k = report.taken(0, bool(b["open_on"].iloc[0]), b["open_own"].iloc[0])[0]
                    name += [int(b["open"].iloc[0])] * k
                starts = report.starts(k)[0]
                for s, e in zip(starts, [*starts[1:], report.n][: len(starts)], strict=True):
                    name += [part * WIDE + start + s] * (e - s)
            yield pd.DataFrame({"part": b["part"], "no": b["no"], "island": name})

    ready = slim.join(entry, "part").repartition("part").sortWithinPartitions("part", "no")
    names = ready.mapInPandas(named, "part int, no long, island long")
    rows = dealt.join(written(names, "continuation-names"), ["part", "no"])
    whole = rows.groupBy("island").agg(F.sort_array(F.collect_list(F.struct("part", "no", "scan_id", *ORDER))).alias("xs"))
    x = F.get("xs", F.lit(0))
    ids = F.filter(F.transform("xs", lambda r: r["control_id"]), lambda i: i != "")
    mean = F.aggregate(F.slice("xs", F.lit(2), F.size("xs")), x["confidence"], lambda a, r: (a + r["confidence"]) / 2)
    return whole.select(
        x["scan_id"].alias("scan_id"), x["pos"].alias("pos"), F.coalesce(F.get(ids, F.lit(0)), F.lit("")).alias("control_id"), F.array_join(F.transform("xs", lambda r: r["body"]), " ").alias("body"),
        (x["continues"] & (F.size("xs") == 1)).alias("continues"), F.array_max(F.transform("xs", lambda r: r["end_line"])).alias("end_line"), mean.alias("confidence"),
    )
