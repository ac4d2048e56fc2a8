"""Merged rows over many parts equal the plain fold."""

import random

import pytest

from reportlake.operators import islands as I

SCHEMA = "scan_id long, pos long, control_id string, body string, continues boolean, end_line long, confidence double"


def fold(rows):
    none = lambda v: (v is not None, v)
    clean = [(s, p, c or "", b or "", bool(k), e, f) for s, p, c, b, k, e, f in rows]
    out, last = [], None
    for x in sorted(clean, key=lambda r: tuple(none(v) for v in r)):
        if last and last[0] == x[0] and (last[4] or (last[2] and last[2] == x[2])):
            ends = [v for v in (last[5], x[5]) if v is not None]
            both = last[6], x[6]
            last[2:] = [last[2] or x[2], f"{last[3]} {x[3]}", False, max(ends, default=None), None if None in both else sum(both) / 2]
        else:
            last = list(x)
            out.append(last)
    return sorted(map(repr, map(tuple, out)))


@pytest.mark.parametrize("part_rows", [1, 3, 10, I.ROWS])
def test_islands_over_parts(spark, part_rows):
    rng = random.Random(part_rows)
    rows = []
    for scan, n, ids in ((1, 60, "ab"), (2, 1, "a"), (None, 30, "abc"), (3, 40, "a"), (4, 50, "abcdefg")):
        rows += [(scan, k // 2 if scan == 4 else k, rng.choice([None, "", *ids]), rng.choice([None, "", "x", "y z"]), rng.choice([None, False, False, True]), rng.choice([None, 1, 9]), rng.choice([None, 0.5, 0.25, 0.75, 0.1])) for k in range(n)]
    rows += rows[:3]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(repr, map(tuple, I.merge_continuations(df, part_rows).collect()))) == fold(rows)
    assert I.merge_continuations(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(300))
def test_places_cover_all_open_rows(seed):
    """Whatever row is open when a part begins, what follows is one of the few places in the table."""
    rng = random.Random(seed)
    n = rng.randrange(1, 9)
    r = I.Report([rng.choice(["", "a", "b"]) for _ in range(n)], [rng.random() < 0.4 for _ in range(n)])
    last, on, own = r.lasts()
    for state in [(o, i) for o in (False, True) for i in ("", "a", "b", "c")]:
        k, *become = r.taken(0, *state)
        starts, *end = r.starts(k)
        assert k in {0, 1, r.run[0], r.run[1] if n > 1 else 1, n}
        assert (starts[-1], *end) == (last[k], on[k], own[k]) if k < n else (starts == [] and become[0] is (state[0] and n == 0))


def test_one_large_report_spreads_over_tasks(spark):
    df = spark.range(300_000).selectExpr("cast(1 as long) as scan_id", "id as pos", "concat('c', cast(id div 3 as string)) as control_id", "'t' as body", "id % 7 = 0 as continues", "id as end_line", "0.5D as confidence")
    out = I.merge_continuations(df, 20_000)
    got = [(r["pos"], r["end_line"]) for r in out.select("pos", "end_line").orderBy("pos").collect()]
    want, last = [], None
    for i in range(300_000):
        if last and (last[2] or last[3] == i // 3):
            last[1:3] = [i, False]
        else:
            last = [i, i, i % 7 == 0, i // 3]
            want.append(last)
    assert got == [(w[0], w[1]) for w in want]
