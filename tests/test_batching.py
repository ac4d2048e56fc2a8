"""Batches over many parts equal the plain fold."""

import random

import numpy as np
import pytest

from reportlake.operators import batching as B


def fold(rows, most):
    out, last, used, batch, started = [], None, 0, 0, False
    for key, at, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2] or 0)):
        if not started or key != last:
            last, used, batch, started = key, 0, 0, True
        t = t or 0
        if used > 0 and used + t > most:
            batch, used = batch + 1, 0
        used += t
        out.append((key, at, batch))
    return out


@pytest.mark.parametrize("seed", range(200))
def test_reactions_are_those_of_the_fold(seed):
    rng = random.Random(seed)
    t = np.array([rng.choice([0, 0, 1, 2, 5, rng.randrange(30)]) for _ in range(rng.randrange(1, 25))], np.int64)
    most = rng.choice([1, 7, 12, 40])
    bounds, fills, counts = B.reactions(t, most)
    for u in range(1, most + 20):
        _, used, batch = B.greedy(t, most, u, 0)
        hit = next((k for k, b in enumerate(bounds) if u > b), None)
        assert (used, batch) == ((u + int(t.sum()), 0) if hit is None else (fills[hit], counts[hit]))


@pytest.mark.parametrize("part_rows", [7, 40, B.ROWS])
def test_batches_over_parts(spark, part_rows):
    rng = random.Random(part_rows)
    rows = []
    for key, n in (("a", 90), ("b", 1), (None, 40), ("c", 5), ("d", 130)):
        rows += [(key, k // 2 if key == "a" else k, rng.choice([None, 0, 0, 3, 9, 25, 60])) for k in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "source string, seq long, tokens long")
    got = [tuple(r) for r in B.token_batches(df, "source", "seq", "tokens", 50, part_rows).collect()]
    assert sorted(got, key=repr) == sorted(fold(rows, 50), key=repr)
    assert B.token_batches(df.limit(0), "source", "seq", "tokens", 50).count() == 0


def test_one_huge_group_spreads_over_tasks(spark):
    df = spark.range(1_000_000).selectExpr("cast(1 as int) as g", "id as seq", "pmod(xxhash64(id), 400) as tokens")
    out = B.token_batches(df, "g", "seq", "tokens", 20_000)
    got = out.orderBy("seq").toPandas()["batch"].to_numpy()
    tokens = df.orderBy("seq").toPandas()["tokens"].to_numpy()
    assert (got == B.greedy(tokens, 20_000)[0]).all() and got[-1] > 5000
    parts = B.written(df, "x").repartitionByRange(10, "g", "seq").selectExpr("spark_partition_id() as p").groupBy("p").count().collect()
    assert len(parts) == 10 and max(r["count"] for r in parts) < 200_000
