"""Embedding whitening: projections on the leading principal components, scaled to variance one.

Entries are fixed-point whole numbers, so counts, sums and deviations are exact at any order of summing. Spark sums the
covariance from blocks of rows: each task gives one partial matrix, added up row of the matrix by row. What reaches the
driver is one d x d matrix, whatever the number of vectors; its leading eigenpairs come by spectrum slicing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .spectrum import leading_eigenpairs

COMPONENTS = 16
OFFSET = 1_000_000
#: Entries beyond this have no whole-number form of 64 bits with room for sums.
LARGEST = float(1 << 44)


def whole(vector: Column) -> Column:
    """x = floor(64 c) + 1000000 of each entry; null unless all entries are numbers of less than 2^44 in size."""
    v = vector.cast("array<double>")
    fits = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    return F.when(fits & (F.size(v) > 0), F.transform(v, lambda c: F.floor(64 * c).cast("long") + OFFSET))


def matrix_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of an Arrow list column as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def summed_matrix(rows: DataFrame, of_block, kind: str) -> np.ndarray:
    """Sum over all blocks of rows (x) of the matrices of_block(x), each task adding up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                part = of_block(matrix_of(b.column(0)))
                total = part if total is None else total + part
        if total is not None:
            at = np.repeat(np.arange(total.shape[0]), total.shape[1])
            yield pa.RecordBatch.from_pydict({"i": at, "j": np.tile(np.arange(total.shape[1]), total.shape[0]), "value": total.ravel()})

    parts = rows.select("x").mapInArrow(run, f"i long, j long, value {kind}")
    sums = parts.groupBy("i", "j").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros((sums["i"].max() + 1, sums["j"].max() + 1) if len(sums) else (0, 0), np.int64 if kind == "long" else np.float64)
    out[sums["i"], sums["j"]] = sums["value"]
    return out


def whiten(vectors: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each row and component.

    Rows whose vector is null, empty, or holds a null, non-finite or huge (2^44 or more) entry take no part; nor do rows of
    another length than most rows have (of equally common lengths the longest counts). Everything is fitted on the distinct
    whole-number vectors, n of them; repeated rows and ids are each returned. Components are numbered from 1 by falling
    eigenvalue, at most as many as there are dimensions; those without variance, which cannot be scaled to one, are not
    returned, so a single distinct vector gives no rows, as does an empty table. A deviation beyond 64 bits is null. Other
    columns, whatever their names, are not looked at.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", whole(F.col(vector)).alias("x")).where("x is not null")
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", "d")).alias("best")).first()["best"]
    d = lengths["d"] if lengths else 0
    rows = rows.where(F.size("x") == d)
    fit = written(rows.select("x").distinct(), "fit-vectors")
    n = fit.count()
    sums = summed_matrix(fit, lambda x: x.sum(axis=0, dtype=np.int64)[None, :], "long")
    sums = sums[0] if len(sums) else np.zeros(d, np.int64)
    # n*x - S is exact; divided by n it is the centred entry, rounded once
    shift, rest = np.divmod(sums, max(n, 1))

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - shift).astype(np.float64) - rest / max(n, 1)

    gram = lambda c: c.T @ c
    cov = summed_matrix(fit, lambda x: gram(centred(x)), "double") / max(n, 1) if n else np.zeros((0, 0))
    values, basis = leading_eigenpairs(cov, min(components, d))
    k = len(values)
    onto = basis / np.sqrt(values) if k else np.zeros((d, 0))
    own = summed_matrix(fit, lambda x: gram(centred(x) @ onto), "double") / n if k else np.zeros((0, 0))
    error = float(np.abs(own - np.eye(k)).max()) if k else 0.0
    explained = [float(e) for e in values / np.trace(cov)] if k else []

    def deviations(x: np.ndarray) -> list[int | None]:
        y = (x - shift) * float(n)
        if np.abs(y).max(initial=0.0) ** 2 * d < 2.0**62:
            return ((n * (x - shift) - rest) ** 2).sum(axis=1).tolist()
        exact = [sum((n * int(e - s) - int(r)) ** 2 for e, s, r in zip(row, shift, rest, strict=True)) for row in x]
        return [e if e < 1 << 63 else None for e in exact]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and k:
                x = matrix_of(b.column(1))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(deviations(x), pa.int64()), pa.array(list(centred(x) @ onto), pa.list_(pa.float64()))],
                    ["vec_id", "deviation", "w"],
                )

    kind = rows.schema["vec_id"].dataType.simpleString()
    done = rows.mapInArrow(project, f"vec_id {kind}, deviation long, w array<double>")
    share = F.array(*map(F.lit, explained)).cast("array<double>")
    return done.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
