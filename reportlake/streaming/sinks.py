"""Sinks that a repeated batch does not change: rows of an update-mode stream, and a table of learned patterns with deltas,
compaction and a review queue. All are plain folders named by the batch, so what a batch wrote before it failed is simply
written again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportlake.operators.controls import fold_patterns, learn_patterns
from reportlake.operators.matching import pattern_pairs

STORED = "organization string, pattern string, frequency long, first_seen timestamp, last_seen timestamp"
REVIEW = "organization string, pattern string, other string, similarity double, frequency long"


def update_sink(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch function for update mode: the changed rows of a batch in a folder of its own."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return keep


def latest_rows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest row of each key that an update_sink holds."""
    rows = spark.read.parquet(path)
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("x")).select(*keys, "x.*")


def numbered(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished folders batch=N below path, rising."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    found = [s.getPath() for s in fs.listStatus(where) if s.getPath().getName().startswith("batch=")]
    return sorted(int(p.getName()[6:]) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def dropped(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class PatternTable:
    """Learned patterns below `path`: deltas/batch=N of each batch, bases/batch=N with all up to N, review/batch=N with the
    pairs that batch N queued first.

    Reading folds the newest base and the deltas after it. A base is written every `every` batches; then deltas and bases
    that the base before it already held are removed, so readers of the last two bases are never robbed of a file.
    """

    def __init__(self, path: str, every: int = 10):
        self.path, self.every = path, every

    def _folded(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        bases = [n for n in numbered(spark, f"{self.path}/bases") if upto is None or n <= upto]
        base = bases[-1] if bases else -1
        deltas = [n for n in numbered(spark, f"{self.path}/deltas") if n > base and (upto is None or n <= upto)]
        read = lambda paths: spark.read.schema(STORED).parquet(*paths) if paths else spark.createDataFrame([], STORED)
        stored = read([f"{self.path}/bases/batch={base}"] if bases else [])
        return fold_patterns(stored, read([f"{self.path}/deltas/batch={n}" for n in deltas]))

    def patterns(self, spark: SparkSession) -> DataFrame:
        return self._folded(spark).select("organization", "pattern", "frequency", "first_seen", "last_seen")

    def reviews(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """Each pair that waits for review, once."""
        held = [n for n in numbered(spark, f"{self.path}/review") if before is None or n < before]
        return spark.read.schema(REVIEW).parquet(*[f"{self.path}/review/batch={n}" for n in held]) if held else spark.createDataFrame([], REVIEW)

    def fold(self, batch: DataFrame, batch_id: int) -> None:
        """foreachBatch function: learns the batch's patterns, queues new review pairs of its organizations."""
        spark = batch.sparkSession
        done = numbered(spark, f"{self.path}/bases")
        if done and done[-1] >= batch_id:
            return  # a base holds this batch, so it was finished in full
        learned = learn_patterns(batch).select("organization", "pattern", F.col("frequency").cast("long").alias("frequency"), *[F.col(c).cast("timestamp").alias(c) for c in ("first_seen", "last_seen")])
        learned.write.mode("overwrite").parquet(f"{self.path}/deltas/batch={batch_id}")
        touched = spark.read.schema(STORED).parquet(f"{self.path}/deltas/batch={batch_id}").select("organization").distinct()
        known = self._folded(spark, batch_id).join(touched, "organization", "left_semi")
        pairs = pattern_pairs(known.select("organization", "pattern", "frequency")).where("action = 'needs_review'")
        fresh = pairs.join(self.reviews(spark, batch_id), ["organization", "pattern", "other"], "left_anti")
        fresh.select("organization", "pattern", "other", "similarity", F.col("frequency").cast("long").alias("frequency")).write.mode("overwrite").parquet(f"{self.path}/review/batch={batch_id}")
        if (batch_id + 1) % self.every == 0:
            self.patterns(spark).write.mode("overwrite").parquet(f"{self.path}/bases/batch={batch_id}")
            before = done[-1] if done else -1
            for n in numbered(spark, f"{self.path}/deltas"):
                if n <= before:
                    dropped(spark, f"{self.path}/deltas/batch={n}")
            for n in done[:-1]:
                dropped(spark, f"{self.path}/bases/batch={n}")
