"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white space characters that part words.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. In local mode, where driver and executors are one process, one of our own is
    made if none is configured; a cluster must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the shared folder and read again: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of a text; none for a null or blank one."""
    bare = F.btrim(text_or_empty(text), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def most_frequent(counts: DataFrame, key: str, limit: int) -> DataFrame:
    """The rows of counts (with n > 0) in the highest frequency bands, sixteen to a doubling, that together hold at most
    `limit` rows, and of the band that does not fit whole about as many as do, by a hash of `key`.

    Only the bands' sizes reach the driver, and whoever collects the rows gets about `limit`, however large the table and
    however many its partitions are.
    """
    band = F.floor(F.log2("n") * 16).cast("int")
    sizes = sorted(((r["band"], r["size"]) for r in counts.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("size")).collect()), reverse=True)
    held, chosen = 0, F.lit(False)
    for at, size in sizes:
        if held + size > limit:
            share = int(0.9 * (limit - held) / size * (1 << 31))
            return counts.where(chosen | ((band == at) & (F.pmod(F.xxhash64(key), F.lit(1 << 31)) < share)))
        held, chosen = held + size, band >= at
    return counts
