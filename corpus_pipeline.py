"""From raw documents to token ids: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportlake.llm import bpe, classifier, jaccard_join, mixing, surrogates
from reportlake.llm.common import BLANKS, table, text_or_empty, written
from reportlake.llm.queries import bpe_digest

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It is fitted on the labelled ones among docs. Null texts are judged
    as empty ones, repeated rows alike; without labels of both kinds all stay; an empty table stays empty; columns beyond
    those of documents are dropped, here and in all stages."""
    docs = docs.select(*COLUMNS)
    model = classifier.fit(docs, table(spark, sf_dir, "labels"))
    scored = classifier.score(docs, model, keep=tuple(COLUMNS))
    # one row or none from a generator: as a filter the score would be pushed down and worked out for each weight anew
    row = F.when(classifier.predicted() == 1, F.array(F.struct(*COLUMNS))).otherwise(F.array())
    return scored.select(F.explode(row).alias("row")).select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked on five-word shingles at 0.8 one row stays: that of the smallest id, a missing id
    last. Rows are judged each by its own text, also where an id repeats or is missing; equal rows are one. Blank rows
    without an id link with nothing and stay."""
    docs = docs.select(*COLUMNS)
    groups = written(jaccard_join.jaccard_rows(docs, percent=80, width=5), "groups")
    gone = groups.where("key <> first_key").select("key").distinct()
    nameless = F.col("doc_id").isNull() & (F.btrim(text_or_empty(F.col("text")), F.lit(BLANKS)) == "")
    kept = docs.where(~nameless).withColumn("key", jaccard_join.row_key()).join(gone, "key", "left_anti")
    # of rows of equal id and text the one of the least other columns stays; only texts whose key repeats are dealt by it
    again = written(kept.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("key"), "repeated-keys")
    one = kept.join(again, "key", "left_semi").groupBy("key").agg(F.min(F.struct("lang", "source", "n_chars", "doc_id", "text")).alias("row")).select("row.*")
    kept = kept.join(again, "key", "left_anti").select(*COLUMNS).unionByName(one.select(*COLUMNS))
    return kept.unionByName(docs.where(nameless))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by surrogates; n_chars follows the new text where there was any. Null and empty
    texts stay as they are, repeated rows are rewritten alike."""
    new = surrogates.surrogate_text(docs.select(*COLUMNS), surrogates.configured_key(spark))
    return new.withColumn("n_chars", F.when(F.col("_n_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: each document once, those of small sources again as their budget asks. Null sources
    are one source; null texts count no tokens; equal ids of a source are taken together."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests and the packed token ids of every row, in no order. Null texts count as empty ones."""
    coded = bpe.bpe_round_trip(docs.select("doc_id", "text"))
    return bpe_digest(coded, keep=("ids",))


STAGES = [("quality_classifier", quality), ("jaccard_join", near_copies), ("pii_surrogates", personal_data), ("mixing", mixture), ("bpe", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
