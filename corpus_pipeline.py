"""The corpus pipeline: toxic documents out, one of each near-duplicate group, secrets masked, sources
mixed to their targets, and the rest packed into training sequences.

A stage takes (spark, docs, sf_dir) and returns what it keeps; all but the last return the columns of
documents. Nulls: a null text is an empty text to every stage, a null id or source stays a row of its own.
An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconlake.llm.base import materialize, table
from beaconlake.llm.mixing import repeat_documents
from beaconlake.llm.packing import pack
from beaconlake.llm.secrets import redacted
from beaconlake.llm.simhash import representatives
from beaconlake.llm.toxicity import drop_toxic

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the word model, learnt from labels, rejects."""
    return drop_toxic(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates one row, that with the smallest id."""
    return representatives(docs.select(*COLUMNS))


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secret values in the texts; n_chars follows. Texts without secrets stay as they are."""
    masked = redacted(docs.select(*COLUMNS, F.col("text").alias("before_")))
    changed = ~F.col("text").eqNullSafe(F.col("before_"))
    return masked.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that the sources give the words of their weights."""
    return repeat_documents(docs.select(*COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences."""
    return pack(docs.select(*COLUMNS))


STAGES = [
    ("toxicity", toxicity),
    ("simhash_dedup", simhash_dedup),
    ("secret_masking", secret_masking),
    ("source_mixing", source_mixing),
    ("packing", packing),
]

#: Classifier, fingerprints and token ids have no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written as a table before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
