"""The corpus pipeline: documents to a mixed training set.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before
kept; :func:`run` writes each stage as Parquet in the shared checkpoint folder
and reads it again.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, langid, mixing, pii, simhash
from tessera.llm.common import shared_folder, ship, table
from tessera.llm.queries import PII_KEY


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents and drops those that the model rejects, and texts that are null or have no letter."""
    ship(spark)
    return langid.confident(docs, langid.fit(docs.where(~langid.held_out())))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: that with the smallest id, told apart by id and fingerprint."""
    return simhash.survivors(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; null and empty texts hold none and stay."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by surrogates; ``n_chars`` follows the new text and is null with it."""
    return pii.pseudonymise(docs, PII_KEY).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives each document its place in the mix of sources; documents without a source are one of their own."""
    return mixing.mix(docs, carry=True)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
]

ORACLE_SQL = None  # SQL can't express the language model, the fingerprints or the surrogates: see tests/llm


def _remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder wherever Spark's file systems keep it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.

    A stage's folder goes once the next one is written; the last, which the
    result reads, stays in the checkpoint folder.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        if before:
            _remove(spark, before)
        docs, before = spark.read.parquet(at), at
    return docs
