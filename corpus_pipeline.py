"""Corpus pipeline: quality, near-duplicates, test items, personal data, tokens.

Every stage is (spark, docs, sf_dir) -> DataFrame; `run` writes its rows as Parquet in the shared folder
and reads them again as the next stage's documents. All but the last return the columns of documents.
SQL can't express the stages (trained weights, hashes, tokens), so ORACLE_SQL is None; the tests hold
`run` against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pitchload.llm import bm25_decon, pii_anchor, probminhash, sp_dropout, weak_quality
from pitchload.session import cut


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: rows that go to a Python worker at once; whole texts are long, and the default of 10 000 would hold
#: tens of MB on both sides
BATCH_ROWS = 1_000


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for junk or toxic go."""
    _small_batches(spark)
    return weak_quality.accepted(docs, _table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that of the smallest doc_id."""
    _small_batches(spark)
    return probminhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    _small_batches(spark)
    return bm25_decon.without_test_items(docs, _table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to its kind in brackets; n_chars follows."""
    _small_batches(spark)
    return pii_anchor.redacted(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their number, digest and the round trip's result."""
    _small_batches(spark)
    return sp_dropout.encode(docs)


STAGES = [("quality classifier", quality), ("minhash near-dedup", near_dedup), ("benchmark decontamination", decontaminate),
          ("personal data", redact), ("sentencepiece tokens", tokenize)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
