"""A corpus pipeline of five stages, each written as Parquet and read again by the next.

STAGES lists (name, function); a function takes (spark, docs, sf_dir). All stages
but the last return the columns of documents. run() applies them in order:

1. quality: documents that the quality classifier scores under 0.7 go.
2. near copies: one document of each component of the n-gram Jaccard join stays.
3. decontamination: documents in which a benchmark item is found go.
4. PII: personal data in texts is replaced, and so are terms that disclose it.
5. pieces: what is left is encoded and decoded.

Nulls in any column are kept as they are; a null text counts as empty, and is judged as one. Rows without an id take part
in all stages; of rows that are equal in text one stays, whatever their ids. Texts of any length are taken whole. An empty
table gives no rows. Further columns of any name pass through all stages but the last, which returns ids, counts and digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm import decontaminate, jaccard, pieces, pii, quality
from weirflow.llm.common import dropped, written
from weirflow.llm.queries import piece_model_path, table


#: Rows of an Arrow batch. Batches of whole texts, on both sides of a Python worker, are what an executor's memory beyond
#: its heap is spent on.
BATCH_ROWS = "1000"
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches of a stage. Stages are executed after they return, so it stays set; run() restores it."""
    spark.conf.set(_BATCH_SETTING, BATCH_ROWS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects (a score under 0.7)."""
    small_batches(spark)
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each component of near copies."""
    small_batches(spark)
    return jaccard.kept(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which a benchmark item is found."""
    small_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and the terms that disclose it; n_chars follows the new text."""
    return pii.sanitised(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes the documents that are left."""
    small_batches(spark)
    return pieces.encode_documents(docs, piece_model_path())


STAGES = [("quality", quality_stage), ("near copies", near_copies_stage), ("decontamination", decontamination_stage), ("pii", pii_stage), ("pieces", pieces_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each one's result written and read again."""
    docs, before = table(spark, sf_dir, "documents"), spark.conf.get(_BATCH_SETTING)
    last = None
    try:
        for name, stage in STAGES:
            docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
            if last is not None:
                dropped(last)
            last = docs
    finally:
        spark.conf.set(_BATCH_SETTING, before)
    return docs


#: No SQL: the classifier, the edit distances and the merges aren't expressible; tests hold run() against brute force.
ORACLE_SQL = None
