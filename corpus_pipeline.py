"""The corpus pipeline: documents to packed training sequences.

STAGES lists (name, function) in order; a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again for the next stage.
All but the last return the columns of documents.

1. quality: documents that the line CRF scores below its threshold go.
2. exact_dedup: of equal texts, the row with the largest doc_id stays.
3. near_dedup: of each component of texts with similar five-word shingles (0.8 or more), the row with the smallest doc_id stays.
4. secrets: secrets in the texts give way to the name of their kind; all rows stay.
5. packing: the pieces of the texts and their places in sequences of 4096 tokens.

Each stage lowers the session's limit of an Arrow batch (`small_batches`); it stays, as its result is computed later.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vecloom.llm import exact_dedup, near_copies, packing, quality_crf, secret_scan
from vecloom.llm.common import read_table, remove_folder, shared_folder, small_batches
from vecloom.llm.queries import vocabulary


def bounded(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """stage, whose texts reach Python workers in small batches."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@bounded
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_crf.drop_bad(docs, quality_crf.train(docs, read_table(spark, sf_dir, "labels")))


@bounded
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


@bounded
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.drop_near_copies(docs)


@bounded
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact_documents(docs)


@bounded
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("secrets", secrets), ("packing", pack)]

#: SQL can't express the classifier, the components, the grammars or the tokenizer; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents; what comes before it is written to the shared folder."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:  # what a stage wrote goes when the next one has read it
            remove_folder(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
