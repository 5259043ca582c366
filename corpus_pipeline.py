"""Corpus pipeline: language ID, line dedup, near-duplicate join, PII surrogates, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept; all but
the last return the columns of ``documents``.  :func:`run` writes each stage's result as Parquet
into the shared checkpoint folder and reads it again as the next one's input.

Edge cases: a null text has no letter, so language ID drops it, as it does an empty one; very long texts are
processed whole; rows that repeat a text leave one row, the one of the smallest doc_id; columns beside those of
``documents`` pass through all stages but the last, also ones with names that the stages use themselves; an empty
table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from churnkit.llm import jaccard_join, language_crf, line_dedup, packing, pii
from churnkit.llm.common import documents, written
from churnkit.llm.queries import pii_key


def _long_texts(spark: SparkSession) -> None:
    """Arrow batches of 1,000 rows unless the session sets another number than Spark's own: rows are whole texts, and a task
    holds several copies of a batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a letter, or where no language holds half of the words, go."""
    _long_texts(spark)
    return language_crf.confident(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in 10 documents or more leave their texts."""
    _long_texts(spark)
    return line_dedup.with_lines_dropped(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays."""
    _long_texts(spark)
    return jaccard_join.one_of_each(docs)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced in the texts."""
    _long_texts(spark)
    return pii.with_surrogates(docs, pii_key(spark))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in the training sequences."""
    _long_texts(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"),
                                  ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates),
    ("pii_surrogates", surrogates),
    ("best_fit_packing", best_fit_packing),
]

#: models, surrogates and token ids are beyond SQL; tests hold the rows against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
