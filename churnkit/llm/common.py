"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Cuts the lineage with files that every executor sees, so a lost executor never
    recomputes what lies before.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(docs: DataFrame, text_col: str = "text") -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(docs[text_col].cast("string"), F.lit(""))


def keeping_columns(stage):
    """For a stage that returns its table's columns: columns with a leading ``__`` bear other names meanwhile,
    so they cannot clash with a stage's own."""
    @wraps(stage)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        own = {c: f"c{i}_{uuid.uuid4().hex}" for i, c in enumerate(docs.columns) if c.startswith("__")}
        if not own:
            return stage(docs, *args, **options)
        out = stage(docs.withColumnsRenamed(own), *args, **options)
        return out.withColumnsRenamed({new: old for old, new in own.items()}).select(*docs.columns)
    return run


def content_key(text: Column) -> list[Column]:
    """128 bits that stand for a text where rows need a key and doc_id may repeat or be null."""
    return [F.xxhash64(text).alias("__k1"), F.xxhash64(text, F.lit(7)).alias("__k2")]


def same_key(left: DataFrame, right: DataFrame, cols) -> Column:
    """Null-safe equality over the named columns."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & left[c].eqNullSafe(right[c])
    return cond


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def batches(it: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``rows`` rows, so that working memory follows few texts."""
    for b in it:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
