"""What the operators of this package share: staging in the cluster's shared folder, batches, names."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staged import shared_dir

#: Rows in one Arrow batch: whole texts can be long, so far fewer than Spark's 10,000.
BATCH_ROWS = 1000


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df as a table written once to the shared folder: cuts lineage, and survives a lost executor."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_ranges(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df staged in ranges of order, each row with the number of its range (`part`, growing with the order): what a sweep
    of the whole order takes along from range to range is then a small table by part."""
    return stage(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), name)


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session, unless the session already asks for smaller ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str, folder: str | None = None) -> str:
    """Where a public tokenizer's file lies: in folder, or where the public_tokenizers package has it."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def documents_of(df: DataFrame) -> DataFrame:
    """doc_id and text alone, so that further columns can't clash with an operator's own; a null text is empty."""
    return df.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def rows_of(batch):
    """The rows of an Arrow batch as dicts, one at a time, so that only one row's blobs are copied."""
    for i in range(batch.num_rows):
        yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}
