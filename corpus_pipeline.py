"""A training corpus from `documents`: toxic texts go, then copies, near copies and repeated passages, and the rest is packed.

Every stage but the last returns the columns of its docs, further ones included. Defined cases of the stages: a null text is an empty
one and is never toxic; of equal texts, empty ones too, one row stays, whatever its id; rows with a null doc_id stay in the toxicity and
repeats stages and lose to others among copies; texts emptied by the repeats stage stay and are packed as their end token; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tierscope.llm import exact_dedup, near_copies, packing, suffix_dedup, toxicity
from tierscope.llm.shared import stage, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.drop_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("simhash", without_near_copies),
    ("suffix_dedup", without_repeats),
    ("packing", packed),
]

#: The stages are a trained model, fingerprints and a linear program: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on what the one before kept, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, work in STAGES[:-1]:
        docs = stage(work(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
