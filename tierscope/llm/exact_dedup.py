"""Exact dedup by a tree-merge of sorted digest runs, in DataFrame operations alone.

Every row falls in one of `runs` runs. A run is the sorted list of the digests of its rows, each with
the winning identifier and a row count. In each binomial round `fan_in` neighbouring runs meet in
their parent: Spark sorts and merges them (the aggregate keeps a struct, so Spark plans a sort-based
aggregate: sorted partial runs, multiway merge) and only one entry per digest goes up. A digest that a
third of all rows share therefore sends at most one entry per run to the next level. On the way down
the root's winner goes to each run's entry, and from there to the rows, so no join sees more than
1/runs of a hot group under one key.

Equality is checked on SHA-256, byte length and XXH64 together.

Defined cases: a null text is the empty text. Rows that repeat a doc_id each count and are each
returned; those that carry the winning id are all `kept`. A null doc_id loses to any other; a group
that has only null ids keeps them. An empty table gives an empty result. Other columns are ignored.
keep_one goes by rows: a number of the row's own breaks ties, and exactly one row of each text stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage

KEY = ["sha", "n_bytes", "check"]


def digests(rows: DataFrame, runs: int, own: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return rows.select(
        *own,
        F.pmod(F.xxhash64(*own), F.lit(runs)).cast("int").alias("run"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"),
        F.octet_length(text).alias("n_bytes"),
        F.xxhash64(text).alias("check"),
    )


def tree_merge(leaves: DataFrame, runs: int = 64, fan_in: int = 8, keep: str = "max", own: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """(entries of the runs, entries of the root) of digest rows; keep: 'max' or 'min' identifier; own: it and what breaks ties."""
    best = F.max if keep == "max" else F.min
    one = F.struct(*own)
    if keep == "min":  # nulls last
        one = F.struct(F.col("doc_id").isNull().alias("none"), *own)
    level = leaves.groupBy("run", *KEY).agg(best(one).alias("best"), F.count(F.lit(1)).alias("n"))
    entries = level.select("run", *KEY)
    while runs > 1:
        runs = -(-runs // fan_in)
        level = level.groupBy(F.floor(F.col("run") / fan_in).cast("int").alias("run"), *KEY).agg(best("best").alias("best"), F.sum("n").alias("n"))
    return entries, level.select(*KEY, F.col("best.doc_id").alias("keep_id"), *(f"best.{c}" for c in own[1:]), F.col("n").alias("group_size"))


def exact_dedup(docs: DataFrame, runs: int = 64, fan_in: int = 8, keep: str = "max") -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    leaves = stage(digests(docs, runs), "digests")
    entries, root = tree_merge(leaves, runs, fan_in, keep)
    told = entries.join(root, KEY)
    return leaves.join(told, ["run", *KEY]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, runs: int = 64, fan_in: int = 8, keep: str = "max") -> DataFrame:
    """The rows of docs that stay, one of each text, with their own columns."""
    own = ("doc_id", "_row")
    rows = stage(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    kept = tree_merge(digests(rows, runs, own), runs, fan_in, keep, own)[1].select("_row")
    return rows.join(kept, "_row", "left_semi").drop("_row")
