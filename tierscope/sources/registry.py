"""Products, SKU links and the token index as one store of versions: what a batch records is seen whole or not at all.

A batch writes the three tables to a folder that nobody reads yet, then one row to `commits`: the new version and the folders that make it up.
A single file appears at once, so readers see the version before or the one after. What was recorded is folded when it is read: the first record of
a product gives its fields, the latest time its last_seen_at, the first link of a SKU stays, tokens are distinct; recording a batch again changes
nothing. After some batches the folders are folded into one, which is a new version by the same switch. One writer at a time, as a stream's batches are."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .staged import staged

FIELDS = ["method", "confidence", "title", "brand", "size_text", "upc", "first_seen_at"]
#: version and position tell which record was first.
TABLES = {
    "products": "canonical_id string, method string, confidence double, title string, brand string, size_text string, upc string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, version long, position long",
    "links": "sku_key string, retailer string, retailer_sku string, canonical_id string, version long, position long",
    "tokens": "token string, canonical_id string",
}
COMMITS = "version long, folders array<string>"


def _head(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """The last version and its folders; there are few, since they are folded."""
    try:
        top = spark.read.schema(COMMITS).parquet(f"{path}/commits").agg(F.max(F.struct("version", "folders")).alias("c")).first()["c"]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        top = None
    return (top["version"], list(top["folders"])) if top else (0, [])


def _commit(spark: SparkSession, path: str, version: int, folders: list[str]) -> None:
    spark.createDataFrame([(version, folders)], COMMITS).coalesce(1).write.mode("append").parquet(f"{path}/commits")


def _folded(name: str, rows: DataFrame) -> DataFrame:
    order = F.struct("version", "position")
    if name == "tokens":
        return rows.distinct()
    key, rest = ("canonical_id", FIELDS) if name == "products" else ("sku_key", ["retailer", "retailer_sku", "canonical_id"])
    latest = [F.max("last_seen_at").alias("last_seen_at")] if name == "products" else []
    once = rows.groupBy(key).agg(F.min_by(F.struct(*rest, "version", "position"), order).alias("r"), *latest)
    return once.select(key, "r.*", *(["last_seen_at"] if latest else []))


def _read(spark: SparkSession, path: str, folders: list[str], name: str) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], TABLES[name])
    return spark.read.schema(TABLES[name]).parquet(*[f"{path}/data/{f}/{name}" for f in folders])


def _write(tables: dict[str, DataFrame], path: str) -> str:
    """The folder that holds the tables; it counts once a version names it."""
    folder = uuid.uuid4().hex
    for name, rows in tables.items():
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(TABLES[name])]
        rows.select(columns).write.parquet(f"{path}/data/{folder}/{name}")
    return folder


def tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """products, links and tokens as of the last version; empty tables where nothing was recorded."""
    _, folders = _head(spark, path)
    return {name: _folded(name, _read(spark, path, folders, name)) for name in TABLES}


def record(spark: SparkSession, path: str, seen: DataFrame, most: int = 16) -> int:
    """Records sightings(position, canonical_id, method, confidence, title, brand, size_text, upc, seen_at, sku_key, retailer, retailer_sku, tokens)
    in the order of position, and gives the version that shows them. Rows without an id, or without a SKU, add to the other tables alone.
    most: folders that a version may be made of."""
    version, folders = _head(spark, path)
    rows = staged(seen.withColumn("version", F.lit(version + 1)), "seen")
    known = rows.where(F.col("canonical_id").isNotNull())
    new = {
        "products": _folded("products", known.withColumns({"first_seen_at": F.col("seen_at"), "last_seen_at": F.col("seen_at")})),
        "links": _folded("links", known.where(F.col("sku_key").isNotNull())),
        "tokens": known.select(F.explode("tokens").alias("token"), "canonical_id").distinct(),
    }
    live = [*folders, _write(new, path)]
    _commit(spark, path, version + 1, live)
    if len(live) > most:
        whole = _write({name: _folded(name, _read(spark, path, live, name)) for name in TABLES}, path)
        _commit(spark, path, version + 2, [whole])
        return version + 2
    return version + 1
