"""Export files: JSON that is a bare array, {results}, or [{results}], decoded to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REQUIRED = ["observation_id", "schema_version", "panelist_id", "observed_at", "retailer", "retailer_sku", "title", "currency", "fulfillment", "session_state", "surface", "device", "adapter", "client_version", "cell_key", "received_at"]
OPTIONAL = ["retailer_store_id", "store_label", "upc", "zip3"]
ROW = ", ".join([f"{c} string" for c in REQUIRED + OPTIONAL] + ["price_minor string", "is_estimate string", "clean_session string"])


def unwrapped(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per exported object, as JSON text, with its file's place in paths and its place in the file."""
    files = None
    for i, path in enumerate(paths):
        one = spark.read.text(path, wholetext=True).select(F.lit(i).alias("file"), F.col("value"))
        files = one if files is None else files.union(one)
    v = F.parse_json("value")
    inner = F.coalesce(F.try_variant_get(v, "$[0].results", "array<variant>"), F.try_variant_get(v, "$.results", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"))
    return files.select("file", F.posexplode(inner).alias("place", "item")).select("file", "place", F.to_json("item").alias("item"))


def boolean(c: Column) -> Column:
    """true, false, 0, 1 and their texts; else null."""
    return F.when(F.lower(c.cast("string")).isin("1", "true"), True).when(F.lower(c.cast("string")).isin("0", "false"), False)


def decoded(items: DataFrame, strict: bool = False) -> DataFrame:
    """Typed rows with an array of errors that name the column; strict: raise at the first row that has any."""
    rows = items.select("file", "place", F.from_json("item", ROW).alias("r")).select("file", "place", "r.*")
    wrong = lambda c, message: F.concat(F.lit("row "), F.col("place").cast("string"), F.lit(f", {c}: {message}"))
    errors = [F.when(F.col(c).isNull(), wrong(c, "missing")) for c in REQUIRED]
    errors += [F.when(F.col("price_minor").try_cast("long").isNull(), wrong("price_minor", "not a whole number")), F.when(boolean(F.col("is_estimate")).isNull(), wrong("is_estimate", "not a boolean"))]
    errors += [F.when(F.try_to_timestamp(F.col(c)).isNull() & F.col(c).isNotNull(), wrong(c, "not a time")) for c in ("observed_at", "received_at")]
    out = rows.withColumn("errors", F.array_compact(F.array(*errors)))
    out = out.withColumns({"price_minor": F.col("price_minor").try_cast("long"), "is_estimate": boolean(F.col("is_estimate")), "clean_session": boolean(F.col("clean_session")), "observed_at": F.try_to_timestamp("observed_at"), "received_at": F.try_to_timestamp("received_at")})
    if strict:
        out = out.withColumn("errors", F.when(F.size("errors") > 0, F.raise_error(F.get("errors", F.lit(0)))).otherwise(F.col("errors")))
    return out


def first_of_each(rows: DataFrame, key: str = "observation_id") -> DataFrame:
    """Of rows with the same id, that of the first file wins."""
    order = Window.partitionBy(key).orderBy("file", "place")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def html_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages under a folder, at any depth, whole; a folder named raw is left out."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.html").text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html")).where(~F.col("path").contains("/raw/"))


def flags(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("panelist_id string, status string, reason string, cell_key string, flagged_at timestamp, reviewed_at timestamp, review_note string").json(path)


#: Columns that are looked up by value, and by which no file is sorted.
LOOKED_UP = ("panelist_id", "observation_id")


def write_observations(rows: DataFrame, path: str, row_group: int | None = None) -> None:
    """Append, a folder for each day of receipt, so that windows and retention read and drop whole folders.

    Days and cells are dealt to tasks by range, so a day is written by as many as its rows need, and a cell lies in few files and row groups
    (their least and greatest values tell which). LOOKED_UP have a Bloom filter in every row group. row_group: its bytes; Parquet's own number if none."""
    order = ["received_on", "cell_key", "observed_at"]
    bounds = {f"parquet.bloom.filter.enabled#{c}": "true" for c in LOOKED_UP} | ({"parquet.block.size": str(row_group)} if row_group else {})
    dealt = rows.withColumn("received_on", F.to_date("received_at")).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.write.mode("append").options(**bounds).partitionBy("received_on").parquet(path)


def stored_observations(spark: SparkSession, path: str, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """What write_observations wrote, received from `first` to `last`, both included: only the days in between are listed."""
    rows, day, at = spark.read.parquet(path), F.col("received_on"), F.col("received_at")
    if first is not None:
        rows = rows.where((day >= F.to_date(first)) & (at >= first))
    if last is not None:
        rows = rows.where((day <= F.to_date(last)) & (at <= last))
    return rows.drop("received_on")
