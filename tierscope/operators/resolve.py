"""The price ladder of every cell at once: tiers, shares, floor and confidence, or why there is none yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import coupon
from ..schema import MAX_TIERS, MIN_SIGHTINGS, NOISE_FROM, SAFETY_FACTOR

TIERS = "array<struct<price:bigint,n:bigint>>"


def histogram(votes: DataFrame, key: tuple[str, ...] = ("cell_key",), price: str = "price_minor") -> DataFrame:
    return votes.groupBy(*key, F.col(price).cast("long").alias("price")).agg(F.count(F.lit(1)).alias("n"))


def is_kept(price: Column, n: Column, twice: Column, cell_n: Column) -> Column:
    """From NOISE_FROM votes on, prices seen once go, unless they are below every price seen twice."""
    return ~F.coalesce((cell_n >= NOISE_FROM) & twice.isNotNull(), F.lit(False)) | (n >= 2) | F.coalesce(price < twice, F.lit(False))


def resolve(votes: DataFrame, key: tuple[str, ...] = ("cell_key",), price: str = "price_minor", currency: str | None = "currency", cells: DataFrame | None = None) -> DataFrame:
    """One row per cell: n, k, status, reason, needed, floor_minor, confidence, spread, tiers (price, n, share), currency.

    cells: keys to answer for even where there are no votes. A price that is null or below zero is an error."""
    good = F.coalesce(F.col(price) >= 0, F.lit(False))
    checked = votes.withColumn(price, F.when(good, F.col(price)).otherwise(F.raise_error(F.lit("a price is not a whole number of zero or more")).cast("long")))
    unit = F.min(currency) if currency else F.lit("USD")
    counts = checked.groupBy(*key, F.col(price).cast("long").alias("price")).agg(F.count(F.lit(1)).alias("n"), unit.alias("unit"))
    own = Window.partitionBy(*key)
    counts = counts.withColumns({"cell_n": F.sum("n").over(own), "twice": F.min(F.when(F.col("n") >= 2, F.col("price"))).over(own), "currency": F.min("unit").over(own)})
    counts = counts.where(is_kept(F.col("price"), F.col("n"), F.col("twice"), F.col("cell_n"))).withColumn("k", F.count(F.lit(1)).over(own))
    # a cell of too many tiers is told by their number; its prices are never an array
    few = F.when(F.col("k") <= MAX_TIERS, F.struct("price", "n"))
    laid = counts.groupBy(*key).agg(F.max("cell_n").alias("cell_n"), F.max("k").cast("int").alias("k"), F.array_sort(F.collect_list(few)).alias("kept"), F.min("n").alias("rarest"), F.sum("n").alias("total"), F.min("currency").alias("currency")).withColumnRenamed("cell_n", "n")
    if cells is not None:
        laid = cells.select(*key).distinct().join(laid, list(key), "left")
    laid = laid.withColumns({"n": F.coalesce("n", F.lit(0).cast("long")), "currency": F.coalesce("currency", F.lit("USD")), "k": F.coalesce("k", F.lit(0)), "total": F.coalesce("total", F.lit(0).cast("long")), "kept": F.coalesce("kept", F.array().cast(TIERS))})
    n, k, rarest = F.col("n"), F.col("k"), F.col("rarest")
    needs = F.element_at(F.array(*(F.lit(_required(i)) for i in range(1, MAX_TIERS + 1))), F.greatest(F.lit(1), F.least(k, F.lit(MAX_TIERS))))
    more = F.greatest(needs, F.when(rarest < MIN_SIGHTINGS, F.ceil(MIN_SIGHTINGS * n / rarest)).otherwise(0)) - n
    reason = F.when(n == 0, "no_observations").when(k > MAX_TIERS, "too_many_tiers").when(n < needs, "insufficient_n").when(rarest < MIN_SIGHTINGS, "rare_tier_unconfirmed")
    needed = F.when(n == 0, F.lit(_required(2))).when(k > MAX_TIERS, 0).when(n < needs, more).when(rarest < MIN_SIGHTINGS, F.greatest(F.lit(1).cast("long"), more))
    out = laid.withColumns({"reason": reason, "needed": needed.cast("long")})
    out = out.withColumn("status", F.when(F.col("reason").isNull(), "RESOLVED").otherwise("UNRESOLVED"))
    resolved = F.col("status") == "RESOLVED"
    out = out.withColumn("tiers", F.when(resolved, F.transform("kept", lambda t: F.struct(t["price"].alias("price"), t["n"].alias("n"), (t["n"] / F.col("total")).alias("share")))))
    shares = F.transform("tiers", lambda t: t["share"])
    low, high = F.get("tiers", F.lit(0))["price"], F.element_at("tiers", -1)["price"]
    return out.withColumns({
        "floor_minor": low,
        # not evaluated but where resolved: its cost doubles with every tier
        "confidence": F.when(resolved & (k <= MAX_TIERS), coupon.all_seen(shares, n, MAX_TIERS)),
        "spread": F.when(resolved & (k > 1), F.when(low == 0, 0.0).otherwise((high - low) / low)),
    }).select(*key, "n", "k", "status", "reason", "needed", "floor_minor", "confidence", "spread", "tiers", "currency")


def _required(k: int, factor: float = SAFETY_FACTOR) -> int:
    import math

    return math.ceil(round(factor * k * sum(1 / i for i in range(1, k + 1)), 9))


def tiers_of(resolutions: DataFrame, key: tuple[str, ...] = ("cell_key",)) -> DataFrame:
    return resolutions.select(*key, F.posexplode("tiers").alias("tier", "t")).select(*key, "tier", "t.price", "t.n", "t.share")


def ladder_view(resolutions: DataFrame, mine: DataFrame, key: tuple[str, ...] = ("cell_key",), price: str = "my_price") -> DataFrame:
    """Tiers of each cell of mine(key, my_price), marked `mine` and `floor`; state resolved, unresolved or no_data."""
    both = mine.join(resolutions, list(key), "left")
    state = F.when(F.col("status") == "RESOLVED", "resolved").when(F.coalesce("n", F.lit(0)) > 0, "unresolved").otherwise("no_data")
    tiers = F.transform("tiers", lambda t, i: F.struct(t["price"].alias("price"), t["share"].alias("share"), (t["price"] == F.col(price)).alias("mine"), (i == 0).alias("floor")))
    return both.select(*mine.columns, state.alias("state"), tiers.alias("tiers"))
