"""Synthetic ladders with a known truth: each row comes from a hash of its seed and position, so any number of tasks makes them,
and the first n rows of a ladder are those of any longer one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def truth(tiers: list[int], probabilities: list[float] | None = None, floor_rarity: float | None = None, plant: tuple[int, float] | None = None) -> dict:
    """Prices in order with their probabilities: uniform by default; the floor's may be set, or a floor be planted below all."""
    if len(set(tiers)) != len(tiers) or any(t <= 0 for t in tiers) or not tiers:
        raise ValueError("tiers are distinct and above zero")
    p = probabilities or [1 / len(tiers)] * len(tiers)
    if len(p) != len(tiers) or abs(sum(p) - 1) > 1e-9 or any(x <= 0 for x in p):
        raise ValueError("probabilities are above zero, one for each tier, and sum to one")
    pairs = sorted(zip(tiers, p, strict=True))
    if floor_rarity is not None:
        rest = 1 - pairs[0][1]
        pairs = [(pairs[0][0], floor_rarity)] + [(t, x * (1 - floor_rarity) / rest) for t, x in pairs[1:]]
    if plant is not None:
        if plant[0] >= pairs[0][0]:
            raise ValueError("a planted floor is below every tier")
        pairs = [plant] + [(t, x * (1 - plant[1])) for t, x in pairs]
    return {"prices": [t for t, _ in pairs], "probabilities": [x for _, x in pairs], "floor": pairs[0][0], "floor_probability": pairs[0][1], "k": len(pairs)}


def draw(seed: Column, position: Column, label: str) -> Column:
    """A number in [0, 1): the first 32 bits of the MD5 of seed, label and position."""
    text = F.concat_ws("|", seed, F.lit(label), position.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296


def ladders(specs: DataFrame, n: int) -> DataFrame:
    """seed, position, panelist_id, observed_at, price_minor for specs(seed, tiers in order, probabilities or null, stickiness, observers or null).

    An observer repeats its own last tier with probability `stickiness`: its price is the last one it drew afresh."""
    rows = specs.withColumn("position", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    rows = rows.withColumn("panelist_id", F.when(F.col("observers").isNull(), F.col("position")).otherwise(F.col("position") % F.col("observers")))
    p = F.coalesce("probabilities", F.transform("tiers", lambda _: 1.0 / F.size("tiers")))
    below = F.aggregate(p, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n")), lambda a, x: F.struct((a["sum"] + x).alias("sum"), (a["n"] + F.when(F.col("u") >= a["sum"] + x, 1).otherwise(0)).alias("n")))["n"]
    tier = F.least(below, F.size("tiers") - 1)
    drawn = rows.withColumn("u", draw(F.col("seed"), F.col("position"), "tier")).withColumn("own", F.get("tiers", tier))
    own = Window.partitionBy("seed", "panelist_id").orderBy("position")
    stays = (draw(F.col("seed"), F.col("position"), "stay") < F.col("stickiness")) & (F.row_number().over(own) > 1)
    price = F.last(F.when(~F.col("stays"), F.col("own")), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0))
    at = F.lit("2026-09-04 15:26:18").cast("timestamp_ntz") + F.make_interval(mins=F.col("position").cast("int"))
    return drawn.withColumn("stays", stays).select("seed", "position", "panelist_id", at.alias("observed_at"), price.cast("long").alias("price_minor"))


def native_ladder(spark: SparkSession, tiers: list[int], n: int, seed: int = 0) -> DataFrame:
    """A uniform ladder of any length from a hash of the position: no state, so any number of tasks."""
    at = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(len(tiers))).cast("int")
    return spark.range(n).select(F.col("id").alias("position"), F.get(F.array(*map(F.lit, sorted(tiers))), at).cast("long").alias("price_minor"))
