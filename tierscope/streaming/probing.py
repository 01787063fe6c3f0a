"""Probes on a stream: anonymous rows meet the signed-in rows around them as both come in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import probes
from ..operators.panel import is_probe
from ..schema import PAIR_AHEAD_MINUTES, PAIR_BACK_MINUTES


def paired(stream: DataFrame, back_minutes: int = PAIR_BACK_MINUTES, ahead_minutes: int = PAIR_AHEAD_MINUTES, late: str = "2 hours") -> DataFrame:
    """probes.pair on a stream, in append mode: a row's verdict comes once no signed-in row of its band can come any more.

    A stream-stream join within the band, and the nearest of each anonymous row as an aggregate behind it. State holds the rows of the band and of
    `late`, and no longer history; a row that is later than `late` behind the newest takes no part. Rows without a panelist or product
    meet none, and those without a time are left out."""
    timed = stream.withColumn("at", F.col("observed_at").cast("timestamp")).withWatermark("at", late)
    side = lambda rows, name: rows.select(*(F.col(k).alias(f"{name}_{k}") for k in ("panelist_id", "retailer", "sku", "at")), F.struct(*probes.COLUMNS).alias(name))
    anon, mine = side(timed.where(is_probe()), "anon"), side(timed.where(F.col("session_state") == "logged_in"), "mine")
    # the batch join compares whole seconds
    gap = probes.whole_seconds(F.col("mine_at")) - probes.whole_seconds(F.col("anon_at"))
    same_key = [F.col(f"anon_{k}") == F.col(f"mine_{k}") for k in ("panelist_id", "retailer", "sku")]
    # the bounds by which state is dropped, a second wider than the band
    band = [F.col("mine_at") >= F.col("anon_at") - F.expr(f"interval {60 * back_minutes + 1} seconds"), F.col("mine_at") <= F.col("anon_at") + F.expr(f"interval {60 * ahead_minutes + 1} seconds")]
    near = anon.join(mine, [*same_key, *band, gap.between(-60 * back_minutes, 60 * ahead_minutes)], "leftOuter")
    found = near.select("anon_at", "anon", F.when(F.col("mine_at").isNotNull(), probes.nearness()).alias("m"))
    best = found.groupBy(F.window("anon_at", "1 hour"), "anon").agg(F.min("m").alias("m"))
    return probes.told(best.select("anon.*", "m"))
