"""Flags in the order of a batch: a panelist that an earlier pair got flagged no longer counts among the others of a later one.

A pair (panelist, cell) stands at the place of its first row. What a pair sees depends on the flags of pairs before it, so verdicts are worked out
again and again for all pairs at once, each with the flags found last time at earlier places, until the flags stay the same. The first flags of
a round are right if those before them were, so the rounds end with what going through the pairs one by one gives; few are needed, since
flags seldom change others. The range of a cell's others comes from the two least and two largest panelists that no pair flags, and from a
list of those that one does; that list is bounded by the batch's flags.

Defined cases: without rows or pairs there are no flags; a panelist that has a flag of any status gets none, and one with an active flag isn't counted; the
first flag of a panelist stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ABUSE_HIGH, ABUSE_LOW, ABUSE_PANELISTS
from ..sources.staged import staged
from .ingest import suspect_reason

CELL = ["cell_key", "panelist_id"]


def pairs_of(batch: DataFrame, order: str = "observation_id") -> DataFrame:
    """panelist_id, cell_key, place: the pairs of a batch, at the least `order` of their rows, which no two rows share."""
    return batch.groupBy(*CELL).agg(F.min(order).alias("place"))


def _ends(base: DataFrame) -> DataFrame:
    """Of each cell: how many panelists, and the two with the lowest and with the highest prices."""
    first = base.groupBy("cell_key").agg(F.count(F.lit(1)).alias("panelists"), F.min(F.struct("lo", "panelist_id")).alias("lo1"), F.max(F.struct("hi", "panelist_id")).alias("hi1"))
    told = base.join(first, "cell_key")
    second = told.groupBy("cell_key").agg(F.min(F.when(F.col("panelist_id") != F.col("lo1.panelist_id"), F.col("lo"))).alias("lo2"), F.max(F.when(F.col("panelist_id") != F.col("hi1.panelist_id"), F.col("hi"))).alias("hi2"))
    return first.join(second, "cell_key")


def _mark(found: DataFrame) -> tuple:
    return tuple(found.agg(F.count(F.lit(1)), F.sum(F.xxhash64("panelist_id", "cell_key", "place").cast("decimal(38,0)"))).first())


def flags_in_order(pairs: DataFrame, rows: DataFrame, flags: DataFrame) -> DataFrame:
    """panelist_id, status, cell_key, reason, place: the flags that pairs add one after the other.

    pairs: as pairs_of gives them; rows: (cell_key, panelist_id, price_minor) of the time looked back on; flags: (panelist_id, status) so far."""
    active = flags.where("status = 'suspect'").select("panelist_id").distinct()
    asked = staged(pairs.join(active, "panelist_id", "left_anti"), "pairs")
    near = staged(rows.select(*CELL, "price_minor").distinct().join(asked.select("cell_key").distinct(), "cell_key", "left_semi"), "prices")
    own = near.groupBy(*CELL).agg(F.min("price_minor").alias("lo"), F.max("price_minor").alias("hi"))
    base = staged(own.join(active, "panelist_id", "left_anti"), "ranges")
    prices = near.join(asked.select(*CELL), CELL, "left_semi")
    may = asked.join(flags.select("panelist_id").distinct(), "panelist_id", "left_anti")
    found, seen = None, None
    while True:
        new = asked.limit(0) if found is None else found
        later = base.join(new.select("panelist_id", F.col("place").alias("f")), "panelist_id").groupBy("cell_key").agg(F.collect_list(F.struct("panelist_id", "f", "lo", "hi")).alias("later"))
        never = base.join(new.select("panelist_id"), "panelist_id", "left_anti")
        told = may.join(_ends(never), "cell_key", "left").join(later, "cell_key", "left").join(never.select(*CELL, F.lit(1).alias("is_in")), CELL, "left")
        me = F.col("panelist_id")
        unflagged = F.filter(F.coalesce("later", F.array().cast(later.schema["later"].dataType)), lambda x: (x["f"] >= F.col("place")) & (x["panelist_id"] != me))
        low = F.when(me == F.col("lo1.panelist_id"), F.col("lo2")).otherwise(F.col("lo1.lo"))
        high = F.when(me == F.col("hi1.panelist_id"), F.col("hi2")).otherwise(F.col("hi1.hi"))
        others = F.coalesce("panelists", F.lit(0)) - F.coalesce("is_in", F.lit(0)) + F.size(unflagged)
        seen_by = told.select(*CELL, "place", others.alias("others"), F.least(low, F.array_min(F.transform(unflagged, lambda x: x["lo"]))).alias("others_lo"), F.greatest(high, F.array_max(F.transform(unflagged, lambda x: x["hi"]))).alias("others_hi"))
        inside = (F.col("price_minor") >= ABUSE_LOW * F.col("others_lo")) & (F.col("price_minor") <= ABUSE_HIGH * F.col("others_hi"))
        out = prices.join(seen_by.where(F.col("others") >= ABUSE_PANELISTS), CELL).groupBy(*CELL, "place", "others", "others_lo", "others_hi").agg(F.count_if(inside).alias("inside")).where("inside = 0")
        first = out.withColumn("reason", suspect_reason()).groupBy("panelist_id").agg(F.min_by(F.struct("cell_key", "reason", "place"), "place").alias("o"))
        found = staged(first.select("panelist_id", F.lit("suspect").alias("status"), "o.cell_key", "o.reason", "o.place"), "flags")
        now = _mark(found)
        if now == seen:
            return found
        seen = now
