"""Ordered folds over a cell's prices: level shifts, and the first prefix that resolves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import MIN_SIGHTINGS, SAFETY_FACTOR

BLOCK, MIN_SCALE, SLACK, ALARM, MIN_SHARE, REFERENCE_BLOCKS = 10, 0.02, 0.5, 4.0, 0.7, 3
FACTORS, SIGHTINGS = (1.0, 1.25, 1.5, 1.75, 2.0, 2.5, 3.0), (2, 3, 4)


def shift_blocks(obs: DataFrame, key: tuple[str, ...] = ("cell_key",), size: int = BLOCK) -> DataFrame:
    """Whole blocks of `size` rows in time order: number, lower median price, share of rows at it, first time."""
    order = Window.partitionBy(*key).orderBy("observed_at", "observation_id")
    numbered = obs.select(*key, "observed_at", "price_minor", F.floor((F.row_number().over(order) - 1) / size).cast("int").alias("block"))
    blocks = numbered.groupBy(*key, "block").agg(F.array_sort(F.collect_list("price_minor")).alias("p"), F.min("observed_at").alias("at")).where(F.size("p") == size)
    median = F.get("p", F.lit((size - 1) // 2))
    return blocks.select(*key, "block", median.alias("median"), (F.size(F.filter("p", lambda x: x == median)) / size).alias("share"), "at")


def detect_shift(obs: DataFrame, key: tuple[str, ...] = ("cell_key",), size: int = BLOCK, min_scale: float = MIN_SCALE, slack: float = SLACK, alarm: float = ALARM, min_share: float = MIN_SHARE, reference_blocks: int = REFERENCE_BLOCKS) -> DataFrame:
    """Per cell: shifted, at (first time of the block where the run began), inconclusive (why there is no answer).

    A two-sided CUSUM with resets, folded over the blocks of a cell in order; nothing after the first alarm counts."""
    blocks = shift_blocks(obs, key, size)
    cells = obs.select(*key).distinct()
    laid = cells.join(blocks.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("block", "median", "share", "at"))).alias("b")), list(key), "left")
    laid = laid.withColumn("b", F.coalesce("b", F.expr("cast(array() as array<struct<block:int,median:bigint,share:double,at:timestamp_ntz>>)")))
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.when(F.size(c) > 0, F.size(c))
    first = F.array_sort(F.transform(F.slice("b", 1, reference_blocks), lambda x: x["median"]))
    laid = laid.withColumn("reference", F.get(first, F.floor((F.size(first) - 1) / 2).cast("int")))
    laid = laid.withColumn("x", F.transform("b", lambda b: F.try_divide(b["median"] - F.col("reference"), F.col("reference")).cast("double")))
    laid = laid.withColumn("m", mean(F.col("x")))
    spread = F.sqrt(F.try_divide(F.aggregate("x", F.lit(0.0), lambda a, v: a + (v - F.col("m")) * (v - F.col("m"))), F.size("x") - 1))
    laid = laid.withColumn("sigma", F.greatest(F.lit(min_scale), F.coalesce(spread, F.lit(0.0))))
    reason = F.when(F.size("b") < 2, "too_few_blocks").when((mean(F.transform("b", lambda b: b["share"])) < min_share) | (F.col("reference") <= 0), "no_dominant_price")
    zero = F.struct(F.lit(0.0).alias("up"), F.lit(0.0).alias("down"), F.lit(0).alias("up_from"), F.lit(0).alias("down_from"), F.lit(0).alias("j"), F.lit(None).cast("int").alias("alarm"))

    def step(s: Column, v: Column) -> Column:
        z = v / F.col("sigma")
        up, down = s["up"] + z - slack, s["down"] - z - slack
        up_from, down_from = F.when(up <= 0, s["j"] + 1).otherwise(s["up_from"]), F.when(down <= 0, s["j"] + 1).otherwise(s["down_from"])
        alarm_at = F.when(s["alarm"].isNotNull(), s["alarm"]).when(up > alarm, up_from).when(down > alarm, down_from)
        return F.struct(F.greatest(up, F.lit(0.0)).alias("up"), F.greatest(down, F.lit(0.0)).alias("down"), up_from.alias("up_from"), down_from.alias("down_from"), (s["j"] + 1).alias("j"), alarm_at.alias("alarm"))

    told = laid.withColumn("inconclusive", reason).withColumn("alarm", F.when(F.col("inconclusive").isNull(), F.aggregate("x", zero, step)["alarm"]))
    return told.select(*key, F.col("alarm").isNotNull().alias("shifted"), F.get("b", F.col("alarm"))["at"].alias("at"), "inconclusive")


def first_resolution(votes: DataFrame, settings: list[tuple[float, int]], key: tuple[str, ...] = ("cell_key",)) -> DataFrame:
    """For each cell and setting (factor, sightings): the first prefix of votes in time order that resolves, or no row.

    Running windows tell for every prefix how many prices it has and how many of them were seen often enough; no cell is
    held in an array, and one pass answers all settings."""
    order = Window.partitionBy(*key).orderBy("observed_at", "observation_id")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    times = F.row_number().over(Window.partitionBy(*key, "price_minor").orderBy("observed_at", "observation_id"))
    rows = votes.select(*key, "observed_at", "observation_id", "price_minor", times.alias("times"))
    often = {m: f"often_{m}" for m in sorted({m for _, m in settings})}
    running = {"at": F.row_number().over(order), "k": F.count_if(F.col("times") == 1).over(so_far).cast("int"), "low": F.min("price_minor").over(so_far)}
    running |= {name: F.count_if(F.col("times") == m).over(so_far) for m, name in often.items()}
    laid = rows.withColumns(running).withColumn("harmonic", F.sum(F.when(F.col("times") == 1, 1 / F.col("k"))).over(so_far))
    ready = [(F.col("at") >= F.ceil(F.round(F.col("k") * F.col("harmonic") * float(f), 9))) & (F.col(often[m]) == F.col("k")) for f, m in settings]
    first = laid.groupBy(*key).agg(*(F.min(F.when(ok, F.struct("at", "k", "low"))).alias(f"s{i}") for i, ok in enumerate(ready)))
    each = F.array(*(F.struct(F.lit(float(f)).alias("factor"), F.lit(m).alias("sightings"), F.col(f"s{i}").alias("r")) for i, (f, m) in enumerate(settings)))
    return first.select(*key, F.inline(each)).where("r is not null").select(*key, "factor", "sightings", "r.at", "r.k", F.col("r.low").alias("floor_minor"))


#: The sweep: every factor at the usual sightings, every number of sightings at the usual factor.
SWEEP = [(f, MIN_SIGHTINGS) for f in FACTORS] + [(SAFETY_FACTOR, m) for m in SIGHTINGS if m != MIN_SIGHTINGS]


def reconcile(resolutions: DataFrame, votes: DataFrame, settings: list[tuple[float, int]] = SWEEP) -> DataFrame:
    """Per setting: cells that resolve, those that resolved with tiers or the floor still missing, median votes needed."""
    final = resolutions.where("status = 'RESOLVED'").select("cell_key", F.col("k").alias("k_final"), F.col("floor_minor").alias("floor_final"))
    first = first_resolution(votes.join(final.select("cell_key"), "cell_key", "left_semi"), settings).join(final, "cell_key")
    told = first.groupBy("factor", "sightings").agg(
        F.count(F.lit(1)).alias("resolved"), F.count_if(F.col("k") < F.col("k_final")).alias("premature_tiers"), F.count_if(F.col("floor_minor") > F.col("floor_final")).alias("premature_floor"), F.median("at").alias("median_votes"),
    )
    all_ = votes.sparkSession.createDataFrame(settings, "factor double, sightings int").join(told, ["factor", "sightings"], "left")
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return all_.select("factor", "sightings", n("resolved"), n("premature_tiers"), n("premature_floor"), F.try_divide("premature_tiers", "resolved").alias("premature_tier_rate"), F.try_divide("premature_floor", "resolved").alias("premature_floor_rate"), "median_votes")


def recommendation(rows: list, cells: int, budget: float = 0.15, least: int = 20) -> str:
    """Of collected sweep rows: the smallest factor at the usual sightings whose premature-floor rate is within the budget."""
    if cells < least:
        return f"{cells} resolved cells, {least} wanted: keep the present factor."
    good = sorted(r["factor"] for r in rows if r["sightings"] == MIN_SIGHTINGS and r["premature_floor_rate"] is not None and r["premature_floor_rate"] <= budget)
    return f"The smallest factor that holds is {good[0]}." if good else "No factor of the sweep holds."
