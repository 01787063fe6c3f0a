"""Pairs of anonymous and signed-in observations: an as-of join within a band, verdicts and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import PAIR_AHEAD_MINUTES, PAIR_BACK_MINUTES
from .panel import is_probe, medians


COLUMNS = ["observation_id", "panelist_id", "retailer", "sku", "observed_at", "price_minor", "store_id", "store_label"]


def same_store(a: str = "mine", b: str = "anon") -> Column:
    """True, false, or null where it can't be told: ids decide where both are there, else labels (not at a marketplace)."""
    ids, labels = [f"{x}.store_id" for x in (a, b)], [f"{x}.store_label" for x in (a, b)]
    both = lambda c: F.col(c[0]).isNotNull() & F.col(c[1]).isNotNull()
    return F.when(both(ids), F.col(ids[0]) == F.col(ids[1])).when((F.col(f"{b}.retailer") != "instacart") & both(labels), F.col(labels[0]) == F.col(labels[1]))


def verdict(same: Column, mine: Column, anon: Column) -> Column:
    return F.when(same.isNull(), "STORE_UNKNOWN").when(~same, "STORE_DIFFERS").when(mine == anon, "SAME").when(mine > anon, "MORE").otherwise("LESS")


def whole_seconds(at: Column) -> Column:
    """Seconds of a time to the nearest, halves to the even one, as the SQL's epoch()::BIGINT has them: the band is told by these."""
    return F.rint(F.unix_micros(at.cast("timestamp")) / 1_000_000).cast("long")


def pair(obs: DataFrame, back_minutes: int = PAIR_BACK_MINUTES, ahead_minutes: int = PAIR_AHEAD_MINUTES) -> DataFrame:
    """One row per anonymous row: the nearest signed-in row of the same panelist, retailer and product in [at - back, at + ahead], in whole seconds.

    Ties go to the earlier row, then the smaller id. A time bucket as long as the band joins the equality keys, and the
    anonymous side asks its two neighbours, so a busy key is many buckets rather than one; the nearest is an aggregate."""
    width = 60 * (back_minutes + ahead_minutes)
    seconds = lambda c: whole_seconds(F.col(c))
    anon = obs.where(is_probe()).select(*COLUMNS)
    # what has no probe at all needs no row on the other side
    mine = obs.where(F.col("session_state") == "logged_in").select(*COLUMNS)
    key = ["panelist_id", "retailer", "sku", "bucket"]
    left = anon.withColumn("bucket", F.explode(F.sequence(F.floor((seconds("observed_at") - 60 * back_minutes) / width), F.floor((seconds("observed_at") + 60 * ahead_minutes) / width))))
    right = mine.withColumn("bucket", F.floor(seconds("observed_at") / width))
    gap = lambda: seconds("mine.observed_at") - seconds("anon.observed_at")
    near = left.alias("anon").join(right.alias("mine"), [F.col(f"anon.{k}") == F.col(f"mine.{k}") for k in key]).where(gap().between(-60 * back_minutes, 60 * ahead_minutes))
    best = near.select(F.col("anon.observation_id").alias("observation_id"), nearness().alias("m")).groupBy("observation_id").agg(F.min("m").alias("m"))
    return told(anon.join(best, "observation_id", "left"))


def nearness() -> Column:
    """The signed-in row `mine` of a pair as a struct whose smallest is the one to take for the row `anon`."""
    micros = lambda side: F.unix_micros(F.col(f"{side}.observed_at").cast("timestamp"))
    return F.struct(F.abs(micros("mine") - micros("anon")).alias("gap"), F.col("mine.observed_at").alias("at"), F.col("mine.observation_id").alias("id"), F.col("mine.price_minor").alias("price"), same_store().alias("same"))


def told(rows: DataFrame) -> DataFrame:
    """Anonymous rows with the nearest signed-in one (m, null without any): verdict and difference."""
    judged = rows.withColumn("verdict", F.when(F.col("m").isNotNull(), verdict(F.col("m.same"), F.col("m.price"), F.col("price_minor"))))
    return judged.select("observation_id", "panelist_id", "retailer", "sku", "price_minor", F.col("m.id").alias("mine_id"), F.col("m.price").alias("mine_price"), "verdict", F.when(F.col("verdict").isin("SAME", "MORE", "LESS"), F.col("m.price") - F.col("price_minor")).alias("delta"))


def rates(pairs: DataFrame) -> DataFrame:
    """Per retailer: pairs by verdict, comparable ones, unpaired ones, difference rate and median size of a difference."""
    is_ = lambda *v: F.col("verdict").isin(*v)
    told = pairs.groupBy("retailer").agg(
        *(F.count_if(F.coalesce(is_(v), F.lit(False))).alias(v.lower()) for v in ("SAME", "MORE", "LESS", "STORE_DIFFERS", "STORE_UNKNOWN")),
        F.count_if(F.coalesce(is_("SAME", "MORE", "LESS"), F.lit(False))).alias("comparable"), F.count_if(F.col("mine_id").isNull()).alias("unpaired"),
        F.try_divide(F.count_if(F.coalesce(is_("MORE", "LESS"), F.lit(False))), F.count_if(F.coalesce(is_("SAME", "MORE", "LESS"), F.lit(False)))).alias("difference_rate"),
    )
    median = medians(pairs.withColumnRenamed("retailer", "_retailer"), ["_retailer"], F.when(is_("MORE", "LESS"), F.abs("delta")), "median_delta")
    return told.join(median, F.col("retailer").eqNullSafe(F.col("_retailer")), "left").drop("_retailer")


def check_stats(results: DataFrame) -> DataFrame:
    """results(retailer, verdict, reason) counted per retailer: checks, differences, failures and failures by reason (a map).

    A check without a verdict of its own (UNCHECKED) is a failure; where it tells no reason the page wasn't read."""
    failed = F.col("verdict") == "UNCHECKED"
    totals = results.groupBy("retailer").agg(F.count(F.lit(1)).alias("checks"), F.count_if(F.col("verdict").isin("MORE", "LESS")).alias("differences"), F.count_if(failed).alias("failures"))
    told = results.where(failed).groupBy("retailer", F.coalesce("reason", F.lit("extract_unavailable")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    maps = told.groupBy(F.col("retailer").alias("_retailer")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("by_reason"))
    joined = totals.join(maps, F.col("retailer").eqNullSafe(F.col("_retailer")), "left").drop("_retailer")
    return joined.withColumn("by_reason", F.coalesce("by_reason", F.create_map().cast("map<string,bigint>")))


def latest_own(obs: DataFrame, key: str = "sku") -> DataFrame:
    """A panelist's latest row of each page that no clean session made."""
    own = obs.where(~F.col("clean_session").eqNullSafe(F.lit(True)))
    return own.groupBy("panelist_id", key).agg(F.max_by(F.struct("observation_id", "price_minor"), F.struct("observed_at", "observation_id")).alias("b")).select("panelist_id", key, "b.*")


def probe_triggers(own: DataFrame, results: DataFrame) -> DataFrame:
    """Own rows with the probe result of their product, where the price is still that of the result."""
    return own.alias("o").join(results.alias("r"), (F.col("o.sku") == F.col("r.sku")) & (F.col("o.price_minor") == F.col("r.price_minor")), "left").select("o.*", F.col("r.verdict").alias("verdict"))


def classify_fetch(kind: Column, status: Column, ok: Column) -> Column:
    return F.when(kind == "opaqueredirect", "redirected").when(kind == "error", "network_error").when(~ok, "http_error").otherwise("ok")
