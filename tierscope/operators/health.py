"""Health of capture adapters: reports to rows, sums, folds and differences of counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def report_rows(reports: DataFrame) -> DataFrame:
    """reports(clientVersion, date, adapters array) as one row for each adapter."""
    a = F.col("a")
    return reports.select("date", "clientVersion", F.explode("adapters").alias("a")).select("date", "clientVersion", F.concat(a["adapter"], F.lit("@"), a["version"]).alias("adapter"), a["attempted"].alias("attempted"), a["extracted"].alias("extracted"), a["failed"].alias("failed"))


def report_errors() -> Column:
    """What is wrong with a report: array of sentences."""
    bad = lambda c: F.coalesce(c, F.lit(True))
    counts = lambda a: bad((a["attempted"] < 0) | (a["attempted"] > 10**9)) | bad((a["extracted"] < 0) | (a["extracted"] > 10**9)) | bad(a["extracted"] > a["attempted"])
    return F.array_compact(F.array(
        F.when(bad(~F.col("clientVersion").rlike(r"^\d+\.\d+\.\d+$")), "clientVersion: malformed"), F.when(bad(~F.col("date").cast("string").rlike(r"^\d{4}-\d\d-\d\d$")), "date: malformed"),
        F.when(bad((F.size("adapters") < 1) | (F.size("adapters") > 20)), "adapters: 1 to 20"), F.when(F.exists("adapters", lambda a: bad(F.length(a["adapter"]) > 32)), "adapters: a name is over 32 characters"),
        F.when(F.exists("adapters", counts), "adapters: a count is not between 0 and 1e9"), F.when(F.exists("adapters", lambda a: bad(F.size(F.map_keys(a["failed"])) > 16)), "adapters: over 16 reasons"),
    ))


def failed_from_json(c: Column) -> Column:
    """A map of reason to count; what is no count is left out, what is no map is empty."""
    return F.coalesce(F.map_filter(F.from_json(c, "map<string,bigint>"), lambda _, n: n.isNotNull() & (n >= 0)), F.create_map().cast("map<string,bigint>"))


def summary(rows: DataFrame, key: tuple[str, ...] = ("adapter", "date")) -> DataFrame:
    """Sums per key, with the reason maps merged by sum."""
    totals = rows.groupBy(*key).agg(F.sum("attempted").alias("attempted"), F.sum("extracted").alias("extracted"))
    reasons = rows.select(*key, F.explode("failed").alias("reason", "n")).groupBy(*key, "reason").agg(F.sum("n").alias("n"))
    maps = reasons.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("failed"))
    return totals.join(maps, list(key), "left").withColumn("failed", F.coalesce("failed", F.create_map().cast("map<string,bigint>")))


def fold(rows: DataFrame) -> DataFrame:
    """Over all dates: extraction rate (null without attempts), and reasons by count, then name."""
    order = lambda x, y: F.when(x["n"] > y["n"], -1).when(x["n"] < y["n"], 1).when(x["reason"] < y["reason"], -1).when(x["reason"] > y["reason"], 1).otherwise(0)
    told = summary(rows, ("adapter",)).withColumn("rate", F.try_divide("extracted", "attempted"))
    return told.withColumn("reasons", F.array_sort(F.transform(F.map_entries("failed"), lambda e: F.struct(e["key"].alias("reason"), e["value"].alias("n"))), order)).drop("failed")


def outcome_counters(outcomes: DataFrame) -> DataFrame:
    """outcomes(adapter, outcome, reason) counted per adapter."""
    is_ = lambda v: F.count_if(F.col("outcome") == v)
    return outcomes.groupBy("adapter").agg(F.count(F.lit(1)).alias("attempted"), is_("stored").alias("stored"), is_("duplicate").alias("duplicates"), is_("rejected").alias("rejected"), is_("skipped").alias("skipped"), is_("extract_failed").alias("failed"))


def outcome_rows(outcomes: DataFrame, fallback: str | None = None) -> DataFrame:
    """Captures as counts: adapter, attempted, extracted, failed (reason to count).

    outcomes(adapter, status, reason, stored, duplicates, rejected, skipped): the last four are of a listing, where skipped has the tiles by reason.
    fallback: the adapter of outcomes that name none; without it they don't count. Neither do captures without consent or adapter."""
    n = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long"))
    listing, one, none = F.col("status") == "listing", F.lit(1).cast("long"), F.lit(0).cast("long")
    skipped = F.map_filter(F.coalesce("skipped", F.create_map().cast("map<string,bigint>")), lambda _, v: F.coalesce(v > 0, F.lit(False)))
    tiles = n("stored") + n("duplicates") + n("rejected")
    single = lambda reason: F.create_map(reason, one)
    refused = F.when(n("rejected") > 0, F.create_map(F.lit("rejected"), n("rejected"))).otherwise(F.create_map().cast("map<string,bigint>"))
    # skipped tiles may have a reason of that name themselves
    both = F.map_zip_with(skipped, refused, lambda _, x, y: F.coalesce(x, none) + F.coalesce(y, none))
    taken = outcomes.withColumn("adapter", F.coalesce("adapter", F.lit(fallback))).where(F.col("adapter").isNotNull() & F.col("status").isin("stored", "duplicate", "rejected", "extract_failed", "listing"))
    return taken.select(
        "adapter", F.when(listing, tiles + F.aggregate(F.map_values(skipped), none, lambda x, y: x + y)).otherwise(one).alias("attempted"),
        F.when(listing, tiles).when(F.col("status") == "extract_failed", none).otherwise(one).alias("extracted"),
        F.when(listing, both).when(F.col("status") == "rejected", single(F.lit("rejected"))).when(F.col("status") == "extract_failed", single(F.coalesce("reason", F.lit("unknown")))).otherwise(F.create_map().cast("map<string,bigint>")).alias("failed"),
    )


def subtract(now: DataFrame, sent: DataFrame) -> DataFrame:
    """Counters (adapter, attempted, extracted, failed) less those that were sent, never below zero; reasons and adapters without anything left go."""
    zero = F.lit(0).cast("long")
    left = lambda c: F.greatest(zero, F.col(f"a.{c}") - F.coalesce(f"b.{c}", zero)).alias(c)
    gone = F.coalesce("b.failed", F.create_map().cast("map<string,bigint>"))
    failed = F.map_filter(F.map_zip_with("a.failed", gone, lambda _, x, y: F.coalesce(x, zero) - F.coalesce(y, zero)), lambda _, v: v > 0)
    both = now.alias("a").join(sent.alias("b"), F.col("a.adapter") == F.col("b.adapter"), "left")
    return both.select("a.adapter", left("attempted"), left("extracted"), failed.alias("failed")).where("attempted > 0")


def reports(left: DataFrame, client_version: str, date: Column) -> DataFrame:
    """Counters as one report(clientVersion, date, adapters), adapters in order of their names; no row where nothing was attempted.

    Adapters are few (a report holds 20 at most), so an array holds them."""
    cut = F.instr("adapter", "@")
    entry = F.struct(
        F.when(cut > 0, F.substring_index("adapter", "@", 1)).otherwise(F.col("adapter")).alias("adapter"),
        F.when(cut > 0, F.expr("substring(adapter, instr(adapter, '@') + 1)")).otherwise("").alias("version"), "attempted", "extracted", "failed",
    )
    put = left.where("attempted > 0").agg(F.array_sort(F.collect_list(F.struct(F.col("adapter").alias("id"), entry.alias("e"))), lambda x, y: F.when(x["id"] < y["id"], -1).when(x["id"] > y["id"], 1).otherwise(0)).alias("a"))
    return put.where(F.size("a") > 0).select(F.lit(client_version).alias("clientVersion"), date.alias("date"), F.col("a.e").alias("adapters"))
