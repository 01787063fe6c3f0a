"""Summaries of cells, panels and products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DECISION
from . import resolve as R
from . import windows as W


def commonest(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """key, value: the most frequent value of each key, ties to the smallest; counted first, so that no task holds a key's values."""
    counts = rows.groupBy(*key, value).agg(F.count(value).alias("_n"))
    return counts.groupBy(*key).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(value))


def medians(rows: DataFrame, key: list[str], value: Column, name: str) -> DataFrame:
    """key, name: the median of a value for each key (null without values), from a histogram and its running sum."""
    counts = rows.select(*key, value.cast("double").alias("_v")).groupBy(*key, "_v").agg(F.count("_v").alias("_n"))
    own = Window.partitionBy(*key)
    told = counts.withColumns({"_upto": F.sum("_n").over(own.orderBy("_v")), "_all": F.sum("_n").over(own)})
    # the middle rows: one, or two where the number is even
    first, last = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    holds = lambda at: F.max(F.when((F.col("_upto") >= at) & (F.col("_upto") - F.col("_n") < at), F.col("_v")))
    return told.groupBy(*key).agg(((holds(first) + holds(last)) / 2).alias(name))


def cell_summary(obs: DataFrame, flags: DataFrame) -> DataFrame:
    """Per cell: rows and panelists, suspects included, rows left out, votes, common title, and the resolution."""
    flagged = flags.where("status = 'suspect'").select("panelist_id", F.lit(True).alias("suspect"))
    marked = obs.join(flagged, "panelist_id", "left").withColumn("suspect", F.coalesce("suspect", F.lit(False)))
    total = marked.groupBy("cell_key").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("panelist_id").alias("panelists"), F.count_if("suspect").alias("excluded_rows"))
    title = commonest(marked, ["cell_key"], "title")
    resolved = R.resolve(W.votes(marked.where(~F.col("suspect")).drop("suspect")))
    return total.join(title, "cell_key").join(resolved, "cell_key", "left").withColumn("votes", F.coalesce("n", F.lit(0)))


def cell_metrics(cells: DataFrame, least: int = 5) -> DataFrame:
    """One row over a cell summary."""
    resolved = F.col("status") == "RESOLVED"
    multi = resolved & (F.col("k") > 1)
    one = cells.agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(F.col("votes") >= least).alias("cells_with_votes"), F.count_if(resolved).alias("resolved"), F.count_if(multi).alias("multi_tier"),
        F.try_divide(F.count_if(multi), F.count_if(resolved)).alias("multi_tier_share"), F.max("spread").alias("max_spread"), F.sum("excluded_rows").alias("excluded_rows"),
    )
    median = medians(cells.withColumn("_one", F.lit(1)), ["_one"], F.col("spread"), "median_spread")
    return one.withColumn("_one", F.lit(1)).join(median, "_one", "left").drop("_one")


def max_spread(cells: DataFrame) -> DataFrame:
    """The widest resolved cell, the first by key where several are."""
    return cells.where("spread is not null").orderBy(F.desc("spread"), "cell_key").limit(1)


def panel_metrics(obs: DataFrame) -> DataFrame:
    """Per retailer, and over all (retailer null)."""
    return obs.rollup("retailer").agg(
        F.countDistinct("panelist_id").alias("panelists"), F.count(F.lit(1)).alias("rows"),
        F.count_if(is_probe()).alias("probe_rows"), F.count_if("is_estimate").alias("estimate_rows"),
    )


def counts_by(obs: DataFrame, column: str) -> DataFrame:
    return obs.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))


def top_skus(obs: DataFrame, n: int = 20, sku: str = "sku") -> DataFrame:
    order = (F.desc("rows"), F.desc("panelists"), sku)
    top = obs.groupBy(sku).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("panelist_id").alias("panelists")).orderBy(*order).limit(n)
    return top.join(commonest(obs.join(top.select(sku), sku, "left_semi"), [sku], "title"), sku).orderBy(*order)


def is_probe():
    """Anonymous rows of a session known to be clean."""
    return (F.col("session_state") == "logged_out") & F.col("clean_session").eqNullSafe(F.lit(True))


def decide(resolved, multi_tier, checks, differences, limits: dict = DECISION):
    """TRACK_B, TRACK_A, PIVOT or INCONCLUSIVE, of four count columns."""
    cells, probes = resolved >= limits["min_cells"], checks >= limits["min_checks"]
    share, rate = F.try_divide(multi_tier, resolved), F.try_divide(differences, checks)
    return F.when(cells & (share >= limits["multi_tier_share"]), "TRACK_B").when(probes & (rate >= limits["difference_rate"]), "TRACK_A").when(cells & probes, "PIVOT").otherwise("INCONCLUSIVE")


def decision_reasons(row: dict, limits: dict = DECISION, counsel: str | None = None) -> list[str]:
    """Plain sentences on one row of decision inputs, for a report."""
    pct = lambda a, b: "n/a" if not b else f"{100 * a / b:.1f}%"
    share, rate = pct(row["multi_tier"], row["resolved"]), pct(row["differences"], row["checks"])
    out = [
        f"{row['resolved']} resolved cells, {limits['min_cells']} wanted; multi-tier share {share}.",
        f"{row['checks']} comparable checks, {limits['min_checks']} wanted; difference rate {rate}.",
        f"Verdict: {row['verdict']}.",
    ]
    return out + (["Counsel's review is outstanding, so this is not final."] if counsel is None else [])


def markdown(title: str, df: DataFrame, most: int = 200) -> str:
    """A small aggregate as a Markdown table; at most `most` rows are fetched."""
    rows = df.limit(most).collect()
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join("n/a" if v is None else str(v) for v in r) + " |" for r in rows)]) + "\n"


def rare_share_by_k(resolutions: DataFrame) -> DataFrame:
    rarest = F.array_min(F.transform("tiers", lambda t: t["share"]))
    return resolutions.where("status = 'RESOLVED'").withColumn("rarest", rarest).groupBy("k").agg(F.count(F.lit(1)).alias("cells"), F.median("rarest").alias("rarest_median"), F.min("rarest").alias("rarest_min"))


def twice_seen(votes: DataFrame) -> DataFrame:
    """Of (cell, price) groups seen at least twice, the share seen a third time."""
    groups = votes.groupBy("cell_key", "price_minor").agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.count_if(F.col("n") >= 2).alias("twice"), F.count_if(F.col("n") >= 3).alias("thrice"), F.try_divide(F.count_if(F.col("n") >= 3), F.count_if(F.col("n") >= 2)).alias("share"))


def session_rank(obs: DataFrame) -> DataFrame:
    return obs.withColumn("nth", F.row_number().over(Window.partitionBy("panelist_id").orderBy("observed_at", "observation_id")))


def window_totals(obs: DataFrame) -> DataFrame:
    """One row: rows, panelists and the latest time; null where there is none."""
    return obs.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("panelist_id").alias("panelists"), F.max("observed_at").alias("latest"))


def panelist_cells(obs: DataFrame) -> DataFrame:
    """Each panelist's cells once, with the time it was first seen there."""
    return obs.groupBy("panelist_id", "cell_key").agg(F.min("observed_at").alias("first_seen"))
