"""URL filters: a sort-merge range join of URLs with (host, path) rules, in DataFrame operations alone.

A URL has a canonical key for each of the last labels of its host: the labels in reverse, `/`, and the path
(`www.example.org/a` gives `org//a` and `org.example//a`, as deep as any rule's host goes). A rule has one such key, and fits exactly the
keys that start with it: those from its key up to its key with a byte above all of UTF-8. These intervals nest or lie apart.

All keys and both ends of all rules are sorted together, in ranges. A sweep of the order keeps the stack of open rules: an
end that opens pushes, one that closes pops, so the depth is a running sum, and slot d of the stack is the last rule opened at depth d.
The slot at a URL's own depth is the longest of its rules. A range takes over the depth and the slots that the ranges before it have left
open, as a table of at most a row for each range and depth. Equal keys are dealt to several ranges by a hash, so a hot host or URL is split.

Defined cases: a null url, or one without `://`, has an empty host and path. Rules of one host and path are one, and `block` wins.
Of a URL's rules the one with the longest string (host and path) wins, then the longer host. Where none fits, the verdict is `default`.
Repeated and null page_ids are each judged; empty pages give an empty result; without rules all get the default; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import in_ranges, stage

OPENS, HELD, CLOSES = 0, 1, 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def labels(host: Column) -> Column:
    """The labels of a host, the last one first."""
    return F.reverse(F.split(host, r"\.", -1))


def key(reversed_labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(reversed_labels, "."), F.lit("/"), path).cast("binary")


def rule_ends(rules: DataFrame) -> DataFrame:
    """key, ord, salt, row, rule: where each rule of rules(host, path, verdict) opens and where it closes."""
    own = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    text = F.concat("host", "path")
    rule = F.struct(F.length(text).alias("size"), F.length("host").alias("host_size"), text.alias("rule"), "verdict")
    at = key(labels(F.col("host")), F.col("path"))
    ends = F.array(F.struct(at.alias("key"), F.lit(OPENS).alias("ord")), F.struct(F.concat(at, F.lit(b"\xff")).alias("key"), F.lit(CLOSES).alias("ord")))
    return own.select(F.explode(ends).alias("end"), rule.alias("rule")).select("end.key", "end.ord", F.lit(0).cast("long").alias("salt"), F.lit(None).cast("long").alias("row"), "rule")


def swept(entries: DataFrame) -> DataFrame:
    """row, rule: the innermost open rule of every entry of entries(key, ord, salt, row, rule) that is held, where one is open."""
    dealt = in_ranges(entries, "ranges", "key", "ord", "salt").withColumn("step", 1 - F.col("ord"))
    in_order = Window.partitionBy("part").orderBy("key", "ord").rowsBetween(Window.unboundedPreceding, 0)
    ranges = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    open_before = dealt.groupBy("part").agg(F.sum("step").alias("steps")).select("part", F.coalesce(F.sum("steps").over(ranges), F.lit(0)).alias("depth_before"))

    def at_depth(rows: DataFrame) -> DataFrame:
        return rows.join(open_before, "part").withColumn("depth", F.col("depth_before") + F.sum("step").over(in_order)).drop("depth_before")

    # what each range leaves in a slot holds until the next range that fills it
    slots = at_depth(dealt.where(F.col("ord") != HELD)).where(F.col("ord") == OPENS).groupBy("depth", "part").agg(F.max_by("rule", "key").alias("left"))
    last = dealt.agg(F.max("part")).first()[0] or 0
    until = F.coalesce(F.lead("part").over(Window.partitionBy("depth").orderBy("part")), F.lit(last))
    carried = slots.withColumn("until", until).where("until > part").select("depth", "left", F.explode(F.sequence(F.col("part") + 1, "until")).alias("part"))

    slot = Window.partitionBy("part", "depth").orderBy("key", "ord").rowsBetween(Window.unboundedPreceding, 0)
    top = at_depth(dealt).where((F.col("ord") != CLOSES) & (F.col("depth") > 0)).withColumn("top", F.last(F.when(F.col("ord") == OPENS, F.col("rule")), ignorenulls=True).over(slot))
    held = top.where(F.col("ord") == HELD).select("row", "part", "depth", "top")
    return held.join(carried, ["part", "depth"], "left").select("row", F.coalesce("top", "left").alias("rule"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """One row per row of pages(page_id, url): page_id, host, path, rule, verdict, by rules(host, path, verdict)."""
    host, path = host_and_path(F.coalesce(F.col("url"), F.lit("")))
    rows = stage(pages.select("page_id", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row")), "urls")
    deepest = rules.agg(F.max(F.size(labels(F.col("host"))))).first()[0] or 0
    depths = F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(deepest))) if deepest else F.array().cast("array<int>")
    held = rows.withColumn("labels", labels(F.col("host"))).select("row", "path", "labels", F.explode(depths).alias("n"))
    points = held.select(key(F.slice("labels", 1, F.col("n")), F.col("path")).alias("key"), F.lit(HELD).alias("ord"), F.xxhash64("row").alias("salt"), "row", F.lit(None).alias("rule"))
    best = swept(points.unionByName(rule_ends(rules))).groupBy("row").agg(F.max("rule").alias("best"))
    return rows.join(best, "row", "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
