"""What happens to a batch before it is stored: id and semantic dedup, rate limits, suspects, mutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import SEMANTIC
from ..schema import ABUSE_HIGH, ABUSE_LOW, ABUSE_PANELISTS, DEDUP_MINUTES, RATE_LIMIT, RETENTION_DAYS, SCHEMA_VERSION


def first_of(rows: DataFrame, key: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The first row of each key; an aggregate, so that rows are reduced before they move."""
    rest = [c for c in rows.columns if c not in key]
    got = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_f"))
    return got.select(*key, *(F.col("_f")[c].alias(c) for c in rest)).select(*rows.columns)


def new_rows(batch: DataFrame, stored: DataFrame, key: str = "observation_id", order: tuple[str, ...] = ("received_at",)) -> DataFrame:
    """The rows of a batch to append: the first of each id, where the table has none yet."""
    return first_of(batch, (key,), order).join(stored.select(key), key, "left_anti")


def _kept_times(events: Column, gap: int) -> Column:
    """Greedy fold over sorted (at, stored, id, near_stored): an event is kept if no stored and no kept one is nearer than gap."""
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<bigint>").alias("ids"))

    def step(state, e):
        near = F.coalesce(e["at"] - state["last"] < gap, F.lit(False)) | e["near_stored"]
        keep = ~e["stored"] & ~near
        return F.struct(F.when(keep, e["at"]).otherwise(state["last"]).alias("last"), F.when(keep, F.concat(state["ids"], F.array(e["id"]))).otherwise(state["ids"]).alias("ids"))

    return F.aggregate(events, start, step)["ids"]


def semantic_dedup(batch: DataFrame, stored: DataFrame | None = None, minutes: float = DEDUP_MINUTES, key: tuple[str, ...] = SEMANTIC) -> DataFrame:
    """Rows of a batch that repeat no stored row and no kept row of the same key within less than `minutes`, oldest first.

    Stored rows are read only around the batch: each key's earliest to latest time, `minutes` wider. Windows tell the nearest
    stored times and cut a key's rows where they are `minutes` apart or more; what is kept in one such stretch says nothing about the
    next, so the greedy fold holds one stretch and not the history of a key."""
    micro = int(minutes * 60_000_000)
    at = F.unix_micros(F.col("observed_at").cast("timestamp"))
    new = batch.select(*key, at.alias("at"), F.lit(False).alias("stored"), F.col("observation_id").alias("id"))
    rows = new
    if stored is not None:
        span = new.groupBy(*key).agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
        old = stored.select(*key, at.alias("at"), F.lit(True).alias("stored"), F.col("observation_id").alias("id")).join(span, list(key))
        rows = new.union(old.where((F.col("at") > F.col("lo") - micro) & (F.col("at") < F.col("hi") + micro)).drop("lo", "hi"))
    order = Window.partitionBy(*key).orderBy("at", "stored", "id")
    back, ahead = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    marked = rows.withColumn("begins", F.coalesce(F.col("at") - F.lag("at").over(order) >= micro, F.lit(True)))
    if stored is None:
        marked = marked.withColumn("near_stored", F.lit(False))
    else:
        old_at = F.when(F.col("stored"), F.col("at"))
        before, after = F.last(old_at, ignorenulls=True).over(back), F.first(old_at, ignorenulls=True).over(ahead)
        marked = marked.withColumn("near_stored", F.coalesce(F.col("at") - before < micro, F.lit(False)) | F.coalesce(after - F.col("at") < micro, F.lit(False)))
    stretches = marked.withColumn("stretch", F.count_if("begins").over(back)).groupBy(*key, "stretch").agg(F.array_sort(F.collect_list(F.struct("at", "stored", "id", "near_stored"))).alias("e"))
    kept = stretches.select(F.explode(_kept_times(F.col("e"), micro)).alias("observation_id"))
    return batch.join(kept, "observation_id", "left_semi")


def rate_windows(rows: DataFrame, key: str = "panelist_id", ts: str = "received_at") -> DataFrame:
    return rows.groupBy(key, F.date_trunc("hour", ts).alias("window_start")).agg(F.count(F.lit(1)).alias("count"))


def add_counts(buckets: DataFrame, more: DataFrame, key: tuple[str, ...] = ("key", "window_start")) -> DataFrame:
    """The upsert-increment: counts of the same bucket added up."""
    return buckets.unionByName(more).groupBy(*key).agg(F.sum("count").alias("count"))


def demands(rows: DataFrame, token: Column) -> DataFrame:
    """What a batch asks for: rows in all under its token, and for each panelist."""
    own = rows.groupBy(F.concat(F.lit("panelist:"), F.col("panelist_id").cast("string")).alias("key")).agg(F.count(F.lit(1)).alias("demand"))
    return rows.groupBy(token.alias("key")).agg(F.count(F.lit(1)).alias("demand")).union(own)


def counts_for(keys: DataFrame, buckets: DataFrame, on: list[str]) -> DataFrame:
    """Bucket counts for keys, zero where there is none."""
    return keys.join(buckets, on, "left").withColumn("count", F.coalesce("count", F.lit(0)))


def over_limit(asked: DataFrame, buckets: DataFrame, limit: int = RATE_LIMIT) -> DataFrame:
    """Keys whose demand goes beyond the limit; a batch with any is refused whole, and the token comes first."""
    return counts_for(asked, buckets, ["key"]).where(F.col("count") + F.col("demand") > limit).orderBy(~F.col("key").startswith("token:"), "key")


def suspects(obs: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """(cell, panelist) pairs whose every price is below half the least or above one and a half times the largest of at least
    three other panelists, flagged ones left out.

    The range of the others comes from the two least and two largest panelists of the cell, so no cell is joined to itself."""
    own = obs.groupBy("cell_key", "panelist_id").agg(F.min("price_minor").alias("lo"), F.max("price_minor").alias("hi"))
    base = own
    if flags is not None:
        base = own.join(flags.where("status = 'suspect'").select("panelist_id"), "panelist_id", "left_anti")
    first = base.groupBy("cell_key").agg(F.count(F.lit(1)).alias("panelists"), F.min(F.struct("lo", "panelist_id")).alias("lo1"), F.max(F.struct("hi", "panelist_id")).alias("hi1"))
    ends = base.join(first, "cell_key")
    second = ends.groupBy("cell_key").agg(F.min(F.when(F.col("panelist_id") != F.col("lo1.panelist_id"), F.col("lo"))).alias("lo2"), F.max(F.when(F.col("panelist_id") != F.col("hi1.panelist_id"), F.col("hi"))).alias("hi2"))
    inside = base.select("cell_key", "panelist_id", F.lit(1).alias("is_in"))
    all_ = own.join(first, "cell_key").join(second, "cell_key").join(inside, ["cell_key", "panelist_id"], "left")
    others = F.col("panelists") - F.coalesce("is_in", F.lit(0))
    low = F.when(F.col("panelist_id") == F.col("lo1.panelist_id"), F.col("lo2")).otherwise(F.col("lo1.lo"))
    high = F.when(F.col("panelist_id") == F.col("hi1.panelist_id"), F.col("hi2")).otherwise(F.col("hi1.hi"))
    told = all_.select("cell_key", "panelist_id", "lo", "hi", others.alias("others"), low.alias("others_lo"), high.alias("others_hi")).where(F.col("others") >= ABUSE_PANELISTS)
    prices = obs.select("cell_key", "panelist_id", "price_minor").join(told, ["cell_key", "panelist_id"])
    inside_band = (F.col("price_minor") >= ABUSE_LOW * F.col("others_lo")) & (F.col("price_minor") <= ABUSE_HIGH * F.col("others_hi"))
    return prices.groupBy("cell_key", "panelist_id", "others", "others_lo", "others_hi").agg(F.count_if(inside_band).alias("inside")).where("inside = 0").drop("inside")


def suspect_reason() -> Column:
    return F.format_string("every price is outside [%d, %d] as seen by %d other panelists", "others_lo", "others_hi", "others")


def flag_new(flags: DataFrame, found: DataFrame) -> DataFrame:
    """Flags to append: one for each panelist that has none, whatever its status; the first cell by key gives the reason."""
    rows = found.withColumn("reason", suspect_reason())
    return rows.groupBy("panelist_id").agg(F.min_by(F.struct("cell_key", "reason"), "cell_key").alias("f")).join(flags.select("panelist_id"), "panelist_id", "left_anti").select("panelist_id", F.lit("suspect").alias("status"), "f.cell_key", "f.reason")


def purged(rows: DataFrame, now: Column, ts: str = "received_at", days: int = RETENTION_DAYS) -> DataFrame:
    """What stays after retention; a row exactly at the cutoff stays."""
    return rows.where(F.col(ts) >= now - F.expr(f"interval {days} days"))


def without_panelists(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select("panelist_id").distinct(), "panelist_id", "left_anti")


def pending(rows: DataFrame, sent: DataFrame, key: str = "observation_id") -> DataFrame:
    return rows.join(sent.select(key), key, "left_anti")


def live_sent(sent: DataFrame, stored: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Entries of what was sent to keep: still in the store, or younger than `days`."""
    there = stored.select("observation_id", F.lit(True).alias("there")).distinct()
    return sent.join(there, "observation_id", "left").where(F.col("there") | (F.col("sent_at") >= now - F.expr(f"interval {days} days"))).drop("there")


def backoff_ms(failures: Column) -> Column:
    """15 minutes, doubled for each failure after the first, a day at most."""
    return F.when(failures <= 0, 0).otherwise(F.least(F.lit(86_400_000.0), 900_000 * F.pow(F.lit(2.0), failures - 1))).cast("long")


def in_backoff(until: Column, now: Column) -> Column:
    """Whether uploads still wait at `now`. No wait is longer than a day: where the clock went back further, nothing is held up."""
    left = F.unix_millis(until.cast("timestamp")) - F.unix_millis(now.cast("timestamp"))
    return F.coalesce((left > 0) & (left <= 86_400_000), F.lit(False))


def until_next_window(at: Column) -> Column:
    """Whole seconds until the next hour begins, at least one: when a refused request may come again."""
    hour = 3_600_000_000
    return F.greatest(F.lit(1), F.ceil((hour - F.pmod(F.unix_micros(at.cast("timestamp")), F.lit(hour))) / 1_000_000)).cast("long")


def epoch_ms(value: Column) -> Column:
    """Milliseconds since 1970 of a text: a number as it is, an instant in ISO 8601 (UTC where it names no zone); null, or an error where it is neither."""
    told = F.transform(F.array(value.cast("string")), lambda v: F.coalesce(v.try_cast("double").cast("long"), F.unix_millis(v.try_cast("timestamp"))))[0]
    return F.when(value.isNotNull(), F.coalesce(told, F.raise_error(F.concat(F.lit("not a valid instant: "), value.cast("string"))).cast("long")))


def completed(extracted: DataFrame, panelist: Column, client_version: Column, at: Column | None = None) -> DataFrame:
    """What a page gave, as whole observations: an id of its own, the panelist, the time and the provenance."""
    rest = [c for c in extracted.columns if c not in ("adapter", "evidenceHash")]
    provenance = F.struct(F.col("adapter").alias("adapter"), client_version.alias("clientVersion"), F.col("evidenceHash").alias("evidenceHash"))
    return extracted.select(F.lit(SCHEMA_VERSION).alias("schemaVersion"), F.uuid().alias("observationId"), panelist.alias("panelistId"), (F.current_timestamp() if at is None else at).alias("observedAt"), *rest, provenance.alias("provenance"))


def ids_to_delete(known: DataFrame, rows: DataFrame) -> DataFrame:
    """panelist_id, known: the identity's own ids, then any other that is still on a stored row; each once."""
    own = known.select("panelist_id").distinct()
    others = rows.select("panelist_id").distinct().join(own, "panelist_id", "left_anti")
    return own.withColumn("known", F.lit(True)).union(others.withColumn("known", F.lit(False)))


def _split(tables: dict[str, DataFrame], stays: dict[str, Column]) -> tuple[dict[str, DataFrame], DataFrame]:
    """What stays of each table, and (table, deleted) for all of them."""
    counts = None
    for name, rows in tables.items():
        one = rows.agg(F.count_if(~F.coalesce(stays[name], F.lit(False))).alias("deleted")).select(F.lit(name).alias("table"), "deleted")
        counts = one if counts is None else counts.union(one)
    return {name: rows.where(stays[name]) for name, rows in tables.items()}, counts


def deleted(tables: dict[str, DataFrame], ids: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every table without the rows of these panelists, and how many each lost; a second time deletes nothing."""
    gone = ids.select("panelist_id", F.lit(True).alias("_gone")).distinct()
    marked = {name: rows.join(gone, "panelist_id", "left") for name, rows in tables.items()}
    kept, counts = _split(marked, dict.fromkeys(tables, F.col("_gone").isNull()))
    return {name: rows.drop("_gone") for name, rows in kept.items()}, counts


def retained(observations: DataFrame, flags: DataFrame, buckets: DataFrame, now: Column) -> tuple[dict[str, DataFrame], DataFrame]:
    """What stays of raw rows by receipt, of flags by the time they were set, and of rate buckets by their window; and what goes.

    Rows exactly at a cutoff stay."""
    raw, hours = now - F.expr(f"interval {RETENTION_DAYS} days"), now - F.expr("interval 2 hours")
    return _split({"observations": observations, "flags": flags, "buckets": buckets}, {"observations": F.col("received_at") >= raw, "flags": F.col("flagged_at") >= raw, "buckets": F.col("window_start") >= hours})
