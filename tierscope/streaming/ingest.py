"""Streams: ingest of batches, hourly counts, semantic dedup with keyed state, debounce.

Ingest in two steps keeps its cost apart from the size of the store: `admit_batch` checks rows and requests and lands what it admits;
`idempotent` reads what has landed as a stream and lets each id through once, by state that goes with the retention; `ingest_batch` with
ids_known then only looks at the hours around its rows. What is refused never gets into that state, so it can be sent again.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType, TimestampType

from ..operators import flagging, health, ingest
from ..schema import DEDUP_MINUTES, RATE_LIMIT, RETENTION_DAYS, WINDOW_HOURS
from ..sources.staged import staged

RESULTS = "presented long, valid long, admitted long, accepted long, duplicates long"
COUNTERS = "adapter string, attempted long, extracted long, failed map<string,bigint>"


def hourly(stream: DataFrame, key: str = "panelist_id", ts: str = "observed_at") -> DataFrame:
    """Rows per key and hour. The watermark is as long as the longest window a query looks back."""
    timed = stream.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", f"{WINDOW_HOURS} hours")
    return timed.groupBy(F.window("at", "1 hour"), key).agg(F.count(F.lit(1)).alias("rows"))


def debounced(rows: DataFrame, key: str, ts: str, gap: str = "500 milliseconds") -> DataFrame:
    """One row for each burst of a key: when it had been quiet for `gap`."""
    # a cast would take the watermark of a column away
    at = F.col(ts) if isinstance(rows.schema[ts].dataType, TimestampType) else F.col(ts).cast("timestamp")
    return rows.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("changes"), F.max(ts).alias("settled"))


def debounced_stream(stream: DataFrame, key: str, ts: str, gap: str = "500 milliseconds", late: str = "1 hour") -> DataFrame:
    """debounced() on a stream, in append mode: a burst comes once the watermark has passed its end by the gap. Rows later than `late` are left out."""
    return debounced(stream.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late), key, "at", gap).withColumn("settled", F.col("settled").cast("timestamp_ntz"))


def deduplicated(stream: DataFrame, minutes: float = DEDUP_MINUTES, key: tuple[str, ...] = ("panelist_id", "cell_key", "price_minor"), clock: str = "observed_at", hours: int = WINDOW_HOURS) -> DataFrame:
    """Semantic dedup on a stream: rows of a micro-batch oldest first, against the kept times of their key in state.

    clock: the time that state goes by. By observed_at, rows over `hours` late are lost. By received_at none is late, however old it is, and with
    `hours` as long as the retention a row meets all that is stored. State goes when the watermark is `hours` past the newest clock of its key."""
    gap, keep = int(minutes * 60 * 1_000_000), hours * 3600 * 1_000_000

    def run(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept, newest = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)  # kept is sorted
        rows = pd.concat(list(frames)).sort_values(["us", "observation_id"])
        out = []
        for us, i in zip(rows["us"].tolist(), rows["observation_id"].tolist(), strict=True):
            at = bisect_left(kept, us)
            if all(abs(us - k) >= gap for k in kept[max(0, at - 1) : at + 1]):
                insort(kept, us)
                out.append(i)
        newest = max(newest, int(rows["clock"].max()))
        # by another clock than their own, old times may still be met
        state.update(([k for k in kept if clock != "observed_at" or newest - k <= keep], newest))
        state.setTimeoutTimestamp(max((newest + keep) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"observation_id": out})

    event, ticks = F.col("observed_at").cast("timestamp"), F.col(clock).cast("timestamp")
    rows = stream.withColumns({"event_at": ticks, "us": F.unix_micros(event), "clock": F.unix_micros(ticks)}).withWatermark("event_at", f"{WINDOW_HOURS} hours")
    return rows.groupBy(*key).applyInPandasWithState(run, "observation_id long", "kept array<bigint>, newest bigint", "append", GroupStateTimeout.EventTimeTimeout)


def idempotent(stream: DataFrame, days: int = RETENTION_DAYS, received: str = "received_at") -> DataFrame:
    """Rows whose id no row has had within `days` before: an id is state as long as its row is kept, and a batch reads no table for it."""
    timed = stream.withColumn("_received", F.col(received).cast("timestamp")).withWatermark("_received", f"{days} days")
    return timed.dropDuplicatesWithinWatermark(["observation_id"]).drop("_received")


def throttled(stream: DataFrame, minutes: float = 60, key: tuple[str, ...] = ("probe_key",)) -> DataFrame:
    """At most one row of a key in any `minutes`: the same state as dedup, over another key."""
    return deduplicated(stream, minutes, key)


def _refused(own: SparkSession, batch: DataFrame, path: str, epoch: int, limit: int, request: str) -> DataFrame:
    """Requests of a batch (with window_start) that hold a panelist over the hourly limit."""
    counts = _stored(own, f"{path}/counts", _counts(batch), epoch)
    # the windows of a batch: an equality on the partition column, which prunes what is read
    hours = [r[0] for r in batch.select(_hour("window_start")).distinct().collect()]
    asked = batch.groupBy("panelist_id", "window_start").agg(F.count(F.lit(1)).alias("want"))
    have = counts.where(F.col("hour").isin(hours)).groupBy("panelist_id", "window_start").agg(F.sum("n").alias("have"))
    over = asked.join(have, ["panelist_id", "window_start"], "left").where(F.col("want") + F.coalesce("have", F.lit(0)) > limit).select("panelist_id").distinct()
    return batch.join(over, "panelist_id", "left_semi").select(request).distinct()


def _write(df: DataFrame, path: str, epoch: int, *by: str) -> None:
    df.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by, "epoch").parquet(path)


def _rows() -> Column:
    return F.count(F.lit(1)).alias("n")


def _windowed(batch: DataFrame, valid: Column | None, passed: Observation | None = None) -> DataFrame:
    rows = batch if valid is None else batch.where(valid)
    return staged(rows if passed is None else rows.observe(passed, _rows()), "batch").withColumn("window_start", F.date_trunc("hour", F.col("received_at").cast("timestamp")))


def admit_batch(spark: SparkSession, path: str, limit: int = RATE_LIMIT, request: str = "panelist_id", valid: Column | None = None):
    """A foreachBatch function: lands in path/admitted the rows that are valid, of requests that aren't refused, and counts them as presented."""

    def run(batch: DataFrame, epoch: int) -> None:
        own = spark if batch.sparkSession is None else batch.sparkSession
        columns = batch.columns
        batch = _windowed(batch, valid)
        admitted = staged(batch.join(_refused(own, batch, path, epoch, limit, request), request, "left_anti"), "admitted")
        _write(admitted.select(columns), f"{path}/admitted", epoch)
        _write(_counts(admitted), f"{path}/counts", epoch, "hour")

    return run


def landed(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """What admit_batch has landed, as a stream with the columns of `like`."""
    return spark.readStream.schema(_with_epoch(like)).parquet(f"{path}/admitted").drop("epoch")


def ingest_batch(spark: SparkSession, path: str, limit: int | None = RATE_LIMIT, minutes: float = DEDUP_MINUTES, request: str = "panelist_id", valid: Column | None = None, ids_known: bool = False, flag_hours: int | None = None, order: str = "observation_id"):
    """A foreachBatch function: checks, rate limit, dedup by id and by meaning, append, flags. path: folder of `rows`, `counts` and `flags`.

    valid: what a row has to meet; others are left out. request: the column that tells requests apart; one that holds a panelist over the
    hourly limit is refused whole and isn't counted; no limit: rows come from admit_batch. ids_known: no id comes again, as after idempotent(); else
    the ids of all stored rows are read. Rows are stored by the hour they were observed, and counts by the hour they were received, so a batch reads
    the hours around its own. path/results gets a row for each batch: how many rows came, were valid, were admitted, and of those were stored or were
    duplicates, counted by the jobs that write them. flag_hours: panelists whose prices in that many hours are out of others' range are flagged, in `order`. A batch that is
    tried again writes its own partitions anew, so it is stored once."""
    micro = f"interval {int(minutes * 60)} seconds"

    def run(batch: DataFrame, epoch: int) -> None:
        own = spark if batch.sparkSession is None else batch.sparkSession
        came, passed, let_in, stored = (Observation() for _ in range(4))
        batch = _windowed(batch.observe(came, _rows()), valid, passed)
        first, last, now = batch.agg(F.min("observed_at"), F.max("observed_at"), F.max("received_at")).first()
        if first is None:
            return
        rows = _stored(own, f"{path}/rows", batch.withColumn("hour", _hour("observed_at")), epoch)
        taken = batch
        if limit is not None:
            taken = staged(batch.join(_refused(own, batch, path, epoch, limit, request), request, "left_anti").observe(let_in, _rows()), "admitted")
        admitted = (passed if limit is None else let_in).get["n"]
        taken = taken if ids_known else ingest.new_rows(taken, rows)
        near = rows.where(F.col("hour").between(_hour(F.lit(first) - F.expr(micro)), _hour(F.lit(last) + F.expr(micro))))
        kept = staged(ingest.semantic_dedup(taken, near, minutes).observe(stored, _rows()), "kept")
        counts = (came.get["n"], passed.get["n"], admitted, stored.get["n"], admitted - stored.get["n"])
        _write(own.createDataFrame([counts], RESULTS), f"{path}/results", epoch)
        _write(kept.withColumn("hour", _hour("observed_at")), f"{path}/rows", epoch, "hour")
        if limit is not None:
            _write(_counts(kept), f"{path}/counts", epoch, "hour")
        if flag_hours is not None:
            back = F.lit(now) - F.expr(f"interval {flag_hours} hours")
            recent = rows.where((F.col("hour") >= _hour(back)) & (F.col("observed_at") >= back) & (F.col("observed_at") <= F.lit(now)))
            in_time = kept.where((F.col("observed_at") >= back) & (F.col("observed_at") <= F.lit(now)))
            cells = recent.select("cell_key", "panelist_id", "price_minor").union(in_time.select("cell_key", "panelist_id", "price_minor"))
            pairs = flagging.pairs_of(kept, order)
            like = pairs.select("panelist_id", F.lit("suspect").alias("status"), "cell_key", F.lit("").alias("reason"), "place")
            flags = flagging.flags_in_order(pairs, cells, _stored(own, f"{path}/flags", like, epoch))
            _write(flags.select(like.columns), f"{path}/flags", epoch)

    return run


def beacon_batch(spark: SparkSession, path: str, post: Callable[[dict], bool], client_version: str, fallback: str | None = None):
    """A foreachBatch function: counts the outcomes of captures, reports what was not sent yet, and takes it off once `post` says that it went.

    path: folder of `counted` and `sent`, each with a few rows for each batch. What isn't sent stays and goes with the next report. A batch that is
    tried again writes its own rows anew and sends what it sent before, so nothing is counted twice here. The report is dated by the batch's newest `at`."""

    def run(batch: DataFrame, epoch: int) -> None:
        own = spark if batch.sparkSession is None else batch.sparkSession
        like, key = own.createDataFrame([], COUNTERS), ("adapter",)
        batch = staged(batch, "outcomes")
        _write(health.summary(health.outcome_rows(batch, fallback), key), f"{path}/counted", epoch)
        counted = own.read.schema(_with_epoch(like)).parquet(f"{path}/counted").where(F.col("epoch") <= epoch)
        sent = _stored(own, f"{path}/sent", like, epoch)
        left = staged(health.subtract(health.summary(counted, key), health.summary(sent, key)), "left")
        date = F.lit(batch.agg(F.date_format(F.max("at"), "yyyy-MM-dd")).first()[0])
        report = health.reports(left, client_version, date).first()
        if report is not None and post(report.asDict(recursive=True)):
            _write(left, f"{path}/sent", epoch)

    return run


def _with_epoch(like: DataFrame) -> StructType:
    return StructType([*like.schema.fields, StructField("epoch", LongType())])


def _hour(at: Column | str) -> Column:
    return F.date_format(F.col(at) if isinstance(at, str) else at, "yyyyMMddHH").cast("long").alias("hour")



def _counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("panelist_id", "window_start").agg(F.count(F.lit(1)).alias("n")).withColumn("hour", _hour("window_start"))


def _stored(spark: SparkSession, path: str, like: DataFrame, epoch: int) -> DataFrame:
    """What other epochs have stored under path, with the columns of `like`."""
    try:
        there = spark.read.schema(_with_epoch(like)).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return like.limit(0)
    return there.where(F.col("epoch") != epoch).drop("epoch")
