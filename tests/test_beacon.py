"""Counters of captures: outcomes to counts, what is left after a report, reports on a stream under failures and replays."""

import datetime as dt

from pyspark.sql import functions as F

from tierscope.operators import health, probes
from tierscope.streaming import ingest as streaming

OUTCOMES = "adapter string, status string, reason string, stored int, duplicates int, rejected int, skipped map<string,bigint>, at timestamp_ntz"
AT = dt.datetime(2026, 9, 4, 12)
COUNTERS = streaming.COUNTERS


def outcome(status, adapter="a@1", reason=None, stored=0, duplicates=0, rejected=0, skipped=None, at=AT):
    return (adapter, status, reason, stored, duplicates, rejected, skipped, at)


def counters(df):
    return {r.adapter: (r.attempted, r.extracted, r.failed) for r in df.collect()}


def test_outcomes(spark):
    rows = [
        outcome("stored"), outcome("duplicate", adapter=None), outcome("rejected"), outcome("extract_failed", reason="no_price"), outcome("no_consent"), outcome("no_adapter"), outcome(None),
        outcome("listing", "b@2", None, 3, 1, 2, {"no_sku": 4, "rejected": 1, "odd": -2, "none": 0}), outcome("listing", "c@1"),
    ]
    df = spark.createDataFrame(rows, OUTCOMES)
    assert counters(health.summary(health.outcome_rows(df), ("adapter",))) == {"a@1": (3, 2, {"rejected": 1, "no_price": 1}), "b@2": (11, 6, {"no_sku": 4, "rejected": 3}), "c@1": (0, 0, {})}
    assert counters(health.summary(health.outcome_rows(df, "z"), ("adapter",)))["z"] == (1, 1, {})


def test_subtraction_stops_at_zero(spark):
    now = spark.createDataFrame([("a", 5, 3, {"x": 2, "y": 1}), ("b", 2, 2, {}), ("c", 1, 0, {"x": 1})], COUNTERS)
    sent = spark.createDataFrame([("a", 3, 4, {"x": 1, "y": 1, "w": 3}), ("b", 2, 1, {}), ("d", 9, 9, {})], COUNTERS)
    assert counters(health.subtract(now, sent)) == {"a": (2, 0, {"x": 1}), "c": (1, 0, {"x": 1})}


def test_reports(spark):
    left = spark.createDataFrame([("b", 1, 1, {}), ("a@1.2@x", 2, 1, {"x": 1}), ("c", 0, 0, {})], COUNTERS)
    r = health.reports(left, "1.0.0", F.lit("2026-09-04")).first().asDict(recursive=True)
    assert r == {"clientVersion": "1.0.0", "date": "2026-09-04", "adapters": [
        {"adapter": "a", "version": "1.2@x", "attempted": 2, "extracted": 1, "failed": {"x": 1}}, {"adapter": "b", "version": "", "attempted": 1, "extracted": 1, "failed": {}},
    ]}
    assert health.reports(left.where("attempted = 0"), "1.0.0", F.lit("")).isEmpty()


def test_a_beacon_sends_each_count_once(spark, tmp_path):
    """The second report fails, so its counts go with the third; the third batch is tried again and sends the same; the fourth has nothing new."""
    path, sent, answers = str(tmp_path), [], iter([True, False, True, True])
    run = streaming.beacon_batch(spark, path, lambda r: (sent.append(r), next(answers))[1], "1.0.0")
    batches = [[outcome("stored"), outcome("extract_failed", reason="x")], [outcome("rejected", "b")], [outcome("stored", at=AT + dt.timedelta(days=1))], []]
    for epoch, tries in [(0, 1), (1, 1), (2, 2), (3, 1)]:
        for _ in range(tries):
            run(spark.createDataFrame(batches[epoch], OUTCOMES), epoch)
    told = [(r["date"], [(a["adapter"], a["attempted"], a["failed"]) for a in r["adapters"]]) for r in sent]
    third = ("2026-09-05", [("a", 1, {}), ("b", 1, {"rejected": 1})])
    assert told == [("2026-09-04", [("a", 2, {"x": 1})]), ("2026-09-04", [("b", 1, {"rejected": 1})]), third, third]


def test_failures_by_reason(spark):
    rows = [("t", "MORE", None), ("t", "SAME", None), ("t", "UNCHECKED", "redirected"), ("t", "UNCHECKED", None), ("t", "UNCHECKED", "redirected"), ("w", "STORE_DIFFERS", None), (None, "UNCHECKED", "no_price")]
    got = {r.retailer: tuple(r)[1:] for r in probes.check_stats(spark.createDataFrame(rows, "retailer string, verdict string, reason string")).collect()}
    assert got == {"t": (5, 1, 3, {"redirected": 2, "extract_unavailable": 1}), "w": (1, 0, 0, {}), None: (1, 0, 1, {"no_price": 1})}
