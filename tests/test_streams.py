"""Flags in order against going one by one, ids as state, late rows, ingest in two steps."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tierscope.operators import flagging, ingest
from tierscope.streaming import ingest as streaming

T0 = dt.datetime(2026, 9, 4)
ROWS = "observation_id long, panelist_id long, cell_key string, price_minor long, currency string, observed_at timestamp_ntz, received_at timestamp_ntz"


def one_by_one(batch, rows, flags):
    """(panelist, cell, place) of the flags that pairs add, each seeing those before it."""
    status, out, done = dict(flags), [], set()
    by_cell = defaultdict(lambda: defaultdict(list))
    for c, p, price in rows:
        by_cell[c][p].append(price)
    for i, p, c in sorted(batch):
        if (p, c) in done or status.get(p) == "suspect":
            continue
        done.add((p, c))
        others = [x for q, v in by_cell[c].items() if q != p and status.get(q) != "suspect" for x in v]
        n = len({q for q in by_cell[c] if q != p and status.get(q) != "suspect"})
        own = by_cell[c].get(p, [])
        if n >= 3 and own and all(x < 0.5 * min(others) or x > 1.5 * max(others) for x in own) and p not in status:
            status[p] = "suspect"
            out.append((p, c, i))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_flags_in_order(spark, seed):
    rng = random.Random(seed)
    factor = {8: 2, 9: 4, 10: 4, 11: 9, 12: 0.1, 13: 0.2}
    rows = [(f"c{rng.randrange(12)}", p, int(rng.choice([100, 110, 120, 130]) * factor.get(p, 1))) for p in (rng.randrange(14) for _ in range(90))]
    batch = [(i, p, c) for i, (c, p, _) in enumerate(rng.sample(rows, 70))] + [(500 + i, 20 + i, "c0") for i in range(2)]
    flags = [(0, "suspect"), (1, "cleared"), (99, "suspect")]
    pairs = flagging.pairs_of(spark.createDataFrame(batch, "observation_id long, panelist_id long, cell_key string"))
    got = flagging.flags_in_order(pairs, spark.createDataFrame(rows, "cell_key string, panelist_id long, price_minor long"), spark.createDataFrame(flags, "panelist_id long, status string")).collect()
    want = one_by_one(batch, rows, flags)
    assert len(want) > 1 and sorted((r.panelist_id, r.cell_key, r.place) for r in got) == want and {r.status for r in got} == {"suspect"}


def test_flags_of_all_observations(spark, data):
    from tierscope.operators import windows
    from tierscope.plans import views as V
    from tierscope.plans.catalog import QUERIES, obs

    o = obs(spark, data)
    batch = [tuple(r) for r in o.select("observation_id", "panelist_id", "cell_key").collect()]
    rows = [tuple(r) for r in windows.trailing(o, V.NOW).select("cell_key", "panelist_id", "price_minor").collect()]
    want = one_by_one(batch, rows, [tuple(r) for r in V.flags(o).select("panelist_id", "status").collect()])
    assert sorted((r.panelist_id, r.cell_key, r.place) for r in QUERIES["flags_in_order"](spark, data).collect()) == want


def test_a_flag_that_undoes_a_later_one(spark):
    """x is flagged first; without x only two others are left for y."""
    rows = [("c", 1, 100), ("c", 2, 110), ("c", 8, 900), ("c", 9, 10), ("c", 3, 120)]
    batch = [(1, 8, "c"), (2, 9, "c")]
    run = lambda keep: flagging.flags_in_order(flagging.pairs_of(spark.createDataFrame(batch, "observation_id long, panelist_id long, cell_key string")), spark.createDataFrame(keep, "cell_key string, panelist_id long, price_minor long"), spark.createDataFrame([], "panelist_id long, status string")).collect()
    for keep in (rows, rows[:-1]):
        assert sorted((r.panelist_id, r.cell_key, r.place) for r in run(keep)) == one_by_one(batch, keep, [])
    assert {r.panelist_id for r in run(rows)} == {8, 9} and {r.panelist_id for r in run(rows[:-1])} == {8}


def replay(spark, folder, batches, made, name):
    """A stream of files, one each time it runs."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(f"{folder}/{name}-in")
        made(spark.readStream.schema(ROWS).parquet(f"{folder}/{name}-in"), k)


def test_ingest_in_two_steps(spark, tmp_path, monkeypatch):
    """Admitted rows land; each id goes on once, however often it is sent; a refused one can come again; no batch looks the ids up."""
    folder = "file://" + str(tmp_path)
    row = lambda i, who, m, price=199: (i, who, "c", price, "USD", T0 + dt.timedelta(minutes=m), T0 + dt.timedelta(minutes=m))
    batches = [
        [row(1, 1, 0), row(2, 2, 0, 210), row(3, 3, 1, 220), row(4, 4, 2, -1)],
        [row(1, 1, 0), row(5, 1, 3), row(6, 9, 30, 900), row(7, 5, 31, 215)],
        [row(1, 1, 500), row(2, 2, 0, 210), *(row(20 + i, 7, 600 + 2 * i, 300 + i) for i in range(4))],
        [row(20, 7, 700, 300), row(6, 9, 30, 900)],
    ]
    monkeypatch.setattr(ingest, "new_rows", lambda *a, **k: pytest.fail("the ids of stored rows were read"))
    admit = streaming.admit_batch(spark, folder, limit=3, valid=F.col("price_minor") > 0)
    store = streaming.ingest_batch(spark, folder, limit=None, minutes=10, ids_known=True, flag_hours=72)

    def made(stream, k):
        stream.writeStream.foreachBatch(admit).option("checkpointLocation", f"{folder}/a").trigger(availableNow=True).start().awaitTermination()
        seen = streaming.idempotent(streaming.landed(spark, folder, stream))
        seen.writeStream.foreachBatch(store).option("checkpointLocation", f"{folder}/b").trigger(availableNow=True).start().awaitTermination()

    replay(spark, folder, batches, made, "two")
    stored = sorted((r.observation_id, r.price_minor) for r in spark.read.parquet(f"{folder}/rows").collect())
    assert stored == [(1, 199), (2, 210), (3, 220), (6, 900), (7, 215), (20, 300)]  # 5 is near 1; the four of panelist 7 were refused, then 20 came alone
    assert [(r.panelist_id, r.cell_key) for r in spark.read.parquet(f"{folder}/flags").collect()] == [(9, "c")]
    counted = {r.panelist_id: r.n for r in spark.read.parquet(f"{folder}/counts").groupBy("panelist_id").agg(F.sum("n").alias("n")).collect()}
    assert counted[1] == 4 and counted[7] == 1  # as presented


def test_ids_are_forgotten_after_the_retention(spark, tmp_path):
    folder, day = "file://" + str(tmp_path), 1440
    row = lambda i, m: (i, 1, "c", 1, "USD", T0, T0 + dt.timedelta(minutes=m))
    got = []

    def made(stream, k):
        q = streaming.idempotent(stream).writeStream.foreachBatch(lambda df, e: got.extend(r.observation_id for r in df.collect())).option("checkpointLocation", f"{folder}/s").trigger(availableNow=True).start()
        q.awaitTermination()

    replay(spark, folder, [[row(1, 0), row(1, 5)], [row(1, 89 * day), row(2, 89 * day)], [row(3, 200 * day)], [row(1, 200 * day), row(3, 200 * day)]], made, "ids")
    assert got == [1, 2, 3, 1]


@pytest.mark.parametrize("late_first", [False, True])
def test_late_rows_are_taken_by_the_clock_of_receipt(spark, tmp_path, late_first):
    folder = "file://" + str(tmp_path)
    row = lambda i, observed, received: (i, 1, "c", 1, "USD", T0 + dt.timedelta(hours=observed), T0 + dt.timedelta(hours=received))
    old, twin, new = row(1, 0, 300), row(2, 0.1, 301), row(3, 299, 299)
    batches = [[old], [new], [twin]] if late_first else [[new], [old], [twin]]
    got = []

    def made(stream, k):
        s = streaming.deduplicated(stream, 10, clock="received_at", hours=24 * 90)
        s.writeStream.foreachBatch(lambda df, e: got.extend(r.observation_id for r in df.collect())).option("checkpointLocation", f"{folder}/s").trigger(availableNow=True).start().awaitTermination()

    replay(spark, folder, batches, made, "late")
    assert sorted(got) == [1, 3]


def test_pairs_on_a_stream_are_those_of_a_batch(spark, tmp_path):
    """Ties, rows on the edges of the band, rows of others, whatever order the batches bring; a last row far ahead lets all before it out."""
    from tierscope.operators import probes
    from tierscope.streaming import probing

    rng = random.Random(5)
    schema = "observation_id long, panelist_id long, retailer string, sku string, observed_at timestamp_ntz, price_minor long, store_id string, store_label string, session_state string, clean_session boolean"
    at = lambda: T0 + dt.timedelta(minutes=rng.randrange(0, 300, 5), milliseconds=rng.choice([0, 0, 400]))
    one = lambda i, when: (i, rng.randrange(3), "target", rng.choice("ab"), when, rng.choice([100, 110]), rng.choice([None, "1", "2"]), None, *rng.choice([("logged_in", None), ("logged_out", True)]))
    rows = [one(i, at()) for i in range(120)]
    df, folder = spark.createDataFrame(rows, schema), "file://" + str(tmp_path)
    want = sorted(map(str, probes.pair(df, 60, 5).collect()))
    assert "mine_id=None" in "".join(want) and "delta=10" in "".join(want)
    closing = [(10_000 + k, 99, "target", "z", T0 + dt.timedelta(days=30 * (k + 1)), 1, None, None, "logged_out", True) for k in range(2)]
    for rows_of_batch in (rows[::2], rows[1::2], closing[:1], closing[1:]):
        spark.createDataFrame(rows_of_batch, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        q = probing.paired(spark.readStream.schema(schema).parquet(f"{folder}/in"), 60, 5, "6 hours")
        q.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/s").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{folder}/out").where("observation_id < 10000").select(probes.pair(df, 60, 5).columns)
    assert sorted(map(str, got.collect())) == want
