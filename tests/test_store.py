"""The store's files as they are read; ids of browsers; decomposed characters."""

import datetime as dt
import hashlib
import random
import re
import unicodedata

from pyspark.sql import functions as F

from tierscope.functions import text
from tierscope.operators import identity
from tierscope.sources import exports

START = dt.datetime(2026, 9, 1)


def scanned(df) -> dict[str, int]:
    """Files and rows that the scan of a plan without a shuffle reads."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    metrics = leaves.apply(0).metrics()
    return {name: metrics.apply(name).value() for name in ("numFiles", "numOutputRows")}


def test_a_store_is_read_by_day_cell_and_panelist(spark, tmp_path):
    n, path = 40_000, str(tmp_path / "store")
    ids = F.sha2(F.col("id").cast("string"), 256)
    at = F.lit(START) + F.make_dt_interval(secs=(F.col("id") * 17 % 864_000).cast("decimal(18,6)"))
    rows = spark.range(n).select(ids.alias("observation_id"), F.sha2(F.floor(F.col("id") / 10).cast("string"), 256).alias("panelist_id"), F.format_string("cell%03d", F.floor(F.col("id") / 100)).alias("cell_key"), at.alias("observed_at"), at.alias("received_at"), F.lit(199).alias("price_minor"))
    exports.write_observations(rows, path, row_group=20_000)
    whole = scanned(exports.stored_observations(spark, path))
    assert whole["numOutputRows"] == n
    # half a day of eight
    first, last = F.lit(START + dt.timedelta(days=3)), F.lit(START + dt.timedelta(days=3, hours=12))
    day = scanned(exports.stored_observations(spark, path, first, last))
    assert day["numFiles"] <= whole["numFiles"] / 4 and day["numOutputRows"] < n / 4
    # values that no file is sorted by: the Bloom filters leave few row groups; and the cell by its least and greatest values
    someone = hashlib.sha256(b"1234").hexdigest()
    for one, count in ((F.col("panelist_id") == someone, 10), (F.col("observation_id") == someone, 1), (F.col("cell_key") == "cell123", 100)):
        found = exports.stored_observations(spark, path).where(one)
        assert found.count() == count and scanned(found)["numOutputRows"] < n / 4
    got = sorted(r.observation_id for r in exports.stored_observations(spark, path, first, last).collect())
    assert got == sorted(r.observation_id for r in rows.where((F.col("received_at") >= first) & (F.col("received_at") <= last)).collect())


def test_remembered_ids_against_going_through_the_uses(spark):
    rng, uses = random.Random(2), []
    for b in ("a", "b", "hot"):
        uses += [(b, START + dt.timedelta(hours=rng.randrange(24 * 120))) for _ in range(3000 if b == "hot" else 40)]
    uses += [("once", START), ("edge", START), ("edge", START + dt.timedelta(days=7)), ("edge", START + dt.timedelta(days=14, microseconds=-1)), (None, START), ("never", None)]
    want = []
    for b in sorted({b for b, at in uses if b and at}):
        made: list = []
        for at in sorted(at for x, at in uses if x == b):
            if not made or at - made[-1] >= dt.timedelta(days=7):
                made.append(at)
                want.append((b, at, tuple(made[::-1][:13])))
    rng.shuffle(uses)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    got = identity.remembered(spark.createDataFrame(uses, "browser string, at timestamp")).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    at_of = {r.id: r.minted_at for r in got}
    assert sorted((r.browser, r.minted_at, tuple(at_of[i] for i in r.ids)) for r in got) == want
    assert identity.remembered(spark.createDataFrame([], "browser string, at timestamp")).isEmpty()


def test_tokens_of_every_character(spark):
    """Each code point between two letters, against NFKD itself."""

    def plain(x: str) -> list[str]:
        x = "".join(c for c in unicodedata.normalize("NFKD", re.sub("[\u2122\u00ae\u00a9]", " ", x)) if not unicodedata.category(c).startswith("M"))
        return [w for w in re.sub("[^a-z0-9]+", " ", x.lower().replace("%", "pct")).split() if w not in text.STOPWORDS]

    every = [c for c in map(chr, [*range(1, 0xD800), *range(0xE000, 0x110000)]) if unicodedata.category(c) not in ("Cn", "Co")]
    rows = spark.createDataFrame([(f"x{c}y",) for c in every], "t string").select("t", text.tokenize(F.col("t")).alias("w")).toPandas()
    wrong = [(t, list(w), plain(t)) for t, w in zip(rows.t, rows.w, strict=True) if list(w) != plain(t)]
    assert wrong == []
