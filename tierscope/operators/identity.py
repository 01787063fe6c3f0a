"""Pseudonyms of browsers: a new one at the first use a week after the last was made, and the retired ones that are still remembered."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import joined

DAYS, KEPT = 7, 13


def minted(uses: DataFrame, days: int = DAYS) -> DataFrame:
    """browser, minted_at, nth: every use of uses(browser string, at timestamp) at which an id was made.

    Which use makes one depends on the one before, so a browser's times are one sorted run. A task holds a batch of rows and the last id made,
    whatever a browser's history is. Uses without a browser or a time make none."""
    life = days * 86_400_000_000

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        browser, last, nth = None, 0, 0
        for rows in batches:
            own, us = rows["browser"].to_numpy(), rows["us"].to_numpy()
            out: list[tuple[str, int, int]] = []
            ends = [*np.flatnonzero(own[1:] != own[:-1]) + 1, len(own)]
            for begin, end in zip([0, *ends[:-1]], ends, strict=True):
                at = begin
                if begin < end and own[begin] != browser:
                    browser, last, nth = own[begin], us[begin] - life, 0
                while (at := at + int(np.searchsorted(us[at:end], last + life))) < end:
                    last, nth = us[at], nth + 1
                    out.append((browser, last, nth))
            yield pd.DataFrame(out, columns=["browser", "us", "nth"])

    times = uses.where(F.col("browser").isNotNull() & F.col("at").isNotNull()).select("browser", F.unix_micros(F.col("at").cast("timestamp")).alias("us"))
    runs = times.repartition("browser").sortWithinPartitions("browser", "us").mapInPandas(run, "browser string, us long, nth int")
    return runs.select("browser", F.timestamp_micros("us").alias("minted_at"), "nth")


def remembered(uses: DataFrame, days: int = DAYS, kept: int = KEPT) -> DataFrame:
    """browser, id, minted_at, ids: for each id, what the browser can name after it was made: the id, then retired ones, newest first."""
    ids = minted(uses, days).withColumn("id", F.sha2(joined("browser", F.unix_micros("minted_at")), 256))
    back = Window.partitionBy("browser").orderBy("nth").rowsBetween(1 - kept, Window.currentRow)
    return ids.select("browser", "id", "minted_at", F.reverse(F.collect_list("id").over(back)).alias("ids"))
