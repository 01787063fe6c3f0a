"""Time windows over observations, and the latest row of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import WINDOW_HOURS


def _at(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v).cast("timestamp_ntz")


def trailing(obs: DataFrame, now, hours: int = WINDOW_HOURS, ts: str = "observed_at") -> DataFrame:
    """Rows of the closed window [now - hours, now]; later ones and ones without a time are left out."""
    if not hours > 0:
        raise ValueError("hours must be above zero")
    return obs.where(F.col(ts).between(_at(now) - F.expr(f"interval {hours} hours"), _at(now)))


def half_open(obs: DataFrame, start, end, ts: str = "observed_at") -> DataFrame:
    """Rows of [start, end)."""
    return obs.where((F.col(ts) >= _at(start)) & (F.col(ts) < _at(end)))


def week_bounds(start: Column, week: Column) -> tuple[Column, Column]:
    """Begin and end of week 1, 2, ... counted from start."""
    return start + F.make_interval(days=7 * (week - 1)), start + F.make_interval(days=7 * week)


def since_date(today: Column, days: int = 7) -> Column:
    """The first of the last `days` dates, today included."""
    return F.date_sub(today, days - 1)


ORDER = ("observed_at", "received_at", "observation_id")


def latest(obs: DataFrame, key: tuple[str, ...], order: tuple[str, ...] = ORDER) -> DataFrame:
    """The latest row of each key. An aggregate, so that rows are reduced before they move."""
    rest = [c for c in obs.columns if c not in key]
    best = obs.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(*key, *(F.col("_best")[c].alias(c) for c in rest)).select(*obs.columns)


def votes(obs: DataFrame, cell: str = "cell_key", panelist: str = "panelist_id") -> DataFrame:
    """One vote for each panelist in a cell: the latest row."""
    return latest(obs, (cell, panelist))


def without_suspects(obs: DataFrame, flags: DataFrame) -> DataFrame:
    """Rows of panelists that no flag of status 'suspect' names, reviewed or not."""
    return obs.join(flags.where("status = 'suspect'").select("panelist_id"), "panelist_id", "left_anti")


def newest(rows: DataFrame, n: int, by: Column | str, *ties: Column | str, key: tuple[str, ...] = ()) -> DataFrame:
    """The newest n rows (of each key)."""
    order = [F.desc(by) if isinstance(by, str) else by.desc(), *ties]
    if not key:
        return rows.orderBy(*order).limit(n)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def sliced(rows: DataFrame, key: tuple[str, ...], order: tuple[str, ...], size: int) -> DataFrame:
    """Rows with the number of their slice of `size` rows within each key, from 0."""
    return rows.withColumn("slice", F.floor((F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1) / size).cast("int"))


def islands(rows: DataFrame, key: tuple[str, ...], order: tuple[str, ...], value: str) -> DataFrame:
    """Rows with a session number that goes up where value changes, and their count within the session."""
    w = Window.partitionBy(*key).orderBy(*order)
    changed = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    numbered = rows.withColumn("session", F.sum(changed).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.withColumn("count", F.row_number().over(Window.partitionBy(*key, "session").orderBy(*order)))
