"""New days without the history: what earlier days leave open is carried as a small state.

Bars: whether a bar is an outlier depends on the bars up to two windows around it, so the last bars of a
series may be judged anew when more come. The state keeps, for each instrument, the days that such bars
touch and a window's reach of bars before them. An append measures these days and the new ones again;
all earlier days stay as they are.

Features: lags reach back ``LAG`` days, and the targets of the last days of each horizon are still open.
The state keeps as many days as both need. An append gives the rows whose target ends in a new day; rows
that were complete before stay as they are. So the work of an append grows with the new days and the
number of instruments only. The union over all appends is what a build of everything gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators import features as E
from tidemark.operators import measures as D

#: Days that the longest lag reaches back.
LAG = 22


def bar_state(filtered: DataFrame, window: int = 50) -> DataFrame:
    """The bars that a later append needs, with ``open`` on those of days that may change. ``filtered``:
    bars after the session filter, of the state and the days appended to it, or of everything."""
    back, ahead = window // 2, window - window // 2 - 1
    whole = Window.partitionBy("instrument")
    ranked = filtered.withColumn("_end", F.row_number().over(whole.orderBy(F.col("ts").desc())))
    ranked = ranked.withColumn("_from", F.min(F.when(F.col("_end") <= 2 * ahead, B.day())).over(whole))
    ranked = ranked.withColumn("open", B.day() >= F.col("_from")).withColumn("_open", F.sum(F.col("open").cast("int")).over(whole))
    return ranked.where(F.col("_end") <= F.col("_open") + 2 * back).drop("_end", "_from", "_open")


def append_bars(state: DataFrame, bars: DataFrame, minutes: int, jump: float | None = 0.1, spread: float = 8.0, opens: str = "09:30:00", closes: str = "16:00:00") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(daily rows, the days they replace, the new state) for bars of days after the state's."""
    columns = [c for c in state.columns if c != "open"]
    new = B.session_filter(bars.select(*columns), opens, closes)
    both = state.unionByName(new.withColumn("open", F.lit(True)))
    flagged = B.outlier_flags(both, jump=jump, spread=spread)
    clean = flagged.where("open and not outlier and not jumped").select(*columns)
    days = both.where("open").select("instrument", B.day().alias("day")).distinct()
    return D.daily_measures(clean, minutes), days, bar_state(both.select(*columns))


def replaced(old: DataFrame, rows: DataFrame, days: DataFrame) -> DataFrame:
    """The old rows but for those of the given instrument-days, and the new rows."""
    return old.join(days, ["instrument", "day"], "left_anti").unionByName(rows)


def day_state(daily: DataFrame, horizons: list[int]) -> DataFrame:
    """The last days of each instrument that lags and open targets need."""
    last = F.row_number().over(Window.partitionBy("instrument").orderBy(F.col("day").desc()))
    return daily.withColumn("_end", last).where(F.col("_end") <= LAG + max(horizons)).drop("_end")


def append_days(state: DataFrame, daily: DataFrame, horizons: list[int], macro: DataFrame | None = None, event_days: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(feature rows that the new days complete, the new state). The calendars go in whole: they are
    small, and a day may need their last row before it."""
    both = state.select(*daily.columns).unionByName(daily)
    rows = E.build(both, horizons, macro, event_days)
    place = F.row_number().over(Window.partitionBy("instrument").orderBy("day"))
    old = state.groupBy("instrument").agg(F.count("*").alias("_old"))
    places = both.select("instrument", "day", place.alias("_place")).join(old, "instrument", "left")
    due = F.col("_place") + F.col("horizon") - 1 > F.coalesce("_old", F.lit(0))
    found = rows.join(places, ["instrument", "day"]).where(due).select(*rows.columns)
    return found, day_state(both, horizons)
