"""Clock and calendar expressions. Schedule times pass 24:00 and stay numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.functions.scalar import col_of


def _parts(clock):
    """The n-th number (from 1) of a clock text; null where it is not a number."""
    split = F.split(col_of(clock), ":")
    return lambda n: F.try_element_at(split, F.lit(n)).try_cast("long")


def hms_seconds(clock) -> Column:
    """Seconds from ``HH:MM:SS``; hours may pass 24. Anything else is null."""
    part = _parts(clock)
    return part(1) * 3600 + part(2) * 60 + part(3)


def hm_minutes(clock, wrap: bool = False) -> Column:
    """Minute of day from ``HH:MM[:SS]``; ``wrap`` takes 24 off later hours. Anything else is null."""
    part = _parts(clock)
    hour = part(1)
    if wrap:
        hour = F.when(hour > 23, hour - 24).otherwise(hour)
    return hour * 60 + part(2)


def scheduled_elapsed(scheduled, start) -> Column:
    """Scheduled second less the track start.

    More than twelve hours ahead means the trip began the day before, so a day
    is taken off; a missing schedule is 0.
    """
    ahead = col_of(scheduled) - col_of(start)
    return F.coalesce(F.when(ahead > 12 * 3600, ahead - 24 * 3600).otherwise(ahead), F.lit(0))


def unwrap_end(start, end) -> Column:
    """An end at or before its start lies on the next day."""
    start, end = col_of(start), col_of(end)
    return F.when(end <= start, end + 1440).otherwise(end)


def time_features(df: DataFrame, epoch: str, tz: str = "UTC", first_day: Column | None = None) -> DataFrame:
    """Local calendar parts of an epoch column; Monday is 0.

    Seconds of day count from local midnight of ``first_day`` (the row's own
    day by default), so that a trip over midnight keeps counting.
    """
    local = F.convert_timezone(F.lit("UTC"), F.lit(tz), F.to_timestamp_ntz(F.timestamp_seconds(F.floor(epoch))))
    df = df.withColumn("_t", local)
    day = F.to_date("_t")
    first = day if first_day is None else first_day
    return df.withColumns(
        {
            "t_year": F.year("_t"),
            "t_month": F.month("_t"),
            "t_day": F.dayofmonth("_t"),
            "t_hour": F.hour("_t"),
            "t_min": F.minute("_t"),
            "t_sec": F.second("_t").cast("int"),
            "t_day_of_week": F.weekday("_t"),
            "t_min_of_day": F.hour("_t") * 60 + F.minute("_t"),
            "t_sec_of_day": F.datediff(day, first) * 86400
            + F.hour("_t") * 3600
            + F.minute("_t") * 60
            + F.second("_t").cast("int"),
        }
    ).drop("_t")
