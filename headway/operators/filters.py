"""Row, track and service filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.functions.scalar import hash_number
from headway.ordered import with_group

WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
Ranges = Mapping[str, tuple[float, float]]


def _all(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)


def filter_points(df: DataFrame, ranges: Ranges) -> DataFrame:
    """Rows strictly inside every range; null fails."""
    return df.filter(_all([(F.col(c) > lo) & (F.col(c) < hi) for c, (lo, hi) in ranges.items()]))


def dropout(df: DataFrame, frac: float, seed: int, key: Sequence[str]) -> DataFrame:
    """Remove a share of rows chosen by a hash of the key: repeatable on any layout."""
    share = F.pmod(hash_number(key, seed), F.lit(1_000_000))
    return df.filter(share >= int(frac * 1_000_000))


def filter_tracks(
    df: DataFrame, track: str, ranges: Ranges, min_points: int = 2, counted: str | None = None
) -> DataFrame:
    """Drop whole tracks with too few points or any point outside a range.

    Range ends are allowed and nulls do not offend. ``counted`` names the
    column whose non-null values make up the number of points.
    """
    outside = F.lit(False)
    for c, (lo, hi) in ranges.items():
        outside = outside | F.coalesce((F.col(c) < lo) | (F.col(c) > hi), F.lit(False))
    bad = (
        df.filter(F.col(track).isNotNull())
        .groupBy(track)
        .agg(F.count(counted or F.lit(1)).alias("_n"), F.bool_or(outside).alias("_out"))
        .filter((F.col("_n") < min_points) | F.col("_out"))
        .select(track)
    )
    return df.join(bad, track, "left_anti")


def slice_vehicle(df: DataFrame, vehicle: str, value, epoch: str, start: int, end: int) -> DataFrame:
    """One vehicle's rows in a closed epoch range, ids compared as whole numbers; others match nothing."""

    def whole(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(text.try_cast("long"), text.try_cast("decimal(38, 6)").try_cast("long"))

    return df.filter((whole(F.col(vehicle)) == whole(F.lit(value))) & F.col(epoch).try_cast("long").between(start, end))


def active_services(
    calendar: DataFrame, day: date, in_range: bool = True, exceptions: DataFrame | None = None, feed: Sequence[str] = ()
) -> DataFrame:
    """Services that run on the day; with ``in_range`` False only the weekday counts.

    ``exceptions`` (service_id, date, exception_type) adds (1) and removes (2)
    services for the day. ``feed`` columns are part of a service's key.
    """
    key = [*feed, "service_id"]
    runs = F.col(WEEKDAYS[day.weekday()]) == 1
    if in_range:
        start, end = (F.to_date(F.col(c).cast("string"), "yyyyMMdd") for c in ("start_date", "end_date"))
        runs = runs & F.lit(day).between(start, end)
    active = calendar.filter(runs).select(*key)
    if exceptions is None:
        return active
    that_day = F.to_date(F.col("date").cast("string"), "yyyyMMdd") == F.lit(day)
    added = exceptions.filter(that_day & (F.col("exception_type") == 1)).select(*key)
    gone = exceptions.filter(that_day & (F.col("exception_type") == 2)).select(*key)
    return active.join(gone, key, "left_anti").unionByName(added).distinct()


def day_services(
    trips: DataFrame, calendar: DataFrame | None, day: date, feed: Sequence[str], exceptions: DataFrame | None = None
) -> DataFrame:
    """The services to use for a day, per feed.

    Those running on the date; a feed with none of them is taken whole, and
    then by weekday alone. Without a calendar the service with most trips
    counts, and a feed's only service always does. A calendar that has the
    ``feed`` columns is matched on them; one without serves all feeds alike.
    """
    feed = list(feed)
    counts = trips.groupBy(*feed, "service_id").agg(F.count(F.lit(1)).alias("n_trips"))
    if calendar is None:
        best = counts.groupBy(*feed).agg(
            F.min_by("service_id", F.struct(-F.col("n_trips"), "service_id")).alias("service_id")
        )
        return best
    own = [c for c in feed if c in calendar.columns]
    key = [*own, "service_id"]
    today = active_services(calendar, day, True, exceptions, own).distinct().withColumn("_on", F.lit(1))
    weekday = active_services(calendar, day, False, exceptions, own).distinct().withColumn("_wd", F.lit(1))
    flags = counts.join(today, key, "left").join(weekday, key, "left")
    flags = with_group(flags, feed, _any=F.count("_on"), _services=F.count(F.lit(1)))
    keep = (
        F.when(F.col("_any") > 0, F.col("_on") == 1)
        .when(F.col("_services") == 1, F.lit(True))
        .otherwise(F.col("_wd") == 1)
    )
    return flags.filter(keep).select(*feed, "service_id")


def keep_scheduled(points: DataFrame, schedule: DataFrame, by: Sequence[str], key: str | Sequence[str] = "trip_id") -> DataFrame:
    """Drop points whose trip is not scheduled, unless no trip of the group is.

    ``key`` may name a feed and a version besides the trip. A group (a day, a feed)
    without any match is kept whole and marked ``scheduled`` = false, so that the later
    steps can fill their constants. Groups are few: what is known of each is broadcast.
    """
    key = [key] if isinstance(key, str) else list(key)
    known = schedule.select(*key).distinct().withColumn("scheduled", F.lit(True))
    marked = points.join(known, key, "left").withColumn("scheduled", F.coalesce("scheduled", F.lit(False)))
    return with_group(marked, by, few=True, _any=F.bool_or("scheduled")).filter(F.col("scheduled") | ~F.col("_any")).drop("_any")


def without_rows(df: DataFrame, bad: Column, track: str) -> DataFrame:
    """Drop every track that has an offending row; only offenders are shuffled early."""
    return df.join(df.filter(bad).select(track).distinct(), track, "left_anti")


def drop_jump_trips(df: DataFrame, track: str, step: str, max_m: float = 100_000) -> DataFrame:
    """Drop tracks with any step above the limit."""
    return without_rows(df, F.col(step) > max_m, track)


def drop_speed_outliers(df: DataFrame, track: str, speed: str, by: Sequence[str], low=0.0, high=35.0) -> DataFrame:
    """Drop trajectories with a predicted speed out of bounds; ``n_dropped`` counts them per group."""
    by = list(by)
    flags = df.groupBy(*by, track).agg(
        F.coalesce(F.bool_or((F.col(speed) < low) | (F.col(speed) > high)), F.lit(False)).alias("_bad")
    )
    flags = with_group(flags, by, n_dropped=F.count_if("_bad"))
    return df.join(flags.filter(~F.col("_bad")).drop("_bad"), [*by, track])


def holdout(
    df: DataFrame, sample: str, order: Sequence[str], route: str, routes: Sequence[str], only: bool = False
) -> DataFrame:
    """Samples off the held-out routes, or only those on them; the first row names the route."""
    first = F.min_by(route, F.struct(*order))
    held = F.coalesce(F.col("_route").isin(list(routes)), F.lit(False))
    return with_group(df, [sample], _route=first).filter(held if only else ~held).drop("_route")


def min_trip_points(df: DataFrame, track: str, n: int) -> DataFrame:
    """Drop tracks with fewer than ``n`` rows."""
    small = df.groupBy(track).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") < n).select(track)
    return df.join(small, track, "left_anti")


def bad_samples(df: DataFrame, sample: str, order: Sequence[str], label: str = "cumul_time_s") -> DataFrame:
    """Samples with a running time at or below zero after their first row."""
    first = with_group(df, [sample], _first=F.min(F.struct(*order)))
    late = first.filter((F.struct(*order) > F.col("_first")) & (F.col(label) <= 0))
    return late.groupBy(sample).agg(F.count(F.lit(1)).alias("bad_rows"), F.min(label).alias("least"))
