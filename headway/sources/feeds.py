"""Readers, writers and daily roll-up of position feeds and schedules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.functions.scalar import nan_to_null
from headway.sources import schemas


def read_positions(
    spark: SparkSession, path: str, columns: Mapping[str, str] | None = None, days: tuple[date, date] | None = None,
    day_column: str = "service_day",
) -> DataFrame:
    """Position files with fixed columns and types, each row tagged with its file and folder.

    ``columns`` maps the standard names to expressions over another layout.
    With files partitioned by day, ``days`` prunes folders before any is read.
    """
    raw = spark.read.parquet(path)
    if columns is None:
        columns = {name: name for name in ("trip_id", "locationtime", "lat", "lon", "vehicle_id")}
    if days is not None:
        raw = raw.filter(F.col(day_column).between(*days))
    types = dict(part.split() for part in schemas.POSITION.split(", "))
    where = F.split(F.col("_metadata.file_path"), "/")
    picked = raw.select(
        *[F.expr(e).try_cast(types[n]).alias(n) for n, e in columns.items()],
        F.element_at(where, -1).alias("realtime_filename"),
        F.array_join(F.slice(where, 1, F.size(where) - 1), "/").alias("realtime_foldername"),
    )
    return nan_to_null(picked)


def read_schedule(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stop times, stops and trips of an unzipped feed; rows with any null dropped."""

    def load(name: str, schema: str, cols: Sequence[str]) -> DataFrame:
        # The header decides the order; columns are picked by name.
        raw = spark.read.csv(f"{path.rstrip('/')}/{name}", header=True)
        types = dict(part.split() for part in schema.split(", "))
        return raw.select(*[F.col(c).try_cast(types[c]).alias(c) for c in cols]).dropna()

    return (
        load("stop_times.txt", schemas.STOP_TIMES, ["trip_id", "stop_id", "arrival_time", "stop_sequence"]),
        load("stops.txt", schemas.STOPS, ["stop_id", "stop_lon", "stop_lat"]),
        load("trips.txt", schemas.TRIPS, ["trip_id", "service_id", "route_id"]),
    )


def positions_from_feed(feed: DataFrame) -> DataFrame:
    """Nested feed messages to one row per entity that has a vehicle."""
    one = feed.select("file", F.explode("entity").alias("e")).filter(F.col("e.vehicle").isNotNull())
    return one.select(
        "file",
        F.col("e.id").alias("entity_id"),
        F.col("e.vehicle.trip.trip_id").alias("trip_id"),
        F.col("e.vehicle.timestamp").alias("locationtime"),
        F.col("e.vehicle.position.latitude").alias("lat"),
        F.col("e.vehicle.position.longitude").alias("lon"),
        F.col("e.vehicle.vehicle.id").alias("vehicle_id"),
    )


def summarize_positions(df: DataFrame, day: date, order: Sequence[str] = ("locationtime",)) -> DataFrame:
    """One day's reports: the last of each (file, entity), then distinct, by trip and time.

    The day is the first ten characters of the file name, ``yyyy_MM_dd``.
    """
    file_day = F.to_date(F.substring("file", 1, 10), "yyyy_MM_dd")
    cols = ("trip_id", "locationtime", "lat", "lon", "vehicle_id")
    today = df.filter(file_day == F.lit(day))
    last = today.groupBy("file", "entity_id").agg(
        F.max_by(F.struct(*cols), F.struct(*order, *[c for c in cols if c not in order])).alias("r")
    )
    rows = last.select(F.substring("file", 1, 10).alias("file"), *[F.col(f"r.{c}").alias(c) for c in cols]).distinct()
    return rows.sortWithinPartitions("trip_id", "locationtime")


def service_days(df: DataFrame, start: str, n: str, name: str = "service_day") -> DataFrame:
    """``n`` consecutive days from a start day, one row per day."""
    days = F.sequence(F.col(start), F.date_add(F.col(start), F.col(n).cast("int") - 1))
    return df.filter(F.col(n) > 0).withColumn(name, F.explode(days))


def pending_days(
    available: DataFrame, loaded: DataFrame, low: date, high: date, feed: str | None = None, day: str = "service_day"
) -> DataFrame:
    """Days on offer in a range that are not loaded yet."""
    keys = [day] + ([feed] if feed else [])
    return available.filter(F.col(day).between(low, high)).join(loaded.select(*keys).distinct(), keys, "left_anti")


def feeds_with_data(positions: DataFrame, files: DataFrame, feed: str, file: Sequence[str]) -> DataFrame:
    """Feeds that have files and no empty one."""
    keys = [feed, *file]
    counts = positions.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    listed = files.select(*keys).distinct().join(counts, keys, "left")
    full = listed.groupBy(feed).agg(F.min(F.coalesce("_n", F.lit(0))).alias("_least"), F.count(F.lit(1)).alias("n_files"))
    return full.filter(F.col("_least") > 0).select(feed, "n_files")


def write_features(df: DataFrame, path: str, day: str = "service_day", files_per_day: int = 1) -> None:
    """Features as Parquet by day; a large day is spread over several tasks by hash of its rows."""
    spread = F.pmod(F.xxhash64(*[c for c in df.columns if c != day]), F.lit(files_per_day))
    df.repartition(F.col(day), spread).write.mode("overwrite").partitionBy(day).parquet(path)


def split_by_operator(df: DataFrame, col: str, name) -> DataFrame:
    """One operator's rows, to be written with :func:`write_features`."""
    return df.filter(F.col(col) == name)


def trips_in_area(
    trips: DataFrame, stop_times: DataFrame, stops: DataFrame, bounds: Sequence[float]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Schedule tables limited to trips with a stop in the box."""
    inside = stops.filter(
        F.col("stop_lon").between(bounds[0], bounds[2]) & F.col("stop_lat").between(bounds[1], bounds[3])
    )
    touched = stop_times.join(inside.select("stop_id"), "stop_id", "left_semi").select("trip_id").distinct()
    times = stop_times.join(touched, "trip_id", "left_semi")
    return (
        trips.join(touched, "trip_id", "left_semi"),
        times,
        stops.join(times.select("stop_id").distinct(), "stop_id", "left_semi"),
    )
