"""Phone sensor files, receiver logs, drive cycles, the vehicle table and the source registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.functions.scalar import array_from_text, mph_to_mps
from headway.sources import schemas


def read_sensors(spark: SparkSession, path: str, offset: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Location, accelerometer and orientation of a trip folder, on epoch seconds, pitch in degrees."""

    def load(name: str, schema: str) -> DataFrame:
        types = dict(part.split() for part in schema.split(", "))
        raw = spark.read.csv(f"{path.rstrip('/')}/{name}.csv", header=True)
        raw = raw.select(*[F.col(c).try_cast(t).alias(c) for c, t in types.items()])
        second = F.floor(F.col("time") / F.lit(1_000_000_000)) + offset
        return raw.withColumn("locationtime", second.cast("long")).drop("time")

    orientation = load("Orientation", schemas.ORIENTATION)
    return (
        load("Location", schemas.LOCATION),
        load("Accelerometer", schemas.ACCELEROMETER),
        orientation.withColumn("pitch", F.degrees("pitch")),
    )


def read_gnss(spark: SparkSession, path: str, low: int, high: int, leap_s: int = 18) -> DataFrame:
    """Receiver solution text to typed columns; the first row of each second in a closed range.

    Receiver time runs ahead of epoch time by the leap seconds.
    """
    part = F.split(F.trim("value"), r"\s+")
    text_cols = ("day", "time")
    raw = spark.read.text(path).select(
        *[
            (F.get(part, i) if n in text_cols else F.get(part, i).try_cast("double")).alias(n)
            for i, n in enumerate(schemas.GNSS)
        ]
    )
    stamp = F.try_to_timestamp(F.concat_ws(" ", F.regexp_replace("day", "/", "-"), "time"))
    raw = raw.withColumns({"_at": stamp, "locationtime": F.unix_seconds(stamp) - leap_s})
    raw = raw.filter(F.col("locationtime").between(low, high))
    cols = [c for c in schemas.GNSS]
    first = raw.groupBy("locationtime").agg(F.min_by(F.struct(*cols), F.struct("_at", *cols)).alias("r"))
    return first.select("locationtime", "r.*")


def read_drive_cycle(spark: SparkSession, path: str) -> DataFrame:
    """Standard cycle (seconds, mph) as time and metres per second; a byte-order mark is ignored."""
    raw = spark.read.csv(path, header=True)
    t, v = raw.columns[:2]
    return raw.select(F.col(f"`{t}`").try_cast("int").alias("time_s"), mph_to_mps(F.col(f"`{v}`").try_cast("double")).alias("mps"))


#: The numeric coefficients that are used; other columns stay text.
VEHICLE_NUMBERS = ("drag_coef", "frontal_area_m2", "veh_override_kg", "wheel_rr_coef", "aux_kw", "max_regen", "ess_max_kwh")


def read_vehicles(
    spark: SparkSession, path: str, maps: tuple[str, ...] = ("mc_eff_map",), numbers: tuple[str, ...] = VEHICLE_NUMBERS
) -> DataFrame:
    """Vehicle coefficients, efficiency maps parsed from text to arrays; an empty or unreadable cell is null. One pass: types are not inferred."""
    raw = spark.read.csv(path, header=True)

    def typed(c: str):
        col = F.col(f"`{c}`")
        return (array_from_text(col) if c in maps else col.try_cast("double") if c in numbers else col).alias(c)

    return raw.select(*[typed(c) for c in raw.columns])


REGISTRY = (
    "country_code string, subdivision_name string, municipality string, provider string, static_url string,"
    " realtime_url string, min_lon double, max_lon double, min_lat double, max_lat double, uuid string, tz_str string,"
    " epsg_code int, coord_ref_x int, coord_ref_y int"
)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The source registry, columns picked by name."""
    types = dict(part.strip().split() for part in REGISTRY.split(","))
    raw = spark.read.csv(path, header=True)
    return raw.select(*[F.col(c).try_cast(t).alias(c) for c, t in types.items() if c in raw.columns])
