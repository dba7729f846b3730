"""Raw positions to model features for all days at once.

Trip steps share one split and one shuffle; the frame is written to the shared
folder where its key changes (after resampling, after filtering, after the
schedule), so that later steps do not repeat earlier ones. A table is deleted when
the next one is written: one is kept, and two while one is read for the other.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway import ordered as o
from headway.functions import clock, geo
from headway.operators import filters as f
from headway.operators import joins as j
from headway.operators import tracks as tr
from headway.operators import trajectory as tj
from headway.session import release, stage, staged


@dataclass(frozen=True)
class Settings:
    """Thresholds of a run; the defaults suit bus positions of a city."""

    epsg: int = 32610
    bounds: tuple[float, float, float, float] = (-123.0, 46.0, -121.0, 48.5)
    centre: tuple[float, float] = (550000.0, 5270000.0)
    tz: str = "UTC"
    step_m: float | None = None
    max_jump_m: float = 100_000
    trim: int = 3
    breaks: tuple[int, int] = (2, 5)
    point_ranges: dict = field(
        default_factory=lambda: {"calc_dist_m": (0, 10_000), "calc_time_s": (0, 300), "elev_m": (-400, 20_000)}
    )
    drop_share: float = 0.1
    track_ranges: dict = field(default_factory=lambda: {"calc_speed_m_s": (0, 35)})
    hex_size_m: float = 500.0
    grid_m: float = 500.0
    grid_bounds: tuple[float, float, float, float] = (500000, 5200000, 600000, 5400000)
    history: int = 4
    seed: int = 42
    method: str = "geodesic"


def clean_tracks(points: DataFrame, raster: DataFrame, origin: Sequence[float], p: Settings, feed: Sequence[str] = ()) -> DataFrame:
    """Resample, trim, cut, project, measure and filter: points with ``shingle_id``; a trip id counts within its feed."""
    trip, order = [*feed, "trip_id"], ["locationtime", "point_no"]
    df = tj.resample_trips(points, trip, ["locationtime", "event_id"], p.step_m, p.max_jump_m, p.method, first=("vehicle_id",))
    df = stage(df, "resampled")
    done_with = staged()[-1:]
    df, done = o.shared_split(df, trip, order[0])
    df = tr.trim_track_ends(df, trip, order, p.trim)
    df = done(tr.shingle(df, trip, order, *p.breaks, p.seed))
    df = geo.project(geo.within_bounds(df, "lon", "lat", p.bounds), "lon", "lat", p.epsg)
    df = j.sample_raster(geo.center_xy(df, "x", "y", *p.centre), raster, "x", "y", *origin)
    key = ["shingle_id"]
    df, done = o.shared_split(df, key, order[0])
    df = tr.step_metrics(df, key, order, method=p.method)
    df = f.dropout(f.filter_points(df, p.point_ranges), p.drop_share, p.seed, [*trip, "point_no"])
    df = tr.step_metrics(df, key, order, method=p.method)
    df = done(tr.step_speed(df, key, order))
    df = stage(df, "measured")
    release(df.sparkSession, done_with)
    return f.filter_tracks(df, "shingle_id", p.track_ranges)


def add_schedule(
    df: DataFrame, stop_times: DataFrame, stops: DataFrame, trips: DataFrame, by: Sequence[str], versions: DataFrame | None = None,
    feed: Sequence[str] = (),
) -> DataFrame:
    """Nearest scheduled stop, scheduled elapsed time and stops passed.

    With ``versions`` the schedule of the point's feed in force on its day counts.
    """
    own = []
    if versions is not None:
        df, own = j.in_force(df, versions, feed), [*feed, "version"]
    static = stage(j.scheduled_stops(stop_times, stops, own, df), "static")
    done_with = staged()[-1:]
    trips = j.of_trips(trips, df)
    df = f.keep_scheduled(df, static, by, [*own, "trip_id"])
    df = stage(j.attach_schedule(j.nearest_by_key(df, static, [*own, "trip_id"]), static, trips, own), "scheduled")
    release(df.sparkSession, done_with)
    df = tr.track_start(df, ["shingle_id"])
    df = df.withColumns(
        {
            "route_id": F.coalesce("route_id", F.lit("TripNotFound")),
            "stop_sequence": F.coalesce("stop_sequence", F.lit(0)),
            "calc_stop_dist_m": F.coalesce("calc_stop_dist_m", F.lit(0.0)),
            "sch_time_s": clock.scheduled_elapsed("t_sch_sec_of_day", "t_sec_of_day_start"),
        }
    )
    return tr.passed_stops(df, ["shingle_id"], ["locationtime", "point_no"])


def track_features(
    points: DataFrame, stop_times: DataFrame, stops: DataFrame, trips: DataFrame, raster: DataFrame,
    origin: Sequence[float], vectors: DataFrame, vector_key, p: Settings, versions: DataFrame | None = None, feed: Sequence[str] = (),
) -> DataFrame:
    """The whole feature table: one row per kept point.

    ``vector_key`` is the expression that names a hexagon in ``vectors``. With
    ``versions`` points, stop times and trips carry the ``feed`` columns, and the
    latter two a version.
    """
    key, order = ["shingle_id"], ["locationtime", "point_no"]
    df = clean_tracks(points, raster, origin, p, feed)
    done_with = staged()[-1:]
    df = clock.time_features(df, "locationtime", p.tz).withColumn("service_day", F.to_date(F.timestamp_seconds("locationtime")))
    df = add_schedule(df, stop_times, stops, trips, ["service_day"], versions, feed)
    release(df.sparkSession, done_with)
    done_with = staged()[-1:]
    df = stage(tr.cumulative_features(df, key, order), "cumulated")
    release(df.sparkSession, done_with)
    df = j.assign_hex(df, "x", "y", p.hex_size_m).withColumn("vec_id", vector_key)
    x0, y0, x1, y1 = p.grid_bounds
    df = df.withColumns({"xbin": geo.grid_bin("x", x0, x1, p.grid_m), "ybin": geo.grid_bin("y", y0, y1, p.grid_m)})
    df = o.with_group(df, key, track_t0=F.min("locationtime"))
    recent = tr.recent_in_cell(
        df, df.select("xbin", "ybin", "shingle_id", "point_no", "track_t0"), ["xbin", "ybin"], "locationtime",
        "point_no", "track_t0", ["shingle_id", "point_no"], ["calc_speed_m_s", "calc_bear_d"], p.history,
    )
    df = df.join(recent.drop("xbin", "ybin"), ["shingle_id", "point_no"], "left")
    return j.attach_vectors(df, vectors, "vec_id", "embedding", "osm_embed", 64)
