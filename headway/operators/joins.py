"""Schedule, nearest, as-of, region, raster, sensor and depot joins.

No side that grows is forced to broadcast: Spark measures the sides and chooses, and
the adaptive skew join splits a hot key. Hinted is only a sketch of fixed size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway import ordered as o
from headway.functions import geo
from headway.functions.clock import hms_seconds
from headway.functions.scalar import ratio


#: Parts in which the rows of one trip are dealt out when they are looked up.
_DEALT = 4
#: Bits of a sketch of keys: its words are all that is broadcast, however many keys there are.
_BITS = 1 << 25


def maybe_of(df: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in a sketch of the keys asked for: none of these is lost, few others stay, and ``df`` is not shuffled."""
    bit = F.pmod(F.xxhash64(key), F.lit(_BITS))
    words = asked.select(bit.alias("_bit")).groupBy(F.floor(F.col("_bit") / 64).alias("_word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_bit") % 64).cast("int"))).alias("_bits")
    )
    rows = df.withColumn("_bit", bit).withColumn("_word", F.floor(F.col("_bit") / 64)).join(F.broadcast(words), "_word")
    return rows.filter(F.getbit("_bits", (F.col("_bit") % 64).cast("int")) == 1).select(*df.columns)


def of_trips(df: DataFrame, points: DataFrame, trip: str = "trip_id", spread: str | None = None) -> DataFrame:
    """The rows of trips that have points.

    Most rows of other trips go by a sketch of fixed size before anything is shuffled.
    What is left is looked up in the distinct trips, neither sorted nor held; a trip's
    rows are dealt out by ``spread``, so that a later step on the trip deals them anew.
    """
    part = F.pmod(F.xxhash64(spread or trip), F.lit(_DEALT))
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_DEALT - 1).cast("long")))
    trips = points.select(trip).filter(F.col(trip).isNotNull()).distinct()
    asked = trips.withColumn("_part", parts)
    few = maybe_of(df, trips, trip)
    return few.withColumn("_part", part).join(asked.hint("shuffle_hash"), [trip, "_part"], "left_semi").drop("_part")


def scheduled_stops(stop_times: DataFrame, stops: DataFrame, by: Sequence[str] = (), points: DataFrame | None = None) -> DataFrame:
    """Stop times with stop positions, numbered from 0 by scheduled second in the trip.

    ``by`` names the columns that tell schedules apart, a feed and its version: trips
    and stops of two schedules may share ids. Stops without these columns serve all.
    With ``points`` only the trips that have points are numbered.
    """
    if points is not None:
        stop_times = of_trips(stop_times, points, spread="stop_sequence")
    timed = stop_times.withColumn("t_sch_sec_of_day", hms_seconds("arrival_time"))
    timed = o.ordered(
        timed.withColumnRenamed("stop_sequence", "_seq"),
        [*by, "trip_id"], ["t_sch_sec_of_day", "_seq", "stop_id"], stop_sequence=o.row_number(),
    )
    timed = timed.withColumn("stop_sequence", F.col("stop_sequence") - 1).drop("_seq")
    return timed.join(stops, [*[c for c in by if c in stops.columns], "stop_id"])


def trip_route_lookup(trips: DataFrame, routes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct (service, route, trip) of trips on known routes, per schedule that ``by`` names."""
    own = [c for c in by if c in routes.columns]
    known = trips.join(routes.select(*own, "route_id"), [*own, "route_id"])
    return known.select(*by, "service_id", "route_id", "trip_id").distinct()


def _distance(x1, y1, x2, y2) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def nearest_by_key(
    points: DataFrame, places: DataFrame, key: str | Sequence[str], place: str = "stop_id", seq: str = "stop_sequence",
    xy: tuple[str, str] = ("x", "y"), place_xy: tuple[str, str] = ("stop_x", "stop_y"), inline: int = 64,
) -> DataFrame:
    """For each point the closest place of its own key; the lowest sequence on a tie.

    Places are reduced to one per position and laid on a curve through their key's
    square (bits of both coordinates in turn). Runs of ``inline`` of them are the
    leaves of an index, runs of as many leaves its nodes, each with the box it covers.
    A point reads its key's root: the places themselves where one leaf holds them all,
    else the boxes of the nodes. The farthest corner of the best box bounds the
    distance, and the search goes down only into boxes that begin within the bound.
    Points and places without a position (null or NaN) match nothing, at any size.
    Adds ``place``, ``seq`` and ``calc_stop_dist_m``; null where the key has no place.
    """
    keys = [key] if isinstance(key, str) else list(key)
    x, y = xy
    asked_keys = points.select(*keys).distinct()
    leaves = _curve_leaves(places.join(asked_keys, keys, "left_semi"), keys, place, seq, place_xy, inline)
    roots = leaves.groupBy(*keys).agg(F.first(F.when(F.col("_last") == 0, F.col("_spots")), True).alias("_spots"))
    found = points.join(roots, keys, "left")
    here = F.array_min(F.transform("_spots", lambda s: F.struct(_distance(F.col(x), F.col(y), s["x"], s["y"]).alias("d"), s["place"].alias("place"))))
    found = found.withColumn("_near", F.when(_known(x) & _known(y), here)).drop("_spots")
    far = _search(points, leaves.filter("_last > 0"), keys, x, y, max(2, inline))
    both = found.join(far, [*keys, x, y], "left")
    return both.select(*points.columns, *_place_columns(F.coalesce("_near", "_far"), place, seq))


def _known(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))


def _place_columns(best: Column, place: str, seq: str) -> list[Column]:
    return [best["place"]["p"].alias(place), best["place"]["s"].alias(seq), best["d"].alias("calc_stop_dist_m")]


def _spread(v: Column) -> Column:
    """The bits of a 16-bit number at every other place."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def _curve_leaves(places: DataFrame, keys: list[str], place: str, seq: str, xy: tuple[str, str], size: int) -> DataFrame:
    """Leaves of each key: _leaf, _last (the key's highest leaf number), _spots (x, y, place) and their box."""
    qx, qy = xy
    spots = (
        places.filter(_known(qx) & _known(qy))
        .groupBy(*keys, F.col(qx).cast("double").alias("_qx"), F.col(qy).cast("double").alias("_qy"))
        .agg(F.min(F.struct(F.col(seq).alias("s"), F.col(place).alias("p"))).alias("_place"))
    )
    spots = o.with_group(spots, keys, _x0=F.min("_qx"), _x1=F.max("_qx"), _y0=F.min("_qy"), _y1=F.max("_qy"), _n=F.count(F.lit(1)))

    def share(v: str, low: str, high: str) -> Column:
        return F.coalesce(F.floor(F.try_divide(F.col(v) - F.col(low), F.col(high) - F.col(low)) * 65535), F.lit(0)).cast("long")

    curve = _spread(share("_qx", "_x0", "_x1")).bitwiseOR(F.shiftleft(_spread(share("_qy", "_y0", "_y1")), 1))
    spots = o.ordered(spots.withColumn("_z", curve), keys, ["_z", "_qx", "_qy"], _rn=o.row_number())
    leaf = F.floor((F.col("_rn") - 1) / size).alias("_leaf")
    spot = F.struct(F.col("_qx").alias("x"), F.col("_qy").alias("y"), F.col("_place").alias("place"))
    leaves = spots.groupBy(*keys, leaf).agg(F.collect_list(spot).alias("_spots"), F.floor((F.max("_n") - 1) / size).alias("_last"))
    # boxes are read from the spots, so that all who read leaves need the same columns and share one exchange
    edge = lambda pick, c: pick(F.transform("_spots", lambda s: s[c]))
    box = F.struct(
        edge(F.array_min, "x").alias("x0"), edge(F.array_max, "x").alias("x1"), edge(F.array_min, "y").alias("y0"), edge(F.array_max, "y").alias("y1")
    )
    return leaves.withColumn("_box", box)


def _search(points: DataFrame, leaves: DataFrame, keys: list[str], x: str, y: str, fan: int) -> DataFrame:
    """The nearest spot of every distinct (key, x, y) in keys of several leaves: from the nodes' boxes down to the leaves."""
    at = [*keys, x, y]
    box = lambda c, pick, of: pick(F.col("_box")[c]).alias(of)
    nodes = leaves.groupBy(*keys, F.floor(F.col("_leaf") / fan).alias("_node")).agg(
        F.collect_list(F.struct(F.col("_leaf").alias("child"), F.col("_box").alias("box"))).alias("_boxes"),
        F.struct(box("x0", F.min, "x0"), box("x1", F.max, "x1"), box("y0", F.min, "y0"), box("y1", F.max, "y1")).alias("_box"),
    )
    roots = nodes.groupBy(*keys).agg(F.collect_list(F.struct(F.col("_node").alias("child"), F.col("_box").alias("box"))).alias("_boxes"))

    def within(b: Column) -> Column:
        """Distance to the nearest point of a box."""
        dx = F.greatest(b["x0"] - F.col(x), F.col(x) - b["x1"], F.lit(0.0))
        dy = F.greatest(b["y0"] - F.col(y), F.col(y) - b["y1"], F.lit(0.0))
        return F.sqrt(dx * dx + dy * dy)

    def reach(b: Column) -> Column:
        """Distance that holds a place of the box: each of its four sides has one."""
        dx0, dx1 = F.abs(F.col(x) - b["x0"]), F.abs(F.col(x) - b["x1"])
        dy0, dy1 = F.abs(F.col(y) - b["y0"]), F.abs(F.col(y) - b["y1"])
        a, c, d, e = F.least(dx0, dx1), F.greatest(dy0, dy1), F.greatest(dx0, dx1), F.least(dy0, dy1)
        return F.sqrt(F.least(a * a + c * c, d * d + e * e))

    def down(df: DataFrame, child: str) -> DataFrame:
        """The boxes that begin within the bound, one row each."""
        bound = F.array_min(F.transform("_boxes", lambda b: reach(b["box"])))
        df = df.withColumn("_ub", F.least("_ub", bound) if "_ub" in df.columns else bound)
        near = F.filter("_boxes", lambda b: within(b["box"]) <= F.col("_ub") * (1 + 1e-9) + 1e-9)
        return df.select(*at, "_ub", F.explode(F.transform(near, lambda b: b["child"])).alias(child))

    asked = points.select(*at).filter(_known(x) & _known(y)).join(roots.select(*keys), keys, "left_semi").distinct()
    rows = down(asked.join(roots, keys), "_node")
    rows = down(rows.join(nodes.drop("_box"), [*keys, "_node"]), "_leaf")
    best = F.array_min(F.transform("_spots", lambda s: F.struct(_distance(F.col(x), F.col(y), s["x"], s["y"]).alias("d"), s["place"].alias("place"))))
    rows = rows.join(leaves.select(*keys, "_leaf", "_spots"), [*keys, "_leaf"]).select(*at, best.alias("_b"))
    return rows.groupBy(*at).agg(F.min("_b").alias("_far"))


def attach_schedule(points: DataFrame, static: DataFrame, trips: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Arrival, scheduled second, route and service for points with a nearest stop, of the schedule that ``by`` names."""
    by = list(by)
    timed = static.select(*by, "trip_id", "stop_id", "stop_sequence", "arrival_time", "t_sch_sec_of_day", "stop_lon", "stop_lat")
    out = points.join(timed, [*by, "trip_id", "stop_id", "stop_sequence"], "left")
    own = [c for c in by if c in trips.columns]
    return out.join(trips.select(*own, "trip_id", "service_id", "route_id"), [*own, "trip_id"], "left")


def in_force(
    points: DataFrame, versions: DataFrame, feed: Sequence[str], day: str = "service_day", version: str = "version"
) -> DataFrame:
    """Each point with the version of its feed's schedule in force on its day; null where the feed has none.

    Versions are resolved on the feeds' days, not on points: a version holds from the
    day after its own until the day of the next one, the earliest also before.
    """
    chosen = latest_before(points.select(*feed, day).distinct(), versions, feed, day, version)
    return points.drop(version).join(chosen, [*feed, day], "left")


def attach_schedule_in_force(
    points: DataFrame, stop_times: DataFrame, stops: DataFrame, trips: DataFrame, versions: DataFrame, feed: Sequence[str],
    day: str = "service_day", version: str = "version", xy: tuple[str, str] = ("x", "y"),
) -> DataFrame:
    """Points with version, nearest stop and schedule of the feed's schedule in force: an effective-dated join.

    ``stop_times`` and ``trips`` carry the feed columns and the version, ``stops`` may.
    Equal trip ids of other feeds or versions never meet. Points of trips that the
    schedule in force does not have keep nulls.
    """
    by = [*feed, version]
    static, trips = scheduled_stops(stop_times, stops, by, points), of_trips(trips, points)
    points = in_force(points, versions, feed, day, version)
    return attach_schedule(nearest_by_key(points, static, [*by, "trip_id"], xy=xy), static, trips, by)


def latest_before(
    days: DataFrame, versions: DataFrame, by: Sequence[str], day: str = "service_day", version: str = "version"
) -> DataFrame:
    """The latest version strictly before each day, else the earliest there is.

    Days and versions are laid on one time line per group and the last version
    is carried forward; a version on the day itself comes after it.
    """
    by = list(by)
    number = F.datediff(F.col("_d"), F.lit("1970-01-01").cast("date"))
    line = days.select(*by, F.col(day).alias("_d"), F.lit(0).alias("_kind")).distinct().unionByName(
        versions.select(*by, F.col(version).alias("_d"), F.lit(1).alias("_kind"))
    )
    line = line.withColumns({"_no": number, "_v": F.when(F.col("_kind") == 1, F.col("_d"))})
    line = o.ordered(line, by, ["_no", "_kind"], _last=o.last_known("_v"), _first=o.group_min("_v"))
    return line.filter("_kind = 0").select(*by, F.col("_d").alias(day), F.coalesce("_last", "_first").alias(version))


def assign_hex(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """Region id of each point: the hexagon is computed, not searched for."""
    q, r = geo.hex_axial(x, y, size)
    df = df.withColumns({"hex_q": q, "hex_r": r})
    return df.withColumn("region_id", geo.hex_id("hex_q", "hex_r"))


def attach_vectors(df: DataFrame, vectors: DataFrame, on: str, vector: str, prefix: str, width: int) -> DataFrame:
    """Region vector as columns ``0_prefix``..; ``prefix_missing`` marks regions without one."""
    out = df.join(vectors.select(on, F.col(vector).alias("_v")), on, "left")
    cols = {f"{i}_{prefix}": F.try_element_at("_v", F.lit(i + 1)) for i in range(width)}
    return out.withColumns(cols | {f"{prefix}_missing": F.col("_v").isNull()}).drop("_v")


def cover_box(bounds: DataFrame, keys: Sequence[str], size: float) -> DataFrame:
    """All hexagons that touch a box (min_x, min_y, max_x, max_y), with their neighbours."""
    wide, high = math.sqrt(3) * size, 1.5 * size
    rows = F.sequence(
        (F.floor((F.col("min_y") - size) / high)).cast("long"), (F.ceil((F.col("max_y") + size) / high)).cast("long")
    )
    cells = bounds.withColumn("hex_r", F.explode(rows))
    low, up = F.col("min_x") / wide - F.col("hex_r") / 2, F.col("max_x") / wide - F.col("hex_r") / 2
    cells = cells.withColumn("hex_q", F.explode(F.sequence(F.floor(low - 1).cast("long"), F.ceil(up + 1).cast("long"))))
    cx, cy = wide * (F.col("hex_q") + F.col("hex_r") / 2), high * F.col("hex_r")
    inside = cx.between(F.col("min_x") - wide / 2, F.col("max_x") + wide / 2) & cy.between(
        F.col("min_y") - size, F.col("max_y") + size
    )
    around = F.array(*[geo.hex_id(F.col("hex_q") + dq, F.col("hex_r") + dr) for dq, dr in geo.HEX_NEIGHBOURS])
    return cells.filter(inside).select(
        *keys, "hex_q", "hex_r", geo.hex_id("hex_q", "hex_r").alias("region_id"), around.alias("neighbours")
    )


def region_hourly_service(
    stop_times: DataFrame, stops: DataFrame, size: float, trip="trip_id", direction="direction_id"
) -> DataFrame:
    """Trips and directions per region and hour, one column per hour of the day."""
    placed = assign_hex(stops, "stop_x", "stop_y", size).select("stop_id", "region_id")
    hour = F.pmod(F.floor(hms_seconds("arrival_time") / 3600), F.lit(24)).cast("int")
    seen = stop_times.join(placed, "stop_id").select("region_id", hour.alias("hour"), trip, direction).distinct()
    # one distinct per measure instead of expanding every row for both
    counts = [
        seen.select("region_id", "hour", c).distinct().groupBy("region_id", "hour").agg(F.count(c).alias("n")).withColumn("what", F.lit(what))
        for c, what in ((trip, "trips"), (direction, "directions"))
    ]
    picks = [
        F.coalesce(F.max(F.when((F.col("hour") == h) & (F.col("what") == c), F.col("n"))), F.lit(0)).alias(f"{c}_{h}")
        for c in ("trips", "directions")
        for h in range(24)
    ]
    return counts[0].unionByName(counts[1]).groupBy("region_id").agg(*picks)


def merge_sensors(
    location: DataFrame, accelerometer: DataFrame, orientation: DataFrame, device: Sequence[str], t="locationtime"
) -> DataFrame:
    """Sensors on the location's seconds: one mean per second, then filled both ways."""
    key = [*device, t]

    def per_second(df: DataFrame) -> DataFrame:
        return df.groupBy(*key).agg(*[F.avg(c).alias(c) for c in df.columns if c not in key])

    out = per_second(location)
    for other in (accelerometer, orientation):
        out = out.join(per_second(other), key, "left")
    cols = [c for c in out.columns if c not in key]
    calcs = {f"_f_{c}": o.last_known(c) for c in cols} | {f"_b_{c}": o.next_known(c) for c in cols}
    out = o.ordered(out, device, [t], **calcs)
    return out.withColumns({c: F.coalesce(f"_f_{c}", f"_b_{c}") for c in cols}).drop(*calcs)


def sample_raster(
    points: DataFrame, cells: DataFrame, x: str, y: str, x0: float, y0: float, dx: float, dy: float,
    value: str = "z", name: str = "elev_m",
) -> DataFrame:
    """Raster value under each point; null off the raster. ``dy`` is negative for north-up."""
    at = points.withColumns(
        {"_col": F.floor((F.col(x) - x0) / dx).cast("long"), "_row": F.floor((F.col(y) - y0) / dy).cast("long")}
    )
    raster = cells.select(F.col("col").alias("_col"), F.col("row").alias("_row"), F.col(value).alias(name))
    return at.join(raster, ["_col", "_row"], "left").drop("_col", "_row")


def attach_depots(blocks: DataFrame, depots: DataFrame) -> DataFrame:
    """Depot position for each block's depot."""
    return blocks.join(depots.select("depot_id", "depot_x", "depot_y"), "depot_id")


def attach_block_summary(trips: DataFrame, blocks: DataFrame, keys: Sequence[str] = ("block_id",)) -> DataFrame:
    """Block totals back on each trip."""
    return trips.join(blocks, list(keys))


def vehicle_blocks(
    positions: DataFrame, trips: DataFrame, reports: DataFrame, day: str, vehicle: str, skip_prefix: str | None = None
) -> DataFrame:
    """Energy reports with the (service, block) pairs the vehicle was seen on that day."""
    seen = positions.select(day, vehicle, "trip_id").distinct()
    planned = trips.select("service_id", "block_id", "trip_id").distinct()
    lookup = seen.join(planned, "trip_id").select(day, vehicle, "service_id", "block_id").distinct()
    if skip_prefix:
        reports = reports.filter(~F.col(vehicle).cast("string").startswith(skip_prefix))
    return reports.join(lookup, [day, vehicle])


def compare_blocks(actual: DataFrame, modeled: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean reported value per block and metric beside the modelled block."""
    means = actual.groupBy("block_id").pivot("metric", list(metrics)).agg(F.avg("value"))
    return means.join(modeled, "block_id")


def mean_block_std(actual: DataFrame) -> DataFrame:
    """Per metric, the mean over blocks of the within-block deviation."""
    per_block = actual.groupBy("block_id", "metric").agg(F.stddev_samp("value").alias("std"))
    return per_block.groupBy("metric").agg(F.avg("std").alias("mean_std"))


def net_improvement(results: DataFrame, keys: Sequence[str] = ("run", "model", "fold"), value="value") -> DataFrame:
    """Tuned less untuned error, in hundredths; pairs only, no self-join."""
    tuned = F.avg(F.when(F.col("is_tuned"), F.col(value)))
    base = F.avg(F.when(~F.col("is_tuned"), F.col(value)))
    out = results.groupBy(*keys).agg(tuned.alias("value_tune"), base.alias("value_notune"))
    out = out.filter(F.col("value_tune").isNotNull() & F.col("value_notune").isNotNull())
    return out.withColumn("net_improvement", (F.col("value_tune") - F.col("value_notune")) * 100)


def network_compare(
    baseline: DataFrame, charge: DataFrame, metrics: Sequence[str], limit: tuple[str, float] | None = None
) -> DataFrame:
    """Baseline metrics as columns beside each provider's charge availability."""
    wide = baseline.groupBy("provider").pivot("metric", list(metrics)).agg(F.avg("value"))
    if limit:
        wide = wide.filter(F.col(f"`{limit[0]}`") < limit[1])
    return wide.join(charge, wide["provider"] == charge["agency"]).drop("agency")


def ratio_join(a: DataFrame, b: DataFrame, on: str, top: str, bottom: str, name: str) -> DataFrame:
    """Two tables matched on a label, one quotient added."""
    return a.join(b, on).withColumn(name, ratio(top, bottom))
