"""Fleet energy, depots, charging and sensitivity.

Every step is keyed by the columns passed in, so that all scenarios and
networks go through one job; parameters are numbers or columns.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from headway import ordered as o
from headway.functions.clock import unwrap_end
from headway.functions.geo import manhattan
from headway.functions.scalar import clip, m_to_mi, param_of, ratio, relabel
from headway.operators.aggregates import block_energy, exact_percentiles, regen
from headway.operators.tracks import deadhead, downtime
from headway.session import stage

# Cabin air exchange through open doors.
CABIN_TEMP_F = 65
DOOR_AREA_FT2 = 8 * 4 * 2 * 0.5
WIND_FT_S = 0.5
AIR_LB_FT3 = 0.075
AIR_BTU_LB_F = 0.24
BTU_PER_KWH = 3412
DAY_MIN = 1440
HORIZON_MIN = 3 * DAY_MIN


@dataclass(frozen=True)
class Vehicle:
    """Road-load coefficients; the defaults are a 40 ft battery bus."""

    # Public coefficients of the bus.
    drag_coef: float = 0.6
    frontal_area_m2: float = 10.78
    mass_kg: float = 18340
    rolling_coef: float = 0.006
    max_regen: float = 0.98
    # Approximation: one efficiency for motor, electronics and transmission.
    efficiency: float = 0.9


AIR_KG_M3, GRAVITY = 1.2, 9.81
PASSENGER_KG = 150 * 0.453592


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def road_load_power(
    cycle: DataFrame, track: Sequence[str], t: str, speed: str, grade: str, veh: Vehicle = Vehicle(), aux_kw=10.0, passengers=0.0,
) -> DataFrame:
    """Power of each second by cause, from the speed now and at the previous sample.

    An approximation of a vehicle simulation: constant efficiency, losses of
    the battery not modelled. A track's first sample has no interval and goes.
    """
    df = o.ordered(cycle, track, [t], _v=o.prev(speed), _t=o.prev(t)).filter(F.col("_t").isNotNull())
    mass = F.lit(veh.mass_kg) + _col(passengers) * PASSENGER_KG
    mean, dt = (F.col(speed) + F.col("_v")) / 2, F.col(t) - F.col("_t")
    slope = F.atan(F.col(grade))
    df = df.withColumns(
        {
            "rr_kw": mass * (GRAVITY * veh.rolling_coef) * F.cos(slope) * mean / 1000,
            "drag_kw": F.lit(0.5 * AIR_KG_M3 * veh.drag_coef * veh.frontal_area_m2) * mean * mean * mean / 1000,
            "ascent_kw": mass * GRAVITY * F.sin(slope) * mean / 1000,
            "accel_kw": mass * (F.col(speed) * F.col(speed) - F.col("_v") * F.col("_v")) / (2 * dt) / 1000,
            "aux_kw": _col(aux_kw),
            "dist_m": mean * dt,
            "dt_s": dt.cast("double"),
        }
    )
    road = F.col("rr_kw") + F.col("drag_kw") + F.col("ascent_kw") + F.col("accel_kw")
    drive = F.when(road > 0, road / veh.efficiency).otherwise(road * (veh.efficiency * veh.max_regen))
    return df.withColumn("ess_kw", drive + F.col("aux_kw")).drop("_v", "_t")


def road_load_energy(cycle: DataFrame, track: Sequence[str], t: str, speed: str, grade: str, veh: Vehicle = Vehicle(),
                     aux_kw=10.0, passengers=0.0) -> DataFrame:
    """kWh by cause, consumption per mile and energy returned, per trip."""
    df = road_load_power(cycle, track, t, speed, grade, veh, aux_kw, passengers)
    parts = ("rr_kw", "drag_kw", "ascent_kw", "accel_kw", "aux_kw", "ess_kw")
    sums = df.groupBy(*track).agg(
        *[(F.sum(F.col(p) * F.col("dt_s")) / 3600).alias(p.replace("_kw", "_kwh")) for p in parts],
        (F.sum(F.least(F.col("ess_kw"), F.lit(0.0)) * F.col("dt_s")) / 3600).alias("regen_kwh"),
        F.sum("dist_m").alias("dist_m"),
    )
    return sums.withColumn("electric_kwh_per_mi", ratio("ess_kwh", m_to_mi("dist_m")))


def road_load_settings(
    cycle: DataFrame, track: Sequence[str], t: str, speed: str, grade: str, loads: Sequence[tuple[float, float]], veh: Vehicle = Vehicle(),
) -> DataFrame:
    """:func:`road_load_energy` for several (passengers, auxiliary kW) at once: one row per trip.

    ``by_load`` lists consumption per mile and energy returned in the order of ``loads``.
    Samples are shuffled and read once, whatever the number of settings.
    """
    df = road_load_power(cycle, track, t, speed, grade, veh)
    per_kg = (F.col("rr_kw") + F.col("ascent_kw") + F.col("accel_kw")) / veh.mass_kg
    loaded = {p: per_kg * (veh.mass_kg + p * PASSENGER_KG) + F.col("drag_kw") for p, _ in loads}
    places = {p: i for i, p in enumerate(loaded)}
    df = df.select(*track, "dist_m", "dt_s", *[road.alias(f"_road{places[p]}") for p, road in loaded.items()])

    def power(p: float, aux: float) -> Column:
        road = F.col(f"_road{places[p]}")
        return F.when(road > 0, road / veh.efficiency).otherwise(road * (veh.efficiency * veh.max_regen)) + aux

    sums = df.groupBy(*track).agg(
        F.sum("dist_m").alias("dist_m"),
        *[(F.sum(power(*load) * F.col("dt_s")) / 3600).alias(f"_ess{i}") for i, load in enumerate(loads)],
        *[(F.sum(F.least(power(*load), F.lit(0.0)) * F.col("dt_s")) / 3600).alias(f"_regen{i}") for i, load in enumerate(loads)],
    )
    each = [
        F.struct(ratio(f"_ess{i}", m_to_mi("dist_m")).alias("electric_kwh_per_mi"), F.col(f"_regen{i}").alias("regen_kwh")) for i in range(len(loads))
    ]
    return sums.select(*track, F.array(*each).alias("by_load"))


def trip_energy(trips: DataFrame, cycles: DataFrame, by: Sequence[str], power: str = "ess_kw") -> DataFrame:
    """Trip frame from per-second power and step distances.

    Distance is cut to whole metres. Where any trip of a network has no block
    each trip is its own.
    """
    sums = cycles.groupBy("trip_id").agg(
        F.sum("dist_m").cast("long").alias("trip_dist_m"), regen(power).alias("cyc_regen_kwh"),
    )
    df = trips.drop("trip_dist_m", "cyc_regen_kwh").join(sums, "trip_id")
    df = df.withColumn("cyc_energy_kwh", F.col("consumption_kwh_mi") * m_to_mi("trip_dist_m"))
    return own_blocks(df, by)


def own_blocks(trips: DataFrame, by: Sequence[str]) -> DataFrame:
    """The trip as its own block where a network lacks any block id."""
    df = o.with_group(trips, by, _gap=F.bool_or(F.col("block_id").isNull()))
    block = F.when(F.col("_gap"), F.col("trip_id")).otherwise(F.col("block_id").cast("string"))
    return df.withColumn("block_id", block).drop("_gap")


def idle_minutes() -> Column:
    """Down time with the engine on: at most an hour per stop."""
    return clip(F.col("t_min_down"), 0, 60)


def deadhead_energy(df: DataFrame, kwh_mi, aux_kw, idle_min: Column | None = None) -> DataFrame:
    """Energy between trips: the way there, and idling (by default from the trip's down time)."""
    drive = m_to_mi("trip_deadhead_dist_m") * _col(kwh_mi)
    idle = (idle_minutes() if idle_min is None else idle_min) * 60 * _col(aux_kw) / 3600
    return df.withColumns(
        {"trip_deadhead_drive_kwh": drive, "trip_deadhead_aux_kwh": idle, "trip_deadhead_kwh": drive + idle}
    )


def door_energy(df: DataFrame, temp_f, open_s, stops: str = "stop_count", cooling: str = "signed") -> DataFrame:
    """Heat lost through open doors.

    By default a gain, when it is hotter outside than in the cabin, lowers the
    total; ``cooling='abs'`` counts it as energy spent on cooling.
    """
    differential = F.lit(float(CABIN_TEMP_F)) - _col(temp_f)
    if cooling == "abs":
        differential = F.abs(differential)
    btu_s = differential * (DOOR_AREA_FT2 * WIND_FT_S * AIR_LB_FT3 * AIR_BTU_LB_F)
    return df.withColumn("trip_door_kwh", F.col(stops) * _col(open_s) * btu_s / BTU_PER_KWH)


def depot_count(area_km2, density) -> Column:
    return F.greatest(F.lit(1), F.floor(_col(area_km2) * _col(density)).cast("int"))


def block_ends(trips: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First start and last end of each block."""
    at = F.struct("t_min_of_day", "trip_id")
    return trips.groupBy(*keys).agg(
        F.min_by("start_x", at).alias("block_start_x"), F.min_by("start_y", at).alias("block_start_y"),
        F.max_by("end_x", at).alias("block_end_x"), F.max_by("end_y", at).alias("block_end_y"),
    )


POINT = T.StructType().add("x", T.DoubleType()).add("y", T.DoubleType())


def nearest_centre(x: str, y: str, centres: str) -> Column:
    """(d, i): squared distance to the nearest of a list of centres and its place in the list, the first of equals."""
    far = lambda c: (F.col(x) - c["x"]) * (F.col(x) - c["x"]) + (F.col(y) - c["y"]) * (F.col(y) - c["y"])
    return F.array_min(F.transform(centres, lambda c, i: F.struct(far(c).alias("d"), i.alias("i"))))


def depot_centres(blocks: DataFrame, network: Sequence[str], counts: Sequence[int], rounds: int | None = None) -> DataFrame:
    """network, n_depots, centres: depots of every network and count by Lloyd's rounds over the block starts, all at once.

    They begin at the blocks with the smallest MD5 of the id; a round gives every block
    start to its nearest centre, the first of equals, and moves each centre to the mean
    of its starts, to the millimetre. A centre without starts stays. A network's count
    ends when its centres are where they were in a round before, or after ``rounds``
    where these are given. Blocks without a position count for nothing.
    A round is one pass and one shuffle of partial sums over what has not ended; what
    returns is the centres, at most as many as the counts add up to per network.
    """
    network, of, spark = list(network), [*network, "n_depots"], blocks.sparkSession
    x, y, counts = "block_start_x", "block_start_y", sorted(set(counts))
    starts = blocks.select(*network, "block_id", x, y).filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    starts = stage(starts, "block-starts")
    order = Window.partitionBy(*network).orderBy(F.md5(F.col("block_id").cast("string")), "block_id")
    first = starts.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= max(counts))
    first = first.groupBy(*network).agg(F.array_sort(F.collect_list(F.struct("_rn", F.col(x).alias("x"), F.col(y).alias("y")))).alias("_first")).collect()
    places = {(*(r[c] for c in network), k): [(p["x"], p["y"]) for p in r["_first"][:k]] for r in first for k in counts}
    fields = [*[starts.schema[c] for c in network], T.StructField("n_depots", T.IntegerType()), T.StructField("centres", T.ArrayType(POINT))]
    schema = T.StructType(fields)

    def table(keys) -> DataFrame:
        rows = [dict(zip(of, key)) | {"centres": [{"x": a, "y": b} for a, b in places[key]]} for key in keys]
        return spark.createDataFrame(pa.Table.from_pylist(rows, schema=to_arrow_schema(schema)), schema)

    def mean(c: str) -> Column:
        return (F.floor(F.avg(c) * 1000 + 0.5) / 1000).alias(c)

    moving, seen = list(places), {key: {tuple(at)} for key, at in places.items()}
    for _ in itertools.count() if rounds is None else range(rounds):
        if not moving:
            break
        own = starts.join(F.broadcast(table(moving)), network).select(*of, x, y, nearest_centre(x, y, "centres")["i"].alias("_i"))
        for r in own.groupBy(*of, "_i").agg(mean(x), mean(y)).collect():
            places[tuple(r[c] for c in of)][r["_i"]] = (r[x], r[y])
        moving = [key for key in moving if tuple(places[key]) not in seen[key]]
        for key in moving:
            seen[key].add(tuple(places[key]))
    return table(places)


def assign_depots(blocks: DataFrame, centres: DataFrame, network: Sequence[str]) -> DataFrame:
    """Every block once per depot count of its network, with its nearest depot; a block without a position has none."""
    df = blocks.join(centres, list(network)).withColumn("_near", nearest_centre("block_start_x", "block_start_y", "centres"))
    depot = F.try_element_at("centres", F.col("_near.i") + 1)
    df = df.withColumns({"depot_id": F.when(F.col("_near.d").isNotNull(), F.col("_near.i")), "_depot": F.when(F.col("_near.d").isNotNull(), depot)})
    return df.withColumns({"depot_x": F.col("_depot.x"), "depot_y": F.col("_depot.y")}).drop("_near", "_depot", "centres")


def depot_deadhead(blocks: DataFrame, kwh_mi) -> DataFrame:
    """Way from the depot to the first start and from the last end back, in metres and kWh."""
    out = manhattan("block_start_x", "block_start_y", "depot_x", "depot_y")
    back = manhattan("block_end_x", "block_end_y", "depot_x", "depot_y")
    df = blocks.withColumn("block_deadhead_dist_m", out + back)
    return df.withColumn("block_deadhead_kwh", m_to_mi("block_deadhead_dist_m") * _col(kwh_mi))


def prepare_trips(trips: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The parts that no scenario changes: end over midnight, down time, way to the next trip."""
    df = trips.withColumn("t_min_of_day_end", unwrap_end("t_min_of_day", "t_min_of_day_end"))
    df = df.withColumn("t_min_trip", F.col("t_min_of_day_end") - F.col("t_min_of_day"))
    df, done = o.shared_split(df, keys, "t_min_of_day")
    return done(deadhead(downtime(df, keys), keys))


def fleet_energy(
    prepared: DataFrame, params: Mapping[str, object], keys: Sequence[str], block_depots: DataFrame | None = None,
    depot_on: Sequence[str] = (),
) -> DataFrame:
    """Trip rows with trip, door, deadhead and block energy.

    ``params`` holds numbers or columns for ``deadhead_consumption_kwh_mi``,
    ``aux_power_kw``, ``temperature_f`` and ``door_open_time_s``. Without
    ``block_depots`` blocks have no way from and to a depot.
    """
    df = trip_costs(prepared, params, block_depots, depot_on)
    return df.join(block_energy(df, keys), list(keys))


def trip_costs(prepared: DataFrame, params: Mapping[str, object], block_depots: DataFrame | None, depot_on: Sequence[str],
               idle_min: Column | None = None) -> DataFrame:
    """Deadhead, door and depot energy of each row, trip or block, without any grouping."""
    df = deadhead_energy(prepared, params["deadhead_consumption_kwh_mi"], params["aux_power_kw"], idle_min)
    df = door_energy(df, params["temperature_f"], params["door_open_time_s"])
    if block_depots is None:
        return df.withColumns({"block_deadhead_kwh": F.lit(0.0), "block_deadhead_dist_m": F.lit(0.0)})
    return depot_deadhead(df.join(block_depots, list(depot_on)), params["deadhead_consumption_kwh_mi"])


def charging_needs(trips: DataFrame, keys: Sequence[str], plug_kw) -> DataFrame:
    """Per block: first start, last end, energy, charge time and window, least rate."""
    at = F.struct("t_min_of_day", "trip_id")
    df = trips.withColumn("_plug", _col(plug_kw)).groupBy(*keys).agg(
        F.min("t_min_of_day").alias("t_min_of_day"),
        F.max_by("t_min_of_day_end", at).alias("t_min_of_day_end"),
        F.min_by("block_net_energy_kwh", at).alias("block_net_energy_kwh"),
        F.min_by("_plug", at).alias("plug_power_kw"),
    )
    return charge_window(df)


def charge_window(blocks: DataFrame) -> DataFrame:
    """Charge time, window and least rate from a block's times, energy and plug."""
    df = blocks.withColumns(
        {
            "charge_time_min": F.col("block_net_energy_kwh") / F.col("plug_power_kw") * 60,
            "t_charge_start_min": F.col("t_min_of_day_end"),
            "t_block_min": F.col("t_min_of_day_end") - F.col("t_min_of_day"),
        }
    )
    df = df.withColumns(
        {
            "t_charge_end_min": F.col("t_min_of_day_end") + F.col("charge_time_min"),
            "t_until_pullout_min": 1441 - F.col("t_block_min"),
        }
    )
    return df.withColumn("min_charge_rate", ratio("block_net_energy_kwh", F.col("t_until_pullout_min") / 60))


STATUS = (
    "tot_veh_active", "tot_veh_inactive", "tot_veh_charging", "tot_veh_arriving", "tot_veh_departing",
    "tot_energy_arriving", "tot_energy_departing", "tot_power",
)


_COUNTED = ("active", "charging", "arriving", "departing", "e_in", "e_out", "power")


def _amounts(**values) -> list[Column]:
    return [_col(values.get(n, 0.0)).cast("double").alias(n) for n in (*_COUNTED, "blocks")]


def _spans(blocks: DataFrame) -> DataFrame:
    """The times of a block as whole minutes, each span from its first minute to the one after its last."""
    last = F.floor("t_charge_end_min").cast("long") + 1
    return blocks.withColumns(
        {
            "_on": F.col("t_min_of_day").cast("long"), "_off": F.col("t_min_of_day_end").cast("long"),
            "_from": F.ceil("t_charge_start_min").cast("long"), "_to": F.greatest(last, F.ceil("t_charge_start_min").cast("long")),
        }
    )


def _levels(changes: DataFrame, keys: Sequence[str], names: Sequence[str], end: Column) -> DataFrame:
    """Changes at ``t`` to levels: a row per minute in which anything changes, with the minutes until the next one.

    Changes are added up before the shuffle, so a key has at most one row per minute there.
    """
    keys = list(keys)
    summed = changes.groupBy(*keys, "t").agg(*[F.sum(n).alias(n) for n in names])
    line = Window.partitionBy(*keys).orderBy("t")
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    out = summed.withColumn("_last", F.max("t").over(Window.partitionBy(*keys)))
    out = out.select(*keys, "t", "_last", *[F.sum(n).over(so_far).alias(n) for n in names], F.lead("t").over(line).alias("_next"))
    return out.withColumn("minutes", F.coalesce(F.col("_next"), end) - F.col("t")).filter("minutes > 0").drop("_next", "_last")


def _whole(name: str) -> Column:
    return F.round(F.col(name)).cast("long")


def _named_status(levels: DataFrame, keys: Sequence[str], rest: Column) -> DataFrame:
    return levels.select(
        *keys, F.col("t").alias("t_min_of_day"), "minutes", _whole("active").alias("tot_veh_active"), rest.alias("tot_veh_inactive"),
        _whole("charging").alias("tot_veh_charging"), _whole("arriving").alias("tot_veh_arriving"), _whole("departing").alias("tot_veh_departing"),
        F.col("e_in").alias("tot_energy_arriving"), F.col("e_out").alias("tot_energy_departing"), F.col("power").alias("tot_power"),
    )


def _each_minute(levels: DataFrame) -> DataFrame:
    at = F.explode(F.sequence(F.col("t_min_of_day"), F.col("t_min_of_day") + F.col("minutes") - 1)).alias("t_min_of_day")
    return levels.select(*[at if c == "t_min_of_day" else F.col(c) for c in levels.columns if c != "minutes"])


def status_levels(blocks: DataFrame, keys: Sequence[str], horizon: int | None = None) -> DataFrame:
    """State of the fleet between changes, and the minutes it lasts; both ends of an interval counted.

    Each block gives a handful of changes (+1 at a start, -1 in the minute after an
    end); summed and accumulated they replace comparing minutes with blocks. Without a
    horizon the line goes on to the end of the day of the last change, three days at least.
    """
    keys = list(keys)
    energy, plug = F.col("block_net_energy_kwh"), F.col("plug_power_kw")

    def change(t, **values) -> Column:
        return F.struct(F.greatest(t.cast("long"), F.lit(0)).alias("t"), *_amounts(**values))

    charges = F.col("_to") > F.col("_from")
    changes = F.array(
        change(F.lit(0), blocks=1),
        change(F.col("_on"), active=1, departing=1, e_out=energy), change(F.col("_on") + 1, departing=-1, e_out=-energy),
        change(F.col("_off"), arriving=1, e_in=energy), change(F.col("_off") + 1, active=-1, arriving=-1, e_in=-energy),
        F.when(charges, change(F.col("_from"), charging=1, power=plug)),
        F.when(charges, change(F.col("_to"), charging=-1, power=-plug)),
    )
    events = _spans(blocks).select(*keys, F.inline(F.filter(changes, lambda c: c.isNotNull())))
    if horizon is None:
        end = F.greatest(F.lit(HORIZON_MIN), (F.floor((F.col("_last") - 1) / DAY_MIN) + 1) * DAY_MIN).cast("long")
    else:
        events, end = events.filter(F.col("t") < horizon), F.lit(horizon).cast("long")
    levels = _levels(events, keys, (*_COUNTED, "blocks"), end)
    return _named_status(levels, keys, _whole("blocks") - _whole("active"))


def vehicle_status(blocks: DataFrame, keys: Sequence[str], horizon: int | None = HORIZON_MIN) -> DataFrame:
    """:func:`status_levels` minute by minute."""
    return _each_minute(status_levels(blocks, keys, horizon))


def _round_the_clock(start: Column, end: Column, **values) -> list[Column]:
    """Changes of a span laid round one day: whole turns count everywhere, the remainder may pass midnight."""
    turns, at = F.floor((end - start) / DAY_MIN), F.pmod(start, F.lit(DAY_MIN))
    to = at + F.pmod(end - start, F.lit(DAY_MIN))
    part = to > at

    def change(t: Column, times) -> Column:
        return F.struct(t.cast("long").alias("t"), *_amounts(**{n: _col(v) * times for n, v in values.items()}))

    return [
        F.when(turns > 0, change(F.lit(0), turns)),
        F.when(part, change(at, 1)),
        F.when(part & (to < DAY_MIN), change(to, -1)),
        F.when(to > DAY_MIN, change(F.lit(0), 1)),
        F.when(to > DAY_MIN, change(to - DAY_MIN, -1)),
    ]


def least_at_rest(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per minute of day, between changes, the least number of vehicles at rest on any day: t, rest, minutes.

    Days are compared at the minutes in which any of them changes.
    """
    keys = list(keys)
    spans = _spans(blocks)
    ends = F.array(
        F.struct(F.lit(0).cast("long").alias("t"), F.lit(0).alias("on"), F.lit(1).alias("blocks")),
        F.struct(F.greatest("_on", F.lit(0)).alias("t"), F.lit(1).alias("on"), F.lit(0).alias("blocks")),
        F.struct(F.greatest(F.col("_off") + 1, F.lit(0)).alias("t"), F.lit(-1).alias("on"), F.lit(0).alias("blocks")),
    )
    changes = spans.select(*keys, F.inline(ends)).groupBy(*keys, "t").agg(F.sum("on").alias("on"), F.sum("blocks").alias("blocks"))
    marks = changes.groupBy(*keys).agg(
        F.collect_set(F.pmod("t", F.lit(DAY_MIN))).alias("_at"), F.floor(F.max("t") / DAY_MIN).cast("long").alias("_days")
    )
    marks = marks.select(*keys, F.explode("_at").alias("_at"), "_days").select(*keys, "_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_days"))).alias("_day"))
    marks = marks.select(*keys, (F.col("_at") + DAY_MIN * F.col("_day")).alias("t"), F.lit(0).cast("long").alias("on"), F.lit(0).cast("long").alias("blocks"))
    levels = _levels(changes.union(marks), keys, ("on", "blocks"), F.col("_last") + 1)
    rest = levels.groupBy(*keys, F.pmod("t", F.lit(DAY_MIN)).alias("t")).agg(F.min(F.col("blocks") - F.col("on")).alias("rest"))
    following = F.lead("t", 1, DAY_MIN).over(Window.partitionBy(*keys).orderBy("t"))
    return rest.withColumn("minutes", following - F.col("t"))


def folded_levels(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All days laid on one, between changes: sums over days, but the least of the vehicles at rest."""
    keys = list(keys)
    energy, plug = F.col("block_net_energy_kwh"), F.col("plug_power_kw")
    on, off = F.col("_on"), F.col("_off")
    changes = [
        F.struct(F.lit(0).cast("long").alias("t"), *_amounts()),
        *_round_the_clock(on, off + 1, active=1),
        *_round_the_clock(on, on + 1, departing=1, e_out=energy),
        *_round_the_clock(off, off + 1, arriving=1, e_in=energy),
        *_round_the_clock(F.col("_from"), F.col("_to"), charging=1, power=plug),
    ]
    events = _spans(blocks).select(*keys, F.inline(F.filter(F.array(*changes), lambda c: c.isNotNull())))
    events = events.withColumn("rest", F.lit(0.0))
    before = F.lag("rest", 1, 0).over(Window.partitionBy(*keys).orderBy("t"))
    rest = least_at_rest(blocks, keys).select(*keys, "t", *_amounts(), (F.col("rest") - before).cast("double").alias("rest"))
    levels = _levels(events.union(rest), keys, (*_COUNTED, "rest"), F.lit(DAY_MIN).cast("long"))
    return _named_status(levels, keys, _whole("rest"))


def folded_status(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """:func:`folded_levels` minute by minute."""
    return _each_minute(folded_levels(blocks, keys))


def power_levels(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Charging power of all days laid on one, between changes and quarter hours: t, minutes, power."""
    keys = list(keys)
    # what _round_the_clock gives, in plain columns: it is read for every block of every scenario
    spans = _spans(blocks).select(*keys, F.pmod("_from", F.lit(DAY_MIN)).alias("_at"), (F.col("_to") - F.col("_from")).alias("_long"), "plug_power_kw")
    part = F.pmod("_long", F.lit(DAY_MIN))
    turns = F.floor(F.col("_long") / DAY_MIN) + F.when(F.col("_at") + part > DAY_MIN, 1).otherwise(0)
    once = F.when(part > 0, 1).otherwise(0)
    plug = F.col("plug_power_kw").cast("double")
    changes = F.array(
        F.struct(F.lit(0).cast("long").alias("t"), (plug * turns).alias("power")),
        F.struct(F.col("_at").cast("long").alias("t"), (plug * once).alias("power")),
        F.struct((F.col("_at") + part).cast("long").alias("t"), (-plug * once).alias("power")),
    )
    events = spans.filter("_long > 0").select(*keys, F.inline(changes)).filter((F.col("power") != 0) & (F.col("t") != DAY_MIN))
    events = events.withColumn("t", F.pmod("t", F.lit(DAY_MIN).cast("long")))
    quarters = F.explode(F.expr(f"sequence(0L, {DAY_MIN - 15}L, 15L)")).alias("t")
    marks = blocks.select(*keys).distinct().select(*keys, quarters, F.lit(0.0).alias("power"))
    return _levels(events.union(marks), keys, ("power",), F.lit(DAY_MIN).cast("long"))


def managed_rate(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Daily energy over parked vehicle-hours: the rate that would serve all blocks."""
    energy = blocks.groupBy(*keys).agg(F.sum("block_net_energy_kwh").alias("daily_energy_kwh"))
    rest = least_at_rest(blocks, keys)
    hours = rest.groupBy(*keys).agg((F.sum(F.col("rest") * F.col("minutes")) / 60).alias("charge_veh_hr"))
    both = energy.join(hours, list(keys))
    return both.withColumn("min_charge_rate_managed", ratio("daily_energy_kwh", "charge_veh_hr"))


# Baseline parameters, the ranges around them, and the names of parameters and metrics further down.
BASELINE = {
    "acc_dec_factor": 1.0,
    "passenger_load": 41.0,
    "aux_power_kw": 20.0,
    "deadhead_consumption_kwh_mi": 2.77,
    "depot_density_per_sqkm": 0.0012,
    "door_open_time_s": 30.0,
    "temperature_f": 46.0,
    "depot_plug_power_kw": 50.0,
}
RANGES = {
    "acc_dec_factor": (0.1, 5.0),
    "passenger_load": (1.0, 82.0),
    "aux_power_kw": (1.0, 40.0),
    "deadhead_consumption_kwh_mi": (2.0, 5.0),
    "depot_density_per_sqkm": (0.0002, 0.002),
    "door_open_time_s": (10.0, 120.0),
    "temperature_f": (20.0, 90.0),
    "depot_plug_power_kw": (50.0, 350.0),
}
#: Fixed value: area served, for the number of depots.
AREA_KM2 = 5530
CYCLE_PARAMS = ("acc_dec_factor", "passenger_load", "aux_power_kw")
PARAM_NAMES = {
    "acc_dec_factor": "Acc./Dec. Factor",
    "passenger_load": "Passenger Load",
    "door_open_time_s": "Door Open Time",
    "depot_density_per_sqkm": "Depot Density",
    "deadhead_consumption_kwh_mi": "Deadhead Consumption",
    "temperature_f": "Temperature",
    "aux_power_kw": "Aux Power",
    "depot_plug_power_kw": "Plug Power",
}


def scenario_list(
    baseline: Mapping[str, float] = BASELINE, ranges: Mapping[str, tuple[float, float]] = RANGES, steps: int = 5
) -> list[tuple[str, dict[str, float]]]:
    """The baseline, then each parameter at evenly spaced values with the others at baseline."""
    out = [("baseline", dict(baseline))]
    for name, (low, high) in ranges.items():
        for i in range(steps):
            value = low + (high - low) * i / (steps - 1)
            out.append((f"{name}-{i}", {**baseline, name: value}))
    return out


def with_scenarios(df: DataFrame, scenarios: Sequence[tuple[str, Mapping[str, float]]] | None = None) -> DataFrame:
    """Each row once per scenario, with the scenario's name and parameters as columns."""
    scenarios = scenarios or scenario_list()
    rows = [
        F.struct(F.lit(name).alias("file"), *[F.lit(float(v)).alias(p) for p, v in params.items()])
        for name, params in scenarios
    ]
    return df.select("*", F.inline(F.array(*rows)))


def cycle_variants(
    scenarios: Sequence[tuple[str, Mapping[str, float]]] | None = None,
) -> list[tuple[str, dict[str, float]]]:
    """The distinct settings that change a drive cycle; other scenarios share the baseline's."""
    seen: dict[tuple, tuple[str, dict[str, float]]] = {}
    for name, params in scenarios or scenario_list():
        part = {p: params[p] for p in CYCLE_PARAMS}
        seen.setdefault(tuple(part.values()), (name, part))
    return list(seen.values())


def block_stats(prepared: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What a block's energy depends on, summed over its trips, and where it begins and ends.

    Every cost is linear in these sums, so scenarios multiply blocks and not trips.
    """
    at = F.struct("t_min_of_day", "trip_id")
    return prepared.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trips"),
        F.sum("trip_dist_m").alias("trip_dist_m"),
        F.sum("trip_deadhead_dist_m").alias("trip_deadhead_dist_m"),
        F.sum(idle_minutes()).alias("idle_min"),
        F.sum("stop_count").alias("stop_count"),
        F.min("t_min_of_day").alias("t_min_of_day"),
        F.max_by("t_min_of_day_end", at).alias("t_min_of_day_end"),
        F.min_by("start_x", at).alias("block_start_x"), F.min_by("start_y", at).alias("block_start_y"),
        F.max_by("end_x", at).alias("block_end_x"), F.max_by("end_y", at).alias("block_end_y"),
    )


def drive_sums(prepared: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Consumption, drive energy and energy returned of each block, per setting of the columns ``by``."""
    return prepared.groupBy(*keys, *by).agg(
        F.sum("consumption_kwh_mi").alias("sum_consumption"),
        F.sum(F.col("consumption_kwh_mi") * m_to_mi("trip_dist_m")).alias("cyc_energy_kwh"),
        F.sum("cyc_regen_kwh").alias("block_cyc_regen_kwh"),
    )


def block_table(stats: DataFrame) -> DataFrame:
    """Energy, distance, consumption and charge window of each block, parameters and depot read from its row.

    A block without a depot (null) has no way from and to it.
    """
    df = trip_costs(stats, {p: F.col(p) for p in BASELINE}, None, (), F.col("idle_min")).drop("block_deadhead_kwh", "block_deadhead_dist_m")
    df = depot_deadhead(df, F.col("deadhead_consumption_kwh_mi")).na.fill(0.0, ["block_deadhead_kwh", "block_deadhead_dist_m"])
    net = F.col("cyc_energy_kwh") + F.col("trip_door_kwh") + F.col("trip_deadhead_kwh") + F.col("block_deadhead_kwh")
    far = F.col("trip_dist_m") + F.col("trip_deadhead_dist_m") + F.col("block_deadhead_dist_m")
    df = df.withColumns(
        {"block_net_energy_kwh": net, "block_dist_mi": m_to_mi(far), "plug_power_kw": F.col("depot_plug_power_kw")}
    )
    return charge_window(df.withColumn("block_consumption_kwh_mi", ratio("block_net_energy_kwh", "block_dist_mi")))


def scenario_metrics(blocks: DataFrame, rest: DataFrame, keys: Sequence[str], battery_kwh: float = 466.0) -> DataFrame:
    """The fleet numbers of each scenario, long form, from :func:`block_table` and the networks' :func:`least_at_rest`.

    No scenario changes when vehicles are out, so rest is counted once per network.

    The 15-minute power is the peak of quarter-hour means, the 1-minute power
    the peak of minutes.
    """
    keys = list(keys)

    def share(when: Column) -> Column:
        return F.avg(F.when(when, 1.0).otherwise(0.0))

    fleet = blocks.groupBy(*keys).agg(
        F.sum("n_trips").cast("double").alias("Number of Trips"),
        F.count(F.lit(1)).cast("double").alias("Number of Blocks"),
        F.avg("block_dist_mi").alias("Avg. Block Distance (mi)"),
        F.avg("t_block_min").alias("Avg. Block Duration (min)"),
        F.avg("block_net_energy_kwh").alias("Avg. Block Energy (kWh)"),
        F.avg("block_consumption_kwh_mi").alias("Avg. Block Consumption (kWh/mi)"),
        (F.sum("sum_consumption") / F.sum("n_trips")).alias("Avg. Trip Consumption (kWh/mi)"),
        share(F.col("block_net_energy_kwh") < battery_kwh).alias("Proportion Blocks Meeting Energy"),
        share(F.col("t_until_pullout_min") > F.col("charge_time_min")).alias("Proportion Blocks Meeting Charging"),
        F.avg("charge_time_min").alias("Avg. Charge Time (min)"),
        F.sum("block_net_energy_kwh").alias("_energy"),
    )
    power = power_levels(blocks, keys).groupBy(*keys, F.floor(F.col("t") / 15).alias("_q")).agg(
        (F.sum(F.col("power") * F.col("minutes")) / 15).alias("_p"), F.max("power").alias("_m")
    )
    power = power.groupBy(*keys).agg(
        F.max("_m").alias("Peak 1min Power (kW)"),
        F.max("_p").alias("Peak 15min Power (kW)"),
        F.avg("_p").alias("Avg. 15min Power (kW)"),
    )
    network = [k for k in keys if k in rest.columns]
    hours = rest.groupBy(*network).agg((F.sum(F.col("rest") * F.col("minutes")) / 60).alias("_hours"))
    needs = blocks.unpivot(keys, ["block_net_energy_kwh", "min_charge_rate"], "_of", "_v")
    cuts = exact_percentiles(needs, [*keys, "_of"], "_v", [0.1, 0.95], "_p")

    def cut(of: str, p: str) -> Column:
        return F.max(F.when(F.col("_of") == of, F.col(p)))

    cuts = cuts.groupBy(*keys).agg(
        cut("block_net_energy_kwh", "_p0").alias("Battery Capacity 10% (kWh)"),
        cut("block_net_energy_kwh", "_p1").alias("Battery Capacity 95% (kWh)"),
        cut("min_charge_rate", "_p0").alias("Charger Power 10% (kW)"),
        cut("min_charge_rate", "_p1").alias("Charger Power 95% (kW)"),
    )
    wide = fleet.join(power, keys).join(cuts, keys).join(hours, network)
    wide = wide.withColumn("Min Charge Rate (kW)", ratio("_energy", "_hours")).drop("_energy", "_hours")
    metrics = [m for m in wide.columns if m not in keys]
    return wide.unpivot(keys, [F.col(f"`{m}`") for m in metrics], "metric", "value")


def name_parameters(long: DataFrame, file: str = "file") -> DataFrame:
    """The parameter behind each scenario, by its display name."""
    return long.withColumn("sensitivity_parameter", relabel(param_of(file), PARAM_NAMES))


#: What the metrics of a scenario read of its blocks.
BLOCK_MEASURES = (
    "n_trips", "sum_consumption", "block_dist_mi", "block_net_energy_kwh", "block_consumption_kwh_mi", "t_min_of_day", "t_min_of_day_end",
    "plug_power_kw", "charge_time_min", "t_charge_start_min", "t_charge_end_min", "t_block_min", "t_until_pullout_min", "min_charge_rate",
)


def run_scenarios(
    trips: DataFrame, keys: Sequence[str] = ("network_id",), scenarios=None, cycle_kwh: DataFrame | None = None,
    depots: bool = True, area_km2: float = AREA_KM2, rounds: int | None = None,
) -> DataFrame:
    """All scenarios for all networks, from trips to named metrics.

    ``cycle_kwh`` has the consumption and the energy returned of each trip per setting
    of the cycle parameters (trip_id, ``CYCLE_PARAMS``, consumption_kwh_mi,
    cyc_regen_kwh). Without it trips keep their own consumption, and scenarios that
    change a drive cycle are refused: they would equal the baseline. So are scenarios
    of depot density without ``depots``. Depots follow from the density and
    ``area_km2``, for all counts in one clustering, which goes on until no depot moves
    unless it is cut at ``rounds``.

    A block stays one row until the scenarios multiply it: its sums per cycle setting
    and its depot per count are lists as long as there are settings and counts.
    """
    keys = list(keys)
    scene, block = [*keys, "file"], [*keys, "block_id"]
    scenarios = scenarios or scenario_list()
    for names, given in ((("acc_dec_factor", "passenger_load"), cycle_kwh is not None), (("depot_density_per_sqkm",), depots)):
        moved = [p for p in names if len({params[p] for _, params in scenarios}) > 1]
        if moved and not given:
            raise ValueError(f"scenarios of {', '.join(moved)} need {'depots' if names[0].startswith('depot') else 'a table of consumption by setting'}")
    prepared = prepare_trips(trips, block)
    variants = cycle_variants(scenarios)
    setting = {tuple(v.values()): i for i, (_, v) in enumerate(variants)}
    if cycle_kwh is None:
        sums = drive_sums(prepared, block).withColumn("_setting", F.explode(F.array(*map(F.lit, range(len(variants))))))
    else:
        numbered = [(*map(float, v), i) for v, i in setting.items()]
        settings = trips.sparkSession.createDataFrame(numbered, ", ".join(f"{c} double" for c in CYCLE_PARAMS) + ", _setting int")
        wanted = cycle_kwh.select("trip_id", *CYCLE_PARAMS, "consumption_kwh_mi", "cyc_regen_kwh").join(F.broadcast(settings), list(CYCLE_PARAMS))
        wanted = wanted.select("trip_id", "_setting", "consumption_kwh_mi", "cyc_regen_kwh")
        sums = drive_sums(trips.select(*block, "trip_id", "trip_dist_m").join(wanted, "trip_id"), block, ["_setting"])
    drive = F.struct("sum_consumption", "cyc_energy_kwh", "block_cyc_regen_kwh")
    sums = sums.groupBy(*block).agg(F.map_from_entries(F.collect_list(F.struct("_setting", drive))).alias("_drive"))
    df = stage(block_stats(prepared, block).join(sums, block), "block-stats")
    counts = {name: max(1, int(area_km2 * p["depot_density_per_sqkm"])) for name, p in scenarios}
    if depots:
        centres = depot_centres(df, keys, list(counts.values()), rounds)
        at = F.struct(F.col("depot_x").alias("x"), F.col("depot_y").alias("y"))
        near = assign_depots(df.select(*block, "block_start_x", "block_start_y"), centres, keys)
        near = near.groupBy(*block).agg(F.map_from_entries(F.collect_list(F.struct("n_depots", at))).alias("_depots"))
        df = df.join(near, block, "left")
    else:
        df = df.withColumn("_depots", F.lit(None).cast("map<int, struct<x: double, y: double>>"))
    grid = [(name, {**p, "_setting": setting[tuple(p[c] for c in CYCLE_PARAMS)], "n_depots": counts[name]}) for name, p in scenarios]
    df = with_scenarios(df, grid)
    df = df.withColumns({"_at": F.try_element_at("_depots", F.col("n_depots").cast("int")), "_sums": F.try_element_at("_drive", F.col("_setting").cast("int"))})
    df = df.select("*", F.col("_at.x").alias("depot_x"), F.col("_at.y").alias("depot_y"), "_sums.*")
    blocks = stage(block_table(df).select(*scene, "block_id", *BLOCK_MEASURES), "blocks")
    # when vehicles are out is the same in every scenario
    one = blocks.filter(F.col("file") == scenarios[0][0])
    return name_parameters(scenario_metrics(blocks, least_at_rest(one, keys), scene))
