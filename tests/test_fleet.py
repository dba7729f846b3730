"""Sweeps round the clock, depots, scenarios and schedules in force against counting by hand."""

import hashlib
import itertools
import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from headway.operators import baselines as bl
from headway.operators import energy as e
from headway.operators import filters as f
from headway.operators import joins as j
from headway.operators import trajectory as tj
from headway.plans.fleet import cycle_stage
from headway.plans.track_features import add_schedule

BLOCKS = (
    "network_id string, block_id string, t_min_of_day long, t_min_of_day_end long, block_net_energy_kwh double, plug_power_kw double,"
    " t_charge_start_min long, t_charge_end_min double"
)


def blocks(n, seed, longest=900):
    r = random.Random(seed)
    out = []
    for i in range(n):
        t0 = r.randrange(0, 1440)
        t1 = t0 + r.randrange(5, 2500)
        kwh, plug = r.uniform(-20, longest), r.choice([50.0, 50.0, 5.0])
        out.append((r.choice("ab"), f"b{i}", t0, t1, kwh, plug, t1, t1 + kwh / plug * 60))
    # one that charges for more than four days, one that starts and ends at midnight
    return out + [("a", "slow", 600, 700, 300.0, 2.5, 700, 700 + 300 / 2.5 * 60), ("a", "round", 0, 1440, 10.0, 5.0, 1440, 1560.0)]


def counted(data, t):
    """active, charging, arriving, departing, energy in, energy out, power at a minute."""
    active = [b for b in data if b[2] <= t <= b[3]]
    charging = [b for b in data if b[6] <= t <= b[7]]
    return [
        len(active), len(charging), sum(b[3] == t for b in data), sum(b[2] == t for b in data),
        sum(b[4] for b in data if b[3] == t), sum(b[4] for b in data if b[2] == t), sum(b[5] for b in charging),
    ]


COLUMNS = ("tot_veh_active", "tot_veh_charging", "tot_veh_arriving", "tot_veh_departing", "tot_energy_arriving", "tot_energy_departing", "tot_power")


def test_status_goes_on_to_the_last_change(spark):
    data = blocks(30, 1)
    got = e.vehicle_status(spark.createDataFrame(data, BLOCKS), ["network_id"], None).collect()
    for network in "ab":
        own = [b for b in data if b[0] == network]
        last = int(max(max(b[3], math.floor(b[7])) for b in own))
        rows = {r["t_min_of_day"]: r for r in got if r["network_id"] == network}
        assert sorted(rows) == list(range(max(3, last // 1440 + 1) * 1440))
        for t in [*range(0, len(rows), 61), last, last + 1, 1439, 1440]:
            if t in rows:
                assert [rows[t][c] for c in COLUMNS] == pytest.approx(counted(own, t), abs=1e-6)
                assert rows[t]["tot_veh_inactive"] == len(own) - rows[t]["tot_veh_active"]


def test_days_laid_on_one(spark):
    data = blocks(30, 2)
    got = e.folded_status(spark.createDataFrame(data, BLOCKS), ["network_id"]).collect()
    for network in "ab":
        own = [b for b in data if b[0] == network]
        rows = {r["t_min_of_day"]: r for r in got if r["network_id"] == network}
        assert sorted(rows) == list(range(1440))
        for m in [*range(0, 1440, 37), 1439]:
            each = [counted(own, m + 1440 * d) for d in range(12)]
            assert [rows[m][c] for c in COLUMNS] == pytest.approx([sum(x) for x in zip(*each)], abs=1e-6)
            assert rows[m]["tot_veh_inactive"] == len(own) - max(x[0] for x in each)


def test_power_and_rest_between_changes(spark):
    data = blocks(25, 3)
    df = spark.createDataFrame(data, BLOCKS)
    folded = {(r["network_id"], r["t_min_of_day"]): r for r in e.folded_status(df, ["network_id"]).collect()}
    for rows, value, name in ((e.power_levels(df, ["network_id"]), "power", "tot_power"), (e.least_at_rest(df, ["network_id"]), "rest", "tot_veh_inactive")):
        seen = {}
        for r in rows.collect():
            for m in range(r["t"], r["t"] + r["minutes"]):
                assert (r["network_id"], m) not in seen
                seen[r["network_id"], m] = r[value]
        assert seen == pytest.approx({k: r[name] for k, r in folded.items()}, abs=1e-6)


def starts(n, seed):
    r = random.Random(seed)
    rows = [(r.choice("ab"), i, float(r.randrange(0, 5000)), float(r.randrange(0, 5000)), 0.0, 0.0) for i in range(n)]
    return [*rows, ("c", 900, 1.0, 2.0, 0.0, 0.0), ("c", 901, None, 2.0, 0.0, 0.0), ("d", 902, None, None, 0.0, 0.0)]


ENDS = "network_id string, block_id int, block_start_x double, block_start_y double, block_end_x double, block_end_y double"


def test_depots_are_where_no_round_moves_them(spark):
    rows = starts(60, 4)
    df = spark.createDataFrame(rows, ENDS)
    centres = e.depot_centres(df, ["network_id"], [1, 3, 5], rounds=100)
    lists = {(r["network_id"], r["n_depots"]): [(c["x"], c["y"]) for c in r["centres"]] for r in centres.collect()}
    assert set(lists) == {(n, k) for n in "abc" for k in (1, 3, 5)} and len(lists["c", 5]) == 1
    got = e.assign_depots(df, centres, ["network_id"]).collect()
    for (network, k), places in lists.items():
        mine = [r for r in got if (r["network_id"], r["n_depots"]) == (network, k) and r["depot_id"] is not None]
        for r in mine:
            far = [(r["block_start_x"] - x) ** 2 + (r["block_start_y"] - y) ** 2 for x, y in places]
            assert r["depot_id"] == far.index(min(far)) and (r["depot_x"], r["depot_y"]) == places[r["depot_id"]]
        for i, place in enumerate(places):
            own = [(r["block_start_x"], r["block_start_y"]) for r in mine if r["depot_id"] == i]
            if own:  # the optimum condition: a centre is the mean of its blocks
                assert place == pytest.approx(tuple(np.mean(own, axis=0)), abs=1e-3)
    assert [r["depot_id"] for r in got if r["block_id"] == 901] == [None] * 3 and all(r["network_id"] != "d" for r in got)


TRIPS = (
    "trip_id string, network_id string, block_id int, t_min_of_day long, t_min_of_day_end long, start_x double, start_y double, end_x double,"
    " end_y double, trip_dist_m long, consumption_kwh_mi double, stop_count int, cyc_regen_kwh double"
)


def fleet(n, seed):
    r = random.Random(seed)
    place = lambda: float(r.randrange(0, 40_000))
    return [
        (f"t{i}", r.choice("ab"), i // 3, 300 + 40 * (i % 25), 330 + 40 * (i % 25), place(), place(), place(), place(), r.randrange(5000, 30_000), r.uniform(1.5, 3), 20, -1.0)
        for i in range(n)
    ]


def by_hand(points, k):
    """Lloyd's rounds over (block, x, y) until one moves nothing, and their number."""
    centres = [(x, y) for _, x, y in sorted(points, key=lambda p: (hashlib.md5(str(p[0]).encode()).hexdigest(), p[0]))[:k]]
    for n in itertools.count(1):
        own = [[] for _ in centres]
        for _, x, y in points:
            far = [(x - a) ** 2 + (y - b) ** 2 for a, b in centres]
            own[far.index(min(far))].append((x, y))
        mean = [tuple(math.floor(sum(v) / len(o) * 1000 + 0.5) / 1000 for v in zip(*o)) if o else c for o, c in zip(own, centres)]
        if mean == centres:
            return centres, n
        centres = mean


def test_scenarios_move_depots_until_they_rest(spark, monkeypatch):
    rows = fleet(600, 11)
    found, cluster = [], e.depot_centres
    monkeypatch.setattr(e, "depot_centres", lambda *a, **k: found.append(cluster(*a, **k)) or found[-1])
    e.run_scenarios(spark.createDataFrame(rows, TRIPS), scenarios=[("baseline", e.BASELINE)])
    centres = {r["network_id"]: [(c["x"], c["y"]) for c in r["centres"]] for r in found[0].collect()}
    longest = 0
    for network, got in centres.items():
        first = {}
        for r in sorted((r for r in rows if r[1] == network), key=lambda r: (r[3], r[0])):
            first.setdefault(r[2], (r[2], r[5], r[6]))
        want, n = by_hand(list(first.values()), len(got))
        assert got == want
        longest = max(longest, n)
    assert len(centres) == 2 and longest > 6  # five rounds were not enough


def measured(spark, rows, scenarios):
    settings = [tuple(v.values()) for _, v in e.cycle_variants(scenarios)]
    table = [(t[0], *map(float, s), t[10] + 0.05 * (s[0] - 1) + 0.002 * (s[1] - 41), -1.0) for t in rows for s in settings]
    return spark.createDataFrame(table, "trip_id string, " + ", ".join(f"{c} double" for c in e.CYCLE_PARAMS) + ", consumption_kwh_mi double, cyc_regen_kwh double")


def test_every_scenario_changes_something(spark):
    rows, scenarios = fleet(60, 5), e.scenario_list()
    df = spark.createDataFrame(rows, TRIPS)
    out = e.run_scenarios(df, cycle_kwh=measured(spark, rows, scenarios)).collect()
    values = {}
    for r in out:
        values.setdefault(r["file"], {})[r["network_id"], r["metric"]] = r["value"]
    base = dict(scenarios)["baseline"]
    depots = lambda p: max(1, int(e.AREA_KM2 * p["depot_density_per_sqkm"]))
    for name, params in scenarios:
        same = {k: v for k, v in params.items() if k != "depot_density_per_sqkm"} == {k: v for k, v in base.items() if k != "depot_density_per_sqkm"}
        unchanged = same and depots(params) == depots(base)
        assert (values[name] == pytest.approx(values["baseline"], rel=1e-12)) == unchanged, name


def test_scenarios_without_their_inputs_are_refused(spark):
    df = spark.createDataFrame(fleet(6, 6), TRIPS)
    with pytest.raises(ValueError, match="acc_dec_factor, passenger_load"):
        e.run_scenarios(df)
    quiet = [s for s in e.scenario_list() if not s[0].startswith(("acc_dec", "passenger"))]
    with pytest.raises(ValueError, match="depot_density"):
        e.run_scenarios(df, scenarios=quiet, depots=False)
    assert e.run_scenarios(df, scenarios=quiet[:1]).count() > 0


def test_schedule_in_force(spark):
    """Two feeds share a trip and a stop; each has two versions."""
    day = lambda n: date(2024, 1, 1) + timedelta(n)
    versions = [(0, day(5)), (0, day(15)), (1, day(10)), (1, day(20))]
    times = [(f, v, "T", s, i, f"0{6 + f}:{10 * k + i:02d}:00") for k, (f, v) in enumerate(versions) for i, s in enumerate("AB") if (f, i) != (1, 1)]
    trips = [(f, v, "T", f"S{f}", f"R{f}-{v.day}") for f, v in versions]
    points = [(i, f, day(d), "T", x, 0.0) for i, (f, d, x) in enumerate([(0, 2, 0.0), (0, 5, 90.0), (0, 6, 90.0), (0, 15, 0.0), (0, 16, 0.0), (1, 16, 90.0), (1, 21, 90.0)])]
    points += [(7, 1, day(16), "U", 0.0, 0.0), (8, 2, day(16), "T", 0.0, 0.0)]
    out = j.attach_schedule_in_force(
        spark.createDataFrame(points, "i int, feed int, service_day date, trip_id string, x double, y double"),
        spark.createDataFrame(times, "feed int, version date, trip_id string, stop_id string, stop_sequence int, arrival_time string"),
        spark.createDataFrame([("A", 0.0, 0.0, 0.0, 0.0), ("B", 0.0, 0.0, 100.0, 0.0)], "stop_id string, stop_lon double, stop_lat double, stop_x double, stop_y double"),
        spark.createDataFrame(trips, "feed int, version date, trip_id string, service_id string, route_id string"),
        spark.createDataFrame(versions, "feed int, version date"), ["feed"],
    )
    got = {r["i"]: (r["version"] and r["version"].day, r["stop_id"], r["t_sch_sec_of_day"], r["route_id"]) for r in out.collect()}
    sec = lambda h, m: h * 3600 + m * 60
    assert got == {
        0: (6, "A", sec(6, 0), "R0-6"), 1: (6, "B", sec(6, 1), "R0-6"), 2: (6, "B", sec(6, 1), "R0-6"), 3: (6, "A", sec(6, 0), "R0-6"),
        4: (16, "A", sec(6, 10), "R0-16"), 5: (11, "A", sec(7, 20), "R1-11"), 6: (21, "A", sec(7, 30), "R1-21"), 7: (11, None, None, None), 8: (None, None, None, None),
    }
    kept = f.keep_scheduled(j.in_force(spark.createDataFrame(points, "i int, feed int, service_day date, trip_id string, x double, y double"),
                                       spark.createDataFrame(versions, "feed int, version date"), ["feed"]),
                            spark.createDataFrame(trips, "feed int, version date, trip_id string, service_id string, route_id string"), ["feed"], ["feed", "version", "trip_id"])
    assert {r["i"]: r["scheduled"] for r in kept.collect()} == {i: i != 8 for i in range(9) if i != 7}


def test_features_take_the_schedule_in_force(spark):
    day = lambda n: date(2024, 1, 1) + timedelta(n)
    versions = [(f, day(v)) for f in (0, 1) for v in (5, 15)]
    times = [(f, v, "T", "A", 0, f"0{6 + f}:{v.day:02d}:00") for f, v in versions]
    trips = [(f, v, "T", "S", f"R{f}-{v.day}") for f, v in versions]
    points = [(f, "T", f"{f}_{d}", day(d), 1000 * d + 10 * i, i, 21_600 + f * 3600 + 60 * i, 0.0, 0.0) for f in (0, 1) for d in (10, 20) for i in range(2)]
    points += [(1, "U", "u", day(20), 5, 0, 0, 0.0, 0.0)]
    names = "feed int, trip_id string, shingle_id string, service_day date, locationtime long, point_no long, t_sec_of_day long, x double, y double"
    out = add_schedule(
        spark.createDataFrame(points, names),
        spark.createDataFrame(times, "feed int, version date, trip_id string, stop_id string, stop_sequence int, arrival_time string"),
        spark.createDataFrame([("A", 0.0, 0.0, 3.0, 4.0)], "stop_id string, stop_lon double, stop_lat double, stop_x double, stop_y double"),
        spark.createDataFrame(trips, "feed int, version date, trip_id string, service_id string, route_id string"), ["service_day"],
        spark.createDataFrame(versions, "feed int, version date"), ["feed"],
    ).collect()
    assert {(r["shingle_id"], r["point_no"]): (r["route_id"], r["sch_time_s"], r["calc_stop_dist_m"]) for r in out} == {
        (f"{f}_{d}", i): (f"R{f}-{v}", 60 * v, 5.0) for f in (0, 1) for d, v in ((10, 6), (20, 16)) for i in range(2)
    }


@pytest.mark.parametrize("inline", [2, 16, 64])
def test_nearest_in_dense_and_far_places(spark, inline):
    """Thousands of places within a hand's breadth, a line of places, and points far outside."""
    r = np.random.default_rng(6)
    dense = [("a", f"d{i}", i, float(500 + x / 1e6), float(500 + y / 1e6)) for i, (x, y) in enumerate(r.integers(0, 100, (1500, 2)))]
    line = [("a", f"l{i}", 5000 + i, float(i), 7.0) for i in range(300)] + [("b", f"m{i}", i, 3.0, 1000.0 * i) for i in range(200)]
    places = dense + line
    points = [("a", i, float(x), float(y)) for i, (x, y) in enumerate(r.uniform(-1000, 2000, (60, 2)))]
    points += [("a", 100 + i, float(500 + x / 1e6), float(500 + y / 1e6)) for i, (x, y) in enumerate(r.integers(-20, 120, (60, 2)))]
    points += [("a", 200, 1e12, -1e12), ("a", 201, -4e9, 500.0), ("b", 202, 1e7, 55_300.0), ("b", 203, 3.0, 1e9), ("b", 204, -5.0, -1e8)]
    out = j.nearest_by_key(
        spark.createDataFrame(points, "k string, i long, x double, y double"),
        spark.createDataFrame(places, "k string, stop_id string, stop_sequence long, stop_x double, stop_y double"), "k", inline=inline,
    ).collect()
    want = {}
    for k, i, x, y in points:
        dist, seq, stop = min((math.sqrt((x - p[3]) * (x - p[3]) + (y - p[4]) * (y - p[4])), p[2], p[1]) for p in places if p[0] == k)
        want[i] = (stop, dist)
    assert {r["i"]: (r["stop_id"], r["calc_stop_dist_m"]) for r in out} == want


@pytest.mark.parametrize("n", [150, 233, 267, 1000, 5000])
def test_smoothing_equals_its_definition(spark, n):
    """Odd and even windows, ends included, with one unknown value."""
    values = np.cumsum(np.random.default_rng(n).normal(0, 5, n)) + 1e4
    values[n // 2] = np.nan
    df = spark.createDataFrame([("a", i, None if math.isnan(v) else float(v)) for i, v in enumerate(values)], "k string, t long, v double").repartition(3)
    got = [r[0] for r in tj.smooth(df, ["k"], ["t"], "v").orderBy("t").select("smoothed").collect()]
    w = max(int(n * 0.03), 3)
    want = tj._smooth_chunk(values, 0, n, w, min(5, w - 1))
    assert [x is None for x in got] == np.isnan(want).tolist()
    known = ~np.isnan(want)
    assert np.allclose(np.array(got, dtype=float)[known], want[known], atol=1e-6)


def test_folds_from_one_pass_of_sums(spark):
    r = np.random.default_rng(8)
    rows = [(f"s{s}", t, float(x := r.normal(50, 9)), float(7 * s % 5), 1.0, int(s % 24), int(s % 7), 3 * x + 10.0 * (s % 24) * t) for s in range(80) for t in range(3)]
    df = bl.assign_fold(spark.createDataFrame(rows, "k string, t int, a double, b double, c double, t_hour int, t_day_of_week int, cumul_time_s double"), "k", 4)
    got = {r["k"]: (r["fold"], r["labels"], r["preds"]) for r in bl.cross_predict(df, "k", ["t"], ["a", "b", "c"]).collect()}
    data = {}
    for s, t, *x in rows:
        data.setdefault(s, {})[t] = x
    names = sorted(data)
    hot = lambda i, n: [float(i == k) for k in range(n)]
    x = np.array([[v for c in range(3) for v in (data[s][0][c], data[s][2][c])] + hot(data[s][0][3], 24) + hot(data[s][0][4], 7) for s in names])
    y, fold = np.array([data[s][2][5] for s in names]), np.array([got[s][0] for s in names])
    for k in range(4):
        tx, ty = x[fold != k], y[fold != k]
        mean, scale = tx.mean(0), tx.std(0)
        live = scale > 1e-9
        z = (tx[:, live] - mean[live]) / scale[live]
        w = np.linalg.solve(z.T @ z / len(z) + 0.01 * np.eye(live.sum()), z.T @ (ty - ty.mean()) / len(z))
        want = ty.mean() + (x[fold == k][:, live] - mean[live]) / scale[live] @ w
        assert np.allclose([got[s][2] for s, m in zip(names, fold) if m == k], want, atol=1e-6)
    assert [got[s][1] for s in names] == y.tolist()


def test_only_trips_with_points_are_scheduled(spark):
    """The rest of the schedule is looked up and dropped before it is sorted."""
    times = spark.createDataFrame([(t, s, i, f"0{6 + i}:00:00") for t in ("T", "U", None) for i, s in enumerate("BA")], "trip_id string, stop_id string, stop_sequence int, arrival_time string")
    stops = spark.createDataFrame([("A", 0.0, 0.0, 0.0, 0.0), ("B", 0.0, 0.0, 100.0, 0.0)], "stop_id string, stop_lon double, stop_lat double, stop_x double, stop_y double")
    points = spark.createDataFrame([("T",), ("T",), (None,), ("V",)], "trip_id string")
    got = j.scheduled_stops(times, stops, points=points).select("trip_id", "stop_id", "stop_sequence").collect()
    assert sorted(map(tuple, got)) == [("T", "A", 1), ("T", "B", 0)]
    assert [tuple(r) for r in j.of_trips(points.withColumn("n", F.lit(1)), points.filter("trip_id = 'V'")).collect()] == [("V", 1)]


@pytest.mark.parametrize("own", [False, True])
def test_cycles_of_all_settings_are_those_of_each(spark, own):
    """Sums side by side equal one run a setting, and seconds are not multiplied on the way."""
    r = random.Random(3)
    factors = [float(p["acc_dec_factor"]) for _, p in e.cycle_variants()]
    rows = [(f"t{i}", f, s, r.uniform(0, 20) * f ** 0.1, r.uniform(-0.05, 0.05)) for i in range(4) for f in (sorted(set(factors)) if own else [1.0]) for s in range(1 + 3 * i)]
    cycles = spark.createDataFrame(rows, "trip_id string, acc_dec_factor double, time_s long, mps double, grade double")
    plain = cycles if own else cycles.drop("acc_dec_factor")
    got = {(x["trip_id"], x["acc_dec_factor"], x["passenger_load"], x["aux_power_kw"]): (x["consumption_kwh_mi"], x["cyc_regen_kwh"]) for x in cycle_stage(plain, e.Vehicle()).collect()}
    want = {}
    for _, p in e.cycle_variants():
        one = cycles.filter(F.col("acc_dec_factor") == p["acc_dec_factor"]) if own else cycles
        for x in e.road_load_energy(one, ["trip_id"], "time_s", "mps", "grade", aux_kw=p["aux_power_kw"], passengers=p["passenger_load"]).collect():
            want[x["trip_id"], *(float(p[c]) for c in e.CYCLE_PARAMS)] = (x["electric_kwh_per_mi"], x["regen_kwh"])
    assert got.keys() == want.keys()
    assert all(got[k] == (pytest.approx(want[k][0], rel=1e-9), pytest.approx(want[k][1], rel=1e-9, abs=1e-12)) for k in want)
    plan = cycle_stage(plain, e.Vehicle())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate inline") < plan.index("Window") and plan.count("Generate inline") == 1


def test_stages_of_features_are_deleted(spark):
    from headway.catalog import load
    from headway.session import staged

    before = set(staged())
    assert load()["flagship_track_features"].run(spark, "/root/testdata/sf0.001").count() > 0
    assert ["/cumulated-" in p for p in staged() if p not in before] == [True]


def test_other_trips_go_before_anything_is_shuffled(spark):
    points = spark.range(0, 20_000, 100).selectExpr("cast(if(id = 0, null, id) as string) AS trip_id")
    times = spark.range(20_000).selectExpr("cast(if(id % 1000 = 7, null, id) as string) AS trip_id", "id AS n")
    wanted = points.filter("trip_id IS NOT NULL").distinct()
    kept = {r["n"] for r in j.maybe_of(times, wanted, "trip_id").collect()}
    asked = set(range(100, 20_000, 100))
    assert asked <= kept and len(kept) < 1.2 * len(asked)
    out = j.of_trips(times, points)
    assert sorted(r["n"] for r in out.collect()) == sorted(asked)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftSemi") < plan.index("strategy=broadcast")  # the sketch is read below the look-up


def test_rows_stay_where_they_are_when_groups_are_few(spark):
    rows = [(1, "a"), (1, "x"), (2, "x"), (2, None), (None, "x"), (None, "a"), (3, "a")]
    points = spark.createDataFrame(rows, "day int, trip_id string")
    out = f.keep_scheduled(points, spark.createDataFrame([("a",)], "trip_id string"), ["day"])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") == 1
    got = {(r["day"], r["trip_id"], r["scheduled"]) for r in out.collect()}
    assert got == {(1, "a", True), (2, "x", False), (2, None, False), (None, "a", True), (3, "a", True)}
