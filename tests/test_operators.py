"""Edge cases on small frames, with answers from brute force or by hand."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from headway import ordered as o
from headway.functions import clock, geo
from headway.functions import scalar as s
from headway.functions.sql import register
from headway.operators import aggregates as a
from headway.operators import baselines as bl
from headway.operators import energy as e
from headway.operators import filters as f
from headway.operators import joins as j
from headway.operators import tracks as tr
from headway.operators import trajectory as tj
from headway.sources import feeds as fd


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def track(spark, n=60, keys=("a", "b"), seed=1):
    rng = np.random.default_rng(seed)
    data = []
    for k in keys:
        for i in range(n if k == "a" else 5):
            v = None if rng.random() < 0.3 else float(rng.integers(0, 100))
            data.append((k, int(rng.integers(0, 40)), i, v))
    data += [(None, 1, 0, 1.0), (None, 2, 1, 2.0)]
    return spark.createDataFrame(data, "k string, t long, i long, v double")


def all_calcs(df):
    return o.ordered(
        df, ["k"], ["t", "i"], p=o.prev("v"), n=o.following("v"), rn=o.row_number(), rs=o.running_sum("v"), rm=o.running_max("v"),
        lk=o.last_known("v"), nk=o.next_known("v"), first=o.first_row("v"), last=o.last_row("v"), mn=o.group_min("v"),
        sm=o.group_sum("v"), ct=o.group_count(),
    )


def test_hot_keys_give_the_same_rows(spark):
    df = track(spark)
    plain = rows_any(all_calcs(df))
    for limit in ("3", "11", "50"):
        spark.conf.set("spark.headway.maxGroupRows", limit)
        assert rows_any(all_calcs(df.repartition(3))) == plain
    spark.conf.unset("spark.headway.maxGroupRows")


def rows_any(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_ordered_against_pandas(spark, small_groups):
    df = all_calcs(track(spark).filter("k = 'a'")).toPandas().sort_values(["t", "i"])
    v = df["v"]
    assert df["p"].equals(v.shift())
    assert df["lk"].equals(v.ffill()) and df["nk"].equals(v.bfill())
    assert list(df["rn"]) == list(range(1, len(df) + 1))
    assert np.allclose(df["rs"].ffill().fillna(0), v.fillna(0).cumsum())


def test_rows_without_key_have_no_results(spark):
    got = all_calcs(track(spark)).filter("k is null").collect()
    assert len(got) == 2 and all(r["rn"] is None and r["sm"] is None for r in got)


def test_first_step_is_missing(spark):
    df = spark.createDataFrame(
        [("a", 0, 1, 10.0, 50.0), ("a", 5, 2, 10.0, 50.1), ("b", 0, 3, 30.0, 10.0)], "k string, t long, i long, lon double, lat double")
    for method in ("haversine", "geodesic"):
        got = rows(tr.step_metrics(df, ["k"], ["t", "i"], t="t", method=method), "i", "calc_dist_m", "calc_time_s")
        assert got[0][1:] == (None, None) and got[2][1:] == (None, None)
        assert abs(got[1][1] - 11_120) < 20 and got[1][2] == 5


def test_geodesic_published_point(spark):
    """Flinders Peak to Buninyong on GRS80-like figures: 54972.271 m, azimuth 306 deg 52 min 5.37 s."""
    df = spark.createDataFrame(
        [(144 + 25 / 60 + 29.52440 / 3600, -(37 + 57 / 60 + 3.72030 / 3600), 143 + 55 / 60 + 35.38390 / 3600, -(37 + 39 / 60 + 10.15610 / 3600)),
         (10.0, 50.0, 10.0, 50.0)],
        "a double, b double, c double, d double")
    got = geo.geodesic(df, "a", "b", "c", "d").collect()
    assert abs(got[0]["dist_m"] - 54972.271) < 0.002
    assert abs(got[0]["bear_d"] % 360 - (306 + 52 / 60 + 5.37 / 3600)) < 1e-5
    assert got[1]["dist_m"] == 0


def test_utm_published_point(spark):
    """CN Tower: zone 17 north, 630084 east, 4833438 north."""
    df = geo.project(spark.createDataFrame([(-79.387139, 43.642567)], "lon double, lat double"), "lon", "lat", 32617)
    r = df.first()
    assert abs(r["x"] - 630084) < 1 and abs(r["y"] - 4833438) < 2


def test_grid_bin_is_digitize(spark):
    register(spark)
    lo, hi, size = 0, 10_300, 500
    edges = np.linspace(lo, hi, (hi - lo) // size)
    values = [-1.0, 0.0, 1.0, 514.9, 515.0, 5000.0, 10_299.9, 10_300.0, 20_000.0, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [tuple(r) for r in df.select(geo.grid_bin("v", lo, hi, size), F.expr(f"grid_bin(v, {lo}, {hi}, {size})")).collect()]
    want = [None if v is None else int(np.digitize(v, edges)) for v in values]
    assert [g[0] for g in got] == want and [g[1] for g in got] == want


def test_clock(spark):
    df = spark.createDataFrame([("25:10:05",), ("23:59:00",), (None,)], "c string")
    got = df.select(clock.hms_seconds("c"), clock.hm_minutes("c"), clock.hm_minutes("c", True)).collect()
    assert [tuple(r) for r in got] == [(90605, 1510, 70), (86340, 1439, 1439), (None, None, None)]
    df = spark.createDataFrame([(80000, 1000), (1000, 500), (None, 5)], "sch long, start long")
    assert [r[0] for r in df.select(clock.scheduled_elapsed("sch", "start")).collect()] == [79000 - 86400, 500, 0]


def test_nearest_small_and_large_keys_agree_with_brute_force(spark):
    rng = np.random.default_rng(3)
    places = [(k, f"s{i}", i, float(x), float(y)) for k, n in (("a", 300), ("b", 3))
              for i, (x, y) in enumerate(rng.integers(0, 3000, (n, 2)))]
    places += [("a", f"far{i}", 1000 + i, 900_000.0 + i % 20, 900_000.0 + i // 20) for i in range(200)]
    points = [(k, i, float(x), float(y)) for k in "abc" for i, (x, y) in enumerate(rng.integers(-500, 4000, (80, 2)))]
    points += [("a", 900, 500_000.0, 480_000.0), ("a", 901, -7e5, 3e5)]
    pl = spark.createDataFrame(places, "k string, stop_id string, stop_sequence long, stop_x double, stop_y double")
    pt = spark.createDataFrame(points, "k string, i long, x double, y double")
    got = rows(j.nearest_by_key(pt, pl, "k", inline=50), "k", "i", "stop_id", "calc_stop_dist_m")
    want = []
    for k, i, x, y in points:
        best = min((((x - q[3]) ** 2 + (y - q[4]) ** 2) ** 0.5, q[2], q[1]) for q in places if q[0] == k) if k != "c" else (None, None, None)
        want.append((k, i, best[2], best[0]))
    assert got == sorted(want)


@pytest.mark.parametrize("n", [2, 3, 20, 140, 210, 400])
def test_smoothing(spark, n):
    """Windows of 3 (input), 4 (even) and odd; a polynomial of fitting degree is kept where the fit is at the sample."""
    y = np.sin(np.arange(n) / 9.0) * 10
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(y)], "k string, t long, v double")
    got = [r[1] for r in rows(tj.smooth(df, ["k"], ["t"], "v"), "t", "smoothed")]
    w = max(int(n * 0.03), 3)
    d = min(5, w - 1)
    if w == 3:
        assert np.allclose(got, y)
        return
    want, half = np.empty(n), w // 2
    for i in range(n):
        lo = i - half if w % 2 else i - half + 1
        at = half if w % 2 else half - 0.5
        if i < half:
            lo, at = 0, i
        elif i >= n - half:
            lo, at = n - w, i - (n - w)
        want[i] = np.polyval(np.polyfit(np.arange(w), y[lo : lo + w], d), at)
    assert np.allclose(got, want, atol=1e-6)
    spark.conf.set("spark.headway.maxGroupRows", "50")
    split = [r[1] for r in rows(tj.smooth(df, ["k"], ["t"], "v"), "t", "smoothed")]
    spark.conf.unset("spark.headway.maxGroupRows")
    assert np.allclose(split, got)


def test_resample_is_interp(spark):
    d = [0.0, 0.0, 130.0, 130.0, 400.0, 1000.0]
    df = spark.createDataFrame([("a", i, v, v * 2) for i, v in enumerate(d)], "k string, t long, cumul_dist_m double, lat double")
    got = rows(tj.resample_by_distance(df, ["k"], ["t"], 200.0, linear=["lat"]), "cumul_dist_m", "lat")
    marks = np.arange(0, 1000, 200)
    assert got == [(float(m), float(np.interp(m, d, np.array(d) * 2))) for m in marks]


def test_peak_filter_reuses_end_windows(spark):
    v = [1.0, 5.0, 2.0, 8.0]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)] + [("b", 0, 3.0)], "k string, t long, v double")
    got = rows(tj.peak_filter(df, ["k"], ["t"], "v", 3, 2.0, 1.0), "k", "t", "peaked")
    mid1, mid2 = 5 + 2 * (5 - 8 / 3), 2 + (2 - 5)
    assert np.allclose([g[2] for g in got], [mid1, mid1, mid2, mid2, 3.0])


def test_vehicle_status_against_counting(spark):
    rng = np.random.default_rng(5)
    data = [("n", f"b{i}", int(t0), int(t0 + d), float(x), 50.0, int(t0 + d), float(t0 + d + x / 50 * 60))
            for i, (t0, d, x) in enumerate(zip(rng.integers(0, 1400, 40), rng.integers(10, 2000, 40), rng.integers(-20, 900, 40)))]
    df = spark.createDataFrame(
        data, "network_id string, block_id string, t_min_of_day long, t_min_of_day_end long, block_net_energy_kwh double,"
        " plug_power_kw double, t_charge_start_min long, t_charge_end_min double")
    got = e.vehicle_status(df, ["network_id"]).toPandas().sort_values("t_min_of_day")
    assert len(got) == 4320
    for t in (0, 100, 777, 1439, 1440, 2000, 3000, 4319):
        r = got.iloc[t]
        assert r["tot_veh_active"] == sum(b[2] <= t <= b[3] for b in data)
        assert r["tot_veh_active"] + r["tot_veh_inactive"] == len(data)
        assert r["tot_veh_charging"] == sum(b[6] <= t <= b[7] for b in data)
        assert abs(r["tot_power"] - 50 * sum(b[6] <= t <= b[7] for b in data)) < 1e-9
        assert r["tot_veh_arriving"] == sum(b[3] == t for b in data)
        assert abs(r["tot_energy_departing"] - sum(b[4] for b in data if b[2] == t)) < 1e-9


def test_percentiles_are_exact(spark, small_groups):
    v = np.random.default_rng(2).integers(0, 30, 101).astype(float)
    df = spark.createDataFrame([("a", float(x)) for x in v], "k string, v double")
    r = a.exact_percentiles(df, ["k"], "v", [0.1, 0.5, 0.95]).first()
    assert np.allclose([r["p0"], r["p1"], r["p2"]], np.percentile(v, [10, 50, 95]))


def test_shingles_partition_tracks(spark):
    df = spark.createDataFrame([(k, i) for k, n in (("a", 17), ("b", 3), ("c", 1)) for i in range(n)], "k string, t long")
    out = tr.shingle(df, ["k"], ["t"], 2, 5).toPandas()
    assert len(out) == 21
    sizes = out[out.k == "a"].groupby("shingle_id").size()
    assert sizes.max() - sizes.min() <= 1 and 2 <= len(sizes) <= 4


def test_filter_tracks_counts_and_nulls(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", 35.0), ("b", 1.0), ("b", 36.0), ("c", 5.0), ("d", None), ("d", 3.0), (None, 99.0)], "k string, v double")
    assert rows(f.filter_tracks(df, "k", {"v": (0, 35)}).filter("k is not null"), "k") == [("a",), ("a",), ("d",), ("d",)]


def test_service_days_and_calendar(spark):
    cal = spark.createDataFrame(
        [("in", 1, "20240117", "20240131"), ("edge", 1, "20240101", "20240117"), ("off", 0, "20240101", "20241231"), ("old", 1, "20230101", "20231231")],
        "service_id string, wednesday int, start_date string, end_date string")
    assert rows(f.active_services(cal, datetime.date(2024, 1, 17)), "service_id") == [("edge",), ("in",)]
    df = spark.createDataFrame([(datetime.date(2024, 2, 28), 3), (datetime.date(2024, 1, 1), 0)], "d date, n int")
    assert [r[0].day for r in fd.service_days(df, "d", "n").select("service_day").orderBy("service_day").collect()] == [28, 29, 1]


def test_latest_version_is_strictly_before(spark):
    d = datetime.date
    days = spark.createDataFrame([(1, d(2024, 1, 5)), (1, d(2024, 1, 10)), (1, d(2024, 1, 11))], "feed int, service_day date")
    ver = spark.createDataFrame([(1, d(2024, 1, 7)), (1, d(2024, 1, 10))], "feed int, version date")
    got = rows(j.latest_before(days, ver, ["feed"]), "service_day", "version")
    assert [g[1].day for g in got] == [7, 7, 10]


def test_ratio_and_clip(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 4.0), (None, 1.0), (float("nan"), 1.0)], "a double, b double")
    assert [r[0] for r in df.select(s.ratio("a", "b")).collect()] == [None, 0.25, None, None]
    assert [r[0] for r in df.select(s.clip("a", 2.0, 3.0)).limit(3).collect()] == [2.0, 2.0, None]


def test_recent_fill_and_strict(spark):
    pts = spark.createDataFrame([("c", 1, 1, 10.0), ("c", 2, 2, 20.0), ("c", 5, 3, 30.0)], "cell string, t long, i long, v double")
    ask = spark.createDataFrame([("c", 2, 100), ("c", 9, 101), ("d", 9, 102)], "cell string, at long, q long")
    rec = tr.recent_in_cell(pts, ask, ["cell"], "t", "i", "at", ["q"], ["v"], 2)
    assert rows(tr.recent_columns(rec, ["v"], 2).fillna(-1), "q", "v_1", "v_2") == [(100, 10.0, -1), (101, 30.0, 20.0), (102, -1, -1)]
    assert rows(tr.recent_columns(rec, ["v"], 2, strict=True).fillna(-1), "q", "v_1") == [(100, -1), (101, 30.0), (102, -1)]
    filled = tr.recent_columns(rec.withColumn("run", F.lit(1)), ["v"], 2, fill_by=["run"])
    assert rows(filled, "q", "v_1")[2] == (102, 20.0)


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(10.0, 12.0), (20.0, 16.0)], "labels double, preds double").withColumn("g", F.lit(1))
    r = a.regression_metrics(df, "labels", "preds", ["g"]).first()
    assert r["mae"] == 3 and abs(r["rmse"] - 10**0.5) < 1e-12 and abs(r["mape"] - 0.2) < 1e-12
    assert abs(r["r_score"] - (1 - 20 / 50)) < 1e-12 and abs(r["ex_var"] - (1 - 9 / 25)) < 1e-12


def test_hourly_speed_defaults(spark):
    df = spark.createDataFrame([("a", 1, 7, 4.0), ("a", 2, 8, 6.0), ("b", 1, 7, 9.0)], "k string, t long, h long, v double")
    got = dict(rows(bl.fit_hourly_speed(df, "k", ["t"], "v", "h"), "t_hour", "speed"))
    assert len(got) == 24 and got[7] == 7.0 and got[8] == 6.0


def test_doors_gain_in_the_heat(spark):
    df = spark.createDataFrame([(10,)], "stop_count long")
    cold, hot = (e.door_energy(df, t, 30).first()["trip_door_kwh"] for t in (46, 84))
    assert cold > 0 and hot == -cold
    assert e.door_energy(df, 84, 30, cooling="abs").first()["trip_door_kwh"] == cold
    assert e.door_energy(df, 65, 30).first()["trip_door_kwh"] == 0


def test_scenarios():
    names = [n for n, _ in e.scenario_list()]
    assert len(names) == 41 and names[0] == "baseline" and names[-1] == "depot_plug_power_kw-4"
    assert len(e.cycle_variants()) == 16
