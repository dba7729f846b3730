"""One answer at every size, and no job while a plan is built."""

import math

import numpy as np
import pytest

from headway.catalog import load
from headway.functions.clock import hm_minutes, hms_seconds
from headway.operators import filters as f
from headway.operators import joins as j
from headway.operators import trajectory as tj

SF = "/root/testdata/sf0.001"
#: Queries whose operators write a stage, fit a model or read files and streams that the query writes first.
STAGED = {"sources", "streaming", "flagship"}
ORDERED = (
    "step_metrics", "step_speed", "cumulative", "passed_stops", "track_start", "peak_filter", "nearest_stop", "nearest_shape_point", "interp_at",
    "ecdf", "describe_cols", "asof_static", "resample_distance", "resample_second", "recent_in_cell", "ffill_cells", "network_energy", "interval_count",
)


@pytest.mark.parametrize("limit", [1, 10**9])
def test_nearest_is_the_same_at_every_size(spark, limit):
    points = spark.createDataFrame(
        [(0, "a", 1.0, 1.0), (1, "a", None, 1.0), (2, "a", math.nan, 1.0), (3, "a", 1e9, 1e9), (4, "b", 0.0, 0.0), (5, "none", 0.0, 0.0), (6, "a", -3e12, 5.0)],
        "i int, k string, x double, y double",
    )
    places = spark.createDataFrame(
        [("a", "A", 0, 0.0, 0.0), ("a", "B", 1, 500.0, 500.0), ("a", "C", 2, None, 0.0), ("a", "D", 3, math.nan, 0.0), ("b", "E", 0, 3.0, 4.0), ("b", "F", 1, 3.0, 4.0)],
        "k string, stop_id string, stop_sequence int, stop_x double, stop_y double",
    )
    got = {r["i"]: (r["stop_id"], r["calc_stop_dist_m"]) for r in j.nearest_by_key(points, places, "k", inline=limit).collect()}
    assert got[0] == ("A", pytest.approx(2**0.5)) and got[4] == ("E", 5.0)
    assert got[3][0] == "B" and got[6][0] == "A"
    assert got[1] == got[2] == got[5] == (None, None)


@pytest.mark.parametrize("n", [1000, 20_000])
def test_one_unknown_value_blanks_its_window_only(n):
    values = np.sin(np.arange(n) / 50.0)
    values[n // 2] = np.nan
    window = 2 * (int(n * 0.03) // 2) + 1
    out = tj._smooth_chunk(values, 0, n, window, 5)
    assert np.isnan(out).sum() == window


def test_dirty_text_is_null(spark):
    df = spark.createDataFrame([("25:10:05",), ("bad",), ("7",), (None,), ("",)], "t string")
    got = [tuple(r) for r in df.select(hms_seconds("t"), hm_minutes("t")).collect()]
    assert got == [(90605, 1510)] + [(None, None)] * 4
    ids = spark.createDataFrame([("7", 5), ("A12", 5), ("7.0", 5), ("9007199254740993", 5)], "v string, t long")
    assert f.slice_vehicle(ids, "v", "7", "t", 0, 9).count() == 2
    assert f.slice_vehicle(ids, "v", "9007199254740993", "t", 0, 9).count() == 1


def test_services_by_feed_with_exceptions(spark):
    from datetime import date

    week = ", ".join(f"{d} int" for d in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"))
    on = (1,) * 7
    calendar = spark.createDataFrame(
        [("A", "s1", *on, "20240101", "20241231"), ("A", "s2", *on, "20240101", "20241231"), ("B", "s3", *on, "20240101", "20241231")],
        f"feed string, service_id string, {week}, start_date string, end_date string",
    )
    trips = spark.createDataFrame([(x, s, s + x) for x in "AB" for s in ("s1", "s2", "s3", "s4")], "feed string, service_id string, trip_id string")
    exceptions = spark.createDataFrame([("A", "s2", "20240117", 2), ("B", "s4", "20240117", 1), ("B", "s3", "20240118", 2)], "feed string, service_id string, date string, exception_type int")
    got = f.day_services(trips, calendar, date(2024, 1, 17), ["feed"], exceptions).collect()
    assert sorted(tuple(r) for r in got) == [("A", "s1"), ("B", "s3"), ("B", "s4")]


def test_seconds_in_blocks(spark):
    df = spark.createDataFrame([("a", 0, 0.0), ("a", 10, 10.0), ("a", 1000, 1000.0)], "k string, t long, v double")
    every = tj.resample_by_second(df, ["k"], "t", ["v"], block=7)
    assert sorted((r["t"], round(r["v"], 6)) for r in every.collect()) == [(i, float(i)) for i in range(1001)]
    assert tj.resample_by_second(df, ["k"], "t", ["v"], longest_gap=20).count() == 12


@pytest.mark.parametrize("name", ORDERED)
def test_no_job_while_a_plan_is_built(spark, name):
    query = load()[name]
    assert query.module not in STAGED
    spark.sparkContext.setJobGroup(f"build-{name}", name)
    try:
        query.run(spark, SF)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(f"build-{name}")
    finally:
        spark.sparkContext.setJobGroup("tests", "tests")
    assert len(jobs) <= 8  # footers of the tables that the query reads
    assert not [x for x in jobs if _reads_rows(spark, x)]


def _reads_rows(spark, job) -> bool:
    """Whether the job is more than the reading of a schema (one stage, one task, named after the reader)."""
    info = spark.sparkContext.statusTracker().getJobInfo(job)
    stages = [spark.sparkContext.statusTracker().getStageInfo(s) for s in (info.stageIds if info else [])]
    return any(s is not None and not s.name.startswith("parquet") for s in stages)
