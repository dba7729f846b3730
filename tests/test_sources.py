"""Readers of small reference files: drive cycles, vehicles, the source registry."""

import pytest

from headway.sources import sensors


def write(tmp_path, name, text, encoding="utf-8"):
    path = tmp_path / name
    path.write_text(text, encoding=encoding)
    return str(path)


def test_drive_cycle_with_a_byte_order_mark(spark, tmp_path):
    path = write(tmp_path, "cycle.csv", "Time (seconds),Speed (mph)\n0,0\n1,10.5\n2,bad\n", "utf-8-sig")
    got = sorted((r["time_s"], r["mps"]) for r in sensors.read_drive_cycle(spark, path).collect())
    assert got == [(0, 0.0), (1, pytest.approx(10.5 * 0.44704, rel=1e-3)), (2, None)]


def test_single_row_cycle(spark, tmp_path):
    path = write(tmp_path, "one.csv", "Time (seconds),Speed (mph)\n0,60\n")
    assert sensors.read_drive_cycle(spark, path).count() == 1


def test_vehicles_are_typed_without_a_pass_over_the_file(spark, tmp_path):
    text = "selection,scenario_name,drag_coef,mc_eff_map,veh_override_kg\n1,bus,0.6,\"[0.1, 0.25]\",18340\n2,car,,,x\n"
    tracker = spark.sparkContext.statusTracker()
    path = write(tmp_path, "veh.csv", text)
    spark.sparkContext.setJobGroup("vehicles", "reading")
    df = sensors.read_vehicles(spark, path)
    headers = len(tracker.getJobIdsForGroup("vehicles"))
    got = {r["selection"]: r for r in df.collect()}
    assert headers <= 1 and got["1"]["drag_coef"] == 0.6 and list(got["1"]["mc_eff_map"]) == [0.1, 0.25] and got["1"]["scenario_name"] == "bus"
    assert got["2"]["drag_coef"] is None and got["2"]["veh_override_kg"] is None and not got["2"]["mc_eff_map"]


def test_registry_columns_by_name(spark, tmp_path):
    head = "uuid,provider,epsg_code,min_lon,max_lon,min_lat,max_lat,coord_ref_x,coord_ref_y,extra,tz_str"
    path = write(tmp_path, "reg.csv", f"{head}\nu1,North,32610,-122.5,-121.9,47.1,48.0,550000,5270000,e,America/Los_Angeles\nu2,South,32756,151,,-34.1,x,1,2,e,Australia/Sydney\n")
    got = {r["uuid"]: r.asDict() for r in sensors.read_registry(spark, path).collect()}
    assert got["u1"] == {
        "provider": "North", "min_lon": -122.5, "max_lon": -121.9, "min_lat": 47.1, "max_lat": 48.0, "uuid": "u1", "tz_str": "America/Los_Angeles",
        "epsg_code": 32610, "coord_ref_x": 550000, "coord_ref_y": 5270000,
    }
    assert got["u2"]["epsg_code"] == 32756 and got["u2"]["max_lon"] is None and got["u2"]["max_lat"] is None
