"""Stateful streams against the batch operators: rows in any order of arrival, late ones within and beyond the delay."""

import random

import pytest
from pyspark.sql import functions as F

from headway.operators import tracks as tr
from headway.streaming import positions as st

SCHEMA = "trip_id string, event_id long, locationtime long, lon double, lat double, xbin long, ybin long, speed_m_s double, ts timestamp"
HOUR = 3600
#: Times are counted from here; a stream's first watermark is 1970.
BASE = 600 * HOUR


@pytest.fixture(autouse=True)
def state_store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", st.ROCKS)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


#: Rows that came too late, per delivery.
DROPPED = []


def points(n, low, high, seed, first_id):
    r = random.Random(seed)
    out = []
    for i in range(n):
        t = r.randrange(low, high)
        out.append((f"t{r.randrange(3)}", first_id + i, t, r.random(), r.random(), r.randrange(2), 0, r.random()))
    return out


def frame(spark, rows):
    df = spark.createDataFrame([(*p[:2], p[2] + BASE, *p[3:], None) for p in rows], SCHEMA)
    return df.withColumn("ts", F.timestamp_seconds("locationtime"))


def deliver(spark, tmp_path, parts, build):
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for part in parts:
        random.Random(len(part)).shuffle(part)
        frame(spark, part).repartition(2).write.mode("append").parquet(folder)
        query = st.run_available(build(st.stream_positions(spark, folder, frame(spark, []).schema)), out, mark)
        DROPPED.append(st.rows_dropped(query))
    return spark.read.parquet(out)


def deliveries():
    """Three deliveries; the second brings rows that are late within an hour, some in the second of another, and one that is later."""
    one = points(60, 0, 2 * HOUR, 1, 0)
    late = points(40, HOUR + 1, 2 * HOUR, 2, 100) + [("t0", 150, one[3][2] if one[3][2] > HOUR else 2 * HOUR - 1, 0.5, 0.5, 0, 0, 0.5)]
    two = points(60, 2 * HOUR, 3 * HOUR, 3, 200) + late
    lost = ("t1", 300, 60, 0.1, 0.2, 1, 0, 0.3)
    three = points(60, 3 * HOUR, 6 * HOUR, 4, 400) + [("t2", 500, 6 * HOUR, 0.0, 0.0, 0, 0, 0.1)]
    return [one, [*two, lost], three], one + two + three


def settled(rows, bucket_s, delay=HOUR):
    mark = max(r[2] for r in rows) - delay
    return {r[1] for r in rows if (r[2] // bucket_s + 1) * bucket_s <= mark}


def test_steps_equal_the_batch_whatever_the_order(spark, tmp_path, bucket_s=1800):
    parts, kept = deliveries()
    DROPPED.clear()
    got = deliver(spark, tmp_path, parts, lambda df: st.stream_step_metrics(df, delay="1 hour", bucket_s=bucket_s)).collect()
    assert DROPPED == [0, 1, 0]
    batch = tr.step_metrics(frame(spark, kept), ["trip_id"], ["locationtime", "event_id"], method="haversine").collect()
    want = {r["event_id"]: (r["calc_dist_m"], r["calc_time_s"]) for r in batch}
    ids = settled(kept, bucket_s)
    assert sorted(r["event_id"] for r in got) == sorted(ids) and 300 not in ids and 150 in ids
    for r in got:
        dist, time = want[r["event_id"]]
        assert r["calc_time_s"] == time
        assert r["calc_dist_m"] == (pytest.approx(dist, abs=1e-3) if dist is not None else None)


def test_a_trip_starts_anew_after_the_limit(spark, tmp_path):
    rows = [("t0", i, t, 0.1 * i, 0.0, 0, 0, 1.0) for i, t in enumerate([0, 600, 1200, 9000, 9600, 40_000])]
    got = deliver(spark, tmp_path, [rows[:2], rows[2:4], rows[4:]], lambda df: st.stream_step_metrics(df, delay="1 second", keep_ms=1_000_000, bucket_s=60))
    assert sorted((r["event_id"], r["calc_time_s"]) for r in got.collect()) == [(0, None), (1, 600.0), (2, 600.0), (3, None), (4, 600.0)]


def test_points_without_a_position_have_no_step(spark, tmp_path):
    rows = [("t0", 0, 0, 0.0, 0.0, 0, 0, 1.0), ("t0", 1, 60, None, 0.0, 0, 0, None), ("t0", 2, 120, 0.1, 0.0, 0, 0, 1.0), ("t0", 3, 9999, 0.0, 0.0, 0, 0, 1.0)]
    got = deliver(spark, tmp_path, [rows[1:2] + rows[2:3], rows[:1] + rows[3:]], lambda df: st.stream_step_metrics(df, delay="10 minutes", bucket_s=60))
    assert sorted((r["event_id"], r["calc_dist_m"], r["calc_time_s"]) for r in got.collect()) == [(0, None, None), (1, None, 60.0), (2, None, 60.0)]


def test_recent_in_cell_equals_looking_back(spark, tmp_path, bucket_s=60):
    parts, kept = deliveries()
    got = deliver(spark, tmp_path, parts, lambda df: st.stream_recent_in_cell(df, 4, delay="1 hour", bucket_s=bucket_s)).collect()
    assert sorted(r["event_id"] for r in got) == sorted(settled(kept, bucket_s))
    own = {p[1]: p for p in kept}
    for r in got:
        p = own[r["event_id"]]
        before = sorted((q[2], q[1], q[7]) for q in kept if q[5:7] == p[5:7] and q[2] < p[2])
        assert list(r["recent"]) == [v for *_, v in before[-4:][::-1]]


def test_state_does_not_grow_with_trips(spark, tmp_path):
    """1000 trips wait in one bucket: entries count by groups and buckets; every trip steps on its own."""
    rows = [(f"t{i}", i, i % 50, 0.001 * i, 0.0, 0, 0, 1.0) for i in range(1000)]
    rows += [(f"t{i}", 1000 + i, 60 + i % 50, 0.001 * i, 0.01, 0, 0, 1.0) for i in range(0, 1000, 2)]
    rows += [(None, 2000, 5, 0.0, 0.0, 0, 0, 1.0), (None, 2001, 70, 0.0, 0.02, 0, 0, 1.0)]
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    sizes = []
    for part in (rows[::-1], [("end", 3000, 10 * HOUR, 0.0, 0.0, 0, 0, 1.0)]):
        frame(spark, part).write.mode("append").parquet(folder)
        query = st.run_available(st.stream_step_metrics(st.stream_positions(spark, folder, frame(spark, []).schema), delay="1 hour", bucket_s=60), out, mark)
        sizes += [op.numRowsTotal for p in query.recentProgress for op in p.stateOperators]
    assert 0 < max(sizes) < 1000
    got = {r["event_id"]: r for r in spark.read.parquet(out).collect()}
    assert sorted(got) == sorted(r[1] for r in rows)
    assert all(got[i]["calc_time_s"] is None and got[i]["trip_id"] == f"t{i}" for i in range(1000))
    assert all(got[1000 + i]["calc_time_s"] == 60 and got[1000 + i]["calc_dist_m"] == pytest.approx(1111.95, abs=0.1) for i in range(0, 1000, 2))
    assert got[2000]["calc_time_s"] is None and got[2001]["calc_time_s"] == 65 and got[2001]["trip_id"] is None
