"""Ordered calculations per track, block, shape and cell."""

from pyspark.sql import functions as F

from headway import ordered as o
from headway.catalog.registry import query, view
from headway.catalog.roles import positions, samples, table, trips
from headway.functions import geo
from headway.functions.scalar import clip, ratio
from headway.operators import tracks as tr

TRIP = (["trip_id"], ["locationtime", "event_id"])
SHINGLE = (["shingle_id"], ["locationtime", "event_id"])


def stop_visits(spark, sf):
    """Stop sequence seen at each point, for the passed-stops features."""
    return positions(spark, sf).withColumn("stop_sequence", F.expr("locationtime div 7200 % 40"))


view("vis", "SELECT *, locationtime // 7200 % 40 AS stop_sequence FROM pos")


@query("step_metrics", "event_id trip_id calc_dist_m~3 calc_bear_d~6 calc_time_s", "SELECT * FROM stp_steps")
def _(spark, sf):
    return tr.step_metrics(positions(spark, sf), *TRIP, method="haversine")


@query("step_speed", "event_id calc_speed_m_s~6 calc_dist_km~6",
       """SELECT *, CASE WHEN calc_time_s <> 0 THEN calc_dist_m / calc_time_s END AS calc_speed_m_s,
       calc_dist_m / 1e3 AS calc_dist_km FROM stp_steps WHERE t0 IS NOT NULL""")
def _(spark, sf):
    return tr.step_speed(tr.step_metrics(positions(spark, sf), *TRIP, method="haversine"), *TRIP)


view("cum0", """SELECT *, CAST(sum(calc_time_s) OVER w AS DOUBLE) AS ct, sum(calc_dist_km) OVER w AS cd,
    CAST(sum(passed_stops_n) OVER w AS BIGINT) AS cp FROM smp
    WINDOW w AS (PARTITION BY shingle_id ORDER BY locationtime, event_id ROWS UNBOUNDED PRECEDING)""")
view("cum", """SELECT *, ct - min(ct) OVER w AS cumul_time_s, cd - min(cd) OVER w AS cumul_dist_km,
    cp - min(cp) OVER w AS cumul_passed_stops_n, cd * 1000 AS cumul_dist_m FROM cum0
    WINDOW w AS (PARTITION BY shingle_id)""")


def cumulated(spark, sf):
    return tr.cumulative_features(samples(spark, sf), *SHINGLE)


@query("cumulative", "event_id shingle_id cumul_time_s~6 cumul_dist_km~6 cumul_dist_m~4 cumul_passed_stops_n",
       "SELECT * FROM cum")
def _(spark, sf):
    return cumulated(spark, sf)


@query("passed_stops", "event_id passed_stops_n",
       """SELECT *, coalesce(stop_sequence - lag(stop_sequence) OVER (PARTITION BY trip_id ORDER BY locationtime, event_id), 0)
       AS passed_stops_n FROM vis""")
def _(spark, sf):
    return tr.passed_stops(stop_visits(spark, sf), *TRIP)


@query("track_start", "event_id shingle_id t_sec_of_day_start",
       "SELECT *, min(locationtime % 86400) OVER (PARTITION BY shingle_id) AS t_sec_of_day_start FROM smp")
def _(spark, sf):
    return tr.track_start(samples(spark, sf).withColumn("sec", F.col("locationtime") % 86400), ["shingle_id"], "sec")


view("num", """SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY locationtime, event_id) AS rn,
    count(*) OVER (PARTITION BY trip_id) AS n FROM pos""")


@query("trim_ends", "event_id trip_id", "SELECT * FROM num WHERE rn > 3 AND rn <= n - 3")
def _(spark, sf):
    return tr.trim_track_ends(positions(spark, sf), *TRIP, 3)


@query("shingle", "event_id trip_id shingle_id",
       """SELECT *, trip_id || '_' || CASE WHEN rn - 1 < (n % k) * (n // k + 1) THEN (rn - 1) // (n // k + 1)
       ELSE n % k + (rn - 1 - (n % k) * (n // k + 1)) // (n // k) END AS shingle_id FROM (SELECT *, 2 + CAST('0x' || substr(md5(trip_id || '|42'), 1, 12) AS BIGINT) % 3 AS k FROM num)""")
def _(spark, sf):
    return tr.shingle(positions(spark, sf), *TRIP, 2, 5)


@query("gap_to_next", "trip_id block_id t_min_down",
       """SELECT *, coalesce(lead(t_min_of_day) OVER (PARTITION BY block_id ORDER BY t_min_of_day, trip_id)
       - t_min_of_day_end, 0) AS t_min_down FROM trp""")
def _(spark, sf):
    return tr.downtime(trips(spark, sf), ["block_id"])


@query("deadhead", "trip_id block_id trip_deadhead_dist_m~3",
       """SELECT *, coalesce(abs(lead(start_x) OVER w - end_x) + abs(lead(start_y) OVER w - end_y), 0e0)
       AS trip_deadhead_dist_m FROM trp WINDOW w AS (PARTITION BY block_id ORDER BY t_min_of_day, trip_id)""")
def _(spark, sf):
    return tr.deadhead(trips(spark, sf), ["block_id"])


def cells(spark, sf, size=5000.0):
    """Positions with grid cells over the whole service area."""
    return positions(spark, sf).withColumns(
        {"xbin": geo.grid_bin("x", 0, 37500, size), "ybin": geo.grid_bin("y", 0, 50000, size)})


view("cel", """SELECT *, CAST(CASE WHEN x < 0 THEN 0 WHEN x >= 37500 THEN 7
    ELSE least(floor(x / (37500e0 / 6e0)) + 1, 6) END AS BIGINT) AS xbin,
    CAST(CASE WHEN y < 0 THEN 0 WHEN y >= 50000 THEN 10 ELSE least(floor(y / (50000e0 / 9e0)) + 1, 9) END AS BIGINT)
    AS ybin FROM pos""")


@query("recent_in_cell", "event_id recency speed_m_s elapsed_s",
       """SELECT s.event_id, s.recency, s.speed_m_s, s.elapsed_s FROM (
         SELECT q.event_id, p.speed_m_s, p.locationtime - q.track_t0 AS elapsed_s,
         row_number() OVER (PARTITION BY q.event_id ORDER BY p.locationtime DESC, p.event_id DESC) AS recency
         FROM (SELECT *, min(locationtime) OVER (PARTITION BY trip_id, locationtime // 432000) AS track_t0 FROM cel) q
         JOIN cel p ON p.xbin = q.xbin AND p.ybin = q.ybin AND p.locationtime < q.track_t0) s WHERE recency <= 4""")
def _(spark, sf):
    pts = cells(spark, sf)
    tracks = o.with_group(
        pts.withColumn("part", F.expr("locationtime div 432000")), ["trip_id", "part"], track_t0=F.min("locationtime"))
    recent = tr.recent_in_cell(
        pts, tracks.select("xbin", "ybin", "event_id", "track_t0"), ["xbin", "ybin"], "locationtime", "event_id",
        "track_t0", ["event_id"], ["speed_m_s"], 4)
    return tr.recent_rows(recent, ["event_id"])


@query("ffill_cells", "event_id xbin ybin filled",
       """SELECT *, last_value(CASE WHEN event_id % 3 = 0 THEN speed_m_s END IGNORE NULLS) OVER (PARTITION BY xbin, ybin
       ORDER BY locationtime, event_id ROWS UNBOUNDED PRECEDING) AS filled FROM cel""")
def _(spark, sf):
    df = cells(spark, sf).withColumn("filled", F.expr("case when event_id % 3 = 0 then speed_m_s end"))
    return tr.fill_forward(df, ["xbin", "ybin"], ["locationtime", "event_id"], "filled")


view("gaps", "SELECT *, CASE WHEN event_id % 4 = 1 THEN speed_m_s END AS v FROM pos")


@query("fill_both", "event_id v",
       """SELECT event_id, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY trip_id ORDER BY locationtime, event_id
         ROWS UNBOUNDED PRECEDING), first_value(v IGNORE NULLS) OVER (PARTITION BY trip_id ORDER BY locationtime, event_id
         ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM gaps""")
def _(spark, sf):
    df = positions(spark, sf).withColumn("v", F.expr("case when event_id % 4 = 1 then speed_m_s end"))
    return tr.fill_both(df, *TRIP, "v")


@query("local_diff", "event_id local_diff~6",
       """SELECT *, speed_m_s - lag(speed_m_s, 2) OVER (PARTITION BY trip_id ORDER BY locationtime, event_id) AS local_diff
       FROM pos QUALIFY row_number() OVER (PARTITION BY trip_id ORDER BY locationtime, event_id) >= 3""")
def _(spark, sf):
    return tr.local_diff(positions(spark, sf), *TRIP, "speed_m_s", 3)


@query("first_last_row", "shingle_id x_first y_first speed_m_s_first x_last y_last speed_m_s_last",
       "SELECT shingle_id, " + ", ".join(
           f"arg_{'min' if e == 'first' else 'max'}({c}, (locationtime, event_id)) AS {c}_{e}"
           for e in ("first", "last") for c in ("x", "y", "speed_m_s")) + " FROM smp GROUP BY 1")
def _(spark, sf):
    return tr.first_last(samples(spark, sf), *SHINGLE, ["x", "y", "speed_m_s"])


@query("repeat_first", "event_id t_min_of_day_start t_day_of_week_start",
       """SELECT *, first_value(t_min_of_day) OVER w AS t_min_of_day_start, first_value(t_day_of_week) OVER w
       AS t_day_of_week_start FROM smp WINDOW w AS (PARTITION BY shingle_id ORDER BY locationtime, event_id)""")
def _(spark, sf):
    return tr.repeat_first(samples(spark, sf), *SHINGLE, ["t_min_of_day", "t_day_of_week"])


@query("running_energy", "event_id cumul_kwh~6",
       """SELECT *, sum(speed_m_s) OVER (PARTITION BY trip_id ORDER BY locationtime, event_id ROWS UNBOUNDED PRECEDING)
       / 3600 AS cumul_kwh FROM pos""")
def _(spark, sf):
    return tr.running_kwh(positions(spark, sf), *TRIP, "speed_m_s")


@query("acceleration", "event_id accel~8",
       """SELECT *, CASE WHEN dt <> 0 THEN dv / dt END AS accel FROM (SELECT *, speed_m_s - lag(speed_m_s) OVER w AS dv,
       locationtime - lag(locationtime) OVER w AS dt FROM pos
       WINDOW w AS (PARTITION BY trip_id ORDER BY locationtime, event_id))""")
def _(spark, sf):
    return tr.acceleration(positions(spark, sf), *TRIP, "speed_m_s", "locationtime")


view("seg", """SELECT trip_id AS shape_id, locationtime // 7200 % 40 AS seq_id, avg(speed_m_s) AS speed_mean
    FROM pos GROUP BY ALL""")


@query("shape_cumulative", "shape_id seq_id cumul_dist_m~3 calc_dist_m~3 calc_time_s~6 cumul_time_s~6",
       """SELECT *, sum(calc_time_s) OVER (PARTITION BY shape_id ORDER BY seq_id ROWS UNBOUNDED PRECEDING) AS cumul_time_s
       FROM (SELECT *, calc_dist_m / speed_mean AS calc_time_s FROM (SELECT *, seq_id * 3e2 AS cumul_dist_m,
       coalesce(seq_id * 3e2 - lag(seq_id * 3e2) OVER (PARTITION BY shape_id ORDER BY seq_id), 0e0) AS calc_dist_m
       FROM seg))""")
def _(spark, sf):
    df = (positions(spark, sf).withColumn("seq_id", F.expr("locationtime div 7200 % 40"))
          .groupBy(F.col("trip_id").alias("shape_id"), "seq_id").agg(F.avg("speed_m_s").alias("speed_mean")))
    return tr.segment_profile(df)
