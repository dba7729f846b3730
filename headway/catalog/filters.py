"""Filters, predicates, order, sets and reshaping over whole tables."""

from datetime import date

from pyspark.sql import functions as F

from headway.catalog.registry import query, view
from headway.catalog.roles import calendar, exceptions, positions, routes, samples, scores, stop_times, table, trips, versions
from headway.functions import geo
from headway.operators import filters as f
from headway.operators import reshape as r
from headway.operators import tracks as tr


@query("range_filter_points", "event_id speed_m_s calc_dist_m",
       "SELECT * FROM smp WHERE speed_m_s > 2e1 AND speed_m_s < 8e1 AND calc_dist_m > 100 AND calc_dist_m < 400")
def _(spark, sf):
    return f.filter_points(samples(spark, sf), {"speed_m_s": (20.0, 80.0), "calc_dist_m": (100, 400)})


@query("random_dropout", "event_id trip_id",
       "SELECT * FROM pos WHERE CAST('0x' || substr(md5(CAST(event_id AS VARCHAR) || '|42'), 1, 12) AS BIGINT) % 1000000 >= 100000")
def _(spark, sf):
    return f.dropout(positions(spark, sf), 0.1, 42, ["event_id"])


@query("range_filter_tracks", "event_id shingle_id speed_m_s",
       """SELECT * FROM smp WHERE shingle_id NOT IN (SELECT shingle_id FROM smp GROUP BY 1
       HAVING count(*) < 2 OR min(speed_m_s) < 1e0 OR max(speed_m_s) > 2e2)""")
def _(spark, sf):
    return f.filter_tracks(samples(spark, sf), "shingle_id", {"speed_m_s": (1.0, 200.0)})


@query("bbox_filter", "event_id lon lat",
       "SELECT * FROM pos WHERE lon BETWEEN -122.45e0 AND -122.25e0 AND lat BETWEEN 47.4e0 AND 47.7e0")
def _(spark, sf):
    return geo.within_bounds(positions(spark, sf), "lon", "lat", (-122.45, 47.4, -122.25, 47.7))


@query("trip_time_slice", "event_id vehicle_id locationtime",
       "SELECT * FROM pos WHERE vehicle_id = 7 AND locationtime BETWEEN 1704400000 AND 1705800000")
def _(spark, sf):
    df = positions(spark, sf).withColumn("vehicle_id", F.col("vehicle_id").cast("string"))
    return f.slice_vehicle(df, "vehicle_id", "7", "locationtime", 1704400000, 1705800000).withColumn(
        "vehicle_id", F.col("vehicle_id").cast("long"))


@query("service_on_date", "service_id",
       "SELECT service_id FROM onday")
def _(spark, sf):
    return f.active_services(calendar(spark, sf), date(2024, 1, 17), exceptions=exceptions(spark, sf))


@query("services_or_busiest", "network_id service_id rule",
       """SELECT * FROM (WITH counts AS (SELECT network_id, service_id, count(*) AS n FROM trp GROUP BY ALL),
       flags AS (SELECT c.*, d.service_id IS NOT NULL AS today, w.service_id IS NOT NULL AS wd FROM counts c
         LEFT JOIN onday d USING (service_id) LEFT JOIN onweekday w USING (service_id)),
       both_ AS (SELECT *, bool_or(today) OVER (PARTITION BY network_id) AS any_today,
         count(*) OVER (PARTITION BY network_id) AS services FROM flags)
       SELECT network_id, service_id, 'calendar' AS rule FROM both_
       WHERE CASE WHEN any_today THEN today WHEN services = 1 THEN true ELSE wd END
       UNION ALL SELECT network_id, service_id, 'busiest' FROM (SELECT *, row_number() OVER (PARTITION BY network_id
         ORDER BY n DESC, service_id) AS k FROM counts) WHERE k = 1)""")
def _(spark, sf):
    t, day = trips(spark, sf), date(2024, 1, 17)
    return r.union_tagged(
        {"calendar": f.day_services(t, calendar(spark, sf), day, ["network_id"], exceptions(spark, sf)),
         "busiest": f.day_services(t, None, day, ["network_id"])}, "rule")


@query("scheduled_only", "event_id trip_id scheduled",
       """SELECT * FROM (SELECT p.*, p.trip_id IN (SELECT trip_id FROM stt) AS scheduled FROM pos p)
       QUALIFY scheduled OR NOT bool_or(scheduled) OVER (PARTITION BY feed_id)""")
def _(spark, sf):
    return f.keep_scheduled(positions(spark, sf), stop_times(spark, sf), ["feed_id"])


@query("drop_impossible_jumps", "event_id trip_id calc_dist_m~3",
       """SELECT * FROM stp_steps WHERE trip_id NOT IN (SELECT trip_id FROM stp_steps WHERE calc_dist_m > 50000)""")
def _(spark, sf):
    df = tr.step_metrics(positions(spark, sf), ["trip_id"], ["locationtime", "event_id"], method="haversine")
    return f.drop_jump_trips(df, "trip_id", "calc_dist_m", 50000)


@query("drop_bad_speeds", "event_id trip_id speed_m_s n_dropped",
       """SELECT * FROM (SELECT p.*, b.bad, sum(CASE WHEN b.bad AND first_row THEN 1 ELSE 0 END)
       OVER (PARTITION BY feed_id)::BIGINT AS n_dropped
       FROM (SELECT *, row_number() OVER (PARTITION BY feed_id, trip_id ORDER BY event_id) = 1 AS first_row FROM pos) p
       JOIN (SELECT trip_id, max(speed_m_s) > 2.5e2 OR min(speed_m_s) < 0 AS bad FROM pos GROUP BY 1) b USING (trip_id))
       WHERE NOT bad""")
def _(spark, sf):
    return f.drop_speed_outliers(positions(spark, sf), "trip_id", "speed_m_s", ["feed_id"], 0.0, 250.0)


@query("holdout_split", "event_id shingle_id held",
       """SELECT *, first_value(route_id) OVER (PARTITION BY shingle_id ORDER BY locationtime, event_id)
       IN ('R1', 'R2', 'R3') AS held FROM smp""")
def _(spark, sf):
    df, keys = samples(spark, sf), ("shingle_id", ["locationtime", "event_id"], "route_id", ["R1", "R2", "R3"])
    held = f.holdout(df, *keys, only=True).withColumn("held", F.lit(True))
    return held.unionByName(f.holdout(df, *keys).withColumn("held", F.lit(False)))


@query("min_points_trip", "event_id trip_id",
       "SELECT * FROM pos WHERE trip_id IN (SELECT trip_id FROM pos GROUP BY 1 HAVING count(*) >= 68)")
def _(spark, sf):
    return f.min_trip_points(positions(spark, sf), "trip_id", 68)


@query("order_tracks", "trip_id locationtime event_id", "SELECT * FROM pos ORDER BY trip_id, locationtime, event_id")
def _(spark, sf):
    return r.order_tracks(positions(spark, sf), ["trip_id", "locationtime", "event_id"])


@query("last_n", "vehicle_id event_id locationtime recency",
       """SELECT *, CAST(row_number() OVER (PARTITION BY vehicle_id ORDER BY locationtime DESC, event_id DESC) AS INTEGER)
       AS recency FROM pos QUALIFY recency <= 4""")
def _(spark, sf):
    return tr.last_n(positions(spark, sf), ["vehicle_id"], ["locationtime", "event_id"], 4)


@query("busiest", "network_id service_id n",
       """SELECT * FROM (SELECT network_id, service_id, count(*) AS n FROM trp GROUP BY ALL)
       QUALIFY row_number() OVER (PARTITION BY network_id ORDER BY n DESC, service_id) = 1""")
def _(spark, sf):
    return r.top_group(trips(spark, sf), "service_id", ["network_id"])


@query("head_sorted", "event_id speed_m_s", "SELECT * FROM pos ORDER BY speed_m_s DESC, event_id LIMIT 25")
def _(spark, sf):
    return r.top(positions(spark, sf), [F.desc("speed_m_s"), "event_id"], 25)


@query("sample_groups", "shape_id trip_id",
       """SELECT * FROM trp WHERE shape_id IN (SELECT shape_id FROM (SELECT DISTINCT shape_id FROM trp)
       ORDER BY CAST('0x' || substr(md5(shape_id || '|42'), 1, 12) AS BIGINT), shape_id LIMIT 10)""")
def _(spark, sf):
    return r.sample_groups(trips(spark, sf), "shape_id", 10)


@query("union_runs", "trip_id tag locationtime sec",
       """SELECT trip_id, 'seen' AS tag, locationtime, NULL::BIGINT AS sec FROM pos
       UNION ALL SELECT trip_id, 'planned', NULL, sec::BIGINT FROM stt""")
def _(spark, sf):
    from headway.functions.clock import hms_seconds
    planned = stop_times(spark, sf).select("trip_id", hms_seconds("arrival_time").alias("sec"))
    return r.union_tagged({"seen": positions(spark, sf).select("trip_id", "locationtime"), "planned": planned}, "tag")


@query("distinct_rows", "service_day vehicle_id trip_id", "SELECT DISTINCT service_day, vehicle_id, trip_id FROM pos")
def _(spark, sf):
    return r.distinct_rows(positions(spark, sf), ["service_day", "vehicle_id", "trip_id"])


@query("anti_ids", "trip_id block_id",
       "SELECT * FROM trp WHERE trip_id NOT IN (SELECT trip_id FROM stt WHERE stop_sequence >= 6)")
def _(spark, sf):
    return r.without_ids(trips(spark, sf), stop_times(spark, sf).filter("stop_sequence >= 6"), "trip_id")


@query("wide_to_long", "trip_id metric value~6",
       """SELECT trip_id, unnest(['trip_dist_m', 'consumption_kwh_mi', 'cyc_regen_kwh']) AS metric,
       unnest([trip_dist_m::DOUBLE, consumption_kwh_mi::DOUBLE, cyc_regen_kwh::DOUBLE]) AS value FROM trp""")
def _(spark, sf):
    return r.to_long(trips(spark, sf), ["trip_id"], ["trip_dist_m", "consumption_kwh_mi", "cyc_regen_kwh"])


@query("long_to_wide", "trip_id click~6 error~6 purchase~6 signup~6 view~6",
       "SELECT trip_id, " + ", ".join(f"avg(speed_m_s) FILTER (event_type = '{e}') AS {e}"
                                      for e in ("click", "error", "purchase", "signup", "view"))
       + " FROM pos GROUP BY 1")
def _(spark, sf):
    names = ["click", "error", "purchase", "signup", "view"]
    return r.to_wide(positions(spark, sf), ["trip_id"], "event_type", "speed_m_s", names)


@query("split_report", "service_day vehicle_id metric value~6",
       """SELECT service_day, split_part(n, ' - ', 1) AS vehicle_id, split_part(n, ' - ', 2) AS metric, v AS value FROM
       (SELECT service_day, unnest(['101 - speed', '102 - speed', '101 - count', '102 - count']) AS n, unnest([
         avg(speed_m_s) FILTER (vehicle_id % 2 = 0), avg(speed_m_s) FILTER (vehicle_id % 2 = 1),
         (count(*) FILTER (vehicle_id % 2 = 0))::DOUBLE, (count(*) FILTER (vehicle_id % 2 = 1))::DOUBLE]) AS v
       FROM pos GROUP BY service_day)""")
def _(spark, sf):
    odd = F.col("vehicle_id") % 2 == 1
    wide = positions(spark, sf).groupBy("service_day").agg(
        F.avg(F.when(~odd, F.col("speed_m_s"))).alias("101 - speed"),
        F.avg(F.when(odd, F.col("speed_m_s"))).alias("102 - speed"),
        F.count_if(~odd).alias("101 - count"),
        F.count_if(odd).alias("102 - count"),
    )
    return r.clean_vehicle_report(wide, ["service_day"])


view("stp_lag", """SELECT *, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0, lag(locationtime) OVER w AS t0 FROM pos
    WINDOW w AS (PARTITION BY trip_id ORDER BY locationtime, event_id)""")
view("stp_steps", """SELECT *, 12742e3 * asin(sqrt(pow(sin(radians(lat - lat0) / 2e0), 2)
    + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lon - lon0) / 2e0), 2))) AS calc_dist_m,
    degrees(atan2(sin(radians(lon - lon0)) * cos(radians(lat)), cos(radians(lat0)) * sin(radians(lat))
      - sin(radians(lat0)) * cos(radians(lat)) * cos(radians(lon - lon0)))) AS calc_bear_d,
    locationtime - t0 AS calc_time_s FROM stp_lag""")
