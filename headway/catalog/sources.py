"""Readers, writers and daily roll-up, each over files made from whole tables."""

from datetime import date

from pyspark.sql import functions as F

from headway.catalog.registry import query, view
from headway.catalog.roles import positions, samples, stop_times, stops, table, trips
from headway.session import shared_dir
from headway.sources import feeds as fd
from headway.sources import sensors as sn


@query("scan_positions", "trip_id locationtime lat lon vehicle_id realtime_filename",
       """SELECT trip_id, locationtime, lat, lon, CAST(vehicle_id AS VARCHAR) AS vehicle_id, 'events.parquet' AS realtime_filename
       FROM pos WHERE service_day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""")
def _(spark, sf):
    cols = {
        "trip_id": "user_id", "locationtime": "unix_seconds(cast(ts as timestamp))",
        "lat": "4.733e1 + ((event_id * 6367) % 1000) * 4.5e-4", "lon": "-1.2255e2 + ((event_id * 7919) % 1000) * 5e-4",
        "vehicle_id": "user_id % 40",
    }
    # The table has no day column: the range on its timestamp is pushed to the scan.
    from datetime import datetime
    days = (datetime(2024, 1, 5), datetime(2024, 1, 20, 23, 59, 59, 999999))
    return fd.read_positions(spark, f"{sf}/events.parquet", cols, days, "ts")


@query("scan_schedule", "part a b c d",
       """SELECT 'stop_times' AS part, trip_id AS a, stop_id AS b, arrival_time AS c, CAST(stop_sequence AS VARCHAR) AS d FROM stt
       WHERE stop_sequence % 5 > 0 UNION ALL SELECT 'stops', stop_id, CAST(round(stop_x) AS BIGINT)::VARCHAR, NULL, NULL FROM stp
       UNION ALL SELECT 'trips', trip_id, service_id, route_id, NULL FROM trp""")
def _(spark, sf):
    folder = shared_dir(spark, "schedule")
    times = stop_times(spark, sf).withColumn("arrival_time", F.expr("case when stop_sequence % 5 > 0 then arrival_time end"))
    times.write.csv(f"{folder}/stop_times.txt", header=True)
    stops(spark, sf).selectExpr("stop_lat", "stop_id", "stop_x AS stop_lon").write.csv(f"{folder}/stops.txt", header=True)
    trips(spark, sf).select("route_id", "trip_id", "service_id").write.csv(f"{folder}/trips.txt", header=True)
    times, places, runs = fd.read_schedule(spark, folder)
    none = F.lit(None).cast("string")
    return (
        times.select(F.lit("stop_times").alias("part"), F.col("trip_id").alias("a"), F.col("stop_id").alias("b"),
                     F.col("arrival_time").alias("c"), F.col("stop_sequence").cast("string").alias("d"))
        .unionByName(places.select(F.lit("stops").alias("part"), F.col("stop_id").alias("a"),
                                   F.round("stop_lon").cast("long").cast("string").alias("b"), none.alias("c"), none.alias("d")))
        .unionByName(runs.select(F.lit("trips").alias("part"), F.col("trip_id").alias("a"), F.col("service_id").alias("b"),
                                 F.col("route_id").alias("c"), none.alias("d")))
    )


def feed(spark, sf):
    """Two entities per message: the report, and one without a vehicle; each report also in the next poll's file."""
    df = positions(spark, sf).withColumn("poll", F.explode(F.array(F.lit(0), F.lit(1))))
    name = F.concat(F.date_format(F.timestamp_seconds("locationtime"), "yyyy_MM_dd_HH"), F.lit("_"), F.col("poll").cast("string"))
    vehicle = F.struct(
        F.struct("trip_id").alias("trip"),
        F.struct(F.col("lat").cast("float").alias("latitude"), F.col("lon").cast("float").alias("longitude")).alias("position"),
        F.col("locationtime").alias("timestamp"), F.struct(F.col("vehicle_id").cast("string").alias("id")).alias("vehicle"))
    full = F.struct(F.col("vehicle_id").cast("string").alias("id"), vehicle.alias("vehicle"))
    empty = F.struct(F.lit("alert").alias("id"), F.when(F.lit(False), vehicle).alias("vehicle"))
    return df.select(name.alias("file"), F.array(full, empty).alias("entity"))


view("fed", """SELECT strftime(to_timestamp(locationtime) AT TIME ZONE 'UTC', '%Y_%m_%d_%H') || '_' || CAST(poll AS VARCHAR) AS file,
    CAST(vehicle_id AS VARCHAR) AS entity_id, trip_id, locationtime, CAST(lat AS FLOAT) AS lat, CAST(lon AS FLOAT) AS lon,
    CAST(vehicle_id AS VARCHAR) AS vehicle_id FROM pos CROSS JOIN (SELECT unnest([0, 1]) AS poll)""")


@query("feed_explode", "file entity_id trip_id locationtime lat lon vehicle_id", "SELECT * FROM fed")
def _(spark, sf):
    return fd.positions_from_feed(feed(spark, sf))


@query("daily_summary", "file trip_id locationtime lat lon vehicle_id",
       """SELECT DISTINCT file[1:10] AS file, trip_id, locationtime, lat, lon, vehicle_id FROM (SELECT * FROM fed
       WHERE starts_with(file, '2024_01_15') QUALIFY row_number() OVER (PARTITION BY file, entity_id
       ORDER BY locationtime DESC, trip_id DESC, lat DESC, lon DESC) = 1)""")
def _(spark, sf):
    return fd.summarize_positions(fd.positions_from_feed(feed(spark, sf)), date(2024, 1, 15))


@query("date_list", "feed_id service_day",
       """SELECT feed_id, unnest(range(0, CAST(n AS BIGINT))) ::INTEGER + d0 AS service_day FROM (SELECT feed_id, min(service_day) AS d0,
       count(DISTINCT service_day) + feed_id AS n FROM pos GROUP BY 1)""")
def _(spark, sf):
    spans = positions(spark, sf).groupBy("feed_id").agg(F.min("service_day").alias("d0"), F.count_distinct("service_day").alias("n"))
    return fd.service_days(spans.withColumn("n", F.col("n") + F.col("feed_id")), "d0", "n")


@query("new_files_only", "vehicle_id service_day",
       """SELECT DISTINCT vehicle_id, service_day FROM pos WHERE service_day BETWEEN DATE '2024-01-08' AND DATE '2024-01-21'
       AND (vehicle_id, service_day) NOT IN (SELECT vehicle_id, service_day FROM pos WHERE event_type = 'click')""")
def _(spark, sf):
    df = positions(spark, sf)
    offered = df.select("vehicle_id", "service_day").distinct()
    return fd.pending_days(offered, df.filter("event_type = 'click'"), date(2024, 1, 8), date(2024, 1, 21), "vehicle_id")


@query("nonempty_feed", "feed_id n_files",
       """SELECT feed_id, count(*) AS n_files FROM (SELECT DISTINCT feed_id, service_day FROM pos) LEFT JOIN (SELECT feed_id, service_day,
       count(*) AS n FROM pos WHERE event_type = 'view' AND speed_m_s > 1e1 GROUP BY ALL) USING (feed_id, service_day) GROUP BY 1
       HAVING min(coalesce(n, 0)) > 0""")
def _(spark, sf):
    df = positions(spark, sf)
    return fd.feeds_with_data(df.filter("event_type = 'view' AND speed_m_s > 1e1"), df, "feed_id", ["service_day"])


@query("sensor_scan", "sensor locationtime v~6",
       """SELECT 'location' AS sensor, locationtime + 2 AS locationtime, lon AS v FROM pos UNION ALL
       SELECT 'accelerometer', locationtime + 2, speed_m_s FROM pos UNION ALL
       SELECT 'orientation', locationtime + 2, degrees(speed_m_s / 1e2) FROM pos""")
def _(spark, sf):
    folder = shared_dir(spark, "sensors")
    df = positions(spark, sf).withColumn("time", F.expr("locationtime * 1000000000 + event_id % 1000"))
    df.selectExpr("time", "lon AS longitude", "lat AS latitude", "0e0 AS altitudeAboveMeanSeaLevel", "0e0 AS bearing", "speed_m_s AS speed") \
        .write.csv(f"{folder}/Location.csv", header=True)
    df.selectExpr("speed_m_s AS y", "time").write.csv(f"{folder}/Accelerometer.csv", header=True)
    df.selectExpr("time", "speed_m_s / 1e2 AS pitch").write.csv(f"{folder}/Orientation.csv", header=True)
    loc, acc, ori = sn.read_sensors(spark, folder, 2)
    parts = (("location", loc, "longitude"), ("accelerometer", acc, "y"), ("orientation", ori, "pitch"))
    out = [d.select(F.lit(n).alias("sensor"), "locationtime", F.col(c).alias("v")) for n, d, c in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("gnss_scan", "locationtime lat~6 lon~6 elev_m~3 ratio~3",
       """SELECT t - 18 AS locationtime, arg_min(lat, (ms, lat)) AS lat, arg_min(lon, (ms, lat)) AS lon, arg_min(speed_m_s, (ms, lat)) AS elev_m,
       arg_min(event_id, (ms, lat)) AS ratio FROM (SELECT *, locationtime // 7 * 7 AS t, event_id % 1000 AS ms FROM pos)
       WHERE t - 18 BETWEEN 1704400000 AND 1705800000 GROUP BY t""")
def _(spark, sf):
    folder = shared_dir(spark, "gnss")
    df = positions(spark, sf).withColumn("at", F.timestamp_seconds(F.expr("locationtime div 7 * 7")))
    line = F.concat_ws("   ", F.date_format("at", "yyyy/MM/dd"), F.concat(F.date_format("at", "HH:mm:ss"), F.lit("."),
                       F.lpad(F.expr("cast(event_id % 1000 as string)"), 3, "0")), "lat", "lon", "speed_m_s",
                       F.lit("1 8 0.1 0.1 0.1 0.0 0.0 0.0 0.5"), "event_id")
    df.select(line.alias("value")).write.text(folder)
    return sn.read_gnss(spark, folder, 1704400000, 1705800000)


@query("sink_features", "shingle_id calc_dist_m calc_time_s service_day",
       "SELECT shingle_id, calc_dist_m, calc_time_s, service_day FROM smp")
def _(spark, sf):
    folder = shared_dir(spark, "features")
    fd.write_features(samples(spark, sf).select("shingle_id", "calc_dist_m", "calc_time_s", "event_id", "service_day"), folder, files_per_day=2)
    return spark.read.parquet(folder)


@query("extract_operator", "event_id feed_id", "SELECT * FROM pos WHERE feed_id = 3")
def _(spark, sf):
    return fd.split_by_operator(positions(spark, sf), "feed_id", 3)


@query("restrict_area", "kind id other",
       """SELECT 'trip' AS kind, trip_id AS id, route_id AS other FROM trp WHERE trip_id IN (SELECT trip_id FROM tin) UNION ALL
       SELECT 'time', trip_id, stop_id FROM stt WHERE trip_id IN (SELECT trip_id FROM tin) UNION ALL
       SELECT 'stop', stop_id, NULL FROM stp WHERE stop_id IN (SELECT stop_id FROM stt WHERE trip_id IN (SELECT trip_id FROM tin))""")
def _(spark, sf):
    t, st, sp = fd.trips_in_area(trips(spark, sf), stop_times(spark, sf), stops(spark, sf), (-122.5, 47.4, -122.35, 47.6))
    return (t.selectExpr("'trip' AS kind", "trip_id AS id", "route_id AS other")
            .unionByName(st.selectExpr("'time' AS kind", "trip_id AS id", "stop_id AS other"))
            .unionByName(sp.selectExpr("'stop' AS kind", "stop_id AS id", "cast(null as string) AS other")))


view("tin", """SELECT DISTINCT trip_id FROM stt JOIN stp USING (stop_id) WHERE stop_lon BETWEEN -122.5e0 AND -122.35e0
    AND stop_lat BETWEEN 47.4e0 AND 47.6e0""")
