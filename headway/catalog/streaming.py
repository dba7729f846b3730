"""Streams over the events, replayed from files and read back from the sink."""

from pyspark.sql import functions as F

from headway.catalog.registry import query, view
from headway.catalog.roles import table
from headway.functions import geo
from headway.session import shared_dir
from headway.streaming import positions as st


def points(df):
    return df.selectExpr(
        "event_id", "cast(user_id as string) AS trip_id", "user_id % 40 AS vehicle_id", "cast(ts as timestamp) AS ts",
        "unix_seconds(cast(ts as timestamp)) AS locationtime",
        "-1.2255e2 + ((event_id * 7919) % 1000) * 5e-4 AS lon", "4.733e1 + ((event_id * 6367) % 1000) * 4.5e-4 AS lat",
        "((event_id * 7919) % 1000) * 3.75e1 AS x", "((event_id * 6367) % 1000) * 5e1 AS y", "value AS speed_m_s")


def replay(spark, sf, build, frames=None):
    """Run the stream over the events in one go, or over the given parts in turn, with one checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", st.ROCKS)
    # The number of state partitions is fixed when a stream first starts: one per core here.
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    try:
        return _replay(spark, sf, build, frames)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def _replay(spark, sf, build, frames):
    events = table(spark, sf, "events")
    out, mark = shared_dir(spark, "stream-out"), shared_dir(spark, "stream-mark")
    if frames is None:
        source = st.stream_positions(spark, sf, events.schema, "events.parquet")
        st.run_available(build(points(source)), out, mark)
    else:
        folder = shared_dir(spark, "stream-in")
        for part in frames:
            part.write.mode("append").parquet(folder)
            source = st.stream_positions(spark, folder, events.schema)
            st.run_available(build(points(source)), out, mark)
    return spark.read.parquet(out)


def halves(spark, sf, late=False):
    """The events in two deliveries, in time order or the later half first."""
    events = table(spark, sf, "events")
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    parts = [events.filter(F.col("ts") < cut), events.filter(F.col("ts") >= cut)]
    return parts[::-1] if late else parts


@query("st_positions", "event_id trip_id locationtime lon lat",
       "SELECT * FROM pos")
def _(spark, sf):
    return replay(spark, sf, lambda df: df, halves(spark, sf))


@query("st_dedup", "trip_id locationtime vehicle_id",
       "SELECT DISTINCT trip_id, locationtime, vehicle_id FROM pos")
def _(spark, sf):
    """Every report twice in its delivery, and those of the last 20 hours again in the next one."""
    def build(df):
        twice = df.withColumn("poll", F.explode(F.array(F.lit(0), F.lit(1)))).drop("poll")
        return st.stream_dedup(twice, ["trip_id", "vehicle_id", "locationtime"])
    first, second = halves(spark, sf)
    again = first.filter(F.col("ts") >= F.lit("2024-01-15 04:00:00").cast("timestamp_ntz"))
    return replay(spark, sf, build, [first, second.union(again)])


view("wm", "SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 DAY AS w FROM events")


@query("st_daily", "service_day vehicle_id n_points",
       """SELECT service_day, vehicle_id, count(*) AS n_points FROM pos GROUP BY ALL
       HAVING service_day + INTERVAL 1 DAY <= (SELECT w FROM wm)""")
def _(spark, sf):
    return replay(spark, sf, lambda df: st.stream_daily(df, ["vehicle_id"]), halves(spark, sf))


@query("st_late", "service_day n_points",
       """SELECT service_day, count(*) AS n_points FROM pos WHERE service_day >= DATE '2024-01-16'
       OR service_day + INTERVAL 1 DAY > (SELECT w FROM wm) GROUP BY 1 HAVING service_day + INTERVAL 1 DAY <= (SELECT w FROM wm)""")
def _(spark, sf):
    return replay(spark, sf, lambda df: st.stream_daily(df, []), halves(spark, sf, late=True))


BUCKET = 21600
LOST = "event_id % 50 = 7 AND ts < TIMESTAMP '2024-01-13 00:00:00'"
#: What a stream may have emitted: rows that were not too late, in buckets that the watermark has passed.
view("pos_in", f"SELECT * FROM cel WHERE event_id NOT IN (SELECT event_id FROM events WHERE {LOST})")
view("past_mark", f"SELECT event_id FROM pos_in WHERE (locationtime // {BUCKET} + 1) * {BUCKET} <= (SELECT epoch(w) FROM wm)")


def disordered(spark, sf):
    """The events in two deliveries: the second brings rows up to 20 hours older than the newest before it, in time, and some days older, too late."""
    events = table(spark, sf, "events")
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    soon = (F.col("ts") >= cut) & (F.col("ts") < cut + F.expr("INTERVAL 20 HOURS")) & (F.col("event_id") % 3 == 0)
    first = ((F.col("ts") < cut - F.expr("INTERVAL 2 HOURS")) & ~F.expr(LOST.replace("TIMESTAMP", "TIMESTAMP_NTZ"))) | soon
    return [events.filter(first), events.filter(~first)]


@query("st_steps", "event_id trip_id calc_dist_m~3 calc_time_s~3",
       """SELECT * FROM (SELECT event_id, trip_id, locationtime - lag(locationtime) OVER w AS calc_time_s,
         CASE WHEN lag(lon) OVER w IS NOT NULL THEN 2 * 6371000 * asin(sqrt(least(1e0, pow(sin(radians(lat - lag(lat) OVER w) / 2), 2)
           + cos(radians(lag(lat) OVER w)) * cos(radians(lat)) * pow(sin(radians(lon - lag(lon) OVER w) / 2), 2)))) END AS calc_dist_m
         FROM pos_in WINDOW w AS (PARTITION BY trip_id ORDER BY locationtime, event_id)) JOIN past_mark USING (event_id)""")
def _(spark, sf):
    return replay(spark, sf, lambda df: st.stream_step_metrics(df, keep_ms=60 * st.DAY_MS, bucket_s=BUCKET), disordered(spark, sf))


def binned(df):
    return df.withColumns({"xbin": geo.grid_bin("x", 0, 37500, 5000.0), "ybin": geo.grid_bin("y", 0, 50000, 5000.0)})


@query("st_recent_cell", "event_id xbin ybin recent",
       """SELECT q.event_id, any_value(q.xbin) AS xbin, any_value(q.ybin) AS ybin,
       coalesce(list(p.speed_m_s ORDER BY p.locationtime DESC, p.event_id DESC) FILTER (p.event_id IS NOT NULL), []) [1:4] AS recent
       FROM pos_in q JOIN past_mark USING (event_id) LEFT JOIN pos_in p ON q.xbin = p.xbin AND q.ybin = p.ybin AND p.locationtime < q.locationtime
       GROUP BY q.event_id""")
def _(spark, sf):
    return replay(spark, sf, lambda df: st.stream_recent_in_cell(binned(df), 4, keep_ms=60 * st.DAY_MS, bucket_s=BUCKET), disordered(spark, sf))


@query("st_cell_speed", "start xbin ybin speed~6 n",
       """SELECT * FROM (SELECT hour_of AS start, xbin, ybin, avg(speed_m_s) AS speed, count(*) AS n FROM (SELECT cel.*,
       TIMESTAMP '2024-01-01 00:00:00' + to_hours(locationtime // 3600 - 473352) AS hour_of FROM cel) GROUP BY 1, 2, 3)
       WHERE start + INTERVAL 1 HOUR <= (SELECT w FROM wm)""")
def _(spark, sf):
    return replay(spark, sf, lambda df: st.stream_cell_speed(binned(df), ["xbin", "ybin"], "speed_m_s", width="1 hour"))


@query("st_trip_sessions", "trip_id start finish n_points",
       """SELECT trip_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS finish, count(*) AS n_points FROM (
         SELECT *, sum(fresh) OVER (PARTITION BY trip_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (
           SELECT CAST(user_id AS VARCHAR) AS trip_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR
           THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY trip_id, s HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT w FROM wm)""")
def _(spark, sf):
    return replay(spark, sf, lambda df: st.stream_trip_sessions(df, ["trip_id"], "6 hours"))
