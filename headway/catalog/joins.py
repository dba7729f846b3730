"""Joins over whole tables: schedule, nearest, as-of, regions, sensors, blocks."""

from pyspark.sql import functions as F

from headway.catalog.registry import query, view
from headway.catalog.roles import positions, routes, scores, stop_times, stops, table, trips, versions
from headway.functions.scalar import archetype_of, is_tuned
from headway.operators import aggregates as a
from headway.operators import joins as j

view("sst", """SELECT trip_id, stop_id, arrival_time, CAST(sec AS BIGINT) AS t_sch_sec_of_day, stop_lon, stop_lat, stop_x, stop_y,
    row_number() OVER (PARTITION BY trip_id ORDER BY sec, stop_sequence, stop_id) - 1 AS stop_sequence
    FROM stt JOIN stp USING (stop_id)""")


@query("schedule_join", "trip_id stop_id stop_sequence t_sch_sec_of_day stop_lon stop_lat", "SELECT * FROM sst")
def _(spark, sf):
    return j.scheduled_stops(stop_times(spark, sf), stops(spark, sf))


@query("shapes_lookup", "service_id route_id trip_id",
       "SELECT DISTINCT service_id, route_id, trip_id FROM trp JOIN rou USING (route_id)")
def _(spark, sf):
    return j.trip_route_lookup(trips(spark, sf), routes(spark, sf))


view("near", """SELECT p.*, s.stop_id, s.stop_sequence, s.calc_stop_dist_m FROM pos p LEFT JOIN (
      SELECT event_id, stop_id, stop_sequence, calc_stop_dist_m FROM (
        SELECT q.event_id, t.stop_id, t.stop_sequence,
        sqrt((q.x - t.stop_x) * (q.x - t.stop_x) + (q.y - t.stop_y) * (q.y - t.stop_y)) AS calc_stop_dist_m
        FROM pos q JOIN sst t ON q.trip_id = t.trip_id)
      QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY calc_stop_dist_m, stop_sequence, stop_id) = 1) s
    USING (event_id)""")


def nearest(spark, sf):
    points = positions(spark, sf)
    static = j.scheduled_stops(stop_times(spark, sf), stops(spark, sf), points=points)
    return j.nearest_by_key(points, static, "trip_id"), static


@query("nearest_stop", "event_id trip_id stop_id stop_sequence calc_stop_dist_m~4", "SELECT * FROM near")
def _(spark, sf):
    return nearest(spark, sf)[0]


@query("nearest_shape_point", "event_id shape_id seq_id calc_stop_dist_m~4",
       """SELECT event_id, shape_id, seq_id, calc_stop_dist_m FROM (SELECT q.event_id, q.feed_id AS shape_id, t.seq_id,
         sqrt((q.x - t.px) * (q.x - t.px) + (q.y - t.py) * (q.y - t.py)) AS calc_stop_dist_m
         FROM pos q JOIN (SELECT p_partkey % 8 AS shape_id, p_partkey AS seq_id, (p_partkey * 7919) % 1000 * 3.75e1 AS px,
           (p_partkey * 6367) % 997 * 5e1 AS py FROM part) t ON q.feed_id = t.shape_id)
       QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY calc_stop_dist_m, seq_id) = 1""")
def _(spark, sf):
    shape = table(spark, sf, "part").selectExpr(
        "p_partkey % 8 AS shape_id", "p_partkey AS seq_id", "(p_partkey * 7919) % 1000 * 3.75e1 AS px",
        "(p_partkey * 6367) % 997 * 5e1 AS py").withColumn("point_id", F.col("seq_id"))
    seen = positions(spark, sf).withColumnRenamed("feed_id", "shape_id")
    return j.nearest_by_key(seen, shape, "shape_id", "point_id", "seq_id", place_xy=("px", "py"))


@query("schedule_attach", "event_id stop_id arrival_time t_sch_sec_of_day route_id service_id",
       """SELECT n.*, s.arrival_time, s.t_sch_sec_of_day, t.route_id, t.service_id FROM near n
       LEFT JOIN sst s ON n.trip_id = s.trip_id AND n.stop_id = s.stop_id AND n.stop_sequence = s.stop_sequence
       LEFT JOIN trp t ON n.trip_id = t.trip_id""")
def _(spark, sf):
    points, static = nearest(spark, sf)
    return j.attach_schedule(points, static, j.of_trips(trips(spark, sf), positions(spark, sf)))


def two_feeds(spark, sf):
    """Two feeds that share trip ids, each with two versions of its schedule: points, stop times, trips and versions."""
    points = positions(spark, sf).drop("feed_id").selectExpr("*", "event_id % 2 AS feed_id")
    kinds = "explode(array(0, 1)) AS feed_id"
    days = table(spark, sf, "region").filter("r_regionkey < 4").selectExpr(
        "r_regionkey % 2 AS feed_id", "r_regionkey div 2 AS edition",
        "date_add(date'2024-01-05', cast(r_regionkey % 2 * 4 + r_regionkey div 2 * 11 as int)) AS version")
    sec = "18000 + l_linenumber * 900 + (l_partkey % 60) * 10 + (l_orderkey % 24) * 3600 + feed_id * 60 + edition * 600"
    times = table(spark, sf, "lineitem").selectExpr("*", kinds).join(F.broadcast(days), "feed_id").selectExpr(
        "feed_id", "version", "cast(l_orderkey as string) AS trip_id", "cast((l_suppkey + 3 * feed_id + 5 * edition) % 10 + 1 as string) AS stop_id",
        "l_linenumber AS stop_sequence", f"{sec} AS sec").selectExpr(
        "* except (sec)", "concat_ws(':', lpad(cast(sec div 3600 as string), 2, '0'), lpad(cast(sec div 60 % 60 as string), 2, '0'), "
        "lpad(cast(sec % 60 as string), 2, '0')) AS arrival_time")
    runs = trips(spark, sf).selectExpr("trip_id", "route_id", "service_id", kinds).join(F.broadcast(days), "feed_id").selectExpr(
        "feed_id", "version", "trip_id", "concat(route_id, '-', cast(edition as string)) AS route_id", "concat(service_id, '-', cast(feed_id as string)) AS service_id")
    return points, times, runs, days.select("feed_id", "version")


view("v2", """SELECT r_regionkey % 2 AS feed_id, r_regionkey // 2 AS edition, DATE '2024-01-05' + CAST(r_regionkey % 2 * 4 + r_regionkey // 2 * 11 AS INTEGER) AS version
    FROM region WHERE r_regionkey < 4""")
view("pos2", "SELECT * REPLACE (event_id % 2 AS feed_id) FROM pos")
view("day2", """SELECT feed_id, service_day, coalesce(max(version) FILTER (version < service_day), min(version)) AS version
    FROM (SELECT DISTINCT feed_id, service_day FROM pos2) JOIN v2 USING (feed_id) GROUP BY ALL""")
view("sst2v", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feed_id, version, trip_id ORDER BY sec, seq, stop_id) - 1 AS stop_sequence FROM (
    SELECT feed_id, version, CAST(l_orderkey AS VARCHAR) AS trip_id, CAST((l_suppkey + 3 * feed_id + 5 * edition) % 10 + 1 AS VARCHAR) AS stop_id, l_linenumber AS seq,
    18000 + l_linenumber * 900 + (l_partkey % 60) * 10 + (l_orderkey % 24) * 3600 + feed_id * 60 + edition * 600 AS sec FROM lineitem, v2)) JOIN stp USING (stop_id)""")


@query("schedule_in_force", "event_id feed_id version stop_id stop_sequence t_sch_sec_of_day calc_stop_dist_m~4 route_id service_id",
       """SELECT p.event_id, p.feed_id, d.version, n.stop_id, n.stop_sequence, CAST(n.sec AS BIGINT) AS t_sch_sec_of_day, n.calc_stop_dist_m,
       CASE WHEN t.trip_id IS NOT NULL THEN t.route_id || '-' || CAST(t.edition AS VARCHAR) END AS route_id,
       CASE WHEN t.trip_id IS NOT NULL THEN t.service_id || '-' || CAST(t.feed_id AS VARCHAR) END AS service_id
       FROM pos2 p JOIN day2 d USING (feed_id, service_day) LEFT JOIN (
         SELECT event_id, stop_id, stop_sequence, sec, sqrt((x - stop_x) * (x - stop_x) + (y - stop_y) * (y - stop_y)) AS calc_stop_dist_m
         FROM pos2 JOIN day2 USING (feed_id, service_day) JOIN sst2v USING (feed_id, version, trip_id)
         QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY calc_stop_dist_m, stop_sequence, stop_id) = 1) n USING (event_id)
       LEFT JOIN (SELECT * FROM trp, v2) t ON t.feed_id = p.feed_id AND t.version = d.version AND t.trip_id = p.trip_id""")
def _(spark, sf):
    points, times, runs, days = two_feeds(spark, sf)
    return j.attach_schedule_in_force(points, times, stops(spark, sf), runs, days, ["feed_id"])


@query("asof_static", "feed_id service_day version",
       """SELECT feed_id, service_day, coalesce(max(version) FILTER (version < service_day), min(version)) AS version
       FROM (SELECT DISTINCT feed_id, service_day FROM pos) JOIN ver USING (feed_id) GROUP BY ALL""")
def _(spark, sf):
    return j.latest_before(positions(spark, sf), versions(spark, sf), ["feed_id"])


HEX = """CAST(CASE WHEN abs(rq - q) > abs(rr - r) AND abs(rq - q) > abs(rs - s) THEN -rr - rs ELSE rq END AS BIGINT) AS hex_q,
    CAST(CASE WHEN NOT (abs(rq - q) > abs(rr - r) AND abs(rq - q) > abs(rs - s)) AND abs(rr - r) > abs(rs - s)
    THEN -rq - rs ELSE rr END AS BIGINT) AS hex_r"""


def hex_sql(source: str, x: str, y: str, size: str) -> str:
    return f"""SELECT *, CAST(hex_q AS VARCHAR) || ':' || CAST(hex_r AS VARCHAR) AS region_id FROM (SELECT *, {HEX} FROM (
      SELECT *, floor(q + 5e-1) AS rq, floor(r + 5e-1) AS rr, floor(s + 5e-1) AS rs FROM (SELECT *, -q - r AS s FROM (
        SELECT *, ({x} * (sqrt(3e0) / 3e0) - {y} * (1e0 / 3e0)) / {size} AS q, {y} * (2e0 / 3e0) / {size} AS r
        FROM {source}))))"""


view("hexed", hex_sql("pos", "x", "y", "1e3"))
view("hexstop", hex_sql("stp", "stop_x", "stop_y", "4e3"))


@query("region_join", "event_id hex_q hex_r region_id", "SELECT * FROM hexed")
def _(spark, sf):
    return j.assign_hex(positions(spark, sf), "x", "y", 1000.0)


@query("region_embeddings", "event_id vec_id e0_osm_embed e1_osm_embed e31_osm_embed e63_osm_embed osm_embed_missing",
       """SELECT p.event_id, p.vec_id, v.embedding[1] AS e0_osm_embed, v.embedding[2] AS e1_osm_embed,
       v.embedding[32] AS e31_osm_embed, v.embedding[64] AS e63_osm_embed, v.vec_id IS NULL AS osm_embed_missing
       FROM (SELECT *, (hex_q + 50) * 29 + hex_r AS vec_id FROM hexed) p LEFT JOIN embeddings v USING (vec_id)""")
def _(spark, sf):
    pts = j.assign_hex(positions(spark, sf), "x", "y", 1000.0).withColumn("vec_id", F.expr("(hex_q + 50) * 29 + hex_r"))
    out = j.attach_vectors(pts, table(spark, sf, "embeddings"), "vec_id", "embedding", "osm_embed", 64)
    return out.withColumnsRenamed({f"{i}_osm_embed": f"e{i}_osm_embed" for i in (0, 1, 31, 63)})


@query("hex_cover", "feed_id hex_q hex_r region_id neighbours",
       """SELECT feed_id, hex_q, hex_r, hex_q || ':' || hex_r AS region_id,
       [(hex_q + 1) || ':' || hex_r, (hex_q + 1) || ':' || (hex_r - 1), hex_q || ':' || (hex_r - 1),
        (hex_q - 1) || ':' || hex_r, (hex_q - 1) || ':' || (hex_r + 1), hex_q || ':' || (hex_r + 1)] AS neighbours
       FROM (SELECT *, unnest(range(CAST(floor(min_x / (sqrt(3e0) * 2e3) - hex_r / 2e0 - 1) AS BIGINT),
           CAST(ceil(max_x / (sqrt(3e0) * 2e3) - hex_r / 2e0 + 1) AS BIGINT) + 1)) AS hex_q
         FROM (SELECT *, unnest(range(CAST(floor((min_y - 2e3) / 3e3) AS BIGINT), CAST(ceil((max_y + 2e3) / 3e3) AS BIGINT) + 1))
           AS hex_r FROM (SELECT feed_id, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y
             FROM pos GROUP BY 1)))
       WHERE (sqrt(3e0) * 2e3) * (hex_q + hex_r / 2e0) BETWEEN min_x - (sqrt(3e0) * 2e3) / 2e0 AND max_x + (sqrt(3e0) * 2e3) / 2e0
         AND 3e3 * hex_r BETWEEN min_y - 2e3 AND max_y + 2e3""")
def _(spark, sf):
    bounds = positions(spark, sf).groupBy("feed_id").agg(
        F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))
    return j.cover_box(bounds, ["feed_id"], 2000.0)


HOURS = [f"{c}_{h}" for c in ("trips", "directions") for h in range(24)]


@query("region_service", "region_id " + " ".join(HOURS),
       "SELECT region_id, " + ", ".join(
           f"count(DISTINCT {col}) FILTER (hour = {h}) AS {name}_{h}"
           for name, col in (("trips", "trip_id"), ("directions", "direction_id")) for h in range(24))
       + """ FROM (SELECT region_id, sec // 3600 % 24 AS hour, trip_id, CAST(trip_id AS BIGINT) % 2 AS direction_id
       FROM stt JOIN hexstop USING (stop_id)) GROUP BY 1""")
def _(spark, sf):
    times = stop_times(spark, sf).withColumn("direction_id", F.col("trip_id").cast("long") % 2)
    return j.region_hourly_service(times, stops(spark, sf), 4000.0)


view("sen", """SELECT feed_id AS device, locationtime // 3600 AS t, event_type, lon, lat, speed_m_s FROM pos""")


@query("sensor_merge", "device locationtime lon~6 lat~6 acc~6 pitch~6",
       """SELECT device, t AS locationtime, lon, lat, """ + ", ".join(
           f"""coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY device ORDER BY t ROWS UNBOUNDED PRECEDING),
           first_value({c} IGNORE NULLS) OVER (PARTITION BY device ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
           AS {c}""" for c in ("acc", "pitch"))
       + """ FROM (SELECT device, t, avg(lon) AS lon, avg(lat) AS lat FROM sen WHERE event_type IN ('view', 'signup', 'purchase')
         GROUP BY ALL)
       LEFT JOIN (SELECT device, t, avg(speed_m_s) AS acc FROM sen WHERE event_type = 'click' GROUP BY ALL) USING (device, t)
       LEFT JOIN (SELECT device, t, avg(speed_m_s / 1e2) AS pitch FROM sen WHERE event_type = 'error' GROUP BY ALL)
       USING (device, t)""")
def _(spark, sf):
    raw = positions(spark, sf).selectExpr(
        "feed_id AS device", "locationtime div 3600 AS locationtime", "event_type", "lon", "lat", "speed_m_s")
    loc = raw.filter("event_type IN ('view', 'signup', 'purchase')").select("device", "locationtime", "lon", "lat")
    acc = raw.filter("event_type = 'click'").selectExpr("device", "locationtime", "speed_m_s AS acc")
    ori = raw.filter("event_type = 'error'").selectExpr("device", "locationtime", "speed_m_s / 1e2 AS pitch")
    return j.merge_sensors(loc, acc, ori, ["device"])


@query("raster_join", "event_id elev_m~2",
       """SELECT event_id, z AS elev_m FROM pos LEFT JOIN (SELECT p_partkey % 50 AS col, p_partkey // 50 AS rw,
       p_retailprice AS z FROM part) ON CAST(floor(x / 750e0) AS BIGINT) = col
       AND CAST(floor((y - 50000e0) / -1250e0) AS BIGINT) = rw""")
def _(spark, sf):
    raster = table(spark, sf, "part").selectExpr("p_partkey % 50 AS col", "p_partkey div 50 AS row", "p_retailprice AS z")
    return j.sample_raster(positions(spark, sf), raster, "x", "y", 0.0, 50000.0, 750.0, -1250.0)


@query("depot_join", "block_id depot_id depot_x depot_y",
       """SELECT DISTINCT block_id, block_id % 30 AS depot_id, n_nationkey * 1.5e3 AS depot_x, n_regionkey * 9e3 AS depot_y
       FROM trp JOIN nation ON block_id % 30 = n_nationkey""")
def _(spark, sf):
    depots = table(spark, sf, "nation").selectExpr(
        "cast(n_nationkey as bigint) AS depot_id", "n_nationkey * 1.5e3 AS depot_x", "n_regionkey * 9e3 AS depot_y")
    blocks = trips(spark, sf).select("block_id", F.expr("block_id % 30 AS depot_id")).distinct()
    return j.attach_depots(blocks, depots)


@query("block_join", "trip_id block_id trip_dist_m block_dist_m",
       """SELECT trip_id, block_id, trip_dist_m, CAST(sum(trip_dist_m) OVER (PARTITION BY block_id) AS BIGINT) AS block_dist_m
       FROM trp""")
def _(spark, sf):
    t = trips(spark, sf)
    return j.attach_block_summary(t, t.groupBy("block_id").agg(F.sum("trip_dist_m").alias("block_dist_m")))


view("rep", "SELECT service_day, vehicle_id, event_type AS metric, avg(speed_m_s) AS value FROM pos GROUP BY ALL")
view("vbl", """SELECT r.*, l.service_id, l.block_id FROM rep r JOIN (SELECT DISTINCT service_day, vehicle_id, service_id, block_id
    FROM pos JOIN trp USING (trip_id)) l USING (service_day, vehicle_id) WHERE NOT starts_with(CAST(vehicle_id AS VARCHAR), '3')""")
view("mod", """SELECT block_id, sum(trip_dist_m) / 1000 / 1.609e0 AS block_dist_mi,
    sum(trip_dist_m * consumption_kwh_mi) / 1000 / 1.609e0 AS block_net_energy_kwh FROM trp GROUP BY 1""")


def reports(spark, sf):
    df = positions(spark, sf).withColumnRenamed("event_type", "metric")
    return a.vehicle_day_metrics(df, "service_day", "vehicle_id", value="speed_m_s")


def actual(spark, sf):
    return j.vehicle_blocks(positions(spark, sf), trips(spark, sf), reports(spark, sf), "service_day", "vehicle_id", "3")


@query("report_daily", "service_day vehicle_id metric value~6", "SELECT * FROM rep")
def _(spark, sf):
    return reports(spark, sf)


@query("vehicle_block_lookup", "service_day vehicle_id metric value~6 service_id block_id", "SELECT * FROM vbl")
def _(spark, sf):
    return actual(spark, sf)


KINDS = ["click", "error", "purchase", "signup", "view"]


@query("modeled_vs_actual", "block_id block_dist_mi~6 block_net_energy_kwh~4 " + " ".join(f"{k}~8" for k in KINDS),
       "SELECT block_id, block_dist_mi, block_net_energy_kwh, " + ", ".join(
           f"avg(value) FILTER (metric = '{k}') AS {k}" for k in KINDS)
       + " FROM vbl JOIN mod USING (block_id) GROUP BY ALL")
def _(spark, sf):
    modeled = trips(spark, sf).groupBy("block_id").agg(
        (F.sum("trip_dist_m") / 1000 / 1.609).alias("block_dist_mi"),
        (F.sum(F.col("trip_dist_m") * F.col("consumption_kwh_mi")) / 1000 / 1.609).alias("block_net_energy_kwh"))
    return j.compare_blocks(actual(spark, sf), modeled, KINDS)


@query("modeled_vs_actual_std", "metric mean_std~6",
       """SELECT metric, avg(s) AS mean_std FROM (SELECT block_id, metric, stddev_samp(value) AS s FROM vbl GROUP BY ALL)
       GROUP BY 1""")
def _(spark, sf):
    return j.mean_block_std(actual(spark, sf))


@query("tuned_vs_base", "run model fold value_tune~6 value_notune~6 net_improvement~4",
       """SELECT *, (value_tune - value_notune) * 100 AS net_improvement FROM (
         SELECT run, replace(model, '_TUNED', '') AS model, fold, avg(v) FILTER (ends_with(model, '_TUNED')) AS value_tune,
         avg(v) FILTER (NOT ends_with(model, '_TUNED')) AS value_notune FROM (
           SELECT run, model, fold, avg(abs(labels - preds) / abs(labels)) AS v FROM sco WHERE experiment_name = 'diff_city'
           GROUP BY ALL) GROUP BY ALL) WHERE value_tune IS NOT NULL AND value_notune IS NOT NULL""")
def _(spark, sf):
    by = ["run", "model", "experiment_name", "fold"]
    res = a.format_results(scores(spark, sf).filter("experiment_name = 'diff_city'"), by).filter("metric = 'mape'")
    res = res.withColumn("is_tuned", is_tuned("model")).withColumn("model", F.regexp_replace("model", "_TUNED$", ""))
    return j.net_improvement(res)


@query("cost_ratio", "mode cost~2 distance~2 cost_per_km~6",
       """SELECT mode, cost, distance, cost / distance AS cost_per_km FROM
       (SELECT l_returnflag AS mode, sum(l_extendedprice) AS cost FROM lineitem GROUP BY 1)
       JOIN (SELECT l_returnflag AS mode, sum(l_quantity) * 1e2 AS distance FROM lineitem GROUP BY 1) USING (mode)""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "mode")
    cost = li.groupBy("mode").agg(F.sum("l_extendedprice").alias("cost"))
    km = li.groupBy("mode").agg((F.sum("l_quantity") * 100).alias("distance"))
    return j.ratio_join(cost, km, "mode", "cost", "distance", "cost_per_km")
