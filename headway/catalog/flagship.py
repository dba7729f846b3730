"""Whole pipelines over the driver's tables."""

from pyspark.sql import functions as F

from headway import ordered as o
from headway.catalog.energy import cycles
from headway.catalog.registry import query, view
from headway.catalog.roles import positions, stop_times, stops, table, trips
from headway.operators import aggregates as a
from headway.operators import filters as f
from headway.operators import tracks as tr
from headway.plans.fleet import sensitivity
from headway.plans.track_features import Settings, track_features
from headway.plans.travel_time import evaluate_baselines

KEY, ORDER = ["shingle_id"], ["locationtime", "event_id"]

view("fl0", """SELECT *, trip_id || '_' || CAST(locationtime // 432000 AS VARCHAR) AS shingle_id,
    (locationtime // 3600) % 24 AS t_hour, event_id % 3 AS passed_stops_n, (event_id * 13) % 3600 * 1e0 AS sch_time_s FROM pos""")
view("fl1", """SELECT *, 12742e3 * asin(sqrt(pow(sin(radians(lat - lat0) / 2e0), 2)
    + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lon - lon0) / 2e0), 2))) AS calc_dist_m, locationtime - t0 AS calc_time_s
    FROM (SELECT *, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0, lag(locationtime) OVER w AS t0 FROM fl0
      WINDOW w AS (PARTITION BY shingle_id ORDER BY locationtime, event_id)) WHERE t0 IS NOT NULL""")
view("fl2", """SELECT *, CASE WHEN calc_time_s <> 0 THEN calc_dist_m / calc_time_s END AS v FROM fl1
    QUALIFY count(*) OVER (PARTITION BY shingle_id) >= 3 AND max(calc_dist_m) OVER (PARTITION BY shingle_id) <= 45000""")
view("fl3", """SELECT *, ct - min(ct) OVER (PARTITION BY shingle_id) AS cumul_time_s FROM (SELECT *,
    sum(calc_dist_m / 1e3) OVER w * 1000 AS cumul_dist_m, sum(calc_time_s) OVER w AS ct FROM fl2
    WINDOW w AS (PARTITION BY shingle_id ORDER BY locationtime, event_id ROWS UNBOUNDED PRECEDING))""")
view("fl4", """SELECT *, CAST('0x' || substr(md5(shingle_id || '|42'), 1, 12) AS BIGINT) % 5 AS fold FROM (SELECT shingle_id, avg(v) AS ms,
    arg_min(t_hour, (locationtime, event_id)) AS h, arg_max(cumul_dist_m, (locationtime, event_id)) AS d,
    CAST(arg_max(cumul_time_s, (locationtime, event_id)) AS DOUBLE) AS labels, arg_max(sch_time_s, (locationtime, event_id)) AS sch,
    count(*) AS n FROM fl3 GROUP BY 1)""")
view("fl5", """SELECT fold, 'AVG' AS model, labels, d / coalesce((tot - own) / nullif(tn - n, 0), 6e0) AS preds FROM (SELECT s.*, q.own, q.tot, q.n AS on_, q.tn
      FROM fl4 s JOIN (SELECT h, fold, own, n, sum(own) OVER (PARTITION BY h) AS tot, sum(n) OVER (PARTITION BY h) AS tn FROM (
        SELECT h, fold, sum(ms) AS own, count(ms) AS n FROM fl4 GROUP BY ALL)) q USING (h, fold)) t(shingle_id, ms, h, d, labels, sch, np, fold, own, tot, n, tn)
    UNION ALL SELECT fold, 'SCH', labels, sch FROM fl4 UNION ALL SELECT fold, 'PER', labels, (n - 1) * 3e1 FROM fl4""")
view("fl6", """SELECT *, sqrt(mse) AS rmse, 1 - vm / vl AS ex_var, 1 - mse / vl AS r_score FROM (SELECT model, CAST(fold AS INTEGER) AS fold,
    min(labels) AS label_min, max(labels) AS label_max, avg(labels) AS label_mean, min(preds) AS pred_min, max(preds) AS pred_max,
    avg(preds) AS pred_mean, avg(abs(labels - preds)) AS mae, avg((labels - preds) * (labels - preds)) AS mse,
    avg(abs(labels - preds) / greatest(abs(labels), 2.220446049250313e-16)) AS mape, var_pop(labels - preds) AS vm,
    var_pop(labels) AS vl FROM fl5 GROUP BY ALL)""")


@query("flagship_travel_time", "model fold metric value~3",
       " UNION ALL ".join(f"SELECT model, fold, '{m}' AS metric, {m} AS value FROM fl6" for m in a.METRICS))
def _(spark, sf):
    df = positions(spark, sf).selectExpr(
        "*", "concat(trip_id, '_', cast(locationtime div 432000 as string)) AS shingle_id", "(locationtime div 3600) % 24 AS t_hour",
        "event_id % 3 AS passed_stops_n", "(event_id * 13) % 3600 * 1e0 AS sch_time_s")
    df, done = o.shared_split(df, KEY, ORDER[0])
    df = tr.step_speed(tr.step_metrics(df, KEY, ORDER, method="haversine"), KEY, ORDER)
    df = o.ordered(df, KEY, ORDER, _n=o.group_count(), _far=o.group_max("calc_dist_m"))
    df = df.filter("_n >= 3 AND _far <= 45000")
    df = done(tr.cumulative_features(df, KEY, ORDER))
    return evaluate_baselines(df, "shingle_id", ORDER)


@query("flagship_track_features", "shingle_id point_no locationtime~3 calc_dist_m~2 calc_speed_m_s~5 cumul_dist_m~1 cumul_time_s~3 stop_id "
       "calc_stop_dist_m~2 sch_time_s passed_stops_n t_hour t_day_of_week region_id recent osm_embed_missing")
def _(spark, sf):
    pts = positions(spark, sf).drop("x", "y", "service_day")
    settings = Settings(
        step_m=2500.0, point_ranges={"calc_dist_m": (0, 10_000), "calc_time_s": (0, 864_000), "elev_m": (-400, 20_000)},
        hex_size_m=2000.0, grid_m=5000.0)
    raster = table(spark, sf, "part").selectExpr("p_partkey % 50 AS col", "p_partkey div 50 AS row", "p_retailprice AS z")
    places = stops(spark, sf).drop("stop_x", "stop_y")
    from headway.functions import geo
    places = geo.project(places, "stop_lon", "stop_lat", 32610, "stop_x", "stop_y")
    return track_features(
        pts, stop_times(spark, sf), places, trips(spark, sf), raster, (530000.0, 5300000.0, 2500.0, -2500.0),
        table(spark, sf, "embeddings"), F.expr("pmod(hex_q * 31 + hex_r, 600)"), settings)


@query("flagship_sensitivity", "file network_id metric value~3 sensitivity_parameter")
def _(spark, sf):
    return sensitivity(trips(spark, sf), cycles(spark, sf))
