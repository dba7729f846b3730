"""Scalar expressions over whole tables."""

from pyspark.sql import functions as F

from headway.catalog.registry import query, view
from headway.catalog.roles import positions, samples, scores, stop_times, table, trips
from headway.catalog.windows import cumulated
from headway.functions import clock, geo
from headway.functions import scalar as s
from headway.functions.sql import register
from headway.operators import baselines as bl
from headway.operators import filters as f
from headway.operators import tracks as tr
from headway.operators import trajectory as tj

HAV = "12742e0 * asin(sqrt(pow(sin(radians({b2} - {b1}) / 2e0), 2) + cos(radians({b1})) * cos(radians({b2})) * pow(sin(radians({a2} - {a1}) / 2e0), 2)))"


@query("haversine_km", "event_id km~6 km_sql~6",
       f"SELECT event_id, {HAV.format(a1='lon', b1='lat', a2='-122.3e0', b2='47.6e0')} AS km, km AS km_sql FROM pos")
def _(spark, sf):
    register(spark)
    return positions(spark, sf).select(
        "event_id", geo.haversine_km("lon", "lat", F.lit(-122.3), F.lit(47.6)).alias("km"),
        F.expr("haversine_km(lon, lat, -122.3e0, 47.6e0)").alias("km_sql"))


def vincenty_sql(source: str = "pos", lon0: str = "-122.3e0", lat0: str = "47.6e0") -> str:
    """Vincenty's inverse method from a point or a point's columns, the longitude iteration unrolled."""
    f, a = "(1e0 / 298.257223563e0)", "6378137e0"
    sql = f"""SELECT event_id, radians(lon - {lon0}) AS dl, radians(lon - {lon0}) AS lam, atan((1 - {f}) * tan(radians({lat0}))) AS u1,
        atan((1 - {f}) * tan(radians(lat))) AS u2 FROM {source}"""
    for _ in range(6):
        sql = f"""SELECT *, sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss,
            sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM ({sql})"""
        sql = f"SELECT *, CASE WHEN ss = 0 THEN 0e0 ELSE cos(u1) * cos(u2) * sin(lam) / ss END AS sa, atan2(ss, cs) AS sig FROM ({sql})"
        sql = f"SELECT *, 1 - sa * sa AS ca FROM ({sql})"
        sql = f"""SELECT *, CASE WHEN ca < 1e-15 THEN 0e0 ELSE cs - 2 * sin(u1) * sin(u2) / ca END AS cm,
            {f} / 16 * ca * (4 + {f} * (4 - 3 * ca)) AS cc FROM ({sql})"""
        keep = "event_id, dl, u1, u2, ss, cs, sig, ca, cm, sin(lam) AS sl, cos(lam) AS cl"
        sql = f"""SELECT {keep}, dl + (1 - cc) * {f} * sa * (sig + cc * ss * (cm + cc * cs * (-1 + 2 * cm * cm))) AS lam FROM ({sql})"""
        last, sql = sql, f"SELECT event_id, dl, u1, u2, lam FROM ({sql})"
    sql = f"""SELECT *, degrees(atan2(cos(u2) * sl, cos(u1) * sin(u2) - sin(u1) * cos(u2) * cl)) AS bear_d,
        ca * (1 / pow(1 - {f}, 2) - 1) AS usq FROM ({last})"""
    sql = f"""SELECT *, 1 + usq / 16384 * (4096 + usq * (-768 + usq * (320 - 175 * usq))) AS aa,
        usq / 1024 * (256 + usq * (-128 + usq * (74 - 47 * usq))) AS bb FROM ({sql})"""
    return f"""SELECT event_id, bear_d, {a} * (1 - {f}) * aa * (sig - bb * ss * (cm + bb / 4 * (cs * (-1 + 2 * cm * cm)
        - bb / 6 * cm * (-3 + 4 * ss * ss) * (-3 + 4 * cm * cm)))) AS dist_m FROM ({sql})"""


@query("geodesic_inv", "event_id dist_m~3 bear_d~6", vincenty_sql())
def _(spark, sf):
    df = positions(spark, sf).withColumns({"lon0": F.lit(-122.3), "lat0": F.lit(47.6)})
    return geo.geodesic(df, "lon0", "lat0", "lon", "lat")


@query("manhattan", "trip_id dist~3", "SELECT trip_id, abs(start_x - end_x) + abs(start_y - end_y) AS dist FROM trp")
def _(spark, sf):
    return trips(spark, sf).withColumn("dist", geo.manhattan("start_x", "start_y", "end_x", "end_y"))


view("box", """SELECT feed_id, min(lon) AS x0, min(lat) AS y0, max(lon) AS x1, max(lat) AS y1 FROM pos GROUP BY 1""")


def boxes(spark, sf):
    return positions(spark, sf).groupBy("feed_id").agg(
        F.min("lon").alias("x0"), F.min("lat").alias("y0"), F.max("lon").alias("x1"), F.max("lat").alias("y1"))


@query("bbox_area", "feed_id area~4",
       f"SELECT feed_id, ({HAV.format(a1='x0', b1='y0', a2='x1', b2='y0')}) * ({HAV.format(a1='x0', b1='y0', a2='x0', b2='y1')}) AS area FROM box")
def _(spark, sf):
    return boxes(spark, sf).withColumn("area", geo.bbox_area_km2("x0", "y0", "x1", "y1"))


def utm_sql() -> str:
    """Krüger series to fourth order for zone 10 north."""
    n = "(1e0 / 298.257223563e0 / (2e0 - 1e0 / 298.257223563e0))"
    a = [f"({n} / 2 - 2 * pow({n}, 2) / 3 + 5 * pow({n}, 3) / 16 + 41 * pow({n}, 4) / 180 - 127 * pow({n}, 5) / 288)",
         f"(13 * pow({n}, 2) / 48 - 3 * pow({n}, 3) / 5 + 557 * pow({n}, 4) / 1440 + 281 * pow({n}, 5) / 630)",
         f"(61 * pow({n}, 3) / 240 - 103 * pow({n}, 4) / 140 + 15061 * pow({n}, 5) / 26880)",
         f"(49561 * pow({n}, 4) / 161280 - 179 * pow({n}, 5) / 168)"]
    scale = f"(9996e-4 * 6378137e0 / (1 + {n}) * (1 + pow({n}, 2) / 4 + pow({n}, 4) / 64))"
    k = f"(2 * sqrt({n}) / (1 + {n}))"
    e = " + ".join(["eta"] + [f"{c} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, c in enumerate(a, 1)])
    no = " + ".join(["xi"] + [f"{c} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, c in enumerate(a, 1)])
    ecc = "sqrt(1e0 / 298.257222101e0 * (2 - 1e0 / 298.257222101e0))"
    m = lambda p: f"(cos({p}) / sqrt(1 - pow({ecc} * sin({p}), 2)))"
    t = lambda p: f"(tan(pi() / 4 - ({p}) / 2) / pow((1 - {ecc} * sin({p})) / (1 + {ecc} * sin({p})), {ecc} / 2))"
    p1, p2, p0 = "radians(47.5e0)", "radians(48 + 44 / 60e0)", "radians(47e0)"
    cone = f"((ln{m(p1)} - ln{m(p2)}) / (ln{t(p1)} - ln{t(p2)}))"
    return f"""SELECT event_id, 5e5 + {scale} * ({e}) AS x, {scale} * ({no}) AS y, 5e5 + rho * sin(th) AS cx, rho0 - rho * cos(th) AS cy
      FROM (SELECT *, atan2(tt, cos(l)) AS xi, atanh(sin(l) / sqrt(1 + tt * tt)) AS eta, 6378137e0 * g * pow({t('radians(lat)')}, c) AS rho,
        6378137e0 * g * pow({t(p0)}, c) AS rho0, c * radians(lon + 120 + 50 / 60e0) AS th FROM (
          SELECT *, radians(lon + 123) AS l, sinh(atanh(sin(radians(lat))) - {k} * atanh({k} * sin(radians(lat)))) AS tt,
          {m(p1)} / (c * pow({t(p1)}, c)) AS g FROM (SELECT event_id, lon, lat, {cone} AS c FROM pos)))"""


@query("project_utm", "event_id x~3 y~3 cx~3 cy~3", utm_sql())
def _(spark, sf):
    df = geo.project(positions(spark, sf).drop("x", "y"), "lon", "lat", 32610)
    return geo.project(df, "lon", "lat", 32148, "cx", "cy")


@query("center_xy", "event_id x_cent~3 y_cent~3", "SELECT event_id, x - 18000 AS x_cent, y - 25000 AS y_cent FROM pos")
def _(spark, sf):
    return geo.center_xy(positions(spark, sf), "x", "y", 18000.7, 25000.2)


@query("bbox_corners", "feed_id ring",
       """SELECT feed_id, [{'x': x0, 'y': y0}, {'x': x0, 'y': y1}, {'x': x1, 'y': y1}, {'x': x1, 'y': y0}, {'x': x0, 'y': y0}]
       AS ring FROM box""")
def _(spark, sf):
    return boxes(spark, sf).withColumn("ring", geo.bbox_polygon("x0", "y0", "x1", "y1"))


@query("grid_bin", "event_id xbin ybin xbin_sql", "SELECT *, xbin AS xbin_sql FROM cel")
def _(spark, sf):
    register(spark)
    return positions(spark, sf).withColumns(
        {"xbin": geo.grid_bin("x", 0, 37500, 5000), "ybin": geo.grid_bin("y", 0, 50000, 5000),
         "xbin_sql": F.expr("grid_bin(x, 0e0, 37500e0, 5000e0)")})


@query("time_parts", "event_id t_year t_month t_day t_hour t_min t_sec t_day_of_week t_min_of_day t_sec_of_day",
       """SELECT event_id, CAST(year(t) AS INTEGER) AS t_year, CAST(month(t) AS INTEGER) AS t_month, CAST(day(t) AS INTEGER) AS t_day,
       CAST(hour(t) AS INTEGER) AS t_hour, CAST(minute(t) AS INTEGER) AS t_min, CAST(second(t) AS INTEGER) AS t_sec,
       CAST(isodow(t) - 1 AS INTEGER) AS t_day_of_week, CAST(hour(t) * 60 + minute(t) AS INTEGER) AS t_min_of_day,
       CAST(datediff('day', DATE '2023-12-31', CAST(t AS DATE)) * 86400 + hour(t) * 3600 + minute(t) * 60 + second(t) AS INTEGER)
       AS t_sec_of_day FROM (SELECT event_id, to_timestamp(locationtime) AT TIME ZONE 'America/Los_Angeles' AS t FROM pos)""")
def _(spark, sf):
    return clock.time_features(positions(spark, sf), "locationtime", "America/Los_Angeles", F.lit("2023-12-31").cast("date"))


@query("clock_to_seconds", "trip_id stop_id sec sec_sql", "SELECT trip_id, stop_id, CAST(sec AS BIGINT) AS sec, CAST(sec AS BIGINT) AS sec_sql FROM stt")
def _(spark, sf):
    register(spark)
    return stop_times(spark, sf).withColumns(
        {"sec": clock.hms_seconds("arrival_time"), "sec_sql": F.expr("hms_seconds(arrival_time)")})


@query("clock_to_minutes", "trip_id stop_id m wrapped",
       """SELECT trip_id, stop_id, CAST(sec // 60 AS BIGINT) AS m,
       CAST(CASE WHEN sec // 3600 > 23 THEN sec // 60 - 1440 ELSE sec // 60 END AS BIGINT) AS wrapped FROM stt""")
def _(spark, sf):
    return stop_times(spark, sf).withColumns(
        {"m": clock.hm_minutes("arrival_time"), "wrapped": clock.hm_minutes("arrival_time", wrap=True)})


@query("schedule_delta", "event_id sch",
       """SELECT event_id, coalesce(CASE WHEN d > 43200 THEN d - 86400 ELSE d END, 0) AS sch FROM (SELECT event_id,
       CASE WHEN event_id % 5 > 0 THEN event_id * 37 % 100000 END - locationtime % 86400 AS d FROM pos)""")
def _(spark, sf):
    df = positions(spark, sf).selectExpr(
        "event_id", "case when event_id % 5 > 0 then event_id * 37 % 100000 end AS planned", "locationtime % 86400 AS start")
    return df.withColumn("sch", clock.scheduled_elapsed("planned", "start"))


@query("midnight_wrap", "trip_id t_end",
       "SELECT trip_id, CASE WHEN t_min_of_day_end <= t_min_of_day THEN t_min_of_day_end + 1440 ELSE t_min_of_day_end END AS t_end FROM trp")
def _(spark, sf):
    return trips(spark, sf).withColumn("t_end", clock.unwrap_end("t_min_of_day", "t_min_of_day_end"))


@query("safe_ratio", "event_id r~8",
       """SELECT event_id, coalesce(last_value(q IGNORE NULLS) OVER (PARTITION BY trip_id ORDER BY locationtime, event_id
       ROWS UNBOUNDED PRECEDING), first_value(q IGNORE NULLS) OVER (PARTITION BY trip_id ORDER BY locationtime, event_id
       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS r FROM (SELECT *, CASE WHEN event_id % 4 > 0
       THEN speed_m_s / (event_id % 4) END AS q FROM pos)""")
def _(spark, sf):
    df = positions(spark, sf).withColumn("r", s.ratio("speed_m_s", F.col("event_id") % 4))
    return tr.fill_both(df, ["trip_id"], ["locationtime", "event_id"], "r")


@query("grade", "event_id grade~8",
       """SELECT event_id, least(greatest(coalesce(last_value(q IGNORE NULLS) OVER (PARTITION BY trip_id ORDER BY locationtime, event_id
       ROWS UNBOUNDED PRECEDING), first_value(q IGNORE NULLS) OVER (PARTITION BY trip_id ORDER BY locationtime, event_id
       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), -15e-2), 15e-2) AS grade FROM (SELECT *,
       CASE WHEN dist <> 0 THEN (speed_m_s - coalesce(lag(speed_m_s) OVER (PARTITION BY trip_id ORDER BY locationtime, event_id),
       speed_m_s)) / dist END AS q FROM (SELECT *, (event_id % 7) * 1e2 AS dist FROM pos))""")
def _(spark, sf):
    df = positions(spark, sf).withColumn("dist", F.expr("(event_id % 7) * 1e2"))
    return tj.grade(df, ["trip_id"], ["locationtime", "event_id"], "speed_m_s", "dist")


@query("clip", "event_id v", "SELECT event_id, least(greatest(speed_m_s, 1e1), 9e1) AS v FROM pos")
def _(spark, sf):
    return positions(spark, sf).withColumn("v", s.clip("speed_m_s", 10.0, 90.0))


@query("normalize", "event_id z~6 back~6",
       """SELECT event_id, (speed_m_s - m) / sd AS z, (speed_m_s - m) / sd * sd + m AS back FROM pos
       JOIN (SELECT feed_id, avg(speed_m_s) AS m, stddev_pop(speed_m_s) AS sd FROM pos GROUP BY 1) USING (feed_id)""")
def _(spark, sf):
    df = positions(spark, sf)
    df = df.join(df.groupBy("feed_id").agg(F.avg("speed_m_s").alias("m"), F.stddev_pop("speed_m_s").alias("sd")), "feed_id")
    df = df.withColumn("z", s.normalize("speed_m_s", "m", "sd"))
    return df.withColumn("back", s.denormalize("z", "m", "sd"))


@query("fill_missing_features", "event_id calc_speed_m_s elev_m calc_dist_m",
       "SELECT event_id, -1 AS calc_speed_m_s, -1 AS elev_m, calc_dist_m FROM smp")
def _(spark, sf):
    return bl.with_features(samples(spark, sf), ["calc_speed_m_s", "elev_m", "calc_dist_m"])


@query("assert_positive_label", "shingle_id bad_rows least~6",
       """SELECT shingle_id, count(*) AS bad_rows, min(lab) AS least FROM (SELECT *, cumul_time_s - 2e2 AS lab,
       row_number() OVER (PARTITION BY shingle_id ORDER BY locationtime, event_id) AS rn FROM cum) WHERE rn > 1 AND lab <= 0 GROUP BY 1""")
def _(spark, sf):
    df = cumulated(spark, sf).withColumn("lab", F.col("cumul_time_s") - 200)
    return f.bad_samples(df, "shingle_id", ["locationtime", "event_id"], "lab")


@query("name_parts", "model archetype tuned param day n",
       """SELECT model, split_part(model, '_', 1) AS archetype, split_part(model, '_', -1) = 'TUNED' AS tuned,
       split_part(experiment_name || '-' || fold, '-', 1) AS param, DATE '2024-01-01' + CAST(fold AS INTEGER) AS day, count(*) AS n
       FROM sco GROUP BY ALL""")
def _(spark, sf):
    df = scores(spark, sf).withColumns(
        {"label": F.concat_ws("-", "experiment_name", "fold"),
         "file": F.concat(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), "fold"), "yyyy_MM_dd"), F.lit(".pkl"))})
    return df.groupBy(
        "model", s.archetype_of("model").alias("archetype"), s.is_tuned("model").alias("tuned"),
        s.param_of("label").alias("param"), s.day_of_file("file").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("relabel", "event_id event_type",
       """SELECT event_id, CASE event_type WHEN 'view' THEN 'Seen' WHEN 'error' THEN 'Fault' ELSE event_type END AS event_type FROM pos""")
def _(spark, sf):
    return positions(spark, sf).withColumn("event_type", s.relabel("event_type", {"view": "Seen", "error": "Fault"}))


@query("unit_factors", "event_id mph~6 mps~6 mi~9 km~6",
       """SELECT event_id, speed_m_s * 2.23694e0 AS mph, speed_m_s * 0.44704e0 AS mps, speed_m_s / 1000 / 1.609e0 AS mi,
       speed_m_s * 1.60934e0 AS km FROM pos""")
def _(spark, sf):
    return positions(spark, sf).withColumns(
        {"mph": s.mps_to_mph("speed_m_s"), "mps": s.mph_to_mps("speed_m_s"), "mi": s.m_to_mi("speed_m_s"), "km": s.mi_to_km("speed_m_s")})


@query("parse_array_text", "vec_id n first last total~5",
       """SELECT vec_id, CAST(len(v) AS INTEGER) AS n, v[1] AS first, v[-1] AS last, list_sum(v) AS total
       FROM (SELECT vec_id, [CAST(round(x, 4) AS DOUBLE) FOR x IN CAST(embedding AS DOUBLE[])] AS v FROM embeddings)""")
def _(spark, sf):
    text = F.to_json(F.transform(F.col("embedding").cast("array<double>"), lambda x: F.round(x, 4)))
    df = table(spark, sf, "embeddings").select("vec_id", s.array_from_text(text).alias("v"))
    return df.select("vec_id", F.size("v").alias("n"), F.element_at("v", 1).alias("first"), F.element_at("v", -1).alias("last"),
                     F.aggregate("v", F.lit(0.0), lambda a, b: a + b).alias("total"))
