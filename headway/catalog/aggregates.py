"""Aggregations over whole tables."""

from pyspark.sql import functions as F

from headway.catalog.registry import query, view
from headway.catalog.roles import positions, samples, scores, stop_times, table, trips
from headway.catalog.windows import cells
from headway.operators import aggregates as a


@query("trip_span", "trip_id t_min_of_day_first t_min_of_day_last",
       """SELECT trip_id, CAST(arg_min(sec // 60, (stop_sequence, sec // 60)) AS BIGINT) AS t_min_of_day_first,
       CAST(arg_max(sec // 60, (stop_sequence, sec // 60)) AS BIGINT) AS t_min_of_day_last FROM stt GROUP BY 1""")
def _(spark, sf):
    return a.trip_span(stop_times(spark, sf))


@query("trip_span_wrapped", "trip_id t_min_of_day t_min_of_day_end stop_count",
       """SELECT trip_id, CAST(arg_min(m, (stop_sequence, m)) AS BIGINT) AS t_min_of_day,
       CAST(arg_max(m, (stop_sequence, m)) AS BIGINT) AS t_min_of_day_end, count(*) AS stop_count
       FROM (SELECT *, CASE WHEN sec // 3600 > 23 THEN sec // 60 - 1440 ELSE sec // 60 END AS m FROM stt) GROUP BY 1""")
def _(spark, sf):
    return a.trip_span_wrapped(stop_times(spark, sf))


FEATS = ["speed_m_s", "calc_dist_m", "calc_time_s", "x", "y", "sch_time_s"]


@query("feature_stats", "feature mean~6 std~6 sample_count",
       " UNION ALL ".join(f"SELECT '{c}' AS feature, avg({c}) AS mean, stddev_pop({c}) AS std, count(*) AS sample_count FROM smp"
                          for c in FEATS))
def _(spark, sf):
    return a.feature_config(samples(spark, sf), FEATS, "shingle_id", 1.0)


@query("segment_speed", "feed_id seq_id speed_mean~6 speed_std~6 count_n",
       """SELECT feed_id, event_id * 7919 % 1000 // 10 AS seq_id, avg(speed_m_s) AS speed_mean, stddev_samp(speed_m_s) AS speed_std,
       count(*) AS count_n FROM pos GROUP BY ALL""")
def _(spark, sf):
    df = positions(spark, sf).withColumn("seq_id", F.expr("event_id * 7919 % 1000 div 10"))
    return a.segment_speeds(df, ["feed_id", "seq_id"], "speed_m_s")


@query("cell_minute_speed", "tbin ybin xbin speed~6",
       "SELECT locationtime // 60 % 1440 AS tbin, ybin, xbin, avg(speed_m_s) AS speed FROM cel GROUP BY ALL")
def _(spark, sf):
    return a.grid_frames(cells(spark, sf), "speed_m_s")


view("blk", """SELECT *, trip_dist_m / 1e3 / 1.609e0 * consumption_kwh_mi AS cyc_energy_kwh, stop_count * 3e-2 AS trip_door_kwh,
    stop_count * 2e-2 AS trip_deadhead_kwh, stop_count * 1e1 AS trip_deadhead_dist_m, block_id % 9 * 1e0 AS block_deadhead_kwh,
    block_id % 9 * 5e2 AS block_deadhead_dist_m FROM trp""")


@query("block_summary", "block_id block_net_energy_kwh~6 block_cyc_regen_kwh~6 block_dist_mi~6 block_consumption_kwh_mi~6",
       """SELECT *, block_net_energy_kwh / block_dist_mi AS block_consumption_kwh_mi FROM (SELECT block_id,
       sum(cyc_energy_kwh) + sum(trip_door_kwh) + sum(trip_deadhead_kwh) + min(block_deadhead_kwh) AS block_net_energy_kwh,
       sum(cyc_regen_kwh) AS block_cyc_regen_kwh,
       (sum(trip_dist_m) + sum(trip_deadhead_dist_m) + min(block_deadhead_dist_m)) / 1000 / 1.609e0 AS block_dist_mi
       FROM blk GROUP BY 1)""")
def _(spark, sf):
    df = trips(spark, sf).selectExpr(
        "*", "trip_dist_m / 1e3 / 1.609e0 * consumption_kwh_mi AS cyc_energy_kwh", "stop_count * 3e-2 AS trip_door_kwh",
        "stop_count * 2e-2 AS trip_deadhead_kwh", "stop_count * 1e1 AS trip_deadhead_dist_m",
        "block_id % 9 * 1e0 AS block_deadhead_kwh", "block_id % 9 * 5e2 AS block_deadhead_dist_m")
    return a.block_energy(df)


POWERS = ["rr_kw", "drag_kw", "accel_kw"]


def powers(spark, sf):
    return positions(spark, sf).selectExpr(
        "trip_id", "speed_m_s * 3e-1 AS rr_kw", "speed_m_s * speed_m_s * 1e-2 AS drag_kw", "speed_m_s - 6e1 AS accel_kw")


view("pow", """SELECT trip_id, speed_m_s * 3e-1 AS rr_kw, speed_m_s * speed_m_s * 1e-2 AS drag_kw, speed_m_s - 6e1 AS accel_kw
    FROM pos""")


@query("regen_energy", "trip_id regen_kwh~6", "SELECT trip_id, sum(least(accel_kw, 0e0)) / 3600 AS regen_kwh FROM pow GROUP BY 1")
def _(spark, sf):
    return powers(spark, sf).groupBy("trip_id").agg(a.regen("accel_kw").alias("regen_kwh"))


@query("component_energy", "trip_id component kwh~6",
       " UNION ALL ".join(f"SELECT trip_id, '{p}' AS component, sum({p}) / 3600 AS kwh FROM pow GROUP BY 1" for p in POWERS))
def _(spark, sf):
    return a.energy_components(powers(spark, sf), ["trip_id"], POWERS)


view("met", """SELECT *, sqrt(mse) AS rmse, 1 - vm / vl AS ex_var, 1 - mse / vl AS r_score FROM (
    SELECT run, model, experiment_name, fold, min(labels) AS label_min, max(labels) AS label_max, avg(labels) AS label_mean,
    min(preds) AS pred_min, max(preds) AS pred_max, avg(preds) AS pred_mean, avg(abs(labels - preds)) AS mae,
    avg((labels - preds) * (labels - preds)) AS mse, avg(abs(labels - preds) / greatest(abs(labels), 2.220446049250313e-16)) AS mape,
    var_pop(labels - preds) AS vm, var_pop(labels) AS vl FROM sco GROUP BY ALL)""")
BY = ["run", "model", "experiment_name", "fold"]
view("mlong", " UNION ALL ".join(f"SELECT run, model, experiment_name, fold, '{m}' AS metric, {m} AS value FROM met" for m in a.METRICS))


@query("error_metrics", " ".join(BY) + " " + " ".join(f"{m}~6" for m in a.METRICS), "SELECT * FROM met")
def _(spark, sf):
    return a.regression_metrics(scores(spark, sf), "labels", "preds", BY)


@query("result_long", " ".join(BY) + " metric value~6", "SELECT * FROM mlong")
def _(spark, sf):
    return a.format_results(scores(spark, sf), BY)


@query("result_summary", "run metric experiment_name model model_archetype is_tuned mean~6 std~6",
       """SELECT run, metric, experiment_name, replace(model, '_TUNED', '') AS model, split_part(model, '_', 1) AS model_archetype,
       ends_with(model, '_TUNED') AS is_tuned, avg(value) AS mean, stddev_samp(value) AS std FROM mlong GROUP BY ALL""")
def _(spark, sf):
    return a.summarize_results(a.format_results(scores(spark, sf), BY))


@query("sensitivity_range", "experiment_name metric min~6 max~6",
       "SELECT experiment_name, metric, min(value) AS min, max(value) AS max FROM mlong GROUP BY ALL")
def _(spark, sf):
    return a.scenario_ranges(a.format_results(scores(spark, sf), BY), ["experiment_name", "metric"])


view("nbk", "SELECT *, CASE WHEN network_id <> 'N3' THEN block_id END AS block FROM trp")


@query("network_summary", "network_id n_static_trips n_static_blocks no_block_ids service_veh_km~6 mean_block_veh_km~6 "
       "mean_block_duration_min~6 mean_block_deadhead_min~6",
       """SELECT network_id, CAST(sum(trips) AS BIGINT) AS n_static_trips, count(*) AS n_static_blocks,
       CASE WHEN network_id = 'N3' THEN 1 ELSE 0 END AS no_block_ids, sum(m) / 1000 AS service_veh_km,
       avg(m) / 1000 AS mean_block_veh_km, avg(dur) AS mean_block_duration_min, avg(dead) AS mean_block_deadhead_min
       FROM (SELECT network_id, b, count(*) AS trips, sum(trip_dist_m) AS m, coalesce(sum(t1 - t0), 0) AS dur, sum(dead) AS dead
         FROM (SELECT *, coalesce(lead(t0) OVER (PARTITION BY network_id, b ORDER BY coalesce(t0, 1000000000), trip_id) - t1, 0)
           AS dead FROM (SELECT n.*, CASE WHEN network_id = 'N3' THEN trip_id ELSE CAST(block AS VARCHAR) END AS b, t0, t1 FROM nbk n
             JOIN (SELECT network_id, service_id FROM (SELECT network_id, service_id, count(block) AS k FROM nbk GROUP BY ALL)
               QUALIFY row_number() OVER (PARTITION BY network_id ORDER BY k DESC, service_id) = 1) USING (network_id, service_id)
             LEFT JOIN (SELECT trip_id, arg_min(sec // 60, (stop_sequence, arrival_time)) AS t0,
               arg_max(sec // 60, (stop_sequence, arrival_time)) AS t1 FROM stt GROUP BY 1) USING (trip_id)))
         GROUP BY ALL) GROUP BY network_id""")
def _(spark, sf):
    t = trips(spark, sf).withColumn("block_id", F.expr("case when network_id <> 'N3' then block_id end"))
    return a.network_profile(t, stop_times(spark, sf))


@query("day_counts", "feed_id n_days mean_points~6 std_points~6 mean_samples~6 std_samples~6 total_points~6 total_samples~6 n_routes",
       """SELECT *, mean_points * n_days AS total_points, mean_samples * n_days AS total_samples FROM (
         SELECT feed_id, count(*) AS n_days, avg(p) AS mean_points, stddev_pop(p) AS std_points, avg(s) AS mean_samples,
         stddev_pop(s) AS std_samples FROM (SELECT feed_id, service_day, count(*) AS p, count(DISTINCT shingle_id) AS s
           FROM smp GROUP BY ALL) GROUP BY 1) JOIN (SELECT feed_id, count(DISTINCT route_id) AS n_routes FROM smp GROUP BY 1)
       USING (feed_id)""")
def _(spark, sf):
    return a.daily_sample_stats(samples(spark, sf), ["feed_id"], "service_day", "shingle_id", "route_id")


@query("fleet_size", "feed_id fleet_size",
       """SELECT feed_id, coalesce(n, 411) AS fleet_size FROM (SELECT CAST(n_nationkey AS BIGINT) AS feed_id FROM nation)
       LEFT JOIN (SELECT feed_id, count(DISTINCT vehicle_id) AS n FROM pos GROUP BY 1) USING (feed_id)""")
def _(spark, sf):
    feeds = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("feed_id"))
    return a.fleet_size(positions(spark, sf), feeds, "feed_id", "vehicle_id")


def quantiles(col):
    return ", ".join(f"quantile_cont({col}, {p}) AS q{i}" for i, p in enumerate(("2.5e-1", "5e-1", "7.5e-1")))


@query("describe_cols", "network_id feature count mean~6 std~6 min~6 q0~6 q1~6 q2~6 max~6",
       " UNION ALL ".join(
           f"""SELECT network_id, '{c}' AS feature, count(v) AS count, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min,
           max(v) AS max, {quantiles('v')} FROM (SELECT network_id, CAST({c} AS DOUBLE) AS v FROM trp) GROUP BY network_id"""
           for c in ("trip_dist_m", "consumption_kwh_mi", "o_totalprice")))
def _(spark, sf):
    return a.describe(trips(spark, sf), ["trip_dist_m", "consumption_kwh_mi", "o_totalprice"], ["network_id"])


CORR = ["trip_dist_m", "consumption_kwh_mi", "stop_count", "o_totalprice"]


@query("corr_matrix", "a b corr~6",
       " UNION ALL ".join(f"SELECT '{x}' AS a, '{y}' AS b, corr({x}, {y}) AS corr FROM trp" for x in CORR for y in CORR))
def _(spark, sf):
    return a.corr_matrix(trips(spark, sf), CORR)


@query("ecdf", "speed_m_s share~9",
       "SELECT DISTINCT speed_m_s, cume_dist() OVER (ORDER BY speed_m_s) AS share FROM pos")
def _(spark, sf):
    return a.ecdf(positions(spark, sf), "speed_m_s")


@query("histogram", "event_type bin n density~9",
       """SELECT *, n / (sum(n) OVER (PARTITION BY event_type) * 5e0) AS density FROM (SELECT event_type,
       CAST(floor(speed_m_s / 5e0) AS BIGINT) AS bin, count(*) AS n FROM pos GROUP BY ALL)""")
def _(spark, sf):
    return a.histogram(positions(spark, sf), "speed_m_s", 5.0, ["event_type"])
