"""Travel-time baselines, splits and scoring."""

from pyspark.sql import functions as F

from headway.catalog.registry import query, view
from headway.catalog.roles import samples, scores, table
from headway.catalog.windows import SHINGLE, cumulated
from headway.operators import aggregates as a
from headway.operators import baselines as bl

KEY, ORDER = "shingle_id", SHINGLE[1]
view("hrs", """SELECT h AS t_hour, coalesce(speed, 6e0) AS speed FROM (SELECT unnest(range(24)) AS h) LEFT JOIN (
    SELECT hr, avg(v) AS speed FROM (SELECT shingle_id, avg(speed_m_s) AS v, arg_min(t_hour, (locationtime, event_id)) AS hr
    FROM smp GROUP BY 1) GROUP BY 1) ON h = hr""")
view("ends", """SELECT shingle_id, arg_min(t_hour, (locationtime, event_id)) AS t_hour, arg_max(cumul_dist_m, (locationtime, event_id)) AS dist,
    arg_max(cumul_time_s, (locationtime, event_id)) AS labels, arg_max(sch_time_s, (locationtime, event_id)) AS sch, count(*) AS n
    FROM cum GROUP BY 1""")


def hourly(spark, sf):
    return bl.fit_hourly_speed(samples(spark, sf), KEY, ORDER, "speed_m_s")


@query("fit_hourly", "t_hour speed~6", "SELECT * FROM hrs")
def _(spark, sf):
    return hourly(spark, sf)


@query("predict_hourly", "shingle_id preds~6 labels~6",
       "SELECT shingle_id, dist / speed AS preds, labels FROM ends JOIN hrs USING (t_hour)")
def _(spark, sf):
    return bl.predict_hourly(cumulated(spark, sf), hourly(spark, sf), KEY, ORDER)


@query("predict_schedule", "shingle_id preds~6 labels~6", "SELECT shingle_id, sch AS preds, labels FROM ends")
def _(spark, sf):
    return bl.predict_schedule(cumulated(spark, sf), KEY, ORDER)


@query("predict_constant", "shingle_id preds~6 labels~6", "SELECT shingle_id, (n - 1) * 3e1 AS preds, labels FROM ends")
def _(spark, sf):
    return bl.predict_constant(cumulated(spark, sf), KEY, ORDER)


@query("kfold", "shingle_id event_id fold", "SELECT *, CAST(CAST('0x' || substr(md5(shingle_id || '|42'), 1, 12) AS BIGINT) % 5 AS INTEGER) AS fold FROM smp")
def _(spark, sf):
    return bl.assign_fold(samples(spark, sf), KEY, 5)


@query("sample_index", "shingle_id start length",
       "SELECT shingle_id, min(event_id) AS start, count(*) AS length FROM smp GROUP BY 1")
def _(spark, sf):
    return bl.sample_lengths(samples(spark, sf), KEY, "event_id")


@query("total_from_steps", "shingle_id total_time_s~6",
       """SELECT shingle_id, coalesce(sum(calc_time_s) FILTER (rn > 1), 0) AS total_time_s FROM (SELECT *, row_number() OVER
       (PARTITION BY shingle_id ORDER BY locationtime, event_id) AS rn FROM smp) GROUP BY 1""")
def _(spark, sf):
    return bl.total_time(samples(spark, sf), KEY, ORDER)


@query("masked_losses", "model mse~4 huber~4",
       """SELECT model, avg((preds - labels) * (preds - labels)) FILTER (fold > 1) AS mse, avg(CASE WHEN abs(preds - labels) <= 1
       THEN (preds - labels) * (preds - labels) / 2 ELSE abs(preds - labels) - 5e-1 END) FILTER (fold > 1) AS huber FROM sco GROUP BY 1""")
def _(spark, sf):
    real = F.col("fold") > 1
    return scores(spark, sf).groupBy("model").agg(
        bl.masked_mse("preds", "labels", real).alias("mse"), bl.masked_huber("preds", "labels", real).alias("huber"))


@query("experiment_matrix", "model fold experiment_name metric value~6",
       " UNION ALL ".join(f"SELECT model, fold, experiment_name, '{m}' AS metric, {m} AS value FROM xmet" for m in a.METRICS))
def _(spark, sf):
    df = table(spark, sf, "lineitem").selectExpr(
        "concat('m', cast(l_partkey % 3 as string)) AS model", "l_linenumber AS fold", "l_partkey % 3 AS home", "l_suppkey % 3 AS city",
        "concat('R', cast(l_orderkey % 30 as string)) AS route",
        "l_extendedprice / 1e2 AS labels", "l_quantity * 2e1 + l_discount * 1e2 AS preds")
    return bl.score_experiments(df, "home", "city", "route", ["R1", "R2"])


view("xmet", """SELECT *, sqrt(mse) AS rmse, 1 - vm / vl AS ex_var, 1 - mse / vl AS r_score FROM (SELECT model, fold, experiment_name,
    min(labels) AS label_min, max(labels) AS label_max, avg(labels) AS label_mean, min(preds) AS pred_min, max(preds) AS pred_max,
    avg(preds) AS pred_mean, avg(abs(labels - preds)) AS mae, avg((labels - preds) * (labels - preds)) AS mse,
    avg(abs(labels - preds) / abs(labels)) AS mape, var_pop(labels - preds) AS vm, var_pop(labels) AS vl FROM (
      SELECT 'm' || CAST(l_partkey % 3 AS VARCHAR) AS model, l_linenumber AS fold, CASE WHEN l_orderkey % 30 IN (1, 2) THEN 'holdout'
      WHEN l_partkey % 3 = l_suppkey % 3 THEN 'same_city' ELSE 'diff_city' END AS experiment_name, l_extendedprice / 1e2 AS labels,
      l_quantity * 2e1 + l_discount * 1e2 AS preds FROM lineitem) GROUP BY ALL)""")


@query("apply_speeds", "event_id pred_speed_m_s~6 calc_time_s~6 cumul_time_s~6",
       """SELECT event_id, v AS pred_speed_m_s, c AS calc_time_s, sum(c) OVER w - first_value(c) OVER w AS cumul_time_s FROM (
         SELECT *, calc_dist_m / v AS c FROM (SELECT *, calc_dist_m / (2e1 + event_id % 30) AS v FROM smp))
       WINDOW w AS (PARTITION BY shingle_id ORDER BY locationtime, event_id ROWS UNBOUNDED PRECEDING)""")
def _(spark, sf):
    df = samples(spark, sf).withColumn("pred_time_s", F.expr("2e1 + event_id % 30"))
    return bl.apply_speeds(df, [KEY], ORDER)


ENDS = ["x", "y", "sch_time_s", "cumul_dist_m"]
WIDTH = 2 * len(ENDS) + sum(bl.START.values())


def one_hot(size, col):
    return f"list_transform(range({size}), lambda h: CASE WHEN h = {col} THEN 1e0 ELSE 0e0 END)"


view("trv", "SELECT shingle_id, " + ", ".join(
    f"coalesce({e}({c} ORDER BY locationtime, event_id), 0) * 1e0 AS {c}_{e}" for c in ENDS for e in ("first", "last"))
    + """, coalesce(first(t_hour ORDER BY locationtime, event_id), 0) AS hr, coalesce(first(t_day_of_week ORDER BY locationtime, event_id), 0) AS wd,
    coalesce(last(cumul_time_s ORDER BY locationtime, event_id), 0) * 1e0 AS lab FROM cum GROUP BY 1""")
view("trf", f"""SELECT shingle_id, CAST(CAST('0x' || substr(md5(shingle_id || '|42'), 1, 12) AS BIGINT) % 5 AS INTEGER) AS fold, lab,
    list_concat([{', '.join(f'{c}_{e}' for c in ENDS for e in ('first', 'last'))}], list_concat({one_hot(24, 'hr')}, {one_hot(7, 'wd')})) AS f FROM trv""")
view("tix", f"SELECT unnest(range(1, {WIDTH + 1})) AS i")
view("tgm", "SELECT fold, a.i, b.i AS j, sum(f[a.i] * f[b.i]) AS p FROM trf, tix a, tix b GROUP BY ALL")
view("tms", "SELECT fold, i, sum(f[i]) AS s, sum(f[i] * lab) AS c FROM trf, tix GROUP BY ALL")
view("tns", "SELECT o.fold, count(*) AS n, avg(lab) AS about FROM (SELECT DISTINCT fold FROM trf) o JOIN trf ON trf.fold <> o.fold GROUP BY ALL")
view("tsp", """SELECT o.fold, g.i, g.j, sum(p) / any_value(n) AS p FROM tns o JOIN tgm g ON g.fold <> o.fold GROUP BY ALL""")
view("tmn", """SELECT fold, i, m, sqrt(greatest(p - m * m, 0)) AS sd, c - m * about AS pull FROM (
    SELECT o.fold, i, sum(s) / any_value(n) AS m, sum(c) / any_value(n) AS c, any_value(about) AS about
    FROM tns o JOIN tms ON tms.fold <> o.fold GROUP BY ALL) JOIN (SELECT fold, i, p FROM tsp WHERE i = j) USING (fold, i)""")
view("tlv", "SELECT *, CASE WHEN sd > 1e-9 * greatest(1, abs(m)) THEN sd END AS sc FROM tmn")
view("trw", """SELECT a.fold, a.i, list_append(list(coalesce((p - a.m * b.m) / (a.sc * b.sc), 0) + CASE WHEN a.i = b.i THEN 1e-2 ELSE 0 END ORDER BY b.i),
    coalesce(any_value(a.pull / a.sc), 0)) AS w FROM tlv a JOIN tlv b ON b.fold = a.fold JOIN tsp ON tsp.fold = a.fold AND tsp.i = a.i AND tsp.j = b.i GROUP BY ALL""")
#: Elimination, one unknown a step; the ridge keeps every pivot away from zero.
view("tsv", f"""WITH RECURSIVE g AS (SELECT 0 AS k, fold, i, w FROM trw UNION ALL
    SELECT g.k + 1, g.fold, g.i, CASE WHEN g.i = g.k + 1 THEN r ELSE list_transform(range(1, {WIDTH + 2}), lambda j: g.w[j] - g.w[g.k + 1] * r[j]) END
    FROM g JOIN (SELECT fold, list_transform(w, lambda v: v / w[k + 1]) AS r FROM g WHERE i = k + 1) q ON q.fold = g.fold WHERE g.k < {WIDTH})
    SELECT fold, i, w[{WIDTH + 1}] AS b FROM g WHERE k = {WIDTH}""")


@query("learned_baseline", "shingle_id fold labels~4 preds~4",
       """SELECT shingle_id, fold, any_value(lab) AS labels, any_value(about) + sum(coalesce((f[i] - m) * b / sc, 0)) AS preds
       FROM trf JOIN tns USING (fold) JOIN tlv USING (fold) JOIN tsv USING (fold, i) GROUP BY ALL""")
def _(spark, sf):
    return bl.cross_predict(bl.assign_fold(cumulated(spark, sf), KEY, 5), KEY, ORDER, ENDS)


@query("feature_sets", "event_id calc_dist_m calc_bear_d x_cent y_cent elev_m calc_stop_dist_m sch_time_s passed_stops_n cumul_passed_stops_n",
       """SELECT event_id, calc_dist_m, -1 AS calc_bear_d, -1 AS x_cent, -1 AS y_cent, -1 AS elev_m, -1 AS calc_stop_dist_m, sch_time_s,
       passed_stops_n, cumul_passed_stops_n FROM cum""")
def _(spark, sf):
    return bl.select_features(cumulated(spark, sf), "static", ["event_id"])


@query("tune_subset", "shingle_id event_id",
       """SELECT * FROM smp WHERE shingle_id IN (SELECT shingle_id FROM (SELECT DISTINCT shingle_id FROM smp)
       ORDER BY CAST('0x' || substr(md5(shingle_id || '|42'), 1, 12) AS BIGINT), shingle_id LIMIT 100)""")
def _(spark, sf):
    return bl.tuning_sample(samples(spark, sf), KEY, 100)


@query("train_arrays", "event_id shingle_id features route_id",
       """SELECT event_id, shingle_id, CAST([""" + ", ".join(
           c if c in {"calc_time_s", "cumul_time_s", "calc_dist_m", "sch_time_s", "passed_stops_n", "cumul_passed_stops_n", "cumul_dist_m",
                      "t_min_of_day", "t_day_of_week", "x", "y", "locationtime", "t_hour"} else "-1" for c in bl.ALL_FEATURES)
       + "] AS FLOAT[]) AS features, route_id FROM (SELECT * REPLACE (round(cumul_dist_m, 3) AS cumul_dist_m) FROM cum)")
def _(spark, sf):
    df = cumulated(spark, sf).withColumn("cumul_dist_m", F.round("cumul_dist_m", 3))
    return bl.training_rows(df.withColumn("sid", F.struct("event_id", KEY)), "sid", "route_id").select("sid.*", "features", "route_id")
