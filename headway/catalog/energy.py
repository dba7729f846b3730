"""Fleet energy, charging and scenarios over all trips."""

from pyspark.sql import functions as F

from headway.catalog.registry import query, view
from headway.catalog.roles import table, trips
from headway.operators import aggregates as a
from headway.operators import energy as e
from headway.operators import joins as j
from headway.operators import tracks as tr
from headway.ordered import ordered, row_number

CYCLE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax"]


def cycles(spark, sf):
    """Drive cycles from line items: one trip per order, one sample per line."""
    df = table(spark, sf, "lineitem").selectExpr(
        "cast(l_orderkey as string) AS trip_id", *CYCLE_ORDER, "l_quantity / 2.5e0 AS mps", "l_discount - 5e-2 AS grade")
    return ordered(df, ["trip_id"], CYCLE_ORDER, time_s=row_number()).select("trip_id", "time_s", "mps", "grade")


view("cyc", f"""SELECT CAST(l_orderkey AS VARCHAR) AS trip_id, l_quantity / 2.5e0 AS mps, l_discount - 5e-2 AS grade,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(CYCLE_ORDER)}) AS time_s FROM lineitem""")
view("rl0", """SELECT *, lag(mps) OVER w AS v0, lag(time_s) OVER w AS t0 FROM cyc WINDOW w AS (PARTITION BY trip_id ORDER BY time_s)""")


def road(mass, aux):
    return f"""SELECT *, CASE WHEN road > 0 THEN road / 9e-1 ELSE road * (9e-1 * 98e-2) END + aux_kw AS ess_kw FROM (
      SELECT *, rr_kw + drag_kw + ascent_kw + accel_kw AS road FROM (SELECT *,
        {mass} * (9.81e0 * 6e-3) * cos(atan(grade)) * (mps + v0) / 2 / 1000 AS rr_kw,
        5e-1 * 1.2e0 * 6e-1 * 10.78e0 * pow((mps + v0) / 2, 3) / 1000 AS drag_kw,
        {mass} * 9.81e0 * sin(atan(grade)) * (mps + v0) / 2 / 1000 AS ascent_kw,
        {mass} * (mps * mps - v0 * v0) / (2 * (time_s - t0)) / 1000 AS accel_kw,
        {aux} AS aux_kw, (mps + v0) / 2 * (time_s - t0) AS dist_m, time_s - t0 AS dt FROM rl0 WHERE t0 IS NOT NULL))"""


def road_sums(source):
    return f"""SELECT *, CASE WHEN dist_m <> 0 THEN ess_kwh / (dist_m / 1000 / 1.609e0) END AS electric_kwh_per_mi FROM (
      SELECT trip_id, {', '.join(f'sum({p}_kw * dt) / 3600 AS {p}_kwh' for p in ('rr', 'drag', 'ascent', 'accel', 'aux', 'ess'))},
      sum(least(ess_kw, 0e0) * dt) / 3600 AS regen_kwh, sum(dist_m) AS dist_m FROM {source} GROUP BY 1)"""


view("roadpow", road("(18340e0 + 41e0 * (150e0 * 0.453592e0))", "2e1"))
view("roadsum", road_sums("roadpow"))


@query("road_load", "trip_id rr_kwh~9 drag_kwh~9 ascent_kwh~9 accel_kwh~9 aux_kwh~9 ess_kwh~9 regen_kwh~9 dist_m~4 electric_kwh_per_mi~5",
       "SELECT * FROM roadsum")
def _(spark, sf):
    return e.road_load_energy(cycles(spark, sf), ["trip_id"], "time_s", "mps", "grade", aux_kw=20.0, passengers=41.0)


@query("trip_energy", "trip_id network_id block_id trip_dist_m cyc_regen_kwh~6 cyc_energy_kwh~6",
       """SELECT *, trip_dist_m / 1000 / 1.609e0 * consumption_kwh_mi AS cyc_energy_kwh FROM (SELECT t.trip_id, t.network_id,
       CASE WHEN bool_or(b IS NULL) OVER (PARTITION BY t.network_id) THEN t.trip_id ELSE b END AS block_id, consumption_kwh_mi,
       s.trip_dist_m, s.cyc_regen_kwh FROM (SELECT *, CASE WHEN network_id <> 'N2' OR CAST(trip_id AS BIGINT) % 11 > 0
         THEN CAST(block_id AS VARCHAR) END AS b FROM trp) t
       JOIN (SELECT trip_id, CAST(trunc(sum(dist_m)) AS BIGINT) AS trip_dist_m, sum(least(ess_kw, 0e0)) / 3600 AS cyc_regen_kwh
         FROM roadpow GROUP BY 1) s USING (trip_id))""")
def _(spark, sf):
    df = trips(spark, sf).withColumn(
        "block_id", F.expr("case when network_id <> 'N2' or cast(trip_id as bigint) % 11 > 0 then block_id end"))
    power = e.road_load_power(cycles(spark, sf), ["trip_id"], "time_s", "mps", "grade", aux_kw=20.0, passengers=41.0)
    return e.trip_energy(df, power, ["network_id"])


view("prep", """SELECT *, t1 - t_min_of_day AS t_min_trip, coalesce(lead(t_min_of_day) OVER w - t1, 0) AS t_min_down,
    coalesce(abs(lead(start_x) OVER w - end_x) + abs(lead(start_y) OVER w - end_y), 0e0) AS trip_deadhead_dist_m
    FROM (SELECT *, CASE WHEN t_min_of_day_end <= t_min_of_day THEN t_min_of_day_end + 1440 ELSE t_min_of_day_end END AS t1 FROM trp)
    WINDOW w AS (PARTITION BY network_id, block_id ORDER BY t_min_of_day, trip_id)""")


@query("deadhead_energy", "trip_id t_min_down trip_deadhead_drive_kwh~6 trip_deadhead_aux_kwh~6 trip_deadhead_kwh~6",
       """SELECT *, trip_deadhead_drive_kwh + trip_deadhead_aux_kwh AS trip_deadhead_kwh FROM (SELECT *,
       trip_deadhead_dist_m / 1000 / 1.609e0 * 2.77e0 AS trip_deadhead_drive_kwh,
       least(greatest(t_min_down, 0), 60) * 60 * 2e1 / 3600 AS trip_deadhead_aux_kwh FROM prep)""")
def _(spark, sf):
    return e.deadhead_energy(e.prepare_trips(trips(spark, sf), ["network_id", "block_id"]), 2.77, 20.0)


@query("door_energy", "trip_id trip_door_kwh~8",
       "SELECT *, stop_count * 3e1 * ((65e0 - 46e0) * (3.2e1 * 5e-1 * 75e-3 * 24e-2)) / 3412 AS trip_door_kwh FROM trp")
def _(spark, sf):
    return e.door_energy(trips(spark, sf), 46, 30)


view("bend", """SELECT network_id, block_id, arg_min(start_x, (t_min_of_day, trip_id)) AS sx, arg_min(start_y, (t_min_of_day, trip_id)) AS sy,
    arg_max(end_x, (t_min_of_day, trip_id)) AS ex, arg_max(end_y, (t_min_of_day, trip_id)) AS ey FROM trp GROUP BY ALL""")


def fixed_depots(spark, sf):
    """Blocks with a depot by arithmetic, for the parts after clustering."""
    ends = e.block_ends(trips(spark, sf), ["network_id", "block_id"])
    return ends.withColumns({"depot_x": F.expr("block_id % 4 * 1e4"), "depot_y": F.expr("block_id % 3 * 1e4")})


DEPOTS = sorted({max(1, int(e.AREA_KM2 * ps["depot_density_per_sqkm"])) for _, ps in e.scenario_list()})
#: Rounds after which the clustering is cut in the SQL of all queries but scenario_run.
DEPOT_ROUNDS = 5
view("dpk", f"SELECT unnest({DEPOTS}) AS k")
view("lloyd", f"""WITH RECURSIVE l AS (
    SELECT 0 AS r, network_id, k, rn - 1 AS i, sx AS x, sy AS y FROM (SELECT *, row_number() OVER (
      PARTITION BY network_id ORDER BY md5(CAST(block_id AS VARCHAR)), block_id) AS rn FROM bend) JOIN dpk ON rn <= k
    UNION ALL
    SELECT l.r + 1, l.network_id, l.k, l.i, coalesce(m.x, l.x), coalesce(m.y, l.y) FROM l LEFT JOIN (
      SELECT network_id, k, b.i AS i, floor(avg(sx) * 1000 + 5e-1) / 1000 AS x, floor(avg(sy) * 1000 + 5e-1) / 1000 AS y FROM (
        SELECT bend.network_id, l.k, bend.block_id, any_value(sx) AS sx, any_value(sy) AS sy,
          min({{'d': (sx - l.x) * (sx - l.x) + (sy - l.y) * (sy - l.y), 'i': l.i}}) AS b
        FROM bend JOIN l ON l.network_id = bend.network_id GROUP BY bend.network_id, l.k, bend.block_id) GROUP BY network_id, k, b.i) m
      ON m.network_id = l.network_id AND m.k = l.k AND m.i = l.i WHERE l.r < {DEPOT_ROUNDS})
    SELECT network_id, k, i, x, y FROM l WHERE r = {DEPOT_ROUNDS}""")
view("dasg", """SELECT a.*, l.x AS depot_x, l.y AS depot_y, abs(sx - l.x) + abs(sy - l.y) + abs(ex - l.x) + abs(ey - l.y) AS block_deadhead_dist_m
    FROM (SELECT bend.network_id, block_id, k, any_value(sx) AS sx, any_value(sy) AS sy, any_value(ex) AS ex, any_value(ey) AS ey,
      min({'d': (sx - x) * (sx - x) + (sy - y) * (sy - y), 'i': i}) AS b
      FROM bend JOIN lloyd ON lloyd.network_id = bend.network_id GROUP BY bend.network_id, block_id, k) a
    JOIN lloyd l ON l.network_id = a.network_id AND l.k = a.k AND l.i = a.b.i""")


@query("depots", "network_id block_id n_depots depot_id depot_x~3 depot_y~3",
       "SELECT *, k AS n_depots, b.i AS depot_id FROM dasg")
def _(spark, sf):
    blocks = e.block_ends(trips(spark, sf), ["network_id", "block_id"])
    return e.assign_depots(blocks, e.depot_centres(blocks, ["network_id"], DEPOTS, DEPOT_ROUNDS), ["network_id"])


@query("depot_deadhead", "network_id block_id block_deadhead_dist_m~3 block_deadhead_kwh~6",
       """SELECT *, block_deadhead_dist_m / 1000 / 1.609e0 * 2.77e0 AS block_deadhead_kwh FROM (SELECT *,
       abs(sx - block_id % 4 * 1e4) + abs(sy - block_id % 3 * 1e4) + abs(ex - block_id % 4 * 1e4) + abs(ey - block_id % 3 * 1e4)
       AS block_deadhead_dist_m FROM bend)""")
def _(spark, sf):
    return e.depot_deadhead(fixed_depots(spark, sf), 2.77)


def energy_sql(dd_kwh, dd_m, kwh_mi="2.77e0", aux="2e1", temp="46e0", open_s="3e1", source="prep", scene=""):
    by = f"{scene}network_id, block_id"
    return f"""SELECT *, net AS block_net_energy_kwh, net / mi AS block_consumption_kwh_mi, mi AS block_dist_mi FROM (SELECT *,
      sum(cyc_energy_kwh) OVER b + sum(trip_door_kwh) OVER b + sum(trip_deadhead_kwh) OVER b + {dd_kwh} AS net,
      sum(cyc_regen_kwh) OVER b AS block_cyc_regen_kwh,
      (sum(trip_dist_m) OVER b + sum(trip_deadhead_dist_m) OVER b + {dd_m}) / 1000 / 1.609e0 AS mi FROM (SELECT *,
        trip_dist_m / 1000 / 1.609e0 * consumption_kwh_mi AS cyc_energy_kwh,
        trip_deadhead_dist_m / 1000 / 1.609e0 * {kwh_mi} + least(greatest(t_min_down, 0), 60) * 60 * {aux} / 3600 AS trip_deadhead_kwh,
        stop_count * {open_s} * ((65e0 - {temp}) * (3.2e1 * 5e-1 * 75e-3 * 24e-2)) / 3412 AS trip_door_kwh FROM {source})
      WINDOW b AS (PARTITION BY {by}))"""


view("fleet", energy_sql("0e0", "0e0"))


def fleet(spark, sf, depots=None):
    df = e.prepare_trips(trips(spark, sf), ["network_id", "block_id"])
    df = df.withColumn("cyc_energy_kwh", F.expr("trip_dist_m / 1000 / 1.609e0 * consumption_kwh_mi"))
    return e.fleet_energy(df, e.BASELINE, ["network_id", "block_id"], depots, ["network_id", "block_id"])


@query("network_energy", "trip_id block_id trip_deadhead_kwh~6 trip_door_kwh~6 block_net_energy_kwh~6 block_cyc_regen_kwh~6 "
       "block_dist_mi~6 block_consumption_kwh_mi~6", "SELECT * FROM fleet")
def _(spark, sf):
    return fleet(spark, sf)


@query("network_energy_depots", "trip_id block_id block_deadhead_kwh~6 block_net_energy_kwh~6 block_dist_mi~6",
       energy_sql("block_deadhead_kwh", "block_deadhead_dist_m", source="""(SELECT *,
         block_deadhead_dist_m / 1000 / 1.609e0 * 2.77e0 AS block_deadhead_kwh FROM prep JOIN (SELECT network_id, block_id,
         abs(sx - block_id % 4 * 1e4) + abs(sy - block_id % 3 * 1e4) + abs(ex - block_id % 4 * 1e4) + abs(ey - block_id % 3 * 1e4)
         AS block_deadhead_dist_m FROM bend) USING (network_id, block_id))"""))
def _(spark, sf):
    return fleet(spark, sf, fixed_depots(spark, sf))


def charge_sql(source, plug, scene=""):
    return f"""SELECT *, block_net_energy_kwh / (t_until_pullout_min / 60e0) AS min_charge_rate FROM (SELECT *,
      block_net_energy_kwh / plug * 60 AS charge_time_min, t1 + block_net_energy_kwh / plug * 60 AS t_charge_end_min,
      t1 - t0 AS t_block_min, 1441 - (t1 - t0) AS t_until_pullout_min FROM (
        SELECT {scene}network_id, block_id, min(t_min_of_day) AS t0, arg_max(t1, (t_min_of_day, trip_id)) AS t1,
        arg_min(block_net_energy_kwh, (t_min_of_day, trip_id)) AS block_net_energy_kwh, min({plug}) AS plug
        FROM {source} GROUP BY ALL))"""


#: Some blocks have a slow plug, at which they charge for days.
PLUG = "CASE WHEN block_id % 97 < 2 THEN 8e0 ELSE 5e1 END"
view("chg", charge_sql("fleet", PLUG))


def charging(spark, sf):
    return e.charging_needs(fleet(spark, sf), ["network_id", "block_id"], F.expr(PLUG))


@query("block_coverage", "block_id t_min_of_day t_min_of_day_end block_net_energy_kwh~6 charge_time_min~5 t_charge_end_min~5 "
       "t_block_min t_until_pullout_min min_charge_rate~6", "SELECT *, t0 AS t_min_of_day, t1 AS t_min_of_day_end FROM chg")
def _(spark, sf):
    return charging(spark, sf)


view("sta", """SELECT network_id, t AS t_min_of_day, count(*) FILTER (t0 <= t AND t1 >= t) AS tot_veh_active,
    count(*) FILTER (t0 > t OR t1 < t) AS tot_veh_inactive, count(*) FILTER (t1 <= t AND t_charge_end_min >= t) AS tot_veh_charging,
    count(*) FILTER (t1 = t) AS tot_veh_arriving, count(*) FILTER (t0 = t) AS tot_veh_departing,
    coalesce(sum(block_net_energy_kwh) FILTER (t1 = t), 0) AS tot_energy_arriving,
    coalesce(sum(block_net_energy_kwh) FILTER (t0 = t), 0) AS tot_energy_departing,
    coalesce(sum(plug) FILTER (t1 <= t AND t_charge_end_min >= t), 0) AS tot_power
    FROM chg JOIN (SELECT network_id, unnest(range(greatest(4320, (CAST(max(greatest(t1, floor(t_charge_end_min))) AS BIGINT) // 1440 + 1) * 1440))) AS t
      FROM chg GROUP BY 1) USING (network_id) GROUP BY ALL""")
STATUS_OUT = ("network_id t_min_of_day tot_veh_active tot_veh_inactive tot_veh_charging tot_veh_arriving tot_veh_departing "
              "tot_energy_arriving~4 tot_energy_departing~4 tot_power~4")


@query("interval_count", STATUS_OUT, "SELECT * FROM sta")
def _(spark, sf):
    return e.vehicle_status(charging(spark, sf), ["network_id"], None)


view("fol", "SELECT network_id, t_min_of_day % 1440 AS t_min_of_day, " + ", ".join(
    f"min({c}) AS {c}" if c == "tot_veh_inactive" else f"CAST(sum({c}) AS {'BIGINT' if 'veh' in c else 'DOUBLE'}) AS {c}"
    for c in e.STATUS) + " FROM sta GROUP BY ALL")


def folded(spark, sf):
    return e.folded_status(charging(spark, sf), ["network_id"])


@query("fold_day", STATUS_OUT, "SELECT * FROM fol")
def _(spark, sf):
    return folded(spark, sf)


@query("quarter_hour", "network_id t_min_of_day_bin tot_veh_arriving tot_veh_departing tot_energy_departing~4",
       """SELECT network_id, (t_min_of_day // 15 + 1) * 15 AS t_min_of_day_bin, CAST(sum(tot_veh_arriving) AS BIGINT) AS tot_veh_arriving,
       CAST(sum(tot_veh_departing) AS BIGINT) AS tot_veh_departing, sum(tot_energy_departing) AS tot_energy_departing
       FROM fol GROUP BY ALL""")
def _(spark, sf):
    return a.bin_minutes(folded(spark, sf), 15, ["network_id"], ["tot_veh_arriving", "tot_veh_departing", "tot_energy_departing"])


view("mng", """SELECT network_id, d AS daily_energy_kwh, h AS charge_veh_hr, d / h AS min_charge_rate_managed FROM
    (SELECT network_id, sum(block_net_energy_kwh) AS d FROM chg GROUP BY 1)
    JOIN (SELECT network_id, sum(tot_veh_inactive) / 60 AS h FROM fol GROUP BY 1) USING (network_id)""")


@query("managed_rate", "network_id daily_energy_kwh~4 charge_veh_hr~6 min_charge_rate_managed~6", "SELECT * FROM mng")
def _(spark, sf):
    return e.managed_rate(charging(spark, sf), ["network_id"])


PARAMS = list(e.BASELINE)


def number(v):
    return f"CAST({v!r} AS DOUBLE)"


view("scn", " UNION ALL ".join(
    f"SELECT '{n}' AS file, {max(1, int(e.AREA_KM2 * ps['depot_density_per_sqkm']))} AS k, " + ", ".join(f"{number(float(v))} AS {p}" for p, v in ps.items())
    for n, ps in e.scenario_list()))
#: Stands for a table of measured consumption by cycle setting; at the baseline it is the trips' own.
CONSUMPTION = "consumption_kwh_mi + 2e-3 * (passenger_load - 41e0) + 5e-2 * (acc_dec_factor - 1e0) + 1e-2 * (aux_power_kw - 2e1)"
REGEN = "cyc_regen_kwh * (1e0 + 1e-1 * (acc_dec_factor - 1e0))"


def consumption(spark, sf):
    df = e.with_scenarios(trips(spark, sf), e.cycle_variants())
    return df.selectExpr("trip_id", *e.CYCLE_PARAMS, f"{CONSUMPTION} AS consumption_kwh_mi", f"{REGEN} AS cyc_regen_kwh")


@query("scenario_grid", "file network_id n_trips " + " ".join(f"{p}~6" for p in PARAMS),
       f"SELECT file, network_id, count(*) AS n_trips, {', '.join(PARAMS)} FROM trp CROSS JOIN scn GROUP BY ALL")
def _(spark, sf):
    df = e.with_scenarios(trips(spark, sf))
    return df.groupBy("file", "network_id", *PARAMS).agg(F.count(F.lit(1)).alias("n_trips"))


view("spr", f"""SELECT prep.* REPLACE ({CONSUMPTION} AS consumption_kwh_mi, {REGEN} AS cyc_regen_kwh), scn.*, block_deadhead_dist_m,
    block_deadhead_dist_m / 1000 / 1.609e0 * deadhead_consumption_kwh_mi AS block_deadhead_kwh
    FROM prep CROSS JOIN scn JOIN (SELECT network_id AS dn, block_id AS db, k AS dk, block_deadhead_dist_m FROM dasg)
    ON dn = network_id AND db = block_id AND dk = scn.k""")
view("sfl", energy_sql("block_deadhead_kwh", "block_deadhead_dist_m", "deadhead_consumption_kwh_mi", "aux_power_kw", "temperature_f", "door_open_time_s",
                       "spr", "file, "))
view("sch", charge_sql("sfl", "depot_plug_power_kw", "file, "))
view("sev", """SELECT file, network_id, unnest([t1, greatest(t1, CAST(floor(t_charge_end_min) AS BIGINT)) + 1]) AS t,
    unnest([plug, -plug]) AS p FROM sch WHERE floor(t_charge_end_min) >= t1""")
view("sin", """SELECT file, network_id, unnest([t0, t1 + 1]) AS t, unnest([1, -1]) AS a FROM sch""")
view("sgrid", """SELECT * FROM (SELECT DISTINCT file, network_id FROM sch) CROSS JOIN (SELECT unnest(range((
    SELECT greatest(4320, (CAST(max(greatest(t1, floor(t_charge_end_min))) AS BIGINT) // 1440 + 1) * 1440) FROM sch))) AS t)""")
view("sst2", """SELECT g.file, g.network_id, g.t % 1440 AS m, p, n - a AS rest FROM (SELECT file, network_id, t,
      coalesce(sum(dp) OVER w, 0) AS p, coalesce(sum(da) OVER w, 0) AS a FROM sgrid
      LEFT JOIN (SELECT file, network_id, t, sum(p) AS dp FROM sev GROUP BY ALL) USING (file, network_id, t)
      LEFT JOIN (SELECT file, network_id, t, sum(a) AS da FROM sin GROUP BY ALL) USING (file, network_id, t)
      WINDOW w AS (PARTITION BY file, network_id ORDER BY t ROWS UNBOUNDED PRECEDING)) g
    JOIN (SELECT file, network_id, count(*) AS n FROM sch GROUP BY ALL) USING (file, network_id)""")
view("sfo", "SELECT file, network_id, m, sum(p) AS p, min(rest) AS rest FROM sst2 GROUP BY ALL")
SCENE = "file, network_id"
METRIC_SQL = {
    "Number of Trips": "SELECT {s}, CAST(count(*) AS DOUBLE) AS value FROM sfl GROUP BY ALL",
    "Number of Blocks": "SELECT {s}, CAST(count(*) AS DOUBLE) AS value FROM sch GROUP BY ALL",
    "Avg. Block Distance (mi)": "SELECT {s}, avg(block_dist_mi) AS value FROM sbk GROUP BY ALL",
    "Avg. Block Duration (min)": "SELECT {s}, avg(t_block_min) AS value FROM sch GROUP BY ALL",
    "Avg. Block Energy (kWh)": "SELECT {s}, avg(block_net_energy_kwh) AS value FROM sbk GROUP BY ALL",
    "Avg. Block Consumption (kWh/mi)": "SELECT {s}, avg(block_consumption_kwh_mi) AS value FROM sbk GROUP BY ALL",
    "Avg. Trip Consumption (kWh/mi)": "SELECT {s}, avg(consumption_kwh_mi) AS value FROM sfl GROUP BY ALL",
    "Proportion Blocks Meeting Energy": "SELECT {s}, avg(CASE WHEN block_net_energy_kwh < 466 THEN 1e0 ELSE 0e0 END) AS value FROM sch GROUP BY ALL",
    "Proportion Blocks Meeting Charging": "SELECT {s}, avg(CASE WHEN t_until_pullout_min > charge_time_min THEN 1e0 ELSE 0e0 END) AS value FROM sch GROUP BY ALL",
    "Avg. Charge Time (min)": "SELECT {s}, avg(charge_time_min) AS value FROM sch GROUP BY ALL",
    "Min Charge Rate (kW)": """SELECT {s}, d / h AS value FROM (SELECT {s}, sum(block_net_energy_kwh) AS d FROM sch GROUP BY ALL)
        JOIN (SELECT {s}, sum(rest) / 60 AS h FROM sfo GROUP BY ALL) USING ({s})""",
    "Peak 1min Power (kW)": "SELECT {s}, max(p) AS value FROM sfo GROUP BY ALL",
    "Peak 15min Power (kW)": "SELECT {s}, max(p) AS value FROM (SELECT {s}, avg(p) AS p FROM sfo GROUP BY file, network_id, m // 15) GROUP BY ALL",
    "Avg. 15min Power (kW)": "SELECT {s}, avg(p) AS value FROM sfo GROUP BY ALL",
    "Battery Capacity 10% (kWh)": "SELECT {s}, quantile_cont(block_net_energy_kwh, 1e-1) AS value FROM sch GROUP BY ALL",
    "Battery Capacity 95% (kWh)": "SELECT {s}, quantile_cont(block_net_energy_kwh, 95e-2) AS value FROM sch GROUP BY ALL",
    "Charger Power 10% (kW)": "SELECT {s}, quantile_cont(min_charge_rate, 1e-1) AS value FROM sch GROUP BY ALL",
    "Charger Power 95% (kW)": "SELECT {s}, quantile_cont(min_charge_rate, 95e-2) AS value FROM sch GROUP BY ALL",
}
view("sbk", """SELECT DISTINCT ON (file, network_id, block_id) file, network_id, block_id, block_dist_mi, block_net_energy_kwh,
    block_consumption_kwh_mi FROM sfl ORDER BY file, network_id, block_id, t_min_of_day, trip_id""")
view("smet", " UNION ALL ".join(
    f"SELECT file, network_id, '{m}' AS metric, CAST(value AS DOUBLE) AS value FROM ({q.format(s=SCENE)})"
    for m, q in METRIC_SQL.items()))
LABELS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in e.PARAM_NAMES.items())


#: Lloyd's rounds of each network and count until one in which no depot moves.
SETTLED = """WITH RECURSIVE l AS (
    SELECT 0 AS r, network_id, k, rn - 1 AS i, sx AS x, sy AS y, true AS moved FROM (SELECT *, row_number() OVER (
      PARTITION BY network_id ORDER BY md5(CAST(block_id AS VARCHAR)), block_id) AS rn FROM bend) JOIN dpk ON rn <= k
    UNION ALL
    SELECT r, network_id, k, i, x, y, bool_or(x <> x0 OR y <> y0) OVER (PARTITION BY network_id, k) AS moved FROM (
      SELECT l.r + 1 AS r, l.network_id, l.k, l.i, l.x AS x0, l.y AS y0, coalesce(m.x, l.x) AS x, coalesce(m.y, l.y) AS y FROM l LEFT JOIN (
        SELECT network_id, k, b.i AS i, floor(avg(sx) * 1000 + 5e-1) / 1000 AS x, floor(avg(sy) * 1000 + 5e-1) / 1000 AS y FROM (
          SELECT bend.network_id, l.k, bend.block_id, any_value(sx) AS sx, any_value(sy) AS sy,
            min({'d': (sx - l.x) * (sx - l.x) + (sy - l.y) * (sy - l.y), 'i': l.i}) AS b
          FROM bend JOIN l ON l.network_id = bend.network_id WHERE l.moved GROUP BY bend.network_id, l.k, bend.block_id) GROUP BY network_id, k, b.i) m
        ON m.network_id = l.network_id AND m.k = l.k AND m.i = l.i WHERE l.moved))
    SELECT network_id, k, i, x, y FROM l QUALIFY r = max(r) OVER (PARTITION BY network_id, k)"""


@query("scenario_run", "file network_id metric value~4 sensitivity_parameter",
       f"SELECT *, CASE split_part(file, '-', 1) {LABELS} ELSE file END AS sensitivity_parameter FROM smet", {"lloyd": SETTLED})
def _(spark, sf):
    return e.run_scenarios(trips(spark, sf), cycle_kwh=consumption(spark, sf))


@query("sensitivity_metrics", "file network_id metric value~4",
       "SELECT 'baseline' AS file, network_id, metric, value FROM smet WHERE file = 'baseline'")
def _(spark, sf):
    return e.run_scenarios(trips(spark, sf), scenarios=e.scenario_list()[:1], rounds=DEPOT_ROUNDS)


@query("provider_compare", "provider n_blocks distance energy charge_veh_hr~6 daily_energy_kwh~4 power~6".replace(
    "n_blocks distance energy", "n_blocks~4 distance~4 energy~4"),
       """SELECT provider, n_blocks, distance, energy, charge_veh_hr, daily_energy_kwh, daily_energy_kwh / charge_veh_hr AS power
       FROM (SELECT network_id AS provider, max(value) FILTER (metric = 'Number of Blocks') AS n_blocks,
         max(value) FILTER (metric = 'Avg. Block Distance (mi)') AS distance,
         max(value) FILTER (metric = 'Avg. Block Energy (kWh)') AS energy FROM smet WHERE file = 'baseline' GROUP BY 1)
       JOIN mng ON provider = network_id WHERE distance < 400""")
def _(spark, sf):
    base = e.run_scenarios(trips(spark, sf), scenarios=e.scenario_list()[:1], rounds=DEPOT_ROUNDS).withColumnRenamed("network_id", "provider")
    charge = e.managed_rate(charging(spark, sf), ["network_id"]).withColumnsRenamed(
        {"network_id": "agency", "min_charge_rate_managed": "power"})
    names = {"Number of Blocks": "n_blocks", "Avg. Block Distance (mi)": "distance", "Avg. Block Energy (kWh)": "energy"}
    return j.network_compare(base, charge, list(names), ("Avg. Block Distance (mi)", 400)).withColumnsRenamed(names)
