"""The driver's tables in transit roles, for Spark and for SQL alike.

positions <- events, stop times <- lineitem, stops <- supplier, trips and
blocks <- orders, routes <- nation, services <- supplier. All are whole tables
with columns made by row arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.catalog.registry import view


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def positions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "event_id",
        "cast(user_id as string) AS trip_id",
        "user_id % 40 AS vehicle_id",
        "user_id % 8 AS feed_id",
        "unix_seconds(cast(ts as timestamp)) AS locationtime",
        "cast(ts as date) AS service_day",
        "-1.2255e2 + ((event_id * 7919) % 1000) * 5e-4 AS lon",
        "4.733e1 + ((event_id * 6367) % 1000) * 4.5e-4 AS lat",
        "((event_id * 7919) % 1000) * 3.75e1 AS x",
        "((event_id * 6367) % 1000) * 5e1 AS y",
        "value AS speed_m_s",
        "event_type",
    )


view(
    "pos",
    """SELECT event_id, CAST(user_id AS VARCHAR) AS trip_id, user_id % 40 AS vehicle_id, user_id % 8 AS feed_id,
    CAST(floor(epoch(ts)) AS BIGINT) AS locationtime, CAST(ts AS DATE) AS service_day,
    -1.2255e2 + ((event_id * 7919) % 1000) * 5e-4 AS lon, 4.733e1 + ((event_id * 6367) % 1000) * 4.5e-4 AS lat,
    ((event_id * 7919) % 1000) * 3.75e1 AS x, ((event_id * 6367) % 1000) * 5e1 AS y,
    value AS speed_m_s, event_type FROM events""",
)


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Points with model features; a sample is a trip within five days."""
    return positions(spark, sf).selectExpr(
        "concat(trip_id, '_', cast(locationtime div 432000 as string)) AS shingle_id",
        "*",
        "5e1 + (event_id * 31) % 400 AS calc_dist_m",
        "1e1 + (event_id * 17) % 50 AS calc_time_s",
        "(5e1 + (event_id * 31) % 400) / 1e3 AS calc_dist_km",
        "event_id % 3 AS passed_stops_n",
        "(locationtime div 3600) % 24 AS t_hour",
        "(locationtime div 60) % 1440 AS t_min_of_day",
        "((locationtime div 86400) + 3) % 7 AS t_day_of_week",
        "concat('R', cast(cast(trip_id as bigint) % 30 as string)) AS route_id",
        "(event_id * 13) % 3600 * 1e0 AS sch_time_s",
    )


view(
    "smp",
    """SELECT trip_id || '_' || CAST(locationtime // 432000 AS VARCHAR) AS shingle_id, pos.*,
    5e1 + (event_id * 31) % 400 AS calc_dist_m, 1e1 + (event_id * 17) % 50 AS calc_time_s,
    (5e1 + (event_id * 31) % 400) / 1e3 AS calc_dist_km, event_id % 3 AS passed_stops_n,
    (locationtime // 3600) % 24 AS t_hour, (locationtime // 60) % 1440 AS t_min_of_day,
    ((locationtime // 86400) + 3) % 7 AS t_day_of_week,
    'R' || CAST(CAST(trip_id AS BIGINT) % 30 AS VARCHAR) AS route_id,
    (event_id * 13) % 3600 * 1e0 AS sch_time_s FROM pos""",
)


def stop_times(spark: SparkSession, sf: str) -> DataFrame:
    clock = "18000 + l_linenumber * 900 + (l_partkey % 60) * 10 + (l_orderkey % 24) * 3600"
    return (
        table(spark, sf, "lineitem")
        .selectExpr(
            "cast(l_orderkey as string) AS trip_id",
            "cast(l_suppkey as string) AS stop_id",
            "l_linenumber AS stop_sequence",
            f"{clock} AS sec",
        )
        .selectExpr(
            "trip_id",
            "stop_id",
            "stop_sequence",
            "concat(lpad(cast(sec div 3600 as string), 2, '0'), ':', lpad(cast(sec div 60 % 60 as string), 2, '0'),"
            " ':', lpad(cast(sec % 60 as string), 2, '0')) AS arrival_time",
        )
        .withColumn("departure_time", F.col("arrival_time"))
    )


view(
    "stt0",
    """SELECT CAST(l_orderkey AS VARCHAR) AS trip_id, CAST(l_suppkey AS VARCHAR) AS stop_id, l_linenumber AS stop_sequence,
    18000 + l_linenumber * 900 + (l_partkey % 60) * 10 + (l_orderkey % 24) * 3600 AS sec FROM lineitem""",
)
view(
    "stt",
    """SELECT trip_id, stop_id, stop_sequence, sec, lpad(CAST(sec // 3600 AS VARCHAR), 2, '0') || ':' ||
    lpad(CAST(sec // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(sec % 60 AS VARCHAR), 2, '0') AS arrival_time
    FROM stt0""",
)


def stops(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").selectExpr(
        "cast(s_suppkey as string) AS stop_id",
        "-1.2255e2 + ((s_suppkey * 37) % 100) * 5e-3 AS stop_lon",
        "4.733e1 + ((s_suppkey * 53) % 100) * 4.5e-3 AS stop_lat",
        "((s_suppkey * 37) % 100) * 3.75e2 AS stop_x",
        "((s_suppkey * 53) % 100) * 5e2 AS stop_y",
    )


view(
    "stp",
    """SELECT CAST(s_suppkey AS VARCHAR) AS stop_id, -1.2255e2 + ((s_suppkey * 37) % 100) * 5e-3 AS stop_lon,
    4.733e1 + ((s_suppkey * 53) % 100) * 4.5e-3 AS stop_lat, ((s_suppkey * 37) % 100) * 3.75e2 AS stop_x,
    ((s_suppkey * 53) % 100) * 5e2 AS stop_y FROM supplier""",
)


def trips(spark: SparkSession, sf: str) -> DataFrame:
    start = "240 + (o_orderkey * 37) % 1100"
    return table(spark, sf, "orders").selectExpr(
        "cast(o_orderkey as string) AS trip_id",
        "concat('R', cast(o_custkey % 30 as string)) AS route_id",
        "concat('S', cast(o_orderkey % 7 as string)) AS service_id",
        "concat('N', cast(o_custkey % 5 as string)) AS network_id",
        "o_custkey AS block_id",
        "concat('H', cast(o_custkey % 40 as string)) AS shape_id",
        f"{start} AS t_min_of_day",
        f"({start} + 15 + o_orderkey % 75) % 1300 AS t_min_of_day_end",
        "(o_orderkey * 7919) % 40000 * 1e0 AS start_x",
        "(o_orderkey * 6367) % 40000 * 1e0 AS start_y",
        "(o_orderkey * 5099) % 40000 * 1e0 AS end_x",
        "(o_orderkey * 4327) % 40000 * 1e0 AS end_y",
        "5000 + (o_orderkey * 7) % 20000 AS trip_dist_m",
        "1.5e0 + (o_orderkey % 200) * 1e-2 AS consumption_kwh_mi",
        "10 + o_orderkey % 40 AS stop_count",
        "-5e-2 * (o_orderkey % 50) AS cyc_regen_kwh",
        "o_totalprice",
    )


view(
    "trp",
    """SELECT CAST(o_orderkey AS VARCHAR) AS trip_id, 'R' || CAST(o_custkey % 30 AS VARCHAR) AS route_id,
    'S' || CAST(o_orderkey % 7 AS VARCHAR) AS service_id, 'N' || CAST(o_custkey % 5 AS VARCHAR) AS network_id,
    o_custkey AS block_id, 'H' || CAST(o_custkey % 40 AS VARCHAR) AS shape_id,
    240 + (o_orderkey * 37) % 1100 AS t_min_of_day,
    (240 + (o_orderkey * 37) % 1100 + 15 + o_orderkey % 75) % 1300 AS t_min_of_day_end,
    (o_orderkey * 7919) % 40000 * 1e0 AS start_x, (o_orderkey * 6367) % 40000 * 1e0 AS start_y,
    (o_orderkey * 5099) % 40000 * 1e0 AS end_x, (o_orderkey * 4327) % 40000 * 1e0 AS end_y,
    5000 + (o_orderkey * 7) % 20000 AS trip_dist_m, 1.5e0 + (o_orderkey % 200) * 1e-2 AS consumption_kwh_mi,
    10 + o_orderkey % 40 AS stop_count, -5e-2 * (o_orderkey % 50) AS cyc_regen_kwh, o_totalprice FROM orders""",
)


def routes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").selectExpr("concat('R', cast(n_nationkey as string)) AS route_id", "n_name")


view("rou", "SELECT 'R' || CAST(n_nationkey AS VARCHAR) AS route_id, n_name FROM nation")

DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def calendar(spark: SparkSession, sf: str) -> DataFrame:
    flags = [f"cast((s_suppkey >> {i}) & 1 as int) AS {d}" for i, d in enumerate(DAYS)]
    return table(spark, sf, "supplier").selectExpr(
        "concat('S', cast(s_suppkey as string)) AS service_id",
        *flags,
        "date_format(date_add(date'2024-01-01', cast(s_suppkey % 20 as int)), 'yyyyMMdd') AS start_date",
        "date_format(date_add(date'2024-01-10', cast(s_suppkey % 31 as int)), 'yyyyMMdd') AS end_date",
    )


view(
    "cal",
    "SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS service_id, "
    + ", ".join(f"CAST((s_suppkey >> {i}) & 1 AS INTEGER) AS {d}" for i, d in enumerate(DAYS))
    + """, strftime(DATE '2024-01-01' + CAST(s_suppkey % 20 AS INTEGER), '%Y%m%d') AS start_date,
    strftime(DATE '2024-01-10' + CAST(s_suppkey % 31 AS INTEGER), '%Y%m%d') AS end_date FROM supplier""",
)


def exceptions(spark: SparkSession, sf: str) -> DataFrame:
    """Services added to (1) and removed from (2) single days of January."""
    return table(spark, sf, "nation").selectExpr(
        "concat('S', cast(n_nationkey * 2 div 7 as string)) AS service_id",
        "date_format(date_add(date'2024-01-10', cast(n_nationkey % 14 as int)), 'yyyyMMdd') AS date",
        "cast(1 + n_nationkey div 14 % 2 as int) AS exception_type",
    )


view(
    "exc",
    """SELECT 'S' || CAST(n_nationkey * 2 // 7 AS VARCHAR) AS service_id,
    strftime(DATE '2024-01-10' + CAST(n_nationkey % 14 AS INTEGER), '%Y%m%d') AS date, 1 + n_nationkey // 14 % 2 AS exception_type FROM nation""",
)
for _name, _range in (("onday", " AND '20240117' BETWEEN start_date AND end_date"), ("onweekday", "")):
    view(
        _name,
        f"""SELECT service_id FROM cal WHERE wednesday = 1{_range} AND service_id NOT IN (
        SELECT service_id FROM exc WHERE date = '20240117' AND exception_type = 2)
        UNION SELECT service_id FROM exc WHERE date = '20240117' AND exception_type = 1""",
    )


def versions(spark: SparkSession, sf: str) -> DataFrame:
    """Schedule versions per feed, weekly, later in January for some feeds."""
    return (
        table(spark, sf, "orders")
        .selectExpr(
            "o_custkey % 8 AS feed_id",
            "date_add(date'2024-01-03', cast((o_custkey % 8) + (o_custkey div 8 % 3) * 7 as int)) AS version",
        )
        .distinct()
    )


view(
    "ver",
    """SELECT DISTINCT o_custkey % 8 AS feed_id,
    DATE '2024-01-03' + CAST((o_custkey % 8) + (o_custkey // 8 % 3) * 7 AS INTEGER) AS version FROM orders""",
)


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Label and prediction pairs with model, experiment and fold."""
    return table(spark, sf, "lineitem").selectExpr(
        "concat(case l_orderkey % 3 when 0 then 'GRU' when 1 then 'TRSF' else 'FF' end,"
        " case l_orderkey % 2 when 0 then '_STATIC' else '' end,"
        " case when l_partkey % 2 = 0 then '_TUNED' else '' end) AS model",
        "case l_suppkey % 3 when 0 then 'same_city' when 1 then 'diff_city' else 'holdout' end AS experiment_name",
        "l_linenumber AS fold",
        "concat('run', cast(l_suppkey % 2 as string)) AS run",
        "l_extendedprice / 1e2 AS labels",
        "l_quantity * 2e1 + l_discount * 1e2 AS preds",
    )


view(
    "sco",
    """SELECT CASE l_orderkey % 3 WHEN 0 THEN 'GRU' WHEN 1 THEN 'TRSF' ELSE 'FF' END ||
    CASE l_orderkey % 2 WHEN 0 THEN '_STATIC' ELSE '' END ||
    CASE WHEN l_partkey % 2 = 0 THEN '_TUNED' ELSE '' END AS model,
    CASE l_suppkey % 3 WHEN 0 THEN 'same_city' WHEN 1 THEN 'diff_city' ELSE 'holdout' END AS experiment_name,
    l_linenumber AS fold, 'run' || CAST(l_suppkey % 2 AS VARCHAR) AS run,
    l_extendedprice / 1e2 AS labels, l_quantity * 2e1 + l_discount * 1e2 AS preds FROM lineitem""",
)
