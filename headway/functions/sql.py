"""The same helpers by name in plain SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "haversine_km": (
        "lon1 DOUBLE, lat1 DOUBLE, lon2 DOUBLE, lat2 DOUBLE",
        "DOUBLE",
        "12742e0 * asin(sqrt(pow(sin(radians(lat2 - lat1) / 2e0), 2) + cos(radians(lat1))"
        " * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2e0), 2)))",
    ),
    "grid_bin": (
        "v DOUBLE, lo DOUBLE, hi DOUBLE, size DOUBLE",
        "BIGINT",
        "CASE WHEN v IS NULL THEN NULL WHEN v < lo THEN 0L WHEN v >= hi THEN cast(floor((hi - lo) / size) AS BIGINT)"
        " ELSE least(cast(floor((v - lo) / ((hi - lo) / (floor((hi - lo) / size) - 1e0))) AS BIGINT) + 1L,"
        " cast(floor((hi - lo) / size) AS BIGINT) - 1L) END",
    ),
    "hms_seconds": (
        "clock STRING",
        "BIGINT",
        "cast(split(clock, ':')[0] AS BIGINT) * 3600 + cast(split(clock, ':')[1] AS BIGINT) * 60"
        " + cast(split(clock, ':')[2] AS BIGINT)",
    ),
}


def register(spark: SparkSession) -> None:
    """Define the helpers as temporary SQL functions; the optimiser inlines them."""
    for name, (args, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {result} RETURN {body}")
