"""Order, top rows, unions, set difference and long / wide forms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.functions.scalar import hash_number


def order_tracks(df: DataFrame, keys: Sequence[str], global_order: bool = False) -> DataFrame:
    """Rows of a key together and in order, for writing; or one total order."""
    if global_order:
        return df.orderBy(*keys)
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def top_group(df: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """The group with most rows, the smaller key on a tie."""
    counts = df.groupBy(*by, key).agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by(F.struct(key, "n"), F.struct(-F.col("n"), key)).alias("b")
    return counts.groupBy(*by).agg(best).select(*by, f"b.{key}", "b.n")


def top(df: DataFrame, order: Sequence, n: int) -> DataFrame:
    """First n rows of an order."""
    return df.orderBy(*order).limit(n)


def sample_groups(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """All rows of n groups picked by hash."""
    picked = df.select(key).distinct().orderBy(hash_number([key], seed), key).limit(n)
    return df.join(picked, key, "left_semi")


def union_tagged(frames: Mapping[str, DataFrame], tag: str = "run") -> DataFrame:
    """Stack frames, each marked with its name; missing columns become null."""
    marked = [df.withColumn(tag, F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)


def distinct_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()


def without_ids(df: DataFrame, bad: DataFrame, key: str) -> DataFrame:
    """Rows whose id is not in the other frame."""
    return df.join(bad.select(key).distinct(), key, "left_anti")


def to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], name="metric", value="value") -> DataFrame:
    """Columns to (name, value) rows."""
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in values]).unpivot(list(ids), list(values), name, value)


def to_wide(df: DataFrame, index: Sequence[str], col: str, value: str, names: Sequence[str], agg=F.avg) -> DataFrame:
    """Metric rows to columns, the list of metrics given so that no extra job runs."""
    return df.groupBy(*index).pivot(col, list(names)).agg(agg(value))


def clean_vehicle_report(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Columns named "vehicle - metric" to long rows with both parts."""
    values = [c for c in df.columns if c not in ids]
    long = to_long(df, ids, values, "_name", "value")
    part = F.split("_name", " - ")
    return long.select(*ids, part[0].alias("vehicle_id"), part[1].alias("metric"), "value")
