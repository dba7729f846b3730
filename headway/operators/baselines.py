"""Travel-time baselines, splits, losses and model input rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway import ordered as o
from headway.functions.scalar import hash_number, ratio
from headway.operators.aggregates import format_results
from headway.operators.tracks import first_last
from headway.session import stage

# Feature names in their fixed order.
LABEL_FEATURES = ("calc_time_s", "cumul_time_s")
GPS_FEATURES = ("calc_dist_m", "calc_bear_d", "x_cent", "y_cent", "elev_m")
STATIC_FEATURES = ("calc_stop_dist_m", "sch_time_s", "passed_stops_n", "cumul_passed_stops_n")
DISTANCE_FEATURES = ("cumul_dist_m",)
GTFS_FEATURES = tuple(f"{i}_gtfs_embed" for i in range(16))
OSM_FEATURES = tuple(f"{i}_osm_embed" for i in range(64))
TIME_FEATURES = ("t_min_of_day", "t_day_of_week")
OTHER_FEATURES = ("x", "y", "locationtime", "calc_speed_m_s", "t_hour", "t_min")
ALL_FEATURES = (
    LABEL_FEATURES + GPS_FEATURES + STATIC_FEATURES + DISTANCE_FEATURES + GTFS_FEATURES + OSM_FEATURES
    + TIME_FEATURES + OTHER_FEATURES
)
FEATURE_SETS = {
    "gps": GPS_FEATURES,
    "static": GPS_FEATURES + STATIC_FEATURES,
    "gtfs2vec": GPS_FEATURES + GTFS_FEATURES,
    "osm": GPS_FEATURES + OSM_FEATURES,
    "realtime": GPS_FEATURES + STATIC_FEATURES + ("grid",),
}


def fit_hourly_speed(samples: DataFrame, sample: str, order: Sequence[str], speed="calc_speed_m_s", hour="t_hour",
                     default: float = 6.0) -> DataFrame:
    """Mean over samples of their mean speed, by the hour of the first row; 24 rows."""
    each = samples.groupBy(sample).agg(F.avg(speed).alias("_v"), F.min_by(hour, F.struct(*order)).alias("_h"))
    known = each.groupBy(F.col("_h").cast("long").alias("t_hour")).agg(F.avg("_v").alias("_mean"))
    hours = samples.sparkSession.range(24).withColumnRenamed("id", "t_hour")
    return hours.join(known, "t_hour", "left").select("t_hour", F.coalesce("_mean", F.lit(default)).alias("speed"))


def predict_hourly(samples: DataFrame, speeds: DataFrame, sample: str, order: Sequence[str], hour="t_hour") -> DataFrame:
    """Total distance over the speed of the start hour; the label is the last running time."""
    at = F.struct(*order)
    each = samples.groupBy(sample).agg(
        F.min_by(hour, at).cast("long").alias("t_hour"), F.max_by("cumul_dist_m", at).alias("_dist"),
        F.max_by("cumul_time_s", at).alias("labels"),
    )
    out = each.join(speeds, "t_hour")
    return out.select(sample, ratio("_dist", "speed").alias("preds"), F.col("labels").cast("double").alias("labels"))


def predict_schedule(samples: DataFrame, sample: str, order: Sequence[str]) -> DataFrame:
    """The last scheduled elapsed second."""
    at = F.struct(*order)
    return samples.groupBy(sample).agg(
        F.max_by("sch_time_s", at).cast("double").alias("preds"), F.max_by("cumul_time_s", at).cast("double").alias("labels")
    )


def predict_constant(samples: DataFrame, sample: str, order: Sequence[str], seconds: float = 30.0) -> DataFrame:
    """A fixed time for every step after the first point."""
    return samples.groupBy(sample).agg(
        ((F.count(F.lit(1)) - 1) * F.lit(float(seconds))).alias("preds"),
        F.max_by("cumul_time_s", F.struct(*order)).cast("double").alias("labels"),
    )


def assign_fold(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """Fold number by hash of the sample: the same split on any partitioning, folds disjoint."""
    return df.withColumn("fold", F.pmod(hash_number([key], seed), F.lit(k)).cast("int"))


def sample_lengths(df: DataFrame, sample: str, row: str) -> DataFrame:
    """Start and length of each sample's rows."""
    return df.groupBy(sample).agg(F.min(row).alias("start"), F.count(F.lit(1)).alias("length"))


def total_time(df: DataFrame, sample: str, order: Sequence[str], step: str = "calc_time_s") -> DataFrame:
    """Sum of step times without the first point."""
    at = F.struct(*order)
    sums = df.groupBy(sample).agg(
        F.sum(step).alias("_all"), F.min_by(F.struct(F.col(step).alias("v")), at).alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    rest = F.coalesce("_all", F.lit(0)) - F.coalesce(F.col("_first.v"), F.lit(0))
    return sums.select(sample, F.when(F.col("_n") > 1, rest).otherwise(F.lit(0)).cast("double").alias("total_time_s"))


def masked_mse(pred, label, real) -> Column:
    """Mean squared error over real points only."""
    miss = F.col(pred) - F.col(label)
    return F.avg(F.when(real, miss * miss))


def masked_huber(pred, label, real, delta: float = 1.0) -> Column:
    """Mean Huber loss over real points only."""
    miss = F.abs(F.col(pred) - F.col(label))
    loss = F.when(miss <= delta, miss * miss / 2).otherwise((miss - delta / 2) * delta)
    return F.avg(F.when(real, loss))


def score_experiments(preds: DataFrame, home: str, city: str, route: str, held_out: Sequence[str], by=("model", "fold")):
    """Error measures of same-city, other-city and held-out-route predictions from one keyed frame."""
    held = F.col(route).isin(list(held_out))
    kind = F.when(held, "holdout").when(F.col(home) == F.col(city), "same_city").otherwise("diff_city")
    return format_results(preds.withColumn("experiment_name", kind), [*by, "experiment_name"])


def apply_speeds(traj: DataFrame, track: Sequence[str], order: Sequence[str], dist="calc_dist_m", pred="pred_time_s"):
    """Speed from distance and predicted time; step and running time, the first step removed."""
    df = traj.withColumn("pred_speed_m_s", ratio(dist, pred))
    df = df.withColumn("calc_time_s", ratio(dist, "pred_speed_m_s"))
    df = o.ordered(df, track, order, _sum=o.running_sum("calc_time_s"))
    df = o.with_group(df, track, _first=F.min_by("calc_time_s", F.struct(*order)))
    return df.withColumn("cumul_time_s", F.col("_sum") - F.col("_first")).drop("_sum", "_first")


def with_features(df: DataFrame, cols: Sequence[str], fill: float = -1) -> DataFrame:
    """Absent model columns set to a constant."""
    return df.withColumns({c: F.lit(fill) for c in cols if c not in df.columns})


def select_features(df: DataFrame, name: str, keep: Sequence[str] = ()) -> DataFrame:
    """The columns of one feature set, absent ones filled."""
    cols = FEATURE_SETS[name]
    return with_features(df, cols).select(*keep, *cols)


def tuning_sample(df: DataFrame, sample: str, n: int = 100, seed: int = 42) -> DataFrame:
    """All rows of ``n`` distinct samples picked by hash."""
    picked = df.select(sample).distinct().orderBy(hash_number([sample], seed), sample).limit(n)
    return df.join(picked, sample, "left_semi")


def training_rows(df: DataFrame, sample: str, route: str, cols: Sequence[str] = ALL_FEATURES) -> DataFrame:
    """Sample id, float features in fixed order and route, absent features filled."""
    df = with_features(df, cols)
    values = F.array(*[F.col(c).cast("float") for c in cols])
    return df.select(sample, values.alias("features"), F.col(route).cast("string").alias(route))


#: Categories of a sample's first row, and how many there are.
START = {"t_hour_first": 24, "t_day_of_week_first": 7}


def travel_rows(df: DataFrame, sample: str, order: Sequence[str], cols: Sequence[str], label="cumul_time_s", keep: Sequence[str] = ()) -> DataFrame:
    """One row per sample: its first and last row's columns, start hour and weekday, and the last running time as ``labels``; null is 0."""
    ends = first_last(df, [sample], order, [*cols, "t_hour", "t_day_of_week", label, *keep])
    ends = ends.withColumnsRenamed({f"{label}_last": "labels"} | {f"{c}_first": c for c in keep})
    numbers = [f"{c}_{e}" for c in cols for e in ("first", "last")]
    return ends.select(
        sample, *keep, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in (*numbers, "labels")],
        *[F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c) for c in START],
    )


def gram_sums(rows: DataFrame, numbers: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Everything a linear fit needs, in one pass: rows, sums and products per start hour and weekday (and ``by``)."""
    cols = [*numbers, "labels"]
    pairs = [F.sum(F.col(a) * F.col(b)) for a, b in combinations_with_replacement(cols, 2)]
    return rows.groupBy(*by, *START).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(c) for c in cols]).alias("sums"), F.array(*pairs).alias("products")
    )


@dataclass(frozen=True)
class Linear:
    """A fitted line: one number per numeric column, one per category, and a constant."""

    numbers: tuple[str, ...]
    weights: tuple[float, ...]
    starts: dict[str, tuple[float, ...]]
    constant: float

    def predict(self) -> Column:
        out = F.lit(self.constant)
        for c, v in zip(self.numbers, self.weights):
            out = out + F.col(c) * F.lit(v)
        for c, values in self.starts.items():
            # a category that no row can have counts for nothing
            out = out + F.coalesce(F.try_element_at(F.array(*map(F.lit, values)), F.when(F.col(c) >= 0, F.col(c) + 1)), F.lit(0.0))
        return out


def solve_ridge(sums: Sequence, numbers: Sequence[str], ridge: float = 0.01) -> Linear:
    """Ridge regression from rows of :func:`gram_sums`: columns are scaled to unit deviation, those without any get 0."""
    k, sizes = len(numbers), list(START.values())
    width = k + sum(sizes)
    upper = np.triu_indices(k + 1)
    n, total, square, label, cross = 0, np.zeros(width), np.zeros((width, width)), np.zeros(2), np.zeros(width)
    for r in sums:
        at = [k + sum(sizes[:i]) + r[c] for i, c in enumerate(START) if 0 <= r[c] < sizes[i]]
        s, p = np.array(r["sums"]), np.zeros((k + 1, k + 1))
        p[upper] = r["products"]
        p = p + np.triu(p, 1).T
        n += r["n"]
        total[:k] += s[:k]
        square[:k, :k] += p[:k, :k]
        cross[:k] += p[:k, k]
        label += s[k], p[k, k]
        for i in at:
            total[i] += r["n"]
            square[i, :k] += s[:k]
            square[:k, i] += s[:k]
            cross[i] += s[k]
            for j in at:
                square[i, j] += r["n"]
    if not n:
        return Linear(tuple(numbers), (0.0,) * k, {c: (0.0,) * m for c, m in START.items()}, 0.0)
    mean, about = total / n, label[0] / n
    spread = square / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(spread), 0.0))
    live = scale > 1e-9 * np.maximum(1.0, np.abs(mean))
    scale = np.where(live, scale, 1.0)
    spread = np.where(np.outer(live, live), spread / np.outer(scale, scale), 0.0)
    pull = np.where(live, (cross / n - mean * about) / scale, 0.0)
    slope = np.linalg.solve(spread + ridge * np.eye(width), pull) / scale
    cuts = np.cumsum([k, *sizes])
    starts = {c: tuple(slope[cuts[i] : cuts[i + 1]].tolist()) for i, c in enumerate(START)}
    return Linear(tuple(numbers), tuple(slope[:k].tolist()), starts, float(about - slope @ mean))


def fit_travel_time(train: DataFrame, sample: str, order: Sequence[str], cols: Sequence[str], label="cumul_time_s", ridge: float = 0.01):
    """Ridge regression on the first and last row of each sample with the start hour and weekday.

    Returns the fitted line and a function that makes its input rows.
    """

    def rows(df: DataFrame) -> DataFrame:
        return travel_rows(df, sample, order, cols, label)

    numbers = [f"{c}_{e}" for c in cols for e in ("first", "last")]
    return solve_ridge(gram_sums(rows(train), numbers).collect(), numbers, ridge), rows


def cross_predict(df: DataFrame, sample: str, order: Sequence[str], cols: Sequence[str], fold: str = "fold", label="cumul_time_s", ridge: float = 0.01):
    """sample, fold, labels, preds: every sample predicted by the fit of all folds but its own.

    The sums of all folds come from one job, at most one row per fold, hour and
    weekday; the fit without a fold is solved from the total less its share.
    """
    numbers = [f"{c}_{e}" for c in cols for e in ("first", "last")]
    rows = stage(travel_rows(df, sample, order, cols, label, [fold]), "travel-rows")
    sums = gram_sums(rows, numbers, [fold]).collect()
    preds = F.lit(None).cast("double")
    for f in sorted({r[fold] for r in sums}):
        preds = F.when(F.col(fold) == f, solve_ridge([r for r in sums if r[fold] != f], numbers, ridge).predict()).otherwise(preds)
    return rows.select(sample, fold, "labels", preds.alias("preds"))
