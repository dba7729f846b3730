"""Aggregations. Grouped sums combine before the shuffle; exact quantiles and
distribution functions are ordered passes over value counts, never one task."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway import ordered as o
from headway.functions.clock import hm_minutes
from headway.functions.scalar import archetype_of, hash_number, is_tuned, m_to_mi, ratio


def _ends(stop_times: DataFrame, minute: Column) -> DataFrame:
    timed = stop_times.filter(F.col("departure_time").isNotNull()).withColumn("_m", minute)
    at = F.struct("stop_sequence", "_m")
    return timed.groupBy("trip_id").agg(
        F.min_by("_m", at).alias("first"), F.max_by("_m", at).alias("last"), F.count(F.lit(1)).alias("stop_count")
    )


def trip_span(stop_times: DataFrame) -> DataFrame:
    """First and last departure minute per trip, hours as given."""
    return _ends(stop_times, hm_minutes("departure_time")).select(
        "trip_id", F.col("first").alias("t_min_of_day_first"), F.col("last").alias("t_min_of_day_last")
    )


def trip_span_wrapped(stop_times: DataFrame) -> DataFrame:
    """The same with hours over 23 taken to the next day's clock, and the stop count."""
    return _ends(stop_times, hm_minutes("departure_time", wrap=True)).select(
        "trip_id", F.col("first").alias("t_min_of_day"), F.col("last").alias("t_min_of_day_end"), "stop_count"
    )


def feature_config(
    df: DataFrame, cols: Sequence[str], sample: str, frac: float = 0.1, seed: int = 42
) -> DataFrame:
    """Mean and population deviation of each feature on a hashed share of samples."""
    if frac < 1:
        df = df.filter(F.pmod(hash_number([sample], seed), F.lit(1_000_000)) < int(frac * 1_000_000))
    stats = df.agg(
        F.count(F.lit(1)).alias("sample_count"),
        *[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in cols],
    )
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}.mean"), F.col(f"{c}.std")) for c in cols])
    return stats.select("sample_count", F.inline(rows))


def segment_speeds(points: DataFrame, keys: Sequence[str], speed: str = "calc_speed_m_s") -> DataFrame:
    """Mean, sample deviation and count of speed per segment point."""
    return points.groupBy(*keys).agg(
        F.avg(speed).alias("speed_mean"), F.stddev_samp(speed).alias("speed_std"), F.count(F.lit(1)).alias("count_n")
    )


def grid_frames(points: DataFrame, speed: str = "calc_speed_m_s", t: str = "locationtime") -> DataFrame:
    """Mean speed per (minute of day, y cell, x cell) as a long table."""
    minute = F.pmod(F.floor(F.col(t) / 60), F.lit(1440))
    return points.groupBy(minute.alias("tbin"), "ybin", "xbin").agg(F.avg(speed).alias("speed"))


def energy_components(
    df: DataFrame, ids: Sequence[str], powers: Sequence[str], name: str = "component", value: str = "kwh"
) -> DataFrame:
    """kWh of each per-second power column, in long form."""
    sums = df.groupBy(*ids).agg(*[(F.sum(p) / 3600).alias(p) for p in powers])
    return sums.unpivot(list(ids), list(powers), name, value)


def regen(power: str) -> Column:
    """Energy returned: negative power only, in kWh."""
    return F.sum(F.least(F.col(power), F.lit(0.0))) / 3600


def regression_metrics(df: DataFrame, label: str, pred: str, by: Sequence[str]) -> DataFrame:
    """Summary and error measures per group from one pass of sums.

    ``rmse`` is the root of the mean squared error.
    """
    left, right = F.col(label), F.col(pred)
    miss = left - right
    out = df.groupBy(*by).agg(
        F.min(left).alias("label_min"), F.max(left).alias("label_max"), F.avg(left).alias("label_mean"),
        F.min(right).alias("pred_min"), F.max(right).alias("pred_max"), F.avg(right).alias("pred_mean"),
        F.avg(F.abs(miss)).alias("mae"),
        F.avg(miss * miss).alias("_mse"),
        F.avg(F.abs(miss) / F.greatest(F.abs(left), F.lit(2.220446049250313e-16))).alias("mape"),
        F.var_pop(miss).alias("_vm"), F.var_pop(left).alias("_vl"),
    )

    def score(part: str) -> Column:
        flat = F.when(F.col(part) == 0, F.lit(1.0)).otherwise(F.lit(0.0))
        return F.when(F.col("_vl") == 0, flat).otherwise(1 - F.try_divide(part, "_vl"))

    return out.withColumns(
        {"rmse": F.sqrt("_mse"), "ex_var": score("_vm"), "r_score": score("_mse")}
    ).drop("_mse", "_vm", "_vl")


METRICS = (
    "label_min", "label_max", "label_mean", "pred_min", "pred_max", "pred_mean", "mae", "rmse", "mape", "ex_var", "r_score",
)


def format_results(df: DataFrame, by: Sequence[str], label: str = "labels", pred: str = "preds") -> DataFrame:
    """Metric rows per (model, experiment, fold)."""
    return regression_metrics(df, label, pred, by).unpivot(list(by), list(METRICS), "metric", "value")


def summarize_results(df: DataFrame, keys: Sequence[str] = ("run", "metric", "experiment_name")) -> DataFrame:
    """Mean and sample deviation over folds, tuned models told apart from their base name."""
    df = df.withColumns(
        {
            "model_archetype": archetype_of("model"),
            "is_tuned": is_tuned("model"),
            "model": F.regexp_replace("model", "_TUNED$", ""),
        }
    )
    return df.groupBy(*keys, "model", "model_archetype", "is_tuned").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")
    )


def scenario_ranges(long: DataFrame, keys: Sequence[str] = ("sensitivity_parameter", "metric")) -> DataFrame:
    """Least and greatest value per parameter and metric."""
    return long.groupBy(*keys).agg(F.min("value").alias("min"), F.max("value").alias("max"))


def network_profile(trips: DataFrame, stop_times: DataFrame, network: str = "network_id") -> DataFrame:
    """Per network, the size of its busiest service: trips, blocks, kilometres, times.

    The trip stands for its block where a network reports no blocks.
    """
    counts = trips.groupBy(network, "service_id").agg(F.count("block_id").alias("_n"))
    best = counts.groupBy(network).agg(F.min_by("service_id", F.struct(-F.col("_n"), "service_id")).alias("service_id"))
    day = trips.join(best, [network, "service_id"])
    day = o.with_group(day, [network], _blocks=F.count("block_id"))
    day = day.withColumn("_block", F.when(F.col("_blocks") == 0, F.col("trip_id")).otherwise(F.col("block_id").cast("string")))
    at = F.struct("stop_sequence", "arrival_time")
    spans = (
        stop_times.filter(F.col("arrival_time").isNotNull() & F.col("departure_time").isNotNull())
        .groupBy("trip_id")
        .agg(
            F.min_by(hm_minutes("arrival_time"), at).alias("start"),
            F.max_by(hm_minutes("departure_time"), at).alias("end"),
        )
    )
    day = day.join(spans, "trip_id", "left").withColumns(
        {"_duration": F.col("end") - F.col("start"), "_at": F.coalesce("start", F.lit(10**9))}
    )
    day = o.ordered(day, [network, "_block"], ["_at", "trip_id"], _next=o.following("start"))
    day = day.withColumn("_deadhead", F.coalesce(F.col("_next") - F.col("end"), F.lit(0)))
    blocks = day.groupBy(network, "_block").agg(
        F.count(F.lit(1)).alias("_trips"),
        F.first("_blocks").alias("_blocks"),
        F.sum("trip_dist_m").alias("_m"),
        F.coalesce(F.sum("_duration"), F.lit(0)).alias("_min"),
        F.sum("_deadhead").alias("_dead"),
    )
    named = F.col("_block").isNotNull()
    return blocks.groupBy(network).agg(
        F.sum("_trips").alias("n_static_trips"),
        F.count("_block").alias("n_static_blocks"),
        F.max((F.col("_blocks") == 0).cast("int")).alias("no_block_ids"),
        (F.sum("_m") / 1000).alias("service_veh_km"),
        (F.avg(F.when(named, F.col("_m"))) / 1000).alias("mean_block_veh_km"),
        F.avg(F.when(named, F.col("_min"))).alias("mean_block_duration_min"),
        F.avg(F.when(named, F.col("_dead"))).alias("mean_block_deadhead_min"),
    )


def daily_sample_stats(df: DataFrame, by: Sequence[str], day: str, sample: str, route: str) -> DataFrame:
    """Points and samples per day: mean and deviation over days, totals, distinct routes."""
    by = list(by)
    per_sample = df.groupBy(*by, day, sample).agg(F.count(F.lit(1)).alias("_n"))
    per_day = per_sample.groupBy(*by, day).agg(F.sum("_n").alias("_points"), F.count(sample).alias("_samples"))
    out = per_day.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_days"),
        F.avg("_points").alias("mean_points"), F.stddev_pop("_points").alias("std_points"),
        F.avg("_samples").alias("mean_samples"), F.stddev_pop("_samples").alias("std_samples"),
    )
    out = out.withColumns(
        {
            "total_points": F.col("mean_points") * F.col("n_days"),
            "total_samples": F.col("mean_samples") * F.col("n_days"),
        }
    )
    kinds = df.select(*by, route).distinct().groupBy(*by).agg(F.count(route).alias("n_routes"))
    return out.join(kinds, by)


def fleet_size(positions: DataFrame, feeds: DataFrame, feed: str, vehicle: str, default: int = 411, approx: bool = False):
    """Distinct vehicles per feed, a given number where a feed has no data."""
    count = F.approx_count_distinct(vehicle) if approx else F.count_distinct(vehicle)
    seen = positions.groupBy(feed).agg(count.alias("_n"))
    return feeds.join(seen, feed, "left").withColumn("fleet_size", F.coalesce("_n", F.lit(default))).drop("_n")


def vehicle_day_metrics(df: DataFrame, day: str, vehicle: str, metric: str = "metric", value: str = "value") -> DataFrame:
    """Mean value per (day, vehicle, metric)."""
    return df.groupBy(day, vehicle, metric).agg(F.avg(value).alias("value"))


def exact_percentiles(df: DataFrame, by: Sequence[str], col: str, probs: Sequence[float], prefix: str = "p") -> DataFrame:
    """Exact interpolated quantiles per group, as columns ``p0``, ``p1``, ...

    Value counts are ordered and accumulated, and each quantile is read off at
    the two ranks around it, so a group may be of any size.
    """
    by = list(by)
    counts = df.filter(F.col(col).isNotNull()).groupBy(*by, F.col(col).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    ranked = o.ordered(counts, by, ["_v"], _cum=o.running_sum("_c"), _tot=o.group_sum("_c"))
    low_rank = F.col("_cum") - F.col("_c")

    def at(rank: Column) -> Column:
        return F.max(F.when((low_rank <= rank) & (rank < F.col("_cum")), F.col("_v")))

    pos = [F.lit(float(p)) * (F.col("_tot") - 1) for p in probs]
    picks = []
    for i, p in enumerate(pos):
        picks += [at(F.floor(p)).alias(f"_lo{i}"), at(F.ceil(p)).alias(f"_hi{i}"), F.max(p - F.floor(p)).alias(f"_w{i}")]
    got = ranked.groupBy(*by).agg(*picks)
    return got.select(
        *by,
        *[
            (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_w{i}")).alias(f"{prefix}{i}")
            for i in range(len(probs))
        ],
    )


def describe(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, least, quartiles and greatest of each column, one row per column."""
    long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(list(by), list(cols), "feature", "value")
    keys = [*by, "feature"]
    base = long.groupBy(*keys).agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    quarters = exact_percentiles(long, keys, "value", [0.25, 0.5, 0.75], "q")
    return base.join(quarters, keys, "left")


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair, long form, from one aggregate."""
    pairs = list(combinations_with_replacement(cols, 2))
    stats = df.agg(*[F.corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    rows = []
    for i, (a, b) in enumerate(pairs):
        for left, right in {(a, b), (b, a)}:
            rows.append(F.struct(F.lit(left).alias("a"), F.lit(right).alias("b"), F.col(f"_{i}").alias("corr")))
    return stats.select(F.inline(F.array(*rows)))


def ecdf(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows at or below each value."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("_c"))
    counts = o.ordered(counts, list(by), [col], _cum=o.running_sum("_c"), _tot=o.group_sum("_c"))
    return counts.select(*by, col, (F.col("_cum") / F.col("_tot")).alias("share"))


def histogram(df: DataFrame, col: str, width: float, by: Sequence[str]) -> DataFrame:
    """Density per bin of fixed width."""
    at = F.floor(F.col(col) / F.lit(float(width))).cast("long")
    bins = df.filter(F.col(col).isNotNull()).groupBy(*by, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = o.with_group(bins, by, _total=F.sum("n"))
    return bins.withColumn("density", F.col("n") / (F.col("_total") * F.lit(float(width)))).drop("_total")


def bin_minutes(status: DataFrame, width: int, by: Sequence[str], totals: Sequence[str], t: str = "t_min_of_day"):
    """Status rows summed in bins, each labelled with its end minute."""
    end = ((F.floor(F.col(t) / width) + 1) * width).cast("long")
    return status.groupBy(*by, end.alias("t_min_of_day_bin")).agg(*[F.sum(c).alias(c) for c in totals])


def block_energy(
    trips: DataFrame, keys: Sequence[str] = ("block_id",), order: Sequence[str] = ("t_min_of_day", "trip_id")
) -> DataFrame:
    """Block totals of energy, distance and the resulting consumption."""
    first = F.struct(*order)
    sums = trips.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("cyc_energy_kwh", "trip_door_kwh", "trip_deadhead_kwh", "cyc_regen_kwh",
                                      "trip_dist_m", "trip_deadhead_dist_m")],
        *[F.min_by(c, first).alias(c) for c in ("block_deadhead_kwh", "block_deadhead_dist_m")],
    )
    net = F.col("cyc_energy_kwh") + F.col("trip_door_kwh") + F.col("trip_deadhead_kwh") + F.col("block_deadhead_kwh")
    far = F.col("trip_dist_m") + F.col("trip_deadhead_dist_m") + F.col("block_deadhead_dist_m")
    out = sums.select(
        *keys, net.alias("block_net_energy_kwh"), F.col("cyc_regen_kwh").alias("block_cyc_regen_kwh"),
        m_to_mi(far).alias("block_dist_mi"),
    )
    return out.withColumn("block_consumption_kwh_mi", ratio("block_net_energy_kwh", "block_dist_mi"))
