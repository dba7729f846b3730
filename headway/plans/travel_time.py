"""From samples to baseline scores by fold, as one plan over all samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.functions.scalar import ratio
from headway.operators.aggregates import format_results
from headway.operators.baselines import assign_fold
from headway.operators.reshape import union_tagged
from headway.session import stage


def sample_summary(points: DataFrame, sample: str, order: Sequence[str], speed="calc_speed_m_s", hour="t_hour") -> DataFrame:
    """What the baselines need of a sample, from one aggregate."""
    at = F.struct(*order)
    return points.groupBy(sample).agg(
        F.avg(speed).alias("mean_speed"), F.min_by(hour, at).cast("long").alias("t_hour"),
        F.max_by("cumul_dist_m", at).alias("dist_m"), F.max_by("cumul_time_s", at).cast("double").alias("labels"),
        F.max_by("sch_time_s", at).cast("double").alias("sch_time_s"), F.count(F.lit(1)).alias("n_points"),
    )


def evaluate_baselines(
    points: DataFrame, sample: str, order: Sequence[str], folds: int = 5, seed: int = 42, default_speed: float = 6.0,
) -> DataFrame:
    """Scores of the hourly-speed, schedule and constant baselines on held-out folds.

    The hourly speed for a fold is fitted on the other folds: the hour's total
    less the fold's own share, so that no sample is read once per fold.
    """
    each = stage(assign_fold(sample_summary(points, sample, order), sample, folds, seed), "samples")
    own = each.groupBy("t_hour", "fold").agg(F.sum("mean_speed").alias("_s"), F.count("mean_speed").alias("_n"))
    total = own.groupBy("t_hour").agg(F.sum("_s").alias("_ts"), F.sum("_n").alias("_tn"))
    fitted = own.join(total, "t_hour").withColumn(
        "speed", F.coalesce(ratio(F.col("_ts") - F.col("_s"), F.col("_tn") - F.col("_n")), F.lit(default_speed))
    )
    known = each.join(fitted.select("t_hour", "fold", "speed"), ["t_hour", "fold"])
    preds = {
        "AVG": known.select("fold", "labels", ratio("dist_m", "speed").alias("preds")),
        "SCH": each.select("fold", "labels", F.col("sch_time_s").alias("preds")),
        "PER": each.select("fold", "labels", ((F.col("n_points") - 1) * 30.0).alias("preds")),
    }
    return format_results(union_tagged(preds, "model"), ["model", "fold"])
