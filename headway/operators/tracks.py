"""Per-track features: steps, running totals, shingles, fills and differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headway import ordered as o
from headway.functions import geo
from headway.functions.scalar import hash_number, ratio


def step_metrics(
    df: DataFrame, track: Sequence[str], order: Sequence[str], lon="lon", lat="lat", t="locationtime",
    method: str = "geodesic",
) -> DataFrame:
    """Distance, forward bearing and time since the previous point of the track.

    A track's first row has none of them. ``method`` is the ellipsoid
    (``geodesic``) or the sphere (``haversine``).
    """
    df = o.ordered(df, track, order, _lon=o.prev(lon), _lat=o.prev(lat), _t=o.prev(t))
    if method == "geodesic":
        df = geo.geodesic(df, "_lon", "_lat", lon, lat, "calc_dist_m", "calc_bear_d")
    else:
        df = df.withColumns(
            {
                "calc_dist_m": geo.haversine_km("_lon", "_lat", lon, lat) * 1000,
                "calc_bear_d": geo.sphere_bearing("_lon", "_lat", lon, lat),
            }
        )
    return df.withColumn("calc_time_s", F.col(t) - F.col("_t")).drop("_lon", "_lat", "_t")


def step_speed(df: DataFrame, track: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Speed and kilometres of each step; the first row of a track goes."""
    df = o.ordered(df, track, order, _rn=o.row_number()).filter(F.col("_rn") > 1).drop("_rn")
    return df.withColumns(
        {"calc_speed_m_s": ratio("calc_dist_m", "calc_time_s"), "calc_dist_km": F.col("calc_dist_m") / 1000.0}
    )


def cumulative_features(df: DataFrame, track: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Running time, distance and stops passed, each less its track minimum.

    ``cumul_dist_m`` keeps its offset: it is what the hourly baseline divides.
    """
    names = ("cumul_time_s", "cumul_dist_km", "cumul_passed_stops_n")
    df, done = o.shared_split(df, track, order[0])
    df = o.ordered(
        df, track, order,
        cumul_time_s=o.running_sum("calc_time_s"),
        cumul_dist_km=o.running_sum("calc_dist_km"),
        cumul_passed_stops_n=o.running_sum("passed_stops_n"),
    )
    df = o.ordered(df, track, order, **{f"_min_{n}": o.group_min(n) for n in names})
    df = df.withColumn("cumul_dist_m", F.col("cumul_dist_km") * 1000)
    return done(df.withColumns({n: F.col(n) - F.col(f"_min_{n}") for n in names}).drop(*[f"_min_{n}" for n in names]))


def passed_stops(df: DataFrame, track: Sequence[str], order: Sequence[str], seq="stop_sequence") -> DataFrame:
    """Change in stop sequence since the previous point, 0 at the first; can be negative."""
    df = o.ordered(df, track, order, _prev=o.prev(seq))
    return df.withColumn("passed_stops_n", F.coalesce(F.col(seq) - F.col("_prev"), F.lit(0)).cast("long")).drop("_prev")


def track_start(df: DataFrame, track: Sequence[str], sec="t_sec_of_day") -> DataFrame:
    """Earliest second of day of the track, on every row."""
    return o.with_group(df, track, t_sec_of_day_start=F.min(sec))


def trim_track_ends(df: DataFrame, track: Sequence[str], order: Sequence[str], n: int = 1) -> DataFrame:
    """Remove the first and last ``n`` rows of each track."""
    df = o.ordered(df, track, order, _rn=o.row_number(), _n=o.group_count())
    return df.filter((F.col("_rn") > n) & (F.col("_rn") <= F.col("_n") - n)).drop("_rn", "_n")


def shingle(
    df: DataFrame, track: Sequence[str], order: Sequence[str], low: int, high: int, seed: int = 42
) -> DataFrame:
    """Cut each track into k near-even runs, k from ``low`` to ``high - 1`` by hash.

    The first n mod k runs get one extra row. The id is the track and the run,
    so it is the same on any partitioning.
    """
    df = o.ordered(df, track, order, _rn=o.row_number(), _n=o.group_count())
    k = F.lit(low) + F.pmod(hash_number(track, seed), F.lit(high - low))
    at, size, extra = F.col("_rn") - 1, F.floor(F.col("_n") / k), F.pmod(F.col("_n"), k)
    longer = extra * (size + 1)
    run = F.when(at < longer, F.floor(at / (size + 1))).otherwise(extra + F.floor(F.try_divide(at - longer, size)))
    ids = [F.col(c).cast("string") for c in track]
    return df.withColumn("shingle_id", F.concat_ws("_", *ids, run.cast("string"))).drop("_rn", "_n")


def downtime(df: DataFrame, block: Sequence[str], start="t_min_of_day", end="t_min_of_day_end", tie="trip_id"):
    """Minutes from this trip's end to the block's next start; 0 after the last."""
    df = o.ordered(df, block, [start, tie], _next=o.following(start))
    return df.withColumn("t_min_down", F.coalesce(F.col("_next") - F.col(end), F.lit(0))).drop("_next")


def deadhead(df: DataFrame, block: Sequence[str], start="t_min_of_day", tie="trip_id") -> DataFrame:
    """Manhattan distance from this trip's end to the block's next start; 0 after the last."""
    df = o.ordered(df, block, [start, tie], _nx=o.following("start_x"), _ny=o.following("start_y"))
    far = geo.manhattan("_nx", "_ny", "end_x", "end_y")
    return df.withColumn("trip_deadhead_dist_m", F.coalesce(far, F.lit(0.0))).drop("_nx", "_ny")


def last_n(df: DataFrame, key: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The n most recent rows per key; each task keeps n per key before the shuffle."""
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("recency", F.row_number().over(w)).filter(F.col("recency") <= n)


def recent_in_cell(
    points: DataFrame, samples: DataFrame, cell: Sequence[str], t: str, tie: str, at: str, sample_key: Sequence[str],
    values: Sequence[str], n: int,
) -> DataFrame:
    """The last ``n`` observations in each sample's cell strictly before ``at``.

    Every point is given the n - 1 points before it in its cell; points and
    samples are then laid on one time line per cell and each sample takes the
    last point it sees. A sample is never compared with the points of its
    cell, and a busy cell is split like any other hot key.
    Returns one row per sample: ``recent``, an array of (values, age), newest
    first, null where there is none.
    """
    cell, sample_key = list(cell), list(sample_key)
    box = F.struct(*values, F.col(t).alias("_t"))
    line = o.split_hot(points.select(*cell, t, tie, box.alias("_p0")), cell, t)
    for i in range(1, n):
        line = o.ordered(line, cell, [t, tie], **{f"_p{i}": o.prev(f"_p{i - 1}")})
    line = line.select(
        *cell, F.col(t).alias("_at"), F.lit(1).alias("_kind"), F.col(tie).alias("_tie"),
        F.array(*[f"_p{i}" for i in range(n)]).alias("_seen"),
    )
    asked = samples.select(*cell, F.col(at).alias("_at"), F.lit(0).alias("_kind"), *sample_key)
    both = line.unionByName(asked, allowMissingColumns=True)
    both = o.ordered(both, cell, ["_at", "_kind", "_tie", *sample_key], _last=o.last_known("_seen"))
    recent = F.transform(
        F.filter("_last", lambda p: p.isNotNull()),
        lambda p: F.struct(*[p[v].alias(v) for v in values], (p["_t"] - F.col("_at")).alias("elapsed_s")),
    )
    return both.filter("_kind = 0").select(*cell, *sample_key, recent.alias("recent"))


def recent_rows(recent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The observations of :func:`recent_in_cell` as rows with ``recency`` from 1."""
    rows = recent.select(*keys, F.posexplode("recent").alias("_i", "_r"))
    return rows.select(*keys, (F.col("_i") + 1).alias("recency"), "_r.*")


def recent_columns(
    recent: DataFrame, values: Sequence[str], n: int, strict: bool = False, fill_by: Sequence[str] | None = None
) -> DataFrame:
    """``value_1..value_n`` columns from :func:`recent_in_cell`.

    Gaps stay null. ``strict`` blanks all n where one is missing; ``fill_by``
    puts the mean over the given group (a run, a day) in the gaps, 0 where a
    group has no value at all.
    """
    names = [*values, "elapsed_s"]
    whole = F.size("recent") == n
    picks = {}
    for v in names:
        for i in range(n):
            value = F.try_element_at("recent", F.lit(i + 1))[v]
            picks[f"{v}_{i + 1}"] = F.when(whole, value) if strict else value
    out = recent.withColumns(picks)
    if fill_by is not None:
        sums = {}
        for v in names:
            cols = [F.col(f"{v}_{i + 1}").cast("double") for i in range(n)]
            sums[f"_sum_{v}"] = F.sum(sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0)))
            sums[f"_cnt_{v}"] = F.sum(sum((c.isNotNull().cast("int") for c in cols), F.lit(0)))
        out = o.with_group(out, fill_by, **sums)
        for v in names:
            mean = F.coalesce(ratio(f"_sum_{v}", f"_cnt_{v}"), F.lit(0.0))
            out = out.withColumns({f"{v}_{i + 1}": F.coalesce(F.col(f"{v}_{i + 1}"), mean) for i in range(n)})
        out = out.drop(*sums)
    return out.drop("recent")


def fill_forward(df: DataFrame, key: Sequence[str], order: Sequence[str], *cols: str) -> DataFrame:
    """Last known value carried forward."""
    return o.ordered(df, key, order, **{c: o.last_known(c) for c in cols})


def fill_both(df: DataFrame, key: Sequence[str], order: Sequence[str], *cols: str) -> DataFrame:
    """Forward, then backward fill."""
    calcs = {f"_f_{c}": o.last_known(c) for c in cols} | {f"_b_{c}": o.next_known(c) for c in cols}
    df = o.ordered(df, key, order, **calcs)
    return df.withColumns({c: F.coalesce(f"_f_{c}", f"_b_{c}") for c in cols}).drop(*calcs)


def lagged(df: DataFrame, key: Sequence[str], order: Sequence[str], col: str, k: int, name: str) -> DataFrame:
    """The value k rows back: k steps on one shuffle."""
    df, done = o.shared_split(df.withColumn(name, F.col(col)), key, order[0])
    for _ in range(k):
        df = o.ordered(df, key, order, **{name: o.prev(name)})
    return done(df)


def local_diff(df: DataFrame, key: Sequence[str], order: Sequence[str], col: str, k: int) -> DataFrame:
    """Value minus the value k - 1 rows back; rows without one go."""
    df = df.withColumn("_box", F.struct(F.col(col).alias("v")))
    df = lagged(df, key, order, "_box", k - 1, "_old").filter(F.col("_old").isNotNull())
    return df.withColumn("local_diff", F.col(col) - F.col("_old.v")).drop("_old", "_box")


def first_last(df: DataFrame, key: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """First and last row of each sample side by side."""
    at = F.struct(*order)
    picks = [F.min_by(c, at).alias(f"{c}_first") for c in cols] + [F.max_by(c, at).alias(f"{c}_last") for c in cols]
    return df.groupBy(*key).agg(*picks)


def repeat_first(df: DataFrame, key: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """The sample's first value of each column on all its rows."""
    at = F.struct(*order)
    return o.with_group(df, key, **{f"{c}_start": F.min_by(c, at) for c in cols})


def running_kwh(df: DataFrame, key: Sequence[str], order: Sequence[str], power="power_kw") -> DataFrame:
    """Cumulative energy of a per-second power trace."""
    df = o.ordered(df, key, order, _sum=o.running_sum(power))
    return df.withColumn("cumul_kwh", F.col("_sum") / 3600).drop("_sum")


def acceleration(df: DataFrame, key: Sequence[str], order: Sequence[str], speed: str, t: str) -> DataFrame:
    """Speed difference over time difference."""
    df = o.ordered(df, key, order, _v=o.prev(speed), _t=o.prev(t))
    return df.withColumn("accel", ratio(F.col(speed) - F.col("_v"), F.col(t) - F.col("_t"))).drop("_v", "_t")


def segment_profile(df: DataFrame, shape="shape_id", seq="seq_id", speed="speed_mean", sep: float = 300.0) -> DataFrame:
    """Distance from the sequence, step time from the mean speed, running time."""
    df, done = o.shared_split(df.withColumn("cumul_dist_m", F.col(seq) * F.lit(float(sep))), [shape], seq)
    df = o.ordered(df, [shape], [seq], _prev=o.prev("cumul_dist_m"))
    df = df.withColumn("calc_dist_m", F.coalesce(F.col("cumul_dist_m") - F.col("_prev"), F.lit(0.0))).drop("_prev")
    df = df.withColumn("calc_time_s", ratio("calc_dist_m", speed))
    return done(o.ordered(df, [shape], [seq], cumul_time_s=o.running_sum("calc_time_s")))
