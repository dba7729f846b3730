"""Resampling, interpolation, smoothing and trajectory assembly."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway import ordered as o
from headway.functions import geo
from headway.functions.scalar import clip, hash_number, ratio
from headway.operators.filters import day_services
from headway.operators.tracks import step_metrics
from headway.session import stage


def _between(df: DataFrame, at: Column, low: Column, high: Column, cols: Sequence[str], name: str) -> DataFrame:
    """Linear values of ``cols`` at ``at`` inside the segment from this row to the next."""
    share = (at - low) / (high - low)
    return df.withColumns(
        {c: F.col(c) + (F.col(f"_n_{c}") - F.col(c)) * share for c in cols} | {name: at}
    )


def resample_by_distance(
    df: DataFrame, track: Sequence[str], order: Sequence[str], step: float | str, dist: str = "cumul_dist_m",
    linear: Sequence[str] = ("lat", "lon", "locationtime"), first: Sequence[str] = (),
) -> DataFrame:
    """Each track at equal steps of running distance, from its start up to but not at its end.

    Each pair of neighbouring points owns the marks in [d0, d1) and generates
    them, so nothing is grouped in Python. ``step`` is metres or a column of
    metres per track; ``first`` columns take the track's first value.
    """
    step = F.col(step) if isinstance(step, str) else F.lit(float(step))
    calcs = {f"_n_{c}": o.following(c) for c in (dist, *linear)}
    calcs |= {f"_f_{c}": o.first_row(c) for c in first} | {"_d0": o.first_row(dist)}
    df = o.ordered(df.withColumn("_step", step), track, order, **calcs)
    low, high = F.col(dist) - F.col("_d0"), F.col(f"_n_{dist}") - F.col("_d0")
    df = df.filter(high > low)
    begin, end = F.ceil(low / F.col("_step")).cast("long"), (F.ceil(high / F.col("_step")) - 1).cast("long")
    df = df.withColumns({"_b": begin, "_e": end}).filter(F.col("_e") >= F.col("_b"))
    df = df.withColumn("_i", F.explode(F.sequence("_b", "_e")))
    at = F.col("_d0") + F.col("_i") * F.col("_step")
    df = _between(df, at, F.col(dist), F.col(f"_n_{dist}"), linear, "_at")
    return df.select(
        *track, F.col("_i").alias("point_no"), F.col("_at").alias(dist), *linear, *[F.col(f"_f_{c}").alias(c) for c in first]
    )


def random_step(track: Sequence[str], seed: int = 42, low: int = 200, high: int = 400) -> Column:
    """A step length per track from ``low`` to ``high - 1`` metres, by hash."""
    return (F.lit(low) + F.pmod(hash_number(track, seed), F.lit(high - low))).cast("double")


def resample_trips(df: DataFrame, track: Sequence[str], order: Sequence[str], step: float | str | None = None,
                   max_jump: float = 100_000, method: str = "geodesic", first: Sequence[str] = ()) -> DataFrame:
    """Positions to equal steps: measure, drop trips with an impossible jump, resample."""
    t = order[0]
    df, done = o.shared_split(df, track, t)
    df = step_metrics(df, track, order, t=t, method=method)
    df = df.withColumn("_d", F.coalesce("calc_dist_m", F.lit(0.0)))
    df = o.ordered(df, track, order, cumul_dist_m=o.running_sum("_d"), _far=o.group_max("_d"))
    df = df.filter(F.col("_far") <= max_jump)
    if step is None:
        df, step = df.withColumn("_track_step", random_step(track)), "_track_step"
    return done(resample_by_distance(df, track, order, step, linear=("lat", "lon", t), first=first))


def resample_by_second(
    df: DataFrame, track: Sequence[str], t: str, cols: Sequence[str], longest_gap: int | None = None, block: int = 3600
) -> DataFrame:
    """Mean per second, missing seconds filled in linearly.

    A gap is generated in blocks, so no row holds more than ``block`` seconds;
    gaps above ``longest_gap`` seconds, where given, are left open.
    """
    second = F.floor(t).cast("long")
    df = df.groupBy(*track, second.alias(t)).agg(*[F.avg(c).alias(c) for c in cols])
    df = o.ordered(df, track, [t], **{f"_n_{c}": o.following(c) for c in (t, *cols)})
    last = F.col(f"_n_{t}").isNull()
    ends = F.when(last, F.col(t)).otherwise(F.col(f"_n_{t}") - 1)
    if longest_gap is not None:
        ends = F.when(F.col(f"_n_{t}") - F.col(t) > longest_gap, F.col(t)).otherwise(ends)
    df = df.withColumn("_end", ends).withColumn("_from", F.explode(F.sequence(F.col(t), F.col("_end"), F.lit(block).cast("long"))))
    df = df.withColumn("_at", F.explode(F.sequence("_from", F.least(F.col("_end"), F.col("_from") + block - 1))))
    share = F.when(last, F.lit(0.0)).otherwise((F.col("_at") - F.col(t)) / (F.col(f"_n_{t}") - F.col(t)))
    values = {c: F.when(share == 0, F.col(c)).otherwise(F.col(c) + (F.col(f"_n_{c}") - F.col(c)) * share) for c in cols}
    return df.select(*track, F.col("_at").alias(t), *[e.alias(c) for c, e in values.items()])


def interp_at(
    probe: DataFrame, signal: DataFrame, track: Sequence[str], x: str, y: str, name: str = "interp", probe_key: Sequence[str] = ()
) -> DataFrame:
    """Linear value of a signal at the probe's positions, flat outside its range.

    Both go on one line per track; each probe looks to the last known point
    before it and the next known after it. Signal positions must be unique.
    """
    point = F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    a = signal.filter(F.col(y).isNotNull()).select(*track, x, F.lit(0).alias("_kind"), point.alias("_p"))
    b = probe.withColumn("_kind", F.lit(1))
    line = a.unionByName(b, allowMissingColumns=True)
    line = o.ordered(line, track, [x, "_kind", *probe_key], _a=o.last_known("_p"), _b=o.next_known("_p"))
    out = line.filter("_kind = 1")
    lo, hi = F.col("_a"), F.col("_b")
    share = ratio(F.col(x) - lo["x"], hi["x"] - lo["x"])
    value = F.when(lo.isNull(), hi["y"]).when(hi.isNull() | (lo["x"] == F.col(x)), lo["y"]).otherwise(
        lo["y"] + (hi["y"] - lo["y"]) * share
    )
    return out.withColumn(name, value).select(*probe.columns, name)


def signal_rmse(probe: DataFrame, signal: DataFrame, track: Sequence[str], x: str, y: str, other: str) -> DataFrame:
    """RMSE per track between the probe's ``y`` and the signal interpolated to it."""
    both = interp_at(probe, signal.withColumnRenamed(y, other) if y != other else signal, track, x, other, "_v", [y])
    miss = F.col(y) - F.col("_v")
    return both.groupBy(*track).agg(F.sqrt(F.avg(miss * miss)).alias("rmse"))


def peak_filter(
    df: DataFrame, track: Sequence[str], order: Sequence[str], col: str, k: int = 3, acc: float = 1.0, dec: float = 1.0,
    low: float | None = None, high: float | None = None, name: str = "peaked",
) -> DataFrame:
    """Push each value away from its centred mean of ``k``; scalars for above and below.

    Rows nearer than half a window to an end take the result of the first or
    last full window. Tracks shorter than a window keep their values.
    """
    if k % 2 == 0:
        raise ValueError("the window must be odd")
    h = k // 2
    df, done = o.shared_split(df, track, order[0])
    df = df.withColumns({"_b0": F.col(col), "_f0": F.col(col)})
    for i in range(1, h + 1):
        df = o.ordered(df, track, order, **{f"_b{i}": o.prev(f"_b{i - 1}"), f"_f{i}": o.following(f"_f{i - 1}")})
    near = [F.col(f"_b{i}") for i in range(h, 0, -1)] + [F.col(col)] + [F.col(f"_f{i}") for i in range(1, h + 1)]
    mean = sum(near[1:], near[0]) / k
    away = F.col(col) - mean
    full = F.col(col) + away * F.when(away > 0, F.lit(float(acc))).otherwise(F.lit(float(dec)))
    df = df.withColumn("_full", full)
    df = o.ordered(df, track, order, _left=o.last_known("_full"), _right=o.next_known("_full"))
    value = clip(F.coalesce("_full", "_right", "_left", col), low, high)
    return done(df).withColumn(name, value).drop(
        "_full", "_left", "_right", *[f"_b{i}" for i in range(h + 1)], *[f"_f{i}" for i in range(h + 1)]
    )


def _convolve(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Whole-window sums of values times weights; NaN exactly where a window holds an unknown value, whatever its width."""
    unknown = np.isnan(values)
    known = np.where(unknown, 0.0, values)
    if len(weights) <= 512:
        out = np.convolve(known, weights[::-1], mode="valid")
    else:  # by transform
        size = 1 << int(len(values) + len(weights)).bit_length()
        out = np.fft.irfft(np.fft.rfft(known, size) * np.fft.rfft(weights[::-1], size), size)[len(weights) - 1 : len(values)]
    count = np.concatenate([[0], np.cumsum(unknown)])
    return np.where(count[len(weights) :] > count[: len(count) - len(weights)], np.nan, out)


def _smooth_chunk(values: np.ndarray, start: int, n: int, window: int, degree: int) -> np.ndarray:
    """What :func:`smooth` means, for the values of a piece of a track in memory: ``n`` rows in all, the piece begins at ``start``.

    Rows without a whole window inside the piece come out NaN unless they are
    at an end of the track, where the end window's polynomial is read.
    """
    out = np.full(len(values), np.nan)
    if len(values) < window:
        return out
    x = (np.arange(window) - (window - 1) / 2) / max((window - 1) / 2, 1.0)
    basis = np.vander(x, degree + 1, increasing=True)
    fit = np.linalg.pinv(basis)
    half = window // 2
    # The constant term of the fit is its value in the middle of the window.
    middle = _convolve(values, fit[0])
    shift = half if window % 2 else half - 1
    out[shift : shift + len(middle)] = middle
    if start == 0:
        out[:half] = basis[:half] @ (fit @ values[:window])
    if start + len(values) == n:
        out[len(values) - half :] = basis[window - half :] @ (fit @ values[-window:])
    return out


def _window_moments(df: DataFrame, track: Sequence[str], degree: int) -> DataFrame:
    """Per row of ``_at``, ``_w`` and ``_v``: power sums of the values of its block of ``_w`` rows up to it and from it on.

    The coordinate is the place in the block over its length, so that sums of a long
    track lose no digits. The last entry counts unknown values.
    """
    block = F.floor(F.col("_at") / F.col("_w"))
    place = (F.col("_at") - block * F.col("_w")) / F.col("_w")
    df = df.withColumns({"_block": block, "_y": place})
    known = F.coalesce(F.col("_v"), F.lit(0.0))
    terms = [known * F.pow("_y", F.lit(float(r))) for r in range(degree + 1)] + [F.col("_v").isNull().cast("double")]
    line = Window.partitionBy(*track, "_block")
    up = line.orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    down = line.orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, 0)
    return df.select(
        *track, "_at", F.array(*[F.sum(t).over(up) for t in terms]).alias("_upto"), F.array(*[F.sum(t).over(down) for t in terms]).alias("_from")
    )


def _power(x: Column, n: int) -> Column:
    return reduce(lambda a, b: a * b, [x] * n) if n else F.lit(1.0)


def _moment_weights(df: DataFrame, degree: int) -> DataFrame:
    """``_c0``, ...: the weight of each window moment in the value at ``_q`` of the polynomial fitted to ``_w`` samples.

    With orthogonal polynomials p[k + 1] = z p[k] - beta[k] p[k - 1], whose squares add up
    to w beta[1] .. beta[k] over the samples, the fit is a sum of p[k] times p[k](q) over
    that. Each step is a column, so that no expression grows with the degree.
    """
    w, q, own = F.col("_w"), F.col("_q"), list(df.columns)
    df = df.withColumns({f"_beta{k}": k * k * (w * w - k * k) / (4 * (4 * k * k - 1)) / (w * w) for k in range(1, degree + 1)})
    df = df.withColumns({"_p0": F.lit(1.0), "_p1": q, "_size0": w.cast("double")})
    for k in range(1, degree + 1):
        step = {f"_size{k}": F.col(f"_size{k - 1}") * F.col(f"_beta{k}")}
        if k < degree:
            step[f"_p{k + 1}"] = q * F.col(f"_p{k}") - F.col(f"_beta{k}") * F.col(f"_p{k - 1}")
        df = df.withColumns(step)
    shares = {f"_share{k}": F.when(F.lit(k) < w, F.try_divide(f"_p{k}", f"_size{k}")).otherwise(F.lit(0.0)) for k in range(degree + 1)}
    df = df.withColumns(shares)
    poly = [[F.lit(1.0)]]
    for k in range(degree):
        before = [*poly[k - 1], None, None] if k else [None, None]
        poly.append([_less(u, F.col(f"_beta{k}"), v) for u, v in zip([None, *poly[k]], before)])
    weights = [
        reduce(lambda a, b: a + b, [F.col(f"_share{k}") * poly[k][m] for k in range(m, degree + 1) if poly[k][m] is not None]) for m in range(degree + 1)
    ]
    return df.select(*own, *[c.alias(f"_c{m}") for m, c in enumerate(weights)])


def _less(u: Column | None, beta: Column, v: Column | None) -> Column | None:
    """u - beta v, where either may be absent."""
    if v is None:
        return u
    return -beta * v if u is None else u - beta * v


def smooth(
    df: DataFrame, track: Sequence[str], order: Sequence[str], col: str, factor: float = 0.03, degree: int = 5,
    low: float | None = None, high: float | None = None, name: str = "smoothed",
) -> DataFrame:
    """Local polynomial smoothing; window = max(3, int(n * factor)), degree < window.

    The fit of a window is a sum over orthogonal polynomials of the sample, whose
    recurrence is known for any width, times the window's moments. A window is the end
    of one block of its width and the beginning of the next, so its moments come from
    running sums within blocks: the cost of a row does not depend on the width, and no
    task holds more than a block. The first and last half windows read the
    polynomials of the first and last whole one. A window with an unknown value (null
    or NaN) gives null. A window of three with degree two returns its input. Rows
    without a track keep their value.
    """
    if factor > 1:
        raise ValueError("the window cannot be longer than the track")
    track = list(track)
    value = F.col(col).cast("double")
    df = o.ordered(df, track, order, _rn=o.row_number(), _n=o.group_count())
    df = df.withColumn("_w", F.greatest(F.floor(F.col("_n") * F.lit(factor)), F.lit(3)).cast("long"))
    short = F.coalesce((F.col("_w") <= min(3, degree + 1)) | (F.col("_n") < 3), F.lit(True))
    plain = df.filter(short).withColumn(name, value)
    wide = df.filter(~short).withColumns({"_at": F.col("_rn") - 1, "_v": F.when(F.isnan(value), None).otherwise(value)})
    sums = _window_moments(wide.select(*track, "_at", "_w", "_v"), track, degree)
    w, at, half = F.col("_w"), F.col("_at"), F.floor(F.col("_w") / 2)
    first = F.when(at >= F.col("_n") - half, F.col("_n") - w).when(at < half, F.lit(0)).otherwise(at - half + (1 - w % 2))
    wide = wide.withColumn("_lo", first.cast("long")).withColumn("_hi", F.col("_lo") + w - 1)
    at_end = (at >= F.col("_n") - half) | (at < half)
    wide = wide.withColumn("_q", F.when(at_end, (at - F.col("_lo") - (w - 1) / 2) / w).otherwise(F.lit(0.0)))
    # how far the coordinate of each block lies from the window's, whose origin is its middle
    block = F.floor(F.col("_lo") / w)
    wide = wide.withColumn("_d1", (block * w - F.col("_lo") - (w - 1) / 2) / w)
    wide = wide.withColumns({"_d2": F.col("_d1") + 1, "_two": (block * w != F.col("_lo")).cast("double")})
    wide = _moment_weights(wide, degree)
    shift = lambda d, r: reduce(lambda x, y: x + y, [comb(m, r) * F.col(f"_c{m}") * _power(F.col(d), m - r) for m in range(r, degree + 1)])
    wide = wide.withColumns(
        {f"_a{r}": shift("_d1", r) for r in range(degree + 1)} | {f"_b{r}": F.col("_two") * shift("_d2", r) for r in range(degree + 1)}
    ).drop("_d1", "_d2", "_q", *[f"_c{m}" for m in range(degree + 1)])
    wide = wide.join(sums.select(*track, F.col("_at").alias("_lo"), "_from"), [*track, "_lo"])
    wide = wide.join(sums.select(*track, F.col("_at").alias("_hi"), "_upto"), [*track, "_hi"])
    terms = [F.col(f"_a{r}") * F.col("_from")[r] + F.col(f"_b{r}") * F.col("_upto")[r] for r in range(degree + 1)]
    unknown = F.col("_from")[degree + 1] + F.col("_two") * F.col("_upto")[degree + 1]
    done = wide.withColumn(name, F.when(unknown == 0, reduce(lambda x, y: x + y, terms)))
    both = plain.unionByName(done.select(*plain.columns))
    return both.withColumn(name, clip(name, low, high)).drop("_rn", "_n", "_w")


def points_along(shapes: DataFrame, shape: str, seq: str, x: str, y: str, step: float) -> DataFrame:
    """Points every ``step`` along each shape, with sequence and distance."""
    df, _ = o.shared_split(shapes, [shape], seq)
    df = o.ordered(df, [shape], [seq], _x=o.prev(x), _y=o.prev(y))
    far = F.sqrt(F.pow(F.col(x) - F.col("_x"), 2) + F.pow(F.col(y) - F.col("_y"), 2))
    df = df.withColumn("_d", F.coalesce(far, F.lit(0.0)))
    df = o.ordered(df, [shape], [seq], dist_shape_m=o.running_sum("_d"))
    out = resample_by_distance(df, [shape], [seq], step, "dist_shape_m", (x, y))
    return out.withColumnRenamed("point_no", "seq_id")


def trip_lines(
    stop_times: DataFrame, lookup: DataFrame, x: str, y: str, max_gap: float | None = None, min_stops: int = 5,
) -> DataFrame:
    """Stops of each (service, route, trip) in order, one row per point.

    With ``max_gap``, as for map matching: each trip's first stop goes, then
    trips with a gap at or above it or with fewer than ``min_stops`` left. Lines
    stay rows, so none grows without bound; :func:`as_lines` packs short ones.
    """
    order = ["stop_sequence", "stop_id"]
    df, done = o.shared_split(stop_times, ["trip_id"], order[0])
    df = o.ordered(df, ["trip_id"], order, _x=o.prev(x), _y=o.prev(y), _rn=o.row_number())
    if max_gap is not None:
        gap = F.sqrt(F.pow(F.col(x) - F.col("_x"), 2) + F.pow(F.col(y) - F.col("_y"), 2))
        df = df.withColumn("_gap", gap).filter("_rn > 1")
        df = o.ordered(df, ["trip_id"], order, _far=o.group_max("_gap"), _n=o.group_count())
        df = df.filter((F.col("_far") < max_gap) & (F.col("_n") >= min_stops))
    keys = ["service_id", "route_id", "trip_id"]
    return done(df).join(lookup, "trip_id").select(*keys, *order, F.col(x).alias("x"), F.col(y).alias("y")).distinct()


def as_lines(points: DataFrame) -> DataFrame:
    """The points of :func:`trip_lines` as one array per line, where lines are known to be short."""
    spot = F.struct("stop_sequence", "stop_id", "x", "y")
    lines = points.groupBy("service_id", "route_id", "trip_id").agg(F.sort_array(F.collect_list(spot)).alias("_l"))
    return lines.withColumn("line", F.transform("_l", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))).drop("_l")


def network_trajectories(
    trips: DataFrame, spans: DataFrame, shape_points: DataFrame, calendar: DataFrame | None, day, feed: Sequence[str],
    min_points: int = 3, exceptions: DataFrame | None = None,
) -> DataFrame:
    """A day's trips with their shape points and trip attributes, as one flat frame.

    Services of the day follow the calendar and its ``exceptions``. Trips without shape points, or with fewer than two or ``min_points`` of
    them, are left out.
    """
    active = day_services(trips, calendar, day, feed, exceptions)
    chosen = trips.join(active, [*feed, "service_id"]).join(spans, "trip_id")
    chosen = chosen.withColumn("t_day_of_week", F.lit(day.weekday()))
    points = o.with_group(shape_points, ["shape_id"], _n=F.count(F.lit(1)))
    points = points.filter(F.col("_n") >= max(2, min_points)).drop("_n")
    return chosen.join(points, "shape_id")


def enrich(
    points: DataFrame, track: Sequence[str], order: Sequence[str], epsg, centre: tuple, raster: DataFrame | None = None,
    origin: tuple[float, float, float, float] | None = None, t: str | None = None, method: str = "geodesic",
    start: str | None = None,
) -> DataFrame:
    """Trajectory points with step metrics, local coordinates and elevation.

    Without a time column the times are zero and the running time one, to be
    replaced by predictions. First rows are filled from the second.
    """
    from headway.operators.joins import sample_raster
    from headway.operators.tracks import fill_both

    timed = t is not None
    df = step_metrics(points if timed else points.withColumn("_t0", F.lit(0)), track, order, t=t or "_t0", method=method)
    if timed:
        begin = F.col(start) if start else F.col("_begin")
        df = df if start else o.with_group(df, track, _begin=F.min(t))
        df = df.withColumns({"calc_speed_m_s": ratio("calc_dist_m", "calc_time_s"), "cumul_time_s": F.col(t) - begin})
        df = df.drop("_begin")
    else:
        df = df.withColumns({"calc_time_s": F.lit(0.0), "calc_speed_m_s": F.lit(0.0), "cumul_time_s": F.lit(1.0)}).drop("_t0")
    df = fill_both(df, track, order, "calc_dist_m", "calc_bear_d", "calc_time_s", "calc_speed_m_s")
    df = geo.center_xy(geo.project(df, "lon", "lat", epsg), "x", "y", *centre)
    if raster is not None:
        df = sample_raster(df, raster, "x", "y", *origin, name="calc_elev_m")
    return df


def phone_trip(merged: DataFrame, trip: Sequence[str], t: str, chop: int = 0, tz: str = "UTC") -> tuple[DataFrame, DataFrame]:
    """Per-second sensor frame cut at both ends with elapsed time, and the trip's metadata.

    Weekdays count from Monday 0 as everywhere else.
    """
    from headway.operators.tracks import trim_track_ends

    points = trim_track_ends(merged, trip, [t], chop) if chop else merged
    points = o.with_group(points, trip, _t0=F.min(t)).withColumn("cumul_time_s", F.col(t) - F.col("_t0")).drop("_t0")
    meta = points.groupBy(*trip).agg(F.min(t).alias("start_epoch"), F.max(t).alias("end_epoch"))
    local = F.convert_timezone(F.lit("UTC"), F.lit(tz), F.to_timestamp_ntz(F.timestamp_seconds("start_epoch")))
    meta = meta.withColumn("_l", local).withColumns(
        {
            "t_day": F.to_date("_l"),
            "t_min_of_day": F.hour("_l") * 60 + F.minute("_l"),
            "t_day_of_week": F.weekday("_l"),
        }
    )
    return points, meta.drop("_l")


def match_traces(meta: DataFrame, traces: dict[str, DataFrame], key: str, t: str) -> DataFrame:
    """Traces of several sources cut to each trip's vehicle and epoch range, tagged by source.

    The vehicle and the day make an equi key; the exact range is a filter after.
    A trip over midnight is looked up under each of its days.
    """
    def day_of(c: str) -> Column:
        return F.floor(F.col(c) / 86400)

    trips = meta.withColumn("_day", F.explode(F.sequence(day_of("start_epoch"), day_of("end_epoch"))))
    out = []
    for name, df in traces.items():
        cut = df.withColumn("_day", day_of(t)).join(trips, [key, "_day"])
        cut = cut.filter(F.col(t).between(F.col("start_epoch"), F.col("end_epoch"))).drop("_day")
        out.append(cut.withColumn("source", F.lit(name)))
    first, *rest = out
    for df in rest:
        first = first.unionByName(df, allowMissingColumns=True)
    return first


def drive_cycle(
    df: DataFrame, track: Sequence[str], order: Sequence[str], factor: float = 1.0, speed: str = "pred_speed_m_s",
    t: str = "cumul_time_s", elev: str = "calc_elev_m", dist: str = "calc_dist_m",
) -> DataFrame:
    """Per-second speed and grade of each trip: the input of the energy step.

    Grade is elevation step over distance, filled both ways and bounded; speed
    passes the peak filter and the smoother, bounded to 0..35 m/s.
    """
    df, done = o.shared_split(df, track, order[0])
    df = grade(df, track, order, elev, dist)
    df = peak_filter(df, track, order, speed, 3, factor, factor, 0.0, 35.0, "_peaked")
    df = done(smooth(df, track, order, "_peaked", low=0.0, high=35.0, name="mps"))
    df = stage(df.select(*track, t, "mps", "grade"), "smoothed")
    return resample_by_second(df, track, t, ["mps", "grade"]).withColumnRenamed(t, "time_s")


def grade(df: DataFrame, track: Sequence[str], order: Sequence[str], elev: str, dist: str, limit: float = 0.15):
    """Elevation step over distance, gaps filled both ways, clipped."""
    df, done = o.shared_split(df, track, order[0])
    df = o.ordered(df, track, order, _e=o.prev(elev))
    step = F.when(F.col(elev).isNotNull(), F.col(elev) - F.coalesce("_e", elev))
    df = df.withColumn("_g", ratio(step, dist))
    df = o.ordered(df, track, order, _gf=o.last_known("_g"), _gb=o.next_known("_g"))
    return done(df).withColumn("grade", clip(F.coalesce("_gf", "_gb"), -limit, limit)).drop("_e", "_g", "_gf", "_gb")
