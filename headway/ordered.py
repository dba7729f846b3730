"""Ordered per-key calculations that stay balanced when one key is huge.

A plain ``Window.partitionBy(trip)`` sends all rows of a trip to one task. That
is right for nearly every trip and wrong for the one that holds a third of the
table. :func:`split_hot` finds keys above a row limit and cuts them into
consecutive runs of the order column; :func:`ordered` then computes inside
(key, run) and carries the running state from run to run through a small
aggregate, one row per run of a hot key. Hot keys are found when the plan runs; no
job starts while it is built. Where all the tables behind a frame together are no more
than a task can take (``TASK_BYTES``), any one key is too, and the plan is a plain
window, one shuffle and no carry.

Sizes that are broadcast: hot keys number at most rows / limit and their runs
at most a small multiple of that, whatever the data looks like.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUP_LIMIT = "spark.headway.maxGroupRows"
DEFAULT_GROUP_LIMIT = 4_000_000
#: Bytes of stored tables that one task can sort, spilling if need be.
TASK_BYTES = 256_000_000
_ALL = "_all"
_CUTS = 32


@dataclass(frozen=True)
class Calc:
    """How one output is made inside a run, per run, and across runs."""

    local: Callable[["_Frames"], Column]
    summary: Callable[[Column], Column]
    across: Callable[[Column, "_Frames"], Column]
    merge: Callable[[Column, Column], Column]


@dataclass(frozen=True)
class _Frames:
    up: object
    down: object
    whole: object

    @property
    def so_far(self):
        return self.up.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def to_come(self):
        return self.down.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def before(self):
        return self.up.rowsBetween(Window.unboundedPreceding, -1)

    @property
    def after(self):
        return self.down.rowsBetween(Window.unboundedPreceding, -1)


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def prev(col) -> Calc:
    """Value on the previous row of the key."""
    box = F.struct(_c(col).alias("v"))
    return Calc(
        lambda f: F.lag(box).over(f.up),
        lambda o: F.max_by(box, o),
        lambda s, f: F.lag(s).over(f.up),
        lambda a, b: F.coalesce(a, b)["v"],
    )


def following(col) -> Calc:
    """Value on the next row of the key."""
    box = F.struct(_c(col).alias("v"))
    return Calc(
        lambda f: F.lead(box).over(f.up),
        lambda o: F.min_by(box, o),
        lambda s, f: F.lead(s).over(f.up),
        lambda a, b: F.coalesce(a, b)["v"],
    )


def row_number() -> Calc:
    """Position in the key, from 1."""
    return Calc(
        lambda f: F.row_number().over(f.up).cast("long"),
        lambda o: F.count(F.lit(1)),
        lambda s, f: F.sum(s).over(f.before),
        lambda a, b: a + F.coalesce(b, F.lit(0)),
    )


def running_sum(col) -> Calc:
    """Sum of the rows up to and including this one, nulls ignored."""
    return Calc(
        lambda f: F.sum(_c(col)).over(f.so_far),
        lambda o: F.sum(_c(col)),
        lambda s, f: F.sum(s).over(f.before),
        lambda a, b: F.coalesce(a + b, a, b),
    )


def running_max(col) -> Calc:
    """Largest value so far."""
    return Calc(
        lambda f: F.max(_c(col)).over(f.so_far),
        lambda o: F.max(_c(col)),
        lambda s, f: F.max(s).over(f.before),
        lambda a, b: F.greatest(a, b),
    )


def last_known(col) -> Calc:
    """Latest non-null value up to and including this row."""
    return Calc(
        lambda f: F.last(_c(col), ignorenulls=True).over(f.so_far),
        lambda o: F.max_by(_c(col), F.when(_c(col).isNotNull(), o)),
        lambda s, f: F.last(s, ignorenulls=True).over(f.before),
        lambda a, b: F.coalesce(a, b),
    )


def next_known(col) -> Calc:
    """Earliest non-null value from this row on."""
    return Calc(
        lambda f: F.last(_c(col), ignorenulls=True).over(f.to_come),
        lambda o: F.min_by(_c(col), F.when(_c(col).isNotNull(), o)),
        lambda s, f: F.last(s, ignorenulls=True).over(f.after),
        lambda a, b: F.coalesce(a, b),
    )


def first_row(col) -> Calc:
    """Value on the first row of the key, on every row."""
    box = F.struct(_c(col).alias("v"))
    return Calc(
        lambda f: F.first(box).over(f.so_far),
        lambda o: F.min_by(box, o),
        lambda s, f: F.first(s).over(f.so_far),
        lambda a, b: F.coalesce(b, a)["v"],
    )


def last_row(col) -> Calc:
    """Value on the last row of the key, on every row."""
    box = F.struct(_c(col).alias("v"))
    return Calc(
        lambda f: F.first(box).over(f.to_come),
        lambda o: F.max_by(box, o),
        lambda s, f: F.first(s).over(f.to_come),
        lambda a, b: F.coalesce(b, a)["v"],
    )


def _over_group(agg: Callable[[Column], Column], col, again=None) -> Calc:
    again = again or agg
    return Calc(
        lambda f: agg(_c(col)).over(f.whole),
        lambda o: agg(_c(col)),
        lambda s, f: again(s).over(f.whole),
        lambda a, b: F.coalesce(b, a),
    )


def group_min(col) -> Calc:
    return _over_group(F.min, col)


def group_max(col) -> Calc:
    return _over_group(F.max, col)


def group_sum(col) -> Calc:
    return _over_group(F.sum, col)


def group_count() -> Calc:
    return _over_group(F.count, F.lit(1), F.sum)


def row_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(GROUP_LIMIT, str(DEFAULT_GROUP_LIMIT)))


def _input_bytes(df: DataFrame) -> int:
    """Size of the tables behind the frame, as the planner knows it before any job; very large where it does not."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def _splits(df: DataFrame) -> bool:
    """Whether a plan for the frame provides for hot keys: always where the limit is set, else unless its tables are small as a whole."""
    return df.sparkSession.conf.get(GROUP_LIMIT, None) is not None or _input_bytes(df) > TASK_BYTES


def _match(keys: Sequence[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k) == F.col(f"{prefix}{i}") for i, k in enumerate(keys)])


def _renamed(keys: Sequence[str], prefix: str) -> list[Column]:
    return [F.col(k).alias(f"{prefix}{i}") for i, k in enumerate(keys)]


def _run_names(keys: Sequence[str], order: str) -> tuple[str, str]:
    tag = "_".join([*keys, order])
    return f"_run_{tag}", f"_hot_{tag}"


def split_hot(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Add the run number: 0 for ordinary keys, 1.. in order for hot keys.

    Runs are cut at approximate quantiles of the numeric ``order`` column, so
    uneven density in time does not matter, and each quantile band is divided
    again until a run is near the limit: ``spark.headway.maxGroupRows``, four million
    by default. The keys above it are found when the plan runs, no job is started
    while it is built. Rows without a key belong to no track and are scattered over
    negative runs.

    :func:`ordered` does this on its own. Call it first when several ordered
    steps on one key and order follow each other: they then share one split
    and one shuffle. :func:`drop_runs` takes the columns off again.
    """
    keys = list(keys)
    run_name, hot_name = _run_names(keys, order)
    if not keys:
        df, keys = df.withColumn(_ALL, F.lit(0)), [_ALL]
    t = F.col(order).cast("double")
    no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    scattered = F.when(no_key, -1 - F.pmod(F.xxhash64(order), F.lit(4096)))
    if not _splits(df):
        return df.withColumn(run_name, scattered.otherwise(F.lit(0)).cast("long")).drop(_ALL)
    limit = row_limit(df)
    hot = (
        df.filter(~no_key)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > limit)
        .select(*_renamed(keys, "_h"), "_n")
    )
    marks = [i / _CUTS for i in range(_CUTS + 1)]
    names = [f"_h{i}" for i in range(len(keys))]
    cuts = (
        df.select(*keys, t.alias("_t"))
        .join(F.broadcast(hot), _match(keys, "_h"))
        .groupBy(*names, "_n")
        .agg(F.percentile_approx("_t", F.array(*[F.lit(m) for m in marks]), 10000).alias("_cuts"))
        .select(*names, "_cuts", F.ceil(F.col("_n") / (_CUTS * limit)).alias("_parts"), F.lit(True).alias(hot_name))
    )
    df = df.join(F.broadcast(cuts), _match(keys, "_h"), "left")
    df = df.withColumn("_band", F.when(F.col("_cuts").isNotNull(), F.size(F.filter("_cuts", lambda c: c < t))))
    band = F.col("_band")
    low = F.try_element_at("_cuts", band)
    high = F.try_element_at("_cuts", band + 1)
    share = F.try_divide(t - low, high - low)
    inner = F.when(
        (band >= 1) & share.isNotNull(),
        F.least(F.floor(share * F.col("_parts")), F.col("_parts") - 1),
    ).otherwise(F.lit(0))
    run = (
        scattered.when(band.isNull(), F.lit(0))
        .when(t.isNull(), F.lit(1))
        .otherwise(1 + band * F.col("_parts") + inner)
        .cast("long")
    )
    return df.withColumn(run_name, run).drop(*names, "_cuts", "_parts", "_band", _ALL)


def drop_runs(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    return df.drop(*_run_names(keys, order))


def shared_split(df: DataFrame, keys: Sequence[str], order: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """One split for several ordered steps, and the call that ends it.

    A split made further up is used as it is and stays for the caller.
    """
    if _run_names(keys, order)[0] in df.columns:
        return df, lambda out: out
    return split_hot(df, keys, order), lambda out: drop_runs(out, keys, order)


def ordered(df: DataFrame, keys: Sequence[str], order: Sequence[str], **calcs: Calc) -> DataFrame:
    """Add one column per calculation, rows of a key taken in ``order``.

    ``order[0]`` must be numeric (epoch seconds, metres, a count); the rest
    breaks ties. Run columns from :func:`split_hot` on the same key and order
    are reused and kept.
    """
    keys, order = list(keys), list(order)
    run, hot = _run_names(keys, order[0])
    base = df if run in df.columns else split_hot(df, keys, order[0])
    if not keys:
        base, keys = base.withColumn(_ALL, F.lit(0)), [_ALL]
    # The hot flag follows from the key; with it among the partition keys the
    # filter below can sink through earlier steps, down to the scan.
    split = hot in base.columns
    inside = Window.partitionBy(*keys, run, hot) if split else Window.partitionBy(*keys, run)
    frames = _Frames(
        inside.orderBy(*[F.col(o).asc() for o in order]),
        inside.orderBy(*[F.col(o).desc() for o in order]),
        inside,
    )
    rows = base.select("*", *[calc.local(frames).alias(f"_l_{name}") for name, calc in calcs.items()])

    if not split:
        return rows.select(
            *[c for c in df.columns if c not in calcs],
            *[F.when(F.col(run) >= 0, calc.merge(F.col(f"_l_{n}"), F.lit(None))).alias(n) for n, calc in calcs.items()],
        )

    stamp = F.struct(*order)
    names = [f"_k{i}" for i in range(len(keys))]
    runs = (
        base.filter(hot)
        .groupBy(*_renamed(keys, "_k"), F.col(run).alias("_krun"))
        .agg(*[calc.summary(stamp).alias(f"_s_{name}") for name, calc in calcs.items()])
    )
    by_key = Window.partitionBy(*names)
    chain = _Frames(by_key.orderBy("_krun"), by_key.orderBy(F.desc("_krun")), by_key)
    carry = runs.select(
        *names, "_krun", *[calc.across(F.col(f"_s_{name}"), chain).alias(f"_c_{name}") for name, calc in calcs.items()]
    )
    joined = rows.join(F.broadcast(carry), _match(keys, "_k") & (F.col(run) == F.col("_krun")), "left")
    keyed = F.col(run) >= 0
    return joined.select(
        *[c for c in df.columns if c not in calcs],
        *[
            F.when(keyed, calc.merge(F.col(f"_l_{name}"), F.col(f"_c_{name}"))).alias(name)
            for name, calc in calcs.items()
        ],
    )


def with_group(df: DataFrame, keys: Sequence[str], few: bool = False, **aggs: Column) -> DataFrame:
    """Group aggregates on every row: combine before the shuffle, join back.

    Unlike a whole-partition window this lets the runtime split a hot key. Of keys that
    are ``few`` whatever the data (days, networks) the totals go to the rows, which stay
    where they are.
    """
    keys = list(keys)
    names = [f"_g{i}" for i in range(len(keys))]
    totals = df.groupBy(*_renamed(keys, "_g")).agg(*[a.alias(n) for n, a in aggs.items()])
    totals = F.broadcast(totals) if few else totals
    return df.drop(*aggs).join(totals, _match(keys, "_g"), "left").drop(*names)
