"""Position feeds as streams: the polling loop and the daily roll-up.

Every query here is one checkpointed Structured Streaming job. A file is read
once because the checkpoint remembers it; state is bounded by the watermark or
by a time to live.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 24 * 3600 * 1000


def stream_positions(
    spark: SparkSession, path: str, schema, glob: str | None = None, max_files: int | None = None
) -> DataFrame:
    """New files of a folder as they arrive, at most ``max_files`` per trigger."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def stream_dedup(df: DataFrame, keys: Sequence[str], ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """The first of each repeated report; a key is remembered for the lateness limit."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def stream_daily(df: DataFrame, by: Sequence[str], ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """Daily totals per key, emitted once no report of the day can still arrive."""
    day = F.window(ts, "1 day")
    out = df.withWatermark(ts, delay).groupBy(day.alias("w"), *by).agg(
        F.count(F.lit(1)).alias("n_points"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")
    )
    return out.select(F.to_date("w.start").alias("service_day"), *by, "n_points", "first_ts", "last_ts")


def stream_cell_speed(
    df: DataFrame, cell: Sequence[str], speed: str, ts: str = "ts", width: str = "1 minute", delay: str = "1 day"
) -> DataFrame:
    """Mean speed per window and grid cell."""
    out = df.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"), *cell).agg(
        F.avg(speed).alias("speed"), F.count(F.lit(1)).alias("n")
    )
    return out.select(F.col("w.start").alias("start"), *cell, "speed", "n")


def stream_trip_sessions(df: DataFrame, key: Sequence[str], gap: str = "5 minutes", ts: str = "ts", delay: str = "1 day"):
    """Runs of points of a trip without a longer gap."""
    out = df.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), *key).agg(F.count(F.lit(1)).alias("n_points"))
    return out.select(*key, F.col("w.start").alias("start"), F.col("w.end").alias("finish"), "n_points")


def _haversine_m(lon1, lat1, lon2, lat2):
    lon1, lat1, lon2, lat2 = map(np.radians, (lon1, lat1, lon2, lat2))
    chord = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return 2 * 6371000 * np.arcsin(np.sqrt(np.minimum(chord, 1.0)))


class _InOrder(StatefulProcessor):
    """Rows of a key held back by event time and taken up in order.

    A row waits in the bucket of its ``bucket_s`` seconds, whose rows are map entries,
    one per arriving batch, so that nothing that waits is written again. When the
    watermark has passed a bucket's end no row of it can come any more, whatever the
    order of arrival was, and all such buckets are worked off, earliest first, in one
    call. The state is read and written per bucket and batch, not per row. Memory is
    that of a key's bucket. Rows behind the watermark never arrive here.
    """

    #: Columns of a waiting row besides the time and event_id, and their types.
    fields: dict[str, T.DataType] = {}

    def __init__(self, bucket_s: int, keep_ms: int) -> None:
        self.bucket_s, self.keep_ms = bucket_s, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        held = T.StructType().add("t", T.ArrayType(T.LongType())).add("event_id", T.ArrayType(T.LongType()))
        for name, kind in self.fields.items():
            held = held.add(name, T.ArrayType(kind))
        self.waiting = handle.getMapState("waiting", T.StructType().add("bucket", T.LongType()).add("part", T.LongType()), held)
        self.open = handle.getValueState("open", T.StructType().add("bucket", T.ArrayType(T.LongType())).add("parts", T.ArrayType(T.LongType())))
        self.past = handle.getValueState("past", self.past_schema())

    def past_schema(self) -> T.StructType:
        raise NotImplementedError

    def work_off(self, key, rows: pd.DataFrame, past) -> tuple[pd.DataFrame, tuple, int]:
        """Output for the rows of a bucket, in order; what later rows need to know; its newest second."""
        raise NotImplementedError

    def forget(self, past, now_ms: int):
        """What is left of ``past`` for rows from ``now_ms`` on."""
        raise NotImplementedError

    def ends_ms(self, bucket: int) -> int:
        return (bucket + 1) * self.bucket_s * 1000

    def parts(self) -> dict[int, int]:
        """The buckets in which rows wait, and how many entries each has."""
        return dict(zip(*self.open.get())) if self.open.exists() else {}

    def leave_open(self, parts: dict[int, int]) -> None:
        if parts:
            self.open.update((list(parts), list(parts.values())))
            self.handle.registerTimer(self.ends_ms(min(parts)))
        else:
            self.open.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = ["locationtime", "event_id", *self.fields]
        parts = self.parts()
        for df in rows:
            for bucket, part in df.groupby(df["locationtime"] // self.bucket_s)[names]:
                bucket, new = int(bucket), [part[n].astype(object).where(part[n].notna(), None).tolist() for n in names]
                self.waiting.updateValue((bucket, parts.get(bucket, 0)), tuple(new))
                parts[bucket] = parts.get(bucket, 0) + 1
        if parts:
            self.leave_open(parts)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        parts = self.parts()
        due = sorted(b for b in parts if self.ends_ms(b) <= now)
        past = self.past.get() if self.past.exists() else None
        newest = None
        for bucket in due:
            entries = [self.waiting.getValue((bucket, i)) for i in range(parts[bucket])]
            names = ["locationtime", "event_id", *self.fields]
            rows = pd.DataFrame({n: [v for e in entries for v in e[i]] for i, n in enumerate(names)})
            rows = rows.sort_values(["locationtime", "event_id"], ignore_index=True)
            out, past, newest = self.work_off(key, rows, past)
            for i in range(parts.pop(bucket)):
                self.waiting.removeKey((bucket, i))
            yield out
        if due:
            self.leave_open(parts)
        # a row that waits or comes lies in a bucket that ends after the watermark
        left = None if past is None else self.forget(past, now - self.bucket_s * 1000)
        if left is not None:
            self.past.update(left)
        elif past is not None:
            self.past.clear()
        if newest is not None and left is not None:
            # a row this much later starts anew; the bucket it waits in must be over before the past goes
            self.handle.registerTimer((newest + self.bucket_s) * 1000 + self.keep_ms + 1)

    def close(self) -> None:
        pass


class _Steps(_InOrder):
    """Each point against the one before it on the trip. A key is a group of trips, so that a call works off many trips' rows at once."""

    fields = {"trip_id": T.StringType(), "lon": T.DoubleType(), "lat": T.DoubleType()}

    def past_schema(self) -> T.StructType:
        last = T.StructType().add("trip_id", T.ArrayType(T.StringType())).add("t", T.ArrayType(T.LongType()))
        return last.add("lon", T.ArrayType(T.DoubleType())).add("lat", T.ArrayType(T.DoubleType()))

    def work_off(self, key, rows, past):
        names = ["trip_id", "locationtime", "lon", "lat"]
        before = pd.DataFrame(dict(zip(names, map(list, past or ([],) * 4))))
        both = pd.concat([before.astype(object), rows.astype(object)], ignore_index=True)
        trip = pd.factorize(both["trip_id"], use_na_sentinel=False)[0]
        order = np.argsort(trip, kind="stable")  # a trip's last point, then its rows, which are in order
        trip, both = trip[order], both.iloc[order].reset_index(drop=True)
        t, lon, lat = (both[c].astype("float64") for c in names[1:])
        first = np.append(True, trip[1:] != trip[:-1])
        t0, lon0, lat0 = (v.shift().mask(first) for v in (t, lon, lat))
        far = (t - t0) * 1000 > self.keep_ms
        out = both[["trip_id", "event_id"]].copy()
        out["calc_dist_m"] = _haversine_m(lon0, lat0, lon, lat).where(~far)
        out["calc_time_s"] = (t - t0).where(~far)
        out = out[order >= len(before)].astype({"event_id": rows["event_id"].dtype})
        last = both[np.append(trip[1:] != trip[:-1], True)]
        held = tuple([None if pd.isna(v) else v for v in last[c]] for c in names)
        return out, (held[0], [int(v) for v in held[1]], *held[2:]), int(rows["locationtime"].iloc[-1])

    def forget(self, past, now_ms):
        stay = [i for i, t in enumerate(past[1]) if now_ms - t * 1000 <= self.keep_ms]
        return tuple([column[i] for i in stay] for column in past) if stay else None


def stream_step_metrics(
    df: DataFrame, ts: str = "ts", delay: str = "1 day", keep_ms: int = DAY_MS, bucket_s: int = 3600, groups: int = 64
) -> DataFrame:
    """Distance and time since the trip's previous point, whatever the order of arrival.

    Input has trip_id, event_id, locationtime (the event time in whole seconds), lon,
    lat and the event time. A step leaves when the watermark has passed the bucket of
    its later point; points of one second go by event_id. A point more than
    ``keep_ms`` after the one before it starts the trip anew, and a trip's last point
    is forgotten by then. Points later than ``delay`` are dropped. Trips share state in
    ``groups`` by hash: calls and state entries number groups times buckets, however
    many trips there are.
    """
    out = "trip_id string, event_id long, calc_dist_m double, calc_time_s double"
    group = F.pmod(F.xxhash64("trip_id"), F.lit(groups)).alias("trip_group")
    cols = df.withWatermark(ts, delay).select(group, "trip_id", "event_id", "locationtime", "lon", "lat", ts)
    return cols.groupBy("trip_group").transformWithStateInPandas(
        statefulProcessor=_Steps(bucket_s, keep_ms), outputStructType=out, outputMode="Append", timeMode="EventTime"
    )


class _RecentInCell(_InOrder):
    """The last n observations of a cell before each point's second."""

    fields = {"speed_m_s": T.DoubleType()}

    def __init__(self, n: int, bucket_s: int, keep_ms: int) -> None:
        super().__init__(bucket_s, keep_ms)
        self.n = n

    def past_schema(self) -> T.StructType:
        return T.StructType().add("newest", T.LongType()).add("t", T.ArrayType(T.LongType())).add("v", T.ArrayType(T.DoubleType()))

    def work_off(self, key, rows, past):
        own = rows["locationtime"].to_numpy("int64")
        t = np.concatenate([np.asarray(past[1] if past else [], dtype="int64"), own])
        v = np.concatenate([np.asarray(past[2] if past else [], dtype="float64"), rows["speed_m_s"].to_numpy("float64")])
        # rows of one second do not see each other; nothing older than the limit is seen
        upto = np.searchsorted(t, own, side="left")
        oldest = np.searchsorted(t, own - self.keep_ms // 1000, side="left")
        recent = [[None if np.isnan(x) else float(x) for x in v[max(low, high - self.n) : high][::-1]] for low, high in zip(oldest, upto)]
        out = pd.DataFrame({"xbin": key[0], "ybin": key[1], "event_id": rows["event_id"], "recent": recent})
        # buckets end at whole seconds: no later row shares the newest second, so n are enough
        ring = [None if np.isnan(x) else float(x) for x in v[-self.n :]]
        return out, (int(t[-1]), t[-self.n :].tolist(), ring), int(t[-1])

    def forget(self, past, now_ms):
        return None if now_ms - past[0] * 1000 > self.keep_ms else past


def stream_recent_in_cell(
    df: DataFrame, n: int = 4, ts: str = "ts", delay: str = "1 day", keep_ms: int = DAY_MS, bucket_s: int = 3600
) -> DataFrame:
    """The last ``n`` speeds seen in each point's cell strictly before it, whatever the order of arrival.

    Input has xbin, ybin, event_id, locationtime (the event time in whole seconds),
    speed_m_s and the event time. A row leaves when the watermark has passed its
    bucket; observations more than ``keep_ms`` older than a point are not seen by it.
    Points later than ``delay`` are dropped.
    """
    out = "xbin long, ybin long, event_id long, recent array<double>"
    cols = df.withWatermark(ts, delay).select("xbin", "ybin", "event_id", "locationtime", "speed_m_s", ts)
    return cols.groupBy("xbin", "ybin").transformWithStateInPandas(
        statefulProcessor=_RecentInCell(n, bucket_s, keep_ms), outputStructType=out, outputMode="Append", timeMode="EventTime"
    )


def run_available(df: DataFrame, path: str, checkpoint: str, by: Sequence[str] = ()):
    """Process what has arrived, append to Parquet exactly once, stop. Returns the finished query."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    if by:
        writer = writer.partitionBy(*by)
    query = writer.outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def rows_dropped(query) -> int:
    """Rows that came after the watermark, over all progress reports of a query."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
