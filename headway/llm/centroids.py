"""Centroid clustering of integer vectors, nearest centroids by Orchard's search.

Every centroid has the list of all centroids by distance from it. A vector starts at
one centroid and walks that centroid's list; where it meets a closer one it goes on
with that one's list, and it never measures a centroid twice. Once the list's next
centroid is strictly beyond twice the current distance, nothing further down can be
as close, ties included. The search runs over the vectors of a batch at once.

A round is one pass: tasks add up their vectors by centroid, sums meet by centroid,
and k centroids come back to the driver. The bound of what is broadcast is k times
the number of components.

Defined cases: vectors of another length, null vectors and vectors with a null or
non-finite component are left out; a null ``vec_id`` counts as an empty one where the
first centroids are chosen and stays null; rows that repeat an id are vectors of their
own, equal ids order by their vectors; of two equal centroids the smaller number wins
and the other one stays empty and where it is; fewer than k vectors make fewer
centroids; distances and sums that do not fit a long are null, the search stays exact;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headway.llm.tables import map_batches, stage

DIM, SCALE, K, ROUNDS = 64, 64, 16, 3
SLICE = 8192
#: Components below this square and add up in 64 bits.
NARROW = 1 << 27
LONG_MAX = (1 << 63) - 1


def kept(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """vec_id and the vector as doubles, of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter((F.size("v") == dim) & sound)


def integers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), as Python integers where 64 bits might not do."""
    if not len(x) or np.abs(x).max() < NARROW / scale:
        return np.floor(x * scale).astype(np.int64)
    exact = lambda a: int(a) * scale if abs(a) >= 2.0**52 else math.floor(a * scale)
    return np.array([[exact(a) for a in row] for row in x.tolist()], dtype=object)


def _together(x: np.ndarray, centroids: list[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and centroids as 64-bit integers if all are small, else as Python integers."""
    wide = x.dtype == object or any(abs(a) >= NARROW for c in centroids for a in c)
    kind = object if wide else np.int64
    return x.astype(kind), np.array(centroids, dtype=kind).reshape(len(centroids), -1)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    difference = a - b
    return (difference * difference).sum(axis=-1) if difference.dtype == object else np.einsum("...i,...i->...", difference, difference)


def neighbours(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per centroid all centroids by distance from it, then by number; and the distances."""
    gaps = np.stack([_squared(centroids, c) for c in centroids])
    lists = np.array([sorted(range(len(row)), key=lambda j: (row[j], j)) for row in gaps.tolist()])
    return lists, gaps


def nearest(x: np.ndarray, centroids: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of each vector's nearest centroid, ties to the smaller number; and how many distances were measured."""
    n, k = len(x), len(centroids)
    lists, gaps = neighbours(centroids)
    best = _guess(x, centroids) if start is None else start.copy()
    distance = _squared(x, centroids[best])
    seen = np.zeros((n, k), bool)
    seen[np.arange(n), best] = True
    at = np.zeros(n, np.int64)
    live, measured = np.arange(n), n
    while len(live):
        j = lists[best[live], at[live]]
        # gap > 4 * distance, without leaving 64 bits: beyond twice the distance before squaring
        near = ((gaps[best[live], j] - 1) // 4 < distance[live]).astype(bool)
        live, j = live[near], j[near]
        at[live] += 1
        fresh = ~seen[live, j]
        row, j = live[fresh], j[fresh]
        seen[row, j] = True
        measured += len(row)
        d = _squared(x[row], centroids[j])
        closer = ((d < distance[row]) | ((d == distance[row]) & (j < best[row]))).astype(bool)
        row, j, d = row[closer], j[closer], d[closer]
        best[row], distance[row], at[row] = j, d, 0
        live = live[at[live] < k]
    return best, distance, measured


def _guess(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Where a search starts: the centroid whose components add up most alike."""
    total = centroids.sum(axis=1)
    order = np.array(sorted(range(len(total)), key=lambda j: (total[j], j)))
    wanted = x.sum(axis=1)
    right = np.minimum(np.searchsorted(total[order], wanted), len(order) - 1)
    left = np.maximum(right - 1, 0)
    nearer = (abs(total[order][left] - wanted) <= abs(total[order][right] - wanted)).astype(bool)
    return order[np.where(nearer, left, right)]


def _vectors(column: pa.Array, dim: int):
    """The vectors of a batch as floats, in slices."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    for i in range(0, len(flat), SLICE):
        yield i, flat[i : i + SLICE]


def first_centroids(rows: DataFrame, k: int = K, seed: int = 1, scale: int = SCALE) -> list[tuple[int, ...]]:
    """The vectors whose ``seed:vec_id`` hash smallest."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    got = rows.select("v", F.sha2(name, 256).alias("h")).orderBy("h", "v").limit(k).collect()
    return [tuple(int(a) for a in integers(np.array([r["v"]]), scale)[0]) for r in got]


def _sums(rows: DataFrame, centroids: list[tuple[int, ...]], scale: int) -> dict[int, tuple[int, list[int]]]:
    """Number and sum of the vectors of every centroid that has any."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)
    dim = len(centroids[0])

    def run(batches):
        count, sums = {}, {}
        for b in batches:
            for _, part in _vectors(b.column(0), dim):
                x, c = _together(integers(part, scale), shared.value)
                best = nearest(x, c)[0]
                for j in np.unique(best).tolist():
                    mine = x[best == j]
                    count[j] = count.get(j, 0) + len(mine)
                    total = [int(a) for a in mine.sum(axis=0)]
                    sums[j] = [a + b for a, b in zip(sums[j], total)] if j in sums else total
        if count:
            yield {"cluster": list(count), "n": list(count.values()), "sums": [[str(a) for a in sums[j]] for j in count]}

    def add(group: pa.Table) -> pa.Table:
        totals = reduce(lambda a, b: [x + y for x, y in zip(a, b)], ([int(a) for a in row] for row in group.column("sums").to_pylist()))
        columns = [group.column("cluster")[:1], pa.array([sum(group.column("n").to_pylist())]), pa.array([[str(a) for a in totals]])]
        return pa.Table.from_arrays(columns, names=["cluster", "n", "sums"])

    schema = "cluster int, n long, sums array<string>"
    parts = map_batches(rows.select("v"), run, schema)
    # sums of a centroid meet in two steps, so that no task has those of all others
    some = parts.groupBy("cluster", F.spark_partition_id() % 64).applyInArrow(add, schema)
    got = some.groupBy("cluster").applyInArrow(add, schema).collect()
    return {r["cluster"]: (r["n"], [int(a) for a in r["sums"]]) for r in got}


def fit(rows: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = 1, scale: int = SCALE) -> list[tuple[int, ...]]:
    """The centroids after the given number of rounds."""
    centroids = first_centroids(rows, k, seed, scale)
    for _ in range(rounds if centroids else 0):
        sums = _sums(rows, centroids, scale)
        centroids = [tuple(a // sums[j][0] for a in sums[j][1]) if j in sums else c for j, c in enumerate(centroids)]
    return centroids


def assign(rows: DataFrame, centroids: list[tuple[int, ...]], scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance of every row; the squared distance is null beyond a long."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        for b in batches:
            for i, part in _vectors(b.column(1), len(shared.value[0])):
                x, c = _together(integers(part, scale), shared.value)
                best, distance, _ = nearest(x, c)
                yield {"vec_id": b.column(0)[i : i + len(part)], "cluster": best.astype(np.int32), "distance": [d if d <= LONG_MAX else None for d in distance.tolist()]}

    schema = "vec_id long, cluster int, distance long"
    if not centroids:
        return rows.sparkSession.createDataFrame([], schema)
    return map_batches(rows.select("vec_id", "v"), run, schema)


def _whole(column: str, over=None):
    """A sum as a long, null where it or a part of it is beyond one."""
    total, known, rows = F.sum(F.col(column).cast("decimal(38,0)")), F.count(column), F.count(F.lit(1))
    if over is not None:
        total, known, rows = total.over(over), known.over(over), rows.over(over)
    return F.when((known == rows) & (total <= F.lit(LONG_MAX).cast("decimal(38,0)")), total.cast("long"))


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = 1, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and the digest of the cluster's final centroid."""
    rows = kept(vectors, dim)
    centroids = fit(rows, k, rounds, seed, scale)
    found = stage(assign(rows, centroids, scale), "assigned")
    own = found.groupBy("cluster").agg(_whole("distance").alias("cluster_inertia"))
    digests = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids)]
    digests = found.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")
    # at most k rows from here on
    own = own.withColumn("inertia", _whole("cluster_inertia", over=Window.partitionBy()))
    per_cluster = own.join(F.broadcast(digests), "cluster")
    return found.join(F.broadcast(per_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
