"""Centroid clustering against a search through all centroids, on awkward input too."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from headway.llm import centroids as ce

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, distance long, v string, h string"
DOUBLES = SCHEMA.replace("float", "double")


def squared(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def by_hand(rows, k=16, rounds=3, dim=64):
    kept = [(i, tuple(math.floor(64 * Fraction(x)) for x in v)) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centres = [v for _, v in named[:k]]

    def nearest(v):
        return min((squared(v, c), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(centres)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                centres[j] = tuple(sum(c) // len(mine) for c in zip(*mine))
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    fit = lambda n: n if n < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(
        ((i, j, fit(d), fit(sum(e for _, o, e in found if o == j)), fit(sum(e for *_, e in found)), digest[j]) for i, j, d in found), key=repr
    )


def vectors(n, seed, spread=1.0, step=None):
    v = np.random.default_rng(seed).normal(0, spread, (n, 64)).astype(np.float32)
    return [(i, (np.round(x / step) * step if step else x).tolist()) for i, x in enumerate(v)]


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v, 1, 7, 8, "x", "y") for i, v in rows], schema).repartition(3)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_clusters_against_all_distances(spark):
    rows = vectors(400, 1)
    assert result(ce.cluster(frame(spark, rows))) == by_hand(rows)


def test_ties_repeats_and_rows_left_out(spark):
    rows = vectors(60, 2, step=1.0) + vectors(60, 2, step=1.0)  # every vector twice, on a coarse grid
    rows += [(5, [0.0] * 64), (None, [1.0] * 64), (None, [-0.01] * 64), (900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65)]
    rows += [(904, [math.nan] + [0.0] * 63), (905, [math.inf] + [0.0] * 63), (906, [None] + [0.0] * 63), (907, [-math.inf] * 64)]
    assert result(ce.cluster(frame(spark, rows))) == by_hand(rows)


def test_equal_centroids_leave_one_empty(spark):
    rows = [(i, [1.0] * 64) for i in range(20)]
    got = result(ce.cluster(frame(spark, rows)))
    assert got == by_hand(rows) and {r[1] for r in got} == {0}


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = vectors(5, 3)
    assert result(ce.cluster(frame(spark, rows))) == by_hand(rows)
    none = ce.cluster(frame(spark, []))
    assert none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and none.count() == 0


@pytest.mark.parametrize("size", [3e6, 3e20, 1e307])
def test_wide_numbers_stay_exact(spark, size):
    rows = [(i, [x * size / 4 for x in v]) for i, v in vectors(40, 4)]
    assert result(ce.cluster(frame(spark, rows, DOUBLES))) == by_hand(rows)


@pytest.mark.parametrize("kind", [np.int64, object])
def test_search_finds_the_nearest_and_skips(kind):
    rng = np.random.default_rng(5)
    centres = rng.integers(-400, 400, (40, 8))
    centres[7] = centres[3]
    x = (centres[rng.integers(0, 40, 500)] + rng.integers(-30, 30, (500, 8))).astype(kind)
    best, distance, measured = ce.nearest(x, centres.astype(kind))
    want = [min((squared(a, c), j) for j, c in enumerate(centres.tolist())) for a in x.tolist()]
    assert list(zip(distance.tolist(), best.tolist())) == want
    assert measured < 500 * 40 / 2
    for start in range(3):
        again, _, _ = ce.nearest(x, centres.astype(kind), np.full(500, start))
        assert again.tolist() == best.tolist()
