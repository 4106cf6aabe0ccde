import hashlib
import math
import random

import numpy as np
import pytest

from stocklens.llm import clusters

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, rounds, dimensions, salt="2:"):
    """(vec_id, cluster, distance) and centroids by comparing every vector with every centroid in whole numbers."""
    kept = [(i, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, *_ in rows
            if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]

    def key(row):
        return hashlib.sha256(f"{salt}{'' if row[0] is None else row[0]}".encode()).hexdigest(), row[1]

    centroids = [v for _, v in sorted(kept, key=key)[:k]]

    def nearest():
        out = []
        for i, v in kept:
            d, c = min((sum((a - b) ** 2 for a, b in zip(v, w)), j) for j, w in enumerate(centroids))
            out.append((i, c, d))
        return out

    for _ in range(rounds):
        to = [c for _, c, _ in nearest()]
        for j in range(len(centroids)):
            own = [v for (_, v), c in zip(kept, to) if c == j]
            if own:
                centroids[j] = tuple(sum(x) // len(own) for x in zip(*own))
    return (nearest() if kept else []), centroids


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def random_rows(seed, n, dimensions, spread=1.0):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(dimensions)] for _ in range(9)]
    return [(i, [float(np.float32(m + rng.gauss(0, spread))) for m in rng.choice(middles)], 0) for i in range(n)]


@pytest.mark.parametrize("seed,n,dimensions,k,spread", [(1, 400, 6, 12, 0.3), (2, 150, 3, 40, 1.0), (3, 300, 2, 7, 0.01), (4, 30, 64, 40, 1.0)])
def test_equal_to_brute_force(spark, seed, n, dimensions, k, spread):
    rows = random_rows(seed, n, dimensions, spread)
    placed, centroids = clusters.cluster(spark.createDataFrame(rows, SCHEMA), k=k, dimensions=dimensions)
    want, middles = brute(rows, k, 5, dimensions)
    assert order(tuple(r) for r in placed.collect()) == order(want)
    assert centroids.tolist() == [list(c) for c in middles]


def test_edges(spark):
    """Nulls, wrong lengths, infinite parts, ties, repeated rows and ids, and one vector for a third of all rows."""
    rows = random_rows(5, 60, 4)
    rows += [(100 + i, [1.0, 1.0, 1.0, 1.0], 1) for i in range(40)] + [(None, [0.5, 0.0, -0.5, 0.25], None), rows[3], rows[3]]
    rows += [(3, [9.0, 9.0, 9.0, 9.0], 0), (200, None, 0), (201, [1.0, 2.0, 3.0], 0), (202, [1.0, None, 1.0, 1.0], 0),
             (203, [1.0, float("nan"), 1.0, 1.0], 0), (204, [1.0, float("inf"), 1.0, 1.0], 0), (205, [], 0)]
    placed, _ = clusters.cluster(spark.createDataFrame(rows, SCHEMA), k=10, dimensions=4)
    assert order(tuple(r) for r in placed.collect()) == order(brute(rows, 10, 5, 4)[0])


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2 ** 18 + 37 * i), float(-(2 ** 18)), 0.0], 0) for i in range(20)]
    placed, _ = clusters.cluster(spark.createDataFrame(rows, SCHEMA), k=3, dimensions=3)
    assert order(tuple(r) for r in placed.collect()) == order(brute(rows, 3, 5, 3)[0])
    beyond = spark.createDataFrame([(1, [1e30, 0.0, 0.0], 0)], SCHEMA)
    assert clusters.cluster(beyond, k=3, dimensions=3)[0].count() == 0


def test_bounds_spare_scans():
    rng = np.random.default_rng(1)
    middles = rng.integers(-400, 400, (8, 16))
    x = middles[rng.integers(0, 8, 2000)] + rng.integers(-20, 20, (2000, 16))
    history, scans = [middles.copy()], []
    state = [np.full(2000, -1, np.int32), np.zeros(2000), np.zeros(2000, np.int32), np.zeros(2000), np.zeros(2000, np.int32)]
    for _ in range(4):
        scans.append(clusters.Bounds(np.stack(history)).assign(x, *state))
        assert (state[0] == clusters.squared_distances(x, history[-1]).argmin(1)).all()
        history.append(history[-1] + rng.integers(-3, 4, middles.shape))
    assert scans[0] == 2000 and sum(scans[1:]) < 200


def test_bounds_use_the_whole_displacement():
    """A centroid that wanders off and comes back has not moved, however long its way was."""
    first = np.array([[0, 0], [100, 0]])
    away = first + np.array([[0, 40], [0, 0]])
    x = np.array([[10, 0]])
    state = [np.zeros(1, np.int32), np.array([10.0]), np.zeros(1, np.int32), np.array([90.0]), np.zeros(1, np.int32)]
    bounds = clusters.Bounds(np.stack([first, away, first]))
    assert bounds.moved[0].tolist() == [0, 0] and bounds.assign(x, *state) == 0


def test_inertia_and_hashes(spark):
    rows = random_rows(6, 90, 5)
    placed, centroids = clusters.cluster(spark.createDataFrame(rows, SCHEMA), k=6, dimensions=5)
    got = clusters.with_inertia(placed, centroids).collect()
    for r in got:
        assert r["cluster_inertia"] == sum(o["distance"] for o in got if o["cluster"] == r["cluster"])
        assert r["inertia"] == sum(o["distance"] for o in got)
        text = ",".join(map(str, centroids[r["cluster"]].tolist()))
        assert r["centroid_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table(spark):
    placed, centroids = clusters.cluster(spark.createDataFrame([], SCHEMA))
    assert clusters.with_inertia(placed, centroids).count() == 0 and len(centroids) == 0
