"""Integer clusters against a plain loop over all vectors and centroids."""

import hashlib
import math
import random

import numpy as np
import pytest

from thalweg.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster string, v int"


def vectors(seed, n, dim, step):
    r = random.Random(seed)
    rows = [(i, [float(np.float32(r.randrange(-step, step) / 64)) for _ in range(dim)]) for i in range(n)]
    odd = [(n, None), (n + 1, []), (n + 2, [0.5] * (dim - 1)), (n + 3, [None] * dim), (n + 4, [math.nan] * dim), (n + 5, [math.inf] + [0.0] * (dim - 1)), (None, rows[0][1]), (3, rows[3][1]), (3, rows[4][1])]
    return rows + odd


def clustered(rows, k, rounds, dim):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda x: (x[0] is None, hashlib.sha256(f"3:{x[0]}".encode()).hexdigest() if x[0] is not None else "", x[1]))
    centres = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for j, own in groups.items():
            centres[j] = [sum(x) // len(own) for x in zip(*own)]
    out = [(i, j, d) for i, v in kept for d, j in [nearest(v)]]
    inertia = {}
    for _, j, d in out:
        inertia[j] = inertia.get(j, 0) + d
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for i, j, d in out), key=repr)


@pytest.mark.parametrize(("n", "dim", "step", "k", "rounds"), [(150, 4, 3, 8, 4), (60, 2, 2, 20, 3), (5, 3, 50, 8, 2), (400, 6, 400, 31, 2)])
def test_clusters_equal_a_plain_loop(spark, n, dim, step, k, rounds):
    rows = vectors(n, n, dim, step)
    df = spark.createDataFrame([(i, v, "clash", 0) for i, v in rows], SCHEMA).repartition(3)
    got = centroids.cluster(df, k, rounds, dim=dim).collect()
    assert sorted(map(tuple, got), key=repr) == clustered(rows, k, rounds, dim)


def test_tree_finds_the_smallest_number_among_ties_and_prunes():
    rng = np.random.default_rng(1)
    for k, spread in ((1, 3), (2, 2), (40, 3), (300, 2000)):
        points = rng.integers(-spread, spread, (k, 5))
        queries = np.concatenate([points, rng.integers(-spread, spread, (200, 5))])
        number, squares, taken = centroids.VantageTree(points).nearest(queries)
        every = ((queries[:, None, :] - points[None]) ** 2).sum(axis=2)
        assert (number == every.argmin(axis=1)).all() and (squares == every.min(axis=1)).all()
    clear = np.repeat(rng.integers(-10**6, 10**6, (30, 5)), 20, axis=0) + rng.integers(-9, 9, (600, 5))
    assert centroids.VantageTree(clear).nearest(clear)[2] < 0.5 * len(clear) ** 2


def test_empty_and_too_wide(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert centroids.cluster(empty).count() == 0
    assert centroids.cluster(empty).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    wide = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="no exact distance"):
        centroids.cluster(wide).collect()
