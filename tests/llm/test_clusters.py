import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.llm import clusters
from feedloom.llm.common import release, stored


def brute(rows, k, rounds, seed=2):
    """{(vec_id, cluster, distance)} counted, and centroids, in Python's whole numbers."""
    usable = [(i, [math.floor(x * 256) if abs(x) < 2**40 else int(x) * 256 for x in v]) for i, v in rows if v is not None and len(v) == len(rows[0][1]) and all(x is not None and math.isfinite(x) for x in v)]
    drawn = sorted(usable, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centers = [v for _, v in drawn[:k]]
    for turn in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centers)) for _, v in usable]
        if turn < rounds:
            for j in range(len(centers)):
                own = [v for (_, v), (_, c) in zip(usable, near) if c == j]
                if own:
                    centers[j] = [sum(x) // len(own) for x in zip(*own)]
    return usable, near, centers


def check(spark, rows, k, rounds, dims, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, first string, place string").repartition(3)
    got = clusters.kmeans(df, k, rounds, dims).collect()
    usable, near, centers = brute([r[:2] for r in rows], k, rounds)
    short = lambda x: x if x <= 2**63 - 1 else None
    assert Counter((r["vec_id"], r["cluster"], r["distance"]) for r in got) == Counter((i, j, short(d)) for (i, _), (d, j) in zip(usable, near))
    for r in got:
        assert r["centroid"] == [str(x) for x in centers[r["cluster"]]]
        assert r["cluster_inertia"] == short(sum(d for d, j in near if j == r["cluster"])) and r["inertia"] == short(sum(d for d, _ in near))


def vectors(n, dims, seed, spread=0.05, centers=7):
    draw = random.Random(seed)
    middles = [[draw.gauss(0, 0.3) for _ in range(dims)] for _ in range(centers)]
    return [(i, [float(np.float32(x + draw.gauss(0, spread))) for x in draw.choice(middles)], "x", "y") for i in range(n)]


@pytest.mark.parametrize("n,k,rounds,dims", [(300, 20, 5, 8), (200, 40, 3, 64), (60, 2, 5, 3), (50, 1, 2, 2), (9, 20, 4, 4)])
def test_equals_brute_force(spark, n, k, rounds, dims):
    check(spark, vectors(n, dims, n), k, rounds, dims)


def test_ties_and_repeated_rows(spark):
    """Few different whole numbers: many equal distances, equal centroids and empty clusters."""
    draw = random.Random(5)
    rows = [(i % 90, [draw.randrange(3) / 256 for _ in range(3)], "x", "y") for i in range(150)] + [(None, [0.0, 0.0, 0.0], "x", "y")] * 4
    check(spark, rows, 25, 5, 3)


def test_vectors_that_are_left_out(spark):
    rows = vectors(60, 4, 3) + [
        (100, None, "x", "y"), (101, [0.1] * 3, "x", "y"), (102, [0.1] * 5, "x", "y"), (103, [0.1, None, 0.2, 0.3], "x", "y"),
        (104, [float("nan"), 0.1, 0.2, 0.3], "x", "y"), (105, [float("inf"), 0.1, 0.2, 0.3], "x", "y"), (106, [], "x", "y"),
    ]
    check(spark, rows, 6, 3, 4)


def test_numbers_of_any_size(spark):
    rows = vectors(40, 3, 8) + [(200 + i, [1e30 * (-1) ** i, 3.0 * i, -1e7], "x", "y") for i in range(6)]
    check(spark, rows, 8, 3, 3, "double")
    assert clusters.whole([1e308, -0.001, 0.5, -1e-320]) == [int(1e308) * 256, -1, 128, -1]


def test_bounds_save_work():
    """Later rounds measure fewer distances than all pairs, and give the same clusters."""
    draw = np.random.default_rng(1)
    points = (draw.normal(0, 100, (2000, 16)) + draw.choice([-400, 400], (2000, 16))).astype(np.int64)
    at = clusters.Centroids(points[:30].tolist(), np.zeros(30))
    state = np.zeros(2000, np.int32), np.ones(2000, np.int32), np.full(2000, np.inf), np.zeros(2000)
    for _ in range(4):
        state = clusters.nearest(points, at, *state)
        squares = ((points[:, None, :] - at.points[None]) ** 2).sum(axis=2)
        assert (state[0] == squares.argmin(axis=1)).all()
        nearest, second = np.sort(np.sqrt(squares), axis=1)[:, :2].T
        assert (state[2] >= nearest).all() and (state[3] <= second).all()
        new = [points[state[0] == j].mean(axis=0) // 1 if (state[0] == j).any() else at.points[j] for j in range(30)]
        at = at.moved([[int(x) for x in row] for row in new])


def test_no_rows_and_release(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    found = clusters.kmeans(empty)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"] and found.collect() == []
    table = stored(spark.range(5), "released")
    files = table.inputFiles()
    release(table)
    assert files and spark.sparkContext._jvm.java.io.File(files[0].removeprefix("file:")).exists() is False
    outside = spark.read.parquet("/root/testdata/sf0.001/region.parquet")
    release(outside)
    assert outside.count() == 5
