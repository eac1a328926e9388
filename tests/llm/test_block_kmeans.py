"""Screened clustering against plain integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import block_kmeans, queries
from tests.oracle import compared

SCHEMA = "vec_id long, embedding array<float>"


@pytest.mark.parametrize("size", [3, 100, block_kmeans.LIMIT])
def test_screening_is_exact(size):
    rng = np.random.default_rng(size)
    centroids = rng.integers(-size, size, (16, 64))
    centroids[5] = centroids[3]  # a tie
    v = np.concatenate([rng.integers(-size, size, (300, 64)), centroids, centroids + 1]).clip(-size, size).astype(np.int32)
    best, distance, exact = block_kmeans.nearest(v, block_kmeans._norms(v), centroids)
    for row, b, d in zip(v.tolist(), best, distance):
        all_ = [sum((x - y) ** 2 for x, y in zip(row, c)) for c in centroids.tolist()]
        assert d == min(all_) and b == all_.index(min(all_))
    assert exact.min() >= 1 and exact.max() <= 16


def test_far_centroids_are_screened():
    rng = np.random.default_rng(2)
    centroids = np.repeat(rng.integers(-400, 400, (16, 8)), 8, axis=1)
    v = (centroids[rng.integers(0, 16, 2000)] + rng.integers(-5, 5, (2000, 64))).astype(np.int32)
    *_, exact = block_kmeans.nearest(v, block_kmeans._norms(v), centroids)
    assert exact.mean() < 4  # of 16


def plain(rows, k=16, rounds=3, dimensions=64):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]

    def assign():
        out = []
        for i, v in kept:
            d = [sum((x - y) ** 2 for x, y in zip(v, c)) for c in centroids]
            out.append((i, v, d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        own = assign()
        for j in range(len(centroids)):
            members = [v for _, v, c, _ in own if c == j]
            if members:
                centroids[j] = [sum(x) // len(members) for x in zip(*members)]
    own = assign()
    of = lambda j: sum(d for *_, c, d in own if c == j)
    sha = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    return sorted(((i is not None, i or 0, j, d, of(j), sum(x[3] for x in own), sha(centroids[j])) for i, _, j, d in own))


def found(df):
    assert df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_exact"]
    return sorted((r.vec_id is not None, r.vec_id or 0, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    random.seed(7)
    near = [[random.uniform(-1, 1) for _ in range(64)] for _ in range(6)]
    out = [(i, [x + random.gauss(0, 0.1) for x in random.choice(near)]) for i in range(150)]
    out += [(i + 1000, near[0]) for i in range(75)]  # a third of all vectors alike
    odd = [None, [], [0.5] * 63, [0.5] * 65, [None] + [0.5] * 63, [math.nan] + [0.5] * 63, [math.inf] * 64, [0.0] * 64]
    out += [(2000 + i, v) for i, v in enumerate(odd)] + [(None, [0.25] * 64), (3, out[3][1]), (4, out[5][1])]
    return [(i, None if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in out]


def test_clusters(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("cluster", F.lit("x")).withColumn("v", F.lit(1)).repartition(5)
    assert found(block_kmeans.clustered(df)) == plain(rows)


def test_few_vectors_and_none(spark, rows):
    few = rows[:5] + rows[-3:-2]
    assert found(block_kmeans.clustered(spark.createDataFrame(few, SCHEMA))) == plain(few)
    empty = block_kmeans.clustered(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and "centroid_sha256" in empty.columns
    assert block_kmeans.clustered(spark.createDataFrame([(1, [1.0])], SCHEMA)).count() == 0


def test_huge_components_have_a_defined_result(spark):
    df = spark.createDataFrame([(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.0] * 64)], SCHEMA)
    got = {r.vec_id: r for r in block_kmeans.clustered(df, k=1, rounds=0).collect()}
    assert all(r.distance >= 0 and r.inertia >= r.distance for r in got.values()) and max(r.distance for r in got.values()) >= 64 * (1 << 54)


def test_other_shapes(spark):
    random.seed(3)
    rows = [(i, [random.choice((0.0, 1.0, 5.0)) for _ in range(10)]) for i in range(60)]
    got = found(block_kmeans.clustered(spark.createDataFrame(rows, SCHEMA), k=4, rounds=2, dimensions=10))
    assert got == plain(rows, 4, 2, 10)


def test_query(spark):
    assert compared(spark, queries.op13_block_kmeans, queries.OP13_SQL) > 0
