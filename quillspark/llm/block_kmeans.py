"""Centroid clustering of integer vectors, screened by the norms of their segments.

Vectors are kept with the norms of their segments of `SEGMENT` components. By Cauchy and Schwarz a segment of a vector x
and of a centroid c are at least |norm x - norm c| apart, so the sum over segments of (norm x - norm c)^2 never exceeds
the squared distance. Each vector gets the exact integer distance to the centroid of the least bound, and to further
centroids only where their bound isn't above that distance; so the assignment is the exact one.

Vectors are compressed and written once; each round reads them, sums the components a cluster in the tasks, and adds
those sums up by cluster and component. The driver holds the centroids alone (k times the dimensions).

Defined results: vectors of another length, or with a null or non-finite component, aren't kept; components beyond
+-2^27 after scaling count as +-2^27, so that a squared distance fits 64 bits, and inertias that don't fit end at the
greatest long; a null vec_id hashes as an empty one; rows that repeat a vec_id each count;
ties of the first centroids' hashes go by components, ties of distances to the smaller number; fewer vectors than k
give as many centroids; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.tables import written

CENTROIDS, ROUNDS, DIMENSIONS, SEGMENT, SCALE = 16, 3, 64, 8, 64
#: Greatest size of a component, for distances that fit a long.
LIMIT = 1 << 27


def _norms(x: np.ndarray) -> np.ndarray:
    """Norms of the segments of each row."""
    pad = -x.shape[1] % SEGMENT
    wide = np.pad(x, ((0, 0), (0, pad))).reshape(len(x), -1, SEGMENT).astype(np.float64)
    return np.sqrt((wide * wide).sum(axis=2))


def _matrix(column: pa.ListArray, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).reshape(-1), kind))


def _compress(dimensions: int, scale: float):
    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            whole = rows.filter(pa.compute.fill_null(pa.compute.equal(pa.compute.list_value_length(rows.column(1)), dimensions), False))
            if not whole.num_rows:
                continue
            x = _matrix(whole.column(1), dimensions).astype(np.float64)  # a null component is NaN here
            kept = np.isfinite(x).all(axis=1)
            v = np.clip(np.floor(x[kept] * scale), -LIMIT, LIMIT).astype(np.int32)
            ids = whole.column(0).filter(pa.array(kept))
            yield pa.RecordBatch.from_arrays([ids, _lists(v, pa.int32()), _lists(_norms(v), pa.float64())], ["vec_id", "v", "norms"])

    return compress


def compressed(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: float = SCALE) -> DataFrame:
    """vec_id, v (integers), norms (of segments) of the vectors (vec_id, embedding) that are kept."""
    wide = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return wide.mapInArrow(_compress(dimensions, scale), "vec_id long, v array<int>, norms array<double>")


def nearest(v: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per vector the number of the nearest centroid (the smaller on ties), the squared distance, and how many distances
    were computed."""
    of = _norms(centroids)
    bounds = np.zeros((len(v), len(centroids)))
    for s in range(norms.shape[1]):
        bounds += (norms[:, s, None] - of[None, :, s]) ** 2
    # what floating point may add to a bound
    bounds -= 1e-9 * ((norms**2).sum(axis=1)[:, None] + (of**2).sum(axis=1)[None, :]) + 1e-6
    wide, rows = v.astype(np.int64), np.arange(len(v))
    best = bounds.argmin(axis=1)
    distance = ((wide - centroids[best]) ** 2).sum(axis=1)
    first, exact = best.copy(), np.ones(len(v), np.int32)
    for j in range(len(centroids)):
        open_ = rows[(bounds[:, j] <= distance) & (first != j)]
        d = ((wide[open_] - centroids[j]) ** 2).sum(axis=1)
        exact[open_] += 1
        nearer = (d < distance[open_]) | ((d == distance[open_]) & (j < best[open_]))
        best[open_[nearer]], distance[open_[nearer]] = j, d[nearer]
    return best, distance, exact


def _assign(centroids: np.ndarray):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            best, distance, exact = nearest(_matrix(rows.column(1), centroids.shape[1]), _matrix(rows.column(2), -(-centroids.shape[1] // SEGMENT)), centroids)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(best, pa.int32()), pa.array(distance, pa.int64()), pa.array(exact, pa.int32())], ["vec_id", "cluster", "distance", "n_exact"]
            )

    return assign


def _sums(centroids: np.ndarray):
    """Per cluster and component of a task's vectors: their number and sum."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dimensions = centroids.shape
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64)
        for rows in batches:
            v = _matrix(rows.column(0), dimensions)
            best, _, _ = nearest(v, _matrix(rows.column(1), -(-dimensions // SEGMENT)), centroids)
            counts += np.bincount(best, minlength=k)
            for j in np.unique(best):
                sums[j] += v[best == j].sum(axis=0, dtype=np.int64)
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(full, dimensions), pa.int32()),
                pa.array(np.tile(np.arange(dimensions), len(full)), pa.int32()),
                pa.array(np.repeat(counts[full], dimensions), pa.int64()),
                pa.array(sums[full].reshape(-1), pa.int64()),
            ],
            ["cluster", "component", "n", "total"],
        )

    return add


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: str = "1:") -> np.ndarray:
    """The k vectors (vec_id, v) of smallest sha256 of the seed and the vec_id."""
    h = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    chosen = vectors.select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in sorted(chosen, key=lambda r: (r.h, list(r.v)))], np.int64).reshape(len(chosen), -1 if chosen else 0)


def clustered(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: float = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, n_exact of every kept vector."""
    spark = vectors.sparkSession
    kept = written(compressed(vectors, dimensions, scale), "vectors")
    centroids = first_centroids(kept.select("vec_id", "v"), k)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, n_exact int")
    for _ in range(rounds):
        sums = kept.select("v", "norms").mapInArrow(_sums(centroids), "cluster int, component int, n long, total long")
        moved = centroids.copy()
        # at most k * dimensions rows
        for r in sums.groupBy("cluster", "component").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
            moved[r.cluster, r.component] = r.total // r.n
        centroids = moved
    assigned = written(kept.mapInArrow(_assign(centroids), "vec_id long, cluster int, distance long, n_exact int"), "clusters")
    names = [(j, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(centroids)]
    inertia = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fitting = lambda n: min(n, (1 << 63) - 1)
    facts = [(j, fitting(inertia.get(j, 0)), fitting(sum(inertia.values())), sha) for j, sha in names]
    about = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_exact")
