"""Centroids, nearest centroids, similarity pairs and cluster quality over vectors in array columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark import stages
from quillspark.functions.vectors import cosine, norm, normalised
from quillspark.operators import neighbours


def centroids(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """label, centroid, members: the mean of each label's vectors."""
    mean = rows.select(label, F.posexplode(vector).alias("at", "x")).groupBy(label, "at").agg(F.avg(F.col("x").cast("double")).alias("m"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "m"))), lambda s: s["m"])
    members = rows.groupBy(label).agg(F.count("*").alias("members"))
    return mean.groupBy(label).agg(ordered.alias("centroid")).join(members, label)


def nearest(rows: DataFrame, key: str, vector: str, centres: DataFrame, label: str, most: int = 2048) -> DataFrame:
    """key, nearest, similarity: the most similar of the centres, of equal ones the least label.

    Up to `most` centres go to the rows as one array, so rows are neither multiplied nor shuffled; more are dealt into
    groups of so many by hash, each row meets each group, and the best of a row's groups stays.
    """
    held, seen = stages.counted(centres.select(F.col(label).alias("label"), F.col("centroid").alias("c")), "centres")
    groups = max(1, -(-seen["n"] // most))
    packed = held.groupBy(F.pmod(F.xxhash64("label"), F.lit(groups)).alias("__g")).agg(F.array_sort(F.collect_list(F.struct("label", "c"))).alias("__all"))
    similarity = F.transform("__all", lambda c: F.struct(cosine(F.col(vector), c["c"]).alias("similarity"), c["label"].alias("label")))
    better = lambda a, b: F.when(a["similarity"].isNull() | (b["similarity"] > a["similarity"]), b).otherwise(a)
    if groups == 1:
        found = rows.select(key, vector).crossJoin(F.broadcast(packed)).withColumn("__s", similarity)  # one row
    else:
        asked = rows.select(key, vector, F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).cast("long").alias("__g"))
        found = asked.join(packed, "__g").withColumn("__s", similarity)
    best = found.select(key, F.aggregate(F.slice("__s", 2, F.size("__s")), F.col("__s")[0], better).alias("b"))
    if groups > 1:
        best = best.groupBy(key).agg(F.min_by("b", F.struct(-F.col("b.similarity"), "b.label")).alias("b"))
    return best.select(key, F.col("b.label").alias("nearest"), "b.similarity")


def similar_pairs(rows: DataFrame, key: str, vector: str, least: float, block: int = 1024) -> DataFrame:
    """a, b, similarity of all pairs of rows whose vectors have a dot product of `least` or more; a < b.

    Exact, so every row meets every other: blocks of rows meet in tasks of their own, as products of matrices, and
    only pairs that count come out. It is for distinct titles or phrases, not for whole corpora.
    """
    kept = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).alias("v"))
    both = _blocks_met(kept, block).where("x <= y").select("xs", "ys", (F.col("x") == F.col("y")).alias("same"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for xs, ys, same in zip(batch["xs"], batch["ys"], batch["same"].to_pylist()):
                (xk, xv), (yk, yv) = (side.values.flatten() for side in (xs, ys))
                x, y = (v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1).astype(float) for v in (xv, yv))
                dots = x @ y.T
                i, j = np.nonzero(dots >= least)
                a, b = xk.take(pa.array(i)), yk.take(pa.array(j))
                order = pc.less(a, b)
                keep = pc.not_equal(a, b) if not same else order
                low, high = pc.if_else(order, a, b), pc.if_else(order, b, a)
                yield pa.RecordBatch.from_arrays([low, high, pa.array(dots[i, j])], ["a", "b", "similarity"]).filter(keep)

    kind = rows.schema[key].dataType.simpleString()
    return both.mapInArrow(compare, f"a {kind}, b {kind}, similarity double")


def _blocks_met(rows: DataFrame, block: int, few: int = 4, most: int = 64) -> DataFrame:
    """x, xs, y, ys: every block of about `block` rows (k and more) with every block, itself too.

    The blocks are written and dealt twice, into groups of about `few` and of about `most`; a task reads a group of each, and
    its few blocks meet the others one after another. So however often blocks meet, they are moved twice.
    """
    held, seen = stages.counted(rows, "blocked-rows")
    parts = max(1, -(-seen["n"] // block))
    blocks = held.groupBy(F.pmod(F.xxhash64("k"), F.lit(parts)).alias("x")).agg(F.collect_list(F.struct(*held.columns)).alias("xs"))
    stored = stages.written(blocks, "blocks")
    dealt = lambda size: stored.repartition(max(1, -(-parts // size)), "x")
    return dealt(few).hint("shuffle_replicate_nl").crossJoin(dealt(most).select(F.col("x").alias("y"), F.col("xs").alias("ys")))


def separation(centres: DataFrame, label: str) -> DataFrame:
    """One row: 1 less the greatest cosine of two centres."""
    side = lambda k: centres.select(F.col(label).alias(k), F.col("centroid").alias(f"c_{k}"))
    pairs = side("a").join(F.broadcast(side("b")), F.col("a") < F.col("b"))
    return pairs.agg((1 - F.max(cosine(F.col("c_a"), F.col("c_b")))).alias("separation"))


def davies_bouldin(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """One row: the mean over clusters of the greatest (spread + spread) / distance to another."""
    centres = centroids(rows, label, vector)
    away = lambda a, b: norm(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")))
    spread = rows.join(centres, label).groupBy(label).agg(F.avg(away(F.col(vector), F.col("centroid"))).alias("s"))
    full = centres.join(spread, label)
    side = lambda k: full.select(F.col(label).alias(k), F.col("centroid").alias(f"c_{k}"), F.col("s").alias(f"s_{k}"))
    pairs = side("a").join(F.broadcast(side("b")), F.col("a") != F.col("b"))
    ratio = (F.col("s_a") + F.col("s_b")) / away(F.col("c_a"), F.col("c_b"))
    return pairs.groupBy("a").agg(F.max(ratio).alias("r")).agg(F.coalesce(F.avg("r"), F.lit(0.0)).alias("davies_bouldin"))


def greedy_leaders(rows: DataFrame, key: str, weight: str, vector: str, least: float, **options) -> DataFrame:
    """key, leader, weight (see led)."""
    return led(rows, key, weight, vector, least, **options).select(key, "leader", weight)


def led(rows: DataFrame, key: str, weight: str, vector: str, least: float, orders: int = neighbours.ORDERS, width: int = neighbours.WIDTH) -> DataFrame:
    """key, weight, leader, nearest: in falling weight (then key) a row joins the first leader at `least` cosine or more, else leads;
    nearest is the leader of the greatest cosine, which for a row that follows is one of those it is linked to.

    Links are found by vector orders and compared exactly. They are settled in rounds: a row without an open likelier
    neighbour leads, its neighbours follow, and both leave the graph; so the leaders are those of a loop over all rows, and
    no task holds more than its share of the links. Keys are distinct; rows without a vector lead themselves.
    """
    unit = normalised(F.col(vector).cast("array<double>"))
    kept = rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(F.col(key).alias("k"), F.col(weight).cast("double").alias("w"), unit.alias("v"))
    points, seen = stages.counted(kept.withColumn("id", F.monotonically_increasing_id()), "points", size=F.max(F.size("v")))
    kind = rows.schema[key].dataType
    if not seen["n"]:
        return rows.select(key, weight, F.col(key).alias("leader"), F.col(key).alias("nearest"))
    found = neighbours.similar(points, seen["n"], seen["size"], least - 1e-9, orders, width)
    of = lambda c: points.select(F.col("id").alias(c), F.struct((-F.col("w")).alias("w"), F.col("k").alias("k")).alias(f"place_{c}"))
    known = found.join(of("a"), "a").join(of("b"), "b")
    first = F.col("place_a") < F.col("place_b")
    links = stages.written(known.select(F.when(first, F.struct("a", "b")).otherwise(F.struct(F.col("b").alias("a"), F.col("a").alias("b"))).alias("l"), "similarity").select("l.*", "similarity"), "links")
    follows = settled(links.select("a", "b"))
    leading = links.join(follows.select(F.col("b").alias("a")), "a", "left_anti").join(of("a"), "a")
    of_all = leading.groupBy("b").agg(F.min("place_a").alias("first"), F.min(F.struct(-F.col("similarity"), F.col("place_a").alias("place"))).alias("near"))
    chosen = of_all.select("b", F.col("first.k").cast(kind).alias("__leader"), F.col("near.place.k").cast(kind).alias("__nearest"))
    named = chosen.join(points.select(F.col("id").alias("b"), F.col("k").alias("__k")), "b").select("__k", "__leader", "__nearest")
    joined = rows.select(key, weight).join(named, F.col(key) == F.col("__k"), "left")
    return joined.select(key, weight, F.coalesce("__leader", key).alias("leader"), F.coalesce("__nearest", key).alias("nearest"))


def settled(links: DataFrame) -> DataFrame:
    """b of links (a, b; a before b, no circles): the rows that follow a leader before them. Those with no open row before
    them lead; each round settles them and their neighbours."""
    live, seen = stages.counted(links, "open")
    followers = None
    while seen["n"]:
        leads = live.select("a").distinct().join(live.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        new = stages.written(live.join(leads, "a", "left_semi").select("b").distinct(), "followers")
        followers = new if followers is None else followers.unionByName(new)
        # a leader's links end with its followers, and theirs with them
        rest = live.join(new, "b", "left_anti").join(new.select(F.col("b").alias("a")), "a", "left_anti")
        live, seen = stages.counted(rest, "open")
    return links.select("b").limit(0) if followers is None else followers


def silhouettes(rows: DataFrame, key: str, label: str, vector: str, noise: int = -1, block: int = 1024) -> DataFrame:
    """One row: silhouette (mean, Euclidean), n_clusters, n_noise; 0.0 for fewer than two clusters. Noise is left out.

    Exact, so every row meets every other: blocks of rows meet in tasks of their own, which pass on one sum of distances
    for each row and cluster.
    """
    kept = rows.where(F.col(label) != noise).select(F.col(key).alias("k"), F.col(label).cast("long").alias("l"), F.col(vector).alias("v"))
    both = _blocks_met(kept, block).select("xs", "ys")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task meets a block with one after another: its sums are passed on when the next one begins
        now, keys, labels, x, sums = None, None, None, None, {}

        def closed() -> pa.RecordBatch:
            kinds = sorted(sums)
            at = np.repeat(np.arange(len(keys)), len(kinds))
            columns = [keys.take(pa.array(at)), labels.take(pa.array(at)), pa.array(np.tile(kinds, len(keys)).astype(np.int64)), pa.array(np.stack([sums[i] for i in kinds], axis=1).ravel())]
            return pa.RecordBatch.from_arrays(columns, ["k", "l", "other", "s"])

        for batch in batches:
            for xs, ys in zip(batch["xs"], batch["ys"]):
                (xk, xl, xv), (_, yl, yv) = (side.values.flatten() for side in (xs, ys))
                if now is None or not xk.equals(now):
                    if sums:
                        yield closed()
                    now, keys, labels, sums = xk, xk, xl, {}
                    x = xv.flatten().to_numpy(zero_copy_only=False).reshape(len(xv), -1).astype(float)
                    xx = (x * x).sum(axis=1)[:, None]
                order = np.argsort(yl.to_numpy(), kind="stable")
                y = yv.flatten().to_numpy(zero_copy_only=False).reshape(len(yv), -1).astype(float)[order]
                kinds, begins = np.unique(yl.to_numpy()[order], return_index=True)
                away = x @ y.T
                away *= -2
                away += xx
                away += (y * y).sum(axis=1)[None, :]
                np.sqrt(np.maximum(away, 0, out=away), out=away)
                for i, part in zip(kinds.tolist(), np.add.reduceat(away, begins, axis=1).T):
                    sums[i] = sums[i] + part if i in sums else part
        if sums:
            yield closed()

    kind = rows.schema[key].dataType.simpleString()
    sums = both.mapInArrow(compare, f"k {kind}, l long, other long, s double").groupBy("k", "l", "other").agg(F.sum("s").alias("s"))
    sizes = kept.groupBy(F.col("l").alias("other")).agg(F.count("*").alias("n"))
    means = sums.join(sizes, "other")
    inner = F.col("l") == F.col("other")
    each = means.groupBy("k", "l").agg(
        F.max(F.when(inner, F.try_divide(F.col("s"), F.col("n") - 1))).alias("a"), F.max(F.when(inner, F.col("n"))).alias("own"), F.min(F.when(~inner, F.col("s") / F.col("n"))).alias("b")
    )
    value = F.when(F.col("own") == 1, 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    mean = each.agg(F.avg(value).alias("m"))
    counts = rows.agg(F.count_distinct(F.when(F.col(label) != noise, F.col(label))).alias("n_clusters"), F.count_if(F.col(label) == noise).alias("n_noise"))
    full = counts.crossJoin(F.broadcast(mean))
    return full.select(F.when(F.col("n_clusters") < 2, 0.0).otherwise(F.coalesce("m", F.lit(0.0))).alias("silhouette"), "n_clusters", "n_noise")


def average_linkage(distance: np.ndarray, k: int) -> np.ndarray:
    """Labels of k clusters of a square distance matrix by average linkage."""
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, alive, label = np.ones(n), list(range(n)), np.arange(n)
    while len(alive) > max(k, 1):
        sub = d[np.ix_(alive, alive)]
        i, j = np.unravel_index(np.argmin(sub), sub.shape)
        a, b = sorted((alive[i], alive[j]))
        merged = (d[a] * size[a] + d[b] * size[b]) / (size[a] + size[b])
        d[a], d[:, a] = merged, merged
        d[a, a] = np.inf
        size[a] += size[b]
        label[label == b] = a
        alive.remove(b)
    return np.unique(label, return_inverse=True)[1]


def silhouette(distance: np.ndarray, labels: np.ndarray) -> float:
    """The mean silhouette over a square distance matrix; 0 for fewer than two clusters."""
    kinds = np.unique(labels)
    if len(kinds) < 2:
        return 0.0
    means = np.stack([distance[:, labels == k].sum(axis=1) for k in kinds], axis=1)
    counts = np.array([(labels == k).sum() for k in kinds])
    own = np.searchsorted(kinds, labels)
    rows = np.arange(len(labels))
    alone = counts[own] == 1
    a = means[rows, own] / np.maximum(counts[own] - 1, 1)
    other = means / counts
    other[rows, own] = np.inf
    b = other.min(axis=1)
    s = np.where(alone, 0.0, (b - a) / np.maximum(np.maximum(a, b), 1e-15))
    return float(s.mean())
