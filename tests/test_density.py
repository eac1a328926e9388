"""Graphs, neighbours and density clusters against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark import stages
from quillspark.operators import clusters, density, graphs, neighbours


def test_components_and_ends(spark):
    random.seed(2)
    links = [(random.randrange(60), random.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    own = list(range(200))

    def root(x):
        while own[x] != x:
            x = own[x]
        return x

    for a, b in links:
        lo, hi = sorted((root(a), root(b)))
        own[hi] = lo
    got = {r.node: r.end for r in graphs.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for pair in links for x in pair if root(x) != x}
    assert graphs.components(spark.createDataFrame([], "a long, b long")).count() == 0
    way = spark.createDataFrame([(i, i + 1) for i in range(20)], "node long, up long")
    assert {r.end for r in graphs.ends(way).collect()} == {20}


def kruskal(edges):
    own = {}

    def root(x):
        while own.get(x, x) != x:
            x = own[x]
        return x

    out = []
    for w, a, b in sorted((w, a, b) for a, b, w in edges):
        if root(a) != root(b):
            own[root(a)] = root(b)
            out.append((a, b, w))
    return out


@pytest.mark.parametrize("last", [0, 20, 10_000])
def test_minimum_forest(spark, last):
    random.seed(4)
    edges = sorted({(min(a, b), max(a, b)) for a, b in ((random.randrange(80), random.randrange(80)) for _ in range(300)) if a != b})
    edges = [(a, b, float(random.randrange(9))) for a, b in edges] + [(200, 201, 1.0)]
    got = graphs.minimum_forest(spark.createDataFrame(edges, "a long, b long, w double"), last)
    assert sorted(tuple(r) for r in got.collect()) == sorted(kruskal(edges))


def test_ranks(spark, monkeypatch):
    monkeypatch.setattr(stages, "ROWS", 50)
    rows = spark.range(333).select((F.col("id") * 35 % 333).alias("x"))
    got = {r.x: r.r for r in graphs.ranked(rows, 333, ["x"]).collect()}
    assert got == {i: i for i in range(333)}


def points(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<double>").repartition(4)


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 16))
    x[300:420] = x[300]  # many alike
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = points(spark, x).cache()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    got = neighbours.nearest(df, 700, 16, 5, orders=2, width=700).collect()
    of = {}
    for r in got:
        of.setdefault(r.a, []).append(r.d)
    for i in range(700):
        assert np.allclose(sorted(of[i]), np.sort(d[i])[:5], atol=1e-6)
    blocks = neighbours.nearest(df, 700, 16, 5, orders=12, width=64)
    assert neighbours.recall(df, blocks, 5, 7) > 0.9
    assert blocks.groupBy("a").count().agg(F.max("count"), F.min("count"), F.count("*")).first()[:3] == (5, 5, 700)
    dots = x @ x.T
    want = {(i, j) for i in range(700) for j in range(i) if dots[i, j] >= 0.6}
    found = {(r.b, r.a) for r in neighbours.similar(df, 700, 16, 0.6, orders=12, width=128).collect()}
    assert found <= want and len(found) >= 0.9 * len(want)
    assert {(r.b, r.a) for r in neighbours.similar(df, 700, 16, 0.6, orders=1, width=700).collect()} == want


def brute(x, least, samples, epsilon=0.0):
    """Labels and probabilities over the complete graph, by sets."""
    n = len(x)
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), 9)
    away = d.copy()
    np.fill_diagonal(away, np.inf)
    core = np.sort(away, axis=1)[:, samples - 1]
    edges = [(i, j, max(d[i, j], core[i], core[j])) for i in range(n) for j in range(i + 1, n)]
    node = {i: (frozenset([i]), None, (), math.inf) for i in range(n)}  # points, w, children
    of = {i: i for i in range(n)}
    next_ = n
    for a, b, w in kruskal(edges):
        x_, y_ = of[a], of[b]
        joined = node[x_][0] | node[y_][0]
        node[next_] = (joined, w, (x_, y_), None)
        for p in joined:
            of[p] = next_
        next_ += 1
    clusters = []  # (points, birth, parent, stability, leave)

    def grow(top, birth, parent):
        me = len(clusters)
        clusters.append([node[top][0], birth, parent, 0.0, {}, []])
        at, begin = top, 0.0 if birth == math.inf else 1 / max(birth, 1e-9)
        while True:
            _, w, kids, _ = node[at]
            lam = 1 / max(w, 1e-9)
            large = [k for k in kids if len(node[k][0]) >= least]
            if len(large) == 2:
                clusters[me][3] += len(node[at][0]) * (lam - begin)
                for k in large:
                    clusters[me][5].append(grow(k, w, me))
                return me
            for k in kids:
                if k not in large:
                    for p in node[k][0]:
                        clusters[me][4][p] = lam
                    clusters[me][3] += len(node[k][0]) * (lam - begin)
            if not large:
                return me
            at = large[0]

    grow(next_ - 1, math.inf, None)
    value, wins = {}, {}
    for i in reversed(range(len(clusters))):
        below = sum(value[k] for k in clusters[i][5])
        wins[i] = clusters[i][3] >= below and i != 0
        value[i] = max(clusters[i][3], below)

    def above(i):
        while i is not None:
            yield i
            i = clusters[i][2]

    picked = {i for i in wins if wins[i] and not any(wins[j] for j in list(above(i))[1:])}
    if epsilon:
        climbed = set()
        for i in picked:
            while clusters[i][1] <= epsilon and clusters[i][2] != 0:
                i = clusters[i][2]
            climbed.add(i)
        picked = climbed
    label, lam = {}, {}
    for i, c in enumerate(clusters):
        owner = [j for j in above(i) if j in picked]
        if owner:
            for p, t in c[4].items():
                label[p], lam[p] = owner[-1], t
    most = {j: max(lam[p] for p in label if label[p] == j) for j in set(label.values())}
    name = {j: min(p for p in label if label[p] == j) for j in most}
    return {p: (name[label[p]], lam[p] / most[label[p]]) if p in label else (None, 0.0) for p in range(n)}


def groups(seed, sizes=(40, 25, 30), noise=25):
    rng = np.random.default_rng(seed)
    parts = [rng.normal(size=3) * 6 + rng.normal(size=(s, 3)) * (0.3 + 0.3 * i) for i, s in enumerate(sizes)]
    return np.concatenate([*parts, rng.uniform(-10, 10, size=(noise, 3))])


@pytest.mark.parametrize(("seed", "least", "samples", "epsilon", "small"), [(1, 8, 5, 0.0, False), (2, 5, 5, 0.0, True), (4, 4, 4, 1.5, False)])
def test_density_clusters_are_the_brute_force_ones(spark, seed, least, samples, epsilon, small):
    x = groups(seed)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    limits = {"last": 10, "most": 12} if small else {}
    got = density.clustered(df, "id", "v", least, samples, epsilon, k=len(x) - 1, **limits).collect()
    want = brute(x, least, samples, epsilon)
    assert {r.id: r.cluster for r in got} == {p: c for p, (c, _) in want.items()}
    assert all(abs(r.probability - want[r.id][1]) < 1e-6 for r in got)
    assert len({r.cluster for r in got} - {None}) >= 2 and any(r.cluster is None for r in got)


def test_ranges_of_the_dendrogram_agree(spark):
    random.seed(3)
    tree = [(random.randrange(i), i, round(random.random(), 2)) for i in range(1, 120)] + [(500, 501, 0.5)]
    df = spark.createDataFrame(tree, "a long, b long, w double")
    sides = lambda rows: sorted((r.id, r.w, *sorted(((r.lo, r.n_lo), (r.hi, r.n_hi)))) for r in rows)
    assert sides(density.dendrogram(df)[0].collect()) == sides(density.dendrogram(df, 7)[0].collect())


def test_odd_points(spark):
    rows = [(str(i), [1.0, 0.0]) for i in range(12)] + [(f"x{i}", [0.0, 1.0 + i / 50]) for i in range(12)] + [("none", None), ("empty", [])]
    got = {r.t: (r.cluster, r.probability) for r in density.clustered(spark.createDataFrame(rows, "t string, v array<double>"), "t", "v", 5).collect()}
    assert got["none"] == got["empty"] == (None, 0.0) and got["3"][0] == "0" and got["x4"][0] == "x0" and len(got) == 26
    few = density.clustered(spark.createDataFrame(rows[:3], "t string, v array<double>"), "t", "v", 5)
    assert [r.cluster for r in few.collect()] == [None] * 3
    assert density.clustered(spark.createDataFrame([], "t string, v array<double>"), "t", "v").count() == 0


def loop(rows, least):
    leaders, out = [], {}
    for key, _, v in sorted(rows, key=lambda r: (-r[1], r[0])):
        own = next((k for k, u in leaders if np.dot(u, v) >= least - 1e-9), None)
        out[key] = own or key
        if own is None:
            leaders.append((key, v))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_leaders_are_those_of_a_loop(spark, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, 10))
    rows = []
    for i in range(400):  # a third of all near one of them, so that chains of links arise
        v = base[0 if i % 3 == 0 else rng.integers(12)] + rng.normal(size=10) * 0.6
        rows.append((f"t{i:03d}", int(rng.integers(1, 9)), (v / np.linalg.norm(v)).tolist()))
    df = spark.createDataFrame([*rows, ("none", 3, None)], "title string, n long, v array<double>")
    got = {r.title: r.leader for r in clusters.greedy_leaders(df, "title", "n", "v", 0.8).collect()}
    want = loop(rows, 0.8) | {"none": "none"}
    assert got == want and 12 < len(set(want.values())) < 300
    ways = spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long")
    assert {r.b for r in clusters.settled(ways).collect()} == {1, 3, 5, 7, 9}
    assert clusters.greedy_leaders(df.limit(0), "title", "n", "v", 0.8).count() == 0


def ari(pairs):
    c2 = lambda n: n * (n - 1) / 2
    cells, a, b = Counter(pairs), Counter(x for x, _ in pairs), Counter(y for _, y in pairs)
    both, in_a, in_b = (sum(c2(n) for n in c.values()) for c in (cells, a, b))
    expected = in_a * in_b / c2(len(pairs))
    return 1.0 if (in_a + in_b) / 2 == expected else (both - expected) / ((in_a + in_b) / 2 - expected)


def test_reclustered_draws(spark):
    x = groups(7, (30, 25), 10)
    labels = [0] * 30 + [1] * 22 + [0] * 3 + [-1] * 10
    df = spark.createDataFrame([(i, labels[i], v.tolist()) for i, v in enumerate(x)], "id long, l int, v array<double>")
    drawn = df.where("l <> -1").withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    taken = drawn.where(F.pmod(F.xxhash64("id", "draw", F.lit(42)), F.lit(1 << 20)) < int(0.8 * (1 << 20))).select("draw", "id").collect()
    want = {}
    for d in range(3):
        own = sorted(r.id for r in taken if r.draw == d)
        assert 35 < len(own) < 52
        found = brute(x[own], 5, 5)
        pairs = [(labels[own[p]], c) for p, (c, _) in found.items() if c is not None]
        want[d] = (len(pairs), ari(pairs))
    got = {r.draw: (r.n, r.ari) for r in density.reclustered(df, "id", "l", "v", draws=3, least=5, k=54).collect()}
    assert got.keys() == want.keys() and all(got[d][0] == want[d][0] and abs(got[d][1] - want[d][1]) < 1e-9 for d in want)
    mean = density.stability(df, "id", "l", "v", draws=3, least=5, k=54).first()
    assert abs(mean.ari_mean - np.mean([a for _, a in want.values()])) < 1e-9 and abs(mean.ari_std - np.std([a for _, a in want.values()])) < 1e-9 and mean.n_valid_points == 55
    few = density.stability(df.limit(9), "id", "l", "v", draws=3).first()
    assert (few.ari_mean, few.ari_std, few.n_valid_points) == (0.0, 0.0, 9)


def test_neighbours_of_draws_are_a_row_a_pair(spark):
    x = groups(9, (40, 30), 10)
    n, draws, k, samples = len(x), 70, 9, 4
    marks = np.random.default_rng(1).random((n, draws)) < 0.8
    marks[:5] = False
    words = [[sum(1 << j - i for j in range(i, min(i + 63, draws)) if row[j]) for i in (0, 63)] for row in marks]
    points = spark.createDataFrame([(i, v.tolist(), w) for i, (v, w) in enumerate(zip(x, words))], "id long, v array<double>, draws array<long>")
    near, cores = neighbours.in_draws(points, n, x.shape[1], draws, k, samples)
    away = np.round(np.linalg.norm(x[:, None] - x[None, :], axis=2), 7)
    want, first = {}, {}
    for j in range(draws):
        for a in np.flatnonzero(marks[:, j]):
            own = sorted((away[a, b], b) for b in np.flatnonzero(marks[:, j]) if b != a)[:k]
            first[a, j] = own[samples - 1][0]
            for _, b in own:
                want.setdefault((a, b), set()).add(j)
    rows = near.collect()
    got = {(r.a, r.b): {j for j in range(draws) if (r.m0, r.m1)[j // 63] >> j % 63 & 1} for r in rows}
    assert len(rows) == len(got) and got == want
    found = {(r.a, j): c for r in cores.collect() for j, c in enumerate(r.cores) if c == c}
    assert found.keys() == first.keys() and all(abs(found[p] - first[p]) < 1e-6 for p in first)


def test_thinned_edges_keep_the_forest(spark):
    rng = np.random.default_rng(3)
    edges = sorted({(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 60, (900, 2)) if a != b})
    rows = [(a, b, float(rng.integers(0, 50))) for a, b in edges] + [(a + 100, b + 100, float(rng.integers(0, 50))) for a, b in edges]
    df = spark.createDataFrame(rows, "a long, b long, w double")
    whole = sorted(map(tuple, graphs.minimum_forest(df).collect()))
    thin = graphs.thinned(df, len(rows), F.floor(F.col("a") / 100), 100)
    assert sorted(map(tuple, graphs.minimum_forest(thin).collect())) == whole and thin.count() < len(rows)
    assert sorted(map(tuple, graphs.thinned(df, len(rows), F.floor(F.col("a") / 100)).collect())) == whole


def test_blocks_meet_without_being_shuffled_for_each_other(spark):
    x = groups(11, (25, 20), 15)
    labels = [0] * 25 + [1] * 20 + [-1] * 15
    df = spark.createDataFrame([(i, labels[i], v.tolist()) for i, v in enumerate(x)], "id long, l int, v array<double>")
    met = clusters._blocks_met(df.select(F.col("id").alias("k"), "v"), 7, 2, 3)
    seen = Counter((p.k, q.k) for r in met.collect() for p in r.xs for q in r.ys)
    assert len(seen) == 60 * 60 and set(seen.values()) == {1}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    pairs = clusters.similar_pairs(df, "id", "v", 0.5, 7)
    assert "CartesianProduct" in pairs._jdf.queryExecution().sparkPlan().toString()
    want = {(a, b): x[a] @ x[b] for a in range(60) for b in range(a + 1, 60) if x[a] @ x[b] >= 0.5}
    got = {(r.a, r.b): r.similarity for r in pairs.collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    whole = clusters.silhouettes(df, "id", "l", "v", block=7).first()
    distance = np.linalg.norm(x[:45, None] - x[None, :45], axis=2)
    assert abs(whole.silhouette - clusters.silhouette(distance, np.array(labels[:45]))) < 1e-6 and (whole.n_clusters, whole.n_noise) == (2, 15)
