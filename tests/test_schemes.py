"""Cluster significance, schemes and power on small matrices."""

import numpy as np

from quillspark.operators import axes, metrics
from quillspark.operators import schemes as sc

COUNTS = np.array([[10, 8, 1, 0], [8, 10, 0, 1], [1, 0, 10, 9], [0, 1, 9, 10]], float)


def test_distances_and_schemes():
    d = sc.jaccard_distances(COUNTS)
    assert d[0, 1] == 1 - 8 / 12 and (np.diag(d) == 0).all() and (d == d.T).all()
    good, bad = sc.scheme(COUNTS, np.array([0, 0, 1, 1])), sc.scheme(COUNTS, np.array([0, 1, 0, 1]))
    assert good["combined"] > bad["combined"] and good["coverage"] == 1.0
    assert good["coherence"] == 18.5 / 2 / 0.5 and good["separation"] == 1.0
    # no axis has two skills: three of four measures are at their floor, separation is 1, and k = n halves the mean
    assert np.isclose(sc.scheme(COUNTS, np.arange(4))["combined"], 4 / 3001 / 2)


def test_counts_and_significance():
    d = sc.jaccard_distances(COUNTS)
    scan = sc.cluster_counts(d, 3)
    assert scan.loc[scan.silhouette.idxmax(), "k"] == 2
    found = sc.significance(d, 2)
    assert found["silhouette"] > found["low"] and 0 <= found["p"] <= 1 and found["shuffles"] == 100 and found["significant"] == (found["p"] < 0.05)
    rng = np.random.default_rng(42)
    labels = np.array([0, 0, 1, 1])
    from quillspark.operators.clusters import silhouette

    drawn = [silhouette(d, rng.permutation(labels)) for _ in range(100)]
    assert found["p"] == round(np.mean([x >= silhouette(d, labels) for x in drawn]), 4) and found["high"] == round(np.percentile(drawn, 97.5), 4)
    assert sc.significance(d, 3) == {"silhouette": 0.0, "low": 0.0, "high": 0.0, "p": 1.0, "significant": False, "shuffles": 100}


def test_rand_index():
    a = np.array([0, 0, 1, 1, 2, 2])
    assert sc.rand_index(a, a) == 1.0 and sc.rand_index(a, np.array([5, 5, 3, 3, 0, 0])) == 1.0
    assert sc.rand_index(a, np.zeros(6, int)) == 0.0


def test_bootstrapped_rand(spark):
    import random

    random.seed(4)
    rows = [(i, i % 3, (i % 3) * 10, random.randrange(3), 7) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a int, b int, c int, d int")
    run = lambda labels, **k: metrics.bootstrapped_rand(df, "id", labels, **k).first()
    assert tuple(run(["a", "b"])) == (1.0, 1.0, 1.0, 50)
    mixed = run(["a", "c"], draws=40)
    assert abs(mixed.mean) < 0.03 and mixed.low < mixed.mean < mixed.high and mixed.n_draws == 40
    both = run(["a", "b", "c"], draws=200)
    assert 0.15 < both.mean < 0.55 and both.high == 1.0  # a third of the pairs agree
    assert tuple(run(["a", "d"])) == (0.0, 0.0, 0.0, 0) and tuple(run(["a"])) == (0.0, 0.0, 0.0, 0)
    assert tuple(metrics.bootstrapped_rand(df.limit(9), "id", ["a", "b"]).first()) == (0.0, 0.0, 0.0, 0)


def test_ranks_and_grades(spark):
    rows = [(None, 1.0), (5.0, 2.0), (1.0, 2.0), (5.0, 2.0), (9.0, 0.0)]
    got = metrics.average_ranks(spark.createDataFrame(rows, "x double, y double"), ["x", "y"]).collect()
    assert sorted(((r.x, r.r_x, r.r_y) for r in got), key=str) == sorted([(None, None, 2.0), (5.0, 2.5, 4.0), (1.0, 1.0, 4.0), (5.0, 2.5, 4.0), (9.0, 4.0, 1.0)], key=str)
    roles = spark.createDataFrame([(str(i), n) for i, n in enumerate([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9])], "role string, members int")
    order = sorted([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9])
    want = {n: 0 if n <= 0 else max([g for g in (1, 2, 3, 4) if n >= order[(11 * g // 5 or 11) - 1]], default=0) for n in order}
    assert {r.members: r.grade for r in axes.graded(roles).collect()} == want
    assert axes.graded(roles.limit(0)).count() == 0
    assert [r.grade for r in axes.graded(roles.where("role = '5'")).collect()] == [4]


def test_evaluation():
    rng = np.random.default_rng(3)
    group = np.repeat(np.arange(3), 6)
    counts = np.where(group[:, None] == group[None, :], 40, 2) + rng.integers(0, 3, (18, 18))
    counts = (counts + counts.T) / 2
    np.fill_diagonal(counts, 50)
    found = sc.evaluated(counts, range(2, 6), draws=30)
    assert found["optimal"].sum() == 1 and found["stability"].idxmax() == 1 and found["stability"][1] > 0.9
    assert np.isclose(found["combined"][1], sc.combined(1.0, 1.0, found["stability"][1], found["coherence"][1], 3, 18))
    assert (found["combined_low"] <= found["combined_high"]).all()


def test_names():
    skills = ["a", "b", "c", "d", "e"]
    found = sc.names(skills, {"a": "X", "b": "X", "c": "X"}, [{"a"}, set(skills)], draws=20).set_index("strategy")
    assert found["name"].to_dict() == {"top3": "a, b, c", "top1": "a", "heuristic": "X"}
    assert (found["distinctiveness"] == 1 - 1 / 5).all() and found["optimal"].sum() == 1
