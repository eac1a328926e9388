"""Tests, tails and temporal tiers against plain Python."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import career, characteristics, clusters, tails, temporal
from quillspark.operators import statistics as st


def simpson(f, high, n=20000):
    x = np.linspace(0, high, n + 1)
    y = f(x)
    return (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()) * high / n / 3


def chi_tail(x, k):
    return 1 - simpson(lambda u: 2 * u ** (k - 1) * np.exp(-u * u / 2) / (2 ** (k / 2) * math.gamma(k / 2)), math.sqrt(x))


def f_tail(f, a, b):
    scale = 2 * math.exp(math.lgamma((a + b) / 2) - math.lgamma(a / 2) - math.lgamma(b / 2))
    return scale * simpson(lambda t: np.sin(t) ** (b - 1) * np.cos(t) ** (a - 1), math.atan(math.sqrt(b / (a * f))))


def test_tails(spark):
    rows = [(x, k) for x in (0.01, 0.7, 3.0, 11.0, 40.0) for k in (1, 2, 5, 8)]
    df = spark.createDataFrame(rows, "x double, k int")
    for r in df.select("x", "k", tails.chi_squared(F.col("x"), F.col("k")).alias("p"), tails.erfc(F.col("x")).alias("e"), tails.two_sided(-F.col("x")).alias("z")).collect():
        assert abs(r.p - chi_tail(r.x, r.k)) < 1e-8 and abs(r.e - math.erfc(r.x)) < 1e-9 and abs(r.z - math.erfc(r.x / math.sqrt(2))) < 1e-9
    rows = [(f, a, b) for f in (0.2, 1.0, 4.0) for a in (1, 3, 8) for b in (4, 60, 5000)]
    df = spark.createDataFrame(rows, "f double, a int, b int")
    for r in df.select("f", "a", "b", tails.f_ratio(F.col("f"), F.col("a"), F.col("b")).alias("p")).collect():
        assert abs(r.p - f_tail(r.f, r.a, r.b)) < 1e-7
    none = spark.createDataFrame([(0.0, 0)], "x double, k int").select(tails.chi_squared(F.col("x"), F.col("k")).alias("p")).first()
    assert none.p == 1.0


def test_trend_of_short_and_flat_series(spark):
    rows = [("short", 1, 1.0), ("short", 2, 5.0), *(("flat", t, 3.0) for t in range(6)), *(("up", t, float(t)) for t in range(6)), *(("down", t, -float(t)) for t in range(6))]
    got = {r.g: r for r in st.mann_kendall(spark.createDataFrame(rows, "g string, t int, v double"), ["g"], "t", "v").collect()}
    assert (got["short"].p, got["short"].direction) == (1.0, "stable") and (got["flat"].tau, got["flat"].direction) == (0.0, "stable")
    assert (got["up"].tau, got["up"].direction, got["down"].direction) == (1.0, "growing", "declining")
    assert math.isclose(got["up"].p, math.erfc(15 / math.sqrt(6 * 5 * 17 / 18) / math.sqrt(2)), rel_tol=1e-6)


def test_exact_quantiles(spark):
    rng = np.random.default_rng(5)
    groups = {"a": rng.normal(size=501), "b": np.repeat([1.0, 2.0], 3), "c": np.array([7.0]), "d": np.append(rng.random(40), 1e9)}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("a", None), ("e", None)]
    got = {r.g: r for r in st.quantiles(spark.createDataFrame(rows, "g string, x double"), "g", "x", (0.0, 0.25, 0.5, 0.9, 1.0)).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        assert got[g].n == len(xs) and np.allclose(got[g].q, np.percentile(xs, [0, 25, 50, 90, 100]))


def test_common_odds_with_zero_cells(spark):
    strata = [(5, 3, 2, 8), (4, 0, 1, 6), (0, 0, 0, 1), (7, 7, 7, 7)]
    got = st.mantel_haenszel(spark.createDataFrame(strata, "a int, b int, c int, d int")).first()
    kept = [(a, b, c, d, a + b + c + d) for a, b, c, d in strata if a + b + c + d >= 2]
    gap = sum(a - (a + b) * (a + c) / n for a, b, c, d, n in kept)
    var = sum((a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1)) for a, b, c, d, n in kept)
    odds = sum(a * d / n for a, _, _, d, n in kept) / sum(b * c / n for _, b, c, _, n in kept)
    assert math.isclose(got.chi2, gap * gap / var) and math.isclose(got.odds_ratio, odds) and math.isclose(got.ci_high, odds * math.exp(1.96 / math.sqrt(var)))
    assert math.isclose(got.p, math.erfc(math.sqrt(gap * gap / var / 2)), rel_tol=1e-6)


def test_tiers(spark):
    rng = np.random.default_rng(1)
    seen = [("steady", 2010 + i % 8) for i in range(800)] + [("rising", 2010 + t) for t in range(8) for _ in range(20 * (t + 1))]
    seen += [("rare", 2015)]
    rows = spark.createDataFrame(seen, "characteristic string, year int")
    tier1 = {r.characteristic: r for r in temporal.stability(rows).collect()}
    count, total = Counter(seen), Counter(y for _, y in seen)
    for c, r in tier1.items():
        x, n, t = np.array([count[c, 2010 + i] for i in range(8)]), np.array([total[2010 + i] for i in range(8)]), np.arange(8)
        p = x.sum() / n.sum()
        z = (x @ t - p * (n @ t)) / math.sqrt(max(p * (1 - p), 1e-15) * max(n @ (t * t) - (n @ t) ** 2 / n.sum(), 1e-15))
        assert math.isclose(r.z, z, rel_tol=1e-9, abs_tol=1e-9) and r.is_stable == (math.erfc(abs(z) / math.sqrt(2)) > 0.05)
    assert not tier1["rising"].is_stable and tier1["rare"].first == 0.0
    tier3 = {r.characteristic: r for r in temporal.robustness(rows).collect()}
    assert not tier3["rising"].is_stable and all(r.slope_low <= r.slope_high for r in tier3.values())
    roles = [(int(i), int(y), c) for i in range(40) for y in range(2010, 2014) for c in ("x", "y") if rng.random() < (0.75 if (c == "x") == (i < 20) else 0.3)]
    roles += [(0, 2010, "once")]
    tier2 = {r.characteristic: r for r in temporal.association(spark.createDataFrame(roles, "role_id int, year int, characteristic string")).collect()}
    assert tier2["x"].is_associated and tier2["x"].odds_ratio > 1 > tier2["y"].odds_ratio and tier2["once"].skipped and not tier2["once"].is_associated
    one = temporal.verdict(rows).first()
    assert one.n_tests == 9 and one.passed == (one.n_passed >= 0.8 * 9)


def test_resampling_alone():
    flat = np.full(6, 50.0)
    assert temporal.permuted(flat, np.full(6, 100.0))[1] == 1.0 and temporal.permuted(flat[:1], np.full(1, 100.0)) == (0.0, 1.0)
    mean, low, high = temporal.bootstrapped(np.arange(12.0))
    assert low <= mean <= high and temporal.bootstrapped(np.zeros(1)) == (0.0, 0.0, 0.0)
    # the same draws as one by one
    rng, slopes, series = np.random.default_rng(42), [], np.array([1.0, 3.0, 2.0, 5.0, 4.0])
    for _ in range(50):
        at = [s + j for s in (rng.integers(0, 3), rng.integers(0, 3)) for j in range(3)][:5]
        slopes.append(np.polyfit(np.arange(5), series[at], 1)[0])
    assert np.allclose(temporal.bootstrapped(series, draws=50), [np.mean(slopes), *np.percentile(slopes, [2.5, 97.5])])
    walk, step = temporal.power(np.array([0.2, 0.2, 0.21, 0.2, 0.19, 0.2, 0.2, 0.2]), runs=400)
    assert 0 < walk < 1 and 0 < step < 1 and temporal.power(np.zeros(3)) == (0.0, 0.0)


def test_leaders_over_all_rows(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 8))
    vectors = np.concatenate([base, base + 0.15 * rng.normal(size=base.shape), rng.normal(size=(20, 8))])
    rows = [(i, i % 5, v.tolist()) for i, v in enumerate(vectors)]
    got = {r.k: r.leader for r in clusters.greedy_leaders(spark.createDataFrame(rows, "k long, w long, v array<double>"), "k", "w", "v", 0.85).collect()}
    unit, want, leaders = vectors / np.linalg.norm(vectors, axis=1, keepdims=True), {}, []
    for i in sorted(range(len(rows)), key=lambda i: (-(i % 5), i)):
        near = [j for j in leaders if unit[i] @ unit[j] >= 0.85]
        want[i] = near[0] if near else i
        if not near:
            leaders.append(i)
    assert got == want and len(leaders) < len(rows)
    empty = spark.createDataFrame([], "k long, w long, v array<double>")
    assert clusters.greedy_leaders(empty, "k", "w", "v", 0.85).count() == 0
    pairs = clusters.similar_pairs(spark.createDataFrame([(i, unit[i].tolist()) for i in range(len(unit))], "k long, v array<double>"), "k", "v", 0.85, block=7)
    assert {(r.a, r.b) for r in pairs.collect()} == {(i, j) for i in range(len(unit)) for j in range(i + 1, len(unit)) if unit[i] @ unit[j] >= 0.85}


def test_switch_falls_back(spark):
    axes = list(career.JUNIOR)
    rows = [(r, a, float(x)) for r, xs in {"a": [5, 1, 1, 1, 1, 1, 1], "b": [5, 1, 1, 1, 1, 1, 2], "c": [1, 1, 5, 1, 4, 1, 1]}.items() for a, x in zip(axes, xs)]
    profile = spark.createDataFrame(rows, "role string, axis string, proficiency double")
    found = {(r.source, r.target): r.fallback for r in career.transitions(profile, least=0.9).collect()}
    assert found[("a", "b")] is False and [k for k, v in found.items() if v] == [("c", "b")]
    gaps = {r.source: r.gap for r in career.leadership(profile).collect()}
    assert gaps["a"] == 6.0 and gaps["c"] == 4 - 1.25 + 3


@pytest.mark.parametrize("empty", [True, False])
def test_terms(spark, empty):
    rows = spark.createDataFrame([("Steel rod",), (None,)], "t string").select(characteristics.contains_any(F.col("t"), [] if empty else ["STEEL"], True).alias("x"))
    assert [r.x for r in rows.collect()] == ([True, True] if empty else [True, False])
