"""The studentized range against published quantiles, closed forms and plain sums, and Tukey's intervals from it."""

import math
import random

import pytest

from quillspark.functions import studentized
from quillspark.operators import statistics as st


@pytest.mark.parametrize(
    ("p", "k", "df", "want"),
    [(0.95, 3, 10, 3.877), (0.95, 2, 5, 3.635), (0.95, 10, 120, 4.560), (0.95, 3, 1, 26.976), (0.95, 4, 2, 9.798), (0.99, 3, 5, 6.976), (0.95, 20, 60, 5.241), (0.95, 5, 1e6, 3.858)],
)
def test_published_quantiles(p, k, df, want):
    assert abs(studentized.quantile(p, k, df) - want) < 6e-4
    assert abs(studentized.below(studentized.quantile(p, k, df), k, df) - p) < 1e-9


@pytest.mark.parametrize("q", [0.01, 0.5, 2.0, 3.7, 9.0, 40.0])
def test_two_groups_are_students_t(q):
    t = q / math.sqrt(2)
    assert abs(studentized.below(q, 2, 1) - 2 * math.atan(t) / math.pi) < 1e-6
    assert abs(studentized.below(q, 2, 2) - t / math.sqrt(2 + t * t)) < 1e-7
    x = t / 2  # four degrees of freedom in closed form
    s = t / math.sqrt(4 + t * t)
    assert abs(studentized.below(q, 2, 4) - s * (1 + 2 / (4 + t * t))) < 1e-7 and x >= 0
    assert studentized.below(0, 2, 4) == 0.0


def test_range_by_a_fine_sum():
    phi = lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2)))
    for w, k in ((0.7, 3), (3.1, 3), (4.2, 8)):
        step = 1e-3
        total = sum(k * math.exp(-z * z / 2) / math.sqrt(2 * math.pi) * (phi(z) - phi(z - w)) ** (k - 1) * step for z in (i * step for i in range(-9000, 9001)))
        assert abs(studentized.range_below([w], k)[0] - total) < 1e-9


def test_tukey(spark):
    random.seed(2)
    rows = [(g, random.gauss(m, 1)) for g, m, n in (("a", 0, 12), ("b", 0.1, 9), ("c", 3, 15)) for _ in range(n)] + [("few", 9.0)]
    got = {(r.group1, r.group2): r for r in st.tukey(spark.createDataFrame(rows, "g string, x double"), "g", "x").collect()}
    assert got.keys() == {("a", "b"), ("a", "c"), ("b", "c")}
    own = {g: [x for h, x in rows if h == g] for g in "abc"}
    mean = {g: sum(v) / len(v) for g, v in own.items()}
    mse = sum((x - mean[g]) ** 2 for g, v in own.items() for x in v) / (36 - 3)
    for (a, b), r in got.items():
        error = math.sqrt(mse / 2 * (1 / len(own[a]) + 1 / len(own[b])))
        q = abs(mean[b] - mean[a]) / error
        wide = studentized.quantile(0.95, 3, 33) * error
        assert abs(r.p - (1 - studentized.below(q, 3, 33))) < 1e-9 and r.reject == (r.p < 0.05)
        assert abs(r.lower - (mean[b] - mean[a] - wide)) < 1e-8 and abs(r.upper - (mean[b] - mean[a] + wide)) < 1e-8
        assert r.reject == (r.lower > 0 or r.upper < 0)
    assert got["a", "c"].reject and not got["a", "b"].reject
    assert st.tukey(spark.createDataFrame([("a", 1.0)] * 5, "g string, x double"), "g", "x").count() == 0
    flat = st.tukey(spark.createDataFrame([("a", 1.0)] * 5 + [("b", 2.0)] * 5, "g string, x double"), "g", "x").first()
    assert flat.q is None and flat.p is None
