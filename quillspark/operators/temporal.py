"""Three tiers of tests that characteristics hold over the years: stability, association and robustness.

observations: characteristic, year, one row an observation; assignments: role_id, year, characteristic. Years are few;
what one task gathers is a row for each year of one characteristic.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators import statistics as st

SEED, SHUFFLES, DRAWS, RUNS, BLOCK, DRIFT = 42, 1000, 5000, 10_000, 3, 0.02


def yearly(observations: DataFrame) -> DataFrame:
    """characteristic, year, present, total for every characteristic and year; total is of all observations of the year."""
    counts = observations.groupBy("characteristic", "year").agg(F.count("*").alias("present"))
    totals = counts.groupBy("year").agg(F.sum("present").alias("total"))
    grid = counts.select("characteristic").distinct().crossJoin(F.broadcast(totals))  # characteristics times years
    return grid.join(counts, ["characteristic", "year"], "left").select("characteristic", "year", F.coalesce("present", F.lit(0)).alias("present"), "total")


def stability(observations: DataFrame) -> DataFrame:
    """characteristic, n_years, z, p, is_stable, first, last (prevalence): the trend test of each characteristic."""
    rows = yearly(observations)
    tested = st.cochran_armitage(rows, ["characteristic"], "year", "present", "total")
    share = F.round(F.col("present") / F.col("total"), 4)
    ends = rows.groupBy("characteristic").agg(F.min_by(share, "year").alias("first"), F.max_by(share, "year").alias("last"))
    return tested.join(ends, "characteristic")


def association(assignments: DataFrame) -> DataFrame:
    """characteristic, strata, chi2, p, odds_ratio, ci_low, ci_high, is_associated, skipped.

    Roles are split in halves by sort order; of each year the roles of a half with and without the characteristic make
    a stratum, unless a cell is zero. Fewer than two strata: skipped, not associated.
    """
    roles = assignments.select("role_id").distinct()
    total = roles.agg(F.count("*").alias("n"))
    # range-parted ranks: the lower half are the roles below the middle one
    middle = roles.select(F.ntile(2).over(Window.orderBy(F.desc("role_id"))).alias("half"), "role_id")
    halves = middle.groupBy("half").agg(F.count("*").alias("size"))
    sizes = halves.groupBy().pivot("half", [1, 2]).agg(F.first("size"))
    with_it = assignments.distinct().join(middle, "role_id").groupBy("characteristic", "year").agg(
        F.count_if(F.col("half") == 2).alias("a"), F.count_if(F.col("half") == 1).alias("b")
    )
    cells = with_it.crossJoin(F.broadcast(sizes)).select("characteristic", "a", "b", (F.col("2") - F.col("a")).alias("c"), (F.col("1") - F.col("b")).alias("d"))
    tested = st.mantel_haenszel(st.full_strata(cells), ["characteristic"])
    every = with_it.select("characteristic").distinct().crossJoin(F.broadcast(total))
    out = every.join(tested, "characteristic", "left").withColumn("skipped", (F.coalesce("strata", F.lit(0)) < 2) | (F.col("n") < 2))
    kept = lambda c: F.when(~F.col("skipped"), F.col(c)).alias(c)
    return out.select(
        "characteristic", F.coalesce("strata", F.lit(0)).alias("strata"), *[kept(c) for c in ("chi2", "p", "odds_ratio", "ci_low", "ci_high")],
        F.coalesce(F.col("is_associated") & ~F.col("skipped"), F.lit(False)).alias("is_associated"), "skipped",
    )


def permuted(present: np.ndarray, total: np.ndarray, shuffles: int = SHUFFLES, seed: int = SEED) -> tuple[float, float]:
    """The variance of the yearly shares, and how often it is reached when years are dealt to observations anew (the
    numbers of present ones by year are then a multivariate hypergeometric draw)."""
    if len(total) < 2:
        return 0.0, 1.0
    seen = float(np.var(present / total, ddof=1))
    method = "marginals" if total.sum() >= 1_000_000 else "count"
    drawn = np.random.default_rng(seed).multivariate_hypergeometric(total.astype(np.int64), int(present.sum()), shuffles, method=method)
    return seen, float(np.mean(np.var(drawn / total, axis=1, ddof=1) >= seen - 1e-15))


def bootstrapped(series: np.ndarray, block: int = BLOCK, draws: int = DRAWS, seed: int = SEED) -> tuple[float, float, float]:
    """Mean and 95 % interval of the slope over resampled blocks of consecutive years."""
    n = len(series)
    if n < 2:
        return 0.0, 0.0, 0.0
    size = min(block, n)
    starts = np.random.default_rng(seed).integers(0, n - size + 1, (draws, -(-n // size)))
    picked = series[(starts[:, :, None] + np.arange(size)).reshape(draws, -1)[:, :n]]
    x = np.arange(n) - (n - 1) / 2
    slopes = (picked - picked.mean(axis=1, keepdims=True)) @ x / (x @ x)
    low, high = np.percentile(slopes, [2.5, 97.5])
    return float(slopes.mean()), float(low), float(high)


def _trended(series: np.ndarray) -> np.ndarray:
    """Which rows have a trend at 5 % (two-sided, by Kendall's S)."""
    n = series.shape[1]
    i, j = np.triu_indices(n, 1)
    s = np.sign(series[:, j] - series[:, i]).sum(axis=1)
    return np.abs(s) / np.sqrt(n * (n - 1) * (2 * n + 5) / 18) >= 1.959963984540054


def power(series: np.ndarray, runs: int = RUNS, drift: float = DRIFT, seed: int = SEED) -> tuple[float, float]:
    """How often random walks from the mean pass as stable, and how often a step at a random year is noticed; 0, 0 for
    fewer than four years."""
    n = len(series)
    if n < 4:
        return 0.0, 0.0
    rng, base = np.random.default_rng(seed), float(series.mean())
    walks = base + np.cumsum(rng.normal(0.0, drift, (runs, n)), axis=1)
    height = max(float(np.std(series, ddof=1)) * 1.5, 3 * drift)
    steps = np.full((runs, n), base)
    for row in steps:  # one draw of the year and then of the noise each
        row[rng.integers(1, n) :] += height
        row += rng.normal(0.0, drift * 0.5, n)
    return float(np.mean(~_trended(walks))), float(np.mean(_trended(steps)))


def robustness(observations: DataFrame) -> DataFrame:
    """characteristic, variance, p_permuted, is_stable, slope_mean, slope_low, slope_high, zero_in_interval,
    power_walk, power_step of each characteristic."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("year")
        present, total = pdf["present"].to_numpy(float), pdf["total"].to_numpy(float)
        variance, p = permuted(present, total)
        mean, low, high = bootstrapped(present / total)
        walk, step = power(present / total)
        row = [pdf["characteristic"].iloc[0], variance, p, p > 0.05, mean, low, high, low <= 0 <= high, walk, step]
        return pd.DataFrame([row], columns=[c.split()[0] for c in schema.split(", ")])

    schema = (
        "characteristic string, variance double, p_permuted double, is_stable boolean, slope_mean double, slope_low double, "
        "slope_high double, zero_in_interval boolean, power_walk double, power_step double"
    )
    return yearly(observations).groupBy("characteristic").applyInPandas(run, schema)


def verdict(observations: DataFrame, assignments: DataFrame | None = None, least: float = 0.8) -> DataFrame:
    """One row: n_tests, n_passed, frac_passed, passed over all tiers: stability, association (where there are
    assignments), and of robustness the permutation test and the interval of the slope."""
    tier1 = stability(observations).agg(F.count("*").alias("n"), F.count_if("is_stable").alias("k"))
    tier3 = robustness(observations).agg((2 * F.count("*")).alias("n"), (F.count_if("is_stable") + F.count_if("zero_in_interval")).alias("k"))
    tests = tier1.unionByName(tier3)
    if assignments is not None:
        tests = tests.unionByName(association(assignments).agg(F.count("*").alias("n"), F.count_if("is_associated").alias("k")))
    sums = tests.agg(F.sum("n").alias("n_tests"), F.sum("k").alias("n_passed"))
    share = F.col("n_passed") / F.greatest("n_tests", F.lit(1))
    return sums.select("n_tests", "n_passed", F.round(share, 4).alias("frac_passed"), (F.col("n_passed") >= F.col("n_tests") * least).alias("passed"))
