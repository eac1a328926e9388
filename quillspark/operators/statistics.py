"""Statistical tests as aggregates over DataFrames; every test has a result for too little data.

p-values are columns too (quillspark.operators.tails).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark import stages
from quillspark.functions import studentized
from quillspark.operators import tails


def mann_kendall(rows: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """by, n, s, tau, z, p, direction: Kendall's S of the values in order, tau = S / (n (n - 1) / 2), no tie correction.

    One array of (at, value) per group, so a group should be a time series of a bounded number of periods.
    """
    series = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("t"), F.col(value).cast("double").alias("v")))).alias("xs"))
    n = F.size("xs")
    later = lambda i: F.slice(F.col("xs"), i + 2, F.greatest(n - i - 1, F.lit(0)))
    signs = F.transform(F.col("xs"), lambda x, i: F.aggregate(later(i), F.lit(0.0), lambda s, y: s + F.signum(y["v"] - x["v"])))
    s = F.aggregate(signs, F.lit(0.0), lambda a, b: a + b)
    tau = F.coalesce(F.try_divide(F.col("s"), F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0))
    var = F.col("n") * (F.col("n") - 1) * (2 * F.col("n") + 5) / 18
    few = F.col("n") < 3
    return (
        series.select(*by, n.cast("long").alias("n"), s.alias("s"))
        .withColumn("tau", F.when(few, 0.0).otherwise(tau))
        .withColumn("z", F.when(few, 0.0).otherwise(F.coalesce(F.try_divide(F.col("s"), F.sqrt(var)), F.lit(0.0))))
        .withColumn("p", F.when(few, 1.0).otherwise(tails.two_sided(F.col("z"))))
        .withColumn("direction", trend(F.col("tau"), F.col("p")))
    )


def trend(tau: Column, p: Column) -> Column:
    moving = (p < 0.05) | (F.abs(tau) > 0.3)
    return F.when(moving & (tau > 0), "growing").when(moving & (tau < 0), "declining").otherwise("stable")


def chi_squared(cells: DataFrame, row: str, column: str, count: str) -> DataFrame:
    """One row: chi2, dof, n, cramers_v, p of a table of counts, with Yates' correction where dof is 1; 0 for too little."""
    dense = (
        cells.select(row).distinct().crossJoin(cells.select(column).distinct()).join(cells, [row, column], "left")
        .select(row, column, F.coalesce(count, F.lit(0)).cast("double").alias("o"))
    )  # as many rows as the table has cells
    r = dense.groupBy(row).agg(F.sum("o").alias("__r"))
    c = dense.groupBy(column).agg(F.sum("o").alias("__c"))
    shape = r.agg(F.count("*").alias("nr"), F.sum("__r").alias("__n")).crossJoin(c.agg(F.count("*").alias("nc")))
    full = dense.join(r, row).join(c, column).crossJoin(F.broadcast(shape)).withColumn("e", F.col("__r") * F.col("__c") / F.col("__n"))
    dof = (F.col("nr") - 1) * (F.col("nc") - 1)
    gap = F.abs(F.col("o") - F.col("e"))
    gap = F.when(dof == 1, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    stat = full.groupBy("nr", "nc", F.col("__n").alias("n")).agg(F.sum(F.try_divide(gap * gap, F.col("e"))).alias("chi2"))
    enough = (F.col("nr") > 1) & (F.col("nc") > 1) & (F.col("n") >= 10)
    k = F.least("nr", "nc") - 1
    return stat.select(
        F.when(enough, F.col("chi2")).otherwise(0.0).alias("chi2"),
        F.when(enough, dof).otherwise(0).cast("long").alias("dof"),
        F.col("n").cast("long").alias("n"),
        F.when(enough, F.sqrt(F.col("chi2") / (F.col("n") * k))).otherwise(0.0).alias("cramers_v"),
        F.when(enough, tails.chi_squared(F.col("chi2"), dof)).otherwise(1.0).alias("p"),
    )


def anova(rows: DataFrame, group: str, value: str, least: int = 3) -> DataFrame:
    """One row: f, between, within (degrees of freedom), p over groups of `least` rows or more; 0 for too little."""
    x = F.col(value).cast("double")
    groups = rows.groupBy(group).agg(F.count("*").alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v")).where(F.col("n") >= least)
    sums = groups.agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"),
        F.sum(F.col("n") * F.col("v")).alias("ssw"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"),
    )
    ssb = F.col("q") - F.col("n") * F.col("mean") * F.col("mean")
    f = F.try_divide(ssb / (F.col("k") - 1), F.col("ssw") / (F.col("n") - F.col("k")))
    found = sums.select(
        F.when(F.col("k") > 1, f).otherwise(0.0).alias("f"), (F.col("k") - 1).alias("between"), (F.col("n") - F.col("k")).alias("within")
    )
    return found.withColumn("p", F.when(F.col("between") < 1, 1.0).otherwise(tails.f_ratio(F.col("f"), F.col("between"), F.col("within"))))


def mean_differences(rows: DataFrame, group: str, value: str, least: int = 3, detail: bool = False) -> DataFrame:
    """group1, group2, meandiff, q of each pair of groups (group1 < group2): the difference of their means, and the
    studentized range statistic of Tukey and Kramer, |meandiff| over the root of half the pooled variance of a mean. detail: with that root (error), the number of groups and
    the degrees of freedom within them."""
    x = F.col(value).cast("double")
    groups = rows.groupBy(group).agg(F.count("*").alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v")).where(F.col("n") >= least)
    within = F.sum("n") - F.count("*")
    pooled = groups.agg(F.try_divide(F.sum(F.col("n") * F.col("v")), within).alias("mse"), F.count("*").alias("groups"), within.alias("within"))
    side = lambda k: groups.select(F.col(group).alias(f"group{k}"), F.col("n").alias(f"n{k}"), F.col("m").alias(f"m{k}"))
    pairs = side(1).join(side(2), F.col("group1") < F.col("group2")).crossJoin(F.broadcast(pooled))  # one row for each pair of groups
    gap = F.col("m2") - F.col("m1")
    error = F.sqrt(F.col("mse") / 2 * (1 / F.col("n1") + 1 / F.col("n2")))
    return pairs.select("group1", "group2", gap.alias("meandiff"), F.try_divide(F.abs(gap), error).alias("q"), *([error.alias("error"), "groups", "within"] if detail else []))


def tukey(rows: DataFrame, group: str, value: str, least: int = 3, alpha: float = 0.05) -> DataFrame:
    """group1, group2, meandiff, q, p, lower, upper, reject: the honest significant differences of Tukey and Kramer, with the
    interval of the difference at 1 - alpha; no rows for fewer than two groups, nulls where nothing varies within groups."""
    stages.ship(rows.sparkSession)
    found = mean_differences(rows, group, value, least, detail=True)
    both = found.withColumn("p", studentized.above("q", "groups", "within")).withColumn("wide", F.col("error") * studentized.critical(F.lit(alpha), "groups", "within"))
    gap = F.col("meandiff")
    return both.select("group1", "group2", "meandiff", "q", "p", (gap - F.col("wide")).alias("lower"), (gap + F.col("wide")).alias("upper"), (F.col("p") < alpha).alias("reject"))


def cochran_armitage(rows: DataFrame, by: list[str], at: str, hits: str, total: str) -> DataFrame:
    """by, n_years, z, p, is_stable: the trend of the share hits / total over periods, whose scores are 0, 1, 2, ...
    in order; both factors of the variance are 1e-15 at least."""
    from pyspark.sql import Window

    scored = rows.withColumn("t", (F.dense_rank().over(Window.partitionBy(*by).orderBy(at)) - 1).cast("double"))
    n, r = F.col(total).cast("double"), F.col(hits).cast("double")
    sums = scored.groupBy(*by).agg(
        F.count_distinct("t").alias("n_years"), F.sum(n).alias("n"), F.sum(r).alias("r"), F.sum(n * F.col("t")).alias("nt"),
        F.sum(r * F.col("t")).alias("rt"), F.sum(n * F.col("t") * F.col("t")).alias("ntt"),
    )
    p = F.coalesce(F.try_divide("r", "n"), F.lit(0.0))
    var = F.greatest(p * (1 - p), F.lit(1e-15)) * F.greatest(F.col("ntt") - F.try_divide(F.col("nt") * F.col("nt"), F.col("n")), F.lit(1e-15))
    z = F.when(F.sqrt(var) > 1e-15, (F.col("rt") - p * F.col("nt")) / F.sqrt(var)).otherwise(0.0)
    tested = sums.select(*by, "n_years", z.alias("z")).withColumn("p", tails.two_sided(F.col("z")))
    return tested.withColumn("is_stable", F.col("p") > 0.05)


def full_strata(strata: DataFrame) -> DataFrame:
    """The 2 x 2 strata (a, b, c, d) without a zero cell."""
    return strata.where((F.col("a") > 0) & (F.col("b") > 0) & (F.col("c") > 0) & (F.col("d") > 0))


def mantel_haenszel(strata: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, strata, chi2, p, odds_ratio, ci_low, ci_high, is_associated: Cochran-Mantel-Haenszel over 2 x 2 strata
    (a, b, c, d) of two rows at least, without continuity correction."""
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    n = a + b + c + d
    sums = strata.groupBy(*(by or [])).agg(
        F.count("*").alias("strata"), F.sum(F.when(n >= 2, a - (a + b) * (a + c) / n)).alias("gap"),
        F.sum(F.when(n >= 2, (a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1)))).alias("var"),
        F.sum(F.when(n >= 2, a * d / n)).alias("up"), F.sum(F.when(n >= 2, b * c / n)).alias("down"),
    )
    zero = F.lit(0.0)
    gap, var, up, down = (F.coalesce(x, zero) for x in ("gap", "var", "up", "down"))
    margin = 1.96 / F.sqrt(F.greatest(var, F.lit(1e-15)))
    found = sums.select(
        *(by or []), "strata", F.when(var > 1e-15, gap * gap / F.nullif(var, zero)).otherwise(0.0).alias("chi2"),
        F.when(down > 1e-15, up / F.nullif(down, zero)).otherwise(1.0).alias("odds_ratio"), margin.alias("__m"),
    )
    p = tails.erfc(F.sqrt(F.col("chi2") / 2))  # one degree of freedom
    return found.select(
        *(by or []), "strata", "chi2", p.alias("p"), "odds_ratio", (F.col("odds_ratio") * F.exp(-F.col("__m"))).alias("ci_low"),
        (F.col("odds_ratio") * F.exp(F.col("__m"))).alias("ci_high"), (p < 0.05).alias("is_associated"),
    )


def breslow_day(strata: DataFrame) -> DataFrame:
    """One row: chi2, dof, p, is_homogeneous of the homogeneity of odds ratios over 2 x 2 strata (a, b, c, d); strata
    without rows in the first row or in either column add nothing."""
    common = mantel_haenszel(strata).select(F.col("odds_ratio").alias("r"))
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    r, m1, m0, n1, n = F.col("r"), a + c, b + d, a + b, a + b + c + d
    kept = (n >= 2) & (n1 > 0) & (m1 > 0) & (m0 > 0)
    # the expected a solves (r - 1) x^2 - (r (n1 + m1) + m0 - n1) x + r n1 m1 = 0 within what the margins allow
    q, l, k, flat = r - 1, -(r * (n1 + m1) + m0 - n1), r * n1 * m1, n1 * m1 / n  # noqa: E741
    root = F.sqrt(F.greatest(l * l - 4 * q * k, F.lit(0.0)))
    first, second = ((sign * root - l) / (2 * F.nullif(q, F.lit(0.0))) for sign in (1, -1))
    within = lambda x: (x >= F.greatest(F.lit(0.0), n1 + m1 - n)) & (x <= F.least(n1, m1))
    x = F.when(F.abs(q) < 1e-15, flat).when(within(first), first).when(within(second), second).otherwise(flat)
    small = F.lit(1e-12)
    e = F.greatest(small, F.least(F.col("x"), n1 - 1e-12))
    var = 1 / (1 / e + 1 / F.greatest(small, n1 - e) + 1 / F.greatest(small, m1 - e) + 1 / F.greatest(small, m0 - n1 + e))
    var = F.when(r == 1, n1 * m1 * (n - n1) * (n - m1) / (n * n * (n - 1))).otherwise(var)
    full = strata.crossJoin(F.broadcast(common)).withColumn("x", x).withColumn("var", var)
    gap = (a - F.col("x")) * (a - F.col("x")) / F.col("var")
    sums = full.agg(F.sum(F.when(kept & (F.col("var") > 1e-15), gap)).alias("chi2"), (F.count("*") - 1).alias("dof"))
    found = sums.select(F.coalesce("chi2", F.lit(0.0)).alias("chi2"), F.greatest("dof", F.lit(0)).alias("dof"))
    return found.withColumn("p", tails.chi_squared(F.col("chi2"), F.col("dof"))).withColumn("is_homogeneous", F.col("p") > 0.05)


def kappa_level(kappa: Column) -> Column:
    # fixed values: the levels of agreement and where they begin
    levels = [("poor", 0.0), ("slight", 0.21), ("fair", 0.41), ("moderate", 0.61), ("substantial", 0.81)]
    out = F
    for name, below in levels:
        out = out.when(kappa < below, name)
    return out.otherwise("almost_perfect")


def fleiss_kappa(rows: DataFrame, subject: str, category: str, count: str) -> DataFrame:
    """One row: kappa, z, p, level of subjects rated by equally many raters, from counts of each subject and category."""
    n = F.col(count).cast("double")
    per = rows.groupBy(subject).agg(F.sum(n).alias("m"), F.sum(n * n).alias("q")).where("m > 1")
    agreed = per.agg(F.avg((F.col("q") - F.col("m")) / (F.col("m") * (F.col("m") - 1))).alias("p"), F.avg("m").alias("m"), F.count("*").alias("subjects"))
    shares = rows.join(per.select(subject), subject, "left_semi").groupBy(category).agg(F.sum(n).alias("s"))
    total = shares.agg(F.sum("s").alias("t"))
    share = F.col("s") / F.col("t")
    chance = shares.crossJoin(F.broadcast(total)).agg(F.sum(share * share).alias("e"), F.sum(share * share * share).alias("cubes"))
    e, m = F.col("e"), F.col("m")
    free = 1 - e
    kappa = F.when(free > 1e-15, (F.col("p") - e) / F.nullif(free, F.lit(0.0))).otherwise(0.0)
    var = 2 / (F.col("subjects") * m * (m - 1)) * (e - (2 * m - 3) * e * e + 2 * (m - 2) * F.col("cubes")) / F.nullif(free * free, F.lit(0.0))
    error = F.sqrt(F.when(free > 1e-15, F.greatest(var, F.lit(1e-15))).otherwise(1e15))
    found = agreed.crossJoin(chance).select(kappa.alias("kappa"), F.when(error > 1e-15, kappa / error).otherwise(0.0).alias("z"))
    return found.select("kappa", "z", tails.two_sided(F.col("z")).alias("p"), kappa_level(F.col("kappa")).alias("level"))


def resampled(rows: DataFrame, by: str, at: str, value: str, seed: int = 42, shuffles: int = 1000, draws: int = 5000, block: int = 3) -> DataFrame:
    """by, p_stable, slope_low, slope_high: a permutation p of the variance of period means, and a block bootstrap
    interval of the slope over periods; one short series per group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([at, value])
        rng = np.random.default_rng(seed)
        t, x = pdf[at].to_numpy(), pdf[value].to_numpy(float)
        periods, own = np.unique(t, return_inverse=True)
        means = lambda v: np.bincount(own, v) / np.bincount(own)
        if len(periods) < 3:
            return pd.DataFrame({by: [pdf[by].iloc[0]], "p_stable": [1.0], "slope_low": [0.0], "slope_high": [0.0]})
        seen = means(x).var(ddof=1)
        p = float(np.mean([means(rng.permutation(x)).var(ddof=1) >= seen for _ in range(shuffles)]))
        series, size = means(x), min(block, len(periods))
        starts = rng.integers(0, len(series) - size + 1, (draws, -(-len(series) // size)))
        picked = (starts[:, :, None] + np.arange(size)).reshape(draws, -1)[:, : len(series)]
        years = np.arange(len(series)) - (len(series) - 1) / 2
        slopes = series[picked] @ years / (years @ years)
        low, high = np.percentile(slopes, [2.5, 97.5])
        return pd.DataFrame({by: [pdf[by].iloc[0]], "p_stable": [p], "slope_low": [low], "slope_high": [high]})

    kind = rows.schema[by].dataType.simpleString()
    return rows.select(by, at, value).groupBy(by).applyInPandas(run, f"{by} {kind}, p_stable double, slope_low double, slope_high double")


def correlation(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row: rho, n, p (two-sided, by the t distribution) of two columns; 0 and 1 for fewer than three rows."""
    found = rows.agg(F.corr(x, y).alias("rho"), F.count("*").alias("n"))
    rho, n = F.coalesce(F.nanvl("rho", F.lit(0.0)), F.lit(0.0)), F.col("n")
    free = (1 - rho) * (1 + rho)
    t = F.abs(rho) * F.sqrt(F.try_divide(n - 2, free))
    p = F.when(n < 3, 1.0).when(free <= 0, 0.0).otherwise(tails.t_two_sided(t, n - 2))
    return found.select(rho.alias("rho"), "n", p.alias("p"))


def series_trends(dense: DataFrame, by: str, at: str, count: str, least: int = 2) -> DataFrame:
    """by, tau, p, direction, slope, total, newly_emerged of series with a value of `least` or more somewhere.

    dense has a row for each of by and at. New: absent first, there last, and not already growing.
    """
    ends = dense.groupBy(by).agg(
        F.round(F.coalesce(F.regr_slope(count, at), F.lit(0.0)), 3).alias("slope"), F.sum(count).alias("total"), F.max(count).alias("peak"),
        F.min_by(count, at).alias("first"), F.max_by(count, at).alias("last"),
    ).where(F.col("peak") >= least)
    rows = mann_kendall(dense, [by], at, count).join(ends, by)
    new = (F.col("first") == 0) & (F.col("last") > 0) & (F.col("direction") != "growing")
    return rows.select(by, F.round("tau", 3).alias("tau"), F.round("p", 4).alias("p"), "direction", "slope", "total", new.alias("newly_emerged"))


def trend_verdict(trends: DataFrame) -> DataFrame:
    """One row: n, stable, growing, stability_pct, verdict."""
    sums = trends.agg(F.count("*").alias("n"), F.count_if(F.col("direction") == "stable").alias("stable"), F.count_if(F.col("direction") == "growing").alias("growing"))
    share = F.coalesce(F.try_divide(100.0 * F.col("stable"), F.col("n")), F.lit(0.0))
    verdict = F.when(share > 60, "stable").when(share > 30, "partly stable").otherwise("unstable")
    return sums.select("n", "stable", "growing", F.round(share, 1).alias("stability_pct"), verdict.alias("verdict"))


def quantiles(rows: DataFrame, by: str, value: str, shares: tuple[float, ...], parts: int = 1024) -> DataFrame:
    """by, n, q (array): exact quantiles of each group with linear interpolation; null values are left out.

    Values are counted in `parts` equal ranges of each group first; only the ranges that hold the ranks asked for are
    sorted, so no group is gathered in one task.
    """
    from pyspark.sql import Window

    kept = rows.where(F.col(value).isNotNull()).select(by, F.col(value).alias("x"))
    ends = kept.groupBy(by).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    place = F.least(F.lit(parts - 1), F.floor(F.coalesce(F.try_divide((F.col("x") - F.col("low")) * parts, F.col("high") - F.col("low")), F.lit(0.0))).cast("int"))
    placed = kept.join(ends, by).withColumn("part", place)
    counts = placed.groupBy(by, "part", "n").agg(F.count("*").alias("k"))
    before = Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # `parts` rows at most
    ranks = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), (F.lit(q) * (F.col("n") - 1)).alias("at")) for i, q in enumerate(shares) for side in (0, 1)]))
    starts = counts.withColumn("start", F.coalesce(F.sum("k").over(before), F.lit(0))).withColumn("r", ranks)
    rank = F.when(F.col("r.side") == 0, F.floor("r.at")).otherwise(F.ceil("r.at"))
    asked = starts.withColumn("rank", rank).where((F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("start") + F.col("k")))
    wanted = asked.select(by, "part", F.col("r.i").alias("i"), F.col("r.side").alias("side"), F.col("r.at").alias("at"), (F.col("rank") - F.col("start")).alias("nth"))
    few = wanted.select(by, "part").distinct()
    ordered = placed.join(few, [by, "part"], "left_semi").withColumn("nth", (F.row_number().over(Window.partitionBy(by, "part").orderBy("x")) - 1).cast("long"))
    found = ordered.join(wanted, [by, "part", "nth"]).groupBy(by, "n", "i", "at").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    exact = F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))
    return found.groupBy(by, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", exact.alias("v")))), lambda s: s["v"]).alias("q"))
