"""Trends, associations and stability over yearly series and contingency tables of orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import statistics as st
from quillspark.operators.metrics import average_ranks
from quillspark.plans.registry import query, table



def _simpson(f: str, high: str, steps: int) -> str:
    """SQL: Simpson's rule over f (of t) from 0 to high."""
    weight = f"CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"(list_sum(list_transform(range(0, {steps + 1}), lambda i: ({weight}) * ({f.replace('t_', f'(({high}) * i / {steps}.0::DOUBLE)')}))) * ({high}) / {3 * steps}.0::DOUBLE)"


def _p_normal(z: str) -> str:
    """SQL: P(|normal| > |z|)."""
    return f"greatest(0.0::DOUBLE, 1 - 2 / sqrt(pi()) * {_simpson('exp(-t_ * t_)', f'least(7.0::DOUBLE, abs({z}) / sqrt(2))', 2000)})"


def _p_chi(x: str, k: str) -> str:
    """SQL: P(chi-squared with k degrees of freedom > x), by the density of its root."""
    return f"greatest(0.0::DOUBLE, 1 - {_simpson(f'pow(t_, ({k}) - 1) * exp(-t_ * t_ / 2)', f'sqrt({x})', 4000)} * 2 / (pow(2, ({k}) / 2.0::DOUBLE) * gamma(({k}) / 2.0::DOUBLE)))"


def _p_f(f: str, a: str, b: str) -> str:
    """SQL: P(F with a and b degrees of freedom > f), by the angle whose tangent squared is b / (a f)."""
    scale = f"2 * exp(lgamma((({a}) + ({b})) / 2.0::DOUBLE) - lgamma(({a}) / 2.0::DOUBLE) - lgamma(({b}) / 2.0::DOUBLE))"
    return f"({scale} * {_simpson(f'pow(sin(t_), ({b}) - 1) * pow(cos(t_), ({a}) - 1)', f'atan(sqrt(({b}) / (({a}) * ({f}))))', 20000)})"


_YEARLY = "y AS (SELECT o_orderpriority AS skill, year(o_orderdate) AS year, count(*) AS cnt FROM orders GROUP BY 1, 2)"


def _yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("skill"), F.year("o_orderdate").alias("year")).agg(F.count("*").alias("cnt"))


_KENDALL = """s AS (SELECT a.skill, sum(sign(b.cnt - a.cnt))::DOUBLE AS s FROM y a JOIN y b ON a.skill = b.skill AND a.year < b.year GROUP BY a.skill), n AS (SELECT skill, count(*) AS n FROM y GROUP BY skill),
m AS (SELECT skill, n, s, s / (n * (n - 1) / 2.0) AS tau, s / sqrt(n * (n - 1) * (2 * n + 5) / 18.0) AS z FROM s JOIN n USING (skill)),
k AS (SELECT *, """ + _p_normal("z") + """ AS p FROM m),
d AS (SELECT *, CASE WHEN (p < 0.05 OR abs(tau) > 0.3) AND tau > 0 THEN 'growing' WHEN (p < 0.05 OR abs(tau) > 0.3) AND tau < 0 THEN 'declining' ELSE 'stable' END AS direction FROM k)"""


@query(f"WITH {_YEARLY}, {_KENDALL} SELECT skill, n, s, round(tau, 6) AS tau, round(z, 6) AS z, round(p, 6) AS p, direction FROM d")
def mann_kendall_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = st.mann_kendall(_yearly(spark, sf_dir), ["skill"], "year", "cnt")
    return found.select("skill", "n", "s", *[F.round(c, 6).alias(c) for c in ("tau", "z", "p")], "direction")


_CLERKS = """c AS (SELECT o_custkey % 500 AS skill, year(o_orderdate) AS year, count(*) AS cnt FROM orders GROUP BY 1, 2),
y AS (SELECT skill, year, coalesce(cnt, 0) AS cnt FROM (SELECT DISTINCT skill FROM c) CROSS JOIN (SELECT DISTINCT year FROM c) LEFT JOIN c USING (skill, year))"""


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 500).alias("skill"), F.year("o_orderdate").alias("year")).agg(F.count("*").alias("cnt"))
    grid = rows.select("skill").distinct().crossJoin(F.broadcast(rows.select("year").distinct()))  # a row for each year
    return grid.join(rows, ["skill", "year"], "left").select("skill", "year", F.coalesce("cnt", F.lit(0)).alias("cnt"))


@query(f"""WITH {_CLERKS}, {_KENDALL}, e AS (SELECT skill, CASE WHEN abs(regr_slope(cnt, year)) < 0.0005 THEN 0 ELSE round(coalesce(regr_slope(cnt, year), 0), 3) END AS slope, arg_min(cnt, year) AS first_count, arg_max(cnt, year) AS last_count, sum(cnt)::BIGINT AS total FROM y GROUP BY skill HAVING max(cnt) >= 2)
SELECT skill, round(tau, 3) AS tau, round(p, 4) AS p, direction, slope, total, first_count = 0 AND last_count > 0 AND direction <> 'growing' AS newly_emerged FROM d JOIN e USING (skill)""")
def skill_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills with a year of two mentions or more, absent years as 0: trend test, slope, and which are new."""
    return st.series_trends(_dense(spark, sf_dir), "skill", "year", "cnt")


@query(f"""WITH {_CLERKS}, {_KENDALL}, e AS (SELECT skill FROM y GROUP BY skill HAVING max(cnt) >= 2), q AS (SELECT count(*) AS n, count(*) FILTER (direction = 'stable') AS stable, count(*) FILTER (direction = 'growing') AS growing FROM d JOIN e USING (skill))
SELECT n, stable, growing, round(100.0 * stable / n, 1) AS stability_pct, CASE WHEN 100.0 * stable / n > 60 THEN 'stable' WHEN 100.0 * stable / n > 30 THEN 'partly stable' ELSE 'unstable' END AS verdict FROM q""")
def trend_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many skills are stable, and the verdict: above 60 % stable, above 30 % partly stable, else unstable."""
    return st.trend_verdict(st.series_trends(_dense(spark, sf_dir), "skill", "year", "cnt"))


_QUARTILES = "q AS (SELECT year(o_orderdate) AS year, quantile_cont(o_totalprice::DOUBLE, [0.25, 0.5, 0.75]) AS q, count(*) AS n FROM orders GROUP BY 1)"


def _quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_totalprice").cast("double").alias("x"))
    return st.quantiles(prices, "year", "x", (0.25, 0.5, 0.75))


@query(f"WITH {_QUARTILES} SELECT year, n, round(q[1], 4) AS p25, round(q[2], 4) AS median, round(q[3], 4) AS p75 FROM q")
def salary_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _quartiles(spark, sf_dir)
    return rows.select("year", "n", *[F.round(F.col("q")[i], 4).alias(name) for i, name in enumerate(("p25", "median", "p75"))])


@query(f"""WITH {_QUARTILES}, y AS (SELECT 'all' AS skill, year, q[2] AS cnt FROM q), {_KENDALL}
SELECT d.n, round(tau, 3) AS tau, round(p, 4) AS p, direction, (SELECT round(regr_slope(cnt, year), 3) FROM y) AS slope FROM d""")
def salary_trend_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trend of the yearly medians."""
    medians = _quartiles(spark, sf_dir).select(F.lit("all").alias("skill"), "year", F.col("q")[1].alias("m"))
    slope = medians.groupBy("skill").agg(F.round(F.regr_slope("m", "year"), 3).alias("slope"))
    found = st.mann_kendall(medians, ["skill"], "year", "m").join(slope, "skill")
    return found.select("n", F.round("tau", 3).alias("tau"), F.round("p", 4).alias("p"), "direction", "slope")


@query(f"""WITH o AS (SELECT l_returnflag AS r, l_linestatus AS c, count(*)::DOUBLE AS o FROM lineitem GROUP BY 1, 2),
d AS (SELECT r, c, coalesce(o.o, 0) AS o FROM (SELECT DISTINCT r FROM o) CROSS JOIN (SELECT DISTINCT c FROM o) LEFT JOIN o USING (r, c)),
e AS (SELECT *, sum(o) OVER (PARTITION BY r) * sum(o) OVER (PARTITION BY c) / sum(o) OVER () AS e, sum(o) OVER () AS n FROM d),
s AS (SELECT sum((o - e) ^ 2 / e) AS x, ((count(DISTINCT r) - 1) * (count(DISTINCT c) - 1))::BIGINT AS dof, max(n) AS n, least(count(DISTINCT r), count(DISTINCT c)) - 1 AS k FROM e)
SELECT round(x, 6) AS chi2, dof, n::BIGINT AS n, round(sqrt(x / (n * k)), 6) AS cramers_v, round({_p_chi("x", "dof")}, 6) AS p FROM s""")
def chi2_independence(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("o"))
    found = st.chi_squared(cells, "l_returnflag", "l_linestatus", "o")
    return found.select(F.round("chi2", 6).alias("chi2"), "dof", "n", F.round("cramers_v", 6).alias("cramers_v"), F.round("p", 6).alias("p"))


_GROUPS = "g AS (SELECT c_mktsegment AS g, count(*) AS n, avg(c_acctbal) AS m, var_pop(c_acctbal) AS v FROM customer GROUP BY 1 HAVING count(*) >= 3), s AS (SELECT count(*) AS k, sum(n) AS n, sum(n * m) / sum(n) AS mean, sum(n * v) AS ssw FROM g)"


@query(f"""WITH {_GROUPS}, x AS (SELECT (SELECT sum(g.n * (g.m - s.mean) ^ 2) FROM g) / (k - 1) / (ssw / (n - k)) AS f, k - 1 AS between_, (n - k)::BIGINT AS within_ FROM s)
SELECT round(f, 5) AS f, between_, within_, round({_p_f("f", "between_", "within_")}, 5) AS p FROM x""")
def anova_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = st.anova(table(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal")
    return found.select(F.round("f", 5).alias("f"), F.col("between").alias("between_"), F.col("within").alias("within_"), F.round("p", 5).alias("p"))


@query(f"""WITH {_GROUPS} SELECT x.g AS group1, y.g AS group2, round(y.m - x.m, 4) AS meandiff, round(abs(y.m - x.m) / sqrt(ssw / (s.n - k) / 2 * (1.0 / x.n + 1.0 / y.n)), 4) AS q FROM g x JOIN g y ON x.g < y.g, s""")
def tukey_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of the groups' means and their studentized range statistics."""
    found = st.mean_differences(table(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal")
    return found.select("group1", "group2", F.round("meandiff", 4).alias("meandiff"), F.round("q", 4).alias("q"))


@query()
def tukey_hsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs with p, interval and whether the difference counts; tests hold them against published quantiles."""
    found = st.tukey(table(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal")
    rounded = [F.round(c, 6).alias(c) for c in ("meandiff", "q", "p", "lower", "upper")]
    return found.select("group1", "group2", *rounded, "reject")


_SHARE = "r AS (SELECT o_orderpriority AS grp, year(o_orderdate) AS year, count(*) FILTER (o_orderstatus = 'F') AS hits, count(*) AS total FROM orders GROUP BY 1, 2)"


@query(f"""WITH {_SHARE}, t AS (SELECT *, dense_rank() OVER (PARTITION BY grp ORDER BY year) - 1 AS t FROM r),
s AS (SELECT grp, count(DISTINCT t) AS n_years, sum(total)::DOUBLE AS n, sum(hits)::DOUBLE AS r, sum(total * t)::DOUBLE AS nt, sum(hits * t)::DOUBLE AS rt, sum(total * t * t)::DOUBLE AS ntt FROM t GROUP BY grp),
z AS (SELECT grp, n_years, (rt - r / n * nt) / sqrt(greatest(r / n * (1 - r / n), 1e-15) * greatest(ntt - nt * nt / n, 1e-15)) AS z FROM s), p AS (SELECT *, {_p_normal("z")} AS p FROM z)
SELECT grp, n_years, round(z, 4) AS z, round(p, 6) AS p, p > 0.05 AS is_stable FROM p""")
def cochran_armitage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("grp"), F.year("o_orderdate").alias("year")).agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("hits"), F.count("*").alias("total")
    )
    found = st.cochran_armitage(rows, ["grp"], "year", "hits", "total")
    return found.select("grp", "n_years", F.round("z", 4).alias("z"), F.round("p", 6).alias("p"), "is_stable")


_STRATA = """k AS (SELECT year(o_orderdate) AS year, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 200000) AS a, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice <= 200000) AS b,
count(*) FILTER (o_orderstatus <> 'F' AND o_totalprice > 200000) AS c, count(*) FILTER (o_orderstatus <> 'F' AND o_totalprice <= 200000) AS d FROM orders GROUP BY 1),
z AS (SELECT a::DOUBLE AS a, b::DOUBLE AS b, c::DOUBLE AS c, d::DOUBLE AS d, (a + b + c + d)::DOUBLE AS n FROM k WHERE a > 0 AND b > 0 AND c > 0 AND d > 0),
m AS (SELECT count(*) AS strata, sum(a - (a + b) * (a + c) / n) AS gap, sum((a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))) AS var, sum(a * d / n) / sum(b * c / n) AS r FROM z)"""


def _strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, big = F.col("o_orderstatus") == "F", F.col("o_totalprice") > 200000
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(
        F.count_if(f & big).alias("a"), F.count_if(f & ~big).alias("b"), F.count_if(~f & big).alias("c"), F.count_if(~f & ~big).alias("d")
    )


@query(f"""WITH {_STRATA}, x AS (SELECT strata, gap * gap / var AS x, r, 1.96 / sqrt(var) AS e FROM m)
SELECT strata, round(x, 4) AS chi2, round({_p_chi("x", "1")}, 6) AS p, round(r, 4) AS odds_ratio, round(r * exp(-e), 4) AS ci_low, round(r * exp(e), 4) AS ci_high, {_p_chi("x", "1")} < 0.05 AS is_associated FROM x""")
def cmh(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = st.mantel_haenszel(st.full_strata(_strata(spark, sf_dir)))
    return found.select("strata", F.round("chi2", 4).alias("chi2"), F.round("p", 6).alias("p"), *[F.round(c, 4).alias(c) for c in ("odds_ratio", "ci_low", "ci_high")], "is_associated")


@query(f"""WITH {_STRATA}, x AS (SELECT *, 1 - r AS q, (c + d) - (a + c) + r * ((a + b) + (a + c)) AS l, -r * (a + b) * (a + c) AS k FROM z, m),
y AS (SELECT *, CASE WHEN abs(q) < 1e-12 THEN -k / l ELSE (-l + sqrt(l * l - 4 * q * k)) / (2 * q) END AS x FROM x),
s AS (SELECT sum((a - x) ^ 2 * (1 / x + 1 / (a + b - x) + 1 / (a + c - x) + 1 / (d - a + x))) AS x, count(*) - 1 AS dof FROM y)
SELECT round(x, 4) AS chi2, dof, round({_p_chi("x", "dof")}, 6) AS p, {_p_chi("x", "dof")} > 0.05 AS is_homogeneous FROM s""")
def breslow_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = st.breslow_day(st.full_strata(_strata(spark, sf_dir)))
    return found.select(F.round("chi2", 4).alias("chi2"), "dof", F.round("p", 6).alias("p"), "is_homogeneous")


@query(f"""WITH r AS (SELECT o_custkey % 50 AS s, year(o_orderdate) AS t, o_orderpriority AS c, count(*) AS n FROM orders GROUP BY ALL),
v AS (SELECT s, t, arg_max(c, (n, c)) AS c FROM r GROUP BY s, t), f AS (SELECT s FROM v GROUP BY s HAVING count(*) = (SELECT count(DISTINCT year(o_orderdate)) FROM orders)), g AS (SELECT s, c, count(*)::DOUBLE AS n FROM v WHERE s IN (SELECT s FROM f) GROUP BY s, c),
p AS (SELECT s, sum(n) AS m, sum(n * n) AS q FROM g GROUP BY s), o AS (SELECT avg((q - m) / (m * (m - 1))) AS p, avg(m) AS m, count(*) AS ns FROM p),
k AS (SELECT c, sum(n) / (SELECT sum(n) FROM g) AS share FROM g GROUP BY c), e AS (SELECT sum(share ^ 2) AS e, sum(share ^ 3) AS e3 FROM k),
x AS (SELECT (p - e) / (1 - e) AS kappa, (p - e) / (1 - e) / sqrt(2 / (ns * m * (m - 1)) * (e - (2 * m - 3) * e * e + 2 * (m - 2) * e3) / ((1 - e) * (1 - e))) AS z FROM o, e)
SELECT round(kappa, 4) AS kappa, round(z, 4) AS z, round({_p_normal("z")}, 6) AS p, CASE WHEN kappa < 0 THEN 'poor' WHEN kappa < 0.21 THEN 'slight' WHEN kappa < 0.41 THEN 'fair' WHEN kappa < 0.61 THEN 'moderate' WHEN kappa < 0.81 THEN 'substantial' ELSE 'almost_perfect' END AS level FROM x""")
def fleiss_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do years agree on the commonest priority of groups of customers? Groups rated by every year count."""
    orders = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("s"), F.year("o_orderdate").alias("t"), F.col("o_orderpriority").alias("c"))
    votes = orders.groupBy("s", "t", "c").agg(F.count("*").alias("n")).groupBy("s", "t").agg(F.max_by("c", F.struct("n", "c")).alias("c"))
    years = orders.agg(F.count_distinct("t").alias("years"))
    full = votes.groupBy("s").agg(F.count("*").alias("k")).join(F.broadcast(years), F.col("k") == F.col("years")).select("s")
    counts = votes.join(full, "s", "left_semi").groupBy("s", "c").agg(F.count("*").alias("n"))
    found = st.fleiss_kappa(counts, "s", "c", "n")
    return found.select(F.round("kappa", 4).alias("kappa"), F.round("z", 4).alias("z"), F.round("p", 6).alias("p"), "level")


@query(f"""WITH b AS (SELECT p_brand, avg(p_size) AS x, avg(p_retailprice) AS y FROM part GROUP BY 1),
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM b),
c AS (SELECT corr(rx, ry) AS rho, count(*) AS n FROM r), f AS (SELECT *, rho * rho * (n - 2) / ((1 - rho) * (1 + rho)) AS f FROM c)
SELECT round(rho, 6) AS rho, n, round({_p_f("f", "1", "(n - 2)")}, 5) AS p FROM f""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation over brands and its p by the t distribution."""
    rows = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.avg("p_size").alias("x"), F.avg("p_retailprice").alias("y"))
    return st.correlation(average_ranks(rows, ["x", "y"]), "r_x", "r_y").select(F.round("rho", 6).alias("rho"), "n", F.round("p", 5).alias("p"))


@query("SELECT c_mktsegment AS role, count(*) AS n, round(quantile_cont(c_acctbal::DOUBLE, 0.5), 4) AS median FROM customer GROUP BY 1 HAVING count(*) >= 3")
def median_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("role"), F.col("c_acctbal").cast("double").alias("x"))
    return st.quantiles(rows, "role", "x", (0.5,)).where("n >= 3").select("role", "n", F.round(F.col("q")[0], 4).alias("median"))


@query("""SELECT CASE WHEN p_size < 1 THEN '0–1' WHEN p_size < 3 THEN '1–3' WHEN p_size < 5 THEN '3–5' WHEN p_size < 10 THEN '5–10' ELSE '10+' END AS bin, count(*) AS n FROM part WHERE p_size >= 0 GROUP BY 1""")
def experience_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.functions.text import bin_label

    return table(spark, sf_dir, "part").where("p_size >= 0").groupBy(bin_label(F.col("p_size"), [0, 1, 3, 5, 10]).alias("bin")).agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT p_brand AS role, CASE WHEN p_size > 45 THEN NULL ELSE p_size / 3.0::DOUBLE END AS years FROM part)
SELECT role, count(years) AS n, count(*) - count(years) AS unknown, round(quantile_cont(years, 0.5), 4) AS median, count(*) FILTER (years >= 0 AND years < 1) AS b0, count(*) FILTER (years >= 1 AND years < 3) AS b1,
count(*) FILTER (years >= 3 AND years < 5) AS b2, count(*) FILTER (years >= 5 AND years < 10) AS b3, count(*) FILTER (years >= 10) AS b4 FROM x GROUP BY role""")
def experience_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram, median and number of unknown values of each role's years."""
    years = F.when(F.col("p_size") <= 45, F.col("p_size") / 3.0)
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("role"), years.alias("years"))
    bins = [(0, 1), (1, 3), (3, 5), (5, 10), (10, None)]
    inside = lambda lo, hi: (F.col("years") >= lo) & (F.col("years") < hi) if hi else F.col("years") >= lo
    counts = rows.groupBy("role").agg(
        F.count("years").alias("n"), F.count_if(F.col("years").isNull()).alias("unknown"), *[F.count_if(inside(lo, hi)).alias(f"b{i}") for i, (lo, hi) in enumerate(bins)]
    )
    medians = st.quantiles(rows, "role", "years", (0.5,)).select("role", F.round(F.col("q")[0], 4).alias("median"))
    return counts.join(medians, "role", "left").select("role", "n", "unknown", "median", *[f"b{i}" for i in range(5)])


@query()
def resampled_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permutation and block bootstrap over the monthly means of each priority, all months of all orders."""
    monthly = table(spark, sf_dir, "orders").groupBy(
        F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")
    ).agg(F.avg("o_totalprice").alias("price"))
    return st.resampled(monthly, "priority", "year", "price")
