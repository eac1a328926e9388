"""Do characteristics hold over the years? Sizes of order lines are the characteristics, parts the roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import temporal
from quillspark.plans.registry import query, table
from quillspark.plans.statistics import _p_chi, _p_normal

def _size():
    return F.concat(F.lit("q"), F.floor(F.col("l_quantity") / 8).cast("int").cast("string")).alias("characteristic")


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(_size(), F.year("l_shipdate").alias("year"))


def _assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_partkey").alias("role_id"), F.year("l_shipdate").alias("year"), _size())


_STABILITY = f"""o AS (SELECT 'q' || floor(l_quantity / 8)::INTEGER AS characteristic, year(l_shipdate) AS year, count(*) AS present FROM lineitem GROUP BY ALL),
y AS (SELECT year, sum(present) AS total, dense_rank() OVER (ORDER BY year) - 1 AS t FROM o GROUP BY year),
g AS (SELECT c.characteristic, y.year, y.t, coalesce(present, 0)::DOUBLE AS present, total::DOUBLE AS total FROM (SELECT DISTINCT characteristic FROM o) c CROSS JOIN y LEFT JOIN o ON o.characteristic = c.characteristic AND o.year = y.year),
s AS (SELECT characteristic, count(*) AS n_years, sum(total) AS n, sum(present) AS r, sum(total * t) AS nt, sum(present * t) AS rt, sum(total * t * t) AS ntt, round(arg_min(present / total, year), 4) AS first, round(arg_max(present / total, year), 4) AS last FROM g GROUP BY characteristic),
z AS (SELECT *, (rt - r / n * nt) / sqrt(greatest(r / n * (1 - r / n), 1e-15) * greatest(ntt - nt * nt / n, 1e-15)) AS z FROM s), p AS (SELECT *, {_p_normal("z")} AS p FROM z)"""


@query(f"WITH {_STABILITY} SELECT characteristic, n_years, round(z, 4) AS z, round(p, 6) AS p, p > 0.05 AS is_stable, first, last FROM p")
def temporal_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = temporal.stability(_observations(spark, sf_dir))
    return found.select("characteristic", "n_years", F.round("z", 4).alias("z"), F.round("p", 6).alias("p"), "is_stable", "first", "last")


_ASSOCIATION = f"""r AS (SELECT DISTINCT l_partkey AS role_id, year(l_shipdate) AS year, 'q' || floor(l_quantity / 8)::INTEGER AS characteristic FROM lineitem), i AS (SELECT role_id, row_number() OVER (ORDER BY role_id) AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT role_id FROM r)),
h AS (SELECT role_id, pos <= n // 2 AS low FROM i), sz AS (SELECT count(*) FILTER (low) AS na, count(*) FILTER (NOT low) AS nb FROM h),
t AS (SELECT characteristic, year, count(*) FILTER (low)::DOUBLE AS a, count(*) FILTER (NOT low)::DOUBLE AS b FROM r JOIN h USING (role_id) GROUP BY ALL),
u AS (SELECT characteristic, a, b, na - a AS c, nb - b AS d, (na + nb)::DOUBLE AS n FROM t, sz WHERE a > 0 AND b > 0 AND na - a > 0 AND nb - b > 0),
m AS (SELECT characteristic, count(*) AS strata, sum(a - (a + b) * (a + c) / n) AS gap, sum((a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))) AS var, sum(a * d / n) / sum(b * c / n) AS o FROM u GROUP BY characteristic),
x AS (SELECT c.characteristic, coalesce(strata, 0) AS strata, coalesce(strata, 0) < 2 AS skipped, CASE WHEN strata >= 2 THEN gap * gap / var END AS x, CASE WHEN strata >= 2 THEN o END AS o, 1.96 / sqrt(var) AS e FROM (SELECT DISTINCT characteristic FROM r) c LEFT JOIN m USING (characteristic))"""


@query(f"""WITH {_ASSOCIATION} SELECT characteristic, strata, round(x, 4) AS chi2, round({_p_chi("x", "1")}, 6) AS p, round(o, 4) AS odds_ratio, round(o * exp(-e), 4) AS ci_low, round(o * exp(e), 4) AS ci_high,
coalesce({_p_chi("x", "1")} < 0.05, false) AS is_associated, skipped FROM x""")
def temporal_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = temporal.association(_assignments(spark, sf_dir))
    return found.select(
        "characteristic", "strata", F.round("chi2", 4).alias("chi2"), F.round("p", 6).alias("p"), *[F.round(c, 4).alias(c) for c in ("odds_ratio", "ci_low", "ci_high")],
        "is_associated", "skipped",
    )


@query()
def temporal_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.robustness(_observations(spark, sf_dir))


@query()
def temporal_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.verdict(_observations(spark, sf_dir), _assignments(spark, sf_dir))
