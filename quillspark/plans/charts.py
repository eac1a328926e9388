"""The data of the charts: one row for each point, bar or cell, in the order in which it is drawn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import axes, career
from quillspark.operators.text import top
from quillspark.plans.axes import _PROFILE, profile
from quillspark.plans.career import _NAMED, _named
from quillspark.plans.registry import query, table

#: The order in which axes are drawn; one of them has no data and is skipped.
_ORDER = ("domain_knowledge", "experimental", "unknown", "data_analysis", "computational", "professional_texts", "t_profile", "management")
_ORDER_SQL = "od(axis, pos) AS (VALUES " + ", ".join(f"('{a}', {i})" for i, a in enumerate(_ORDER)) + ")"


def _placed(rows: DataFrame, order: tuple[str, ...] = _ORDER) -> DataFrame:
    """rows with pos, the place of their axis in the order; axes that the order lacks go."""
    place = F.array_position(F.array(*[F.lit(a) for a in order]), F.col("axis")) - 1
    return rows.withColumn("pos", place.cast("int")).where("pos >= 0")


@query(f"WITH {_PROFILE}, {_NAMED}, {_ORDER_SQL} SELECT role, row_number() OVER (PARTITION BY role ORDER BY pos) AS place, axis, proficiency FROM j JOIN od USING (axis)")
def role_spider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spokes of each role's spider in order."""
    from pyspark.sql import Window

    rows = _placed(_named(spark, sf_dir))
    place = F.row_number().over(Window.partitionBy("role").orderBy("pos"))  # one row for each axis
    return rows.select("role", place.alias("place"), "axis", "proficiency")


@query(f"""WITH {_PROFILE}, {_NAMED}, l(level, weight) AS (VALUES (0, 0.10), (1, 0.25), (2, 0.40), (3, 0.60), (4, 0.80), (5, 0.95), (6, 1.00))
SELECT role, axis, level, proficiency >= 1 + 4 * weight AS reached FROM j, l""")
def achievement_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of each role's matrix: is the level reached on the axis?"""
    level = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.lit(1 + 4 * w).alias("threshold")) for i, w in enumerate(axes.LEVELS)])).alias("l")
    return _named(spark, sf_dir).select("role", "axis", "proficiency", level).select("role", "axis", "l.level", (F.col("proficiency") >= F.col("l.threshold")).alias("reached"))


@query(f"WITH {_PROFILE} SELECT axis, count(*) AS roles, round(min(proficiency), 4) AS least, round(avg(proficiency), 4) AS mean, round(max(proficiency), 4) AS most FROM prof GROUP BY axis")
def portfolio_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How all roles spread on each axis."""
    return profile(spark, sf_dir).groupBy("axis").agg(
        F.count("*").alias("roles"), F.round(F.min("proficiency"), 4).alias("least"), F.round(F.avg("proficiency"), 4).alias("mean"), F.round(F.max("proficiency"), 4).alias("most")
    )


@query("""WITH k AS (SELECT p_brand AS role, p_type AS axis, p_name AS skill, count(*) AS n FROM part GROUP BY 1, 2, 3), t AS (SELECT role, skill, sum(n)::BIGINT AS total FROM k GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY role ORDER BY sum(n) DESC, skill) <= 15)
SELECT role, skill, axis, n, round(n / total::DOUBLE, 4) AS share FROM k JOIN t USING (role, skill)""")
def skill_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 foremost skills of each role, their bars cut by axis."""
    counts = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("role"), F.col("p_type").alias("axis"), F.col("p_name").alias("skill")).agg(F.count("*").alias("n"))
    best = top(counts.groupBy("role", "skill").agg(F.sum("n").alias("total")), ["role"], [F.desc("total"), F.asc("skill")], 15)
    return counts.join(best, ["role", "skill"]).select("role", "skill", "axis", "n", F.round(F.col("n") / F.col("total"), 4).alias("share"))


_SOFT_SQL = "sf(soft, axis, w) AS (VALUES " + ", ".join(f"('{s}', '{a}', {w})" for s, ws in axes.SOFT.items() for a, w in ws.items()) + ")"


@query(f"WITH {_PROFILE}, {_NAMED}, {_SOFT_SQL} SELECT role, soft, round(greatest(1, least(5, sum(proficiency * w))), 4) AS proficiency FROM j JOIN sf USING (axis) GROUP BY role, soft")
def soft_spider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spokes of each role's soft competences."""
    return axes.rubric_scores(_named(spark, sf_dir), axes.SOFT).select("role", "soft", F.round("proficiency", 4).alias("proficiency"))


@query(f"""WITH {_PROFILE}, {_NAMED}, d AS (SELECT role, string_agg(axis, ' / ' ORDER BY proficiency DESC, axis) AS dominant FROM (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY role ORDER BY proficiency DESC, axis) <= 2) GROUP BY role),
n AS (SELECT n_name AS role, count(*) AS members FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) SELECT role, members, dominant FROM n JOIN d USING (role)""")
def role_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each role with its members and dominant axes, as the report lists it."""
    customers, nations = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    members = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("role")).agg(F.count("*").alias("members"))
    best = top(_named(spark, sf_dir), ["role"], [F.desc("proficiency"), F.asc("axis")], 2)
    listed = best.groupBy("role").agg(F.array_sort(F.collect_list(F.struct("rank", "axis"))).alias("a"))
    return members.join(listed, "role").select("role", "members", F.array_join(F.transform("a", lambda x: x["axis"]), " / ").alias("dominant"))


@query(f"""WITH {_PROFILE}, {_NAMED}, h AS (SELECT axis, level, round(avg(value), 4) AS mean FROM tr GROUP BY axis, level) SELECT axis, level, mean FROM h""")
def growth_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value of all roles by axis and level."""
    return career.trajectory(_named(spark, sf_dir)).groupBy("axis", "level").agg(F.round(F.avg("value"), 4).alias("mean"))
