"""Skills to axes over parts: brands are roles, the words of part names skills, and glossaries are lists of such words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import mapping
from quillspark.plans.registry import query, table

_GLOSSARY = {
    "tool": ("Anvil", "gear ", "bolt", "rod"), "colour": ("red", "blue", "rod"), "size": ("small", "large"), "state": ("new", "old", "hot", "cold"),
}
_GIVEN = {"widget": "tool", "gizmo": "nowhere", "unknown": "size", "blue": "tool"}
_VALUES = ", ".join(f"('{axis}', '{skill}')" for axis, skills in _GLOSSARY.items() for skill in skills)
_LETTERS = "list_transform(range(0, 26), lambda i: (length(lower({0})) - length(replace(lower({0}), chr((97 + i)::INTEGER), '')))::DOUBLE)"


def _unit(v: str) -> str:
    return f"list_transform({v}, lambda x: x / (sqrt(list_dot_product({v}, {v})) + 1e-12))"


_SCORES = f"""
gl(axis, skill) AS (VALUES {_VALUES}), g AS (SELECT DISTINCT axis, lower(trim(skill)) AS key FROM gl),
tg AS (SELECT key, axis, 1.0 / count(*) OVER (PARTITION BY key) AS tag FROM g),
rs AS (SELECT DISTINCT p_brand AS role, unnest(string_split(p_name, ' ')) AS skill FROM part),
bf AS (SELECT * FROM tg UNION ALL SELECT v.key, v.axis, 1.0 FROM (VALUES ('widget', 'tool'), ('gizmo', 'nowhere'), ('unknown', 'size'), ('blue', 'tool')) v(key, axis)
  WHERE v.key IN (SELECT lower(trim(skill)) FROM rs) AND v.key NOT IN (SELECT key FROM tg) AND v.axis IN (SELECT axis FROM tg)),
ge AS (SELECT axis, {_LETTERS.format("skill")} AS l FROM gl), gu AS (SELECT axis, {_unit("l")} AS v FROM ge),
gc AS (SELECT axis, list(m ORDER BY i) AS c FROM (SELECT axis, i, avg(x) AS m FROM (SELECT axis, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM gu) GROUP BY axis, i) GROUP BY axis),
cn AS (SELECT axis, {_unit("c")} AS c FROM gc),
se AS (SELECT skill, {_LETTERS.format("skill")} AS l FROM (SELECT DISTINCT skill FROM rs)), su AS (SELECT skill, {_unit("l")} AS v FROM se),
sc AS (SELECT skill, cn.axis, 0.7 * coalesce(tag, 0) + 0.3 * list_dot_product(v, c) AS score FROM su CROSS JOIN cn LEFT JOIN bf ON bf.key = lower(trim(skill)) AND bf.axis = cn.axis)
"""


def _role_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("role"), F.explode(F.split("p_name", " ")).alias("skill")).distinct()


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    glossary = spark.createDataFrame([(a, s) for a, skills in _GLOSSARY.items() for s in skills], "axis string, skill string")
    skills = _role_skills(spark, sf_dir).select("skill").distinct()
    given = spark.createDataFrame(list(_GIVEN.items()), "skill string, axis string")
    known = mapping.backfilled(mapping.tags(glossary), skills, given)
    embedded = glossary.select("axis", mapping.letters(F.col("skill")).alias("embedding"))
    return mapping.blended(skills.withColumn("embedding", mapping.letters(F.col("skill"))), known, embedded)


@query(f"WITH {_SCORES} SELECT skill, axis, round(score, 4) AS score FROM sc")
def skill_axis_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of the glossary, or of a list for skills without one, blended with cosines."""
    return _scores(spark, sf_dir).select("skill", "axis", F.round("score", 4).alias("score"))


@query(f"""WITH {_SCORES}, e AS (SELECT role, axis, skill, score FROM rs JOIN sc USING (skill)), m AS (SELECT role, axis, avg(score) AS x FROM e GROUP BY role, axis),
w AS (SELECT *, avg(x) OVER a AS mu, stddev_pop(x) OVER a AS sd, min(x) OVER a AS lo, max(x) OVER a AS hi, count(*) OVER a AS n FROM m WINDOW a AS (PARTITION BY axis)),
b AS (SELECT role, axis, skill, round(score, 4) AS score, row_number() OVER (PARTITION BY role, axis ORDER BY round(score, 4) DESC, skill) AS rank FROM e QUALIFY rank <= 3),
t AS (SELECT role, axis, string_agg(skill, ',' ORDER BY rank) AS skills, sum(score) AS total FROM b GROUP BY role, axis)
SELECT role, axis, round(CASE WHEN n >= 15 THEN CASE WHEN sd < 1e-12 THEN 3.0 ELSE greatest(1.0, least(5.0, 3 + (x - mu) / sd)) END WHEN hi - lo < 1e-12 THEN 3.0 ELSE 1 + 4 * (x - lo) / (hi - lo) END, 4) AS proficiency,
skills, round(total, 3) AS total FROM w JOIN t USING (role, axis)""")
def axis_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each role's proficiency on each axis with its three foremost skills."""
    found = mapping.role_axes(_role_skills(spark, sf_dir), _scores(spark, sf_dir))
    total = F.aggregate("contributing", F.lit(0.0), lambda s, x: s + x["contribution"])
    return found.select("role", "axis", "proficiency", F.array_join(F.transform("contributing", lambda c: c["skill"]), ",").alias("skills"), F.round(total, 3).alias("total"))
