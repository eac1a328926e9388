"""Competency axes: normalisation over roles, rubrics, archetypes, levels and role documents.

Seven numeric aggregates of a role (a source or a language of documents, or a nation) stand for the axes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import axes, skill_rules
from quillspark.operators.text import top
from quillspark.plans.registry import query, table

_PROFILE = """
c AS (SELECT n_name AS role, c_acctbal AS v, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
raw AS (SELECT role, unnest(['a1', 'a2', 'a3', 'a4', 'a5', 'a6', 'a7']) AS axis, unnest([avg(v), min(v), max(v), count(*)::DOUBLE,
  avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END), avg(abs(v)), avg(c_custkey % 7)]) AS x FROM c GROUP BY role),
s AS (SELECT *, avg(x) OVER w AS mu, stddev_pop(x) OVER w AS sd, min(x) OVER w AS lo, max(x) OVER w AS hi, count(*) OVER w AS n FROM raw WINDOW w AS (PARTITION BY axis)),
prof AS (SELECT role, axis, round(CASE WHEN n >= 15 THEN CASE WHEN sd < 1e-12 THEN 3.0 ELSE greatest(1.0, least(5.0, 3 + (x - mu) / sd)) END
  WHEN hi - lo < 1e-12 THEN 3.0 ELSE 1 + 4 * (x - lo) / (hi - lo) END, 6) AS proficiency FROM s)
"""


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """role, axis, proficiency of nations over seven aggregates of their customers."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    v = F.col("c_acctbal")
    wide = rows.groupBy(F.col("n_name").alias("role")).agg(
        F.avg(v).alias("a1"),
        F.min(v).alias("a2"),
        F.max(v).alias("a3"),
        F.count("*").cast("double").alias("a4"),
        F.avg(F.when(v > 0, 1.0).otherwise(0.0)).alias("a5"),
        F.avg(F.abs(v)).alias("a6"),
        F.avg((F.col("c_custkey") % 7).cast("double")).alias("a7"),
    )
    raw = wide.unpivot("role", [f"a{i}" for i in range(1, 8)], "axis", "x")
    return axes.normalised(raw, "axis", "x").select("role", "axis", F.round("score", 6).alias("proficiency"))


@query(f"WITH {_PROFILE} SELECT role, axis, proficiency FROM prof")
def normalize_axes_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(spark, sf_dir)


@query(
    """WITH raw AS (SELECT lang AS role, 'chars' AS axis, avg(n_chars) AS x FROM documents GROUP BY lang
UNION ALL SELECT lang, 'most', max(n_chars)::DOUBLE FROM documents GROUP BY lang UNION ALL SELECT lang, 'flat', 1.0 FROM documents GROUP BY lang),
s AS (SELECT *, min(x) OVER w AS lo, max(x) OVER w AS hi FROM raw WINDOW w AS (PARTITION BY axis))
SELECT role, axis, round(CASE WHEN hi - lo < 1e-12 THEN 3.0 ELSE 1 + 4 * (x - lo) / (hi - lo) END, 6) AS proficiency FROM s"""
)
def normalize_axes_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = (
        table(spark, sf_dir, "documents")
        .groupBy(F.col("lang").alias("role"))
        .agg(F.avg("n_chars").alias("chars"), F.max("n_chars").cast("double").alias("most"), F.lit(1.0).alias("flat"))
    )
    raw = wide.unpivot("role", ["chars", "most", "flat"], "axis", "x")
    return axes.normalised(raw, "axis", "x").select("role", "axis", F.round("score", 6).alias("proficiency"))


@query(
    f"""WITH {_PROFILE}, r(soft, axis, w) AS (VALUES ('s1', 'a1', 0.6), ('s1', 'a2', 0.4), ('s2', 'a3', 0.5), ('s2', 'a4', 0.5), ('s3', 'a5', 1.0), ('s4', 'a6', 0.3), ('s4', 'a7', 0.7))
SELECT role, soft, round(greatest(1, least(5, sum(proficiency * w))), 4) AS proficiency FROM prof JOIN r USING (axis) GROUP BY role, soft"""
)
def soft_rubric(spark: SparkSession, sf_dir: str) -> DataFrame:
    rubric = {"s1": {"a1": 0.6, "a2": 0.4}, "s2": {"a3": 0.5, "a4": 0.5}, "s3": {"a5": 1.0}, "s4": {"a6": 0.3, "a7": 0.7}}
    return axes.rubric_scores(profile(spark, sf_dir), rubric).select("role", "soft", F.round("proficiency", 4).alias("proficiency"))


_LEVELS = "l(level, weight) AS (VALUES (1, 0.10), (2, 0.25), (3, 0.40), (4, 0.60), (5, 0.80), (6, 0.95), (7, 1.00))"


@query(
    f"""WITH {_PROFILE}, {_LEVELS} SELECT role, level, round(1 + 4 * weight, 4) AS threshold, count(*) FILTER (proficiency >= 1 + 4 * weight) AS achieved,
coalesce(string_agg(axis, ',' ORDER BY axis) FILTER (proficiency >= 1 + 4 * weight), '') AS axes FROM prof, l GROUP BY role, level, weight"""
)
def achievement_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return axes.achieved(profile(spark, sf_dir)).select(
        "role", "level", F.round("threshold", 4).alias("threshold"), "achieved", F.array_join("axes", ",").alias("axes")
    )


@query(f"WITH {_PROFILE} SELECT role, axis, proficiency, row_number() OVER (PARTITION BY role ORDER BY proficiency DESC, axis) AS rank FROM prof QUALIFY rank <= 2")
def dominant_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(profile(spark, sf_dir), ["role"], [F.desc("proficiency"), F.asc("axis")], 2)


@query(
    """WITH t AS (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS word FROM part),
r(category, trig, pos) AS (VALUES ('metal', 'steel', 1), ('metal', 'brass', 1), ('metal', 'copper', 1), ('colour', 'blue', 2), ('colour', 'red', 2), ('colour', 'green', 2), ('small', 'small', 3), ('small', 'mini', 3)),
w AS (SELECT DISTINCT word FROM t), m AS (SELECT word, arg_min(category, pos) AS category FROM w JOIN r ON contains(word, trig) OR contains(trig, word) WHERE word <> '' GROUP BY word)
SELECT p_partkey, word, coalesce(category, 'other') AS category FROM t LEFT JOIN m USING (word)"""
)
def category_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of part names by the first rule one of whose triggers holds the word or lies in it."""
    rules = [("metal", ["steel", "brass", "copper"]), ("colour", ["blue", "red", "green"]), ("small", ["small", "mini"])]
    named = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split(F.lower("p_name"), " ")).alias("word"))
    found = axes.categorised(named.select("word").distinct(), "word", rules)
    return named.join(found, "word", "left").select("p_partkey", "word", F.coalesce("category", F.lit("other")).alias("category"))


_TERMS = ("Python", "рентген", "СТАТИСТИКА", "  sql ", "статья", "синтез", "квантовый", "управление проектами", "клетка", "ит", "unknown thing", "")
_RULES_SQL = "rules(category, trig, pos) AS (VALUES " + ", ".join(f"('{c}', '{t}', {i})" for i, (c, ts) in enumerate(skill_rules.CATEGORIES) for t in ts) + ")"
_KINDS_SQL = "kinds(category, kind) AS (VALUES " + ", ".join(f"('{c}', '{k}')" for c, k in skill_rules.KINDS.items()) + ")"


@query(f"""WITH {_RULES_SQL}, {_KINDS_SQL}, w AS (SELECT DISTINCT p_partkey, [{", ".join(repr(t) for t in _TERMS)}][1 + p_size % {len(_TERMS)}] AS skill FROM part),
m AS (SELECT skill, arg_min(category, pos) AS category FROM (SELECT DISTINCT skill FROM w) JOIN rules ON contains(lower(trim(skill)), trig) OR contains(trig, lower(trim(skill))) WHERE trim(skill) <> '' GROUP BY skill)
SELECT p_partkey, skill, category, kind FROM w JOIN m USING (skill) LEFT JOIN kinds USING (category)""")
def skill_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills by the fixed rules, and the kind of work of their categories."""
    skill = F.element_at(F.array(*[F.lit(t) for t in _TERMS]), (F.col("p_size") % len(_TERMS) + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", skill.alias("skill"))
    found = axes.categorised(rows.select("skill").distinct(), "skill", skill_rules.CATEGORIES)
    kinds = F.create_map(*[F.lit(x) for kv in skill_rules.KINDS.items() for x in kv])
    return rows.join(found, "skill").select("p_partkey", "skill", "category", F.try_element_at(kinds, F.col("category")).alias("kind"))


@query(
    """WITH k AS (SELECT p_brand AS role, CASE WHEN p_size <= 14 THEN 'experimental' WHEN p_size <= 24 THEN 'computational' WHEN p_size <= 36 THEN 'communication' WHEN p_size <= 46 THEN 'domain' END AS c FROM part),
f AS (SELECT role, greatest(count(c), 1) AS n, count(*) FILTER (c = 'experimental') AS e, count(*) FILTER (c = 'computational') AS p, count(*) FILTER (c = 'communication') AS m, count(*) FILTER (c = 'domain') AS d FROM k GROUP BY role),
g AS (SELECT role, e / n::DOUBLE AS e, p / n::DOUBLE AS p, m / n::DOUBLE AS m, d / n::DOUBLE AS d FROM f),
h AS (SELECT *, (e > 0.15)::INTEGER + (p > 0.15)::INTEGER + (m > 0.15)::INTEGER + (d > 0.15)::INTEGER AS significant FROM g)
SELECT role, round(e, 4) AS experimental, round(p, 4) AS computational, round(m, 4) AS communication, round(d, 4) AS domain, significant, CASE WHEN e > 0.5 THEN 'Техник' WHEN p > 0.5 THEN 'Инженер'
WHEN significant >= 3 AND m < 0.3 THEN 'Исследователь' WHEN significant >= 3 THEN 'Ведущий специалист' WHEN m >= 0.35 THEN 'Методолог' ELSE 'Гибрид' END AS archetype FROM h"""
)
def archetype_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands by the shares of four kinds of sizes; the largest sizes are of no kind."""
    size = F.col("p_size")
    kind = F.when(size <= 14, "experimental").when(size <= 24, "computational").when(size <= 36, "communication").when(size <= 46, "domain")
    skills = table(spark, sf_dir, "part").select(F.col("p_brand").alias("role"), kind.alias("super_category"))
    found = axes.archetypes(axes.super_fractions(skills))
    return found.select("role", *[F.round(c, 4).alias(c) for c in axes.SUPER_CATEGORIES], "significant", "archetype")


@query(
    f"""WITH {_PROFILE}, top AS (SELECT role, string_agg(axis || '=' || round(proficiency, 2), ';' ORDER BY axis) AS characteristics, max(proficiency) AS peak, count(*) AS n_axes FROM prof GROUP BY role)
SELECT role, n_axes, round(peak, 4) AS peak, (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = role) AS member_count FROM top"""
)
def role_model_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested model document of each role, flattened to its checked fields."""
    members = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    counts = members.groupBy(F.col("n_name").alias("role")).agg(F.count("*").alias("member_count"))
    models = axes.role_models(profile(spark, sf_dir), counts)
    return models.select(
        "role",
        F.size("characteristics").cast("long").alias("n_axes"),
        F.round(F.array_max(F.transform("characteristics", lambda c: c["proficiency"])), 4).alias("peak"),
        "member_count",
    )
