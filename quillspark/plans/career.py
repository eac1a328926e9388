"""Career analytics over the profiles of nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import career
from quillspark.plans.axes import _PROFILE, profile
from quillspark.plans.registry import query, table


@query(f"""WITH {_PROFILE}, d AS (SELECT role, axis FROM prof QUALIFY row_number() OVER (PARTITION BY role ORDER BY proficiency DESC, axis) <= 2),
h AS (SELECT DISTINCT x.role AS source, y.role AS target FROM d x JOIN d y USING (axis) WHERE x.role <> y.role),
sm AS (SELECT x.role AS source, y.role AS target, round(sum(x.proficiency * y.proficiency) / sqrt(sum(x.proficiency ^ 2) * sum(y.proficiency ^ 2)), 6) AS cosine,
  round(sum(greatest(0.0, y.proficiency - x.proficiency)), 6) AS gap FROM prof x JOIN prof y USING (axis) WHERE x.role <> y.role GROUP BY 1, 2),
k AS (SELECT source, target, cosine, gap, row_number() OVER (PARTITION BY source ORDER BY cosine DESC, gap, target) AS rank, false AS fallback FROM sm JOIN h USING (source, target) WHERE cosine >= 0.5 AND gap <= 20 QUALIFY rank <= 2)
SELECT * FROM k UNION ALL SELECT source, target, cosine, gap, row_number() OVER (PARTITION BY source ORDER BY cosine DESC, gap, target) AS rank, true FROM sm WHERE source NOT IN (SELECT source FROM k) QUALIFY rank = 1""")
def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return career.transitions(profile(spark, sf_dir))


#: The axes of the profiles in the order of the fixed axes of a trajectory.
_NAMES = dict(zip([f"a{i}" for i in range(1, 8)], career.JUNIOR))
_NAMED = """nm(axis, name, f, g) AS (VALUES ('a1', 'experimental', 0.45::DOUBLE, 0.7::DOUBLE), ('a2', 'domain_knowledge', 0.40, 1.0), ('a3', 'management', 0.25, 2.2), ('a4', 'professional_texts', 0.30, 1.6), ('a5', 'data_analysis', 0.40, 0.9), ('a6', 'computational', 0.45, 0.8), ('a7', 't_profile', 0.40, 1.0)),
j AS (SELECT role, name AS axis, proficiency, greatest(1.0, round(proficiency * f, 2)) AS j, g FROM prof JOIN nm USING (axis)),
tr AS (SELECT role, axis, level, round(j + (proficiency - j) * pow((level - 1) / 6.0::DOUBLE, g), 2) AS value FROM j, (SELECT unnest(range(1, 8))::INTEGER AS level))"""


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in _NAMES.items() for x in kv])
    return profile(spark, sf_dir).withColumn("axis", F.element_at(names, F.col("axis")))


@query(f"WITH {_PROFILE}, {_NAMED} SELECT role, axis, level, value FROM tr")
def career_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return career.trajectory(_named(spark, sf_dir))


@query(f"""WITH {_PROFILE}, {_NAMED}, u AS (SELECT doc_id AS id, name AS axis, 1 + (doc_id * ascii(axis[2]) % 9) / 2.0::DOUBLE AS value FROM labels, nm WHERE doc_id IS NOT NULL),
v AS (SELECT *, value - avg(value) OVER (PARTITION BY id) AS vc FROM u), p AS (SELECT *, proficiency - avg(proficiency) OVER (PARTITION BY role) AS pc FROM j),
d AS (SELECT id, role, CASE WHEN sqrt(sum(vc * vc)) < 0.3 OR sqrt(sum(pc * pc)) < 1e-9 THEN 0 ELSE round(sum(vc * pc) / (sqrt(sum(vc * vc)) * sqrt(sum(pc * pc))), 9) END AS r, sqrt(sum(vc * vc)) < 0.3 AS is_flat FROM v JOIN p USING (axis) GROUP BY id, role),
b AS (SELECT id, arg_max(role, r) AS x, max(r) AS top, sum(exp(r / 0.35)) AS total, bool_or(is_flat) AS is_flat FROM d GROUP BY id), w AS (SELECT id, min(role) AS role FROM d JOIN b USING (id) WHERE r = top GROUP BY id),
f AS (SELECT id, level, round(sqrt(sum((u.value - tr.value) ^ 2)), 9) AS far FROM u JOIN w USING (id) JOIN tr USING (role, axis) GROUP BY id, level), l AS (SELECT id, level - 1 AS level FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY far, level) = 1)
SELECT id, role, round(exp(top / 0.35) / total * 100)::INTEGER AS confidence, level, is_flat FROM b JOIN w USING (id) JOIN l USING (id)""")
def role_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The role nearest to each of many made profiles."""
    ids = table(spark, sf_dir, "labels").where("doc_id is not null").select(F.col("doc_id").alias("id"))
    axes = F.explode(F.array(*[F.struct(F.lit(name).alias("axis"), F.lit(ord(a[1])).alias("k")) for a, name in _NAMES.items()])).alias("x")
    vectors = ids.select("id", axes).select("id", "x.axis", (1 + F.col("id") * F.col("x.k") % 9 / 2.0).alias("value"))
    return career.matched(_named(spark, sf_dir), vectors)


@query(f"""WITH {_PROFILE}, {_NAMED}, need(axis, n) AS (VALUES ('management', 4.0::DOUBLE), ('domain_knowledge', 4.0))
SELECT role AS source, '-1' AS target, round(sum(greatest(0.0, n - j)), 6) AS gap FROM j JOIN need USING (axis) GROUP BY role""")
def leadership_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return career.leadership(_named(spark, sf_dir))


_TIGHT = """d AS (SELECT role, axis FROM n WHERE true QUALIFY row_number() OVER (PARTITION BY role ORDER BY proficiency DESC, axis) <= 2),
h AS (SELECT DISTINCT x.role AS source, y.role AS target FROM d x JOIN d y USING (axis) WHERE x.role <> y.role),
sm AS (SELECT x.role AS source, y.role AS target, round(sum(x.proficiency * y.proficiency) / sqrt(sum(x.proficiency ^ 2) * sum(y.proficiency ^ 2)), 6) AS cosine,
  round(sum(greatest(0.0, y.proficiency - x.proficiency)), 6) AS gap FROM n x JOIN n y USING (axis) WHERE x.role <> y.role GROUP BY 1, 2),
k AS (SELECT source, target, cosine, gap FROM sm JOIN h USING (source, target) WHERE cosine >= 0.97 AND gap <= 2 QUALIFY row_number() OVER (PARTITION BY source ORDER BY cosine DESC, gap, target) <= 2),
r AS (SELECT * FROM k UNION ALL SELECT * FROM sm WHERE source NOT IN (SELECT source FROM k) QUALIFY row_number() OVER (PARTITION BY source ORDER BY cosine DESC, gap, target) = 1)"""


@query(f"""WITH {_PROFILE}, {_NAMED}, n AS (SELECT role, axis, proficiency FROM j), {_TIGHT}
SELECT source, target, gap FROM r QUALIFY row_number() OVER (PARTITION BY source ORDER BY gap, target) = 1""")
def best_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transition of the least gap of each role, under limits so tight that some roles need the fallback."""
    return career.best_switch(_named(spark, sf_dir), least=0.97, most=2.0)


_STAGES = {"early": {"a1": 5, "a2": 1, "a3": 1}, "middle": {"a4": 4, "a5": 4}, "late": {"a6": 5, "a7": 3}}


@query(f"""WITH {_PROFILE}, g(stage, axis, need) AS (VALUES ('early', 'a1', 5.0::DOUBLE), ('early', 'a2', 1.0), ('early', 'a3', 1.0), ('middle', 'a4', 4.0), ('middle', 'a5', 4.0), ('late', 'a6', 5.0), ('late', 'a7', 3.0)),
nd AS (SELECT stage, sqrt(sum(need * need)) AS n FROM g GROUP BY stage), o AS (SELECT role, sqrt(sum(proficiency ^ 2)) AS l FROM prof GROUP BY role),
sm AS (SELECT role, stage, round(sum(proficiency * need) / (max(l) * max(nd.n) + 1e-9), 6) AS similarity FROM prof JOIN g USING (axis) JOIN nd USING (stage) JOIN o USING (role) GROUP BY role, stage),
dm AS (SELECT role, bool_or(axis IN ('a5', 'a6')) AS transversal FROM (SELECT role, axis FROM prof QUALIFY row_number() OVER (PARTITION BY role ORDER BY proficiency DESC, axis) <= 2) GROUP BY role)
SELECT role, CASE WHEN NOT transversal THEN stage END AS stage, CASE WHEN NOT transversal THEN similarity END AS similarity, transversal FROM sm JOIN dm USING (role) QUALIFY row_number() OVER (PARTITION BY role ORDER BY sm.similarity DESC, sm.stage) = 1""")
def stage_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return career.stages(profile(spark, sf_dir), _STAGES, ("a5", "a6"))


@query(f"""WITH {_PROFILE}, t AS (SELECT r_name AS team, n_name AS role FROM nation JOIN region ON n_regionkey = r_regionkey), q(axis, required) AS (VALUES ('a1', 3.0::DOUBLE), ('a2', 3.5), ('a3', 4.0), ('a4', 4.5))
SELECT team, axis, max(proficiency) AS supply, max(required) AS required, max(proficiency) >= max(required) - 0.01 AS covered FROM t JOIN prof USING (role) JOIN q USING (axis) GROUP BY team, axis""")
def stage_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    teams = nations.join(F.broadcast(regions), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("team"), F.col("n_name").alias("role"))
    return career.coverage(profile(spark, sf_dir), teams, {"a1": 3.0, "a2": 3.5, "a3": 4.0, "a4": 4.5})


@query(f"""WITH {_PROFILE}, {_NAMED}, x AS (SELECT role, axis, round(greatest(0.0, proficiency - j), 4) AS gap FROM j)
SELECT role, axis, gap, row_number() OVER (PARTITION BY role ORDER BY gap DESC, axis) AS rank FROM x WHERE gap > 0 QUALIFY rank <= 3""")
def growth_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each role's juniors lack most of its own peak."""
    return career.top_gaps(_named(spark, sf_dir))


_TEAMS = """mb AS (SELECT n_name AS role, count(c_custkey) AS members FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1), lo AS (SELECT list_sort(list(members)) AS lo, count(*) AS n FROM mb),
gr AS (SELECT role, members, CASE WHEN members <= 0 THEN 0 WHEN members >= lo[n * 4 // 5] THEN 4 WHEN members >= lo[n * 3 // 5] THEN 3 WHEN members >= lo[n * 2 // 5] THEN 2 WHEN members >= lo[n // 5] THEN 1 ELSE 0 END AS grade FROM mb, lo),
dm AS (SELECT role, bool_or(axis IN ('a5', 'a6')) AS transversal FROM (SELECT role, axis FROM prof QUALIFY row_number() OVER (PARTITION BY role ORDER BY proficiency DESC, axis) <= 2) GROUP BY role),
st AS (SELECT n_name AS role, r_name AS stage FROM nation JOIN region ON n_regionkey = r_regionkey), rs AS (SELECT role, stage, members, grade, transversal FROM gr JOIN dm USING (role) JOIN st USING (role))"""


def _residents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with their region as stage, customers as members, and two axes that make a role transversal."""
    from quillspark.operators import axes
    from quillspark.operators.text import top

    nations, customers = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    counts = nations.join(customers, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_name").alias("role")).agg(F.count("c_custkey").alias("members"))
    dominant = top(profile(spark, sf_dir), ["role"], [F.desc("proficiency"), F.asc("axis")], 2)
    transversal = dominant.groupBy("role").agg(F.max(F.col("axis").isin("a5", "a6")).alias("transversal"))
    stages = nations.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("role"), F.col("r_name").alias("stage"))
    return axes.graded(counts).join(transversal, "role").join(stages, "role").select("role", "stage", "members", "grade", "transversal")


@query(f"""WITH {_PROFILE}, {_TEAMS}, o AS (SELECT stage, role, grade, row_number() OVER (PARTITION BY stage ORDER BY members DESC, role) AS place FROM rs WHERE NOT transversal QUALIFY place <= 4),
b AS (SELECT role FROM rs WHERE transversal ORDER BY members DESC, role LIMIT 1)
SELECT stage, role, grade, place FROM o UNION ALL SELECT DISTINCT stage, b.role, 2, 5 FROM rs, b""")
def stage_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return career.stage_teams(_residents(spark, sf_dir))


@query(f"WITH {_PROFILE}, {_TEAMS} SELECT stage, grade, role AS title FROM rs WHERE NOT transversal")
def role_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell of each role that belongs to one stage."""
    return _residents(spark, sf_dir).where("not transversal").select("stage", "grade", F.col("role").alias("title"))


@query(f"WITH {_PROFILE}, {_TEAMS} SELECT role, grade, role AS label FROM (SELECT role FROM rs WHERE transversal), (SELECT unnest(range(5))::INTEGER AS grade)")
def transversal_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transversal roles have their label at every grade."""
    roles = _residents(spark, sf_dir).where("transversal").select("role")
    return roles.select("role", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("grade")).withColumn("label", F.col("role"))
