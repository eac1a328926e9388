"""Overlap of skill sets between groups, and co-occurrence of skills in baskets.

Segments of customers stand for specialties, the kinds of the parts they order for skills.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import sets
from quillspark.plans.registry import query, table

_COUNTS = """
k AS (SELECT c_mktsegment AS specialty, p_brand || '/' || p_type || '/' || p_size AS skill, count(*) AS cnt FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
"""


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    lines = t("lineitem").select("l_orderkey", "l_partkey")
    joined = (
        lines.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("part").select("p_partkey", "p_brand", "p_type", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    )
    return joined.groupBy(F.col("c_mktsegment").alias("specialty"), F.concat_ws("/", "p_brand", "p_type", "p_size").alias("skill")).agg(F.count("*").alias("cnt"))


@query(f"""WITH {_COUNTS}, z AS (SELECT specialty, count(*) AS n FROM k GROUP BY 1),
i AS (SELECT x.specialty AS a, y.specialty AS b, count(*) AS shared FROM k x JOIN k y USING (skill) GROUP BY 1, 2)
SELECT x.specialty AS a, y.specialty AS b, round(CASE WHEN x.specialty = y.specialty THEN 1.0 ELSE coalesce(shared, 0)::DOUBLE / (x.n + y.n - coalesce(shared, 0)) END, 6) AS jaccard
FROM z x CROSS JOIN z y LEFT JOIN i ON i.a = x.specialty AND i.b = y.specialty""")
def jaccard_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.jaccard(_counts(spark, sf_dir), "specialty", "skill").select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query(f"WITH {_COUNTS} SELECT skill, min(cnt) AS least, sum(cnt)::BIGINT AS total FROM k WHERE cnt >= 2 GROUP BY skill HAVING count(*) = (SELECT count(DISTINCT specialty) FROM k)")
def shared_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.shared(_counts(spark, sf_dir), "specialty", "skill", "cnt", 2)


@query(f"""WITH {_COUNTS} SELECT specialty, skill, cnt FROM k x WHERE cnt >= 2 AND NOT EXISTS (SELECT 1 FROM k y WHERE y.skill = x.skill AND y.specialty <> x.specialty AND y.cnt >= 6)""")
def unique_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills of a specialty that no other has six times or more."""
    return sets.unique(_counts(spark, sf_dir), "specialty", "skill", "cnt", 2, 6)


@query(f"""WITH {_COUNTS}, f AS (SELECT *, cnt / sum(cnt) OVER (PARTITION BY specialty)::DOUBLE AS freq FROM k), s AS (SELECT DISTINCT specialty FROM k),
d AS (SELECT x.specialty AS a, s.specialty AS b, x.skill, x.cnt / (1.0 + coalesce(y.cnt, 0)) AS score FROM f x JOIN s ON s.specialty <> x.specialty LEFT JOIN k y ON y.specialty = s.specialty AND y.skill = x.skill)
SELECT a, b, skill, round(score, 4) AS score, row_number() OVER (PARTITION BY a, b ORDER BY round(score, 4) DESC, skill) AS rank FROM d QUALIFY rank <= 20""")
def differentiating(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.differentiating(_counts(spark, sf_dir), "specialty", "skill", "cnt", 20)


@query(f"""WITH {_COUNTS}, s AS (SELECT DISTINCT specialty FROM k),
u AS (SELECT x.specialty AS a, y.specialty AS b, skill FROM s x JOIN s y ON x.specialty <> y.specialty JOIN k ON k.specialty IN (x.specialty, y.specialty)),
d AS (SELECT DISTINCT a, b, skill FROM u)
SELECT a, b, d.skill, round(coalesce(x.cnt, 0) / (1.0 + coalesce(y.cnt, 0)), 4) AS score FROM d LEFT JOIN k x ON x.specialty = a AND x.skill = d.skill LEFT JOIN k y ON y.specialty = b AND y.skill = d.skill""")
def skill_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The skills of either of two specialties, each scored by how much more the first has of it."""
    return sets.differences(_counts(spark, sf_dir), "specialty", "skill", "cnt", missing=True)


_BASKETS = """
q AS (SELECT DISTINCT l_orderkey AS basket, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey),
o AS (SELECT x.item AS a, y.item AS b, count(*) AS n FROM q x JOIN q y ON x.basket = y.basket AND x.item <= y.item GROUP BY 1, 2)
"""


def _baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    joined = lines.select("l_orderkey", "l_partkey").join(parts.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(F.col("l_orderkey").alias("basket"), F.col("p_brand").alias("item")).distinct()


@query(f"WITH {_BASKETS} SELECT a, b, n FROM o")
def cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.cooccurrence(_baskets(spark, sf_dir), "basket", "item")


@query(f"""WITH {_BASKETS}, d AS (SELECT a AS item, n FROM o WHERE a = b)
SELECT a, b, round(1 - o.n::DOUBLE / (x.n + y.n - o.n), 6) AS distance FROM o JOIN d x ON x.item = a JOIN d y ON y.item = b WHERE a < b""")
def jaccard_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sets.jaccard_distance(sets.cooccurrence(_baskets(spark, sf_dir), "basket", "item"))
    return found.select("a", "b", F.round("distance", 6).alias("distance"))
