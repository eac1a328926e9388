"""Schemes of skills from co-occurrence, grades of roles, names of axes, the cache of scored texts and chart data."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import axes, sets
from quillspark.operators import schemes as sc
from quillspark.operators.text import top
from quillspark.plans.registry import query, table
from quillspark.plans.sets import _baskets


@query()
def cluster_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, silhouette, gap over the distances of brands; the matrix has a row for each brand."""
    pairs = sets.cooccurrence(_baskets(spark, sf_dir), "basket", "item").withColumn("g", F.lit(1))
    run = lambda pdf: sc.cluster_counts(sc.jaccard_distances(sc.count_matrix(pdf)[1]), 8)
    return sc.per_group(pairs, "g", run, "k long, silhouette double, gap double")


@query()
def scheme_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How brands by manufacturer, their first two digits, hold together as groups."""
    pairs = sets.cooccurrence(_baskets(spark, sf_dir), "basket", "item").withColumn("g", F.lit(1))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, counts = sc.count_matrix(pdf)
        labels = pd.factorize(pd.Series(names).str.slice(0, 7))[0]
        return pd.DataFrame([sc.scheme(counts, labels)])

    return sc.per_group(pairs, "g", run, "coverage double, separation double, coherence double, combined double")


@query()
def scheme_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schemes of 2 to 6 axes over brands, with intervals and the optimal number."""
    pairs = sets.cooccurrence(_baskets(spark, sf_dir), "basket", "item").withColumn("g", F.lit(1))
    schema = (
        "k long, coverage double, separation double, coherence double, stability double, combined double, stability_low double, "
        "stability_high double, combined_low double, combined_high double, optimal boolean"
    )
    return sc.per_group(pairs, "g", lambda pdf: sc.evaluated(sc.count_matrix(pdf)[1], range(2, 7)), schema)


@query()
def cluster_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silhouette of three clusters of brands, with the interval of shuffled labels and how often they reach it."""
    pairs = sets.cooccurrence(_baskets(spark, sf_dir), "basket", "item").withColumn("g", F.lit(1))
    run = lambda pdf: pd.DataFrame([sc.significance(sc.jaccard_distances(sc.count_matrix(pdf)[1]), 3)])
    return sc.per_group(pairs, "g", run, "silhouette double, low double, high double, p double, significant boolean, shuffles long")


@query()
def specialty_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate names of segments by their foremost brands, with the manufacturer as category."""
    lines, orders, customers, parts = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "part"))
    joined = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    )
    counts = joined.groupBy(F.col("c_mktsegment").alias("specialty"), F.col("p_brand").alias("skill")).agg(F.count("*").alias("n"))
    best = top(counts, ["specialty"], [F.desc("n"), F.asc("skill")], 10)
    lists = best.groupBy("specialty").agg(F.array_sort(F.collect_list(F.struct("rank", "skill"))).alias("s"))
    every = lists.agg(F.collect_list(F.struct("specialty", F.transform("s", lambda x: x["skill"]).alias("skills"))).alias("all"))  # one row a specialty
    rows = lists.select("specialty").crossJoin(F.broadcast(every))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["specialty"].iloc[0]
        by = {x["specialty"]: list(x["skills"]) for x in pdf["all"].iloc[0]}
        categories = {skill: skill[:7] for skills in by.values() for skill in skills}
        found = sc.names(by[name], categories, [set(x) for k, x in by.items() if k != name])
        return found.assign(specialty=name)[["specialty", *found.columns]]

    return sc.per_group(rows, "specialty", run, "specialty string, strategy string, name string, stability double, distinctiveness double, optimal boolean")


@query("""WITH n AS (SELECT n_name AS role, count(c_custkey) AS members FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1), l AS (SELECT list_sort(list(members)) AS lo, count(*) AS n FROM n)
SELECT role, members, CASE WHEN members <= 0 THEN 0 WHEN members >= lo[n * 4 // 5] THEN 4 WHEN members >= lo[n * 3 // 5] THEN 3 WHEN members >= lo[n * 2 // 5] THEN 2 WHEN members >= lo[n // 5] THEN 1 ELSE 0 END AS grade FROM n, l""")
def quintile_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades 0 to 4 of nations by their customers."""
    customers = table(spark, sf_dir, "customer")
    rows = table(spark, sf_dir, "nation").join(customers, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    n = rows.groupBy(F.col("n_name").alias("role")).agg(F.count("c_custkey").alias("members"))
    return axes.graded(n).select("role", "members", "grade")


@query("""WITH k AS (SELECT p_brand AS axis, p_partkey AS pos, p_name AS skill, nullif(split_part(p_type, ' ', 1), 'PROMO') AS category FROM part), t AS (SELECT axis, count(*) AS n, list(skill ORDER BY pos)[1:3] AS f FROM k GROUP BY axis),
r AS (SELECT axis, category, count(*) AS n, min(pos) AS pos FROM k WHERE category IS NOT NULL GROUP BY 1, 2), c AS (SELECT axis, list(category ORDER BY n DESC, pos) AS cs, max(n) AS top FROM r GROUP BY axis)
SELECT axis, CASE WHEN top / n::DOUBLE >= 0.5 THEN cs[1] WHEN len(cs) >= 2 AND top / n::DOUBLE >= 0.3 THEN cs[1] || ' + ' || cs[2] WHEN length(array_to_string(f, ', ')) > 60 THEN array_to_string(f[1:2], ', ') ELSE array_to_string(f, ', ') END AS name FROM t LEFT JOIN c USING (axis)""")
def axis_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands named by the first words of their parts' types, or by their first parts."""
    category = F.nullif(F.split_part("p_type", F.lit(" "), F.lit(1)), F.lit("PROMO"))
    skills = table(spark, sf_dir, "part").select(F.col("p_brand").alias("axis"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("skill"), category.alias("category"))
    return axes.axis_names(skills)


@query("""SELECT DISTINCT sha256(text) AS key FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE source < 'src5')""")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that a cache filled from some sources lacks."""
    docs = table(spark, sf_dir, "documents")
    held = docs.where("source < 'src5'").select(F.sha2("text", 256).alias("key")).distinct()
    return docs.select(F.sha2("text", 256).alias("key")).distinct().join(held, "key", "left_anti")


@query("""SELECT n_name AS role, count(*) AS members, count(DISTINCT c_mktsegment) AS skills, round(avg(c_acctbal), 4) AS level FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def portfolio_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data of the summary chart: members, skills and mean level of each role."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy(F.col("n_name").alias("role")).agg(
        F.count("*").alias("members"), F.count_distinct("c_mktsegment").alias("skills"), F.round(F.avg("c_acctbal"), 4).alias("level")
    )
