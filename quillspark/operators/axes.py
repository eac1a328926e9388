"""Scores of roles on axes: normalisation, rubrics, levels, rule categories, archetypes and nested role models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark import stages
from quillspark.operators import graphs

# The weight of each of seven levels; a level's threshold on an axis is 1 + 4 * weight.
LEVELS = (0.10, 0.25, 0.40, 0.60, 0.80, 0.95, 1.00)
# The shares by which a role has its archetype, and the names of the archetypes.
SIGNIFICANT, LEADING, TALKING, METHODICAL = 0.15, 0.5, 0.3, 0.35
ARCHETYPES = ("Техник", "Инженер", "Исследователь", "Ведущий специалист", "Методолог", "Гибрид")
SUPER_CATEGORIES = ("experimental", "computational", "communication", "domain")
# How soft competences follow from axes.
SOFT = {
    "thinking": {"data_analysis": 0.45, "computational": 0.35, "experimental": 0.20},
    "teamwork": {"professional_texts": 0.40, "management": 0.35, "experimental": 0.25},
    "leadership": {"management": 0.70, "professional_texts": 0.20, "domain_knowledge": 0.10},
    "professional_culture": {"professional_texts": 0.50, "domain_knowledge": 0.30, "management": 0.20},
}
FLAT, MIDDLE, MANY = 1e-12, 3.0, 15


def normalised(rows: DataFrame, axis: str, value: str) -> DataFrame:
    """score in [1, 5] over all roles of an axis: of MANY roles or more 3 + z, clipped; else min-max; MIDDLE where flat."""
    w = Window.partitionBy(axis)
    x, lo, hi = F.col(value), F.min(value).over(w), F.max(value).over(w)
    sd, mean = F.stddev_pop(value).over(w), F.avg(value).over(w)
    z = F.when(sd < FLAT, MIDDLE).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(5.0), 3 + (x - mean) / F.nullif(sd, F.lit(0.0)))))
    span = F.when(hi - lo < FLAT, MIDDLE).otherwise(1 + 4 * (x - lo) / F.nullif(hi - lo, F.lit(0.0)))
    return rows.withColumn("score", F.when(F.count("*").over(w) >= MANY, z).otherwise(span))


def rubric_scores(scores: DataFrame, rubric: dict[str, dict[str, float]]) -> DataFrame:
    """role, soft, proficiency: a weighted sum of the axes of each role, clipped to [1, 5]; missing axes count 0."""
    spark = scores.sparkSession
    rows = [(soft, axis, float(w)) for soft, weights in rubric.items() for axis, w in weights.items()]
    table = spark.createDataFrame(rows, "soft string, axis string, w double")
    total = F.sum(F.coalesce("proficiency", F.lit(0.0)) * F.col("w"))
    return scores.join(F.broadcast(table), "axis").groupBy("role", "soft").agg(F.greatest(F.lit(1.0), F.least(F.lit(5.0), total)).alias("proficiency"))


def achieved(scores: DataFrame, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """role, level, threshold, achieved, axes: the axes of each role at or above each level's threshold."""
    level = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), (F.lit(1.0) + F.lit(4.0) * F.lit(w)).alias("threshold")) for i, w in enumerate(levels, 1)]))
    each = scores.withColumn("l", level).select("role", "axis", "proficiency", "l.*")
    reached = F.col("proficiency") >= F.col("threshold")
    return each.groupBy("role", "level", "threshold").agg(
        F.count_if(reached).alias("achieved"), F.array_sort(F.collect_list(F.when(reached, F.col("axis")))).alias("axes")
    )


def categorised(phrases: DataFrame, phrase: str, rules: list[tuple[str, list[str]]]) -> DataFrame:
    """phrase, category: the first rule with a trigger that the phrase holds or that holds the phrase; case and ends
    don't matter. Rules are a short fixed list, which each phrase goes through by itself."""
    p = F.lower(F.trim(phrase))
    chain = F
    for category, triggers in rules:
        listed = F.array(*[F.lit(t) for t in triggers])
        chain = chain.when(F.exists(listed, lambda t: F.contains(p, t) | F.contains(t, p)), category)
    return phrases.where(p != "").withColumn("category", chain.otherwise(None)).where("category is not null")


def super_fractions(skills: DataFrame) -> DataFrame:
    """role, experimental, computational, communication, domain (shares of the classified skills, to four places),
    significant (how many shares are above SIGNIFICANT) of skills (role, super_category); unclassified ones are null."""
    known = F.col("super_category").isin(*SUPER_CATEGORIES)
    total = F.greatest(F.count_if(known), F.lit(1))
    exact = skills.groupBy("role").agg(*[(F.count_if(F.coalesce(F.col("super_category") == c, F.lit(False))) / total).alias(c) for c in SUPER_CATEGORIES])
    significant = sum((F.when(F.col(c) > SIGNIFICANT, 1).otherwise(0) for c in SUPER_CATEGORIES), F.lit(0))
    return exact.withColumn("significant", significant)


def archetypes(fractions: DataFrame) -> DataFrame:
    """fractions with the archetype of each role by its shares; the first rule that holds wins."""
    technician, engineer, researcher, lead, methodologist, hybrid = ARCHETYPES
    broad, talk = F.col("significant") >= 3, F.col("communication")
    rule = (
        F.when(F.col("experimental") > LEADING, technician)
        .when(F.col("computational") > LEADING, engineer)
        .when(broad & (talk < TALKING), researcher)
        .when(broad & (talk >= TALKING), lead)
        .when(talk >= METHODICAL, methodologist)
        .otherwise(hybrid)
    )
    return fractions.withColumn("archetype", rule)


def axis_names(skills: DataFrame, longest: int = 60) -> DataFrame:
    """axis, name of skills (axis, pos, skill, category): the category of half of them or more, else two categories
    where the first has 0.3 or more, else the first three skills, or two if those are too long together. Of equally
    frequent categories the one met first counts as first."""
    total = skills.groupBy("axis").agg(
        F.count("*").alias("n"), F.transform(F.slice(F.array_sort(F.collect_list(F.struct("pos", "skill"))), 1, 3), lambda s: s["skill"]).alias("first")
    )  # an axis has some tens of skills
    counts = skills.where("category is not null").groupBy("axis", "category").agg(F.count("*").alias("k"), F.min("pos").alias("pos"))
    ranked = counts.groupBy("axis").agg(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), "pos", "category"))).alias("c"))
    both = total.join(ranked, "axis", "left")
    share = -F.col("c")[0]["k"] / F.col("n")
    three = F.array_join("first", ", ")
    plain = F.when(F.length(three) > longest, F.array_join(F.slice("first", 1, 2), ", ")).otherwise(three)
    two = F.concat(F.col("c")[0]["category"], F.lit(" + "), F.try_element_at("c", F.lit(2))["category"])
    name = F.when(share >= 0.5, F.col("c")[0]["category"]).when((F.size("c") >= 2) & (share >= 0.3), two).otherwise(plain)
    return both.select("axis", name.alias("name"))


def graded(roles: DataFrame, count: str = "members") -> DataFrame:
    """roles with grade: 4 to 1 for the highest fifth's cut that the members reach, 0 below all and for no members.

    The cut of grade g is the member count at place floor(n g / 5) of all, ascending (the last where that is 0). The four
    cuts are looked up in distributed ranks; nothing but them comes to the driver.
    """
    held, seen = stages.counted(roles, "ungraded")
    n = seen["n"]
    places = {g: (n * g // 5 or n) - 1 for g in (1, 2, 3, 4)}
    ranks = graphs.ranked(held.select(count), n, [count], "__r").where(F.col("__r").isin(*places.values()))
    cuts = {r["__r"]: r[count] for r in ranks.collect()}
    grade = F.when(F.col(count) <= 0, 0)
    for g in (4, 3, 2, 1):
        if places[g] in cuts:
            grade = grade.when(F.col(count) >= F.lit(cuts[places[g]]), g)
    return held.withColumn("grade", grade.otherwise(0))


def role_models(scores: DataFrame, members: DataFrame) -> DataFrame:
    """The nested document of each role: its characteristics by axis, its levels and its number of members."""
    characteristics = scores.groupBy("role").agg(F.array_sort(F.collect_list(F.struct("axis", "proficiency"))).alias("characteristics"))
    levels = (
        achieved(scores)
        .groupBy("role")
        .agg(F.array_sort(F.collect_list(F.struct("level", "threshold", "achieved", "axes"))).alias("competency_levels"))
    )
    return characteristics.join(levels, "role").join(members, "role", "left").withColumn("member_count", F.coalesce("member_count", F.lit(0)))
