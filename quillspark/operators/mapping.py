"""Skills to axes: glossary tags blended with cosines, means of roles, and the skills that contribute most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.vectors import dot, normalised
from quillspark.operators import axes
from quillspark.operators.clusters import centroids
from quillspark.operators.text import top

# What a tag and a cosine weigh, and how many contributing skills are listed.
TAG, COSINE, CONTRIBUTING = 0.7, 0.3, 3


def tags(glossary: DataFrame) -> DataFrame:
    """skill, axis, tag of a glossary (axis, skill): a skill on k axes counts 1 / k on each; case and ends don't matter."""
    listed = glossary.select("axis", F.lower(F.trim("skill")).alias("skill")).distinct()
    return listed.join(listed.groupBy("skill").agg(F.count("*").alias("k")), "skill").select("skill", "axis", (1 / F.col("k")).alias("tag"))


def backfilled(known: DataFrame, skills: DataFrame, given: DataFrame) -> DataFrame:
    """The tags, with tag 1 for skills that have none and that `given` (skill, axis) names an axis for."""
    untagged = skills.select(F.lower(F.trim("skill")).alias("skill")).distinct().join(known.select("skill").distinct(), "skill", "left_anti")
    valid = known.select("axis").distinct()
    more = given.select(F.lower(F.trim("skill")).alias("skill"), "axis").join(untagged, "skill", "left_semi").join(valid, "axis", "left_semi")
    return known.unionByName(more.select("skill", "axis", F.lit(1.0).alias("tag")))


def blended(skills: DataFrame, tag_rows: DataFrame, embedded_glossary: DataFrame) -> DataFrame:
    """skill, axis, score of skills (skill, embedding) on every axis: TAG * tag + COSINE * cosine with the axis' centroid.

    embedded_glossary: axis, embedding of each phrase. Axes are few; their centroids go to the skills by broadcast.
    """
    centres = centroids(embedded_glossary, "axis", "embedding").select("axis", normalised(F.col("centroid")).alias("centre"))
    every = skills.select("skill", "embedding", F.lower(F.trim("skill")).alias("key")).crossJoin(F.broadcast(centres))  # one row for each axis
    known = tag_rows.select(F.col("skill").alias("key"), "axis", "tag")
    score = TAG * F.coalesce("tag", F.lit(0.0)) + COSINE * dot(F.col("embedding"), F.col("centre"))
    return every.join(known, ["key", "axis"], "left").select("skill", "axis", score.alias("score"))


def role_axes(role_skills: DataFrame, scores: DataFrame) -> DataFrame:
    """role, axis, proficiency (mean score of the role's skills, normalised over all roles), contributing (the
    foremost skills by score, then name)."""
    each = role_skills.select("role", "skill").join(scores, "skill")
    means = each.groupBy("role", "axis").agg(F.avg("score").alias("x"))
    best = top(each.withColumn("score", F.round("score", 4)), ["role", "axis"], [F.desc("score"), F.asc("skill")], CONTRIBUTING)
    listed = best.groupBy("role", "axis").agg(F.array_sort(F.collect_list(F.struct("rank", "skill", F.col("score").alias("contribution")))).alias("c"))
    named = listed.select("role", "axis", F.transform("c", lambda s: F.struct(s["skill"].alias("skill"), s["contribution"].alias("contribution"))).alias("contributing"))
    return axes.normalised(means, "axis", "x").join(named, ["role", "axis"]).select("role", "axis", F.round("score", 4).alias("proficiency"), "contributing")


def letters(text: Column) -> Column:
    """Unit vectors of the counts of a to z: an embedder without a model, for tests and defaults."""
    lower = F.lower(text)
    counts = F.array(*[(F.length(lower) - F.length(F.replace(lower, F.lit(chr(97 + i))))).cast("double") for i in range(26)])
    return normalised(counts)
