"""The batch pipeline over raw postings: classify, skills, roles, axes, models and validation as one graph of frames.

Scorers, extractors and embedders are functions DataFrame -> DataFrame that a caller may replace; the defaults are
deterministic.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark import stages
from quillspark.config import Config
from quillspark.functions.vectors import cosine
from quillspark.operators import axes, characteristics, clusters, density, mapping, phrases
from quillspark.operators.text import tfidf, tokens, top

Scorer = Callable[[DataFrame], DataFrame]
# Roles of software work by their numbers, and the words of the two rules.
IT_ROLES = (96, 123, 124, 125, 126)
IT_WORDS = r"[Pp]rogramm|[Пп]рограмм|[RrРр]азработчик"
STEM_WORDS = r"лаборатор|эксперимент|исследовани|научн|анализ|синтез|моделирован"


@dataclass(frozen=True)
class Scorers:
    """category: vacancy_id, text -> vacancy_id, stem, it, other. embed: title -> title, embedding (of length one).

    phrases: vacancy_id, description -> vacancy_id, at, text, lemma. sections: vacancy_id, description -> vacancy_id, pos,
    sentence, label; None keeps whole descriptions. axes: skill -> skill, axis for skills that no glossary has; None for none.
    """

    category: Scorer
    embed: Scorer
    phrases: Scorer | None = None
    sections: Scorer | None = None
    axes: Scorer | None = None


def keyword_scores(rows: DataFrame) -> DataFrame:
    share = lambda p: F.size(F.regexp_extract_all("text", F.lit(f"({p})"), 1)).cast("double")
    stem, it = share(STEM_WORDS), share(IT_WORDS)
    total = stem + it + 1
    return rows.select("vacancy_id", (stem / total).alias("stem"), (it / total).alias("it"), (1 / total).alias("other"))


def hashed_embedding(titles: DataFrame, size: int = 64) -> DataFrame:
    """Unit vectors of hashed character trigrams."""
    padded = F.concat(F.lit(" "), F.lower("title"), F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - 2, F.lit(1))), lambda i: F.substring(padded, i, F.lit(3)))
    slots = F.transform(grams, lambda g: F.pmod(F.xxhash64(g), F.lit(size)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)) + 1e-12
    return titles.withColumn("v", counts).select("title", F.transform("v", lambda x: x / length).alias("embedding"))


DEFAULTS = Scorers(keyword_scores, hashed_embedding)


def classified(vacancies: DataFrame, config: Config, scorers: Scorers = DEFAULTS) -> DataFrame:
    """vacancy_id, title, description, stem_category (and key_skills): by role numbers, then words, then scores of what is left."""
    title, text = F.coalesce("name", F.lit("")), F.coalesce("description", F.lit(""))
    more = ["key_skills"] if "key_skills" in vacancies.columns else []
    rows = vacancies.select(
        F.col("id").alias("vacancy_id"), title.alias("title"), text.alias("description"), *more,
        F.arrays_overlap(F.transform("professional_roles", lambda r: r["id"]), F.array(*[F.lit(i) for i in IT_ROLES])).alias("by_role"),
    )
    rule = F.coalesce("by_role", F.lit(False)) | (F.col("title").rlike(IT_WORDS) & ~F.col("description").rlike(STEM_WORDS))
    ruled = rows.withColumn("ruled", rule).drop("by_role")
    sure = ruled.where("ruled").drop("ruled").withColumn("stem_category", F.lit("PURE_IT"))
    rest = ruled.where("not ruled").drop("ruled")
    scores = scorers.category(rest.select("vacancy_id", F.concat_ws(" ", F.nullif("title", F.lit("")), F.nullif("description", F.lit(""))).alias("text")))
    both = (F.col("stem") > config.interdisciplinary) & (F.col("it") > config.interdisciplinary)
    best = F.greatest("stem", "it", "other")
    category = F.when(both, "INTERDISCIPLINARY").when(F.col("stem") == best, "STEM_RESEARCH").when(F.col("it") == best, "PURE_IT").otherwise("NON_STEM")
    return sure.unionByName(rest.join(scores, "vacancy_id").withColumn("stem_category", category).drop("stem", "it", "other"))


def words(rows: DataFrame) -> DataFrame:
    """Distinct words as phrases: an extractor without a model."""
    return rows.select("vacancy_id", F.posexplode(tokens(F.col("description"))).alias("at", "text")).withColumn("lemma", F.col("text"))


def skills(rows: DataFrame, config: Config, scorers: Scorers = DEFAULTS) -> DataFrame:
    """vacancy_id, skill_phrase, frequency, tfidf_weight: the phrases of the sections that tell of skills, then the key
    skills, without boilerplate, as canonical phrases; of a vacancy the first ones, of those that come in enough vacancies."""
    kept = rows.where(F.length(F.trim("description")) >= 20)
    texts = kept.select("vacancy_id", "description")
    if scorers.sections:
        texts = characteristics.kept_sections(scorers.sections(texts)).withColumnRenamed("text", "description")
    found = characteristics.without_boilerplate((scorers.phrases or words)(texts), "text", "lemma")
    given = kept.select("vacancy_id", F.posexplode("key_skills").alias("at", "s")).select("vacancy_id", "at", F.col("s.name").alias("text")) if "key_skills" in rows.columns else None
    none = found.select("vacancy_id", "at", "text").limit(0)
    listed = phrases.with_key_skills(found, none if given is None else given, "vacancy_id", config.max_words)
    terms = phrases.canonical_terms(listed, "vacancy_id", scorers.embed, config.dedup_similarity, config.max_skills, config.min_document_frequency)
    weighted = tfidf(terms.withColumnRenamed("term", "skill_phrase"), "vacancy_id")
    return weighted.select("vacancy_id", "skill_phrase", F.lit(1).alias("frequency"), F.round("weight", 6).alias("tfidf_weight"))


def roles(rows: DataFrame, config: Config, scorers: Scorers = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """title, role of distinct titles, and role, centroid, member_count, top_titles, noise_flag.

    Roles are clusters of titles by density, each named by the title nearest to its centroid; noise is one more row, to
    which no title goes: every title has the role of the nearest centroid (none where there are only noise titles).
    """
    titles = rows.select("title").where("title <> ''").distinct()
    vectors = stages.written(scorers.embed(titles), "titles")
    found = density.clustered(vectors, "title", "embedding", config.min_cluster_size, config.min_samples, config.cluster_epsilon)
    members = stages.written(vectors.join(found.select("title", F.coalesce("cluster", F.lit("")).alias("cluster")), "title"), "members")  # no title is empty
    centres = clusters.centroids(members, "cluster", "embedding")
    near = members.join(centres, "cluster").select("cluster", "title", F.round(cosine(F.col("embedding"), F.col("centroid")), 9).alias("near"))
    best = top(near, ["cluster"], [F.desc("near"), F.asc("title")], 3)
    listed = best.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("rank", "title"))).alias("t"))
    named = listed.select("cluster", F.transform("t", lambda t: t["title"]).alias("top_titles"))
    noise = F.col("cluster") == ""
    out = centres.join(named, "cluster").select(F.element_at("top_titles", 1).alias("role"), "centroid", F.col("members").alias("member_count"), "top_titles", noise.alias("noise_flag"))
    table = stages.written(out, "roles")
    real = table.where(~F.col("noise_flag"))
    own = clusters.nearest(vectors, "title", "embedding", real, "role").select("title", F.col("nearest").alias("role"))
    return own, table


def skills_per_role(skill_rows: DataFrame, rows: DataFrame, named: DataFrame) -> DataFrame:
    own = rows.select("vacancy_id", "title").join(named, "title").select("vacancy_id", "role")
    return skill_rows.join(own, "vacancy_id").groupBy("role", F.col("skill_phrase").alias("skill")).agg(
        F.sum("frequency").alias("frequency"), F.sum("tfidf_weight").alias("tfidf_weight")
    )


def axis_scores(role_skills: DataFrame, glossary: DataFrame, scorers: Scorers = DEFAULTS) -> DataFrame:
    """role, axis, proficiency, contributing: skills by glossary (axis, skill), or by the scorer where no glossary has them,
    blended with cosines to the axes' centroids; means of roles, normalised, with the foremost skills."""
    own = role_skills.select("skill").distinct()
    known = mapping.tags(glossary)
    if scorers.axes:
        known = mapping.backfilled(known, own, scorers.axes(own.join(known.select("skill").distinct(), "skill", "left_anti")))
    embedded = lambda df: scorers.embed(df.select(F.col("skill").alias("title")).distinct()).withColumnRenamed("title", "skill")
    listed = glossary.select("axis", "skill").join(embedded(glossary), "skill").select("axis", "embedding")
    scores = mapping.blended(embedded(own), known, listed)
    return mapping.role_axes(role_skills, scores)


def models(scores: DataFrame, members: DataFrame, role_skills: DataFrame, config: Config) -> DataFrame:
    """The nested model of each role with its foremost skills."""
    best = top(role_skills, ["role"], [F.desc("tfidf_weight"), F.asc("skill")], config.top_skills)
    listed = best.groupBy("role").agg(F.array_sort(F.collect_list(F.struct("rank", "skill", "tfidf_weight"))).alias("skills"))
    return axes.role_models(scores.drop("contributing"), members.where("not noise_flag").select("role", "member_count")).join(listed, "role", "left")


def validation(rows: DataFrame, role_table: DataFrame, scores: DataFrame) -> DataFrame:
    """metric, value: counts, coverage and separation of a run."""
    total = rows.agg(F.count("*").cast("double").alias("value")).select(F.lit("vacancies").alias("metric"), "value")
    stem = rows.agg(F.coalesce(F.avg(F.when(F.col("stem_category") == "STEM_RESEARCH", 1.0).otherwise(0.0)), F.lit(0.0)).alias("value"))
    complete = scores.groupBy("role").agg(F.count_distinct("axis").alias("n")).agg(F.count_if(F.col("n") >= 7).cast("double").alias("value"))
    apart = clusters.separation(role_table.where("not noise_flag"), "role").select(F.coalesce("separation", F.lit(0.0)).alias("value"))
    named = lambda df, m: df.select(F.lit(m).alias("metric"), "value")
    return total.union(named(stem, "stem_share")).union(named(complete, "complete_roles")).union(named(apart, "separation"))


def markdown(metrics: list, title: str = "Validation") -> str:
    """Bullets of (metric, value) rows; names that begin with _ are left out."""
    return "\n".join([f"# {title}", "", *[f"- {m}: {v:.4g}" for m, v in metrics if not m.startswith("_")], ""])
