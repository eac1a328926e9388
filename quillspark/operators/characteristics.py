"""Scores of texts by characteristic: thresholds, fallbacks, means by title and cluster, phrases and filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.vectors import dot
from quillspark.operators.text import top

# Phrases that say nothing of a skill.
BOILERPLATE = (
    "опыт работы", "обучение и развитие", "развитие сотрудников", "аренда квартиры", "аренда квартир", "добровольное медицинское страхование",
    "медицинское страхование", "раз в месяц", "раза в месяц", "год", "месяц", "официальное трудоустройство", "трудоустройство", "социальный пакет",
    "график работы", "заработная плата", "заработной платы", "зарплата", "рабочее место", "рабочем месте", "условия труда", "полный рабочий день",
    "высшее образование", "среднее образование", "высшее профессиональное образование", "образование", "ученая степень", "ученой степени",
    "учёная степень", "знание", "навык", "навыки", "умение", "умения", "компетенция", "компетенции", "требование", "требования", "стаж", "стаж работы", "опыт",
)
# The sections of a posting that skills are taken from.
SECTIONS = ("requirements", "responsibilities")


def confident(scored: DataFrame, least: float = 0.3, known: list[str] | None = None) -> DataFrame:
    """vacancy_id, characteristic, confidence of scored (vacancy_id, scores: a map by characteristic): one row for each
    score of `least` or more; characteristics that aren't known are left out."""
    rows = scored.select("vacancy_id", F.explode("scores").alias("characteristic", "confidence")).where(F.col("confidence") >= least)
    return rows.where(F.col("characteristic").isin(known)) if known is not None else rows


def scored_or(texts: DataFrame, first: Callable[[DataFrame], DataFrame], second: Callable[[DataFrame], DataFrame], least: float = 0.3) -> DataFrame:
    """Texts (vacancy_id, text) scored by the first scorer, and by the second where the first gives no scores; empty
    texts go to neither. A scorer gives vacancy_id, scores."""
    full = texts.where(F.length(F.trim("text")) > 0)
    found = first(full).where("scores is not null")
    rest = full.join(found.select("vacancy_id"), "vacancy_id", "left_anti")
    return confident(found, least).unionByName(confident(second(rest), least))


def title_means(rows: DataFrame) -> DataFrame:
    """title, label, confidence: the mean over the rows of a title."""
    return rows.groupBy("title", "label").agg(F.avg("confidence").alias("confidence"))


def foremost_labels(rows: DataFrame, n: int = 2) -> DataFrame:
    """title, labels: of each title the n labels of the greatest mean confidence in order."""
    best = top(title_means(rows).withColumn("c", F.round("confidence", 9)), ["title"], [F.desc("c"), F.asc("label")], n)
    ordered = best.groupBy("title").agg(F.array_sort(F.collect_list(F.struct("rank", "label"))).alias("l"))
    return ordered.select("title", F.transform("l", lambda x: x["label"]).alias("labels"))


def enriched(title: Column, labels: Column) -> Column:
    """The title with its labels before it, or the bare title."""
    return F.when(F.size(labels) > 0, F.concat(F.lit("characteristics: "), F.array_join(labels, ", "), F.lit("; "), title)).otherwise(title)


def cluster_profile(rows: DataFrame, members: DataFrame) -> DataFrame:
    """cluster, profile: a map from label to mean confidence over the titles of a cluster (members: title, cluster)."""
    means = rows.join(members, "title").groupBy("cluster", "label").agg(F.round(F.avg("confidence"), 4).alias("c"))
    return means.groupBy("cluster").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "c")))).alias("profile"))


def without_boilerplate(rows: DataFrame, text: str, lemma: str, phrases: tuple[str, ...] = BOILERPLATE) -> DataFrame:
    """Rows neither whose text nor whose lemma is a phrase that says nothing."""
    return rows.where(~F.lower(F.trim(text)).isin(list(phrases)) & ~F.lower(F.trim(lemma)).isin(list(phrases)))


def kept_sections(sentences: DataFrame, kept: tuple[str, ...] = SECTIONS) -> DataFrame:
    """vacancy_id, text of sentences (vacancy_id, pos, sentence, label): those of the sections kept, in order; sentences
    whose label is null (the classifier failed) stay."""
    rows = sentences.where(F.col("label").isNull() | F.col("label").isin(list(kept)))
    ordered = rows.groupBy("vacancy_id").agg(F.array_sort(F.collect_list(F.struct("pos", "sentence"))).alias("s"))
    return ordered.select("vacancy_id", F.concat_ws(" ", F.transform("s", lambda x: x["sentence"])).alias("text"))


def contains_any(text: Column, terms: list[str], empty: bool) -> Column:
    """Does the text hold one of the terms, whatever their case? With no terms the answer is `empty`."""
    lower = F.lower(text)
    found = F.lit(empty)
    for i, term in enumerate(terms):
        hit = F.coalesce(F.contains(lower, F.lit(term.lower())), F.lit(False))
        found = hit if i == 0 else found | hit
    return found


def canonical(phrases: DataFrame, canonicals: DataFrame, block: int = 512) -> DataFrame:
    """phrase, canonical, similarity of phrases (phrase, embedding): the canonical phrase (canonical, embedding) of the
    greatest dot product, of equal ones the first by name.

    Canonical phrases grow with the corpus, so blocks of them meet the phrases in a join, and each phrase keeps the best
    of a block before the blocks meet.
    """
    n = canonicals.agg(F.greatest(F.ceil(F.count("*") / block), F.lit(1)).alias("parts"))
    placed = canonicals.crossJoin(F.broadcast(n)).withColumn("part", F.pmod(F.xxhash64("canonical"), F.col("parts")))
    blocks = placed.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("canonical", F.col("embedding").alias("e")))).alias("cs"))
    asked = phrases.crossJoin(F.broadcast(n)).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    pairs = asked.join(blocks, "part")
    scored = F.transform("cs", lambda c: F.struct(F.round(dot(F.col("embedding"), c["e"]), 9).alias("similarity"), c["canonical"].alias("canonical")))
    better = lambda a, b: F.when(b["similarity"] > a["similarity"], b).otherwise(a)
    best = pairs.withColumn("s", scored).select("phrase", F.aggregate(F.slice("s", 2, F.size("s")), F.col("s")[0], better).alias("b"))
    found = top(best.select("phrase", "b.canonical", "b.similarity"), ["phrase"], [F.desc("similarity"), F.asc("canonical")], 1)
    return found.select("phrase", "canonical", "similarity")
