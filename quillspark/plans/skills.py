"""Skill extraction, weighting and role profiles over documents: a document is a posting, its terms are skills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import text
from quillspark.plans.registry import query, table

_LEAST = 5
_PAIRS = r"""
t AS (SELECT doc_id, source, lang, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}]+'))) AS term FROM documents),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term HAVING count(*) >= 5),
p AS (SELECT t.*, df FROM t JOIN f USING (term)),
w AS (SELECT p.*, ln(1 + (SELECT count(DISTINCT doc_id) FROM p) / df::DOUBLE) / count(*) OVER (PARTITION BY doc_id) AS weight FROM p)
"""


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return text.tfidf(text.frequent(text.pairs(docs, "doc_id", "text", keep=("source", "lang")), "term", _LEAST), "doc_id")


@query(f"WITH {_PAIRS} SELECT doc_id, term, round(weight, 6) AS weight FROM w")
def tfidf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weighted(spark, sf_dir).select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query(f"WITH {_PAIRS} SELECT term, count(*) AS doc_count FROM p GROUP BY term")
def skill_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text.pairs(table(spark, sf_dir, "documents"), "doc_id", "text")
    return text.document_frequency(rows, "term").where(F.col("df") >= _LEAST).select("term", F.col("df").alias("doc_count"))


@query(f"WITH {_PAIRS} SELECT source AS role, term, count(*) AS frequency, round(sum(weight), 5) AS tfidf_weight FROM w GROUP BY 1, 2")
def skills_per_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weighted(spark, sf_dir).groupBy(F.col("source").alias("role"), "term").agg(
        F.count("*").alias("frequency"), F.round(F.sum("weight"), 5).alias("tfidf_weight")
    )


@query(
    f"""WITH {_PAIRS}, s AS (SELECT source AS role, term, count(*) AS frequency, round(sum(weight), 5) AS tfidf_weight FROM w GROUP BY 1, 2)
SELECT role, term, frequency, tfidf_weight, row_number() OVER (PARTITION BY role ORDER BY tfidf_weight DESC, term) AS rank FROM s QUALIFY rank <= 20"""
)
def top_skills_per_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.top(skills_per_role(spark, sf_dir), ["role"], [F.desc("tfidf_weight"), F.asc("term")], 20)


@query(
    r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}]+')) AS term, generate_subscripts(regexp_extract_all(lower(text), '[\p{L}]+'), 1) AS pos FROM documents),
d AS (SELECT doc_id, term, min(pos) AS pos FROM t GROUP BY 1, 2)
SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rank FROM d QUALIFY rank <= 30"""
)
def first_distinct_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 30 distinct terms of each document in order."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.slice(text.tokens(F.col("text")), 1, 30)).alias("pos", "term")).select(
        "doc_id", "term", (F.col("pos") + 1).cast("long").alias("rank")
    )


@query(
    r"""WITH t AS (SELECT doc_id, lang, source, length(trim(text)) AS chars, len(string_split_regex(trim(text), '\s+')) AS n_words FROM documents)
SELECT doc_id, chars, n_words FROM t WHERE chars >= 20 AND n_words BETWEEN 5 AND 500"""
)
def length_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trimmed = F.trim("text")
    return (
        docs.select("doc_id", F.length(trimmed).cast("long").alias("chars"), F.size(F.split(trimmed, r"\s+")).cast("long").alias("n_words"))
        .where("chars >= 20 AND n_words BETWEEN 5 AND 500")
    )


@query(
    """WITH p AS (SELECT doc_id, regexp_matches(lower(text), 'the|and|with') AS it, regexp_matches(lower(text), 'der|und|les|des') AS stem,
  coalesce(quality, 0) AS a, coalesce(toxic, 0) AS b, (l.doc_id IS NOT NULL) AS scored FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, CASE WHEN it AND NOT stem THEN 'PURE_IT' WHEN NOT scored THEN 'NON_STEM' WHEN a > 0.5 AND b > 0.5 THEN 'INTERDISCIPLINARY'
  WHEN a >= b THEN 'STEM_RESEARCH' ELSE 'PURE_IT' END AS category FROM p"""
)
def tier_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules first; only what they leave undecided meets the scores."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lower = F.lower("text")
    rules = docs.select("doc_id", (lower.rlike("the|and|with") & ~lower.rlike("der|und|les|des")).alias("rule"))
    decided = rules.where("rule").select("doc_id", F.lit("PURE_IT").alias("category"))
    a, b = F.coalesce("quality", F.lit(0)), F.coalesce("toxic", F.lit(0))
    scored = (
        rules.where("not coalesce(rule, false)")
        .join(labels.withColumn("scored", F.lit(True)), "doc_id", "left")
        .select(
            "doc_id",
            F.when(F.col("scored").isNull(), "NON_STEM")
            .when((a > 0.5) & (b > 0.5), "INTERDISCIPLINARY")
            .when(a >= b, "STEM_RESEARCH")
            .otherwise("PURE_IT")
            .alias("category"),
        )
    )
    return decided.unionByName(scored)


@query("SELECT lang, source, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY lang), 4) AS percent FROM documents GROUP BY lang, source")
def category_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    counts = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("lang")), 4))


@query(
    """WITH p AS (SELECT quality AS truth, CASE WHEN d.n_chars > 500 THEN 1 ELSE 0 END AS pred FROM labels JOIN documents d USING (doc_id)),
c AS (SELECT k AS class, count(*) FILTER (truth = k AND pred = k) AS tp, count(*) FILTER (truth <> k AND pred = k) AS fp,
  count(*) FILTER (truth = k AND pred <> k) AS fn FROM p, (VALUES (0), (1)) v(k) GROUP BY k)
SELECT class, tp, fp, fn, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM c"""
)
def classification_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.operators.metrics import f1_by_class

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = labels.join(docs, "doc_id").select(F.col("quality").alias("truth"), (F.col("n_chars") > 500).cast("int").alias("pred"))
    return f1_by_class(rows, "truth", "pred", [0, 1]).select("class", "tp", "fp", "fn", F.round("f1", 6).alias("f1"))


@query("""WITH p AS (SELECT quality AS truth, CASE WHEN d.n_chars > 500 THEN 1 ELSE 0 END AS pred FROM labels JOIN documents d USING (doc_id)),
c AS (SELECT k, count(*) FILTER (truth = k AND pred = k) AS tp, count(*) FILTER (truth <> k AND pred = k) AS fp, count(*) FILTER (truth = k AND pred <> k) AS fn FROM p, (VALUES (0), (1)) v(k) GROUP BY k),
f AS (SELECT tp + fn AS support, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1 FROM c) SELECT round(avg(f1), 6) AS macro, round(sum(f1 * support) / sum(support), 6) AS weighted FROM f""")
def classification_f1_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.operators.metrics import f1_summary

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = labels.join(docs, "doc_id").select(F.col("quality").alias("truth"), (F.col("n_chars") > 500).cast("int").alias("pred"))
    return f1_summary(rows, "truth", "pred", [0, 1]).select(F.round("macro", 6).alias("macro"), F.round("weighted", 6).alias("weighted"))
