"""Filters, lookups, summaries and report rows: what the phases and the report read from their tables.

Documents stand for postings: their language for a title, their source for a role, labels for scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import stages
from quillspark.operators import characteristics as ch
from quillspark.operators import graphs, sets
from quillspark.operators.text import top
from quillspark.plans.registry import query, table

_SCORED = "sc AS (SELECT doc_id AS vacancy_id, lang || '/' || source AS title, unnest(['quality', 'toxic', 'length']) AS label, unnest([quality * 0.7, toxic * 0.9, least(1.0, n_chars / 4000.0)])::DOUBLE AS confidence FROM documents JOIN labels USING (doc_id))"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vacancy_id, title, scores: a map of three characteristics."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    values = F.create_map(
        F.lit("quality"), F.col("quality") * 0.7, F.lit("toxic"), F.col("toxic") * 0.9, F.lit("length"), F.least(F.lit(1.0), F.col("n_chars") / 4000.0)
    )
    return rows.select(F.col("doc_id").alias("vacancy_id"), F.concat("lang", F.lit("/"), "source").alias("title"), values.alias("scores"))


def _confident(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _scores(spark, sf_dir)
    rows = ch.confident(scores.select("vacancy_id", "scores")).withColumnRenamed("characteristic", "label")
    return rows.join(scores.select("vacancy_id", "title"), "vacancy_id")


@query(f"WITH {_SCORED} SELECT vacancy_id, label, round(confidence, 6) AS confidence FROM sc WHERE confidence >= 0.3")
def confident_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _confident(spark, sf_dir).select("vacancy_id", "label", F.round("confidence", 6).alias("confidence"))


@query("""WITH a AS (SELECT doc_id AS vacancy_id, 'good' AS characteristic, quality * 0.8 AS confidence FROM documents JOIN labels USING (doc_id) WHERE length(trim(text)) > 0 AND quality IS NOT NULL),
b AS (SELECT doc_id AS vacancy_id, 'good' AS characteristic, CASE WHEN n_chars > 1000 THEN 0.6 ELSE 0.2 END AS confidence FROM documents WHERE length(trim(text)) > 0 AND doc_id NOT IN (SELECT vacancy_id FROM a WHERE vacancy_id IS NOT NULL))
SELECT vacancy_id, characteristic, round(confidence, 4) AS confidence FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE confidence >= 0.3""")
def scorer_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels score what they cover, the length of the text what is left."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    named = lambda score: F.create_map(F.lit("good"), score.cast("double")).alias("scores")
    marks = labels.where("quality is not null").select(F.col("doc_id").alias("vacancy_id"), named(F.col("quality") * 0.8))
    texts = docs.select(F.col("doc_id").alias("vacancy_id"), "text", "n_chars")
    by_length = lambda rest: rest.select("vacancy_id", named(F.when(F.col("n_chars") > 1000, 0.6).otherwise(0.2)))
    found = ch.scored_or(texts, lambda rows: rows.select("vacancy_id").join(marks, "vacancy_id"), by_length)
    return found.select("vacancy_id", "characteristic", F.round("confidence", 4).alias("confidence"))


@query(f"WITH {_SCORED} SELECT title, label, round(avg(confidence), 6) AS confidence FROM sc WHERE confidence >= 0.3 GROUP BY title, label")
def title_label_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.title_means(_confident(spark, sf_dir)).select("title", "label", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {_SCORED}, m AS (SELECT title, label, avg(confidence) AS c FROM sc WHERE confidence >= 0.3 GROUP BY title, label),
r AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY round(c, 9) DESC, label) AS rank FROM m QUALIFY rank <= 2)
SELECT title, 'characteristics: ' || string_agg(label, ', ' ORDER BY rank) || '; ' || title AS enriched FROM r GROUP BY title""")
def enriched_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles with their two foremost labels before them."""
    return ch.foremost_labels(_confident(spark, sf_dir)).select("title", ch.enriched(F.col("title"), F.col("labels")).alias("enriched"))


@query(f"""WITH {_SCORED}, m AS (SELECT split_part(title, '/', 1) AS cluster, label, round(avg(confidence), 4) AS c FROM sc WHERE confidence >= 0.3 GROUP BY 1, 2)
SELECT cluster, string_agg(label || '=' || round(c * 1000)::BIGINT, ',' ORDER BY label) AS profile FROM m GROUP BY cluster""")
def cluster_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _confident(spark, sf_dir)
    members = rows.select("title", F.split_part("title", F.lit("/"), F.lit(1)).alias("cluster")).distinct()
    entries = F.transform(F.map_entries("profile"), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] * 1000).cast("long").cast("string")))
    return ch.cluster_profile(rows, members).select("cluster", F.array_join(F.array_sort(entries), ",").alias("profile"))


@query("""SELECT count(*) AS vacancies, count(DISTINCT source) AS roles, count(*) FILTER (quality = 1) AS stem, count(DISTINCT lang || '/' || source) AS skills,
(round(100.0 * count(DISTINCT CASE WHEN quality IS NOT NULL THEN source END) / count(DISTINCT source))::BIGINT)::VARCHAR || '%' AS coverage FROM documents LEFT JOIN labels USING (doc_id)""")
def kpi_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and the coverage of the model, as the report's first row shows them."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    covered = F.count_distinct(F.when(F.col("quality").isNotNull(), F.col("source")))
    share = F.round(F.try_divide(100.0 * covered, F.count_distinct("source"))).cast("long").cast("string")
    return rows.agg(
        F.count("*").alias("vacancies"), F.count_distinct("source").alias("roles"), F.count_if(F.col("quality") == 1).alias("stem"),
        F.count_distinct(F.concat("lang", F.lit("/"), "source")).alias("skills"), F.concat(F.coalesce(share, F.lit("—")), F.lit("%")).alias("coverage"),
    )


@query("""WITH t AS (SELECT count(*) AS n, count(*) FILTER (quality = 1) AS good, count(DISTINCT source) AS roles, count(DISTINCT source || '/' || lang) AS pairs FROM documents LEFT JOIN labels USING (doc_id))
SELECT unnest(['stem_share', 'roles', 'role_skill_pairs']) AS metric, unnest([round(100.0 * good / n)::BIGINT, roles, pairs]) AS value, unnest(['>= 90', '', '']) AS target FROM t""")
def metrics_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    once = rows.agg(
        F.round(100.0 * F.count_if(F.col("quality") == 1) / F.count("*")).cast("long").alias("stem_share"), F.count_distinct("source").alias("roles"),
        F.count_distinct(F.concat("source", F.lit("/"), "lang")).alias("role_skill_pairs"),
    )
    long = once.unpivot([], ["stem_share", "roles", "role_skill_pairs"], "metric", "value")
    return long.withColumn("target", F.when(F.col("metric") == "stem_share", ">= 90").otherwise(""))


@query("SELECT lang AS axis, min(n_chars) AS least, max(n_chars) AS most, round(avg(n_chars), 4) AS mean, count(*) AS n FROM documents GROUP BY lang")
def score_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least, greatest and mean value by axis."""
    rows = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("axis"))
    return rows.agg(F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.round(F.avg("n_chars"), 4).alias("mean"), F.count("*").alias("n"))


@query("SELECT event_type AS source, count(DISTINCT user_id) AS runs, sum(event_id % 50)::BIGINT AS stored, min(ts)::TIMESTAMP AS first_start FROM events GROUP BY 1")
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs and stored records by source."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source"))
    return rows.agg(F.count_distinct("user_id").alias("runs"), F.sum(F.col("event_id") % 50).alias("stored"), F.min("ts").alias("first_start"))


_TABLES = ("documents", "pages", "labels", "conversations", "benchmark")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _TABLES))
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [table(spark, sf_dir, t).agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in _TABLES]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("""SELECT c_custkey, coalesce(s_name, 'none') AS role, coalesce(s.k, -1) AS role_id, coalesce(n.k, 0) AS orders FROM customer
LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS k, arg_min(s_name, s_suppkey) AS s_name FROM supplier GROUP BY 1) s ON c_nationkey = s_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1) n ON o_custkey = c_custkey""")
def role_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups that keep every row: role by nation, the first of its suppliers (-1 where there is none), and attached counts."""
    roles = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.min(F.struct("s_suppkey", "s_name")).alias("s")).select("s_nationkey", "s.*")
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("k"))
    rows = table(spark, sf_dir, "customer").join(roles, F.col("c_nationkey") == F.col("s_nationkey"), "left").join(counts, "c_custkey", "left")
    return rows.select("c_custkey", F.coalesce("s_name", F.lit("none")).alias("role"), F.coalesce("s_suppkey", F.lit(-1)).alias("role_id"), F.coalesce("k", F.lit(0)).alias("orders"))


@query("""SELECT n_name AS role, count(*) AS members, round(avg(o_totalprice), 4) AS experience FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE n_nationkey IN (SELECT s_nationkey FROM supplier) GROUP BY 1 HAVING count(*) > 0""")
def scored_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experience joined to roles, of the roles that have scores (here: suppliers) alone; noise has no role."""
    scored = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"))
    members = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(scored, "n_nationkey", "left_semi")
    rows = table(spark, sf_dir, "orders").join(members, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("n_name").alias("role")).agg(F.count("*").alias("members"), F.round(F.avg("o_totalprice"), 4).alias("experience"))


@query("""WITH w AS (SELECT c_nationkey, string_agg(c_mktsegment || ':' || n, ',' ORDER BY c_mktsegment) AS weights FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) GROUP BY 1)
SELECT n_name AS skill, coalesce(weights, '') AS weights FROM nation LEFT JOIN w ON c_nationkey = n_nationkey""")
def weights_by_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights of each skill (nation) on the axes (segments of its customers) as one map, empty where there are none."""
    counts = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("k")).agg(F.count("*").alias("n"))
    maps = counts.groupBy("n_nationkey").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("m"))
    entries = F.transform(F.map_entries("m"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    rows = table(spark, sf_dir, "nation").join(maps, "n_nationkey", "left")
    return rows.select(F.col("n_name").alias("skill"), F.coalesce(F.array_join(entries, ","), F.lit("")).alias("weights"))


_EXCLUDED, _WANTED = ["ANVIL", "gear"], ["the", "und"]


@query("SELECT p_partkey, p_name FROM part WHERE NOT (contains(lower(p_name), 'anvil') OR contains(lower(p_name), 'gear'))")
def title_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(~ch.contains_any(F.col("p_name"), _EXCLUDED, False)).select("p_partkey", "p_name")


@query("SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'the') OR contains(lower(text), 'und')")
def keyword_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where(ch.contains_any(F.col("text"), _WANTED, True)).select("conv_id", "turn")


@query("""WITH p AS (SELECT p_partkey, ['Опыт работы', 'python', 'НАВЫКИ', 'спектроскопия', 'год', 'анализ данных'][1 + p_partkey % 6] AS text, ['опыт работы', 'python', 'навык', 'спектроскопия', 'годы', 'стаж'][1 + p_size % 6] AS lemma FROM part)
SELECT p_partkey, text, lemma FROM p WHERE lower(text) NOT IN ('опыт работы', 'навыки', 'год') AND lemma NOT IN ('опыт работы', 'навык', 'стаж')""")
def boilerplate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda words, key: F.element_at(F.array(*[F.lit(w) for w in words]), (F.col(key) % 6 + 1).cast("int"))
    texts, lemmas = ("Опыт работы", "python", "НАВЫКИ", "спектроскопия", "год", "анализ данных"), ("опыт работы", "python", "навык", "спектроскопия", "годы", "стаж")
    rows = table(spark, sf_dir, "part").select("p_partkey", pick(texts, "p_partkey").alias("text"), pick(lemmas, "p_size").alias("lemma"))
    return ch.without_boilerplate(rows, "text", "lemma")


@query("""WITH s AS (SELECT conv_id AS vacancy_id, turn AS pos, text AS sentence, CASE turn % 4 WHEN 0 THEN 'requirements' WHEN 1 THEN 'benefits' WHEN 2 THEN 'responsibilities' END AS label FROM conversations)
SELECT vacancy_id, md5(string_agg(sentence, ' ' ORDER BY pos)) AS text_md5 FROM s WHERE label IS NULL OR label <> 'benefits' GROUP BY vacancy_id""")
def section_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as sentences, labelled by their place; one in four has no label."""
    turn = F.col("turn") % 4
    label = F.when(turn == 0, "requirements").when(turn == 1, "benefits").when(turn == 2, "responsibilities")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("vacancy_id"), F.col("turn").alias("pos"), F.col("text").alias("sentence"), label.alias("label"))
    return ch.kept_sections(rows).select("vacancy_id", F.md5("text").alias("text_md5"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), c AS (SELECT vec_id AS canonical, embedding::DOUBLE[] AS v FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 5),
s AS (SELECT e.vec_id AS phrase, canonical, round(list_dot_product(e.v, c.v), 9) AS similarity FROM e, c)
SELECT phrase, canonical, round(similarity, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY similarity DESC, canonical) = 1""")
def canonical_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector to the nearest of those that stand for canonical phrases, the first five of each label."""
    rows = table(spark, sf_dir, "embeddings")
    chosen = top(rows, ["label"], [F.asc("vec_id")], 5).select(F.col("vec_id").alias("canonical"), "embedding")
    found = ch.canonical(rows.select(F.col("vec_id").alias("phrase"), "embedding"), chosen)
    return found.select("phrase", "canonical", F.round("similarity", 6).alias("similarity"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(string_split(p_name, ' '), string_split(lower(p_type), ' ')))), ',') AS phrases FROM part")
def phrase_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted phrases together with explicit ones, each once."""
    both = F.array_union(F.split("p_name", " "), F.split(F.lower("p_type"), " "))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(both), ",").alias("phrases"))


@query("""WITH s AS (SELECT p_partkey, string_split(p_name, ' ') AS a, string_split(lower(p_type), ' ') AS b FROM part)
SELECT p_partkey, CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1.0 ELSE round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) END AS jaccard FROM s""")
def set_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of two sets in a row; two empty sets are equal."""
    return table(spark, sf_dir, "part").select("p_partkey", F.round(sets.overlap(F.split("p_name", " "), F.split(F.lower("p_type"), " ")), 6).alias("jaccard"))


@query("SELECT DISTINCT p_type AS title, dense_rank() OVER (ORDER BY p_type) AS pos FROM part")
def sorted_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct titles and their places in order, from sorted parts."""
    titles, seen = stages.counted(table(spark, sf_dir, "part").select(F.col("p_type").alias("title")).distinct(), "titles")
    return graphs.ranked(titles, seen["n"], ["title"]).select("title", (F.col("r") + 1).alias("pos"))


@query("SELECT p_brand AS skill, count(*) AS cnt FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY cnt DESC, skill LIMIT 15")
def global_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 skills of the greatest count of all."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("p_brand").alias("skill")).agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), F.asc("skill")).limit(15)


@query("""WITH k AS (SELECT c_mktsegment AS s, p_brand || '/' || p_size AS skill, count(*) AS cnt FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
g AS (SELECT s, row_number() OVER (ORDER BY s) AS pos FROM (SELECT DISTINCT s FROM k)), d AS (SELECT x.skill, x.s AS a, h.s AS b, g.pos AS pa, h.pos AS pb, round(x.cnt / (1.0 + coalesce(y.cnt, 0)), 4) AS score FROM k x JOIN g ON g.s = x.s JOIN g h ON h.s <> x.s LEFT JOIN k y ON y.s = h.s AND y.skill = x.skill)
SELECT skill, score, a AS origin FROM d QUALIFY row_number() OVER (PARTITION BY skill ORDER BY score DESC, pa, pb) = 1""")
def best_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each skill's best differentiating score over all ordered pairs of specialties; of equal ones the first pair's."""
    t = lambda name: table(spark, sf_dir, name)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    counts = rows.groupBy(F.col("c_mktsegment").alias("s"), F.concat_ws("/", "p_brand", "p_size").alias("skill")).agg(F.count("*").alias("cnt"))
    scored = sets.differences(counts, "s", "skill", "cnt")
    best = top(scored, ["skill"], [F.desc("score"), F.asc("a"), F.asc("b")], 1)
    return best.select("skill", "score", F.col("a").alias("origin"))


@query(r"""SELECT event_id, (props ->> '$.k')::BIGINT AS k, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%d') END AS published,
CASE event_id % 5 WHEN 0 THEN 'Нет опыта' WHEN 1 THEN 'От 1 года до 3 лет' WHEN 2 THEN 'От 3 до 6 лет' WHEN 3 THEN 'Более 6 лет' END AS experience, event_id % 7 AS n_roles FROM events""")
def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw JSON records decoded: dates written two ways, experience codes by their labels, roles with an id and a name."""
    from quillspark.sources import mappers

    e = table(spark, sf_dir, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    code = F.element_at(F.array(*[F.lit(x) for x in ("noExperience", "between1And3", "between3And6", "moreThan6", "other")]), (F.col("event_id") % 5 + 1).cast("int"))
    date = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(day.alias("$date")))).otherwise(day)
    roles = F.transform(F.sequence(F.lit(0), (F.col("event_id") % 7).cast("int")), lambda i: F.struct(F.when(i > 0, i.cast("string")).otherwise("x").alias("id"), F.concat(F.lit("r"), i.cast("string")).alias("name")))
    raw = e.select("event_id", F.to_json(F.struct(F.get_json_object("props", "$.k").alias("k"), date.alias("published_at"), code.alias("experience"), roles.alias("roles"))).alias("data"))
    return raw.select(
        "event_id", F.get_json_object("data", "$.k").cast("bigint").alias("k"), mappers.publication_day(F.get_json_object("data", "$.published_at")).alias("published"),
        mappers.experience_label(F.get_json_object("data", "$.experience")).alias("experience"),
        F.size(mappers.valid_roles(F.get_json_object("data", "$.roles"))).cast("long").alias("n_roles"),
    )
