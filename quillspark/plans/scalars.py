"""Scalar functions at work on the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.plans.registry import query, table


@query(r"SELECT page_id, md5(coalesce(nullif(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[\s\x{A0}]+', ' ', 'g')), ''), '')) AS text_md5 FROM pages")
def clean_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(F.coalesce(tx.clean_html(F.col("html")), F.lit(""))).alias("text_md5"))


_SAID = (
    "Опыт работы от # лет", "требуемый опыт #-9 лет", "стаж работы: # года", "Опыт: от # лет в лаборатории", "от 1-# года, нужен опыт", "без требований",
    "Нет опыта", "#-7 years", "от # до 8 лет", "#.5 yrs", "entry level, # years", "Кандидат наук, магистратура", "Неполное высшее", "высшее образование",
    "среднее специальное", "PhD or M.Sc. in physics", "Bachelor's degree", "high school diploma", "АСПИРАНТ", "доктор  наук",
)
_SAID_SQL = "t AS (SELECT o_orderkey, replace([" + ", ".join("'" + x.replace("'", "''") + "'" for x in _SAID) + f"][1 + o_orderkey % {len(_SAID)}], '#', (o_custkey % 12)::VARCHAR) AS s FROM orders)"


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a phrase about experience or education each, a number in it."""
    phrases = F.array(*[F.lit(x) for x in _SAID])
    phrase = F.element_at(phrases, (F.col("o_orderkey") % len(_SAID) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.replace(phrase, F.lit("#"), (F.col("o_custkey") % 12).cast("string")).alias("s"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_YEARS_SQL = ", ".join(
    f"CASE WHEN regexp_matches(regexp_extract(lower(s), {_quoted(p)}, 2), '^[0-9]+$') THEN (regexp_extract(lower(s), {_quoted(p)}, 1)::DOUBLE + TRY_CAST(regexp_extract(lower(s), {_quoted(p)}, 2) AS DOUBLE)) / 2 "
    f"ELSE TRY_CAST(regexp_extract(lower(s), {_quoted(p)}, 1) AS DOUBLE) END"
    for p in tx.EXPERIENCE
)


@query(f"WITH {_SAID_SQL} SELECT o_orderkey, coalesce({_YEARS_SQL}) AS years FROM t")
def experience_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir).select("o_orderkey", tx.experience_years(F.col("s")).alias("years"))


_NONE_SQL = " OR ".join(f"contains(lower(trim(s)), {_quoted(x)})" for x in tx.NO_EXPERIENCE)
_RANGE = tx.YEARS.replace("(?iu)", "(?i)")


@query(f"""WITH {_SAID_SQL} SELECT o_orderkey, CASE WHEN {_NONE_SQL} THEN 0 ELSE TRY_CAST(regexp_extract(s, {_quoted(_RANGE)}, 1) AS DOUBLE) END AS low,
CASE WHEN {_NONE_SQL} THEN 0 ELSE TRY_CAST(regexp_extract(s, {_quoted(_RANGE)}, 2) AS DOUBLE) END AS high FROM t""")
def experience_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least and most years that a phrase asks for."""
    found = _said(spark, sf_dir).select("o_orderkey", tx.experience_range(F.col("s")).alias("r"))
    return found.select("o_orderkey", F.col("r.min").alias("low"), F.col("r.max").alias("high"))


_DATED = ("{%Y-%m-%d}", "{%d.%m.%Y}", "{%-d.%-m.%Y} 10:30", " {%d.%m.%Y}, вторник", "{month}", "{month} года", "{Month}", "вчера", "{%Y-%m-%dT00:00:00}")


@query(f"""WITH t AS (SELECT o_orderkey, o_orderdate AS d, o_orderkey % {len(_DATED)} AS k FROM orders)
SELECT o_orderkey, CASE WHEN k = 7 THEN 'вчера' WHEN k = 8 THEN strftime(d, '%Y-%m-%d') || 'T00:00:00' ELSE strftime(d, '%Y-%m-%d') END AS iso FROM t""")
def iso_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written in several ways, with one digit, a time or words after them, come back as ISO; other text stays."""
    d = F.col("o_orderdate")
    name = F.element_at(F.array(*[F.lit(m) for m in tx.MONTHS]), F.month(d))
    worded = lambda m: F.concat_ws(" ", F.date_format(d, "d"), m, F.date_format(d, "yyyy"))
    forms = {
        "{%Y-%m-%d}": F.date_format(d, "yyyy-MM-dd"), "{%d.%m.%Y}": F.date_format(d, "dd.MM.yyyy"), "{%-d.%-m.%Y} 10:30": F.concat(F.date_format(d, "d.M.yyyy"), F.lit(" 10:30")),
        " {%d.%m.%Y}, вторник": F.concat(F.lit(" "), F.date_format(d, "dd.MM.yyyy"), F.lit(", вторник")), "{month}": worded(name),
        "{month} года": F.concat(worded(name), F.lit(" года")), "{Month}": worded(F.upper(name)), "вчера": F.lit(" вчера "), "{%Y-%m-%dT00:00:00}": F.date_format(d, "yyyy-MM-dd'T'00:00:00"),
    }
    written = F.element_at(F.array(*[forms[f] for f in _DATED]), (F.col("o_orderkey") % len(_DATED) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.iso_date(written).alias("iso"))


_PAID = (
    "$#,000 - $#,500", "EUR #K", "до # 000 руб.", "от # 000 руб.", "#000", "# per hour", "$# - $999 per hour", "от # до 9 000 руб.", "£#,250.50", "по договору",
    "USD # to 999.5", "# — 999K €", "зарплата # 000 рублей", "$#/hr", "#.5/hour", "", "# 000 руб. (# тыс.)",
)
_SIGN_SQL, _AMOUNT_SQL = r"(?:\$|USD\s*|€|EUR\s*|£|GBP\s*)", r"([0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]+)?\s*[Kk]?)"
_SPREAD_SQL = f"{_SIGN_SQL}?\\s*{_AMOUNT_SQL}\\s*(?:-|–|to|—)\\s*{_SIGN_SQL}?\\s*{_AMOUNT_SQL}"


def _amount_sql(raw: str) -> str:
    bare = f"trim(replace({raw}, ',', ''))"
    return f"round_even(TRY_CAST(trim(rtrim(upper({bare}), 'K')) AS DOUBLE) * CASE WHEN upper({bare}) LIKE '%K' THEN 1000 ELSE 1 END, 0)::INTEGER"


def _english_sql(i: int) -> str:
    return f"""CASE WHEN regexp_matches(s, '{_SPREAD_SQL}') THEN {_amount_sql(f"regexp_extract(s, '{_SPREAD_SQL}', {i})")}
WHEN regexp_matches(s, '{_SIGN_SQL}\\s*{_AMOUNT_SQL}') THEN {_amount_sql(f"regexp_extract(s, '{_SIGN_SQL}" + chr(92) + f"s*{_AMOUNT_SQL}', 1)")}
WHEN contains(l, 'per hour') OR contains(l, '/hr') OR contains(l, '/hour') THEN 2080 * {_amount_sql("regexp_extract(s, '[0-9]{1,4}(?:,[0-9]{3})*(?:" + chr(92) + ".[0-9]+)?')")} END"""


@query(f"""WITH t AS (SELECT o_orderkey, trim(replace([{", ".join(f"'{x}'" for x in _PAID)}][1 + o_orderkey % {len(_PAID)}], '#', (o_custkey % 900 + 100)::VARCHAR)) AS s FROM orders),
u AS (SELECT *, lower(s) AS l, list_transform(regexp_extract_all(s, '[0-9][0-9 ]*[0-9]|[0-9]+'), lambda x: replace(x, ' ', '')::INTEGER) AS n FROM t),
r AS (SELECT o_orderkey, contains(l, 'руб') OR contains(l, 'от') OR contains(l, 'до') AS ru, s, l, n, CASE WHEN contains(l, 'руб') THEN 'RUR' WHEN contains(l, '$') OR contains(l, 'usd') THEN 'USD' WHEN contains(l, '€') OR contains(l, 'eur') THEN 'EUR'
  WHEN contains(l, '£') OR contains(l, 'gbp') THEN 'GBP' END AS currency FROM u)
SELECT o_orderkey, coalesce(CASE WHEN ru THEN CASE WHEN len(n) > 1 OR contains(l, 'от') OR NOT contains(l, 'до') THEN list_min(n) END ELSE {_english_sql(1)} END, -1)::INTEGER AS low,
coalesce(CASE WHEN ru THEN CASE WHEN len(n) > 1 OR (contains(l, 'до') AND NOT contains(l, 'от')) THEN list_max(n) END ELSE {_english_sql(2)} END, -1)::INTEGER AS high, currency FROM r""")
def salary_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts about pay in both languages: ranges, single amounts, thousands, hourly rates, amounts without a currency."""
    said = F.element_at(F.array(*[F.lit(x) for x in _PAID]), (F.col("o_orderkey") % len(_PAID) + 1).cast("int"))
    s = F.replace(said, F.lit("#"), (F.col("o_custkey") % 900 + 100).cast("string"))
    found = table(spark, sf_dir, "orders").select("o_orderkey", tx.salary(s).alias("s"))
    return found.select("o_orderkey", F.coalesce("s.from", F.lit(-1)).alias("low"), F.coalesce("s.to", F.lit(-1)).alias("high"), "s.currency")


@query(r"""SELECT doc_id, CASE WHEN length(trim(text)) > 100 AND regexp_extract(trim(text)[1:100], '(?s)^(.*) ', 1) <> '' THEN regexp_extract(trim(text)[1:100], '(?s)^(.*) ', 1) ELSE nullif(trim(text)[1:100], '') END AS title FROM documents""")
def title_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.title_or_start(F.lit(None).cast("string"), F.col("text")).alias("title"))


@query(r"""SELECT event_id, (props ->> '$.k')::BIGINT AS k, props = to_json({'k': (props ->> '$.k')::BIGINT}) AS same FROM (SELECT event_id, replace(props, ' ', '') AS props FROM events)""")
def json_extract_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), (F.to_json(F.struct(k.alias("k"))) == F.replace("props", F.lit(" "), F.lit(""))).alias("same"))


@query("SELECT (props ->> '$.k')::BIGINT AS k, count(*) AS n FROM events WHERE props ->> '$.k' IS NOT NULL GROUP BY 1")
def json_group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint").alias("k")
    return table(spark, sf_dir, "events").select(k).where("k is not null").groupBy("k").agg(F.count("*").alias("n"))


@query(r"""SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, nullif(regexp_extract(url, '/(\d+)(?:[/?#.]|$)', 1), '') AS number FROM pages""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), tx.url_id(F.col("url")).alias("number"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS key FROM documents")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.cache_key(F.col("text")).alias("key"))


@query(r"""SELECT p_partkey, CASE WHEN p_size % 10 = 1 AND p_size % 100 <> 11 THEN 'год' WHEN p_size % 10 BETWEEN 2 AND 4 AND NOT p_size % 100 BETWEEN 12 AND 14 THEN 'года' ELSE 'лет' END AS word FROM part""")
def years_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", tx.years_word(F.col("p_size")).alias("word"))


_LEVEL_SQL = " ".join(f"WHEN regexp_matches(s, {_quoted(p)}) THEN '{name}'" for p, name in tx.EDUCATION)


@query(f"WITH {_SAID_SQL} SELECT o_orderkey, CASE {_LEVEL_SQL} END AS level FROM t")
def education_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir).select("o_orderkey", tx.education_level(F.col("s")).alias("level"))
