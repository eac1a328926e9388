"""Collecting, merging, updating and verifying raw records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import store
from quillspark.plans.registry import query, table
from quillspark.sources import archive, reports


@query("""WITH a AS (SELECT doc_id AS id, 'first' AS run, n_chars FROM documents WHERE source < 'src5'), b AS (SELECT doc_id AS id, 'second' AS run, n_chars + 1 AS n_chars FROM documents WHERE source >= 'src3')
SELECT * FROM a UNION ALL SELECT * FROM b WHERE id NOT IN (SELECT id FROM a)""")
def insert_or_ignore_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    a = docs.where("source < 'src5'").select(F.col("doc_id").alias("id"), F.lit("first").alias("run"), "n_chars")
    b = docs.where("source >= 'src3'").select(F.col("doc_id").alias("id"), F.lit("second").alias("run"), (F.col("n_chars") + 1).alias("n_chars"))
    return store.insert_or_ignore(a, b, "id", [F.asc("run"), F.asc("n_chars")])


@query("""SELECT c_custkey, coalesce(CASE WHEN s.s_suppkey IS NOT NULL THEN s.s_name END, c_name) AS c_name, c_acctbal FROM customer LEFT JOIN supplier s ON s_suppkey = c_custkey""")
def backfill_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return store.updated(rows, changes, "c_custkey", ["c_name"])


@query("""SELECT user_id AS run_id, arg_max(event_type, event_id) AS state, max(event_id) AS at FROM events GROUP BY 1""")
def run_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("state"), F.col("event_id").alias("at"))
    return store.ledger_state(events, "run_id", "at")


@query("""SELECT unnest(['text', 'lang', 'source', 'n_chars']) AS field, unnest([count(nullif(text, '')), count(nullif(lang, '')), count(nullif(source, '')), count(n_chars)]) AS present,
unnest([count(*) - count(nullif(text, '')), count(*) - count(nullif(lang, '')), count(*) - count(nullif(source, '')), count(*) - count(n_chars)]) AS absent,
unnest([round(100.0 * count(nullif(text, '')) / count(*), 2), round(100.0 * count(nullif(lang, '')) / count(*), 2), round(100.0 * count(nullif(source, '')) / count(*), 2), round(100.0 * count(n_chars) / count(*), 2)]) AS percent FROM documents""")
def field_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.field_presence(table(spark, sf_dir, "documents"), ["text", "lang", "source", "n_chars"])


@query("SELECT text_md5, n, n - 1 AS surplus FROM (SELECT md5(text) AS text_md5, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1)")
def duplicate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.duplicates(table(spark, sf_dir, "documents").select(F.md5("text").alias("text_md5")), ["text_md5"])


@query("""WITH e AS (SELECT page_id, CASE WHEN length(html) < 2000 THEN 'short;' ELSE '' END || CASE WHEN url NOT LIKE 'https://%' THEN 'scheme;' ELSE '' END || CASE WHEN NOT contains(html, '</html>') THEN 'cut;' ELSE '' END AS errors FROM pages)
SELECT errors, count(*) AS n FROM e GROUP BY errors""")
def verify_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pages fail which checks."""
    checks = {"short": F.length("html") >= 2000, "scheme": F.col("url").like("https://%"), "cut": F.contains("html", F.lit("</html>"))}
    found = table(spark, sf_dir, "pages").select(F.concat_ws("", F.transform(store.errors(checks), lambda x: F.concat(x, F.lit(";")))).alias("errors"))
    return found.groupBy("errors").agg(F.count("*").alias("n"))


@query(r"""WITH p AS (SELECT regexp_extract(url, '^https?://(?:[a-z]+\.)?([^/?#]+)', 1) AS host, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '') AS address FROM pages)
SELECT host, count(*) AS captures, count(DISTINCT address) AS urls FROM p GROUP BY ROLLUP (host)""")
def census_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures and distinct addresses by host, with the total."""
    address = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "/$", "")
    rows = table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^https?://(?:[a-z]+\.)?([^/?#]+)", 1).alias("host"), address.alias("address"))
    return rows.rollup("host").agg(F.count("*").alias("captures"), F.count_distinct("address").alias("urls"))


@query("""SELECT date_trunc('week', ts)::TIMESTAMP AS week, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2""")
def weekly_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(F.date_trunc("week", "ts").alias("week"), "event_type")
    return rows.agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("""SELECT d.source AS role, d.doc_id, d.lang FROM documents d JOIN labels l USING (doc_id) QUALIFY row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) = 1""")
def first_vacancy_per_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.operators.text import top

    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return top(rows, ["source"], [F.asc("doc_id")], 1).select(F.col("source").alias("role"), "doc_id", "lang")


@query(r"""WITH m AS (SELECT conv_id, turn, text FROM conversations) SELECT conv_id, turn, regexp_extract(text, '^([^\n]*)', 1) AS title, len(string_split(text, chr(10))) AS n_lines,
len(regexp_extract_all(text, '#[\p{L}\d_]+')) AS n_tags FROM m""")
def message_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select(
        "conv_id", "turn", F.regexp_extract("text", r"^([^\n]*)", 1).alias("title"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
        F.size(F.regexp_extract_all("text", F.lit(r"(#[\p{L}\d_]+)"), 1)).cast("long").alias("n_tags"),
    )


_CAPTURES = """c AS (SELECT strftime(ts, '%Y%m%d%H%M%S') AS timestamp, CASE event_id % 3 WHEN 0 THEN 'http://www.' ELSE 'https://' END || 'Jobs.org/' || event_type || '/' || user_id || CASE event_id % 4 WHEN 0 THEN '?q=1' WHEN 1 THEN '/' ELSE '' END AS original,
CASE WHEN event_id % 10 = 9 THEN 'image/png' ELSE 'text/html' END AS mimetype, CASE WHEN event_id % 11 = 0 THEN '404' ELSE '200' END AS statuscode FROM events),
k AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(original), '^https?://(?:www\\.)?', ''), '[?#].*$', ''), '/$', '') AS key FROM c)"""


def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as captures of an archive's index."""
    i = F.col("event_id")
    scheme = F.when(i % 3 == 0, "http://www.").otherwise("https://")
    tail = F.when(i % 4 == 0, "?q=1").when(i % 4 == 1, "/").otherwise("")
    return table(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyyMMddHHmmss").alias("timestamp"), F.concat(scheme, F.lit("Jobs.org/"), "event_type", F.lit("/"), F.col("user_id").cast("string"), tail).alias("original"),
        F.when(i % 10 == 9, "image/png").otherwise("text/html").alias("mimetype"), F.when(i % 11 == 0, "404").otherwise("200").alias("statuscode"),
    )


@query(f"""WITH {_CAPTURES} SELECT timestamp, original, mimetype, statuscode FROM k WHERE starts_with(key, 'jobs.org/view/') AND timestamp >= '20240105' AND timestamp[1:8] <= '20240120' AND statuscode = '200'
QUALIFY row_number() OVER (PARTITION BY key ORDER BY timestamp, original) = 1""")
def index_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest good capture of each address under a pattern in a time range."""
    return archive.index_query(_captures(spark, sf_dir), "jobs.org/view/*", "20240105", "20240120", collapse=True)


@query(f"""WITH {_CAPTURES}, w AS (SELECT *, make_date(2024, 1, 1) + ((strptime(timestamp[1:8], '%Y%m%d')::DATE - make_date(2024, 1, 1)) // 7 * 7)::INTEGER AS win FROM k WHERE starts_with(key, 'jobs.org/') AND statuscode = '200' AND mimetype = 'text/html' AND timestamp[1:4] = '2024'),
f AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY key, win ORDER BY timestamp, original) = 1)
SELECT strftime(win, '%Y-%m-%d') AS first_day, timestamp, original FROM f QUALIFY row_number() OVER (PARTITION BY original ORDER BY timestamp) = 1""")
def weekly_archive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A year in windows of seven days, each address once."""
    found = archive.yearly(_captures(spark, sf_dir), "jobs.org/*", 2024)
    return found.select(F.date_format("window", "yyyy-MM-dd").alias("first_day"), "timestamp", "original")


@query("""SELECT source, year, CASE WHEN year BETWEEN 2013 AND 2016 THEN 'linkedin.com/jobs2/view/*' WHEN year BETWEEN 2019 AND 2026 THEN 'linkedin.com/jobs/view/*' ELSE 'none' END AS pattern, count(*) AS n
FROM (SELECT event_type AS source, 2013 + (user_id % 14)::INTEGER AS year FROM events) GROUP BY 1, 2, 3""")
def era_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures by source and year with the pattern of the year's era."""
    pattern = F
    for first, last, address in archive.ERAS:
        pattern = pattern.when(F.col("year").between(first, last), address)
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), (F.col("user_id") % 14 + 2013).cast("int").alias("year"))
    return rows.groupBy("source", "year", pattern.otherwise("none").alias("pattern")).agg(F.count("*").alias("n"))


@query(f"""WITH {_CAPTURES}, s AS (SELECT split_part(key, '/', 2) AS source, 'jobs.org/' || split_part(key, '/', 2) || '/*' AS pattern, timestamp[1:4]::INTEGER AS year, key FROM k)
SELECT source, pattern, year, count(*) AS captures, count(DISTINCT key) AS urls FROM s GROUP BY 1, 2, 3""")
def census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures and distinct addresses by source, pattern and year."""
    return reports.census(_sourced(spark, sf_dir))


def _sourced(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.split_part(archive.address_key(F.col("original")), F.lit("/"), F.lit(2))
    rows = _captures(spark, sf_dir).withColumn("source", source)
    return rows.withColumn("pattern", F.concat(F.lit("jobs.org/"), "source", F.lit("/*")))


@query(f"""WITH {_CAPTURES}, s AS (SELECT split_part(key, '/', 2) AS source, 'jobs.org/' || split_part(key, '/', 2) || '/*' AS pattern, timestamp[1:4]::INTEGER AS year, key FROM k),
n AS (SELECT source, pattern, year, count(*) AS c, count(DISTINCT key) AS u FROM s GROUP BY 1, 2, 3)
SELECT source, year, rpad(source, 24, ' ') || ' ' || rpad(pattern, 36, ' ') || ' ' || lpad(year::VARCHAR, 6, ' ') || '  ' || lpad(format('{{:,}}', c), 10, ' ') || ' ' || lpad(format('{{:,}}', u), 8, ' ') AS line FROM n""")
def census_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The census as lines of a fixed-width table."""
    return reports.census_lines(reports.census(_sourced(spark, sf_dir)))


@query("""WITH a AS (SELECT doc_id FROM documents WHERE source < 'src5'), b AS (SELECT DISTINCT doc_id FROM documents WHERE source >= 'src3') SELECT count(*) AS n FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)""")
def merge_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows a merge brings in."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return store.merged(docs.where("source < 'src5'"), docs.where("source >= 'src3'"), "doc_id", [F.asc("source")])[1]


@query("""SELECT c_custkey, CASE WHEN s_suppkey IS NULL THEN c_name ELSE s_name END AS description, c_acctbal FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""")
def json_field_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One field of a JSON column rewritten where there is a new value, the others kept."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.to_json(F.struct(F.col("c_name").alias("description"), F.col("c_acctbal").cast("double").alias("balance"))).alias("data"))
    changes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("description"))
    out = store.updated_fields(rows, changes, "c_custkey", "data", "description string, balance double", ["description"])
    return out.select("c_custkey", F.get_json_object("data", "$.description").alias("description"), F.get_json_object("data", "$.balance").cast("double").alias("c_acctbal"))
