"""A crawl with the table of pages as the site: each host is a keyword, its pages are listed a few to a search page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import stages
from quillspark.plans.registry import query, table
from quillspark.sources import crawl

#: Postings of a search page, about.
LISTED = 20


@query(f"""WITH u AS (SELECT url, min(page_id) AS page_id, arg_min(length(html), page_id) AS n FROM pages GROUP BY url),
h AS (SELECT *, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM u), c AS (SELECT host, ceil(count(*) / {LISTED}.0)::BIGINT AS p FROM h GROUP BY host),
l AS (SELECT url, host, page_id % p AS page, n FROM h JOIN c USING (host)),
e AS (SELECT host, min(k) AS gap FROM (SELECT host, unnest(range(p + 1)) AS k FROM c) x WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.host = x.host AND l.page = x.k) GROUP BY host)
SELECT url AS address, host, page, n::BIGINT AS n_chars, page + 1 AS generation FROM l JOIN e USING (host) WHERE page < gap""")
def site_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages that searches by host lead to, page after page until one is empty: each address once, its generation
    that of its search page and one."""
    pages = table(spark, sf_dir, "pages").groupBy("url").agg(F.min("page_id").alias("page_id"), F.min_by(F.length("html"), "page_id").cast("long").alias("n_chars"))
    named = pages.withColumn("host", F.regexp_extract("url", r"^https?://([^/?#]+)", 1))
    counts = named.groupBy("host").agg(F.ceil(F.count("*") / LISTED).alias("p"))
    site = stages.written(named.join(counts, "host").select("url", "host", "n_chars", (F.col("page_id") % F.col("p")).alias("page")), "site")
    listing = stages.written(site.groupBy("host", "page").agg(F.collect_list("url").alias("listed")), "listing")  # about LISTED each

    def answered(frontier: DataFrame) -> DataFrame:
        return frontier.join(listing, ["host", "page"], "left")

    searched = crawl.runs(counts, "host", answered)
    details = searched.select(F.explode("listed").alias("address"), "host", "page")
    first = details.groupBy("address").agg(F.min(F.struct("page", "host")).alias("r")).select("address", "r.host", "r.page")
    found = first.join(site.select(F.col("url").alias("address"), "n_chars"), "address")
    return found.select("address", "host", "page", "n_chars", (F.col("page") + 1).alias("generation"))
