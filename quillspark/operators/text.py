"""Term statistics over (document, term) pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Distinct runs of lower-case letters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}]+)"), 1))


def pairs(docs: DataFrame, doc: str, text: str, term: str = "term", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document and distinct term."""
    return docs.select(doc, *keep, F.explode(tokens(F.col(text))).alias(term))


def document_frequency(rows: DataFrame, term: str) -> DataFrame:
    return rows.groupBy(term).agg(F.count("*").alias("df"))


def frequent(rows: DataFrame, term: str, least: int) -> DataFrame:
    """The pairs whose term is in `least` documents or more, with df, the number of those."""
    return rows.join(document_frequency(rows, term).where(F.col("df") >= least), term)


def tfidf(rows: DataFrame, doc: str) -> DataFrame:
    """Pairs with their df get weight = ln(1 + documents / df) / terms of the document.

    All counts are of the pairs given, so after any cap or filter applied to them; df must be of these documents. The pairs
    of a document are gathered once: their number is its number of terms, and the number of such rows that of documents,
    for which Spark reads the same shuffle again.
    """
    rest = [c for c in rows.columns if c != doc]
    held = rows.groupBy(doc).agg(F.collect_list(F.struct(*rest)).alias("__pairs"))
    total = held.agg(F.count_if(F.size("__pairs") > 0).alias("__docs"))
    every = held.crossJoin(F.broadcast(total)).select(doc, "__docs", F.size("__pairs").alias("__n"), F.inline("__pairs"))  # one row
    weight = F.log(1 + F.col("__docs") / F.col("df")) / F.col("__n")
    return every.withColumn("weight", weight).drop("__docs", "__n", "df")


def top(rows: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group in a total order."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n)
