"""Collection by source: yearly archive scans and bulk tables, brought to canonical records that are ready to store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import html
from quillspark.sources import archive, mappers, readers

# The board's address pattern, and what stands in the addresses of its old pages.
BOARD, OLD_BOARD = "hh.ru/vacancy/*", ".do"


def captures_of(captures: DataFrame, source: str, year: int) -> DataFrame:
    """timestamp, original, layout of a source's captures in a year: the board's by weekly windows, the network's by era."""
    if source == "wayback-hhru":
        found = archive.yearly(captures, BOARD, year)
        layout = F.when(F.contains("original", F.lit(OLD_BOARD)), "board-legacy").otherwise("board-modern")
    elif source == "wayback-linkedin":
        found, old = archive.by_era(captures, year), "jobs2" in (archive.era_pattern(year) or "")
        layout = F.lit("network-legacy" if old else "network-modern")
    else:
        raise ValueError(f"no archive source {source}")
    return found.select("timestamp", "original", layout.alias("layout"))


def raw_records(pages: DataFrame) -> DataFrame:
    """timestamp, raw (JSON) of pages (timestamp, original, html, layout) that have a title."""
    out = None
    for layout in html.LAYOUTS:
        parsed = html.parsed_pages(pages.where(F.col("layout") == layout), layout)
        p = F.col("parsed")
        record = F.struct(
            p["name"].alias("name"), p["description"].alias("description"), F.struct(p["employer"].alias("name")).alias("employer"), F.struct(p["area"].alias("name")).alias("area"),
            html.posting_salary(p).alias("salary"), p["date_text"].alias("published_at"), p["skills"].alias("key_skills"), F.struct(p["experience"].alias("name")).alias("experience"),
            p["industry"].alias("industry"), F.col("original").alias("source_url"),
        )
        rows = parsed.where(p["name"].isNotNull()).select("timestamp", F.to_json(record).alias("raw"))
        out = rows if out is None else out.unionByName(rows)
    return out


def archived(captures: DataFrame, source: str, year: int, fetch: archive.Fetch, **options) -> tuple[DataFrame, DataFrame]:
    """The fetched captures of a year (with error), and id, capture_ts, data of the valid records of their pages: canonical,
    with year, experience and education."""
    wanted = captures_of(captures, source, year)
    found = archive.recovered(wanted, fetch, **options)
    pages = found.where("html is not null").join(wanted.dropDuplicates(["timestamp", "original"]), ["timestamp", "original"])
    raw = raw_records(pages).withColumnRenamed("timestamp", "capture_ts")
    return found, records(raw, source)


def records(raw: DataFrame, source: str) -> DataFrame:
    """id, capture_ts, data (JSON) of raw records (raw, capture_ts): mapped, enriched, and valid."""
    valid, _ = mappers.validated(mappers.enriched(mappers.mapped(raw, source)))
    return valid.select("id", F.col("_capture_ts").alias("capture_ts"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("data"))


def bulk(spark: SparkSession, folder: str, capture_ts: str) -> DataFrame:
    """The same of a folder of CSV tables; NaN and empty fields are null."""
    rows = readers.csv_folder(spark, folder)
    plain = [F.when(~F.lower(F.trim(F.col(f"`{c}`"))).isin("", "nan", "none"), F.col(f"`{c}`")).alias(c) for c in rows.columns]
    raw = rows.select(F.to_json(F.struct(*plain)).alias("raw")).withColumn("capture_ts", F.lit(capture_ts))
    return records(raw, "rostud")


def channel(messages: DataFrame, capture_ts: str) -> DataFrame:
    """The same of channel messages (channel, id, date, text): parsed, mapped, enriched and valid in one chain."""
    parsed = mappers.messages(messages.where("text is not null and text <> ''"))
    record = F.struct(
        F.col("title").alias("name"), F.col("text").alias("description"), F.struct(F.col("employer").alias("name")).alias("employer"), F.struct(F.col("area").alias("name")).alias("area"),
        F.col("salary"), F.col("date").alias("published_at"), F.concat(F.lit("https://t.me/"), "channel", F.lit("/"), F.col("id").cast("string")).alias("_source_url"),
    )
    return records(parsed.select(F.to_json(record).alias("raw"), F.lit(capture_ts).alias("capture_ts")), "telegram")
