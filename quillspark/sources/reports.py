"""Reports for people: census and metrics as JSON and as fixed-width tables."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.sources.archive import address_key


def census(captures: DataFrame) -> DataFrame:
    """source, pattern, year, captures, urls of captures (source, pattern, timestamp, original)."""
    year = F.substring("timestamp", 1, 4).cast("int").alias("year")
    return captures.groupBy("source", "pattern", year).agg(F.count("*").alias("captures"), F.count_distinct(address_key(F.col("original"))).alias("urls"))


def census_lines(rows: DataFrame) -> DataFrame:
    """source, year, line: the census as lines of fixed width."""
    line = F.format_string("%-24s %-36s %6d  %,10d %,8d", "source", "pattern", "year", "captures", "urls")
    return rows.select("source", "year", line.alias("line"))


def table(rows: DataFrame, made: str) -> str:
    """The census as text: its rows are one for each source, pattern and year, so they come to the driver."""
    found = census_lines(rows).orderBy("source", "year").collect()
    total = rows.agg(F.coalesce(F.sum("captures"), F.lit(0)).alias("n")).first().n
    head = f"{'Source':<24} {'Pattern':<36} {'Year':>6} {'Captures':>10} {'Unique':>8}"
    return "\n".join(["Census Report", f"Generated: {made}", f"Total estimated records: {total:,}", "", head, "-" * len(head), *(r.line for r in found)])


def write_json(rows: DataFrame, path: str, made: str, **more) -> None:
    """A report of few rows as one JSON file; folders are made where they lack."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    results = [json.loads(x) for x in rows.select(F.to_json(F.struct("*")).alias("j")).toPandas()["j"]]
    Path(path).write_text(json.dumps({"generated_at": made, **more, "results": results}, indent=2, ensure_ascii=False), "utf-8")
