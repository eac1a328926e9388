"""The archive of saved pages: index queries over stored responses, yearly and era-routed scans, and snapshot fetching.

Fetching takes the transport as a function, so jobs run alike against stored pages and a live archive.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import stages
from quillspark.sources.mappers import archive_rows

# Which address patterns a network's archive has in which years; the years between have none.
ERAS = ((2013, 2016, "linkedin.com/jobs2/view/*"), (2019, 2026, "linkedin.com/jobs/view/*"))
#: Answers of a transport: status, content type, body.
Fetch = Callable[[str], tuple[int, str, str]]


def index_responses(spark: SparkSession, path: str) -> DataFrame:
    """Captures from files that each hold one response of the index: a JSON list of rows, the first of them a header,
    at the end perhaps a key to resume by."""
    whole = spark.read.option("wholetext", True).text(path)
    rows = whole.select(F.explode(F.from_json("value", "array<array<string>>")).alias("fields"))
    return archive_rows(rows.where(F.size("fields") > 1))


def address_key(address: Column) -> Column:
    """The key by which captures of one address collapse: without scheme, www, query, last slash and case."""
    bare = F.regexp_replace(F.lower(address), r"^https?://(?:www\.)?", "")
    return F.regexp_replace(F.regexp_replace(bare, r"[?#].*$", ""), "/$", "")


def matches(address: Column, pattern: str) -> Column:
    """Does the address match a pattern that may end in * ?"""
    key = address_key(address)
    return key.startswith(pattern[:-1].lower()) if pattern.endswith("*") else key == pattern.lower()


def index_query(
    captures: DataFrame, pattern: str, start: str | None = None, end: str | None = None, status: int | None = 200, mimetype: str | None = None,
    collapse: bool = False, by: tuple[str, ...] = (),
) -> DataFrame:
    """The captures (timestamp, original, mimetype, statuscode) that match, from `start` to `end` (prefixes of
    timestamps, both inclusive). collapse: the earliest of each address key (and of the columns `by`)."""
    found = captures.where(matches(F.col("original"), pattern))
    if start:
        found = found.where(F.col("timestamp") >= start)
    if end:
        found = found.where(F.substring("timestamp", 1, len(end)) <= end)
    if status is not None:
        found = found.where(F.col("statuscode") == str(status))
    if mimetype:
        found = found.where(F.col("mimetype") == mimetype)
    if not collapse:
        return found
    rest = [c for c in captures.columns if c not in by]
    keyed = found.withColumn("__key", address_key(F.col("original"))).groupBy("__key", *by)
    return keyed.agg(F.min_by(F.struct(*rest), F.struct("timestamp", "original")).alias("r")).select(*by, "r.*")


def yearly(captures: DataFrame, pattern: str, year: int, mimetype: str = "text/html") -> DataFrame:
    """window (its first day) and the captures of a year in windows of seven days: of each window the earliest of each
    address key, and of each address the earliest of all windows."""
    day = F.to_date(F.substring("timestamp", 1, 8), "yyyyMMdd")
    first = F.make_date(F.lit(year), F.lit(1), F.lit(1))
    window = F.date_add(first, (F.floor(F.date_diff(day, first) / 7) * 7).cast("int"))
    within = index_query(captures, pattern, f"{year}0101", f"{year}1231", 200, mimetype).withColumn("window", window)
    weekly = index_query(within, pattern, status=None, collapse=True, by=("window",))
    rest = [c for c in weekly.columns if c != "original"]
    return weekly.groupBy("original").agg(F.min_by(F.struct(*rest), "timestamp").alias("r")).select("original", "r.*")


def era_pattern(year: int) -> str | None:
    """The address pattern of a year; None for the years without; an error outside all eras."""
    for first, last, pattern in ERAS:
        if first <= year <= last:
            return pattern
    if ERAS[0][1] < year < ERAS[-1][0]:
        return None
    raise ValueError(f"no era has the year {year}")


def by_era(captures: DataFrame, year: int) -> DataFrame:
    """The captures of a network in a year by its era's pattern, each address once; none for years without."""
    pattern = era_pattern(year)
    found = captures.limit(0) if pattern is None else index_query(captures, pattern, f"{year}0101", f"{year}1231", 200, "text/html", collapse=True)
    return found.select("timestamp", "original")


def stored(folder: str) -> Fetch:
    """Answers from files that driver and executors share: <folder>/<first 32 hex digits of the address' sha256>.html;
    404 where there is none."""

    def fetch(address: str) -> tuple[int, str, str]:
        path = Path(folder) / f"{hashlib.sha256(address.encode()).hexdigest()[:32]}.html"
        return (200, "text/html", path.read_text("utf-8", "replace")) if path.exists() else (404, "text/html", "")

    return fetch


def retried(fetch: Fetch, address: str, tries: int = 4, first: float = 1.0, most: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> tuple[int, str, str]:
    """An answer below 500 and other than 429, tried again after waits that double up to `most`; else the last answer."""
    wait, answer = first, (0, "", "")
    for left in range(tries - 1, -1, -1):
        try:
            answer = fetch(address)
        except OSError as e:
            answer = (0, "", str(e))
        if 0 < answer[0] < 500 and answer[0] != 429:
            break
        if left:
            sleep(min(wait, most))
            wait *= 2
    return answer


def _page(fetch: Fetch, address: str, tries: int, first: float) -> tuple[str | None, str | None]:
    """The page, and why there is none: missing (4xx), failed (other answers), type (no HTML)."""
    status, kind, body = retried(fetch, address, tries, first)
    if status == 200 and kind.split(";")[0].strip() == "text/html":
        return body, None
    return None, "type" if status == 200 else "missing" if 400 <= status < 500 and status != 429 else "failed"


def asked(addresses: DataFrame, fetch: Fetch, tries: int = 4, first: float = 1.0) -> DataFrame:
    """address, html, error of addresses (see _page)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [_page(fetch, a, tries, first) for a in pdf["address"]]
            yield pdf.assign(html=[p for p, _ in found], error=[e for _, e in found])

    stages.ship(addresses.sparkSession)
    return addresses.select("address").mapInPandas(run, "address string, html string, error string")


def fetched(captures: DataFrame, fetch: Fetch, base: str = "http://web.archive.org/web", tries: int = 4, first: float = 1.0) -> DataFrame:
    """timestamp, original, html, error of captures (see _page)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [_page(fetch, f"{base}/{at}id_/{address}", tries, first) for at, address in zip(pdf["timestamp"], pdf["original"])]
            yield pdf.assign(html=[p for p, _ in found], error=[e for _, e in found])

    stages.ship(captures.sparkSession)
    return captures.select("timestamp", "original").mapInPandas(run, "timestamp string, original string, html string, error string")


def in_passes(
    rows: DataFrame, step: Callable[[DataFrame], DataFrame], passes: int = 3, again: tuple[str, ...] = ("failed",), pause: float = 0.0,
    sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """What step gives (the columns of rows, html, error) for each distinct row after passes over those whose error is in
    `again`.

    Every pass is written with what it fetched, and the next reads its failures from there: a page is asked for once a
    pass, failing before, and comes once. pause: seconds before the second pass, twice as many before the third, and so on.
    """
    left, done, columns = rows.distinct(), None, rows.columns
    for nth in range(passes):
        if nth and pause:
            sleep(pause * nth)
        failed = F.coalesce(F.col("error").isin(*again), F.lit(False))
        found, seen = stages.counted(step(left), "pass", failed=F.count_if(failed))
        last = nth == passes - 1 or not seen["failed"]
        kept = found if last else found.where(~failed)
        done = kept if done is None else done.unionByName(kept)
        if last:
            break
        # as many tasks as a first pass would have for these pages
        left = found.where(failed).select(*columns).repartition(max(1, min(rows.sparkSession.sparkContext.defaultParallelism, seen["failed"])))
    return done


def recovered(missing: DataFrame, fetch: Fetch, passes: int = 3, again: tuple[str, ...] = ("failed",), pause: float = 0.0, sleep: Callable[[float], None] = time.sleep, **options) -> DataFrame:
    """What `fetched` gives for each distinct capture after passes over those that failed (see in_passes)."""
    return in_passes(missing.select("timestamp", "original"), lambda left: fetched(left, fetch, **options), passes, again, pause, sleep)


def error_counts(found: DataFrame) -> DataFrame:
    return found.groupBy(F.coalesce("error", F.lit("none")).alias("error")).agg(F.count("*").alias("n"))
