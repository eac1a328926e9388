"""The archive's index page after page, as a stream whose offset is where each address pattern goes on.

A page is a JSON list of rows: a header, captures, and last the key of the next page, an empty list on the last one. Each
batch has the next page of every pattern that isn't done, so a batch is bounded by the index's page size. A stream that is
stopped goes on with the keys of its checkpoint: a page whose batch was committed is never asked for again, one whose
batch was not is asked for once more, and its rows come once.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from quillspark import stages
from quillspark.sources.clients import Client

# The fields of a capture in order.
FIELDS = ("timestamp", "original", "mimetype", "statuscode", "digest", "length")
#: (pattern, key or "") -> rows of a page.
Page = Callable[[str, str], list[list[str]]]


def stored_pages(folder: str) -> Page:
    """Pages from files <folder>/<first 16 hex digits of the pattern's sha256>/<key or _>.json; none where there is no file."""

    def page(pattern: str, key: str) -> list[list[str]]:
        path = Path(folder) / hashlib.sha256(pattern.encode()).hexdigest()[:16] / f"{key or '_'}.json"
        return json.loads(path.read_text("utf-8")) if path.exists() else []

    return page


def parsed_page(rows: list[list[str]]) -> tuple[list[list[str]], str]:
    """The captures of a page, and the key of the next one, empty on the last."""
    if not rows:
        return [], ""
    *data, key = rows
    if data and tuple(data[0][:2]) == FIELDS[:2]:
        data = data[1:]
    return [r for r in data if r], ",".join(key)


def scan(page: Page, pattern: str) -> Iterator[list[str]]:
    """All captures of a pattern, page after page."""
    key = ""
    while True:
        rows, key = parsed_page(page(pattern, key))
        yield from rows
        if not key:
            return


class CaptureIndex(DataSource):
    """Format `capture_index`: pattern, page, and the fields of a capture, as a stream.

    Options: path (of stored pages), patterns (separated by line feeds), per_second (calls, 1 by default).
    """

    @classmethod
    def name(cls) -> str:
        return "capture_index"

    def schema(self) -> str:
        return "pattern string, page int, " + ", ".join(f"{f} string" for f in FIELDS)

    def page(self) -> Page:
        return stored_pages(self.options["path"])

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Pages(self.page(), [p for p in self.options["patterns"].split("\n") if p], float(self.options.get("per_second", 1.0)))


class _Pages(SimpleDataSourceStreamReader):
    """An offset has for each pattern the number and key of the page to come; number -1 when there is none."""

    def __init__(self, page: Page, patterns: list[str], per_second: float):
        self.client, self.patterns = Client(page, per_second), sorted(set(patterns))

    def initialOffset(self) -> dict:
        return {p: [0, ""] for p in self.patterns}

    def _read(self, start: dict, until: dict | None = None) -> tuple[list[tuple], dict]:
        out, end = [], dict(start)
        for pattern, (number, key) in start.items():
            if number < 0 or (until is not None and until[pattern] == [number, key]):
                continue
            rows, following = parsed_page(self.client(pattern, key))
            out += [(pattern, number, *(r + [None] * len(FIELDS))[: len(FIELDS)]) for r in rows]
            end[pattern] = [number + 1, following] if following else [-1, ""]
        return out, end

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._read(start)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        at = start
        while at != end:
            rows, following = self._read(at, end)
            yield from rows
            if following == at:
                return
            at = following


def stream(spark: SparkSession, path: str, patterns: list[str], per_second: float = 1.0, source: type[CaptureIndex] = CaptureIndex) -> DataFrame:
    stages.ship(spark)
    spark.dataSource.register(source)
    return spark.readStream.format(source.name()).option("path", path).option("patterns", "\n".join(patterns)).option("per_second", per_second).load()
