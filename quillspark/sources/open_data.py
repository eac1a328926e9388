"""Open-data pages by offset as a data source, with caps, retries, and a split by region where a cap binds.

A transport takes the parameters of a page and gives the decoded answer; the default reads stored answers from a folder
that driver and executors share: <folder>/<text or _>/<region or _>/<offset>.json.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

# Sizes of the first and of later pages, and the highest offsets without and with a text search.
FIRST, NEXT, MOST, MOST_WITH_TEXT = 100, 10, 10_000, 110
Answer = Callable[[dict], dict]


def stored(folder: str) -> Answer:
    """Answers from files; a page that isn't stored is an empty one."""

    def answer(page: dict) -> dict:
        path = Path(folder) / page.get("text", "_") / page.get("region_code", "_") / f"{page['offset']}.json"
        if not path.exists():
            return {"status": "200", "meta": {"total": 0}, "results": {"vacancies": []}}
        return json.loads(path.read_text("utf-8"))

    return answer


def retried(answer: Answer, page: dict, tries: int = 5, first: float = 2.0, most: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The answer whose status is 200; failures are tried again after waits that double up to `most`."""
    wait = first
    for _ in range(tries):
        try:
            data = answer(page)
            if str(data.get("status", "200")) == "200":
                return data
        except OSError:
            pass
        sleep(wait)
        wait = min(wait * 2, most)
    raise RuntimeError(f"no answer after {tries} tries for {page}")


def parameters(offset: int, limit: int, text: str | None = None, region: str | None = None, start: str | None = None, end: str | None = None) -> dict:
    given = {"modifiedFrom": start, "modifiedTo": end, "text": text, "region_code": region}
    return {"offset": offset, "limit": limit} | {k: v for k, v in given.items() if v}


def count(answer: Answer, **given) -> int:
    return int(retried(answer, parameters(0, 1, **given))["meta"]["total"])


def scan(answer: Answer, **given) -> Iterator[dict]:
    """All vacancies of a query, page after page, up to the cap."""
    data = retried(answer, parameters(0, FIRST, **given))
    yield from data["results"]["vacancies"]
    end = min(int(data["meta"]["total"]), MOST)
    size = FIRST
    if given.get("text"):
        end, size = min(end, MOST_WITH_TEXT), NEXT
    for offset in range(FIRST, end, size):
        found = retried(answer, parameters(offset, size, **given))["results"]["vacancies"]
        if not found:
            return
        yield from found


def queries(answer: Answer, texts: list[str | None], regions: list[str]) -> list[tuple[str | None, str | None]]:
    """(text, region) of the scans: a text whose count is above the cap is scanned region by region; each text once."""
    out: list[tuple[str | None, str | None]] = []
    for text in dict.fromkeys(texts):
        whole = count(answer, text=text) <= (MOST_WITH_TEXT if text else MOST) or not regions
        out += [(text, None)] if whole else [(text, r) for r in regions]
    return out


class OpenData(DataSource):
    """Format `open_data`: text, region, data (JSON of one vacancy); a partition for each text and region.

    Options: path (of stored answers), texts and regions (separated by commas; regions split texts above the cap),
    split: always, to scan every region.
    """

    @classmethod
    def name(cls) -> str:
        return "open_data"

    def schema(self) -> str:
        return "text string, region string, data string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


class _Query(InputPartition):
    def __init__(self, text: str | None, region: str | None):
        self.text, self.region = text, region


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        listed = lambda k: [x for x in options.get(k, "").split(",") if x]
        self.folder, self.texts, self.regions = options["path"], listed("texts") or [None], listed("regions")
        self.always = options.get("split") == "always"

    def partitions(self) -> list[InputPartition]:
        if self.always:
            return [_Query(t, r) for t in dict.fromkeys(self.texts) for r in self.regions]
        return [_Query(t, r) for t, r in queries(stored(self.folder), self.texts, self.regions)]

    def read(self, partition: _Query):
        for vacancy in scan(stored(self.folder), text=partition.text, region=partition.region):
            yield partition.text, partition.region, json.dumps(vacancy, ensure_ascii=False)


def collected(spark: SparkSession, path: str, texts: list[str] | None = None, regions: list[str] | None = None, **options: str) -> DataFrame:
    """Vacancies of all texts (and regions), each id once."""
    spark.dataSource.register(OpenData)
    reader = spark.read.format("open_data").option("path", path).options(**options)
    rows = reader.option("texts", ",".join(texts or [])).option("regions", ",".join(regions or [])).load()
    key = F.coalesce(F.get_json_object("data", "$.vacancy.id"), F.get_json_object("data", "$.id"))
    return rows.withColumn("id", key).groupBy("id").agg(F.min_by(F.struct("text", "region", "data"), F.struct("text", "region")).alias("r")).select("id", "r.*")


def channel_messages(spark: SparkSession, path: str, keywords: list[str] | None = None, last: int | None = None) -> DataFrame:
    """channel, id, date, text of exported messages (JSON lines): the last ones of each channel that hold a keyword."""
    from quillspark.operators.characteristics import contains_any
    from quillspark.operators.text import top

    rows = spark.read.schema("channel string, id long, date string, text string").json(path).where("text is not null and text <> ''")
    if last:
        rows = top(rows, ["channel"], [F.desc("id")], last, "__nth").drop("__nth")
    return rows.where(contains_any(F.col("text"), keywords or [], True))
