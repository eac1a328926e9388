"""Continuous ingestion: idempotent by key within a watermark, windowed captures, and upserts by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.sources import keyed


def records(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Files of JSON lines as they arrive; the option is the rate limit."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def first_of_key(stream: DataFrame, key: str, at: str, delay: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def weekly_captures(stream: DataFrame, at: str, by: str, delay: str = "1 day") -> DataFrame:
    window = F.window(at, "7 days")
    return stream.withWatermark(at, delay).groupBy(window, by).agg(F.count("*").alias("captures")).select("window.start", "window.end", by, "captures")


def store(stream: DataFrame, path: str, key: str, at: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Adds the rows of keys that the bucketed store at path lacks, of a key the first by time; a batch that runs again
    adds nothing (see quillspark.sources.keyed)."""

    def add(batch: DataFrame, _: int) -> None:
        keyed.insert(batch, path, key, at, buckets)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
