"""Tables between the steps of a job that runs in several: each step is written where the whole cluster reads it, so
that later steps and lost executors don't run it again."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows of a partition of a table that is read back, and of the largest narrow table that is broadcast.
ROWS, SENT = 1 << 18, 1 << 18
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the application's Python workers, which needn't have it on their path."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parent
        to = Path(tempfile.mkdtemp(prefix="quillspark-")) / package.name
        context.addPyFile(shutil.make_archive(str(to), "zip", package.parent, package.name))
        _SHIPPED.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset on one machine, as in tests, a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def counted(df: DataFrame, name: str, **sums: Column) -> tuple[DataFrame, dict]:
    """The frame as a table in the shared folder, read back, and what the write observed: n, its rows, and further
    aggregates. A small table comes back in few partitions."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quillspark/{name}-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in sums.items())).write.parquet(path)
    facts = seen.get
    return spark.read.schema(df.schema).parquet(path).coalesce(max(1, -(-facts["n"] // ROWS))), facts


def written(df: DataFrame, name: str) -> DataFrame:
    return counted(df, name)[0]


def sent(df: DataFrame, n: int, most: int = SENT) -> DataFrame:
    """A frame of n narrow rows as the smaller side of a join: broadcast up to `most` rows, else left to the planner."""
    return F.broadcast(df) if n <= most else df
