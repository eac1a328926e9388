"""Reading inputs and cutting lineage with tables in the folder that the whole cluster shares."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Bytes of the batches that Python workers get at once.
BATCH = 8 << 20
#: Rows of a partition of a gathered table, and of the largest table of numbers that is broadcast (32 MB at most).
ROWS, SENT = 1 << 18, 1 << 19
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers of the application, which needn't have it on their path, and bounds the
    bytes of their batches: a few long texts are then no more to hold than many short ones."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        to = Path(tempfile.mkdtemp(prefix="quillspark-")) / package.name
        context.addPyFile(shutil.make_archive(str(to), "zip", package.parent, package.name))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
        _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset on one machine, as in tests, a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder, read back: later jobs don't compute it again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quillspark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str, **sums: Column) -> tuple[DataFrame, dict]:
    """The written table, and what its write observed: n, its number of rows, and further aggregates."""
    seen = Observation()
    back = written(df.observe(seen, F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in sums.items())), name)
    return back, seen.get


def gathered(df: DataFrame, n: int, wide: int = 1) -> DataFrame:
    """A frame of n rows in partitions of about ROWS / wide: a table of fewer rows is one partition, which needs no
    exchange. wide: how many times the bytes of a few numbers a row has."""
    return df.coalesce(max(1, -(-n * wide // ROWS)))


def sent(df: DataFrame, n: int) -> DataFrame:
    """A frame of n narrow rows for the smaller side of a join: broadcast up to SENT rows, else left to the planner."""
    return F.broadcast(df) if n <= SENT else df
