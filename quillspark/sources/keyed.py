"""A store of one row per key in buckets by hash of the key: a batch reads and writes its own buckets alone."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import stages


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def read(spark: SparkSession, path: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
    """The store's rows, or those of some buckets, whose folders alone are listed and read; none where there is no store."""
    try:
        held = spark.read.schema(f"{schema}, bucket int").option("basePath", path).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        held = spark.createDataFrame([], f"{schema}, bucket int")
    return held if buckets is None else held.where(F.col("bucket").isin(buckets))


def missing(batch: DataFrame, path: str, key: str, at: str, buckets: int) -> DataFrame:
    """The rows of a batch that the store lacks, with their bucket: of a key the first by `at` (null last), then by all
    columns. Rows without a key are left out."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema)
    rest = [c for c in batch.columns if c not in (key, at)]
    order = F.struct(F.col(at).isNull(), at, *rest)
    first = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(at, *rest), order).alias("__r"))
    fresh = first.select(key, "__r.*").select(*batch.columns, bucket_of(key, buckets).alias("bucket"))
    touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # at most as many as there are buckets
    held = read(batch.sparkSession, path, schema, touched).select(key, "bucket")
    return fresh.join(held, [key, "bucket"], "left_anti").select(*batch.columns, "bucket")


def insert(batch: DataFrame, path: str, key: str, at: str, buckets: int = 64) -> int:
    """Adds what the store lacks and says how many rows came in; the rows of a key that is stored stay as they are.

    What comes in is written beside the store first, so that it is decided once: the store is read before it is written.
    """
    fresh, seen = stages.counted(missing(batch, path, key, at, buckets), "fresh")
    if seen["n"]:
        fresh.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)
    return seen["n"]


def update(changes: DataFrame, path: str, key: str, schema: str, apply, buckets: int = 64) -> int:
    """Rewrites the buckets that hold keys of changes as apply(stored rows, changes), which keeps columns and keys; says how
    many keys of the store the changes have.

    The new rows are written beside the store before they replace the buckets, and buckets without changes stay as they are.
    """
    touched = [r.bucket for r in changes.select(bucket_of(key, buckets).alias("bucket")).distinct().collect()]  # at most as many as there are buckets
    spark = changes.sparkSession
    held = read(spark, path, schema, touched)
    fresh, _ = stages.counted(apply(held.drop("bucket"), changes).withColumn("bucket", bucket_of(key, buckets)), "updated")
    hits = held.join(changes.select(key).distinct(), key, "left_semi").count()
    if hits:
        writer = fresh.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("bucket").parquet(path)
    return hits
