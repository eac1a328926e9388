"""Bounded samples for fitting models: the rows of the smallest hashes of their ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(key: Column, of: int) -> Column:
    """crc32 of the key as text, modulo `of`; null where the key is."""
    return F.crc32(key.cast("string").cast("binary")) % of


def bounded(ids: DataFrame, rows: int, seed: str) -> DataFrame:
    """At most `rows` of ids (doc_id and more), by the hash of doc_id."""
    h = F.xxhash64(F.lit(seed), "doc_id")
    return ids.where("doc_id is not null").withColumn("__h", h).orderBy("__h", "doc_id").limit(rows).drop("__h")
