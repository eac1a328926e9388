"""The keyed store of raw records: insert or ignore, merge, field updates, run ledger and verification."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def insert_or_ignore(stored: DataFrame, new: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The stored rows and the new ones of keys not stored; of several new rows of a key the first in order."""
    return stored.unionByName(fresh(stored, new, key, order).select(*stored.columns))


def fresh(stored: DataFrame, new: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The new rows of keys not stored; of several rows of a key the first in order."""
    from quillspark.operators.text import top

    return top(new.join(stored.select(key), key, "left_anti"), [key], order, 1, "__nth").drop("__nth")


def merged(stored: DataFrame, new: DataFrame, key: str, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """What `insert_or_ignore` gives, and one row: n, how many rows came in."""
    out = insert_or_ignore(stored, new, key, order)
    return out, new.select(key).distinct().join(stored.select(key), key, "left_anti").agg(F.count("*").alias("n"))


def updated_fields(stored: DataFrame, changes: DataFrame, key: str, data: str, schema: str, fields: list[str]) -> DataFrame:
    """The stored rows with fields of their JSON column (of the schema) set to what changes has for their key; null
    keeps the old value."""
    renamed = changes.select(F.col(key).alias("__key"), F.struct(*fields).alias("__new"))
    old = F.from_json(data, schema)
    names = [f.name for f in changes.sparkSession.createDataFrame([], schema).schema]
    value = lambda n: F.coalesce(F.col("__new")[n], old[n]) if n in fields else old[n]
    joined = stored.join(renamed, F.col(key) == F.col("__key"), "left").withColumn(data, F.to_json(F.struct(*[value(n).alias(n) for n in names])))
    return joined.select(*stored.columns)


@F.pandas_udf(T.StringType())
def patched(data: pd.Series, patch: pd.Series) -> pd.Series:
    """JSON objects with the fields that a patch (a JSON object) has, in place of their own; a null patch changes nothing,
    data that are no object count as an empty one."""

    def one(text: str | None, more: str | None) -> str | None:
        if more is None:
            return text
        try:
            held = json.loads(text or "{}")
        except ValueError:
            held = {}
        return json.dumps((held if isinstance(held, dict) else {}) | json.loads(more), ensure_ascii=False)

    return pd.Series([one(a, b) for a, b in zip(data, patch)], dtype=object)


def updated(stored: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The stored rows with the columns that changes has for their key (null keeps the old value)."""
    renamed = changes.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = stored.join(renamed, key, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in stored.columns])


def ledger_state(events: DataFrame, run: str, at: str) -> DataFrame:
    """The latest state of each run of an append-only ledger."""
    rest = [c for c in events.columns if c != run]
    latest = events.groupBy(run).agg(F.max_by(F.struct(*rest), at).alias("s"))
    return latest.select(run, *[F.col(f"s.{c}").alias(c) for c in rest])


def field_presence(rows: DataFrame, fields: list[str]) -> DataFrame:
    """field, present, absent, percent of each field in one pass; empty text counts as absent."""
    kinds = dict(rows.dtypes)
    here = lambda c: F.col(c).isNotNull() & ((F.col(c) != "") if kinds[c] == "string" else F.lit(True))
    once = rows.agg(F.count("*").alias("__n"), *[F.count_if(here(c)).alias(c) for c in fields])
    long = once.unpivot("__n", fields, "field", "present")
    return long.select("field", "present", (F.col("__n") - F.col("present")).alias("absent"), F.round(F.coalesce(F.try_divide(100.0 * F.col("present"), F.col("__n")), F.lit(0.0)), 2).alias("percent"))


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that come more than once, and by how many."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").withColumn("surplus", F.col("n") - 1)


def errors(checks: dict[str, Column]) -> Column:
    """The names of the checks that fail, in order; a null check fails."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items()]))
