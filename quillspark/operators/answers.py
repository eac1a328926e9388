"""Texts scored by a model that the caller gives: what was answered before is read from a store, what wasn't is asked for
once, and answers are decoded by a schema in tiers, so that broken ones fall back one by one.

A model is a function (mode, system, user) -> text; mode is "schema" where the answer must follow the schema, "object" where
any JSON object will do. An OSError of the model counts as a broken answer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark import stages
from quillspark.functions import text as tx
from quillspark.sources import keyed

Ask = Callable[[str, str, str], str]
Scorer = Callable[[DataFrame], DataFrame]


def object_in_text(text: Column) -> Column:
    """From the first brace to the last one, null where there is none."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def remembered(texts: DataFrame, scorer: Scorer, path: str, model: str, value: str = "array<double>", buckets: int = 64) -> DataFrame:
    """text, value of texts (text): from the store at path, and for those it lacks from the scorer (text -> text, value), which
    is asked for each different text once; then the store has them too. Null texts have no value; null values aren't kept.

    model: its name; values of another model aren't taken.
    """
    key = F.concat(F.lit(f"{model}|"), tx.cache_key(F.col("text"), 64)).alias("key")
    own = stages.written(texts.select("text").where("text is not null").distinct().select(key, "text"), "texts")
    held = keyed.read(texts.sparkSession, path, f"key string, at timestamp, value {value}").select("key", "value")
    known = stages.written(own.join(held, "key"), "known")
    new, seen = stages.counted(scorer(own.join(known.select("key"), "key", "left_anti").select("text")).select("text", F.col("value").cast(value)), "scored")
    if seen["n"]:
        rows = new.where("value is not null").join(own, "text").select("key", F.current_timestamp().alias("at"), "value")
        keyed.insert(rows, path, "key", "at", buckets)
    return texts.select("text").distinct().join(known.select("text", "value").unionByName(new), "text", "left")


def answered(
    prompts: DataFrame, ask: Ask, schema: str, name: str, model: str, path: str | None = None, temperature: float = 0.0, tries: int = 2,
    valid: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """id, answer of prompts (id, system, user): the answer as a struct of the schema, null where no tier gives one.

    Equal prompts are asked for once, and not at all where the store at path has their answer under the model, the schema's
    name, the temperature and both texts. Tier one asks for the schema, `tries` times; tier two asks for an object and reads
    the one that the text holds; what is still broken has no answer and is asked for again the next time. valid: a check of
    the struct; every field is set by default.
    """
    spark = prompts.sparkSession
    stages.ship(spark)
    fields = [f.name for f in spark.createDataFrame([], schema).schema]
    every = lambda s: F.forall(F.array(*[s[f].isNotNull() for f in fields]), lambda x: x)
    ok = valid or every
    key = F.sha2(F.concat_ws("|", F.lit(model), F.lit(name), F.lit(str(temperature)), F.coalesce("system", F.lit("")), F.coalesce("user", F.lit(""))), 256)
    named = stages.written(prompts.select("id", key.alias("key"), F.coalesce("system", F.lit("")).alias("system"), F.coalesce("user", F.lit("")).alias("user")), "prompts")
    different = named.select("key", "system", "user").dropDuplicates(["key"])
    parsed = lambda c: F.from_json(c, schema)
    sound = lambda c: F.coalesce(parsed(c).isNotNull() & ok(parsed(c)), F.lit(False))
    known = None
    if path:
        held = keyed.read(spark, path, "key string, at timestamp, answer string").select("key", "answer").where(sound(F.col("answer")))
        known = stages.written(different.select("key").join(held, "key"), "known")
        different = different.join(known.select("key"), "key", "left_anti")
    left, found = different, None
    for mode in ["schema"] * max(1, tries) + ["object"]:
        text = F.col("answer") if mode == "schema" else object_in_text(F.col("answer"))
        asked, seen = stages.counted(_asked(left, ask, mode).withColumn("answer", text), "asked")
        good = asked.where(sound(F.col("answer"))).select("key", "answer")
        found = good if found is None else found.unionByName(good)
        left, rest = stages.counted(asked.where(~sound(F.col("answer"))).select("key", "system", "user"), "broken")
        if not rest["n"]:
            break
    if path:
        keyed.insert(found.select("key", F.current_timestamp().alias("at"), "answer"), path, "key", "at")
        found = found.unionByName(known)
    return named.select("id", "key").join(found, "key", "left").select("id", parsed(F.col("answer")).alias("answer"))


def _asked(rows: DataFrame, ask: Ask, mode: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for system, user in zip(pdf["system"], pdf["user"]):
                try:
                    out.append(ask(mode, system, user))
                except OSError:
                    out.append(None)
            yield pdf.assign(answer=pd.Series(out, dtype=object, index=pdf.index))

    return rows.select("key", "system", "user").mapInPandas(run, "key string, system string, user string, answer string")


def scored_characteristics(texts: DataFrame, hypotheses: dict[str, str], decode: Callable[[DataFrame, str, str], DataFrame]) -> DataFrame:
    """vacancy_id, scores (a map; null without an answer) of texts (vacancy_id, text) by the model behind decode(prompts,
    schema, name): confidences brought into 0 to 1, names that aren't asked for left out, of a name's the last."""
    listed = "\n".join(f"{k}: {v}" for k, v in hypotheses.items())
    system = f"Rate from 0 to 1 how much each characteristic marks the text. Answer with their names alone.\n{listed}"
    prompts = texts.select(F.col("vacancy_id").alias("id"), F.lit(system).alias("system"), F.col("text").alias("user"))
    got = decode(prompts, "characteristics array<struct<characteristic_id: string, confidence: double>>", "characteristics")
    fair = F.filter("answer.characteristics", lambda s: s["characteristic_id"].isin(*hypotheses) & s["confidence"].isNotNull())
    # the last of a name, as a map has each name once
    later = F.filter(fair, lambda s, i: ~F.exists(F.slice(fair, i + 2, F.size(fair)), lambda t: t["characteristic_id"] == s["characteristic_id"]))
    clamped = F.transform(later, lambda s: F.struct(s["characteristic_id"].alias("k"), F.least(F.greatest(s["confidence"], F.lit(0.0)), F.lit(1.0)).alias("v")))
    return got.select(F.col("id").alias("vacancy_id"), F.when(F.col("answer").isNotNull(), F.map_from_entries(clamped)).alias("scores"))


def named_roles(roles: DataFrame, decode: Callable[[DataFrame, str, str], DataFrame], most: int = 80) -> DataFrame:
    """The roles (role, top_titles, ...) with `label`: the model's name for the titles, trimmed and cut, or the role itself."""
    system = "Give one short name for the role that these job titles share."
    prompts = roles.select(F.col("role").alias("id"), F.lit(system).alias("system"), F.array_join("top_titles", "\n").alias("user"))
    got = decode(prompts, "name string", "role_name").select(F.col("id").alias("__id"), F.substring(F.trim("answer.name"), 1, most).alias("__name"))
    return roles.join(got, F.col("role") == F.col("__id"), "left").withColumn("label", F.coalesce(F.nullif("__name", F.lit("")), "role")).drop("__id", "__name")


def skill_phrases(rows: DataFrame, decode: Callable[[DataFrame, str, str], DataFrame]) -> DataFrame:
    """vacancy_id, at, text, lemma of rows (vacancy_id, description): the skills that the model lists, lower-cased, each
    once, in order; none without an answer."""
    prompts = rows.select(F.col("vacancy_id").alias("id"), F.lit("List the skills that the text asks for.").alias("system"), F.col("description").alias("user"))
    got = decode(prompts, "skills array<string>", "skills")
    bare = F.transform("answer.skills", lambda s: F.lower(F.trim(s)))
    listed = F.array_distinct(F.filter(bare, lambda s: s.isNotNull() & (s != "")))
    return got.select(F.col("id").alias("vacancy_id"), F.posexplode(listed).alias("at", "text")).withColumn("lemma", F.col("text"))


def decoder(ask: Ask, model: str, path: str | None = None, **options) -> Callable[[DataFrame, str, str], DataFrame]:
    """decode(prompts, schema, name) of a model, with its answers kept at path."""
    return lambda prompts, schema, name: answered(prompts, ask, schema, name, model, path, **options)
