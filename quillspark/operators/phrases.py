"""Noun phrases from dependency trees, and phrases brought to canonical ones.

A parser is given by the caller: a function of frames that gives one row a sentence, its tokens in an array with text,
lemma, tag (part of speech), relation and head (position in the array, its own for a root).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark import stages
from quillspark.operators import clusters
from quillspark.operators.characteristics import BOILERPLATE
from quillspark.operators.text import top

TOKENS = "array<struct<text:string,lemma:string,tag:string,relation:string,head:int>>"
# Tags of heads and of the words that a phrase keeps.
NOUNS, CONTENT = ("NOUN", "PROPN"), ("NOUN", "PROPN", "ADJ")


def _participle(t: Column) -> Column:
    return (t["tag"] == "VERB") & (t["relation"] == "amod")


def _heads(tokens: Column) -> Column:
    """For each token the positions of the nouns whose phrase it belongs to: the way up from it ends below a conjunct, and
    passes adjectives, participles and nominal modifiers alone."""
    count = F.size(tokens)

    def climb(_: Column, j: Column) -> Column:
        own = F.get(tokens, j)
        content = own["tag"].isin(*CONTENT) | _participle(own)
        begun = F.struct(
            j.alias("at"), (content & (own["relation"] != "conj") & (own["head"] != j)).alias("goes"), F.array().cast("array<int>").alias("nouns")
        )

        def step(held: Column, _: Column) -> Column:
            up = F.get(tokens, held["at"])["head"]
            head = F.get(tokens, up)
            nouns = F.when(held["goes"] & head["tag"].isin(*NOUNS), F.concat(held["nouns"], F.array(up))).otherwise(held["nouns"])
            passes = (head["tag"] == "ADJ") | _participle(head) | (head["tag"].isin(*NOUNS) & (head["relation"] == "nmod"))
            goes = held["goes"] & passes & (head["relation"] != "conj") & (head["head"] != up)
            return F.struct(F.when(held["goes"], up).otherwise(held["at"]).alias("at"), goes.alias("goes"), nouns.alias("nouns"))

        # a way up has fewer steps than there are tokens
        return F.aggregate(F.sequence(F.lit(1), count), begun, step, lambda held: held["nouns"])

    return F.transform(tokens, climb)


def noun_phrases(parsed: DataFrame, key: str, sentence: str = "sentence", tokens: str = "tokens", dropped: tuple[str, ...] = BOILERPLATE) -> DataFrame:
    """key, sentence, at, text, lemma of parsed (key, sentence, tokens): the phrase of each noun, lower-cased, in order;
    of nouns whose phrases begin and end alike the first; phrases in `dropped` are left out. Sentences without tokens
    have none.

    A phrase has the noun, and what modifies it directly or through adjectives, participles and nominal modifiers;
    conjuncts and what hangs on them aren't part of it.
    """
    t = F.col("__t")
    held = parsed.select(key, sentence, F.col(tokens).cast(TOKENS).alias("__t")).where(F.size("__t") > 0).withColumn("__heads", _heads(t))
    every = F.sequence(F.lit(0), F.size(t) - 1)
    nouns = F.filter(every, lambda i: F.get(t, i)["tag"].isin(*NOUNS))
    members = lambda i: F.filter(every, lambda j: (i == j) | F.array_contains(F.get("__heads", j), i))
    spans = F.transform(nouns, lambda i: F.struct(i.alias("noun"), members(i).alias("at")))
    listed = held.select(key, sentence, "__t", F.explode(spans).alias("s"))
    ends = [F.element_at("s.at", 1).alias("__first"), F.element_at("s.at", -1).alias("__last")]
    joined = lambda field: F.lower(F.array_join(F.transform("s.at", lambda i: F.get(t, i)[field]), " "))
    named = listed.select(key, sentence, F.col("s.noun").alias("at"), *ends, joined("text").alias("text"), joined("lemma").alias("lemma"))
    first = F.row_number().over(Window.partitionBy(key, sentence, "__first", "__last").orderBy("at"))
    kept = named.withColumn("__nth", first).where("__nth = 1").drop("__nth", "__first", "__last").where("text <> ''")
    return kept.where(~F.col("text").isin(list(dropped)) & ~F.col("lemma").isin(list(dropped)))


def with_key_skills(found: DataFrame, given: DataFrame, key: str, most_words: int = 8) -> DataFrame:
    """key, at, text, lemma: phrases found (key, at, text, lemma) and then those given (key, at, text), each text of a key
    once, without those of more than `most_words` words."""
    both = found.select(key, F.lit(0).alias("__g"), "at", F.lower(F.trim("text")).alias("text"), "lemma")
    more = given.select(key, F.lit(1).alias("__g"), "at", F.lower(F.trim("text")).alias("text")).withColumn("lemma", F.col("text"))
    rows = both.unionByName(more).where((F.col("text") != "") & (F.size(F.split("text", r"\s+")) <= most_words))
    first = rows.groupBy(key, "text").agg(F.min_by(F.struct("__g", "at", "lemma"), F.struct("__g", "at", "lemma")).alias("r"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("r.__g", "r.at", "text")) - 1
    return first.select(key, place.cast("int").alias("at"), "text", "r.lemma")


def canonical_terms(rows: DataFrame, key: str, embed: Callable[[DataFrame], DataFrame], least: float, most: int, often: int) -> DataFrame:
    """key, term, df: phrases (key, at, text, lemma) as their canonical ones, of each key the first `most`, of those that
    `often` keys have.

    Phrases whose lemmas' vectors (embed: title -> title, embedding) have a cosine of `least` lead one another by
    frequency; each is read as the lemma of the leader that is nearest to it, shown by the leader's commonest text.
    """
    own = stages.written(rows, "phrases")
    counts = own.groupBy("lemma").agg(F.count("*").alias("n"))
    texts = own.groupBy("lemma", "text").agg(F.count("*").alias("n")).groupBy("lemma").agg(F.min_by("text", F.struct(-F.col("n"), "text")).alias("term"))
    vectors = embed(counts.select(F.col("lemma").alias("title"))).join(counts.withColumnRenamed("lemma", "title"), "title")
    led = clusters.led(vectors, "title", "n", "embedding", least).select(F.col("title").alias("lemma"), F.col("nearest").alias("leader"))
    shown = led.join(texts.select(F.col("lemma").alias("leader"), "term"), "leader").select("lemma", "term")
    first = own.join(shown, "lemma").groupBy(key, "term").agg(F.min("at").alias("at"))
    capped = top(first, [key], [F.asc("at"), F.asc("term")], most).select(key, "term")
    listed = stages.written(capped, "terms")
    frequent = listed.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= often)
    return listed.join(frequent, "term").select(key, "term", "df")
