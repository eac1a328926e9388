"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

The sources in code point order (null last) weigh 3, 1, 2 and so on; together they take a share of all words, each at
most a multiple of its own size, what is above shared by weight among the rest. A source takes complete epochs of all
its documents first; for what remains, every document draws the key -ln(u) / q, with u a hash of its id and q its
quality weight, and documents are taken whole by ascending key until the budget ends within one, of which the
remaining words are taken. So a source takes the whole part of its target.

Keys run over parts of equal probability of each source; sums of the parts before a part start its own running sum,
so no source is sorted as a whole, and rows equal in all that matters are counted first and spread again at the end.

Defined results: null and empty texts have no words and give none; a source without words has target 0; a document
without a label weighs 1; rows that repeat a doc_id are documents of their own with equal keys; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Quality weight by label; documents without one weigh 1.
QUALITY = {1: 2.0, 0: 0.5}
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target of sizes (source, source_size), one row per source.

    A source's cap is `most` times its size. In ascending order of cap / weight, sources are capped as long as the
    level that the others then share, (all - capped so far) / (weights left), is no less than their own ratio.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    named = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int")))
    capped = named.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("w"))
    everything = Window.partitionBy(F.lit(1))
    upto = everything.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(upto), F.lit(0.0))
    )
    tried = capped.withColumn("level", level).withColumn("free", F.col("ratio") > F.col("level"))
    final = tried.withColumn("flat", F.min(F.when(F.col("free"), F.struct("ratio", "level"))).over(everything)["level"])
    return final.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("flat") * F.col("w"), F.col("cap"))).alias("target"))


def exponential_key(key: Column, quality: Column, seed: str = "mix") -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11) + F.lit(1)).cast("double") / F.lit(float(1 << 53))
    return -F.log(u) / quality


def mix(docs: DataFrame, labels: DataFrame | None, parts: int | None = None, extra: tuple[str, ...] = (), **shares) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of docs (doc_id, text, source).

    extra: ("source",) gives the source too. parts: of each source; by default more where the session shuffles into more.
    """
    parts = parts or max(512, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    kinds = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies"))
    if labels is None:
        rated = kinds.withColumn("q", F.lit(1.0))
    else:
        rating = F.create_map(*[F.lit(x) for kv in QUALITY.items() for x in kv])
        marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("quality"))
        rated = kinds.join(marks, "doc_id", "left").withColumn("q", F.coalesce(F.try_element_at(rating, F.col("quality")), F.lit(1.0)))
    keyed = rated.withColumn("key", exponential_key(F.col("doc_id"), F.col("q"))).withColumn(
        "part", F.least(F.lit(parts - 1), F.floor((1 - F.exp(-F.col("key"))) * parts).cast("int"))
    )
    # null sources join as a value of their own
    named = keyed.withColumn("s", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")))
    sums = named.groupBy("s", "source", "part").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    totals = sums.groupBy("s", "source").agg(F.sum("words").alias("source_size"))
    goal = targets(totals.select("source", "source_size"), **shares).select(
        F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")).alias("s"), "source_size", "target"
    )
    before = Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("s", "part", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start")).join(goal, "s")
    inside = Window.partitionBy("s", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    spread = (
        named.join(starts, ["s", "part"])
        .withColumn("first", F.col("start") + F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0)))
        .withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    )
    whole = F.floor(F.col("target")).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    budget = whole - epochs * F.col("source_size") - (F.col("first") + F.col("nth") * F.col("size"))
    return spread.select(
        "doc_id", *extra, "size", "source_size", "target", (epochs * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least("size", budget))).alias("taken")
    )


def selected(docs: DataFrame, labels: DataFrame | None, **shares) -> DataFrame:
    """The rows of docs of which the mix takes words, as often as it takes the whole of them (a part counts as once),
    every column as it came, whatever its name.

    Rows that repeat a doc_id, source and size are one document here; it comes as often as its likeliest row. Rows
    without words never come. An empty table gives an empty result.
    """
    counted = mix(docs.select("doc_id", "text", "source"), labels, extra=("source",), **shares)
    taken = counted.where("taken > 0").groupBy("doc_id", "source", "size").agg(F.max(F.ceil(F.col("taken") / F.col("size"))).cast("long").alias("times"))
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    held = docs.select(row, F.col("doc_id").alias("id"), F.col("source").alias("from"), size)
    same = held["id"].eqNullSafe(taken["doc_id"]) & held["from"].eqNullSafe(taken["source"]) & (held["size"] == taken["size"])
    back = held.join(taken, same).select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return back.select("row.*")
