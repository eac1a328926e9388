"""Set operations over long tables (group, item, count)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark import stages
from quillspark.operators.text import top


def _by_item(rows: DataFrame, group: str, item: str, count: str) -> DataFrame:
    """item, held: what each group has of the item, (group, count) in order of groups. There are few groups, so a row is
    short; what is asked of all groups is asked of these rows, for which Spark reads the same shuffle again."""
    return rows.groupBy(item).agg(F.array_sort(F.collect_list(F.struct(F.col(group).alias("g"), F.col(count).alias("n")))).alias("held"))


def _groups(by_item: DataFrame) -> DataFrame:
    """One row: groups, all of them in order, and their number."""
    named = by_item.select(F.inline("held")).groupBy("g").agg(F.max("n").alias("n"))
    return named.agg(F.array_sort(F.collect_list("g")).alias("groups"))


def jaccard(rows: DataFrame, group: str, item: str) -> DataFrame:
    """a, b, jaccard of all ordered pairs of groups; 1 with itself, 0 where both are empty."""
    own = _by_item(rows.select(group, item).distinct().withColumn("__n", F.lit(1)), group, item, "__n")
    pairs = own.select(F.explode("held").alias("x"), "held").select(F.col("x.g").alias("a"), F.explode("held").alias("y")).groupBy("a", F.col("y.g").alias("b"))
    shared = stages.written(pairs.agg(F.count("*").alias("n")), "shared")  # a row for two groups at most
    size = shared.where("a = b")
    named = lambda k: size.select(F.col("a").alias(k), F.col("n").alias(f"n_{k}"))
    grid = named("a").crossJoin(F.broadcast(named("b")))  # a pair for each two groups is the result itself
    both = F.coalesce("n", F.lit(0))
    share = F.coalesce(F.try_divide(both.cast("double"), F.col("n_a") + F.col("n_b") - both), F.lit(0.0))
    return grid.join(shared, ["a", "b"], "left").select("a", "b", F.when(F.col("a") == F.col("b"), 1.0).otherwise(share).alias("jaccard"))


def shared(rows: DataFrame, group: str, item: str, count: str, least: int) -> DataFrame:
    """item, least, total of the items that every group has `least` times or more."""
    own = _by_item(rows, group, item, count)
    often = F.filter("held", lambda x: x["n"] >= least)
    counts = F.transform(often, lambda x: x["n"])
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)
    kept = own.crossJoin(F.broadcast(_groups(own))).where(F.size(often) == F.size("groups"))  # one row
    return kept.select(item, F.array_min(counts).alias("least"), total.alias("total"))


def unique(rows: DataFrame, group: str, item: str, count: str, least: int, elsewhere: int) -> DataFrame:
    """The rows of `least` or more whose item no other group has `elsewhere` times or more."""
    own = _by_item(rows, group, item, count).select(item, F.explode("held").alias("x"), "held")
    others = F.exists("held", lambda y: (y["g"] != F.col("x.g")) & (y["n"] >= elsewhere))
    return own.where((F.col("x.n") >= least) & ~others).select(F.col("x.g").alias(group), item, F.col("x.n").alias(count))


def differences(rows: DataFrame, group: str, item: str, count: str, missing: bool = False) -> DataFrame:
    """a, b, item, score: the count in a / (1 + count in b) of the items of a, for each ordered pair of groups, of which
    there are few. missing: the items of b that a lacks come too, with score 0."""
    own = _by_item(rows, group, item, count)
    every = own.crossJoin(F.broadcast(_groups(own)))  # one row
    amounts = F.map_from_entries("held")
    sides = every.select(item, amounts.alias("n"), "groups", F.explode("groups" if missing else F.map_keys(amounts)).alias("a"))
    pairs = sides.select("a", F.explode("groups").alias("b"), item, "n").where("a <> b")
    if missing:
        pairs = pairs.where(F.map_contains_key("n", F.col("a")) | F.map_contains_key("n", F.col("b")))
    of = lambda k: F.coalesce(F.try_element_at("n", F.col(k)), F.lit(0))
    return pairs.select("a", "b", item, F.round(of("a") / (1.0 + of("b")), 4).alias("score"))


def differentiating(rows: DataFrame, group: str, item: str, count: str, n: int) -> DataFrame:
    """a, b, item, score, rank: the n items of each pair of groups with the greatest score."""
    return top(differences(rows, group, item, count), ["a", "b"], [F.desc("score"), F.asc(item)], n)


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two array columns as sets; 1 where both are empty. A null is empty, as in SQL's list_concat; only
    a null a beside a b with items gives null, as list_intersect does."""
    items = F.coalesce(b, F.array())
    union = F.size(F.array_union(F.coalesce(a, F.array()), items))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, items)) / union)


def cooccurrence(rows: DataFrame, basket: str, item: str) -> DataFrame:
    """a, b, n: in how many baskets both are; a = b: how many hold the item. Pairs are formed within a basket alone."""
    side = lambda k: rows.select(basket, F.col(item).alias(k))
    return side("a").join(side("b"), basket).where("a <= b").groupBy("a", "b").agg(F.count("*").alias("n"))


def jaccard_distance(pairs: DataFrame) -> DataFrame:
    """a, b, distance (a < b) from co-occurrence counts with the diagonal."""
    own = pairs.where("a = b")
    x, y = own.select("a", F.col("n").alias("n_a")), own.select("b", F.col("n").alias("n_b"))
    both = pairs.where("a < b").join(x, "a").join(y, "b")
    return both.select("a", "b", (1 - F.coalesce(F.try_divide(F.col("n").cast("double"), F.col("n_a") + F.col("n_b") - F.col("n")), F.lit(0.0))).alias("distance"))
