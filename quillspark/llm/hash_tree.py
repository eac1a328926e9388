"""Sharding by a hierarchical weighted hash tree, with DataFrame functions only.

A tree has regions, a region racks, a rack shards, each shard a weight. A row descends from the root: at every level
each child draws -ln(u) / weight, with u a hash of the key, the child's name and its level, and the least draw wins.
A child of weight w among weights W is so drawn with probability w / W, and where the weight of one child grows, rows
move into it alone. `grown` opens a region of one shard for a new shard: no other weight changes, so it takes rows
only into itself.

Defined results: keys may be null (all null keys are one key), texts too (size 1, checksum of no bytes); rows that
repeat another share its shard and get slots of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: (weight of each shard) by rack by region.
Tree = list[list[list[float]]]


def tree(shards: int, per_rack: int = 4, racks: int = 2, weight: float = 1.0) -> Tree:
    """Shards of equal weight in racks of per_rack and regions of that many racks."""
    ids = list(range(shards))
    rack_list = [ids[i : i + per_rack] for i in range(0, shards, per_rack)]
    return [[[weight] * len(r) for r in rack_list[i : i + racks]] for i in range(0, len(rack_list), racks)]


def grown(base: Tree, weight: float = 1.0) -> Tree:
    return [*base, [[weight]]]


def _least(key: Column, level: str, weights: list[float]) -> Column:
    """The number of the child that wins."""

    def draw(i: int, w: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(f"{level}/{i}")), 11) + F.lit(1)).cast("double") / F.lit(float(1 << 53))
        return F.struct((-F.log(u) / F.lit(w)).alias("draw"), F.lit(i).alias("child"))

    draws = [draw(i, w) for i, w in enumerate(weights) if w > 0]
    return F.array_min(F.array(*draws))["child"] if len(draws) > 1 else draws[0]["child"]


def shard_of(key: Column, shape: Tree) -> Column:
    """The shard of a key as an int column; shards are numbered in the tree's order."""
    total = lambda x: x if isinstance(x, float | int) else sum(map(total, x))

    def pick(level: str, children: list, first: int) -> Column:
        if not isinstance(children[0], list):
            return F.lit(first) + _least(key, level, children)
        won = _least(key, level, [float(total(c)) for c in children])
        out, at = None, first
        for i, c in enumerate(children):
            below = pick(f"{level}/{i}", c, at)
            out = F.when(won == i, below) if out is None else out.when(won == i, below)
            at += sum(len(r) for r in c) if isinstance(c[0], list) else len(c)
        return out

    return pick("", shape, 0).cast("int")


def place(rows: DataFrame, shape: Tree, larger: Tree | None = None, parts: int = 4096) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of rows (doc_id, text).

    Equal rows are counted first and spread again at the end; slots are numbered within `parts` hash parts of a shard,
    each of which starts where the parts before it end, so no shard is sorted as a whole.
    """
    key = F.col("doc_id")
    sized = rows.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    kinds = (
        sized.groupBy("doc_id", "size", "text_crc32")
        .agg(F.count("*").alias("copies"))
        .withColumn("shard", shard_of(key, shape))
        .withColumn("grown_shard", shard_of(key, larger or grown(shape)))
        .withColumn("part", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(parts)))
    )
    sums = kinds.groupBy("shard", "part").agg(F.sum("copies").alias("rows"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("shard", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("start") + F.coalesce(F.sum("copies").over(inside), F.lit(0))
    return (
        kinds.join(F.broadcast(starts), ["shard", "part"])  # at most shards * parts rows
        .withColumn("first", first)
        .withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        .select(
            "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("nth")).alias("slot"), "grown_shard"
        )
    )
