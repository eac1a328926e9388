"""Graphs as frames: ends of pointers, components, minimum spanning forests and ranks, all in rounds of joins.

Each round is written (quillspark.stages), and halves what is left at least; joins on a node that many edges share are
left to adaptive execution, which splits them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark import stages

#: Edges that are left to one task, as fewer rounds are then needed.
LAST = 200_000
#: Edges of which one task keeps a forest.
PART = 1_000_000


def ends(pointers: DataFrame) -> DataFrame:
    """node, end of pointers (node, up; no circles): where the way from node to node ends. Each round doubles the steps."""
    found = pointers.select("node", F.col("up").alias("end"))
    while True:
        further = found.select(F.col("node").alias("end"), F.col("end").alias("next"))
        step = found.join(further, "end", "left").select("node", F.coalesce("next", "end").alias("end"), F.col("next").isNotNull().alias("moved"))
        done, seen = stages.counted(step, "ends", moved=F.count_if("moved"))
        found = done.select("node", "end")
        if not seen["moved"]:
            return found


def _relabelled(edges: DataFrame, labels: DataFrame, sides: tuple[str, str]) -> DataFrame:
    for side in sides:
        renamed = labels.select(F.col("node").alias("__node"), F.col("end").alias("__end"))
        edges = edges.join(renamed, F.col(side) == F.col("__node"), "left").withColumn(side, F.coalesce("__end", side)).drop("__node", "__end")
    return edges.where(F.col(sides[0]) != F.col(sides[1]))


def components(links: DataFrame) -> DataFrame:
    """node, end of links (a, b): the least node that is reached, for every node but those least ones."""
    live, seen = stages.counted(links.select("a", "b").where("a <> b"), "links")
    labels = None
    while seen["n"]:
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lower = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")).where("up < node")
        own = ends(stages.written(lower, "hooks"))
        moved = own.select(F.col("node").alias("end"), F.col("end").alias("next"))
        labels = own if labels is None else labels.join(moved, "end", "left").select("node", F.coalesce("next", "end").alias("end")).unionByName(own)
        live, seen = stages.counted(_relabelled(live, own, ("a", "b")).distinct(), "links")
    if labels is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("end"))
    return labels


def _kruskal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges (ca, cb, w, a, b), in order of w, that join what wasn't joined before."""
    above: dict = {}

    def find(x):
        while (up := above.get(x, x)) != x:
            above[x] = above.get(up, up)
            x = up
        return x

    for pdf in batches:
        keep = []
        for ca, cb in zip(pdf["ca"], pdf["cb"]):
            x, y = find(ca), find(cb)
            keep.append(x != y)
            above[x] = y
        yield pdf.loc[keep, ["a", "b", "w"]]


def minimum_forest(edges: DataFrame, last: int = LAST) -> DataFrame:
    """a, b, w of the edges (a, b, w) of a minimum spanning forest; equal weights go by a, then b.

    Boruvka's rounds: each component takes its least edge, and the components that meet become one. When at most `last`
    edges between components are left, one task takes the rest in order.
    """
    first = edges.select(F.col("a").alias("ca"), F.col("b").alias("cb"), "w", "a", "b").where("a <> b")
    live, seen = stages.counted(first, "edges")
    taken = []
    while seen["n"] > last:
        edge = F.struct("w", "a", "b")
        sides = [live.select(F.col(c).alias("c"), F.col(o).alias("other"), edge.alias("e")) for c, o in (("ca", "cb"), ("cb", "ca"))]
        best = stages.written(sides[0].unionByName(sides[1]).groupBy("c").agg(F.min(F.struct("e", "other")).alias("m")).select("c", "m.e", "m.other"), "least-edges")
        taken.append(best.select("e.a", "e.b", "e.w").distinct())
        back = best.select(F.col("c").alias("other"), F.col("other").alias("back"))
        met = best.join(back, "other").where((F.col("back") != F.col("c")) | (F.col("c") > F.col("other")))
        labels = ends(stages.written(met.select(F.col("c").alias("node"), F.col("other").alias("up")), "hooks"))
        live, seen = stages.counted(_relabelled(live, labels, ("ca", "cb")), "edges")
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema}
    rest = live.coalesce(1).sortWithinPartitions("w", "a", "b").mapInPandas(_kruskal, f"a {kinds['a']}, b {kinds['b']}, w {kinds['w']}")
    for part in taken:
        rest = rest.unionByName(part)
    return rest


def thinned(edges: DataFrame, n: int, group: Column, most: int = PART) -> DataFrame:
    """The n edges (a, b, w) without those that no minimum spanning forest has, as they close a circle of lesser ones among the
    edges of their group or, where groups may have more than `most`, of a part of it."""
    parts = max(1, -(-n // most))
    share = F.pmod(F.xxhash64("a", "b"), F.col("__n")).alias("__part")
    sizes = edges.groupBy(group.alias("__g")).agg(F.ceil(F.count("*") / most).alias("__n"))
    dealt = edges.withColumn("__g", group).join(sizes, "__g").select("__g", share, "a", "b", "w")
    sorted_ = dealt.repartition(parts, "__g", "__part").sortWithinPartitions("__g", "__part", "w", "a", "b")
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema}

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, above = None, {}

        def find(x):
            while (up := above.get(x, x)) != x:
                above[x] = above.get(up, up)
                x = up
            return x

        for pdf in batches:
            kept = []
            for g, part, a, b in zip(pdf["__g"], pdf["__part"], pdf["a"], pdf["b"]):
                if (g, part) != of:
                    of = (g, part)
                    above.clear()
                x, y = find(a), find(b)
                kept.append(x != y)
                above[x] = y
            yield pdf.loc[kept, ["a", "b", "w"]]

    return sorted_.mapInPandas(keep, f"a {kinds['a']}, b {kinds['b']}, w {kinds['w']}")


def ranked(rows: DataFrame, n: int, order: list[str], name: str = "r") -> DataFrame:
    """The n rows with their rank from 0 in order, without a sort in one partition: parts are sorted, and each begins
    where the parts before it end."""
    parts = max(1, -(-n // stages.ROWS))
    own = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order) if parts > 1 else rows.coalesce(1).sortWithinPartitions(*order)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = stages.written(own.withColumn("__part", F.spark_partition_id()).withColumn("__at", inside), "ranked")
    begins, at = {}, 0
    for r in placed.groupBy("__part").count().orderBy("__part").collect():  # as many rows as there are parts
        begins[r["__part"]] = at
        at += r["count"]
    starts = F.create_map(*[F.lit(x).cast("long") for kv in (begins or {0: 0}).items() for x in kv])
    return placed.withColumn(name, F.element_at(starts, F.col("__part").cast("long")) + F.col("__at")).drop("__part", "__at")
