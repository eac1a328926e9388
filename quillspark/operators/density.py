"""Clusters by density with noise: a hierarchy of mutual reachability, condensed and cut where clusters last longest.

The steps are frames: nearest neighbours by vector orders (neighbours), edges weighted by the greater of their length and
both ends' core distances, a minimum spanning forest (graphs), its dendrogram, the condensed tree, the choice of clusters.
No step holds all points in one group: the dendrogram is cut by rank into ranges of `RANGE` merges that know what is
joined below them, and pointers are followed by doubling.

With as many neighbours as points and all points in one block the result is the exact one. Parts of the neighbour graph
that aren't connected count as joined at no density at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark import stages
from quillspark.operators import graphs, metrics, neighbours

#: Merges of a range of the dendrogram, and heads of clusters that one task decides.
RANGE = HEADS = 100_000
#: Bits of a point's number below its draw's.
DRAW = 40
#: Least distance, so that equal points have a density.
TINY = 1e-9


def reachability(near: DataFrame, samples: int) -> DataFrame:
    """a, b, w of near (a, b, d): the greater of d and the core distances of both, which are those to the samples-th
    neighbour (the last where there are fewer)."""
    core = near.groupBy("a").agg(F.array_sort(F.collect_list("d")).alias("l")).select("a", F.element_at("l", F.least(F.size("l"), F.lit(samples))).alias("core"))
    pairs = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d").groupBy("a", "b").agg(F.min("d").alias("d"))
    of = lambda k: core.select(F.col("a").alias(k), F.col("core").alias(f"core_{k}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", F.greatest("d", "core_a", "core_b").alias("w"))


def _merges(pdf: pd.DataFrame) -> pd.DataFrame:
    """id, w, lo, hi, n_lo, n_hi, p of a range's edges in order of rank: what each of them joins."""
    above: dict = {}
    facts: dict = {}

    def find(x):
        while (up := above.get(x, x)) != x:
            above[x] = above.get(up, up)
            x = up
        return x

    out = []
    for r in pdf.sort_values("r").itertuples():
        x, y = find(r.u), find(r.v)
        (nx, tx), (ny, ty) = facts.get(x, (r.su, r.tu)), facts.get(y, (r.sv, r.tv))
        above[x] = y
        facts[y] = (nx + ny, r.r)
        out.append((r.r, r.w, tx, ty, nx, ny, r.p))
    return pd.DataFrame(out, columns=["id", "w", "lo", "hi", "n_lo", "n_hi", "p"])


def dendrogram(tree: DataFrame, most: int = RANGE, group: Column | None = None) -> tuple[DataFrame, int]:
    """id, w, lo, hi, n_lo, n_hi, p of a forest's edges (a, b, w), and their number: id is the rank by weight; lo and hi are
    what the edge joins, the id of the edge that joined it last or -1 - point; n_lo and n_hi are their points, p is one.

    Ranges of more than `most` ranks are halved: the lower half stays as it is, and what it joins becomes one vertex in the
    upper half, with its points and its last edge. So each range can be merged by itself. group: numbers from some m
    to 2 m - 1; edges of two groups share no points, and each group is ranked by itself, after those before it.
    """
    one = F.lit(1).cast("long")
    edges, seen = stages.counted(tree.withColumn("g", one if group is None else group.cast("long")), "tree")
    side = lambda p, v: [F.col(v).alias(p), one.alias(f"s{p}"), (-1 - F.col(v)).alias(f"t{p}")]
    rows = graphs.ranked(edges, seen["n"], ["g", "w", "a", "b"]).select("g", "r", "w", F.col("a").alias("p"), *side("u", "a"), *side("v", "b"))
    columns = rows.columns
    while True:
        large, sizes = stages.counted(rows.groupBy("g").agg(F.count("*").alias("n"), F.min("r").alias("first")).where(F.col("n") > most), "ranges")
        if not sizes["n"]:
            break
        middle = stages.sent(large.select("g", (F.col("first") + F.floor(F.col("n") / 2)).alias("middle")), sizes["n"])
        placed = stages.written(rows.join(middle, "g", "left"), "halves")
        whole = placed.where("middle is null").select(*columns)
        lower, upper = placed.where("r < middle"), placed.where("r >= middle")
        node = lambda v: F.struct("g", F.col(v).alias("v"))
        labels = stages.written(graphs.components(lower.select(node("u").alias("a"), node("v").alias("b"))), "joined")
        ended = lambda df: df.join(labels, "node", "left").withColumn("end", F.coalesce("end", "node"))
        vertices = lower.select(node("u").alias("node"), F.col("su").alias("s")).unionByName(lower.select(node("v").alias("node"), F.col("sv").alias("s"))).distinct()
        size = ended(vertices).groupBy("end").agg(F.sum("s").alias("s"))
        last = ended(lower.select(node("u").alias("node"), "r")).groupBy("end").agg(F.max("r").alias("t"))
        facts = ended(vertices.select("node")).join(size.join(last, "end"), "end").select("node", "end", "s", "t")
        for v in ("u", "v"):
            own = facts.select(F.col("node").alias("__node"), F.col("end").alias("__end"), F.col("s").alias("__s"), F.col("t").alias("__t"))
            joined = upper.join(own, node(v) == F.col("__node"), "left")
            new = {v: F.coalesce(F.col("__end.v"), F.col(v)), f"s{v}": F.coalesce("__s", f"s{v}"), f"t{v}": F.coalesce("__t", f"t{v}")}
            upper = joined.withColumns(new).drop("__node", "__end", "__s", "__t")
        halves = [half.withColumn("g", F.col("g") * 2 + bit).select(*columns) for bit, half in ((0, lower), (1, upper))]
        rows = stages.written(whole.unionByName(halves[0]).unionByName(halves[1]), "ranges")
    merged = rows.groupBy("g").applyInPandas(_merges, "id long, w double, lo long, hi long, n_lo long, n_hi long, p long")
    return stages.written(merged, "merges"), seen["n"]


def _decided(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """head, wins of the heads that are left, from those without open heads below upwards."""
    rows = pd.concat(list(batches))
    own, below = dict(zip(rows["head"], rows["stability"])), dict(zip(rows["head"], rows["below"]))
    up = {h: int(u) for h, u in zip(rows["head"], rows["up"]) if not pd.isna(u)}
    waits = dict.fromkeys(own, 0)
    for u in up.values():
        waits[u] = waits.get(u, 0) + 1
    ready, out = [h for h in own if not waits[h]], []
    while ready:
        h = ready.pop()
        out.append((h, own[h] >= below[h]))
        if (u := up.get(h)) in own:
            below[u] += max(own[h], below[h])
            waits[u] -= 1
            if not waits[u]:
                ready.append(u)
    yield pd.DataFrame(out, columns=["head", "wins"])


def _winners(heads: DataFrame, most: int) -> DataFrame:
    """head, wins of heads (head, up, stability): no less stable than the best of what is below. Heads without open ones
    below are decided in rounds; when at most `most` are open, one task decides them."""
    open_, seen = stages.counted(heads.select("head", "up", "stability", F.lit(0.0).alias("below")), "heads")
    done = []
    while seen["n"] > most:
        waiting = open_.where("up is not null").select(F.col("up").alias("head")).distinct()
        ready = stages.written(open_.join(waiting, "head", "left_anti"), "ready")
        done.append(ready.select("head", (F.col("stability") >= F.col("below")).alias("wins")))
        passed = ready.where("up is not null").groupBy(F.col("up").alias("head")).agg(F.sum(F.greatest("stability", "below")).alias("more"))
        rest = open_.join(waiting, "head", "left_semi").join(passed, "head", "left")
        open_, seen = stages.counted(rest.select("head", "up", "stability", (F.col("below") + F.coalesce("more", F.lit(0.0))).alias("below")), "heads")
    out = open_.coalesce(1).mapInPandas(_decided, "head long, wins boolean") if seen["n"] else open_.select("head", F.lit(True).alias("wins"))
    for part in done:
        out = out.unionByName(part)
    return out


def _topmost(heads: DataFrame, wins: Column) -> DataFrame:
    """head, top: the highest winner at or above each head, null where there is none."""
    state = stages.written(heads.select("head", "up", F.when(wins, F.col("head")).alias("top")), "tops")
    while True:
        above = state.select(F.col("head").alias("up"), F.col("up").alias("up2"), F.col("top").alias("top2"))
        step = state.join(above, "up", "left").select("head", F.col("up2").alias("up"), F.coalesce("top2", "top").alias("top"))
        state, seen = stages.counted(step, "tops", open=F.count("up"))
        if not seen["open"]:
            return state.select("head", "top")


def chosen(merges: DataFrame, points: int | DataFrame, least: int, epsilon: float = 0.0, most: int = HEADS) -> DataFrame:
    """point, cluster, density of the points that a cluster has, from the merges of `dendrogram`; all others are noise.

    A side of a merge with fewer than `least` points falls off; where both sides have as many, two clusters begin. A
    cluster's stability is the sum over its points of 1 / w where they leave it, less 1 / w where it began; clusters are
    kept where no choice below is more stable, never the whole. Clusters that began below the distance `epsilon` give
    way to the one above them that began beyond it. points: how many there are, or (draw, n) of each draw.
    """
    thick = lambda w: 1 / F.greatest(w, F.lit(TINY))
    sides = F.array(*[F.struct(F.col(c).alias("node"), F.col(f"n_{c}").alias("n")) for c in ("lo", "hi")])
    splits = (F.col("n_lo") >= least) & (F.col("n_hi") >= least)
    kids = merges.select(F.inline(sides), F.col("id").alias("up"), "w", splits.alias("splits"))
    tops = merges.where(F.col("n_lo") + F.col("n_hi") >= least).join(kids.select(F.col("node").alias("id")), "id", "left_anti")
    held = tops.withColumn("n", F.lit(points)) if isinstance(points, int) else tops.join(points, F.shiftright("p", DRAW) == F.col("draw"))
    # the top of a tree of all points is no cluster
    whole = held.select("id", (F.col("n_lo") + F.col("n_hi") == F.col("n")).alias("whole"))
    none = F.lit(None).cast("long")
    begun = kids.where((F.col("n") >= least) & F.col("splits")).select(F.col("node").alias("head"), F.col("up").alias("above"), F.col("w").alias("birth"))
    begun = begun.withColumn("whole", F.lit(False)).unionByName(whole.select(F.col("id").alias("head"), none.alias("above"), F.lit(float("inf")).alias("birth"), "whole"))
    own = graphs.ends(kids.where((F.col("n") >= least) & ~F.col("splits")).select("node", "up"))
    head_of = stages.written(own.select("node", F.col("end").alias("head")).unionByName(begun.select(F.col("head").alias("node"), "head")), "head-of")
    begun = begun.join(head_of.select(F.col("node").alias("above"), F.col("head").alias("up")), "above", "left")
    small = lambda c: F.when(F.col(f"n_{c}") < least, F.col(f"n_{c}")).otherwise(0)
    left = F.when(splits, F.col("n_lo") + F.col("n_hi")).otherwise(small("lo") + small("hi"))
    leaving = merges.withColumnRenamed("id", "node").join(head_of, "node").select("head", left.alias("left"), thick(F.col("w")).alias("at"))
    sums = leaving.groupBy("head").agg(F.sum(F.col("left") * F.col("at")).alias("total"), F.sum("left").alias("n"))
    stability = F.col("total") - F.col("n") * F.when(F.col("birth") == float("inf"), 0.0).otherwise(thick(F.col("birth")))
    heads = stages.written(begun.join(sums, "head").select("head", "up", "birth", stability.alias("stability"), "whole"), "all-heads")
    roots = heads.where("whole").select(F.col("head").alias("up"), F.lit(True).alias("below_root"))
    heads = heads.where(~F.col("whole")).join(roots, "up", "left").withColumn("up", F.when(F.col("below_root").isNull(), F.col("up"))).drop("whole", "below_root")
    heads = stages.written(heads, "heads")
    decided = stages.written(heads.join(_winners(heads, most), "head"), "decided")
    final = _topmost(decided, F.col("wins"))
    if epsilon > 0:
        wide = (F.col("birth") > epsilon) | F.col("up").isNull()
        climb = graphs.ends(heads.where(~wide).select(F.col("head").alias("node"), "up"))
        above = final.where("top is not null").select(F.col("top").alias("node")).distinct().join(climb, "node", "left").select(F.coalesce("end", "node").alias("head")).distinct()
        final = _topmost(heads.join(above.withColumn("wins", F.lit(True)), "head", "left"), F.col("wins"))
    fallen = graphs.ends(kids.where(F.col("n") < least).select("node", "up")).where("node < 0").withColumnRenamed("node", "leaf")
    at = fallen.join(merges.select(F.col("id").alias("end"), thick(F.col("w")).alias("density")), "end").join(head_of.withColumnRenamed("node", "end"), "end")
    return at.join(final, "head").where("top is not null").select((-1 - F.col("leaf")).alias("point"), F.col("top").alias("cluster"), "density")


def clustered(
    rows: DataFrame, key: str, vector: str, least: int = 10, samples: int | None = None, epsilon: float = 0.0, k: int | None = None,
    orders: int = neighbours.ORDERS, width: int = neighbours.WIDTH, last: int = graphs.LAST, most: int = RANGE,
) -> DataFrame:
    """key, cluster, probability of rows (distinct keys): a cluster is named by its least key, noise by null, with
    probability 0; probability is a point's density against the greatest of its cluster.

    least: points of a cluster, no more than half of all and two at least. samples: neighbours of the core distance
    (`least` unless given). k: neighbours of the graph (15, or as many as samples). Rows without a vector are noise.
    """
    stages.ship(rows.sparkSession)
    kept = rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    points, seen = stages.counted(kept.withColumn("id", F.monotonically_increasing_id()), "points", size=F.max(F.size("v")))
    n = seen["n"]
    none = rows.select(key, F.lit(None).cast(rows.schema[key].dataType).alias("cluster"), F.lit(0.0).alias("probability"))
    if n < 4:
        return none
    least = max(2, min(least, n // 2))
    samples = samples or least
    near = stages.written(neighbours.nearest(points, n, seen["size"], min(n - 1, k or max(15, samples)), orders, width), "near")
    merges, _ = dendrogram(graphs.minimum_forest(reachability(near, samples), last), most)
    own = stages.written(chosen(merges, n, least, epsilon, most), "chosen")
    named = own.join(points.select(F.col("id").alias("point"), "key"), "point")
    about = named.groupBy("cluster").agg(F.min("key").alias("name"), F.max("density").alias("most"))
    found = named.join(about, "cluster").select("key", F.col("name").alias("cluster"), (F.col("density") / F.col("most")).alias("probability"))
    back = rows.select(F.col(key)).join(found.withColumnRenamed("key", "__key"), F.col(key) == F.col("__key"), "left")
    return back.select(key, "cluster", F.coalesce("probability", F.lit(0.0)).alias("probability"))


def _drawn_edges(points: DataFrame, seen: dict, draws: int, k: int, samples: int, orders: int, width: int) -> DataFrame:
    """a, b, w of mutual reachability (see `reachability`) of every draw; a and b have their draw above their number."""
    near, cores = neighbours.in_draws(points, seen["n"], seen["size"], draws, k, samples, orders, width)
    words = [c for c in near.columns if c.startswith("m")]
    pairs = near.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("d").alias("d"), *(F.bit_or(m).alias(m) for m in words))
    of = lambda c: cores.select(F.col("a").alias(c), F.col("cores").alias(f"cores_{c}"))
    met = pairs.join(of("a"), "a").join(of("b"), "b")
    core = lambda c, j: F.nanvl(F.col(f"cores_{c}")[j], F.lit(0.0))
    weight = lambda j: F.greatest("d", core("a", j), core("b", j))
    listed = F.array(*[F.when(F.getbit(words[j // neighbours.WORD], F.lit(j % neighbours.WORD)) == 1, F.struct(F.lit(j).cast("long").alias("draw"), weight(j).alias("w"))) for j in range(draws)])
    each = met.select("a", "b", F.explode(listed).alias("e")).where("e is not null")
    named = lambda c: (F.shiftleft("e.draw", DRAW) + F.col(c)).alias(c)
    return each.select(named("a"), named("b"), "e.w")


def _short(rows: DataFrame, vector: str) -> Column:
    """The vector as it is where it has floats, else in doubles."""
    return F.col(vector) if rows.schema[vector].dataType.simpleString() == "array<float>" else F.col(vector).cast("array<double>")


def reclustered(
    rows: DataFrame, key: str, label: str, vector: str, noise: int = -1, draws: int = 100, share: float = 0.8, least: int = 10, seed: int = 42, k: int | None = None,
    orders: int = neighbours.ORDERS, width: int = neighbours.WIDTH,
) -> DataFrame:
    """draw, n, ari: how far clusters of subsamples agree with the labels, over the points that both have in clusters.

    Each draw takes the points whose hash with the draw's number is below `share`, noise left out. All draws are clustered
    in one plan: points carry flags of their draws, and only points of one draw are neighbours. Draws with fewer than two points in clusters, and
    tables of fewer than ten points, give no rows.
    """
    stages.ship(rows.sparkSession)
    kept = rows.where((F.col(label) != noise) & F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(label).alias("label"), _short(rows, vector).alias("v"))
    all_, seen = stages.counted(kept, "labelled", size=F.max(F.size("v")))
    if seen["n"] < 10:
        return rows.select(F.lit(0).alias("draw"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("ari")).limit(0)
    flag = lambda j: F.pmod(F.xxhash64("key", j.cast("long"), F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20))
    word = lambda i: sum((F.when(flag(F.lit(j)), F.lit(1 << j - i).cast("long")).otherwise(0) for j in range(i, min(i + neighbours.WORD, draws))), F.lit(0).cast("long"))
    numbered = graphs.ranked(all_, seen["n"], ["key"], "id").withColumn("draws", F.array(*[word(i) for i in range(0, draws, neighbours.WORD)]))
    points = stages.written(numbered, "draws")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long")))
    at, bit = F.floor(F.col("draw") / neighbours.WORD).cast("int"), (F.col("draw") % neighbours.WORD).cast("int")
    taken = points.select("id", "label", "draws", each.alias("draw")).where(F.getbit(F.get("draws", at), bit) == 1)
    taken = taken.select("draw", (F.shiftleft("draw", DRAW) + F.col("id")).alias("point"), "label")
    sub = int(seen["n"] * share)
    least = max(2, min(least, sub // 3))
    # a block has as many points of a draw as it would have by itself
    edges, found = stages.counted(_drawn_edges(points, seen, draws, k or max(15, least), least, orders, -(-width * 100 // int(100 * share))), "draw-edges")
    draw = F.shiftright("a", DRAW)
    merges, _ = dendrogram(graphs.minimum_forest(graphs.thinned(edges, found["n"], draw)), group=draw + draws)
    found = chosen(merges, taken.groupBy("draw").agg(F.count("*").alias("n")), least)
    both = taken.join(found.select("point", "cluster"), "point")
    return metrics.adjusted_rand_by(both, "draw", "label", "cluster").where("n >= 2")


def stability(rows: DataFrame, key: str, label: str, vector: str, noise: int = -1, **options) -> DataFrame:
    """One row: ari_mean, ari_std (of the population of draws), n_valid_points; 0 where no draw counts (see reclustered)."""
    found = reclustered(rows, key, label, vector, noise, **options)
    points = rows.agg(F.count_if((F.col(label) != noise) & F.col(vector).isNotNull()).alias("n_valid_points"))
    facts = found.agg(F.coalesce(F.avg("ari"), F.lit(0.0)).alias("ari_mean"), F.coalesce(F.stddev_pop("ari"), F.lit(0.0)).alias("ari_std"))
    return facts.crossJoin(F.broadcast(points))  # one row each
