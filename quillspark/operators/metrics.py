"""Quality of classifications and clusterings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark import stages
from quillspark.operators import graphs


def f1_by_class(rows: DataFrame, truth: str, pred: str, classes: list) -> DataFrame:
    """class, tp, fp, fn, f1 of each class in one pass; 0 where a class never comes."""
    t, p = F.col(truth), F.col(pred)
    each = F.explode(F.array(*[F.lit(c) for c in classes])).alias("class")
    counted = rows.select(t, p, each).groupBy("class").agg(
        F.count_if((t == F.col("class")) & (p == F.col("class"))).alias("tp"),
        F.count_if((t != F.col("class")) & (p == F.col("class"))).alias("fp"),
        F.count_if((t == F.col("class")) & (p != F.col("class"))).alias("fn"),
    )
    return counted.withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)))


def f1_summary(rows: DataFrame, truth: str, pred: str, classes: list) -> DataFrame:
    """One row: macro (mean F1 of the classes) and weighted (by how often each is true) F1."""
    per = f1_by_class(rows, truth, pred, classes).withColumn("support", F.col("tp") + F.col("fn"))
    weighted = F.coalesce(F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")), F.lit(0.0))
    return per.agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro"), weighted.alias("weighted"))


def _choose2(x: Column) -> Column:
    return x * (x - 1) / 2


def adjusted_rand(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: ari of two labellings from their contingency table."""
    cells = rows.groupBy(a, b).agg(F.count("*").alias("n"))
    both = cells.agg(F.sum(_choose2(F.col("n"))).alias("both"), F.sum("n").alias("total"))
    row_sums = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(_choose2(F.col("n"))).alias("in_a"))
    column_sums = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(_choose2(F.col("n"))).alias("in_b"))
    expected = F.col("in_a") * F.col("in_b") / _choose2(F.col("total"))
    most = (F.col("in_a") + F.col("in_b")) / 2
    return both.crossJoin(row_sums).crossJoin(column_sums).select(
        F.coalesce(F.try_divide(F.col("both") - expected, most - expected), F.lit(1.0)).alias("ari")
    )


def adjusted_rand_by(rows: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """by, n, ari of two labellings of each group of rows."""
    return rand_of_cells(rows.groupBy(by, a, b).agg(F.count("*").alias("n")), by, a, b)


def rand_of_cells(cells: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """The same from the table of counts n by group and both labels."""
    both = cells.groupBy(by).agg(F.sum(_choose2(F.col("n"))).alias("both"), F.sum("n").alias("n"))
    side = lambda c, name: cells.groupBy(by, c).agg(F.sum("n").alias("n")).groupBy(by).agg(F.sum(_choose2(F.col("n"))).alias(name))
    expected = F.coalesce(F.try_divide(F.col("in_a") * F.col("in_b"), _choose2(F.col("n"))), F.lit(0.0))
    most = (F.col("in_a") + F.col("in_b")) / 2
    ari = F.coalesce(F.try_divide(F.col("both") - expected, most - expected), F.lit(1.0))
    return both.join(side(a, "in_a"), by).join(side(b, "in_b"), by).select(by, "n", ari.alias("ari"))


def average_ranks(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows with r_<column>: their rank from 1 by each column, ties sharing their mean; a null has no rank.

    Ranks come from sorted parts that each begin where the parts before end, so no task sorts all rows.
    """
    held, seen = stages.counted(rows, "unranked")
    out = held
    for c in columns:
        places = graphs.ranked(held.where(F.col(c).isNotNull()).select(c), seen["n"], [c], "__r")
        mean = places.groupBy(F.col(c).alias("__v")).agg((F.avg("__r") + 1).alias(f"r_{c}"))
        out = out.join(mean, F.col(c) == F.col("__v"), "left").drop("__v")
    return out


def bootstrapped_rand(rows: DataFrame, key: str, labels: list[str], draws: int = 50, share: float = 0.8, seed: int = 42) -> DataFrame:
    """One row: mean, low, high (2.5 and 97.5 %) of the Rand index of two of the labellings over draws of rows with
    replacement, and n_draws, how many count.

    A draw takes each row as often as a Poisson variable of mean `share` says, by hash of its key and the draw, and two
    columns of labels by hash of the draw; so all draws are one table of counts. Draws in which a labelling has one label
    don't count. Fewer than ten rows or two labellings give 0.
    """
    uniform = lambda *x: F.pmod(F.xxhash64(*x, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    # how often a row is drawn: the number of steps of the distribution that its draw passes
    steps, below, p = [], 0.0, math.exp(-share)
    for k in range(1, 25):
        below += p
        steps.append(below)
        p *= share / k
    u = uniform(F.col("__key"), F.col("draw"))
    times = sum(((u >= b).cast("long") for b in steps[1:]), (u >= steps[0]).cast("long"))
    first = F.floor(uniform(F.lit("first"), F.col("draw")) * len(labels)).cast("int")
    second = F.floor(uniform(F.lit("second"), F.col("draw")) * (len(labels) - 1)).cast("int")
    named = F.array(*[F.col(c).cast("string") for c in labels])
    drawn = rows.select(F.col(key).alias("__key"), named.alias("l"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    placed = drawn.withColumn("n", times).where("n > 0").withColumn("a", first).withColumn("b", second + (second >= first).cast("int"))
    cells = placed.groupBy("draw", F.get("l", F.col("a")).alias("a"), F.get("l", F.col("b")).alias("b")).agg(F.sum("n").alias("n"))
    held = stages.written(cells, "drawn-labels")  # one row for each draw and pair of labels
    varied = held.groupBy("draw").agg(F.count_distinct("a").alias("in_a"), F.count_distinct("b").alias("in_b")).where("in_a > 1 and in_b > 1")
    found = rand_of_cells(held.join(varied.select("draw"), "draw", "left_semi"), "draw", "a", "b").select(F.round("ari", 4).alias("ari"))
    enough = rows.agg((F.count("*") >= 10).alias("enough"))
    facts = found.agg(F.avg("ari").alias("m"), F.percentile("ari", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count("*").alias("k")).crossJoin(F.broadcast(enough))  # one row each
    counts = F.col("enough") & F.lit(len(labels) > 1) & (F.col("k") > 0)
    value = lambda c: F.when(counts, F.round(c, 4)).otherwise(0.0)
    return facts.select(value(F.col("m")).alias("mean"), value(F.col("q")[0]).alias("low"), value(F.col("q")[1]).alias("high"), F.when(counts, F.col("k")).otherwise(0).alias("n_draws"))
