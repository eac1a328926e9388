"""Near-duplicate documents by circulant MinHash.

Two permutations make every coordinate of a signature. The first, sigma, is a bijection of 64-bit shingle hashes
of which 32 bits are kept; the second, pi, is a bijection of 32-bit integers. Coordinate k of a set is the least
pi(sigma(x) + k) over its members: pi circularly shifted by k places. Rows of the signature are hashed to bands,
documents that share a band are candidates, and a link is confirmed on the full shingle sets.

No bucket is capped and none is expanded into all its pairs; one rule holds for buckets of every size:

* documents of equal sets are one class, for which the smallest doc_id stands;
* every bucket compares its members with one of them; the links found make components, which hold most groups together;
* then, in each bucket that spans several components, the members outside its commonest component are compared with
  all members, by blocks of sketches dealt by bucket and block; only pairs that join two components and may be links
  are looked at in full, the likeliest of each member first, then all that still join two components.

So every pair of a bucket is either confirmed or ruled out on its sketch or its sizes, or lies within one component.
Tables of pairs and links are read in as many partitions as their rows need, so small ones move without exchanges.

Defined results: null and empty texts have no shingles, are linked with nothing and are kept. Texts with a null
doc_id, and all but one of the different texts under one doc_id, never stand for a component that has other ids; each
is decided for itself. Rows that repeat a doc_id and its set are one document, reported as often as given. Other
columns, whatever their names, are ignored by `classes` and passed on by `keep_one`. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm import words
from quillspark.llm.tables import counted, gathered, sent, written

ROWS, BANDS = 6, 48
#: Coordinates of which one byte each is kept, to reject most candidates without their texts. A pair at the
#: threshold agrees in 192 +- 7 of them; fewer than AGREE (five deviations less) means it is no link.
SKETCH, AGREE = 256, 158
#: Nodes from here on are sets whose doc_id is null or names another set too.
UNNAMED = 1 << 62
#: Members of a block, and partners in another component that each member is first compared with.
BLOCK, FIRST = 256, 2
#: Members of buckets that span components get a longer sketch, of which a pair at the threshold agrees in 769 +- 14.
LONG, LONG_AGREE = 1024, 700
#: Pairs that one task looks at in full, members of buckets whose blocks one task compares, and bytes of sets it remembers.
PAIRS, MEMBERS, REMEMBERED = 4000, 4000, 32 << 20
#: Rows with sketches count as so many rows of numbers where tables are gathered (64 MB of them a partition at most).
WIDE = 4
U32 = np.uint32
#: What tells sets apart: their size and two sums of their hashes.
KEY = ["n_shingles", "set_a", "set_b"]


def _pi(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit integers, in place."""
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        np.right_shift(x, U32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        np.multiply(x, U32(factor), out=x)
    np.right_shift(x, U32(16), out=spare)
    return np.bitwise_xor(x, spare, out=x)


def signatures(sets: list[np.ndarray], size: int = ROWS * BANDS, step: int = 1 << 15) -> np.ndarray:
    """One row per set (none may be empty), one column per shift of the second permutation."""
    out = np.full((len(sets), size), 0xFFFFFFFF, U32)
    if not sets:
        return out
    members = np.concatenate(sets)
    sigma = (words.mix64(members + np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(U32)
    own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for lo in range(0, len(sigma), step):
        part, docs = sigma[lo : lo + step], own[lo : lo + step]
        first = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
        rows = docs[first]
        x, spare = np.empty_like(part), np.empty_like(part)
        least = np.empty((size, len(first)), U32)
        for k in range(size):
            np.add(part, U32(k), out=x)
            least[k] = np.minimum.reduceat(_pi(x, spare), first)
        out[rows] = np.minimum(out[rows], least.T)
    return out


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n, size = signature.shape
    acc = np.tile(np.arange(1, size // rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (n, 1))
    for j in range(rows):
        acc = words.mix64(acc ^ signature[:, j::rows].astype(np.uint64))
    return acc.astype(np.int64)


_FEATURES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text_hash", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("set_a", T.LongType()),
        T.StructField("set_b", T.LongType()),
        T.StructField("sketch", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ]
)


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ids, texts = pdf["doc_id"].to_numpy(), pdf["text"].tolist()
        for first, block in words.blocks(texts):
            sets = words.shingle_sets(block)
            full = [i for i, s in enumerate(sets) if len(s)]
            sig = signatures([sets[i] for i in full])
            keys, sketch = bands(sig), sig[:, :SKETCH].astype(np.uint8)
            row = {i: j for j, i in enumerate(full)}
            a = [int(np.bitwise_xor.reduce(s).view(np.int64)) if len(s) else None for s in sets]
            b = [int(np.sum(words.mix64(s), dtype=np.uint64).view(np.int64)) if len(s) else None for s in sets]
            yield pd.DataFrame(
                {
                    "doc_id": pd.array(ids[first : first + len(block)], dtype="Int64"),
                    "text_hash": pdf["text_hash"].to_numpy()[first : first + len(block)],
                    "n_shingles": [len(s) for s in sets],
                    "set_a": pd.array(a, dtype="Int64"),
                    "set_b": pd.array(b, dtype="Int64"),
                    "sketch": [sketch[row[i]].tobytes() if i in row else None for i in range(len(sets))],
                    "bands": [keys[row[i]] if i in row else None for i in range(len(sets))],
                }
            )


def _agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many places each row of x agrees with the row of y."""
    return (x == y).sum(axis=1)


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _likely(threshold: float):
    """Of pairs a, b with both sketches and sizes those that may be links."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sizes = np.stack([batch["size_a"].to_numpy(), batch["size_b"].to_numpy()])
                may = sizes.min(axis=0) >= threshold * sizes.max(axis=0)
                may &= _agree(_sketches(batch["sketch_a"]), _sketches(batch["sketch_b"])) >= AGREE
                yield batch.select(["a", "b"]).filter(pa.array(may))

    return compare


def _overlaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The shared and the joint number of shingles of each pair; recent sets are remembered."""
    seen: dict[int, np.ndarray] = {}
    held = 0
    for pdf in batches:
        shared, joint = [], []
        for a, b, x, y in zip(pdf["a"], pdf["b"], pdf["text_a"], pdf["text_b"]):
            if held > REMEMBERED:
                seen.clear()
                held = 0
            for node, text in ((a, x), (b, y)):
                if node not in seen:
                    seen[node] = words.shingle_sets([words.normalised(text)])[0]
                    held += seen[node].nbytes
            s, t = seen[a], seen[b]
            n = len(np.intersect1d(s, t, assume_unique=True))
            shared.append(n)
            joint.append(len(s) + len(t) - n)
        yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "shared": shared, "joint": joint})


def _spread(df: DataFrame, n: int, each: int) -> int:
    """How many tasks n rows of work make, one for each core at least."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-n // each))


def _verified(pairs: DataFrame, n: int, texts: DataFrame, threshold: float, name: str) -> tuple[DataFrame, dict]:
    """a, b, shared, joint, linked of all n pairs (a < b) from their full sets; counts n and linked."""
    text = lambda k: texts.select(F.col("node").alias(k), F.col("text").alias(f"text_{k}"))
    both = gathered(pairs, n).join(text("b"), "b").join(text("a"), "a").select("a", "b", "text_a", "text_b")
    found = both.coalesce(_spread(pairs, n, PAIRS)).mapInPandas(_overlaps, "a long, b long, shared long, joint long")
    return counted(found.withColumn("linked", F.col("shared") >= threshold * F.col("joint")), name, linked=F.count_if("linked"))


def _stars(links: DataFrame, n: int) -> tuple[DataFrame, int]:
    """a, b (the smallest node of its component) of every node of the n links a, b but the smallest; and their number.

    Large-star and small-star in turn, until the edges stay as they are.
    """
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    edges, seen = counted(gathered(down, n).distinct(), "edges", mark=mark)
    while seen["n"]:
        both = gathered(edges, seen["n"]).select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        both = both.select("e.a", "e.b")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: neighbours above a node hang on the node's least neighbour
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # small star: a node and its lower neighbours hang on the least of them
        large = gathered(large, 2 * seen["n"])
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        before = seen
        edges, seen = counted(large.join(low, "a").select(hung).select("e.a", "e.b").where("a <> b").distinct(), "edges", mark=mark)
        if seen == before:
            break
    return edges, seen["n"]


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of the links a, b."""
    links, seen = counted(links.select("a", "b"), "links")
    stars, _ = _stars(links, seen["n"])
    ends = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("component")), F.struct(F.col("b").alias("node"), F.col("b").alias("component")))
    alone = links.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component")).join(stars, F.col("node") == F.col("a"), "left_anti")
    return stars.select(F.explode(ends).alias("e")).select("e.node", "e.component").union(alone).distinct()


def _spanning(large: DataFrame, n: int, stars: DataFrame, n_stars: int) -> tuple[DataFrame, int]:
    """bucket, m, n, c (its component), most of the members of buckets that span components; and their number."""
    of = gathered(stars.select(F.col("a").alias("m"), F.col("b").alias("component")), n_stars)
    named = gathered(large, n).join(of, "m", "left").select("bucket", "m", "n", F.coalesce("component", "m").alias("c"))
    named = gathered(named, n)
    counts = named.groupBy("bucket", "c").agg(F.count("*").alias("k"))
    most = counts.groupBy("bucket").agg(F.max_by("c", F.struct("k", "c")).alias("most"), F.count("*").alias("cs")).where("cs > 1")
    members, seen = counted(named.join(most, "bucket").drop("cs"), "members")
    return members, seen["n"]


def _longer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        nodes, texts = pdf["node"].to_numpy(), pdf["text"].tolist()
        for first, block in words.blocks(texts):
            sets = words.shingle_sets(block)
            sig = signatures(sets, LONG)
            keys, sketch = bands(sig[:, : ROWS * BANDS]), sig.astype(np.uint8)
            yield pd.DataFrame(
                {"m": nodes[first : first + len(block)], "size": [len(x) for x in sets], "sketch": [r.tobytes() for r in sketch], "bands": list(keys)}
            )


def _across(members: DataFrame, n: int, longer: DataFrame, n_longer: int, limit: int | None, threshold: float) -> DataFrame:
    """Pairs of a bucket that lie in two components and may be links; with a limit the likeliest of each member."""
    member = (
        gathered(gathered(members, n, WIDE).join(gathered(longer, n_longer, WIDE), "m"), n, WIDE)
        .withColumn("chunks", F.ceil(F.col("n") / BLOCK))
        .withColumn("chunk", F.pmod(F.xxhash64("m"), F.col("chunks")))
        .withColumn("x", F.struct("m", "c", F.col("c") != F.col("most"), "size", "sketch", "bands"))
    )

    def blocks(rows: DataFrame, side: str) -> DataFrame:
        return rows.groupBy("bucket", "chunk").agg(F.collect_list("x").alias(side), F.max("chunks").alias("chunks"))

    xs = blocks(member.where("c <> most"), "xs").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("chunks")
    both = xs.join(blocks(member, "ys").drop("chunks"), ["bucket", "chunk"]).select("bucket", "xs", "ys")
    return both.repartition(_spread(members, n, MEMBERS)).mapInArrow(_plausible(limit, threshold), "a long, b long")


def _plausible(limit: int | None, threshold: float):
    def side(found: pa.Scalar) -> tuple[np.ndarray, ...]:
        m, c, outside, size, sketch, bands = found.values.flatten()
        as_array = lambda x: x.to_numpy(zero_copy_only=False)
        return as_array(m), as_array(c), as_array(outside), as_array(size), _sketches(sketch), as_array(bands.flatten()).reshape(len(m), -1)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for bucket, xs, ys in zip(batch["bucket"].to_pylist(), batch["xs"], batch["ys"]):
                x_id, x_own, _, x_size, x_sketch, x_bands = side(xs)
                y_id, y_own, y_outside, y_size, y_sketch, y_bands = side(ys)
                agree = np.stack([_agree(y_sketch[:, :SKETCH], x) for x in x_sketch[:, :SKETCH]])
                agree[x_own[:, None] == y_own[None, :]] = 0
                agree[np.minimum.outer(x_size, y_size) < threshold * np.maximum.outer(x_size, y_size)] = 0
                if limit and limit < agree.shape[1]:
                    agree[agree < -np.partition(-agree, limit - 1, axis=1)[:, limit - 1 : limit]] = 0
                elif not limit:  # a pair of two members outside is met from both sides
                    agree[y_outside[None, :] & (x_id[:, None] > y_id[None, :])] = 0
                i, j = np.nonzero(agree >= AGREE)
                near = _agree(x_sketch[i], y_sketch[j]) >= LONG_AGREE
                i, j = i[near], j[near]
                if not limit:  # of the buckets that a pair shares, that of its first common band passes it on
                    same = x_bands[i] == y_bands[j]
                    once = x_bands[i, same.argmax(axis=1)] == bucket
                    i, j = i[once], j[once]
                found.append(np.stack([np.minimum(x_id[i], y_id[j]), np.maximum(x_id[i], y_id[j])]))
            if found:
                a, b = np.unique(np.concatenate(found, axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return compare


def classes(docs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text)."""
    return _classes(docs, threshold).drop("text_hash")


def _sets(rows: DataFrame) -> tuple[DataFrame, dict]:
    """A row for each set of shingles, with the doc_id and the text that stand for it, and its node; counts n and unnamed."""
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("least")
    same = [F.first(c).alias(c) for c in ("sketch", "bands")]  # equal in all rows of a set
    found = rows.where("n_shingles > 0").groupBy(*KEY).agg(least, *same)
    found = found.select(*KEY, F.col("least.doc_id").alias("rep"), F.col("least.text_hash").alias("rep_hash"), "sketch", "bands")
    own = found.where("rep is not null").groupBy("rep").agg(F.min(F.struct(*KEY)).alias("own"))
    unnamed = F.xxhash64(*KEY).bitwiseAND(F.lit(UNNAMED - 1)).bitwiseOR(F.lit(UNNAMED))
    node = F.when(F.struct(*KEY) == F.col("own"), F.col("rep")).otherwise(unnamed)
    return counted(found.join(own, "rep", "left").withColumn("node", node).drop("own"), "sets", unnamed=F.count_if(F.col("node") >= UNNAMED))


def _linked(sets: DataFrame, n_sets: int, hashed: DataFrame, threshold: float) -> tuple[DataFrame, int]:
    """The stars of all links between the sets."""
    member = sets.select(F.explode("bands").alias("bucket"), F.col("node").alias("m"))
    crowded = member.groupBy("bucket").agg(F.count("*").alias("n"), F.min("m").alias("leader")).where("n > 1")
    sized, seen = counted(member.join(crowded, "bucket"), "buckets")
    n = seen["n"]
    every = sets.select("node", F.col("n_shingles").alias("size"), "sketch", "rep", "rep_hash")
    candidates = gathered(sized, n).select(F.col("m").alias("node")).distinct()
    sketches, seen = counted(gathered(every, n_sets, WIDE).join(candidates, "node", "left_semi"), "sketches")
    n_sketches = seen["n"]
    chosen = sent(sketches.select("node", "rep", "rep_hash"), n_sketches)
    stands = F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("text_hash") == F.col("rep_hash"))
    # rows that repeat a text that stands for a set have equal texts
    texts = written(hashed.join(chosen, stands).select("node", "text"), "texts")
    texts = texts.groupBy("node").agg(F.first("text").alias("text"))
    leader = gathered(sized, n).where("m <> leader").select(F.col("leader").alias("a"), F.col("m").alias("b")).distinct()
    part = lambda k: gathered(sketches, n_sketches, WIDE).select(F.col("node").alias(k), F.col("size").alias(f"size_{k}"), F.col("sketch").alias(f"sketch_{k}"))
    both = gathered(leader.join(part("a"), "a"), n, WIDE).join(part("b"), "b")
    likely, seen = counted(both.mapInArrow(_likely(threshold), "a long, b long"), "likely")
    known, seen = _verified(likely, seen["n"], texts, threshold, "pairs")
    n_known = seen["n"]
    stars, n_stars = _stars(known.where("linked"), seen["linked"])
    large, longer, n_longer = sized.where("n > 2").drop("leader"), None, 0
    for limit in (FIRST, None):
        members, n_members = _spanning(large, n, stars, n_stars)
        if not n_members:
            break
        if longer is None:  # later passes have no members besides
            crowd = gathered(members, n_members).select(F.col("m").alias("node")).distinct()
            longer, seen = counted(texts.join(crowd, "node", "left_semi").mapInPandas(_longer, "m long, size long, sketch binary, bands array<long>"), "longer")
            n_longer = seen["n"]
        pairs, seen = counted(_across(members, n_members, longer, n_longer, limit, threshold), "plausible")
        fresh = gathered(pairs, seen["n"]).distinct().join(gathered(known.select("a", "b"), n_known), ["a", "b"], "left_anti")
        fresh, seen = counted(fresh, "fresh")
        if not seen["n"]:
            continue
        new, seen = _verified(fresh, seen["n"], texts, threshold, "across")
        known, n_known = known.unionByName(new), n_known + seen["n"]
        if seen["linked"]:
            links = stars.unionByName(new.where("linked").select("a", "b"))
            stars, n_stars = _stars(links, n_stars + seen["linked"])
    return stars, n_stars


def _classes(docs: DataFrame, threshold: float) -> DataFrame:
    """What `classes` gives, with the hash of each row's text."""
    hashed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    rows = written(hashed.mapInPandas(_features, _FEATURES), "features")
    sets, seen = _sets(rows)
    n_sets = seen["n"]
    stars, n_stars = _linked(sets, n_sets, hashed, threshold)
    of = gathered(stars.select(F.col("a").alias("node"), F.col("b").alias("component")), n_stars)
    top = gathered(sets.select(*KEY, "rep", "node"), n_sets).join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    component_id = F.col("component")
    if seen["unnamed"]:
        # the ids of components that only unnamed sets make; other rows have keys of their own, which match nothing
        asked = F.when(F.col("component") >= UNNAMED, F.col("component")).otherwise(-1 - F.abs("node"))
        named = sets.where(F.col("node") >= UNNAMED).select(F.col("node").alias("asked"), F.col("rep").alias("unnamed_id"))
        top = top.withColumn("asked", asked).join(named, "asked", "left")
        component_id = F.when(F.col("component") >= UNNAMED, F.col("unnamed_id")).otherwise(F.col("component"))
    top = top.select(*KEY, "rep", (F.col("node") == F.col("component")).alias("stands"), component_id.alias("component_id"))
    out = ["doc_id", "text_hash", "n_shingles", "component_id"]
    light = rows.select("doc_id", "text_hash", *KEY)
    full = light.where("n_shingles > 0").join(top, KEY).select(*out, (F.col("stands") & F.col("doc_id").eqNullSafe(F.col("rep"))).alias("kept"))
    bare = light.where("n_shingles = 0").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return full.unionByName(bare)


def keep_one(docs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """The rows of docs that stay: one document of each component, every column as it came."""
    lost = _classes(docs, threshold).where("not kept").select("doc_id", "text_hash").distinct()
    lost, seen = counted(lost, "lost")
    # names that no column of docs has
    gone, own = (next(x for i in range(len(docs.columns) + 1) if (x := f"__{k}{i}") not in docs.columns) for k in ("gone", "hash"))
    gone_rows = sent(lost.toDF(gone, own), seen["n"])
    same = docs["doc_id"].cast("long").eqNullSafe(gone_rows[gone]) & (F.xxhash64(docs["text"]) == gone_rows[own])
    return docs.join(gone_rows, same, "left_anti")
