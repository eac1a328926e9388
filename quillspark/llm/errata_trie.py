"""Grouping of spelling variants by merging the light subtrees of tries.

Words are counted over whole texts. Two words are near if one insertion, deletion or replacement of a code point makes
one of them the other; a word's form is its most frequent near word, where that is `ratio` times as frequent at least.

A near pair has a place: the length of its common prefix, at which one code point is replaced or skipped. Its shorter
word, of m code points, has either the front half of them in common with the other word (place in the back half) or
the back half (place in the front half). So every word goes to four groups: by its front or its back half, as the
shorter or as the longer word. A group of more than `GROUP` words is halved again, by one more half of the window of
places that is left, until it is small or the window is one place wide; then at most 90 + 90 * 90 words of the 90 letters
share all the rest. Every near pair meets in exactly one group, and no group grows with the corpus.

A group's words, without what all of them share, form a trie. Its heavy paths stay as they are; at each node the light
subtrees are merged into the rest with one code point skipped or replaced (`near_pairs`), and terminals that coincide
are near pairs. A word lies in at most log2(words) light subtrees, so that is what each costs.

Defined results: null and empty texts have no words; null ids count as empty ids; rows that repeat another count again;
ties between near words go to the first by code point; an empty table gives no words.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.tables import counted, sent, written
from quillspark.llm.words import LOWER

#: Least code points of a word, its least count, and how much more frequent its form is.
LEAST, OFTEN, RATIO = 6, 5, 5
#: One of so many occurrences (by hash of id and word) loses a code point before words are counted.
SLIPS = 199
#: Most words of a group that isn't halved again, and distinct words that a task counts before it passes them on.
GROUP, HELD = 20_000, 200_000
#: Characters of a text that are read at once; a run of letters is never cut.
SLICE = 1 << 20
_GAP = re.compile("[^A-Za-zÀ-ÿ]")


def _slices(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + SLICE)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def _counter(least: int, slips: int):
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % least)  # a shorter run has no part that matches, a longer one matches whole

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}
        batch = lambda: pa.RecordBatch.from_pydict({"word": pa.array(total.keys(), pa.string()), "n": pa.array(total.values(), pa.int64())})
        crc, seen = zlib.crc32, total.get
        for rows in batches:
            for key, text in zip(rows.column(0).to_pylist(), rows.column(1)):
                start = crc(f"{'' if key is None else key}:".encode())
                for part in _slices(text.as_py() or ""):
                    own: dict[str, int] = {}
                    for word in runs.findall(part.encode("utf-8", "replace").translate(LOWER).decode()):
                        own[word] = own.get(word, 0) + 1
                    for word, n in own.items():
                        if slips:
                            h = crc(word.encode(), start)
                            if not h % slips:
                                at = h % len(word)
                                word = word[:at] + word[at + 1 :]
                                if len(word) < least:
                                    continue
                        total[word] = seen(word, 0) + n
                    if len(total) > HELD:
                        yield batch()
                        total.clear()
        if total:
            yield batch()

    return count


def vocabulary(docs: DataFrame, least: int = LEAST, often: int = OFTEN, slips: int = SLIPS) -> DataFrame:
    """word, n of docs (doc_id, text): runs of letters with A-Z lower-cased, of `least` code points and `often` times.

    Where `slips` divides the crc32 h of `<doc_id>:<run>`, the run is read without its code point h % length.
    """
    runs = docs.select(F.col("doc_id").cast("string"), "text").where("text is not null").mapInArrow(_counter(least, slips), "word string, n long")
    return runs.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def near_pairs(words: list[str], reach: int) -> Iterator[tuple[int, int]]:
    """The pairs (positions in words, which are distinct) at one edit whose common prefix has at most `reach` code points,
    each once."""
    kids: list[dict[str, int]] = [{}]
    ends, above, depth = [-1], [0], [0]
    for i, word in enumerate(words):
        at = 0
        for c in word:
            to = kids[at].get(c)
            if to is None:
                to = kids[at][c] = len(kids)
                kids.append({})
                ends.append(-1)
                above.append(at)
                depth.append(depth[at] + 1)
            at = to
        ends[at] = i
    size = [int(e >= 0) for e in ends]
    for at in range(len(kids) - 1, 0, -1):
        size[above[at]] += size[at]

    def coinciding(a: int, b: int) -> Iterator[tuple[int, int]]:
        stack = [(a, b)]
        while stack:
            x, y = stack.pop()
            if ends[x] >= 0 and ends[y] >= 0:
                yield ends[x], ends[y]
            few, many = (kids[x], kids[y]) if len(kids[x]) < len(kids[y]) else (kids[y], kids[x])
            stack += [(few[c], many[c]) for c in few if c in many]

    def merged(light: list[int]) -> Iterator[tuple[int, int]]:
        """All light subtrees in one trie, their first code point replaced by one sign for all."""
        below: list[dict[str, int]] = [{}]
        held: list[list[int]] = [[]]
        for top in light:
            stack = [(top, 0)]
            while stack:
                x, e = stack.pop()
                if ends[x] >= 0:
                    yield from ((ends[x], other) for other in held[e])
                    held[e].append(ends[x])
                for c, y in kids[x].items():
                    to = below[e].get(c)
                    if to is None:
                        to = below[e][c] = len(below)
                        below.append({})
                        held.append([])
                    stack.append((y, to))

    for at, own in enumerate(kids):
        if depth[at] > reach or not own or (len(own) == 1 and ends[at] < 0):
            continue
        if ends[at] >= 0:
            yield from ((ends[v], ends[at]) for v in own.values() if ends[v] >= 0)  # one code point skipped at the end
        heavy = max(own.values(), key=lambda v: size[v])
        light = [(c, v) for c, v in own.items() if v != heavy]
        for c, v in light:
            for second, x in kids[v].items():  # the light subtree without its first code point
                if second != c and second in own:
                    yield from coinciding(x, own[second])
            if c in kids[heavy]:  # the heavy subtree without its first
                yield from coinciding(v, kids[heavy][c])
            yield from coinciding(v, heavy)
        if len(light) > 1:
            yield from merged([v for _, v in light])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per word of each group that has near words there: their number and the best of them. Groups come one after the
    other (word, n, m, low, high)."""
    out: tuple[list, list, list, list] = ([], [], [], [])

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int64())], ["word", "n_near", "near", "near_n"]
        )
        for column in out:
            column.clear()
        return made

    def close(key: tuple, words: list[str], counts: list[int]) -> None:
        m, low, high = key[:3]
        back = max(0, m - high - 1)
        found: dict[int, list] = {}
        for pair in near_pairs([w[low : len(w) - back] for w in words], high - low):
            a, b = pair
            if len(words[a]) > m and len(words[b]) > m:
                continue  # they meet in a group of their own length
            for x, y in (pair, (b, a)):
                held = found.setdefault(x, [0, 0, ""])
                held[0] += 1
                if counts[y] > held[1] or (counts[y] == held[1] and words[y] < held[2]):
                    held[1:] = counts[y], words[y]
        for x, (n, best_n, best) in found.items():
            for column, value in zip(out, (words[x], n, best, best_n)):
                column.append(value)

    last, words, counts = None, [], []
    for rows in batches:
        for word, n, m, low, high in zip(*(c.to_pylist() for c in rows.columns)):
            back = max(0, m - high - 1)
            key = (m, low, high, word[:low], word[len(word) - back :])
            if key != last:
                if len(words) > 1:
                    close(last, words, counts)
                    if len(out[0]) > 50_000:
                        yield batch()
                last, words, counts = key, [], []
            words.append(word)
            counts.append(n)
    if len(words) > 1:
        close(last, words, counts)
    yield batch()


_KEY = ("m", "low", "high", "front", "back")


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("front", F.expr("substring(word, 1, low)")).withColumn("back", F.expr("right(word, greatest(0, m - high - 1))"))


def _windows(words: DataFrame, least: int) -> DataFrame:
    """word, n and m, low, high of each of its groups: the shorter word's length, the first and last place."""
    shorter = F.filter(F.array(F.length("word") - 1, F.length("word")), lambda m: m >= least)
    sized = words.select("word", "n", F.explode(shorter).alias("m"))
    half = F.ceil(F.col("m") / 2).cast("int")
    both = F.array(F.struct(F.lit(0).alias("low"), (half - 1).alias("high")), F.struct(half.alias("low"), F.col("m").alias("high")))
    return sized.select("word", "n", "m", F.inline(both))


def grouped(words: DataFrame, least: int = LEAST, group: int = GROUP) -> DataFrame:
    """The windows of all words, halved until no group that can be halved has more than `group` words."""
    rows = _windows(words, least)
    while True:
        sizes = _keyed(rows).groupBy(*_KEY).count().where((F.col("count") > group) & (F.col("high") > F.col("low"))).select(*_KEY)
        large, n = counted(sizes, "variant-groups")
        if not n["n"]:
            return rows
        marked = _keyed(rows).join(sent(large.withColumn("large", F.lit(True)), n["n"]), list(_KEY), "left")
        middle = F.ceil((F.col("low") + F.col("high")) / 2).cast("int")
        whole = F.struct("low", "high")
        halves = F.array(F.struct("low", (middle - 1).alias("high")), F.struct(middle.alias("low"), "high"))
        split = F.when(F.col("large"), halves).otherwise(F.array(whole))
        rows = written(marked.select("word", "n", "m", F.inline(split)), "variant-windows")


def variants(docs: DataFrame, least: int = LEAST, often: int = OFTEN, ratio: int = RATIO, slips: int = SLIPS, group: int = GROUP) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of docs (doc_id, text)."""
    words = written(vocabulary(docs, least, often, slips), "variant-words")
    together = _keyed(grouped(words, least, group)).repartition(*_KEY).sortWithinPartitions(*_KEY, "word")
    near = together.select("word", "n", "m", "low", "high").mapInArrow(_near, "word string, n_near long, near string, near_n long")
    best = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best"))
    is_form = -F.col("best.order") >= F.lit(ratio) * F.col("n")
    found = written(
        words.join(best, "word", "left").select(
            "word",
            F.when(is_form, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(is_form, -F.col("best.order")).alias("form_n"),
        ),
        "variants",
    )
    root = F.coalesce("root", "word").alias("root")
    return found.join(roots(found.where("form is not null").select("word", "form")), "word", "left").select("word", "form", root, "n", "n_near", "form_n")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of forms (word, form; no circles): the end of the way from form to form, which each round halves."""
    found = forms.select("word", F.col("form").alias("root"))
    while True:
        further = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = found.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        found, seen = counted(step, "variant-roots", moved=F.count_if("moved"))
        if not seen["moved"]:
            return found.select("word", "root")
        found = found.select("word", "root")
