"""Scoring texts with a weighted backoff automaton learned from the whole corpus.

All n-grams of up to three tokens of all training documents are counted; none is left out, however rare. The root is
the add-half unigram model (c + 0.5) / (N + 0.5 * (V + 1)). Each history seen in training is a state, with an arc for
each token seen after it, of probability (c(h w) + M P(w | shorter h)) / (c(h) + M), and a failure arc to the state of
the shorter history, of weight M / (c(h) + M) (Dirichlet smoothing: M, PRIOR by order, is what the shorter history's
distribution weighs). So the probabilities of each state sum to one. A history never seen fails with weight one. A
text begins in the state START and is read once, left to right: at each token the state follows the token's arc, or
failure arcs until there is one, and the logarithms of what it passes add up.

No table of n-grams is gathered anywhere. Texts are dealt to blocks, n-grams to targets by their hashes; the numbers
of both grow with the input. A block asks each target once for each of its different n-grams and says how often its
training texts have it; the target adds up what all blocks say and answers each; the block builds the states and arcs
that its texts pass and scores them. Lists of hashes go as differences of their sorted values.

Tokens are told apart by 64-bit hashes, the longer n-grams of one target by 40 bits of theirs. Blocks times targets
messages are sent: with blocks of BLOCK characters that is cheap up to about a terabyte of text; beyond, larger blocks
(and executors) should be chosen.

Defined results: a null text is empty and has the end token alone; a row whose doc_id is null is learned from, where
the learning condition is null too; repeated rows count and score each; other columns are dropped; an empty table
gives an empty result; without training rows N and V are 0 and every token is unseen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm import words
from quillspark.llm.tables import written

#: What the shorter history's distribution weighs, in tokens, in states of one token and of two.
PRIOR = (500.0, 10.0)
#: Characters of a block of texts; there are as many targets as blocks.
BLOCK = 8_000_000
#: The hash of the end token; words have hashes of their bytes.
END = np.uint64(0xE7D0E7D0E7D0E7D0)
START = np.uint64(0x57A2757A2757A275)
#: Bits that tell n-grams of one target apart.
BITS = np.uint64(40)


def _tokens(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per run of texts: token hashes with end tokens, and where each text's tokens begin (one more at the end)."""
    for _, block in words.blocks(texts):
        hashes, at = words.word_hashes(block)
        yield np.insert(hashes, at[1:], END), at + np.arange(len(at))


@dataclass
class Grams:
    """The different tokens and longer n-grams of a block of texts, and where its tokens find theirs."""

    starts: np.ndarray  # of each text's tokens, one more at the end
    words: np.ndarray  # sorted hashes
    word_of: np.ndarray  # of each token
    grams: np.ndarray  # sorted: target << BITS | hash
    gram_of: np.ndarray  # of each token its bigram, then of each inner token its trigram
    inner: np.ndarray  # the tokens with a history of two

    @classmethod
    def of(cls, texts: list[str | None], targets: int) -> Grams:
        found = list(_tokens(texts))
        tokens = np.concatenate([t for t, _ in found])
        ends = np.cumsum([0, *(len(t) for t, _ in found)])
        starts = np.concatenate([*(s[:-1] + e for (_, s), e in zip(found, ends)), ends[-1:]])
        before = np.concatenate([[START], tokens[:-1]])
        before[starts[:-1]] = START
        two = words.mix64(words.mix64(before + np.uint64(0xA0761D6478BD642F)) + tokens)
        follows = np.ones(len(tokens), bool)
        follows[starts[:-1]] = False
        inner = np.flatnonzero(follows)
        three = words.mix64(two[inner - 1] * np.uint64(0xE7037ED1A0B428DB) + tokens[inner])
        keys = np.concatenate([two, three])
        high, low = keys >> BITS, keys & np.uint64((1 << 40) - 1)
        grams, gram_of = np.unique(high * np.uint64(targets) >> np.uint64(24) << BITS | low, return_inverse=True)
        return cls(starts, *np.unique(tokens, return_inverse=True), grams, gram_of, inner)

    def seen(self, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often the texts that are learned from have each token and each longer n-gram."""
        own = np.repeat(learn, np.diff(self.starts))
        return (
            np.bincount(self.word_of, own, len(self.words)).astype(np.uint64),
            np.bincount(self.gram_of, np.concatenate([own, own[self.inner]]), len(self.grams)).astype(np.uint64),
        )

    def parted(self, targets: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the tokens and the longer n-grams of each target begin (one more at the end)."""
        n = np.arange(targets + 1, dtype=np.uint64)
        of = (self.words >> BITS) * np.uint64(targets) >> np.uint64(24)
        return np.searchsorted(of, n), np.append(np.searchsorted(self.grams, n[:-1] << BITS), len(self.grams))


def _packed(values: np.ndarray) -> bytes:
    """Integers as planes of bytes, as many as the greatest needs."""
    planes = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    return bytes([planes]) + values.astype("<u8").view("u1").reshape(-1, 8)[:, :planes].T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, "u1", offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), "u1")
    out[:, : data[0]] = planes.T
    return out.reshape(-1).view("<u8")


def _steps(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=np.uint64(0))


def _asked(n: int):
    def ask(table: pa.Table) -> pa.Table:
        grams = Grams.of(table["text"].to_pylist(), n)
        own = list(zip((grams.words, grams.grams & np.uint64((1 << 40) - 1)), grams.seen(table["learn"].to_numpy().astype(float)), grams.parted(n)))
        rows = [[_packed(x) for keys, seen, at in own for x in (_steps(keys[at[t] : at[t + 1]]), seen[at[t] : at[t + 1]])] for t in range(n)]
        columns = [pa.array([table["block"][0].as_py()] * n, pa.int64()), pa.array(range(n), pa.int64())]
        columns += [pa.array([r[k] for r in rows], pa.binary()) for k in range(4)]
        return pa.Table.from_arrays(columns, ["block", "target", "words", "words_seen", "grams", "grams_seen"])

    return ask


def _summed(keys: list[bytes], seen: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """For each list of keys how often all lists together have them; and the sums of the different keys."""
    own = [np.cumsum(_unpacked(x), dtype=np.uint64) for x in keys]
    at = np.cumsum([0, *map(len, own)])
    different, key_of = np.unique(np.concatenate(own), return_inverse=True)
    c = np.bincount(key_of, np.concatenate([_unpacked(x) for x in seen]), len(different)).astype(np.uint64)
    return [_packed(c[key_of[i:j]]) for i, j in zip(at[:-1], at[1:])], c


def _answered(table: pa.Table) -> pa.Table:
    """Of one target: per block the counts of its tokens and n-grams; once the number of different tokens and of all."""
    word_counts, c = _summed(table["words"].to_pylist(), table["words_seen"].to_pylist())
    gram_counts, _ = _summed(table["grams"].to_pylist(), table["grams_seen"].to_pylist())
    rest = [0] * (len(table) - 1)
    columns = [table["block"], table["target"], pa.array(word_counts, pa.binary()), pa.array(gram_counts, pa.binary())]
    columns += [pa.array([int((c > 0).sum()), *rest], pa.int64()), pa.array([int(c.sum()), *rest], pa.int64())]
    return pa.Table.from_arrays(columns, ["block", "target", "words", "grams", "v", "n"])


def traversed(grams: Grams, word_counts: np.ndarray, gram_counts: np.ndarray, whole: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token its count, and the logarithms of its probability at the root and of what the automaton passes."""
    n, first, inner = len(grams.word_of), grams.starts[:-1], grams.inner
    count = word_counts[grams.word_of]
    of_two, of_three = gram_counts[grams.gram_of[:n]], gram_counts[grams.gram_of[n:]]
    # how often each token's states come: START as often as the end token, a history of two as often as that bigram
    one = np.append(0.0, count[:-1])
    one[first] = count[grams.starts[1:] - 1]
    two = of_two[inner - 1]

    def passed(c: np.ndarray, state: np.ndarray, prior: float, below: np.ndarray) -> np.ndarray:
        """log10 of the arc where there is one, else of the failure arc and of what is passed below it."""
        return np.log10(np.where(c > 0, c + prior * 10**below, prior * 10**below) / (state + prior))

    root = np.log10((count + 0.5) / whole)
    out = passed(of_two, one, PRIOR[0], root)
    out[inner] = passed(of_three, two, PRIOR[1], out[inner])
    return count, root, out


def _scored(parts: int, whole: float):
    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        grams, answers = Grams.of(texts["text"].to_pylist(), parts), answers.sort_by("target")
        counts = (np.concatenate([_unpacked(x) for x in answers[k].to_pylist()]).astype(float) for k in ("words", "grams"))
        count, root, passed = traversed(grams, *counts, whole)
        sums = lambda x: pa.array(np.add.reduceat(x, grams.starts[:-1]))
        columns = [texts["doc_id"], pa.array(np.diff(grams.starts)), sums((count > 0).astype(np.int64)), sums(root), sums(passed)]
        return pa.Table.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return score


def scored(docs: DataFrame, learn: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text).

    The model learns from the rows for which `learn` isn't false.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(learn, F.lit(True)).alias("learn"))
    chars = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    parts = min(max(1, -(-chars // BLOCK)), 1 << 20)
    blocks = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts))).repartition(parts, "block")
    asked = blocks.groupBy("block").applyInArrow(_asked(parts), "block long, target long, words binary, words_seen binary, grams binary, grams_seen binary")
    answers = written(
        asked.repartition(parts, "target").groupBy("target").applyInArrow(_answered, "block long, target long, words binary, grams binary, v long, n long"),
        "answers",
    )
    v, n = answers.agg(F.coalesce(F.sum("v"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    answers = answers.select("block", "target", "words", "grams").repartition(parts, "block")
    scores = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _scored(parts, n + 0.5 * (v + 1)), "doc_id long, n_tokens long, n_known long, base_score double, score double"
    )
    return scores.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
