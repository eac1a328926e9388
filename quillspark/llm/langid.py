"""Language of whole texts by word-first backoff.

Words (runs of letters, lower case) seen in training score by their log frequency in each language. For an unseen
word every position scores by the longest character n-gram that training holds there, from `LONGEST` down to single
characters, each by its log frequency in each language. The sums over a text are log likelihoods of the languages.

The model is fitted on at most ROWS labelled documents of at most LEARNED characters each (of rows that repeat a
doc_id one), the same for the same table; its size is bounded by theirs.

Defined results: null texts and texts without letters are `und` with score 0; ties go to the first language by code
point; repeated rows are scored each; other columns are dropped; an empty table, or one without labels, gives `und`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.sampling import bounded

ROWS, LONGEST, LEAST = 2000, 5, 2
#: Characters of the longest text that is learned from.
LEARNED = 1 << 15
#: Evidence counts as from so many words at most, for the score.
EVIDENCE = 25
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    languages: list[str]
    words: dict[str, int]
    word_scores: np.ndarray
    grams: dict[str, int]
    gram_scores: np.ndarray

    def backoff(self, word: str) -> Iterator[int]:
        padded, find = f"<{word}>", self.grams.get
        for i in range(len(padded)):
            for n in range(min(LONGEST, len(padded) - i), 0, -1):
                at = find(padded[i : i + n])
                if at is not None:
                    yield at
                    break

    def predict(self, text: str | None) -> tuple[str, float]:
        words = _WORD.findall((text or "").lower())
        if not self.languages or not any(c.isalpha() for w in words for c in w):
            return "und", 0.0
        counts = Counter(words)
        total = np.zeros(len(self.languages))
        at = [self.words.get(w, -1) for w in counts]
        known = [(i, n) for i, n in zip(at, counts.values()) if i >= 0]
        if known:
            i, n = np.array(known).T
            total += n @ self.word_scores[i]
        grams, times = [], []
        for w, i, n in zip(counts, at, counts.values()):
            if i < 0:
                found = list(self.backoff(w))
                grams += found
                times += [n] * len(found)
        if grams:
            total += np.array(times) @ self.gram_scores[grams]
        total *= min(1.0, EVIDENCE / len(words))
        odds = np.exp(total - total.max())
        best = int(np.argmax(odds))
        return self.languages[best], float(odds[best] / odds.sum())


def fit(rows: list[tuple[str, str]]) -> Model:
    """The model of (text, language) rows."""
    languages = sorted({lang for _, lang in rows})
    column = {lang: i for i, lang in enumerate(languages)}
    words: dict[str, np.ndarray] = {}
    for lang in languages:
        counted: Counter[str] = Counter()
        for text, own in rows:
            if own == lang:
                counted.update(_WORD.findall(text.lower()))
        for w, n in counted.items():
            words.setdefault(w, np.zeros(len(languages)))[column[lang]] += n
    grams: dict[str, np.ndarray] = {}
    for w, n in words.items():
        padded, once = f"<{w}>", np.sqrt(n)  # a word form counts for less the oftener it comes
        for size in range(1, LONGEST + 1):
            for i in range(len(padded) - size + 1):
                g = padded[i : i + size]
                if g in grams:
                    grams[g] += once
                else:
                    grams[g] = once.copy()
    kept = {w: n for w, n in words.items() if n.sum() >= LEAST}
    some = {g: n for g, n in grams.items() if len(g) == 1 or n.sum() >= LEAST}

    def scores(counts: dict[str, np.ndarray], group) -> np.ndarray:
        table = np.array(list(counts.values())).reshape(len(counts), len(languages)) + 0.5
        keys = np.array([group(k) for k in counts])
        for k in set(keys.tolist()):
            table[keys == k] /= table[keys == k].sum(axis=0)
        return np.log(table)

    return Model(
        languages, {w: i for i, w in enumerate(kept)}, scores(kept, lambda w: 0), {g: i for i, g in enumerate(some)}, scores(some, len)
    )


def trained(docs: DataFrame, learn: Column, rows: int = ROWS) -> Model:
    """The model of at most `rows` of the labelled rows of docs (doc_id, text, lang) where `learn` holds."""
    labelled = docs.where(learn & F.col("lang").isNotNull() & (F.length("text") <= LEARNED)).select("doc_id", "text", "lang")
    chosen = bounded(labelled.select("doc_id").distinct(), rows, "langid")
    own = labelled.join(F.broadcast(chosen), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("row"))
    return fit([(r.row.text, r.row.lang) for r in sorted(own.collect(), key=lambda r: r.doc_id)])


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [shared.value.predict(t) for t in pdf["text"]]
            yield pd.DataFrame(
                {"doc_id": pdf["doc_id"].astype("Int64"), "lang_pred": [a for a, _ in found], "score": [float(b) for _, b in found]}
            )

    return docs.select("doc_id", "text").mapInPandas(predict, "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs in a known language, every column as it came; without one, the rows that have letters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.BooleanType())
    def sure(texts: pd.Series) -> pd.Series:
        known = bool(shared.value.languages)
        found = (shared.value.predict(t) if known else ("", float(any(c.isalpha() for c in t or ""))) for t in texts)
        return pd.Series([lang != "und" and score >= least for lang, score in found], dtype=bool)

    return docs.where(sure("text"))


