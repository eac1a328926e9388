"""Quality of whole texts by a byte-level convolutional network in NumPy.

Bytes have learned embeddings; filters of WIDTH embedded bytes step over the text by STRIDE, so chunks overlap and
cover every byte. Responses are max-pooled over windows of WINDOW bytes; of the windows of a block of BLOCK bytes the
greatest and the least response of each filter, and the share of windows that hold text, go through a second layer of
learned units (where the two are alike in all filters, the block repeats itself). The units' greatest and mean values
over the blocks of a document feed one logistic unit.

Training is on at most ROWS labelled documents of at most LEARNED characters each, the same for the same tables. A
fifth of them is kept out of the fit: Adam goes on until their loss settles, the best network is kept and its scores
are calibrated on them. Both labels weigh the same in all of this, however rare one of them is: a score is the
probability of label 1 where both are equally likely beforehand.

Defined results: null and empty texts have one block of padding and a score like any other; labels of null quality
are left out; a document with several labels takes the greatest; of rows that repeat a doc_id the first text is
learned from; repeated rows are scored each; other columns are dropped by `scored` and passed on by `accepted`; an
empty table gives an empty result; without labels every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.sampling import bounded

WIDTH, STRIDE, WINDOW, BLOCK = 8, 4, 32, 256
EMBEDDED, FILTERS, UNITS = 4, 16, 16
#: Rows and characters of each that the network is fitted on; bytes scored at once.
ROWS, LEARNED, RUN = 3000, 1 << 15, 1 << 20
BATCH, RATE, STEPS, EVERY, PATIENCE = 64, 0.01, 500, 50, 4
WINDOWS = BLOCK // WINDOW


def blocks(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, each text padded to whole blocks; the first block of each text (one more at the end); and by block
    which windows hold text.

    Zeros before and after a text fill the chunks that reach over its ends.
    """
    parts, at, live = [], [0], []
    for t in texts:
        raw = (t or "").encode("utf-8", "replace")
        raw = bytes(WIDTH - STRIDE) + raw + bytes(WIDTH - STRIDE)
        n = -(-len(raw) // BLOCK)
        parts.append(raw.ljust(n * BLOCK, b"\x00"))
        live.append(np.arange(n * WINDOWS) * WINDOW < len(raw))
        at.append(at[-1] + n)
    return np.frombuffer(b"".join(parts) + bytes(WIDTH), np.uint8), np.array(at), np.concatenate(live).reshape(-1, WINDOWS)


def runs(texts: list[str | None], size: int = RUN) -> Iterator[list[str | None]]:
    """The texts in order, in lists of about `size` characters."""
    held, total = [], 0
    for t in texts:
        held.append(t)
        total += len(t or "") + BLOCK
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


@dataclass
class Network:
    embedding: np.ndarray  # byte, place of the embedding
    filters: np.ndarray  # place in the chunk, place of the embedding, filter
    bias: np.ndarray
    units: np.ndarray  # greatest and least response of each filter and share of windows, unit
    unit_bias: np.ndarray
    weights: np.ndarray  # of the greatest and of the mean value of each unit
    offset: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)  # calibration: factor and shift of the logit

    @classmethod
    def drawn(cls, rng: np.random.Generator) -> Network:
        normal = lambda sd, *shape: rng.normal(0, sd, shape).astype(np.float32)
        units = normal(1 / np.sqrt(FILTERS), 2 * FILTERS + 1, UNITS)
        half = UNITS // 2  # half of the units begin as contrasts of the greatest and the least window
        units[FILTERS : 2 * FILTERS, :half] = -units[:FILTERS, :half]
        return cls(
            normal(0.5, 256, EMBEDDED), normal(0.5 / np.sqrt(EMBEDDED), WIDTH, EMBEDDED, FILTERS), np.zeros(FILTERS, np.float32),
            units, np.zeros(UNITS, np.float32), normal(0.3, 2 * UNITS), np.zeros(1, np.float32),
        )

    @property
    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.bias, self.units, self.unit_bias, self.weights, self.offset]

    def windows(self, data: np.ndarray, step: int = RUN) -> tuple[np.ndarray, np.ndarray]:
        """By block, window and filter the greatest response, squashed, and where in the window it is."""
        tables = np.einsum("bd,jdf->jbf", self.embedding, self.filters)  # what each byte adds at each place of a chunk
        tops, places, end = [], [], len(data) - WIDTH
        for lo in range(0, end, step):
            n = (min(lo + step, end) - lo) // STRIDE
            z = np.tile(self.bias, (n, 1))
            for j in range(WIDTH):
                z += tables[j][data[lo + j : lo + j + n * STRIDE : STRIDE]]
            z = z.reshape(-1, WINDOWS, WINDOW // STRIDE, FILTERS)
            place = z.argmax(axis=2)
            tops.append(np.tanh(np.take_along_axis(z, place[:, :, None, :], axis=2)[:, :, 0, :]))
            places.append(place)
        return np.concatenate(tops), np.concatenate(places)

    def forward(self, data: np.ndarray, at: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, ...]:
        top, place = self.windows(data)
        most, least = np.where(live[:, :, None], top, -2).max(axis=1), np.where(live[:, :, None], top, 2).min(axis=1)
        u = np.concatenate([most, least, live.mean(axis=1, keepdims=True)], axis=1).astype(np.float32)
        # row by row, so that a text's score doesn't depend on the texts beside it
        h = np.tanh(np.einsum("bi,iu->bu", u, self.units) + self.unit_bias)
        x = np.concatenate([np.maximum.reduceat(h, at[:-1]), np.add.reduceat(h, at[:-1]) / np.diff(at)[:, None]], axis=1)
        return top, place, most, least, u, h, x, np.einsum("di,i->d", x, self.weights) + self.offset

    def gradients(self, rows: tuple[np.ndarray, ...], slope: np.ndarray, found: tuple[np.ndarray, ...]) -> list[np.ndarray]:
        """Of the parameters, from the slope of the loss by each document's logit."""
        data, at, live = rows
        top, place, most, least, u, h, x, _ = found
        doc = np.repeat(np.arange(len(slope)), np.diff(at))
        back = slope[:, None] * self.weights
        flow = back[doc, UNITS:] / np.diff(at)[doc][:, None] + np.where(h >= x[doc, :UNITS], back[doc, :UNITS], 0)
        flow = flow * (1 - h * h)
        down = flow @ self.units.T
        up, low = (top >= most[:, None, :]) & live[:, :, None], (top <= least[:, None, :]) & live[:, :, None]
        pooled = (np.where(up, down[:, None, :FILTERS], 0) + np.where(low, down[:, None, FILTERS : 2 * FILTERS], 0)) * (1 - top * top)
        block, window, own = np.nonzero(pooled)
        start, share = block * BLOCK + window * WINDOW + place[block, window, own] * STRIDE, pooled[block, window, own]
        tables = np.stack(
            [np.bincount(data[start + j].astype(np.int64) * FILTERS + own, share, 256 * FILTERS).reshape(256, FILTERS) for j in range(WIDTH)]
        )
        return [
            np.einsum("jbf,jdf->bd", tables, self.filters), np.einsum("jbf,bd->jdf", tables, self.embedding), pooled.sum(axis=(0, 1)),
            u.T @ flow, flow.sum(axis=0), x.T @ slope, slope.sum(keepdims=True),
        ]

    def logits(self, texts: list[str | None]) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(self.forward(*blocks(part))[-1] for part in runs(texts))])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return _sigmoid(self.scale[0] * self.logits(texts) + self.scale[1])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _even(y: np.ndarray) -> np.ndarray:
    """Weights of mean one by which both labels count the same."""
    return np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))


def _loss(p: np.ndarray, y: np.ndarray) -> float:
    return float(-np.mean(_even(y) * np.log(np.where(y == 1, p, 1 - p) + 1e-12)))


def calibrated(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Factor and shift by which the logits tell y best (Platt's method, with his targets, by Newton steps)."""
    good, bad = (y == 1).sum(), (y == 0).sum()
    goal = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x, w, even = np.stack([logits, np.ones(len(y))], axis=1), np.array([1.0, 0.0]), _even(y)
    for _ in range(50):
        p = _sigmoid(x @ w)
        slope, curve = x.T @ (even * (p - goal)) + 1e-3 * (w - [1, 0]), (x * (even * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        w = w - step / max(1.0, np.abs(step).max())
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def fit(texts: list[str], labels: list[int], seed: int = 7, steps: int = STEPS) -> Network:
    rng = np.random.default_rng(seed)
    net, y = Network.drawn(rng), np.array(labels, float)
    if not len(texts) or y.min() == y.max():
        net.weights[:] = 0
        net.offset[:] = 0.0 if not len(texts) else (4.0 if y[0] else -4.0)
        return net
    order = rng.permutation(len(texts))
    # a fifth of the rows of each label is kept out
    out = np.sort(np.concatenate([rows[: len(rows) // 5] for k in (0, 1) if len(rows := order[y[order] == k])]))
    fitted = np.setdiff1d(order, out)
    kept_texts, kept = [texts[i] for i in out], y[out]
    weight = _even(y)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters]
    best, since, waiting = (np.inf, None), 0, np.zeros(0, int)
    for step in range(1, steps + 1):
        if not len(waiting):
            waiting = rng.permutation(fitted)
        rows, waiting = waiting[:BATCH], waiting[BATCH:]
        batch = blocks([texts[i] for i in rows])
        found = net.forward(*batch)
        slope = weight[rows] * (_sigmoid(found[-1]) - y[rows]) / len(rows)
        rate = RATE * min(1.0, 2 * (1 - step / steps) + 0.05) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for p, (m, v), g in zip(net.parameters, state, net.gradients(batch, slope, found)):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
        if step % EVERY == 0 and len(out):
            now = _loss(_sigmoid(net.logits(kept_texts)), kept)
            since = since + 1 if now >= best[0] else 0
            if now < best[0]:
                best = (now, [p.copy() for p in net.parameters])
            if since >= PATIENCE:
                break
    if best[1]:
        for p, q in zip(net.parameters, best[1]):
            p[:] = q
        if 0 < kept.sum() < len(kept):
            net.scale = calibrated(net.logits(kept_texts), kept)
    return net


def trained(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = ROWS) -> Network:
    """The network of at most `rows` labelled documents for which `learn`, on labels, holds."""
    marks = labels.where(learn & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("quality"))
    chosen = bounded(marks, rows, "quality")
    short = docs.select("doc_id", "text").where(F.length("text") <= LEARNED)
    found = short.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect()
    found = sorted(found, key=lambda r: r.doc_id)
    return fit([r.text for r in found], [r.quality for r in found])


def scored(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, score of every row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": shared.value.scores(texts)})

    return docs.select("doc_id", "text").mapInPandas(score, "doc_id long, score double")


def accepted(docs: DataFrame, network: Network, least: float = 0.3) -> DataFrame:
    """The rows of docs that score `least` or more, every column as it came."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(texts.tolist()), dtype="float64")

    return docs.where(score("text") >= least)
