"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into the phrases of LZ78: each is the shortest string from its place on that is no phrase yet. The
phrases are hashed and the fingerprint is the minimum-hash signature of their set, LANES values of 16 bits in hex.
The likeness of two fingerprints is the share of equal lanes, an estimate of the Jaccard similarity of the sets.

`with_next` compares each document with its own text edited by the next document's beginning, and with the next
document, in the order of doc_id. Ranges of ids are parted and sorted, each read as a stream that holds two texts;
the last document of each range and the first of the next meet in a second step over these edges alone.

Defined results: a null text is empty; empty texts have no phrase and equal fingerprints; a null doc_id comes before
all others; rows that repeat a doc_id follow each other by text; a lone document is its own next; other columns are
dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import words
from quillspark.llm.minhash import signatures
from quillspark.llm.tables import written

LANES = 64


def parse(text: str, seen: set[str], ends: list[int], keep: int | None = None) -> tuple[set[str], int] | None:
    """Goes on with the parse of a text after ends[-1], into seen and ends. keep: returns the phrases, and how many,
    that end there or before it."""
    at, n, length, kept = ends[-1] if ends else 0, len(text), 1, None
    add, put = seen.add, ends.append
    while at < n:
        # phrases are closed under prefixes, so the search may begin at the last length
        end = min(at + length, n)
        phrase = text[at:end]
        if phrase in seen:
            while end < n:
                end += 1
                phrase = text[at:end]
                if phrase not in seen:
                    break
        else:
            while end - 1 > at:
                shorter = text[at : end - 1]
                if shorter in seen:
                    break
                end -= 1
                phrase = shorter
        if keep is not None and end > keep:
            kept, keep = (seen.copy(), len(ends)), None
        add(phrase)
        put(end)
        length, at = end - at, end
    return (seen.copy(), len(ends)) if keep is not None else kept


def phrases(text: str) -> list[int]:
    """Where each phrase ends."""
    ends: list[int] = []
    parse(text, set(), ends)
    return ends


def phrase_hashes(text: str, ends: list[int]) -> np.ndarray:
    if not ends:
        return np.zeros(0, np.uint64)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    up, down = words._power_tables(len(points))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.mix64(points + np.uint64(1)) * up[: len(points)], dtype=np.uint64)])
    stop = np.array(ends)
    start = np.concatenate([[0], stop[:-1]])
    return words.mix64((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))


def fingerprints(sets: list[np.ndarray], lanes: int = LANES) -> np.ndarray:
    out = np.full((len(sets), lanes), 0xFFFF, np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    out[full] = signatures([sets[i] for i in full], lanes).astype(np.uint16)
    return out


def text_fingerprint(text: str | None) -> str:
    text = text or ""
    return _hex(fingerprints([phrase_hashes(text, phrases(text))])[0])


def _hex(lanes: np.ndarray) -> str:
    return lanes.astype(">u2").tobytes().hex()


def _compared(docs: list[tuple]) -> list[tuple]:
    """The result rows of all of docs (doc_id, text) but the last, each with the one that follows."""
    if len(docs) < 2:
        return []
    sets, edits = [], []
    for i, (_, text) in enumerate(docs):
        half = len(text) // 2
        ends: list[int] = []
        seen, n = parse(text, set(), ends, len(text) - half)
        sets.append(phrase_hashes(text, ends))
        if i + 1 < len(docs):
            edited = text[: len(text) - half] + docs[i + 1][1][:half]
            new = ends
            if edited != text:
                new = ends[:n]  # phrases within what is kept are the same
                parse(edited, seen, new)
            edits.append((hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), phrase_hashes(edited, new)))
    own, other = fingerprints(sets), fingerprints([s for _, s in edits])
    rows = []
    for i, (sha, _) in enumerate(edits):
        near_edited, near_next = float((own[i] == other[i]).mean()), float((own[i] == own[i + 1]).mean())
        rows.append((docs[i][0], len(docs[i][1]), sha, _hex(own[i]), _hex(other[i]), near_edited, near_next))
    return rows


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=COLUMNS)
    out["doc_id"] = out["doc_id"].astype("Int64")
    out["n_chars"] = out["n_chars"].astype("Int64")
    return out


def _stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Compared rows of a sorted range (edge 0), and its first (1) and last (2) document with their texts."""
    last = None

    def edge(kind: int, doc: tuple) -> pd.DataFrame:
        return _frame([(doc[0], *[None] * 6)]).assign(edge=kind, text=doc[1])

    for pdf in batches:
        ids = [None if pd.isna(x) else int(x) for x in pdf["doc_id"]]
        docs = [(i, t or "") for i, t in zip(ids, pdf["text"])]
        if not docs:
            continue
        if last is None:
            yield edge(1, docs[0])
        docs = docs if last is None else [last, *docs]
        for lo in range(0, len(docs) - 1, 128):
            yield _frame(_compared(docs[lo : lo + 129])).assign(edge=0, text=None)
        last = docs[-1]
    if last is not None:
        yield edge(2, last)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of docs (doc_id, text)."""
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    rows = written(ranged.mapInPandas(_stream, f"{SCHEMA}, edge int, text string"), "fingerprints")
    order = Window.orderBy(F.col("doc_id").asc_nulls_first(), "edge")
    edges = rows.where("edge > 0").select("doc_id", "text", "edge")  # two of each range
    joined = edges.withColumn("next", F.lead("text").over(order)).withColumn("first", F.first("text").over(order)).where("edge = 2")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = [None if pd.isna(x) else int(x) for x in pdf["doc_id"]]
            nexts = [f if n is None else n for n, f in zip(pdf["next"], pdf["first"])]
            yield _frame([r for i, t, n in zip(ids, pdf["text"], nexts) for r in _compared([(i, t), (None, n)])])

    met = joined.select("doc_id", "text", "next", "first").mapInPandas(meet, SCHEMA)
    return rows.where("edge = 0").select(*COLUMNS).unionByName(met)
