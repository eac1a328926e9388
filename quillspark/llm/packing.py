"""Vector bin packing of examples into training sequences under limits on tokens, segments and loss-bearing tokens.

An open sequence has a residual for each limit; of a window of waiting examples the one whose demand has the greatest
dot product with the residuals (both as shares of the limits) goes in next, if it keeps all limits. When none fits,
an example is cut to fill the sequence, where cutting is allowed; else the sequence is closed. At the end of a
partition, where cutting is allowed, the last tokens go to sequences of a power of two, which need no padding.

Every partition packs its own rows in their order, holding one window of them: there is no shuffle, and a lost task
packs the same rows again. sequence_id is the partition's number times 2**32 plus a running number.

Defined results: a null text is empty, its only id is the end id; repeated rows are documents of their own; a text of
any length is cut; other columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENS, SEGMENTS = 1024, 128
END = 0
#: Sequences that a task gives at once.
STEP = 256


class Ids:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes, as the tokenizers library gives them.

    A byte-level BPE file whose merges make its tokens one by one in the order of their ids says the same as a table
    of ranks, by which tiktoken encodes three times as fast. Texts with a special token's string, and all texts where
    the file is of another kind, go to the tokenizers library itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self._special = [x["content"] for x in said["added_tokens"]]
        ranks = _ranks(said)
        self._ranked = ranks and tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def of(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self._ranked and not any(x in text for x in self._special):
            return self._ranked.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _byte_of() -> dict[str, int]:
    """The bytes that byte-level BPE files write as characters: printable ones as themselves, others from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranks(said: dict) -> dict[bytes, int] | None:
    """The rank of each token of a tokenizers file, or None if ranks alone don't say all that the file says."""
    model, first = said["model"], said.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space")
    odd = said.get("normalizer") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")
    if not plain or odd or model.get("ignore_merges"):
        return None
    vocabulary, pairs = model["vocab"], [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
    made = [vocabulary.get(a + b) for a, b in pairs]
    if made != list(range(256, 256 + len(made))) or len(vocabulary) != 256 + len(made):
        return None
    byte_of = _byte_of()
    return {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items()}


#: A worker's tokenizers by path, which its later tasks use again (a few MB each).
_LOADED: dict[str, Ids] = {}


def loaded(path: str) -> Ids:
    if path not in _LOADED:
        _LOADED[path] = Ids(path)
    return _LOADED[path]


class Packer:
    """Examples go in by `add`; sequences come out as lists of (example, start, length)."""

    def __init__(self, limits: tuple[int, int, int], cut: bool, window: int = 128):
        self.limits, self.cut, self.window = np.array(limits, float), cut, window
        self._items: list[list] = []  # example, start, tokens, loss per token
        self._demand = np.zeros((0, 3))

    def add(self, example, tokens: int, loss: int) -> Iterator[list[tuple]]:
        start, most = 0, int(self.limits[0])
        share = loss / tokens if tokens else 0.0
        if self.cut:
            while tokens - start >= most and most * share <= self.limits[2]:
                yield [(example, start, most)]
                start += most
        elif tokens > most or loss > self.limits[2]:
            raise ValueError(f"an example of {tokens} tokens, {loss} of them with loss, is above the limits")
        if tokens > start:
            self._items.append([example, start, tokens - start, share])
        if len(self._items) >= 2 * self.window:
            yield from self._close(self.window)

    def end(self) -> Iterator[list[tuple]]:
        yield from self._close(0)

    def _close(self, keep: int) -> Iterator[list[tuple]]:
        items = self._items
        demand = np.array([[t, 1, t * s] for _, _, t, s in items]).reshape(-1, 3) / self.limits
        alive = np.ones(len(items), bool)
        while alive.sum() > keep:
            left, out = np.ones(3), []
            while True:
                fits = alive & (demand <= left + 1e-9).all(axis=1)
                if not fits.any():
                    break
                i = int(np.argmax(np.where(fits, demand @ left, -1.0)))
                out.append((items[i][0], items[i][1], items[i][2]))
                left, alive[i] = left - demand[i], False
            room = int(left[0] * self.limits[0] + 1e-6)
            if self.cut and room and left[1] > 0 and alive.any():
                i = int(np.argmax(np.where(alive, demand[:, 0], -1.0)))
                example, start, tokens, share = items[i]
                n = min(room, tokens - 1, int(left[2] * self.limits[2] / share + 1e-6) if share else room)
                if n > 0:
                    out.append((example, start, n))
                    items[i] = [example, start + n, tokens - n, share]
                    demand[i] = np.array([tokens - n, 1, (tokens - n) * share]) / self.limits
            if not keep and self.cut and not alive.any():
                yield from _powers(out)
            else:
                yield out
        self._items = [x for x, a in zip(items, alive) if a]


def _powers(pieces: list[tuple]) -> Iterator[list[tuple]]:
    total = sum(p[2] for p in pieces)
    sizes = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
    for size in sizes:
        out = []
        while size:
            example, start, n = pieces.pop(0)
            take = min(n, size)
            out.append((example, start, take))
            if take < n:
                pieces.insert(0, (example, start + take, n - take))
            size -= take
        yield out


def _pack(path: str | None, tokens: int, segments: int, loss: int) -> Callable:
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import public_tokenizers

        ids = loaded(path or public_tokenizers.path("byte_bpe_50k.json"))
        packer = Packer((tokens, segments, loss), cut=True)
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 32
        end = np.array([END], "<u4").tobytes()

        def frame(sequences: list[list[tuple]]) -> pd.DataFrame:
            nonlocal number
            rows = []
            for pieces in sequences:
                at = 0
                for (doc_id, data), start, n in pieces:
                    rows.append((doc_id, start, n, zlib.crc32(data[4 * start : 4 * (start + n)]), len(data) // 4, number, at))
                    at += n
                number += 1
            columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            out = pd.DataFrame(rows, columns=columns)
            out["doc_id"] = out["doc_id"].astype("Int64")
            return out

        for pdf in batches:
            done = []
            known = [None if pd.isna(x) else int(x) for x in pdf["doc_id"]]
            for doc_id, text, share in zip(known, pdf["text"], pdf["share"]):
                data = ids.of(text) + end
                n = len(data) // 4
                done.extend(packer.add((doc_id, data), n, int(n * share)))
                if len(done) >= STEP:
                    yield frame(done)
                    done = []
            yield frame(done)
        yield frame(list(packer.end()))

    return pack


def pack_documents(
    docs: DataFrame, tokenizer: str | None = None, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int | None = None, share: Column | None = None
) -> DataFrame:
    """The pieces of all documents (doc_id, text). tokenizer: the path of a tokenizers file.

    loss: the most loss-bearing tokens of a sequence (all its tokens if None); share: the share of a document's
    tokens that bear loss, from 0 to 1 (null: 1). Where it is below the limit on tokens, sequences may need padding.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    bearing = F.lit(1.0) if share is None else F.coalesce(F.least(F.greatest(share.cast("double"), F.lit(0.0)), F.lit(1.0)), F.lit(1.0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", bearing.alias("share"))
    return rows.mapInPandas(_pack(tokenizer, tokens, segments, loss or tokens), schema)
