"""Word and shingle arithmetic on NumPy arrays, shared by the operators that read text.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D after lower-casing A-Z.
Null texts count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with avalanche (the splitmix64 finaliser)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = U64(0xD1342543DE82EF95)
_BASE_INVERSE = U64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_WEIGHTS = mix64(np.arange(101, 201, dtype=U64)) | U64(1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, U64), np.multiply.accumulate(np.full(max(n - 1, 0), base, U64))])


_TABLES: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _TABLES or len(_TABLES["up"]) < n:
        _TABLES["up"], _TABLES["down"] = _powers(_BASE, n), _powers(_BASE_INVERSE, n)
    return _TABLES["up"], _TABLES["down"]


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").translate(LOWER)


def blocks(texts: Sequence[str | None], limit: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of whole texts of about `limit` bytes, each with the position of its first text."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        b = normalised(t)
        if held and size + len(b) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(b)
        size += len(b)
    if held:
        yield first, held


def word_hashes(block: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a block in order, and for each text where its words begin (one more at the end)."""
    joined = b" ".join(block) + b" "
    buf = np.frombuffer(joined, np.uint8)
    gap = _SPACE[buf]
    before = np.concatenate([[True], gap[:-1]])
    starts, ends = np.flatnonzero(~gap & before), np.flatnonzero(gap & ~before)
    up, down = _power_tables(len(buf))
    total = np.cumsum(_BYTE[buf] * up[: len(buf)], dtype=U64)
    total = np.concatenate([np.zeros(1, U64), total])
    hashes = mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))
    at = np.cumsum([0, *(len(b) + 1 for b in block)])
    return hashes, np.searchsorted(starts, at)


def shingle_sets(block: Sequence[bytes], width: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its word shingles; a text of fewer words has its whole sequence as one."""
    words, at = word_hashes(block)
    n = max(len(words) - width + 1, 0)
    runs = np.zeros(n, U64)
    for j in range(width):
        runs += words[j : j + n] * _WEIGHTS[j]
    runs = mix64(runs)
    out = []
    for lo, hi in zip(at[:-1], at[1:]):
        if hi - lo >= width:
            out.append(np.unique(runs[lo : hi - width + 1]))
        elif hi > lo:
            out.append(mix64(np.array([np.sum(words[lo:hi] * _WEIGHTS[: hi - lo], dtype=U64) + U64(hi - lo)], U64)))
        else:
            out.append(np.zeros(0, U64))
    return out
