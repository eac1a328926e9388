"""GIF as media columns: bytes stored as animated GIF, code streams decoded to timed frames with colour histograms.

The decoder reads any GIF87a or GIF89a: LZW code streams with growing codes, local palettes, interlacing, delays,
transparency and the disposals keep, clear to background and restore. Frames come one at a time on one canvas.

Defined results: a null text is empty; a payload is padded with bytes 255 up to a positive multiple of one frame, so
an empty text has one frame; equal texts give equal values; repeated rows are stored each; other columns are dropped;
an empty table gives an empty result; a null GIF has no frames.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

WIDTH, HEIGHT = 24, 96
#: A payload is padded to a multiple of this, 24 rows.
UNIT = 24 * WIDTH
GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()
BINS = 8
#: So many parts are encoded abreast and packed at once, fewer than FEW one by one; texts of so many bytes are stored together.
ABREAST, PACKED, FEW, TOGETHER = 2048, 128, 64, 1 << 23
_TABLES: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _widths(depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits of the codes that follow a clear code, the bits before each, and masks: they depend on their number alone.

    The table begins with (1 << depth) + 2 entries and grows by one with each code from the second on.
    """
    if depth not in _TABLES:
        entries = (1 << depth) + 2 + np.maximum(np.arange(4400) - 1, 0)
        widths = np.minimum(np.ceil(np.log2(entries + 1)).astype(np.int64), 12)
        _TABLES[depth] = widths, np.concatenate([[0], np.cumsum(widths)]), ((1 << widths) - 1).astype(np.uint32)
    return _TABLES[depth]


def _codes(data: bytes, depth: int) -> tuple[list[int], list[np.ndarray]]:
    """The codes of data, each times 256, and their widths."""
    clear, first, most = 1 << depth + 8, (1 << depth) + 2 << 8, 4096 << 8
    widths = _widths(depth)[0]
    table: dict[int, int] = {}
    find = table.get
    codes, bits, since, free = [clear], [np.array([depth + 1])], 1, first
    put = codes.append
    prefix = data[0] << 8 if data else None
    for byte in data[1:]:
        # codes of the table are never 0
        if code := find(key := prefix | byte):
            prefix = code
            continue
        put(prefix)
        prefix = byte << 8
        table[key] = free
        free += 256
        if free == most:
            bits += [widths[: len(codes) - since], widths[-1:]]
            put(clear)
            table.clear()
            since, free = len(codes), first
    if prefix is not None:
        put(prefix)
    put(clear + 256)
    bits.append(widths[: len(codes) - since])
    return codes, bits


def _codes_abreast(parts: list[bytes], depth: int) -> np.ndarray:
    """What _codes finds and a pad, a byte of each part at a time: a column for each part, with codes plus one between zeros.

    Parts come longest first and are too short to fill a table. Each part has its own hash table; an entry there has, plus
    one, the code before in 12 bits, then a byte, then, plus one, the code of both.
    """
    clear, lengths, lanes = 1 << depth, np.array([len(p) for p in parts]), np.arange(len(parts))
    longest = int(lengths[0])
    columns = np.frombuffer(b"".join(p.ljust(longest, b"\0") for p in parts), np.uint8).reshape(-1, longest).T.astype(np.uint32)
    columns <<= 12
    unfinished = np.searchsorted(-lengths, -np.arange(longest)).tolist()
    slots = longest.bit_length()
    spread, shift, wrap, base = np.uint32(0x9E377), np.uint32(32 - slots), (1 << slots) - 1, lanes << slots
    table = np.zeros(len(parts) << slots, np.uint32)
    # a code is in the row of the byte that ends it
    found = np.zeros((longest + 3, len(parts)), np.uint16)
    prefix, free = columns[0] + 4096 << 8, np.full(len(parts), clear + 3, np.uint32)
    for t in range(1, longest):
        n = unfinished[t]
        byte, before = columns[t, :n], prefix[:n]
        key = before | byte
        slot = (key * spread >> shift) + base[:n]
        entry = table[slot]
        code = entry ^ key
        known = code < 4096
        other = np.flatnonzero((entry != 0) > known)
        while len(other):
            at = slot[other]
            slot[other] = at = at & ~wrap | at + 1 & wrap
            entry[other] = here = table[at]
            code[other] = here = here ^ key[other]
            other = other[(here >= 4096) & (entry[other] != 0)]
        known = code < 4096
        new = ~known
        table[slot] = np.where(known, entry, key | free[:n])
        found[t, :n] = (before >> 20) * new
        prefix[:n] = np.where(known, code << 20, byte + 4096 << 8)
        free[:n] += new
    found[0] = clear + 1
    found[lengths, lanes] = prefix >> 20
    found[lengths + 1, lanes] = clear + 2
    found[lengths + 2, lanes] = 1
    return found


def _streams(found: np.ndarray, depth: int) -> list[bytes]:
    """The code streams of columns of codes."""
    rows = np.ascontiguousarray(found.T)
    there = rows != 0
    counts = np.count_nonzero(there, axis=1)
    codes, ends = rows[there] - 1, np.cumsum(counts)
    starts = ends - counts
    widths = np.append(depth + 1, _widths(depth)[0])[np.arange(len(codes)) - np.repeat(starts, counts)]
    widths[ends - 1] = 0
    bits = np.add.reduceat(widths, starts)
    widths[ends - 1] = -bits % 8
    data, sizes = _packed(codes, widths), np.cumsum(bits + 7 >> 3).tolist()
    return [data[start:end] for start, end in zip([0, *sizes], sizes)]


def _packed(codes: np.ndarray, widths: np.ndarray) -> bytes:
    pairs = codes.astype("<u2").view(np.uint8).reshape(-1, 2)
    used = np.arange(16, dtype=np.uint8) < widths.astype(np.uint8)[:, None]
    return np.packbits(np.unpackbits(pairs, axis=1, bitorder="little")[used], bitorder="little").tobytes()


def lzw_encode(parts: list[bytes], depth: int = 8) -> list[bytes]:
    """A code stream for each part."""
    streams = [b""] * len(parts)
    short = [i for i, p in enumerate(parts) if 0 < len(p) <= 4094 - (1 << depth)]
    short.sort(key=lambda i: -len(parts[i]))
    alone = set(range(len(parts)))
    for at in range(0, len(short), ABREAST):
        chosen = short[at : at + ABREAST]
        if len(chosen) < FEW:
            break
        alone.difference_update(chosen)
        found = _codes_abreast([parts[i] for i in chosen], depth)
        for start in range(0, len(chosen), PACKED):
            for i, stream in zip(chosen[start:], _streams(found[:, start : start + PACKED], depth)):
                streams[i] = stream
    for i in alone:
        codes, widths = _codes(parts[i], depth)
        streams[i] = _packed(np.array(codes, np.uint32) >> 8, np.concatenate(widths))
    return streams


def _samples(codes: np.ndarray, clear: int, limit: int) -> np.ndarray:
    """What the codes after a clear code draw, up to the code that reaches the limit; the first code is a sample.

    The entry that code i makes is what code i draws and the next sample. So all but the last sample of a code lie where its
    entry was made, and what lies there was drawn likewise; ways back to samples are found by doubling their steps.
    """
    number, plain = np.arange(len(codes)), codes < clear
    # codes of entries that are not made yet stand for the one being made
    made = np.where(plain, number, np.minimum(codes - clear - 2, number - 1))
    lengths, root = 2 - plain, made
    while (more := lengths[root] - 1).any():
        lengths, root = lengths + more, root[root]
    last = codes[root[np.where(plain, number, made + 1)]]
    ends = np.cumsum(lengths)
    if ends[-1] > limit:
        n = int(np.searchsorted(ends, limit)) + 1
        made, last, lengths, ends = made[:n], last[:n], lengths[:n], ends[:n]
    starts = ends - lengths
    source = np.arange(ends[-1]) - np.repeat(starts - starts[made], lengths)
    source[ends - 1] = ends - 1
    steps, most = 1, int(lengths.max()) - 1
    while steps < most:
        source, steps = source[source], 2 * steps
    drawn = np.zeros(ends[-1], np.uint8)
    drawn[ends - 1] = last
    return drawn[source]


def lzw_decode(stream: bytes, depth: int, limit: int) -> bytes:
    """The first `limit` samples of a code stream; a damaged stream gives what comes before the damage."""
    clear, stop = 1 << depth, (1 << depth) + 1
    raw = np.frombuffer(stream + bytes(4), np.uint8).astype(np.uint32)
    words = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    widths, sums, masks = _widths(depth)
    at, out, size, total = 0, [], 0, 8 * len(stream)
    while size < limit and at < total:
        # a clear code at the start, or after another
        while at + depth < total and int(words[at >> 3]) >> (at & 7) & (1 << depth + 1) - 1 == clear:
            at += depth + 1
        n = min(int(np.searchsorted(sums, total - at, side="right")) - 1, len(widths))
        offsets = sums[:n] + at
        codes = words[offsets >> 3] >> (offsets & 7).astype(np.uint32) & masks[:n]
        ends = np.flatnonzero((codes == clear) | (codes == stop))
        k = int(ends[0]) if len(ends) else n
        end = int(offsets[k] + widths[k]) if k < n else None
        after = at + int(sums[n])
        while k == n == len(codes) >= len(widths) and after + 12 <= total and n < limit:
            # no clear code though the table is full: codes of 12 bits go on
            offsets = np.arange(after, min(after + 12 * 4096, total - 11), 12)
            more = words[offsets >> 3] >> (offsets & 7).astype(np.uint32) & np.uint32(4095)
            ends = np.flatnonzero((more == clear) | (more == stop))
            codes, k, n = np.append(codes, more), n + (int(ends[0]) if len(ends) else len(more)), n + len(more)
            end = after + 12 * int(ends[0] + 1) if len(ends) else None
            after += 12 * len(more)
        if k:
            if codes[0] >= clear:
                break
            out.append(_samples(codes[:k].astype(np.intp), clear, limit - size).tobytes())
            size += len(out[-1])
        if end is None or codes[k] == stop:
            break
        at = end
    return b"".join(out)[:limit]


@dataclass
class Frame:
    number: int
    delay_ms: int
    place: tuple[int, int, int, int]  # left, top, width and height of what the frame draws
    pixels: np.ndarray  # the whole canvas: height, width, RGBA

    def drawn(self) -> np.ndarray:
        x, y, w, h = self.place
        return self.pixels[y : y + h, x : x + w]


def histogram(pixels: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Counts of red, of green and of blue over opaque pixels."""
    flat = pixels.reshape(-1, 4)
    shown = flat[:, 3] > 0
    if not shown.all():
        flat = flat[shown]
    values = np.concatenate([np.bincount(flat[:, i], minlength=256) for i in range(3)])
    counts = np.zeros(3 * bins, np.intp)
    np.add.at(counts, np.add.outer(np.arange(3) * bins, np.arange(256) * bins >> 8).ravel(), values)
    return counts


def encode(payload: bytes, width: int = WIDTH, height: int = HEIGHT, delay_cs: int = 10) -> bytes:
    return encode_all([payload], width, height, delay_cs)[0]


def encode_all(payloads: list[bytes], width: int = WIDTH, height: int = HEIGHT, delay_cs: int = 10) -> list[bytes]:
    """Grey frames of the whole width, one after another; a payload's last is as high as it needs."""
    full = width * height
    parts = [[p[i : i + full] for i in range(0, len(p), full)] for p in payloads]
    streams = iter(lzw_encode([part for own in parts for part in own]))
    return [_file(own, list(islice(streams, len(own))), width, delay_cs) for own in parts]


def _file(parts: list[bytes], streams: list[bytes], width: int, delay_cs: int) -> bytes:
    out = [b"GIF89a", struct.pack("<HHBBB", width, len(parts[0]) // width, 0xF7, 0, 0), GREY, b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00"]
    for part, data in zip(parts, streams):
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 0x04, delay_cs, 0, 0))
        out.append(struct.pack("<BHHHHBB", 0x2C, 0, 0, width, len(part) // width, 0, 8))
        out += [bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)]
        out.append(b"\x00")
    return b"".join([*out, b"\x3b"])


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 2 << (flags & 7)
    colours = np.zeros((256, 4), np.uint8)
    colours[:, 3] = 255
    colours[:n, :3] = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
    return colours.view(np.uint32)[:, 0], at + 3 * n


def _rows(height: int) -> np.ndarray:
    """Where the rows of an interlaced image go."""
    return np.concatenate([np.arange(0, height, 8), np.arange(4, height, 8), np.arange(2, height, 4), np.arange(1, height, 2)])


def decode(data: bytes) -> Iterator[Frame]:
    if data[:3] != b"GIF":
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, common = 13, None
    if flags & 0x80:
        common, at = _palette(data, at, flags)
    canvas = np.zeros((height, width), np.uint32)  # RGBA in four bytes
    delay, disposal, clear, number = 0, 0, None, 0

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while at < len(data) and data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(parts), at + 1

    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            body, after = blocks(at + 2)
            if data[at + 1] == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, 10 * int.from_bytes(body[1:3], "little")
                clear = body[3] if body[0] & 1 else None
            at = after
        elif data[at] == 0x2C:
            x, y, w, h, local = struct.unpack_from("<HHHHB", data, at + 1)
            at, colours = at + 10, common
            if local & 0x80:
                colours, at = _palette(data, at, local)
            depth = data[at]
            stream, at = blocks(at + 1)
            samples = np.frombuffer(lzw_decode(stream, depth, w * h).ljust(w * h, b"\x00"), np.uint8).reshape(h, w)
            if local & 0x40:
                ordered = np.empty_like(samples)
                ordered[_rows(h)] = samples
                samples = ordered
            before = canvas.copy() if disposal == 3 else None
            place = canvas[y : y + h, x : x + w]
            samples = samples[: place.shape[0], : place.shape[1]]
            if clear is None:
                place[...] = colours[samples]
            else:
                seen = samples != clear
                place[seen] = colours[samples[seen]]
            pixels = canvas.copy().view(np.uint8).reshape(height, width, 4)
            yield Frame(number, delay, (x, y, place.shape[1], place.shape[0]), pixels)
            if disposal == 2:
                place[...] = 0
            elif before is not None:
                canvas = before
            delay, disposal, clear, number = 0, 0, None, number + 1
        else:
            break


def stored(docs: DataFrame, unit: int = UNIT, together: int = TOGETHER) -> DataFrame:
    """doc_id, n_bytes, gif of every document (doc_id, text)."""

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = [(t or "").encode("utf-8", "replace") for t in pdf["text"]]
            sizes = np.array([len(r) for r in raw], np.int64)
            places = np.cumsum(sizes) // together
            for rows in np.split(np.arange(len(raw)), np.flatnonzero(np.diff(places)) + 1):
                padded = [raw[i].ljust(max(1, -(-len(raw[i]) // unit)) * unit, b"\xff") for i in rows]
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[rows].astype("Int64"), "n_bytes": sizes[rows], "gif": encode_all(padded)})

    return docs.select("doc_id", "text").mapInPandas(store, "doc_id long, n_bytes long, gif binary")


def frames(media: DataFrame) -> DataFrame:
    """doc_id, frame, delay_ms, width, height, rgba, histogram of every frame of media (doc_id, gif)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc_id, data in zip(pdf["doc_id"], pdf["gif"]):
                if data is not None:
                    for f in decode(bytes(data)):
                        yield pd.DataFrame(
                            {
                                "doc_id": pd.array([doc_id], dtype="Int64"),
                                "frame": [f.number],
                                "delay_ms": [f.delay_ms],
                                "width": [f.pixels.shape[1]],
                                "height": [f.pixels.shape[0]],
                                "rgba": [f.pixels.tobytes()],
                                "histogram": [histogram(f.pixels).tolist()],
                            }
                        )

    return media.select("doc_id", "gif").mapInPandas(
        read, "doc_id long, frame int, delay_ms int, width int, height int, rgba binary, histogram array<long>"
    )


def digests(media: DataFrame) -> DataFrame:
    """What the stored GIFs of media (doc_id, n_bytes, gif) hold: payloads read back, and a histogram of all frames."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, n, data in zip(pdf["doc_id"], pdf["n_bytes"], pdf["gif"]):
                data = bytes(data)
                sha, size, tail, shown, count, time = hashlib.sha256(), 0, b"", np.zeros(3 * BINS, int), 0, 0
                for f in decode(data):
                    drawn = f.drawn()
                    part = drawn[..., 0].tobytes()
                    sha.update(part)
                    size, tail, count, time = size + len(part), (tail + part)[-32:], count + 1, time + f.delay_ms
                    shown += histogram(drawn)
                feature = f"{count}x{time}:" + ",".join(map(str, shown))
                rows.append((doc_id, n, size, sha.hexdigest(), zlib.crc32(tail), len(data), hashlib.sha256(data).hexdigest(), feature))
            out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "gif").mapInPandas(digest, schema)
