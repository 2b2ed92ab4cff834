"""Operator 6: media columns as GIF.

A payload of bytes becomes the pixels of an animated GIF: frames of 64 pixels a row and ``FRAME_ROWS`` rows at most, shown
for ``DELAY`` hundredths of a second each, over a grey palette of 256 colours, so that a sample is the grey value of its
pixel. The encoder writes LZW codes that grow from nine to twelve bits and clears the table when it is full; the decoder
takes any LZW stream (growing codes, deferred clears), global and local palettes, interlacing, frame offsets, the disposal
methods 0 to 3 and transparent pixels, and gives the composed frames. How wide a code is follows from its place after the
last clear code, so that codes are packed and unpacked by array operations; the strings are looked up one by one.

Defined results: a null text is an empty one, which is stored as 64 zero bytes; equal texts give equal media; very long
texts have more frames; a null doc_id is kept; repeated rows are each stored; an empty table gives an empty result; other
columns are left alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import blocks, bounded, texts_of

WIDTH, FRAME_ROWS, DELAY = 64, 1024, 4
_FULL = 4096
_GREY = bytes(v for k in range(256) for v in (k, k, k))


# --------------------------------------------------------------------------- LZW


@lru_cache(9)
def _widths(min_size: int) -> np.ndarray:
    """The bits of each code after a clear code, up to the one from which on they no longer change. Before code k the
    table has grown by k - 1 strings."""
    first = (1 << min_size) + 2
    held = np.minimum(first + np.maximum(np.arange(_FULL - first + 2) - 1, 0), _FULL)
    return np.clip(np.floor(np.log2(held)).astype(np.int64) + 1, min_size + 1, 12)


def lzw_encode(samples: bytes, min_size: int = 8) -> bytes:
    """The LZW code stream of samples below 2 ** min_size: the table is cleared when it is full."""
    clear = 1 << min_size
    table: dict[int, int] = {}
    codes, clears = [clear], [0]  # the codes, and where clear codes stand
    get, put, free = table.get, codes.append, clear + 2
    if samples:
        held = samples[0]
        for x in memoryview(samples)[1:]:
            longer = get(held << 8 | x)
            if longer is not None:
                held = longer
                continue
            put(held)
            if free < _FULL:
                table[held << 8 | x] = free
                free += 1
            else:
                clears.append(len(codes))
                put(clear)
                table.clear()
                free = clear + 2
            held = x
        put(held)
    put(clear + 1)
    # a clear code is as wide as another code in its place
    value, starts = np.array(codes, np.int64), np.array(clears)
    place = np.arange(len(value)) - 1
    place[1:] -= np.repeat(starts, np.diff(np.append(starts, len(value) - 1)))
    widths = _widths(min_size)
    bits = widths[np.clip(place, 0, len(widths) - 1)]
    at = np.cumsum(bits) - bits
    value <<= at & 7
    size, byte = int(at[-1] + bits[-1] + 7) >> 3, at >> 3
    out = np.zeros(size + 3, np.int64)
    for k in range(3):  # no two codes share a bit, so that they add up
        out[: size + 3] += np.bincount(byte + k, value >> 8 * k & 255, size + 3).astype(np.int64)
    return out[:size].astype(np.uint8).tobytes()


def _codes(data: np.ndarray, at: int, min_size: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes from bit ``at`` on as they stand after a clear code, so many at most, and the bit after each."""
    widths = _widths(min_size)
    if most > len(widths):
        widths = np.append(widths, np.full(most - len(widths), 12))
    ends = at + np.cumsum(widths[:most])
    ends = ends[: np.searchsorted(ends, 8 * (len(data) - 3), "right")]
    begins = ends - widths[: len(ends)]
    byte = begins >> 3
    wide = data[byte].astype(np.int64) | data[byte + 1].astype(np.int64) << 8 | data[byte + 2].astype(np.int64) << 16
    return wide >> (begins & 7) & ((1 << widths[: len(ends)]) - 1), ends


def lzw_decode(data: bytes, min_size: int) -> np.ndarray:
    """The samples of an LZW code stream."""
    clear = 1 << min_size
    roots = [bytes([k]) for k in range(clear)] + [b"", b""]
    padded = np.frombuffer(data + b"\0\0\0", np.uint8)
    out: list[bytes] = []
    at, most = 0, _FULL
    table, held, ended, fresh = list(roots), b"", False, True
    while not ended:
        codes, ends = _codes(padded, at, min_size, most) if fresh else _codes_full(padded, at)
        if not len(codes):
            break  # the data ends without an end code
        stop = np.flatnonzero((codes == clear) | (codes == clear + 1))
        upto = int(stop[0]) if len(stop) else len(codes)
        for code in codes[:upto].tolist():
            n = len(table)
            if code < n:
                word = table[code]
            elif code == n and held:
                word = held + held[:1]
            else:
                raise ValueError("a code beyond the table")
            out.append(word)
            if held and n < _FULL:
                table.append(held + word[:1])
            held = word
        if len(stop):
            at, ended = int(ends[upto]), int(codes[upto]) == clear + 1
            table, held, fresh = list(roots), b"", True
        else:
            at, fresh = int(ends[-1]), False  # a full table that isn't cleared: codes of twelve bits go on
    return np.frombuffer(b"".join(out), np.uint8)


def _codes_full(data: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of twelve bits from bit ``at`` on."""
    ends = at + 12 * np.arange(1, _FULL + 1)
    ends = ends[: np.searchsorted(ends, 8 * (len(data) - 3), "right")]
    byte, shift = (ends - 12) >> 3, (ends - 12) & 7
    wide = data[byte].astype(np.int64) | data[byte + 1].astype(np.int64) << 8 | data[byte + 2].astype(np.int64) << 16
    return wide >> shift & 4095, ends


# --------------------------------------------------------------------------- GIF


def _sub_blocks(data: bytes) -> bytes:
    out = [len(data[k : k + 255]).to_bytes(1, "little") + data[k : k + 255] for k in range(0, len(data), 255)]
    return b"".join(out) + b"\0"


def encode(payload: bytes) -> bytes:
    """A GIF whose frames' pixels are the payload, a positive multiple of 64 bytes."""
    rows = len(payload) // WIDTH
    if not rows or len(payload) % WIDTH:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    u16 = lambda v: v.to_bytes(2, "little")
    out = [b"GIF89a", u16(WIDTH), u16(min(rows, FRAME_ROWS)), b"\xf7\0\0", _GREY, b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"]
    for top in range(0, rows, FRAME_ROWS):
        n = min(FRAME_ROWS, rows - top)
        pixels = payload[top * WIDTH : (top + n) * WIDTH]
        out += [b"\x21\xf9\x04\x08", u16(DELAY), b"\0\0", b"\x2c", u16(0), u16(0), u16(WIDTH), u16(n), b"\0\x08", _sub_blocks(lzw_encode(pixels))]
    return b"".join([*out, b"\x3b"])


def frames(data: bytes) -> Iterator[tuple[np.ndarray, tuple[int, int, int, int], int]]:
    """Each frame: the composed canvas (rows x width x RGB; a copy), the frame's box (left, top, width, height), the
    delay in hundredths of a second."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    word = lambda at: data[at] | data[at + 1] << 8
    width, height, flags, at = word(6), word(8), data[10], 13
    shared = None
    if flags & 0x80:
        n = 2 << (flags & 7)
        shared = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
    canvas = np.zeros((height, width, 3), np.uint8)
    disposal, delay, clear = 0, 0, None

    def blocks_at(at: int) -> tuple[bytes, int]:
        parts = []
        while data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(parts), at + 1

    while data[at] != 0x3B:
        if data[at] == 0x21:
            kind = data[at + 1]
            body, at = blocks_at(at + 2)
            if kind == 0xF9:
                disposal, delay, clear = body[0] >> 2 & 7, body[1] | body[2] << 8, body[3] if body[0] & 1 else None
            continue
        if data[at] != 0x2C:
            raise ValueError("an unknown block")
        left, top, w, h, local = word(at + 1), word(at + 3), word(at + 5), word(at + 7), data[at + 9]
        at, palette = at + 10, shared
        if local & 0x80:
            n = 2 << (local & 7)
            palette = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
            at += 3 * n
        body, end = blocks_at(at + 1)
        index = lzw_decode(body, data[at])[: w * h].reshape(h, w)
        at = end
        if local & 0x40:
            order = [r for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(start, h, step)]
            straight = np.empty_like(index)
            straight[order] = index
            index = straight
        before = canvas.copy() if disposal == 3 else None
        area = canvas[top : top + h, left : left + w]
        if clear is None:
            area[:] = palette[index]
        else:
            seen = index != clear
            area[seen] = palette[index[seen]]
        yield canvas.copy(), (left, top, w, h), delay
        if disposal == 2:
            area[:] = 0
        elif disposal == 3:
            canvas = before
        disposal, delay, clear = 0, 0, None


def samples_of(data: bytes) -> tuple[bytes, list[tuple[int, np.ndarray]]]:
    """The payload back from the frames, and each frame's delay and histogram of eight grey ranges."""
    parts, shown = [], []
    for canvas, (left, top, w, h), delay in frames(data):
        grey = canvas[top : top + h, left : left + w, 0]
        parts.append(grey.tobytes())
        shown.append((delay, np.bincount(grey.ravel() >> 5, minlength=8)))
    return b"".join(parts), shown


# --------------------------------------------------------------------------- columns


def _padded(text: str) -> tuple[bytes, int]:
    data = text.encode("utf-8", "surrogatepass")
    return data.ljust(max(64, -(-len(data) // 64) * 64), b"\0"), len(data)


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches):
        rows = [_padded(t) for t in texts_of(batch)]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([n for _, n in rows], pa.int64()), pa.array([encode(p) for p, _ in rows], pa.binary())], ["doc_id", "n_bytes", "media"])


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media binary) of every row of docs (doc_id, text)."""
    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_stored, "doc_id long, n_bytes long, media binary")


_FRAMES = "array<struct<delay:int,histogram:array<bigint>>>"


def _loaded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):  # a row at a time: media can be large
            part = batch.slice(k, 1)
            payload, shown = samples_of(part["media"][0].as_py())
            kind = pa.list_(pa.struct([("delay", pa.int32()), ("histogram", pa.list_(pa.int64()))]))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([payload], pa.binary()), pa.array([[{"delay": d, "histogram": h.tolist()} for d, h in shown]], kind)], [*part.schema.names, "payload", "frames"])


def load(media: DataFrame) -> DataFrame:
    """media (doc_id, n_bytes, media) with the decoded payload and its timed frames' histograms."""
    return media.mapInArrow(_loaded, f"doc_id long, n_bytes long, media binary, payload binary, frames {_FRAMES}")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        rows = []
        for doc, n, media in zip(*(batch[k].to_pylist() for k in ("doc_id", "n_bytes", "media")), strict=True):
            payload, shown = samples_of(media)
            histogram = sum(h for _, h in shown)
            feature = f"frames={len(shown)};cs={sum(d for d, _ in shown)};hist=" + ",".join(map(str, histogram.tolist()))
            rows.append((doc, n, len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:]) & 0xFFFFFFFF, len(media), sha256(media).hexdigest(), feature))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


def digests(media: DataFrame) -> DataFrame:
    """Read the stored media back; sizes, digests and features."""
    return media.mapInArrow(_digested, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
