"""Operator 11: periodic runs of words by a harmonic grid and prefix hashes.

A run is a maximal stretch of words with smallest period q and a length of at least ``LEAST`` and ``TIMES * q``.

1. A document's words become numbers, by the words themselves. In a run of period p, the words that equal the one p
   further on form a stretch of at least step(p) = max(LEAST - p, (TIMES - 1) * p) places, which holds a multiple of
   step(p). So for each period only every step(p)-th place is looked at: n / 2 * ln n pairs (period, place) in all.
2. A pair stays if ``WINDOW`` words after or before its place equal those p further on, by their hashes.
3. Binary search on prefix hashes finds how far the equal words reach to both sides, for all pairs left at once.
4. Each run is found from several places and, with multiples of its period, several times: of one start and length, the
   smallest period stays. Its words are then compared one by one, and so are its neighbours. Where a hash was wrong, the
   pairs of the document are extended word by word instead.

Documents don't meet, so that nothing is shuffled; pairs are made ``PAIRS`` at a time.

Defined results: a null text has no words; repeated rows each get their result; a null doc_id is kept, and its words are
never planted; a run may lie in another one of a longer period; an empty table gives an empty result; other columns are
left alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from hashlib import sha256
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import blocks, bounded, crc32, expand, mix, texts_of

LEAST, TIMES, WINDOW = 24, 3, 8
PAIRS = 1 << 19
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def split_words(text: str) -> list[bytes]:
    """Maximal stretches of bytes other than space and tab to carriage return."""
    return text.encode("utf-8", "surrogatepass").split()


def numbers(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers, others different ones."""
    seen: dict[bytes, int] = {}
    fresh = count()
    return np.fromiter((k if (k := seen.get(w)) is not None else seen.setdefault(w, next(fresh)) for w in words), np.int64, len(words))


class Prefixes:
    """Hashes of stretches of a sequence in constant time each. They are polynomials modulo 2^64, and callers verify."""

    def __init__(self, w: np.ndarray):
        n = len(w)
        self.power = np.full(n + 1, _BASE, U64)
        self.power[0] = 1
        np.multiply.accumulate(self.power, out=self.power)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(mix(w.astype(U64) + U64(1)) * self.power[:n], out=self.sums[1:])
        inverse = np.full(max(1, n - WINDOW + 1), _INVERSE, U64)
        inverse[0] = 1
        np.multiply.accumulate(inverse, out=inverse)
        self.windows = (self.sums[WINDOW:] - self.sums[: len(self.sums) - WINDOW]) * inverse

    def equal(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether size elements from i on equal those from j on (i <= j)."""
        return (self.sums[i + size] - self.sums[i]) * self.power[j - i] == self.sums[j + size] - self.sums[j]

    def reach(self, i: np.ndarray, p: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many elements after (or before) i equal those p further on, at most so many: binary search at all places."""
        low, high = np.zeros(len(i), np.int64), most.astype(np.int64)
        while (low < high).any():
            middle = (low + high + 1) >> 1
            begin = i - middle if back else i
            same = self.equal(begin, begin + p, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low


def _grid(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(periods, places) of the harmonic grid, about PAIRS at a time."""
    periods = np.arange(1, n // TIMES + 1, dtype=np.int64)
    steps = np.maximum(LEAST - periods, (TIMES - 1) * periods)
    held = -(-(n - periods) // steps)
    parts = np.cumsum(held) // PAIRS
    for part in np.split(np.arange(len(periods)), np.flatnonzero(np.diff(parts)) + 1):
        if len(part):
            p, m = np.repeat(periods[part], held[part]), np.repeat(steps[part], held[part])
            yield p, expand(np.zeros(len(part), np.int64), held[part]) * m


def _long_enough(length: np.ndarray, p: np.ndarray) -> np.ndarray:
    return length >= np.maximum(LEAST, TIMES * p)


def _is_run(w: np.ndarray, start: int, length: int, p: int) -> bool:
    end = start + length
    if not np.array_equal(w[start : end - p], w[start + p : end]):
        return False
    return (start == 0 or w[start - 1] != w[start - 1 + p]) and (end == len(w) or w[end] != w[end - p])


def _by_words(w: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """(start, length, period) of the stretches of these periods, without hashes."""
    found = []
    for p in np.unique(periods).tolist():
        edge = np.diff((w[:-p] == w[p:]).view(np.int8), prepend=np.int8(0), append=np.int8(0))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        found.append(np.stack([start, end - start + p, np.full(len(start), p)], 1))
    found = np.concatenate(found)
    return found[_long_enough(found[:, 1], found[:, 2])]


def _smallest(found: np.ndarray) -> np.ndarray:
    """Of the rows (start, length, period) of one start and length the one of the smallest period."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    return found[np.any(np.diff(found[:, :2], axis=0, prepend=-1), axis=1)]


def find_runs(w: np.ndarray) -> np.ndarray:
    """(start, length, period) of every run of a sequence of numbers, by start and then period."""
    n, none = len(w), np.zeros((0, 3), np.int64)
    if n < LEAST:
        return none
    prefixes = Prefixes(w)
    windows, last = prefixes.windows, n - WINDOW
    found, periods = [none], [np.zeros(0, np.int64)]
    for p, i in _grid(n):
        after = i + p <= last
        after[after] = windows[i[after]] == windows[(i + p)[after]]
        before = ~after & (i >= WINDOW - 1)
        at = i[before] - (WINDOW - 1)
        before[before] = windows[at] == windows[at + p[before]]
        p, i = p[after | before], i[after | before]
        if not len(p):
            continue
        back, on = prefixes.reach(i, p, i, True), prefixes.reach(i, p, n - p - i, False)
        rows = np.stack([i - back, back + on + p, p], 1)
        found.append(_smallest(rows[_long_enough(rows[:, 1], p)]))
        periods.append(np.unique(p))
    runs = _smallest(np.concatenate(found))
    if not all(_is_run(w, *row) for row in runs.tolist()):
        runs = _smallest(_by_words(w, np.concatenate(periods)))
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words no run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) == 0


def greatest(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run of the greatest length / period, compared exactly; of equal ones the one of the smallest start, then period."""
    if not len(runs):
        return None
    share = runs[:, 1] / runs[:, 2]
    near = runs[share >= share.max() * (1 - 1e-9)].tolist()
    return tuple(min(near, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])))


def plant(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """Of one document in ten by the hash of its doc_id, the words from some place on repeat a first part of them."""
    h, n = crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    times = -(-(n - a) // p)
    return words[:a] + (words[a : a + p] * times)[: n - a]


Change = Callable[[list[bytes], int | None], list[bytes]]


def _documents(batches: Iterator[pa.RecordBatch], change: Change | None) -> Iterator[tuple[list, list[list[bytes]], list[np.ndarray]]]:
    for batch in blocks(batches):
        ids = batch["doc_id"].to_pylist()
        words = [split_words(t) for t in texts_of(batch)]
        if change:
            words = [change(w, i) for w, i in zip(words, ids, strict=True)]
        yield ids, words, [find_runs(numbers(w)) for w in words]


def _input(docs: DataFrame) -> DataFrame:
    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def runs(docs: DataFrame, change: Change | None = None) -> DataFrame:
    """(doc_id, start, length, period) of every run of docs (doc_id, text). change: makes other words of a document's."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, found in _documents(batches, change):
            at = np.repeat(np.arange(len(ids)), [len(f) for f in found])
            flat = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in at.tolist()], pa.int64()), *(pa.array(flat[:, k]) for k in range(3))], ["doc_id", "start", "length", "period"])

    return _input(docs).mapInArrow(rows, "doc_id long, start long, length long, period long")


def collapsed(docs: DataFrame, change: Change | None = None) -> DataFrame:
    """(doc_id, text) of docs, each run shortened to its first period and words joined by one space."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words, found in _documents(batches, change):
            texts = [b" ".join(w for w, k in zip(ws, kept(len(ws), f).tolist(), strict=True) if k).decode("utf-8", "surrogatepass") for ws, f in zip(words, found, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return _input(docs).mapInArrow(rows, "doc_id long, text string")


_DIGESTS = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])


def _digest(doc_id: int | None, words: list[bytes], found: np.ndarray) -> tuple:
    best = greatest(found)
    shown = (None, None, None, None) if best is None else (*best, 1000 * best[1] // best[2])
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in found.tolist())
    stay = kept(len(words), found).tolist() if len(found) else None
    text = b" ".join(words if stay is None else [w for w, k in zip(words, stay, strict=True) if k])
    return doc_id, len(found), *shown, sha256(listed.encode()).hexdigest(), sha256(text).hexdigest()


def digests(docs: DataFrame, change: Change | None = None) -> DataFrame:
    """One row per document: number of runs, the greatest one, digests of all runs and of the collapsed text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words, found in _documents(batches, change):
            out = list(map(_digest, ids, words, found))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(_DIGESTS)], schema=_DIGESTS)

    kinds = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in _DIGESTS)
    return _input(docs).mapInArrow(rows, kinds)
