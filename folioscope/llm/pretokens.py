"""Byte-level BPE pre-tokens of many texts at once, by array operations.

The split is that of the pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``:
runs of letters, digits and other signs, each with one space before it; of white space that
something follows, all but the last character is a token of its own.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

from folioscope.llm.common import expand, mix, span_hashes

LETTER, DIGIT, SPACE, OTHER = 0, 1, 2, 3
#: Symbols that are compared at a time.
COMPARED = 1 << 18


@lru_cache(1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """The class and a random 64-bit code of each code point."""
    top = 0x110000
    every = "".join(map(chr, range(0xD800))) + "\0" * 0x800 + "".join(map(chr, range(0xE000, top)))
    kinds = np.full(top, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            kinds[m.start() : m.end()] = kind
    return kinds, mix(np.arange(1, top + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def starts_of(u: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in the code points u; docs: the start of each text, in order, without empty texts."""
    n = len(u)
    kinds = _classes()[0][u]
    first = np.zeros(n + 1, bool)  # of a text; also the end
    first[docs] = True
    first[n] = True
    change = np.empty(n + 1, bool)
    change[0] = change[n] = True
    np.not_equal(kinds[1:], kinds[:-1], out=change[1:n])
    change |= first
    start = change[:n].copy()
    blank = u == 32
    # a run after one space that belongs to the same text takes the space
    takes = np.zeros(n, bool)
    takes[1:] = start[1:] & ~first[1:n] & blank[:-1] & (kinds[1:] != SPACE)
    start[takes] = False
    # the last white space before something else is cut off from what precedes it
    last = np.zeros(n, bool)
    last[:-1] = (kinds[:-1] == SPACE) & change[1:n] & ~first[1:n]
    start |= last
    # contractions
    at = np.flatnonzero(start & (u == 39))
    if len(at):
        padded = np.concatenate([u, np.zeros(3, u.dtype)])
        bound = np.concatenate([first[1:], np.ones(3, bool)])  # bound[i]: text ends after i
        a, b = padded[at + 1], padded[at + 2]
        one = np.isin(a, [115, 116, 109, 100]) & ~bound[at]
        two = (((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)) & ~bound[at] & ~bound[at + 1]
        for hit, size in ((at[one], 2), (at[two], 3)):
            start[hit + 1] = False
            after = hit + size
            start[after[after < n]] = True
    return np.flatnonzero(start)


class Spans:
    """The pre-tokens of a block of texts: where they start and end in the joined text, their hashes, and the number of
    them in each text."""

    def __init__(self, texts: list[str]):
        self.joined = "".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.symbols = u = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), "<u4")
        begins = np.cumsum(sizes) - sizes
        self.starts = starts_of(u, begins[sizes > 0]) if len(u) else np.zeros(0, np.int64)
        self.ends = np.append(self.starts[1:], len(u)) if len(u) else self.starts
        self.hashes = span_hashes(u, _classes()[1], self.starts, self.ends)
        self.counts = np.diff(np.searchsorted(self.starts, np.append(begins, len(u))))

    def words(self, at: np.ndarray) -> list[str]:
        return [self.joined[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist(), strict=True)]


def differ(symbols: np.ndarray, starts: np.ndarray, lens: np.ndarray, known: np.ndarray, known_starts: np.ndarray, known_lens: np.ndarray) -> bool:
    """Whether any word symbols[start : start + len] isn't the known word of the same place in the lists."""
    if not np.array_equal(lens, known_lens):
        return True
    parts = np.flatnonzero(np.diff(np.cumsum(lens) // COMPARED, prepend=0)) + 1
    for a, b in zip([0, *parts.tolist()], [*parts.tolist(), len(lens)], strict=True):
        if not np.array_equal(symbols[expand(starts[a:b], lens[a:b])], known[expand(known_starts[a:b], lens[a:b])]):
            return True
    return False


def block(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Of a block of texts: each pre-token's index in the list of distinct words, in order of position; the number of
    pre-tokens of each text; the distinct words; their hashes."""
    spans = Spans(texts)
    distinct, index, codes = np.unique(spans.hashes, return_index=True, return_inverse=True)
    words = spans.words(index)
    lens = spans.ends - spans.starts
    first = index[codes]
    if differ(spans.symbols, spans.starts, lens, spans.symbols, spans.starts[first], lens[first]):  # two words of one hash
        seen: dict[str, int] = {}
        codes = np.fromiter((seen.setdefault(w, len(seen)) for w in spans.words(np.arange(len(lens)))), np.int64, len(lens))
        words = list(seen)
        distinct = mix(np.fromiter((hash_word(w) for w in words), np.uint64, len(words)))
    return codes, spans.counts, words, distinct


def hash_word(word: str) -> int:
    u = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), "<u4")
    return int(span_hashes(u, _classes()[1], np.zeros(1, np.int64), np.full(1, len(u)))[0])
