"""Sections and chunks of whole texts, as places in them.

Sections: a heading of Markdown (one to four number signs, outside of fenced code) opens a section that reaches to the next
one; its parent is the last section of a lower level before it. What stands before the first heading is section 0.

Chunks: a text is cut into stretches that follow one another without a gap, each of at most ``max_words`` words and
``max_chars`` characters, its lead-in included. A cut is made at the last blank line that the budget reaches, else at the
last end of a sentence or line, else at the last space, none of them inside a link or tag, else at any space, else
within a word. The lead-in is the end of the stretch before, word for word: the sentences that lie within its last
``overlap`` words or, without one, those words, but never from inside a link or tag; one of more than half the room goes.

Defined results: a null text has no sections and no chunks; an empty one has none either; places are in code points; the
bodies of a text's chunks, one after another, are the text.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators import arrow

_HEADING = re.compile(r"^(#{1,4})[ \t]+(.*?)[ \t]*#*[ \t]*$", re.M)
_FENCE = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\Z)", re.M | re.S)
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_WHOLE = re.compile(r"!?\[[^\]]*\]\([^)]*\)|<[^<>]*>")
_BLANK_LINE = re.compile(r"\n[ \t]*\n\s*")
_SENTENCE = re.compile(r"[.!?][\"'’”)\]*_]*[ \t]+|\n+")
_SPACE = re.compile(r"[ \t]+")


class Section(NamedTuple):
    level: int
    heading: str
    parent: int | None
    start: int
    body: int
    stop: int


def sections(text: str) -> list[Section]:
    """The sections of a text in order; ``body`` is where the line after the heading begins."""
    code = [m.span() for m in _FENCE.finditer(text)]
    heads = [m for m in _HEADING.finditer(text) if not _within(code, m.start())]
    found: list[Section] = []
    if text[: heads[0].start() if heads else len(text)].strip():
        found.append(Section(0, "", None, 0, 0, heads[0].start() if heads else len(text)))
    above: list[tuple[int, int]] = []  # the open sections: level and number
    for k, m in enumerate(heads):
        level = len(m[1])
        while above and above[-1][0] >= level:
            above.pop()
        stop = heads[k + 1].start() if k + 1 < len(heads) else len(text)
        found.append(Section(level, m[2], above[-1][1] if above else None, m.start(), min(m.end() + 1, stop), stop))
        above.append((level, len(found) - 1))
    return found


def _within(spans: list[tuple[int, int]], at: int) -> bool:
    """Whether a place lies inside one of the spans (in order, apart), not at its edge."""
    k = bisect_left(spans, (at,)) - 1
    return k >= 0 and spans[k][0] < at < spans[k][1] or k + 1 < len(spans) and spans[k + 1][0] == at < spans[k + 1][0]


class Chunk(NamedTuple):
    lead: int
    start: int
    stop: int


def chunks(text: str, max_words: int = 400, overlap: int = 60, max_chars: int = 2000) -> list[Chunk]:
    """The chunks of a text: text[lead:stop] is a chunk, text[start:stop] its own body."""
    if not 0 <= overlap < max_words or max_chars < 2:
        raise ValueError("the overlap must be smaller than a chunk")
    n, whole = len(text), [m.span() for m in _WHOLE.finditer(text)]
    outside = lambda found: [e for e in (m.end() for m in found) if not _within(whole, e)]
    words = [m.start() for m in _WORD.finditer(text)]
    sentence_ends = outside(_SENTENCE.finditer(text))
    cuts = [outside(_BLANK_LINE.finditer(text)), sentence_ends, outside(_SPACE.finditer(text)), [m.end() for m in _SPACE.finditer(text)]]
    found: list[Chunk] = []
    lead = start = 0
    while start < n:
        last_word = bisect_left(words, lead) + max_words  # the first word that is too many
        most = min(n, lead + max_chars, words[last_word] if last_word < len(words) else n)
        stop = n if most == n else 0
        for places in cuts:
            if stop:
                break
            k = bisect_right(places, most) - 1
            if k >= 0 and places[k] > start:
                stop = places[k]
        stop = stop or max(most, start + 1)
        found.append(Chunk(lead, start, stop))
        lead = _lead(text, words, sentence_ends, whole, start, stop, overlap)
        if stop - lead > max_chars // 2:
            lead = stop
        start = stop
    return found


def _lead(text: str, words: list[int], sentences: list[int], whole: list[tuple[int, int]], start: int, stop: int, overlap: int) -> int:
    """Where the lead-in of the chunk that begins at stop starts, within the stretch from start on."""
    first = max(bisect_left(words, start), bisect_left(words, stop) - overlap)
    if not overlap or first >= len(words) or words[first] >= stop:
        return stop
    cut = words[first]
    k = bisect_left(sentences, cut)
    if k < len(sentences) and sentences[k] < stop and text[sentences[k] : stop].strip():
        return sentences[k]
    inside = bisect_left(whole, (cut,)) - 1
    if inside >= 0 and whole[inside][0] < cut < whole[inside][1]:
        cut = whole[inside][1]
    return min(cut, stop)


def section_rows(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, ord, level, heading, parent, start, body, stop) of every section of df's texts; parent: an ord."""
    rows_of = lambda t: [(k, *s) for k, s in enumerate(sections(t))]
    return arrow.exploded(df, key, text, "ord int, level int, heading string, parent int, start int, body int, stop int", rows_of)


def chunk_rows(df: DataFrame, key: str, text: str = "text", max_words: int = 400, overlap: int = 60, max_chars: int = 2000) -> DataFrame:
    """(key, ord, lead, start, stop, words, chunk, body) of every chunk of df's texts."""

    def rows_of(t: str) -> list[tuple]:
        return [(k, c.lead, c.start, c.stop, len(_WORD.findall(t[c.lead : c.stop])), t[c.lead : c.stop], t[c.start : c.stop]) for k, c in enumerate(chunks(t, max_words, overlap, max_chars))]

    return arrow.exploded(df, key, text, "ord int, lead int, start int, stop int, words int, chunk string, body string", rows_of)


def html_to_markdown(html: Column) -> Column:
    """Markdown of a page: headings, paragraphs, list items and links; scripts, styles, comments and other tags go, entities
    are resolved. DataFrame functions only."""
    c = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<head\b.*?</head\s*>", " ")
    c = F.regexp_replace(c, r"\s+", " ")
    for level in range(1, 5):
        c = F.regexp_replace(c, rf"(?i) *<h{level}\b[^>]*> *", "\n\n" + "#" * level + " ")
    c = F.regexp_replace(c, r"(?i) *<li\b[^>]*> *", "\n- ")
    c = F.regexp_replace(c, r"(?i) *</?(?:p|h[1-6]|div|ul|ol|article|section|table|tr|blockquote)\b[^>]*> *", "\n\n")
    c = F.regexp_replace(c, r"(?i) *<br\s*/?> *", "\n")
    c = F.regexp_replace(c, r"(?i)<a\b[^>]*\bhref=\"([^\">]*)\"[^>]*>([^<]*)</a\s*>", "[$2]($1)")
    c = F.regexp_replace(c, r"<[^>]+>", "")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(c, r"\n{3,}", "\n\n"))
