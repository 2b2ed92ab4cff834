"""Passages: the chunks of a text's sections with the header under which they are embedded, and filters by section.

A passage's input is its header (the title, and the headings above it from the outermost on) and its text. The chunk's budget
is what the header leaves of ``input_chars``, but at least ``LEAST`` signs; an input that is longer all the same is marked,
not cut. Its digest tells whether a vector that was made of it still holds.

Defined results: a null text has no passages, nor has one without words or signs; a null title is empty; sections without a text
of their own, which only group others, have no passages but stay in the paths of those below them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import arrow, segments
from folioscope.sources.builds import Report, build

LEAST = 1000
_COLUMNS = "section int, level int, heading string, path array<string>, ord int, start int, stop int, words int, text string, input string, digest string, over boolean"


def passages_of(title: str, text: str, max_words: int, overlap: int, input_chars: int) -> list[tuple]:
    found: list[tuple] = []
    paths: list[list[str]] = []
    for number, s in enumerate(segments.sections(text)):
        path = [*(paths[s.parent] if s.parent is not None else []), *([s.heading] if s.heading else [])]
        paths.append(path)
        body = text[s.body : s.stop]
        if not body.strip():
            continue
        header = "\n".join(x for x in (title, " > ".join(path)) if x)
        room = max(LEAST, input_chars - len(header) - 1)
        for k, c in enumerate(segments.chunks(body, max_words, overlap, room)):
            said = body[c.lead : c.stop].strip()
            if not said:
                continue
            whole = f"{header}\n{said}" if header else said
            digest = hashlib.sha256(whole.encode("utf-8", "surrogatepass")).hexdigest()
            words = len(re.findall(r"[^\W_]+(?:['’-][^\W_]+)*", said))
            found.append((number, s.level, s.heading, path, k, s.body + c.lead, s.body + c.stop, words, said, whole, digest, len(whole) > input_chars))
    return found


def passages(df: DataFrame, key: str, text: str, title: str | None = None, max_words: int = 400, overlap: int = 60, input_chars: int = 2048) -> DataFrame:
    """(key, section, level, heading, path, ord, start, stop, words, text, input, digest, over) of every passage of df's texts."""
    held = df.select(F.col(key).alias("key"), F.concat(F.regexp_replace(F.coalesce(F.col(title), F.lit("")) if title else F.lit(""), r"\s+", " "), F.lit("\n"), F.col(text)).alias("both"))

    def rows_of(both: str) -> list[tuple]:
        head, _, body = both.partition("\n")
        return passages_of(head.strip(), body, max_words, overlap, input_chars)

    return arrow.exploded(held, "key", "both", _COLUMNS, rows_of).withColumnRenamed("key", key)


def in_section(heading: str) -> Column:
    """Whether a passage stands in a section of this name, or below one; names are compared as slugs."""
    wanted = re.sub(r"^-+|-+$", "", re.sub(r"[^a-z0-9]+", "-", heading.lower()))
    return F.exists("path", lambda h: T.slug(h) == wanted)


#: Kinds of content by words in a heading, in this order. Fixed values.
KINDS = (("personal", ("journal", "photo", "currently")), ("links", ("links", "briefly", "fortune")), ("meta", ("give back", "promotion", "sponsor")))


def content_kind(heading: Column, short: int = 4) -> Column:
    """The kind of a section by its heading: by the first rule whose word it holds; else ``essay`` if it is short, or ``reference``."""
    low, out = F.lower(F.coalesce(heading, F.lit(""))), None
    for kind, words in KINDS:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise(F.when(F.size(F.filter(F.split(low, r"\s+"), lambda w: w != "")) <= short, "essay").otherwise("reference"))


def embed(rows: DataFrame, path: str, columns: Sequence[str], recipe: str, vectors_of) -> Report:
    """Bring the vectors at path up to date with the passages (with distinct ``id``s): vectors_of makes (id, vector) of rows with
    id and input, and is given only those whose input or recipe is new."""
    return build(rows.select("id", *columns), path, "id", ["input"], recipe, vectors_of)
