"""Terms compiled, on the driver, to regular expressions that Spark evaluates: exact words, phrases, stems, literals."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

GAP = r"[^\p{L}\p{N}]+"
_BEFORE, _AFTER = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
#: Letters with a stroke, which have no decomposition, and signs of print that are typed otherwise. Fixed values.
STROKES = {"ø": "o", "đ": "d", "ł": "l", "ħ": "h"}
TYPED = {"'": "['’‘]", "’": "['’‘]", "‘": "['’‘]", '"': '["“”]', "“": '["“”]', "”": '["“”]', "-": "[-–—‑]", "–": "[-–—‑]", "—": "[-–—‑]"}
MAX_TERM, MAX_ALIASES = 200, 8


def plain(text: str) -> str:
    """The text without accents and strokes."""
    bare = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return "".join(STROKES.get(c) or STROKES.get(c.lower(), c).upper() if c.lower() in STROKES else c for c in bare)


@lru_cache(1)
def accents() -> dict[str, str]:
    """Each plain letter with all letters of the Latin blocks (U+00C0 to U+024F, U+1E00 to U+1EFF) that fold to it."""
    found = {chr(k): chr(k) + chr(k).upper() for k in range(ord("a"), ord("z") + 1)}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = plain(chr(code)).lower()
        if base in found and chr(code) not in found[base]:
            found[base] += chr(code)
    return found


def tokens(term: str) -> list[str]:
    return re.findall(r"[^\W_]+(?:['’][^\W_]+)*", term)


def _letters(token: str) -> str:
    classes = accents()
    return "".join(f"[{classes[c]}]" if c in classes else TYPED.get(c) or re.escape(c) for c in plain(token).lower())


def pattern(term: str, mode: str = "exact", case_sensitive: bool = False) -> str:
    """The expression of a term; several words are a phrase; signs that carry meaning (C++, .NET) are kept as they are."""
    term = term.strip()
    if not term or len(term) > MAX_TERM:
        raise ValueError("a term of 1 to 200 characters is needed")
    flags = "(?u)" if case_sensitive else "(?iu)"
    if mode == "literal":
        return flags + r"[\s\u00a0]+".join("".join(TYPED.get(c) or re.escape(c) for c in p) for p in term.split())
    if re.search(r"[+#&$@]|^\.\w", term):
        return flags + _BEFORE + re.escape(term) + _AFTER
    parts = tokens(term)
    if not parts:
        raise ValueError("a term without letters or digits")
    body = [re.escape(p) if case_sensitive else _letters(p) for p in parts]
    if mode == "stem" and len(parts) == 1:
        suffix = "(s|es|ed|ing|['’]s)?" if len(parts[0]) >= 6 else "(s|['’]s)?" if not re.search("(s|x|z|ch|sh)$", parts[0]) else "(es|['’]s)?"
        return flags + _BEFORE + body[0] + suffix + _AFTER
    return flags + _BEFORE + GAP.join(body) + _AFTER


def sides(term: str) -> list[str]:
    """A slash means or, except in 9/11, and/or, I/O and URLs."""
    if "/" not in term or "://" in term or re.search(r"\d/\d", term) or term.lower() in ("and/or", "i/o"):
        return [term]
    return [s.strip() for s in term.split("/") if s.strip()]


def matches(text: Column, term: str, mode: str = "exact", aliases: tuple[str, ...] = (), case_sensitive: bool = False) -> Column:
    if len(aliases) > MAX_ALIASES:
        raise ValueError("eight aliases at most")
    out = F.lit(False)
    for side in sides(term):
        out = out | text.rlike(pattern(side, mode, case_sensitive))
    for alias in aliases:
        out = out | text.rlike(pattern(alias, mode))
    return out


def first_hit(text: Column, term: str, mode: str = "exact") -> Column:
    """(span, start): the first hit and where it begins, from 1 and in code points; null where there is none."""
    p = pattern(term, mode)
    span = F.regexp_substr(text, F.lit(p))
    before = F.length(F.regexp_extract(text, f"(?s)^(.*?)(?:{p})", 1))
    return F.struct(span.alias("span"), F.when(span.isNotNull(), before + 1).alias("start"))


def without_urls(text: Column) -> Column:
    """URLs overwritten by a sign that is no part of words."""
    return F.regexp_replace(text, r"https?://\S+", "␂")


def context(text: Column, term: str, before: int = 60, after: int = 180) -> Column:
    start = F.regexp_instr(text, F.lit(pattern(term, "literal")))
    return F.when(start > 0, F.substring(text, F.greatest(start - before, F.lit(1)), F.lit(before + after)))


def aliases_for(term: str, families: Sequence[Sequence[str]]) -> tuple[str, ...]:
    """The other names of a term, whichever of its family it is; each side of a slash, and its names, are names of the whole."""
    key, found = plain(term.strip()).lower(), []
    parts = sides(term)
    if len(parts) > 1:
        found = [*parts, *(a for part in parts for a in aliases_for(part, families))]
    for family in families:
        if key in (plain(name).lower() for name in family):
            found += family
    return tuple(dict.fromkeys(a for a in found if plain(a).lower() != key))


def whole_label(label: Column, term: str, aliases: Sequence[str] = ()) -> Column:
    """Whether a label is the term, or one of its names, and nothing else but signs around."""
    out = F.lit(False)
    for name in (term, *aliases):
        body = GAP.join(_letters(t) for t in tokens(name))
        out = out | label.rlike(rf"(?iu)^[^\p{{L}}\p{{N}}]*{body}[^\p{{L}}\p{{N}}]*$")
    return F.coalesce(out, F.lit(False))


def hits(text: Column, term: str, mode: str = "exact") -> Column:
    """All hits of a term as they are written, in order; none for a null text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"({pattern(term, mode)})"), F.lit(1)), F.array().cast("array<string>"))


def reasons(fields: Mapping[str, Column], terms: Mapping[str, Sequence[str]], mode: str = "exact") -> Column:
    """Why a row matches: (field, term, name, span, start, strict) of the first hit of each term in each field, in the order
    of the fields and terms. terms: each with its other names; ``name`` is the one that hit, the term itself first, and
    ``strict`` says whether it was the term. A term may stand in any field: fields are not joined, so that no hit spans two
    of them."""
    found = []
    for field, text in fields.items():
        for term, aliases in terms.items():
            if len(aliases) > MAX_ALIASES:
                raise ValueError("eight aliases at most")
            for_term = F.lit(None).cast("struct<field:string,term:string,name:string,span:string,start:int,strict:boolean>")
            for name in reversed((term, *aliases)):
                hit = first_hit(text, name, mode)
                row = F.struct(F.lit(field).alias("field"), F.lit(term).alias("term"), F.lit(name).alias("name"), hit["span"].alias("span"), hit["start"].alias("start"), F.lit(name == term).alias("strict"))
                for_term = F.when(hit["start"].isNotNull(), row).otherwise(for_term)
            found.append(for_term)
    return F.array_compact(F.array(*found))
