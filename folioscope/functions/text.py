"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ASCII_TOKEN = r"[a-z0-9][a-z0-9'-]+"
UNICODE_TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Retrieval tokens: ASCII, two characters or more."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({ASCII_TOKEN})"), F.lit(1))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({UNICODE_TOKEN})"), F.lit(1))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[A-Za-z0-9][A-Za-z0-9'\-]*"))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def html_to_text(html: Column) -> Column:
    """Readable text: without script, style and page furniture; a new line at br and at the ends of paragraphs, headings and
    list items; entities resolved; no blank lines."""
    c = html
    for tag in ("script", "style"):
        c = F.regexp_replace(c, rf"(?is)<{tag}.*?</{tag}>", " ")
    c = F.regexp_replace(c, r"(?is)<(?:nav|header|footer|aside).*?</(?:nav|header|footer|aside)>", " ")
    c = F.regexp_replace(c, r"(?i)<br\s*/?\s*>|</p>|</h[1-6]>|</li>", "\n")
    c = F.regexp_replace(c, r"<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    c = F.regexp_replace(F.regexp_replace(c, "[ \t]+", " "), r"\s*\n\s*", "\n")
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def shingles(word_array: Column, n: int) -> Column:
    last = F.size(word_array) - n
    grams = F.transform(F.sequence(F.lit(0), last), lambda k: F.array_join(F.slice(word_array, k + 1, F.lit(n)), " "))
    return F.when(last >= 0, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def clip(text: Column, n: int) -> Column:
    """The first n characters, cut at a space, with an ellipsis."""
    cut = F.regexp_replace(F.substring(text, 1, n), r"\s+\S*$", "")
    return F.when(F.length(text) <= n, text).otherwise(F.concat(cut, F.lit("…")))


def body_hash(text: Column) -> Column:
    return F.left(F.sha2(text, 256), F.lit(16))
