"""Links of Markdown: a scanner with a stack of open brackets, their roles, and the view of all links by target.

Kinds: ``inline`` links, ``image``, ``autolink`` (in angle brackets) and ``bare`` URLs. Brackets nest in labels, escaped ones
don't count, and a label ends at a blank line. In a destination, round brackets balance; it may stand in angle brackets
and be followed by a title. Of links within a link's label only images stay. A bare URL is none of its own inside a
link, a tag, an anchor element, a comment or code; punctuation and unopened brackets at its end don't belong to it.

Defined results: a null text has no links; a label may be empty, a destination not; places are in code points.
"""

from __future__ import annotations

from typing import NamedTuple

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions import urls as U
from folioscope.functions.names import free_names
from folioscope.operators import arrow

_SIGN = regex.compile(r"(?P<escape>\\[!-/:-@\[-`{-~])|(?P<blank>\n[ \t]*\n)|(?P<open>!?\[)|(?P<close>\])")
_GAP = r"[ \t]*\n?[ \t]*"
_BIT = r"\\\S|\\(?=\s|$)|[^\s\x00-\x1F()\\]"
_TARGET = regex.compile(
    rf"\({_GAP}(?:<(?P<angle>[^>\n]*)>|(?![<\[])(?P<plain>(?:{_BIT}|(?P<pair>\((?:{_BIT}|(?&pair))*+\)))*+))"
    rf"(?:{_GAP}(?:\"[^\"\n]*\"|'[^'\n]*'|\([^()\n]*\)))?(?:{_GAP}\)|[^\n)\[]*\))"
)
_ESCAPED = regex.compile(r"\\([!-/:-@\[-`{-~])")
_AUTOLINK = regex.compile(r"<(https?://[^\s<>]+)>", regex.I)
_BARE = regex.compile(r"(?<![=\"'])https?://[^\s<>\"`]+", regex.I)
_NO_PLACE = regex.compile(r"<!--.*?-->|<a\b[^>]*>.*?</a\s*>|<[^>]*>|^[ \t]*(?P<fence>```|~~~).*?^[ \t]*(?P=fence)|`[^`\n]+`", regex.I | regex.S | regex.M)


class Link(NamedTuple):
    kind: str
    label: str
    url: str
    start: int
    end: int


def _target(raw: str) -> str:
    url = _ESCAPED.sub(r"\1", raw.strip()).replace("&amp;", "&")
    while url[:1] == "(" and url[-1:] == ")":
        url = url[1:-1].strip()
    return url


def _without_tail(url: str) -> str:
    while url and (url[-1] in ".,:;!?*_~'" or any(url[-1] == close and url.count(close) > url.count(open_) for open_, close in ("()", "[]"))):
        url = url[:-1]
    return url


def _bracketed(text: str) -> list[Link]:
    """Inline links and images, by the end of each."""
    found: list[Link] = []
    waiting: list[tuple[int, int]] = []  # of each open bracket: where the link would start, and its label
    at = 0
    while sign := _SIGN.search(text, at):
        at = sign.end()
        if sign["open"]:
            waiting.append((sign.start(), sign.end()))
        elif sign["blank"]:
            waiting.clear()
            at -= 1  # its line break may begin another blank line
        elif sign["close"] and waiting:
            start, label = waiting.pop()
            target = _TARGET.match(text, at)
            url = _target(target["angle"] if target["angle"] is not None else target["plain"]) if target else ""
            if url:
                images = []
                while found and found[-1].start > start:
                    if (inner := found.pop()).kind == "image":
                        images.append(inner)
                found += reversed(images)
                found.append(Link("image" if text[start] == "!" else "inline", text[label : sign.start()], url, start, target.end()))
                at = target.end()
    return found


def scan(text: str) -> list[Link]:
    """All links of a text, by their start."""
    found = _bracketed(text)
    covered = [(x.start, x.end) for x in found]
    for auto, _ in _outside(covered, _AUTOLINK.finditer(text)):
        found.append(Link("autolink", "", auto[1], *auto.span()))
        covered.append(auto.span())
    if "://" in text:
        covered += [m.span() for m in _NO_PLACE.finditer(text)]
        for bare, most in _outside(covered, _BARE.finditer(text)):
            url = _without_tail(text[bare.start() : min(bare.end(), most)])
            if url.partition("://")[2]:
                found.append(Link("bare", "", url, bare.start(), bare.start() + len(url)))
    return sorted(found, key=lambda x: (x.start, -x.end))


def _outside(covered: list[tuple[int, int]], matches):
    """The matches that start in none of the covered stretches, each with the start of the next one; both run from left to
    right."""
    stretches = iter(sorted(covered))
    following, reached = next(stretches, None), -1
    for m in matches:
        while following and following[0] <= m.start():
            reached = max(reached, following[1])
            following = next(stretches, None)
        if m.start() >= reached:
            yield m, following[0] if following else m.end()


def links(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, ord, kind, label, url, start, stop) of every link in df's texts."""
    rows_of = lambda t: [(k, x.kind, x.label, x.url, x.start, x.end) for k, x in enumerate(scan(t))]
    return arrow.exploded(df, key, text, "ord int, kind string, label string, url string, start int, stop int", rows_of)


def unlinked(text: str) -> str:
    """The text with each link or image replaced by its label; bare URLs and autolinks stay."""
    out, at = [], 0
    for x in scan(text):
        if x.kind in ("inline", "image") and x.start >= at:
            out += [text[at : x.start], unlinked(x.label)]
            at = x.end
    return "".join([*out, text[at:]])


def with_roles(found: DataFrame, df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """found (of ``links``) with role: ``headline`` if nothing but the link, and signs of a heading, stands in its line;
    ``media`` for images; ``commentary`` otherwise."""
    free = free_names([*found.columns, "role"])
    of, body = free("of"), free("body")
    joined = found.join(df.select(F.col(key).alias(of), F.col(text).alias(body)), F.col(key) == F.col(of))
    ahead = F.substring_index(F.left(F.col(body), F.col("start")), "\n", -1)
    after = F.substring_index(F.substring(F.col(body), F.col("stop") + 1, F.length(body)), "\n", 1)
    alone = ahead.rlike(r"^[ \t]*(#{1,6}[ \t]+|[-*+][ \t]+)?$") & after.rlike(r"^[ \t]*#*[ \t]*$")
    role = F.when(F.col("kind") == "image", "media").when(alone, "headline").otherwise("commentary")
    return joined.withColumn("role", role).drop(of, body)


def link_view(found: DataFrame, key: str) -> DataFrame:
    """One row for each source and target: (key, url_key, url, label, role, mentions). found (of ``with_roles``): the first
    occurrence gives url and label, the best role of all stays (headline, commentary, media)."""
    order = F.struct("ord", "start")
    rank = F.when(F.col("role") == "headline", 0).when(F.col("role") == "commentary", 1).otherwise(2)
    keyed = found.withColumn("url_key", U.url_key(F.col("url")))
    first = F.min_by(F.struct("url", "label"), order).alias("first")
    grouped = keyed.groupBy(key, "url_key").agg(first, F.min(F.struct(rank, "role")).alias("best"), F.count(F.lit(1)).alias("mentions"))
    return grouped.select(key, "url_key", "first.url", "first.label", F.col("best.role").alias("role"), "mentions")


def find_links(view: DataFrame, key: str, domain: Column, keep: Column, samples: int = 3) -> DataFrame:
    """(domain, targets, sources, mentions, sample): of the view's rows to keep, by domain, with some of its targets: those
    of most sources, ties by their key."""
    by_target = view.filter(keep).groupBy(domain.alias("domain"), "url_key").agg(F.count(F.lit(1)).alias("sources"), F.sum("mentions").alias("mentions"))
    ranked = by_target.withColumn("place", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("sources"), "url_key")))
    top = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= samples, F.struct("place", "url_key")))), lambda x: x["url_key"]), " ").alias("sample")
    return ranked.groupBy("domain").agg(F.count(F.lit(1)).alias("targets"), F.sum("sources").alias("sources"), F.sum("mentions").alias("mentions"), top)
