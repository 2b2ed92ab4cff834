"""Registered queries for links, sections and chunks of whole texts, with SQL where the rows follow from the page's tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions import urls as U
from folioscope.operators import links, matcher, passages, segments, voices
from folioscope.plans.catalogue import ORACLE_SQL, QUERIES, query
from folioscope.sources.tables import load

__all__ = ["ORACLE_SQL", "QUERIES"]

_ANCHOR = '<a href="([^"]*)">([^<]*)</a>'
_HOST = "https://www.example.org"


def planted_markdown(spark, d):
    """(page_id, markdown): each anchor of a page as a line of Markdown, by its number in turn as a link alone in its line,
    an image within a sentence, a link whose label holds brackets and whose target stands in angle brackets, a linked
    image, a link with a title, and a bare URL at the end of a sentence; before them, things that are no links."""
    anchors = F.regexp_extract_all(F.col("html"), F.lit(f"(?i){_ANCHOR}"), F.lit(1))
    no_links = "# Links\n\n\\[none](x) [a\n\nb] `https://code.test/x` <!-- https://comment.test/y -->\n\n```\nhttps://fence.test/z\n```\n\n"

    def line(path, k):
        at = F.concat(F.lit(_HOST), path)
        form = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
        lines = (
            form("- [one](", at, ")"),
            form("see ![two](", at, ") there"),
            form("[three [3] \\]](<", at, ">) and more"),
            form("a [![four](", at, "/image.png)](", at, ") b"),
            form('x [five [5](inner)]( ', at, ' "a (title)") y'),
            form("so (", at, "/p(6)). End"),
        )
        out = F.lit(None).cast("string")
        for j, one in enumerate(lines):
            out = F.when(k % 6 == j, one).otherwise(out)
        return out

    body = F.array_join(F.transform(anchors, line), "\n")
    return load(spark, d, "pages").select("page_id", F.concat(F.lit(no_links), body).alias("markdown"))


_KINDS = """
WITH a AS (SELECT page_id, regexp_extract_all(html, '(?i)<a href="([^"]*)">([^<]*)</a>', 1) AS paths FROM pages),
u AS (SELECT page_id, unnest(paths) AS path, unnest(range(len(paths))) AS k FROM a),
f AS (SELECT page_id, k, 'https://www.example.org' || path AS addr, CAST(k % 6 AS INTEGER) AS form FROM u),
l AS (SELECT page_id, k, 0 AS j, form, CASE form WHEN 1 THEN 'image' WHEN 5 THEN 'bare' ELSE 'inline' END AS kind,
    CASE form WHEN 0 THEN 'one' WHEN 1 THEN 'two' WHEN 2 THEN 'three [3] \\]' WHEN 3 THEN '![four](' || addr || '/image.png)' WHEN 4 THEN 'five [5](inner)' ELSE '' END AS label,
    CASE form WHEN 5 THEN addr || '/p(6)' ELSE addr END AS url FROM f
  UNION ALL SELECT page_id, k, 1, form, 'image', 'four', addr || '/image.png' FROM f WHERE form = 3)
"""


@query(_KINDS + "SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY k, j) - 1)::INTEGER AS ord, kind, label, url FROM l")
def markdown_links(spark, d):
    """Every link of the planted Markdown: kind, label and target."""
    return links.links(planted_markdown(spark, d), "page_id", "markdown").select("page_id", "ord", "kind", "label", "url")


@query(
    _KINDS
    + """, r AS (SELECT *, CASE WHEN kind = 'image' THEN 'media' WHEN form = 0 THEN 'headline' ELSE 'commentary' END AS role FROM l)
SELECT page_id, url, arg_min(label, 2 * k + j) AS label, min(role = 'media')::INTEGER AS only_media, CASE WHEN max((role = 'headline')::INTEGER) = 1 THEN 'headline' WHEN max((role = 'commentary')::INTEGER) = 1 THEN 'commentary' ELSE 'media' END AS role, count(*) AS mentions
FROM r GROUP BY page_id, url"""
)
def link_roles(spark, d):
    """One row for each page and target: its first label, its best role, how often it stands there."""
    pages = planted_markdown(spark, d)
    view = links.link_view(links.with_roles(links.links(pages, "page_id", "markdown"), pages, "page_id", "markdown"), "page_id")
    return view.select("page_id", "url", "label", (F.col("role") == "media").cast("int").alias("only_media"), "role", "mentions")


def find_page_links(spark, d):
    """Targets by domain over all pages' own Markdown: numbers and the three targets of most pages."""
    pages = load(spark, d, "pages").select("page_id", F.col("url").alias("page_url"), segments.html_to_markdown(F.col("html")).alias("markdown"))
    found = links.with_roles(links.links(pages, "page_id", "markdown"), pages, "page_id", "markdown")
    home = pages.select(F.col("page_id").alias("of"), U.domain(F.col("page_url")).alias("home"))
    view = links.link_view(found, "page_id").join(home, F.col("page_id") == F.col("of"))
    host = F.when(F.col("url").rlike(r"^https?://"), U.domain(F.col("url"))).otherwise(F.col("home"))
    return links.find_links(view, "page_id", host, F.col("role") != "media")


query()(find_page_links)


@query(r"""
WITH m AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)\s*>|<!--.*?-->|<head\b.*?</head\s*>', ' ', 'g') AS h FROM pages),
e AS (SELECT page_id, regexp_extract_all(h, '(?i)<h([1-4])\b[^>]*>', 1) AS levels FROM m),
s AS (SELECT page_id, unnest(levels)::INTEGER AS level, unnest(range(1, len(levels) + 1)) AS k FROM e)
SELECT page_id, k, level, (SELECT max(k) FROM s a WHERE a.page_id = s.page_id AND a.k < s.k AND a.level < s.level) AS parent FROM s""")
def section_tree(spark, d):
    """The headed sections of each page's Markdown, numbered from 1, with the section above each."""
    pages = load(spark, d, "pages").select("page_id", segments.html_to_markdown(F.col("html")).alias("markdown"))
    found = segments.section_rows(pages, "page_id", "markdown").filter("level > 0")
    unheaded = segments.section_rows(pages, "page_id", "markdown").filter("level = 0").select(F.col("page_id").alias("of"))
    shift = F.when(F.col("of").isNull(), 1).otherwise(0)
    rows = found.join(unheaded, found.page_id == F.col("of"), "left")
    return rows.select("page_id", (F.col("ord") + shift).cast("long").alias("k"), "level", (F.col("parent") + shift).cast("long").alias("parent"))


@query("SELECT doc_id, md5(text) AS joined, TRUE AS within_budget, TRUE AS verbatim FROM documents WHERE text <> ''")
def chunk_bodies(spark, d):
    """The digest of each text put together from its chunks' bodies; whether all chunks keep the budget, and begin with the
    end of the one before."""
    rows = segments.chunk_rows(load(spark, d, "documents"), "doc_id", max_words=400, overlap=60, max_chars=2000)
    verbatim = F.expr("right(chunk, length(body)) = body AND length(chunk) - length(body) = start - lead")
    one = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "body"))), lambda x: x["body"]), "")
    budget = F.bool_and((F.col("words") <= 400) & (F.length("chunk") <= 2000))
    return rows.groupBy("doc_id").agg(F.md5(one).alias("joined"), budget.alias("within_budget"), F.bool_and(verbatim).alias("verbatim"))


@query()
def chunk_places(spark, d):
    """Where each chunk of each text stands: its lead-in, its own body and its words."""
    return segments.chunk_rows(load(spark, d, "documents"), "doc_id").select("doc_id", "ord", "lead", "start", "stop", "words")


@query(_KINDS + "SELECT url, min(page_id) AS first_page, count(DISTINCT page_id) AS pages, count(*) AS shown, count(DISTINCT page_id) > 1 AS shared FROM l WHERE kind = 'image' GROUP BY url")
def shared_images(spark, d):
    """Each image of the planted Markdown once: where it is first shown, on how many pages, and whether several share it."""
    found = links.links(planted_markdown(spark, d), "page_id", "markdown").filter("kind = 'image'")
    pages = F.count_distinct("page_id")
    return found.groupBy("url").agg(F.min("page_id").alias("first_page"), pages.alias("pages"), F.count(F.lit(1)).alias("shown"), (pages > 1).alias("shared"))


_RULES = {
    "double entity": r"&amp;(amp|lt|gt|quot|nbsp|#[0-9]+);",
    "template leak": r"(\{\{|\{%|<%=|\$\{)",
    "mojibake": r"(Ã[\x{0080}-\x{00BF}]|â€|\x{FFFD})",
    "markup in a title": r"(?is)<title[^>]*>[^<]*([*#%$&]{3})",
    "empty paragraph": r"(?is)<p[^>]*>\s*(<br\s*/?>)?\s*</p>",
    "paragraph in a paragraph": r"(?is)<p\\b[^>]*>[^<]*(<b>[^<]*)?(<br\\s*/?>)?<p\\b",
    "link without a target": r"(?is)<a\b[^>]*href=\"\s*(#|javascript:[^\"]*)?\s*\"",
    "script text": r"(?is)<script",
}


@query(" UNION ALL ".join(f"SELECT '{name}' AS rule, count(*) AS pages, min(page_id) AS first_page FROM pages WHERE regexp_matches(html, '{rule}')" for name, rule in _RULES.items()))
def page_findings(spark, d):
    """By rule, how many pages break it and the first that does; rules that no page breaks are there with none."""
    rows = load(spark, d, "pages")
    hit = {name: F.coalesce(F.col("html").rlike(rule), F.lit(False)) for name, rule in _RULES.items()}
    one = rows.agg(*[F.struct(F.count_if(c).alias("pages"), F.min(F.when(c, F.col("page_id"))).alias("first_page")).alias(name) for name, c in hit.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"`{name}`.pages"), F.col(f"`{name}`.first_page")) for name in hit])).alias("r")).select("r.*")


_REASON = lambda name: rf"(^|[^\p{{L}}\p{{N}}]){name}([^\p{{L}}\p{{N}}]|$)"


@query(
    f"""
SELECT page_id, concat_ws(' ', CASE WHEN regexp_matches(title, '(?i){_REASON("onwh")}') THEN 'title:onwh' END, CASE WHEN regexp_matches(title, '(?i){_REASON("oui")}') THEN 'title:oui' END,
  CASE WHEN regexp_matches(html, '(?i){_REASON("onwh")}') THEN 'body:onwh' END, CASE WHEN regexp_matches(html, '(?i){_REASON("oui")}') THEN 'body:oui' END) AS reasons
FROM (SELECT page_id, html, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages) WHERE regexp_matches(html, '(?i){_REASON("onwh")}') OR regexp_matches(html, '(?i){_REASON("oui")}')"""
)
def match_reasons(spark, d):
    """Why a page matches a term or its other name: the field and the name that hit there."""
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    why = [matcher.reasons({"title": title, "body": F.col("html")}, {name: ()}) for name in ("onwh", "oui")]
    rows = load(spark, d, "pages").select("page_id", F.concat(*why).alias("why")).filter(F.size("why") > 0)
    text = F.transform(F.array_sort(F.transform("why", lambda r: F.struct((r["field"] != "title").alias("late"), r["name"].alias("name"), r["field"].alias("field")))), lambda r: F.concat(r["field"], F.lit(":"), r["name"]))
    return rows.select("page_id", F.array_join(text, " ").alias("reasons"))


def _voiced(spark, d):
    """The planted Markdown with every third line quoted."""
    lines = F.transform(F.split("markdown", "\n"), lambda x, i: F.when((i % 3 == 2) & (x != ""), F.concat(F.lit("> "), x)).otherwise(x))
    return planted_markdown(spark, d).select("page_id", F.array_join(lines, "\n").alias("markdown"))


_VOICED = """
WITH a AS (SELECT page_id, regexp_extract_all(html, '(?i)<a href="([^"]*)">([^<]*)</a>', 1) AS paths FROM pages),
u AS (SELECT page_id, unnest(paths) AS path, unnest(range(len(paths))) AS k FROM a),
h AS (SELECT page_id, unnest(['# Links', '', '\\[none](x) [a', '', 'b] `https://code.test/x` <!-- https://comment.test/y -->', '', '```', 'https://fence.test/z', '```', '']) AS x, unnest(range(10)) AS i FROM pages),
b AS (SELECT page_id, 10 + k AS i, 'https://www.example.org' || path AS addr, k % 6 AS form FROM u),
l AS (SELECT page_id, i, x, length(x) AS size, 'own' AS plain FROM h
  UNION ALL SELECT page_id, i, CASE form WHEN 0 THEN '- [one](' || addr || ')' WHEN 1 THEN 'see ![two](' || addr || ') there' WHEN 2 THEN '[three [3] \\]](<' || addr || '>) and more'
    WHEN 3 THEN 'a [![four](' || addr || '/image.png)](' || addr || ') b' WHEN 4 THEN 'x [five [5](inner)]( ' || addr || ' "a (title)") y' ELSE 'so (' || addr || '/p(6)). End' END, 0, CASE form WHEN 0 THEN 'link' ELSE 'own' END FROM b
  UNION ALL SELECT page_id, 10, '', 0, 'own' FROM a WHERE len(paths) = 0),
v AS (SELECT page_id, i, CASE WHEN i % 3 = 2 AND x <> '' THEN '> ' || x ELSE x END AS x, CASE WHEN i % 3 = 2 AND x <> '' THEN 'quoted' ELSE plain END AS voice FROM l)
"""


@query(_VOICED + "SELECT page_id, count(*) FILTER (WHERE voice = 'quoted') AS quoted_lines, count(*) FILTER (WHERE voice = 'link') AS link_lines, (sum(length(x)) + count(*) - 1)::BIGINT AS signs FROM v GROUP BY page_id")
def voice_lines(spark, d):
    """How many lines of each page are quoted or nothing but a link, from the spans of voices, which cover the text."""
    pages = _voiced(spark, d)
    found = voices.voice_spans(pages, "page_id", "markdown").join(pages.withColumnRenamed("page_id", "of"), F.col("page_id") == F.col("of"))
    said = F.filter(F.split(F.substring(F.col("markdown"), F.col("start") + 1, F.col("stop") - F.col("start")), "\n"), lambda x: F.trim(x) != "")
    count = lambda voice, name: F.sum(F.when(F.col("voice") == voice, F.size(said)).otherwise(0)).cast("long").alias(name)
    return found.groupBy("page_id").agg(count("quoted", "quoted_lines"), count("link", "link_lines"), F.sum(F.col("stop") - F.col("start")).alias("signs"))


@query()
def own_words(spark, d):
    """What each page says itself: no quoted lines, no links that stand alone, no images."""
    return voices.said_by(_voiced(spark, d), "page_id", ["own"], "markdown")


@query()
def image_contexts(spark, d):
    """Each page's distinct images with their text and the prose nearest to them."""
    return voices.media(_voiced(spark, d), "page_id", "markdown")


def _page_passages(spark, d):
    pages = load(spark, d, "pages").select("page_id", T.page_title(F.col("html")).alias("title"), segments.html_to_markdown(F.col("html")).alias("markdown"))
    return passages.passages(pages, "page_id", "markdown", "title", max_words=120, overlap=20, input_chars=1200)


@query()
def page_passages(spark, d):
    """Each page's passages with their sections and the digest of what would be embedded."""
    found = _page_passages(spark, d)
    return found.select("page_id", "section", "ord", "heading", F.array_join("path", " > ").alias("path"), passages.content_kind(F.col("heading")).alias("kind"), "start", "stop", "words", "digest", "over")


@query(r"""
WITH m AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)\s*>|<!--.*?-->|<head\b.*?</head\s*>', ' ', 'g') AS h FROM pages)
SELECT page_id, TRUE AS titled, TRUE AS whole FROM m WHERE regexp_matches(regexp_replace(h, '<[^>]+>', '', 'g'), '[\p{L}\p{N}]')""")
def passage_headers(spark, d):
    """Pages with words: whether every passage's input begins with its header and ends with its text, which is of the size that
    its places say."""
    pages = load(spark, d, "pages").select("page_id", T.page_title(F.col("html")).alias("title"))
    rows = _page_passages(spark, d).join(pages.withColumnRenamed("page_id", "of"), F.col("page_id") == F.col("of"))
    header = F.array_join(F.filter(F.array(F.trim("title"), F.array_join("path", " > ")), lambda x: x != ""), "\n")
    titled = F.col("input") == F.concat(header, F.lit("\n"), F.col("text"))
    whole = (F.length("text") <= F.col("stop") - F.col("start")) & ((F.length("input") <= 1200) | F.col("over"))
    return rows.groupBy("page_id").agg(F.bool_and(titled).alias("titled"), F.bool_and(whole).alias("whole"))
