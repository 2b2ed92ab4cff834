"""Registered queries for terms with their places, reading lists, chains and chunks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions import text as T
from folioscope.operators import matcher, reading, shaping
from folioscope.plans.catalogue import _bounded, n, query
from folioscope.plans.shaped import ORACLE_SQL, QUERIES
from folioscope.sources.tables import load

__all__ = ["ORACLE_SQL", "QUERIES"]

_THING, _THAT = "th[iìíîï][nñ]g", "th[aàáâãäå]t"
_NO_WORD = "[^\\p{L}\\p{N}]"

# --------------------------------------------------------------------------- terms


@query(f"""
SELECT doc_id, regexp_matches(text, '(?i){_bounded(_THING)}') AS strict FROM documents
WHERE regexp_matches(text, '(?i){_bounded(_THING + "(s|[''’]s)?")}')""")
def match_stem_strict(spark, d):
    """Documents with a form of a word, and whether the word itself is there."""
    hits = load(spark, d, "documents").filter(matcher.matches(F.col("text"), "thing", "stem"))
    return hits.select("doc_id", matcher.matches(F.col("text"), "thing").alias("strict"))


@query(f"""
SELECT doc_id, regexp_extract(text, '(?i)(?:^|{_NO_WORD})({_THAT})(?:{_NO_WORD}|$)', 1) AS span,
  CASE WHEN regexp_matches(text, '(?i)^{_THAT}({_NO_WORD}|$)') THEN 1 ELSE length(regexp_extract(text, '(?is)^(.*?{_NO_WORD}){_THAT}(?:{_NO_WORD}|$)', 1)) + 1 END AS start
FROM documents WHERE regexp_matches(text, '(?i){_bounded(_THAT)}')""")
def match_provenance(spark, d):
    """The first hit of a term as it is written, and its place in code points."""
    hits = load(spark, d, "documents").filter(matcher.matches(F.col("text"), "that"))
    return hits.select("doc_id", matcher.first_hit(F.col("text"), "that").alias("hit")).select("doc_id", "hit.span", F.col("hit.start").cast("long").alias("start"))


_EXAMPLE = _bounded("[eèéêë]x[aàáâãäå]mpl[eèéêë]")


@query(rf"""
SELECT page_id, regexp_matches(x, '(?i){_EXAMPLE}') AS anywhere, regexp_matches(regexp_replace(x, 'https?://\S+', '␂', 'g'), '(?i){_EXAMPLE}') AS outside
FROM (SELECT page_id, coalesce(url, '') || ' ' || coalesce(html, '') AS x FROM pages)""")
def match_outside_urls(spark, d):
    """Whether a term stands in a page at all, and outside of URLs."""
    text = F.concat(F.coalesce("url", F.lit("")), F.lit(" "), F.coalesce("html", F.lit("")))
    hit = lambda c: matcher.matches(c, "example")
    return load(spark, d, "pages").select("page_id", hit(text).alias("anywhere"), hit(matcher.without_urls(text)).alias("outside"))


_TROPE = ("clown", "garbage", "idiot", "moron", "pathetic", "stupid")


@query(rf"""
SELECT doc_id, array_to_string(list_sort(h), ',') AS held FROM (SELECT doc_id, list_filter({list(_TROPE)}, lambda x: list_contains(w, x)) AS h
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL)) WHERE len(h) >= 2""")
def trope_hits(spark, d):
    """Documents with two words or more of a set."""
    held = reading.held_of(T.words(F.col("text")), _TROPE)
    return load(spark, d, "documents").select("doc_id", held.alias("held")).filter(F.size("held") >= 2).select("doc_id", F.array_join("held", ",").alias("held"))


@query(r"""
SELECT page_id, score FROM (SELECT page_id, """ + " + ".join(f"8 * contains(lower(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '{w}')::INTEGER + 3 * contains(lower(url), '{w}')::INTEGER + contains(lower(html), '{w}')::INTEGER" for w in ("the", "fr", "page")) + """ AS score FROM pages)
WHERE score > 0 ORDER BY score DESC, page_id LIMIT 20""")
def weighted_fields(spark, d):
    """Pages by where the terms of a question stand: title, address or body."""
    has = lambda c, w: F.contains(F.lower(c), F.lit(w)).cast("int")
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    score = F.lit(0)
    for w in ("the", "fr", "page"):
        score = score + 8 * has(title, w) + 3 * has(F.col("url"), w) + has(F.col("html"), w)
    return load(spark, d, "pages").select("page_id", score.alias("score")).filter("score > 0").orderBy(F.desc("score"), "page_id").limit(20)


# --------------------------------------------------------------------------- lists


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderdate::DATE ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_totalprice DESC NULLS LAST, o_orderkey) AS place FROM orders")
def day_order(spark, d):
    """Each order's place within its day: by status, then price, then key."""
    kind = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    ranked = reading.placed(load(spark, d, "orders"), [F.to_date("o_orderdate")], [kind, F.desc_nulls_last("o_totalprice"), F.col("o_orderkey")])
    return ranked.select("o_orderkey", F.col("place").cast("long").alias("place"))


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, o_orderkey, concat_ws('+', CASE WHEN k = 1 THEN 'earliest' END, CASE WHEN k = (n + 1) // 2 THEN 'middle' END, CASE WHEN k = n THEN 'latest' END) AS reasons
FROM r WHERE k = 1 OR k = (n + 1) // 2 OR k = n""")
def reading_anchors(spark, d):
    return reading.reading_path(load(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey")


@query("SELECT event_id, lag(event_id) OVER w AS before, lead(event_id) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def source_neighbors(spark, d):
    """What stands before and after each event of a user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return load(spark, d, "events").select("event_id", F.lag("event_id").over(w).alias("before"), F.lead("event_id").over(w).alias("after"))


@query("SELECT o_orderkey, total, greatest(total - 60, 0) AS omitted, CASE WHEN total > 60 THEN 60 END::BIGINT AS next_offset FROM (SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 40), (SELECT count(*) AS total FROM orders)")
def page_with_totals(spark, d):
    """The third page of twenty, with the count of all, how many follow, and where the next page begins."""
    orders, left = load(spark, d, "orders"), F.col("total") - 60
    page = orders.select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).offset(40).limit(20)
    both = page.crossJoin(F.broadcast(orders.agg(n("total"))))  # one row
    return both.select("o_orderkey", "total", F.greatest(left, F.lit(0)).alias("omitted"), F.when(left > 0, F.lit(60).cast("long")).alias("next_offset"))


@query("SELECT event_id FROM events ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END, value DESC NULLS LAST, ts DESC, event_id LIMIT 100")
def review_order(spark, d):
    """The first hundred to look at: errors, then purchases, the largest and newest first."""
    ladder = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    return load(spark, d, "events").orderBy(ladder, F.desc_nulls_last("value"), F.desc("ts"), "event_id").limit(100).select("event_id")


# --------------------------------------------------------------------------- counts


@query("SELECT event_type, user_id, GROUPING(event_type, user_id) AS level, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY ROLLUP (event_type, user_id)")
def usage_totals(spark, d):
    """Counts and sums of a JSON field by type and user, by type, and over all, in one pass."""
    k = F.get_json_object("props", "$.k").cast("long")
    return load(spark, d, "events").rollup("event_type", "user_id").agg(F.grouping_id().alias("level"), n(), F.sum(k).alias("total"))


@query("SELECT o_orderstatus, count(*) AS n, max({'d': o_orderdate, 'k': o_orderkey}).k AS newest, max(o_orderdate) AS newest_at, min(o_orderdate) AS oldest_at FROM orders GROUP BY 1")
def artifact_facts(spark, d):
    """What a table holds of each kind: how many rows, the newest one and its date."""
    newest = F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey"))
    return load(spark, d, "orders").groupBy("o_orderstatus").agg(n(), newest.alias("newest"), F.max("o_orderdate").alias("newest_at"), F.min("o_orderdate").alias("oldest_at"))


# --------------------------------------------------------------------------- chains and chunks


@query("""
WITH RECURSIVE p AS (SELECT o_orderkey AS k, CASE WHEN o_orderdate - lag(o_orderdate) OVER w < INTERVAL 200 DAY THEN lag(o_orderkey) OVER w END AS parent FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
r AS (SELECT k, k AS root, 0::BIGINT AS depth FROM p WHERE parent IS NULL UNION ALL SELECT p.k, r.root, r.depth + 1 FROM p JOIN r ON p.parent = r.k)
SELECT k AS o_orderkey, root, depth FROM r""")
def chain_walk(spark, d):
    """Orders that follow the customer's one before within 200 days: where each chain began, and how many orders ago."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    soon = F.col("o_orderdate") < F.lag("o_orderdate").over(w) + F.expr("INTERVAL 200 DAY")
    linked = load(spark, d, "orders").select("o_orderkey", F.when(soon, F.lag("o_orderkey").over(w)).alias("parent"))
    return reading.chain_roots(linked, "o_orderkey", "parent")


@query("""
WITH w AS (SELECT doc_id, string_split_regex(trim(coalesce(text, '')), '[ \t\n\r]+') AS w FROM documents),
c AS (SELECT doc_id, k, w[k * 100 + 1 : k * 100 + 120] AS w FROM (SELECT doc_id, w, unnest(range(0, (greatest(len(w) - 21, 0) // 100) + 1)) AS k FROM w)),
p AS (SELECT doc_id, k, w, lag(w) OVER (PARTITION BY doc_id ORDER BY k) AS p FROM c),
s AS (SELECT doc_id, k, w, coalesce(list_max(list_filter(range(1, least(20, len(w), len(p)) + 1), lambda x: w[1 : x] = p[len(p) - x + 1 : len(p)])), 0) AS said FROM p)
SELECT doc_id, k::BIGINT AS chunk, sha256(array_to_string(w[said + 1 :], ' ')) AS fresh FROM s""")
def chunks_without_overlap(spark, d):
    """Chunks that share words with the one before, without those words."""
    words = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "^ +| +$", ""), "[ \t\n\r]+")
    parts = load(spark, d, "documents").select("doc_id", F.posexplode_outer(shaping.chunks(words, 120, 20)).alias("chunk", "words")).filter("words is not null").withColumn("words", F.split("words", " "))
    fresh = reading.without_lead_in(parts, "doc_id", "chunk", "words", 20)
    return fresh.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.sha2(F.array_join("words", " "), 256).alias("fresh"))


@query(r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
r AS (SELECT doc_id, g FROM g GROUP BY 1, 2 HAVING max(i) - min(i) >= 5)
SELECT doc_id, count(*) AS runs FROM r GROUP BY 1""")
def repeated_runs(spark, d):
    """Documents that say the same five words twice."""
    return reading.repeated_runs(load(spark, d, "documents"), "doc_id", T.words(F.col("text")))
