"""Registered queries of vectors, spans, lines, copies and sources that belong together, with SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import matching, related, shaping, similar
from folioscope.operators.stems import STOP_WORDS
from folioscope.plans.catalogue import ORACLE_SQL, QUERIES, query, tokens_index
from folioscope.sources.tables import load

__all__ = ["ORACLE_SQL", "QUERIES"]

# --------------------------------------------------------------------------- vectors


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS l FROM v),
p AS (SELECT a.vec_id AS id, b.vec_id AS match, round(list_dot_product(a.e, b.e) / (a.l * b.l), 6) AS score FROM n a JOIN n b ON a.vec_id <> b.vec_id)
SELECT id, place, match, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, match)::INTEGER AS place FROM p) WHERE place <= 5""")
def vector_matches(spark, d):
    """The five best matches of every vector among all others."""
    return similar.best_matches(load(spark, d, "embeddings"), 5)


@query()
def diverse_vector_matches(spark, d):
    """For every vector up to ten of other labels, one of each, by maximal marginal relevance."""
    return similar.diverse_matches(load(spark, d, "embeddings"), floor=-1.0, team="label")


# --------------------------------------------------------------------------- spans


@query("""
WITH e AS (SELECT event_id, epoch_us(ts) AS t, event_type, value FROM events),
s AS (SELECT event_id AS span, t - 30000000 AS low, t + 10000000 + 1000000 * CAST(floor(value) AS BIGINT) AS high FROM e WHERE event_type = 'error')
SELECT span, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, min(event_id) AS first FROM s JOIN e ON t BETWEEN low AND high GROUP BY span""")
def events_around_errors(spark, d):
    """What all users do from half a minute before each error until some time after it, by a join of points with spans that
    no equality key ties together."""
    events = load(spark, d, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_type", F.floor("value").cast("long").alias("v"))
    spans = events.filter("event_type = 'error'").select(F.col("event_id").alias("span"), (F.col("t") - 30_000_000).alias("low"), (F.col("t") + 10_000_000 + 1_000_000 * F.col("v")).alias("high"))
    met = matching.range_join(events, spans, F.col("t"), F.col("low"), F.col("high"))
    return met.groupBy("span").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.min("event_id").alias("first"))


# --------------------------------------------------------------------------- lines


def _edited(text):
    """A text with its lines in reverse order, and without every fifth word of a line."""
    fewer = F.transform(F.split(text, "\n"), lambda line: F.array_join(F.filter(F.split(line, " "), lambda w, i: i % 5 != 4), " "))
    return F.array_join(F.reverse(fewer), "\n")


_LINES = r"""
WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS a, list_reverse(list_transform(string_split(text, chr(10)), lambda l: array_to_string(list_filter(string_split(l, ' '), lambda w, i: i % 5 <> 0), ' '))) AS b FROM documents),
x AS (SELECT doc_id, 'a' AS side, unnest(a) AS said, unnest(range(len(a))) AS line FROM t UNION ALL SELECT doc_id, 'b', unnest(b), unnest(range(len(b))) FROM t),
w AS (SELECT doc_id, side, line, regexp_extract_all(lower(said), '[\p{L}\p{N}''-]+') AS words FROM x),
f AS (SELECT doc_id, side, words, min(line) AS line FROM w WHERE len(words) >= 3 GROUP BY 1, 2, 3),
g AS (SELECT doc_id, side, line, list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) AS grams FROM f),
u AS (SELECT doc_id, side, line, len(grams) AS n, unnest(grams) AS gram FROM g),
s AS (SELECT a.doc_id, a.line, b.line AS best, count(*) AS shared, any_value(a.n) AS grams FROM u a JOIN u b ON a.doc_id = b.doc_id AND a.gram = b.gram AND a.side = 'a' AND b.side = 'b' GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY shared DESC, best) AS k FROM s)
SELECT doc_id, line::INTEGER AS line, best::INTEGER AS best, shared, grams::INTEGER AS grams FROM r WHERE k = 1 AND shared >= 0.2 * grams"""


def _both_texts(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "text")
    return docs, docs.select("doc_id", _edited(F.col("text")).alias("text"))


@query(_LINES)
def edited_lines(spark, d):
    """For each line of a text, the line of its edited form that shares most of its word trigrams."""
    left, right = _both_texts(spark, d)
    return matching.best_lines(left, right, "doc_id", least=0.2)


@query()
def edited_words(spark, d):
    """How each line's words became those of its best line: runs of words kept, gone and new."""
    left, right = _both_texts(spark, d)
    found = matching.line_diffs(left, right, "doc_id", least=0.2)
    return found.select("doc_id", "line", "best", "diff", F.array_join("gone", " ").alias("gone"), F.array_join("new", " ").alias("new"))


@query(r"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents), b AS (SELECT regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
g AS (SELECT DISTINCT unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS gram FROM b),
p AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS gram, unnest(range(0, len(w) - 7)) AS spot FROM t),
h AS (SELECT doc_id, spot FROM p WHERE gram IN (SELECT gram FROM g)),
c AS (SELECT DISTINCT doc_id, unnest(range(spot, spot + 8)) AS word FROM h),
i AS (SELECT doc_id, word, word - row_number() OVER (PARTITION BY doc_id ORDER BY word) AS island FROM c),
r AS (SELECT doc_id, min(word) AS first, max(word) + 1 AS stop FROM i GROUP BY doc_id, island),
s AS (SELECT doc_id, sum(stop - first) AS covered, count(*) AS runs, max(stop - first) AS longest, max(stop) AS last FROM r GROUP BY doc_id),
o AS (SELECT doc_id, max(first - before) AS gap FROM (SELECT doc_id, first, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY first), 0) AS before FROM r) GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS words, coalesce(covered, 0)::BIGINT AS covered, coalesce(runs, 0)::BIGINT AS runs, coalesce(longest, 0)::BIGINT AS longest, greatest(coalesce(gap, 0), coalesce(len(w), 0) - coalesce(last, 0))::BIGINT AS uncovered
FROM t LEFT JOIN s USING (doc_id) LEFT JOIN o USING (doc_id)""")
def covered_words(spark, d):
    """How much of each document stands in passages of the benchmark, by runs of eight words."""
    words = T.words(F.col("text"))
    return matching.covered_runs(load(spark, d, "documents"), "doc_id", words, load(spark, d, "benchmark"), words)


# --------------------------------------------------------------------------- copies

_PASSES = {
    "text": "CASE WHEN text <> '' THEN md5(text) END",
    "squash": "CASE WHEN regexp_replace(lower(text), '[^a-z0-9]+', '{g}') <> '' THEN md5(regexp_replace(lower(text), '[^a-z0-9]+', '{g}')) END",
    "opening": "CASE WHEN length(text) >= 40 THEN lower(substr(text, 1, 40)) END",
    "length": "CASE WHEN text <> '' THEN concat(lang, ' ', length(text)) END",
}


def _passes_sql() -> str:
    """Each pass numbers what is left of both sides within its key, and joins by key and number."""
    out = ["d AS (SELECT doc_id, CAST(substr(source, 4) AS INTEGER) < 10 AS is_left, " + ", ".join(f"{sql.replace(", '{g}'", ", '', 'g'")} AS k_{name}" for name, sql in _PASSES.items()) + " FROM documents)", "m0 AS (SELECT 0::BIGINT AS l, 0::BIGINT AS r, '' AS pass WHERE false)"]
    for j, name in enumerate(_PASSES, 1):
        for side, test, column in (("a", "is_left", "l"), ("b", "NOT is_left", "r")):
            out.append(f"{side}{j} AS (SELECT doc_id, k_{name} AS k, row_number() OVER (PARTITION BY k_{name} ORDER BY doc_id) AS n FROM d WHERE {test} AND k_{name} IS NOT NULL AND doc_id NOT IN (SELECT {column} FROM m{j - 1}))")
        out.append(f"m{j} AS (SELECT * FROM m{j - 1} UNION ALL SELECT a{j}.doc_id, b{j}.doc_id, '{name}' FROM a{j} JOIN b{j} USING (k, n))")
    return "WITH " + ",\n".join(out) + f'\nSELECT l AS "left", r AS "right", pass FROM m{len(_PASSES)}'


@query(_passes_sql())
def copy_matches(spark, d):
    """Documents of ten sources matched one to one with those of the others: by text, by its letters, by its opening, and last
    by language and length, each pass with what the ones before left."""
    docs = load(spark, d, "documents").withColumn("is_left", F.substring("source", 4, 10).cast("int") < 10)
    passes = [(name, *[F.expr(sql.replace("'{g}'", "''"))] * 2) for name, sql in _PASSES.items()]
    return matching.staged_matches(docs.filter("is_left"), docs.filter("not is_left"), passes, "doc_id", "doc_id")


# --------------------------------------------------------------------------- sources

_STOP = ", ".join(f"'{w}'" for w in sorted(STOP_WORDS))


@query(rf"""
WITH t AS (SELECT doc_id, source, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '{T.ASCII_TOKEN.replace("'", "''")}'), lambda w: length(w) > 4 AND NOT regexp_full_match(w, '[0-9]+') AND w NOT IN ({_STOP})))) AS term FROM documents),
c AS (SELECT term FROM t GROUP BY term HAVING count(*) < greatest(0.02 * (SELECT count(*) FROM documents), 20)),
r AS (SELECT t.* FROM t JOIN c USING (term)),
p AS (SELECT a.doc_id AS base, b.doc_id AS related, count(*) AS shared, count(*) + CASE WHEN any_value(a.source) <> any_value(b.source) THEN 2 ELSE 0 END AS score
  FROM r a JOIN r b ON a.term = b.term AND a.doc_id <> b.doc_id WHERE a.doc_id % 50 = 0 GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT * FROM (SELECT base, row_number() OVER (PARTITION BY base ORDER BY score DESC, related)::INTEGER AS place, related, score, shared FROM p) WHERE place <= 5""")
def related_documents(spark, d):
    """For each document whose number is divisible by 50, the five others that share most of its rare words."""
    return related.related_sources(load(spark, d, "documents"), "doc_id", "text", "source", F.col("doc_id") % 50 == 0, path=tokens_index(spark, d))


@query()
def passage_windows(spark, d):
    """The 300 signs of each text that show most of a query."""
    return related.windows(load(spark, d, "documents"), "doc_id", "thing erre Réaux aulich theaer", 300)


# --------------------------------------------------------------------------- answers


@query(r"""
WITH r AS (SELECT source, doc_id, coalesce(text, '') AS t, row_number() OVER w AS place, sum(length(coalesce(text, ''))) OVER w - length(coalesce(text, '')) AS used, count(*) OVER (PARTITION BY source) AS total
  FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
f AS (SELECT *, greatest(6000 - used, 0) AS room, length(t) > greatest(6000 - used, 0) AS over FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth FROM f WHERE NOT over OR room >= 40),
h AS (SELECT *, count(*) OVER (PARTITION BY source) AS held FROM k WHERE nth = place)
SELECT source, doc_id, md5(CASE WHEN over THEN regexp_replace(substr(t, 1, room::BIGINT), '\s+\S*$', '') ELSE t END) AS shown, over AS clipped, total - held AS omitted, CASE WHEN total > held THEN held END AS next_offset FROM h""")
def answers_to_cap(spark, d):
    """The documents of each source that an answer of 6,000 signs has room for, the last of them clipped, and how many it omits."""
    found = shaping.fit_to_cap(load(spark, d, "documents").select("source", "doc_id", "text"), "source", [F.col("doc_id")], "text", 6000)
    return found.select("source", "doc_id", F.md5(F.col("shown").cast("binary")).alias("shown"), "clipped", "omitted", "next_offset")
