"""Registered queries of keyword search from the stored index, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import evaluation, index, keywords, matcher, stems
from folioscope.plans.catalogue import ORACLE_SQL, QUERIES, query
from folioscope.sources.tables import load

__all__ = ["ORACLE_SQL", "QUERIES"]


def folded_index(spark, d) -> str:
    """The index of all documents by words without accents, with their source as kind; built once for a state of the files."""
    return index.served(load(spark, d, "documents"), "documents-folded", tokens=T.words, kind=F.col("source"), fold=True, norms=False)


def _sql(terms: list[str], phrase: list[str], scope: str, k: int) -> str:
    """BM25 of terms; rows with the phrase first, by BM25 of it as one term. Words from 1."""
    at = " AND ".join(f"w[i + {j}] = '{x}'" for j, x in enumerate(phrase))
    counts = [f"len(list_filter(w, lambda x: x = '{t}')) AS t{j}" for j, t in enumerate(terms)] + [f"len(list_filter(range(1, len(w) + 1), lambda i: {at})) AS p"]
    parts = [f"t{j}" for j in range(len(terms))]
    score = lambda names: " + ".join(f"CASE WHEN n > 2 * d{c} THEN ln((n - d{c} + 0.5) / (d{c} + 0.5)) ELSE 1e-6 END * {c} * 2.2 / ({c} + 1.2 * (0.25 + 0.75 * l / a))" for c in names)
    held = " OR ".join(f"{c} > 0" for c in [*parts, "p"])
    return f"""
WITH t AS (SELECT doc_id, source, regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
c AS (SELECT doc_id, source, len(w) AS l, {", ".join(counts)} FROM t),
s AS (SELECT count(*) AS n, avg(l) AS a, {", ".join(f"count(*) FILTER (WHERE {c} > 0) AS d{c}" for c in [*parts, "p"])} FROM c)
SELECT doc_id, round(CASE WHEN p > 0 THEN 1000 + {score(["p"])} ELSE {score(parts)} END, 6) AS score FROM c, s WHERE ({held}) AND {scope} ORDER BY score DESC, doc_id LIMIT {k}"""


@query(_sql(["eauouon", "ing"], ["of", "the"], "true", 40))
def fts_phrase(spark, d):
    """A quoted phrase and more words: rows that hold the phrase first, the others by their words."""
    return keywords.search(spark, folded_index(spark, d), keywords.parse('Éauouon ing "of the"', "phrase", fold=True), 40).withColumnRenamed("key", "doc_id")


@query(_sql(["tion", "erre", "re"], ["tion", "the", "erre", "re"], "source = 'src0'", 20))
def fts_adjacent_of_kind(spark, d):
    """Words without quotes, also taken as a phrase, among the documents of one source."""
    found = keywords.search(spark, folded_index(spark, d), keywords.parse("Tion the erre re", fold=True), 20, kind="src0")
    return found.withColumnRenamed("key", "doc_id")


@query(_sql(["the", "of"], ["-"], "true", 30))
def fts_any_word(spark, d):
    """Rows with any of some very frequent words, which have the least weight."""
    return keywords.search(spark, folded_index(spark, d), keywords.parse("the of", "or"), 30).withColumnRenamed("key", "doc_id")


@query()
def fts_stemmed(spark, d):
    """Words stand for all terms of their stem; what is said in order comes first."""
    found = keywords.search(spark, folded_index(spark, d), keywords.parse("ended things", fold=True), 40, stemmed=True)
    return found.withColumnRenamed("key", "doc_id")


@query(
    """
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+')) AS term FROM documents) GROUP BY 1, 2)
GROUP BY term"""
)
def index_terms(spark, d):
    """Every term of the index, with the rows that hold it and how often it stands in them."""
    return index.terms(spark, folded_index(spark, d)).select("term", "df", "cf")


# --------------------------------------------------------------------------- many searches, pages, lenses

_STOPS = ", ".join(f"'{w}'" for w in sorted(stems.STOP_WORDS))
_FOUND = f"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
s AS (SELECT count(*) AS n, avg(len(w)) AS a FROM t),
u AS (SELECT doc_id, len(w) AS l, unnest(w) AS term FROM t), p AS (SELECT doc_id, l, term, count(*) AS tf FROM u GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
q AS (SELECT item_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda x: x NOT IN ({_STOPS})))) AS term FROM benchmark),
c AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))), 6) AS score FROM q JOIN p USING (term) JOIN df USING (term), s GROUP BY 1, 2),
f AS (SELECT * FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS place FROM c) WHERE place <= 20)"""


def words_index(spark, d) -> str:
    return index.served(load(spark, d, "documents"), "documents-words", tokens=T.words, norms=False)


def _benchmark_hits(spark, d):
    items = load(spark, d, "benchmark")
    terms = F.filter(T.words(F.col("text")), lambda w: ~w.isin(sorted(stems.STOP_WORDS)))
    return evaluation.batch_bm25(spark, words_index(spark, d), items.select(F.col("item_id").alias("id"), terms.alias("terms")), 20)


@query(_FOUND + " SELECT item_id, place, doc_id, score FROM f")
def benchmark_hits(spark, d):
    """The twenty best documents for the words of every benchmark passage, all searched at once."""
    return _benchmark_hits(spark, d).withColumnsRenamed({"id": "item_id", "key": "doc_id"})


@query(
    _FOUND
    + """, h AS (SELECT b.item_id, d.doc_id, d.source, d.lang FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
r AS (SELECT h.*, f.place FROM h LEFT JOIN f USING (item_id, doc_id))
SELECT lang, source, GROUPING(lang, source) AS level, count(*) AS pairs, round(avg(coalesce(1 / place, 0)), 6) AS mrr,
  """
    + ", ".join(f"round(avg(CASE WHEN place <= {k} THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_{k}" for k in (1, 5, 10, 20))
    + " FROM r GROUP BY ROLLUP (lang, source)"
)
def benchmark_retrieval(spark, d):
    """How well keyword search finds the documents that hold a benchmark passage, by language and source, by language, and over
    all: mean reciprocal rank and recall."""
    docs, items = load(spark, d, "documents"), load(spark, d, "benchmark")
    asked = items.select(F.col("item_id").alias("id"), "text", T.words(F.col("text")).alias("terms"))
    truths = evaluation.holders(spark, words_index(spark, d), asked, docs, "doc_id")
    truths = truths.join(docs.select(F.col("doc_id").alias("key"), "lang", "source"), "key")
    return evaluation.retrieval_metrics(_benchmark_hits(spark, d), truths, ["lang", "source"])


@query()
def page_without_copied(spark, d):
    """Twenty search results of which none repeats half of what one above it says; the page is filled up from below."""
    hits = index.bm25(spark, words_index(spark, d), ["thing", "erre", "license", "tion"], None)
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("key"), "text")
    return evaluation.page_without_copied(hits, docs, 20).withColumnRenamed("key", "doc_id")


_OWN, _OTHER = "(^|[^\\p{L}\\p{N}])thing([^\\p{L}\\p{N}]|$)", "(^|[^\\p{L}\\p{N}])tion([^\\p{L}\\p{N}]|$)"


@query(f"""
WITH r AS (SELECT source AS bucket, doc_id, coalesce(regexp_matches(lower(text), '{_OWN}'), false) AS own, coalesce(regexp_matches(lower(text), '{_OTHER}'), false) AS other FROM documents)
SELECT bucket, GROUPING(bucket) AS level, count(*) AS considered, count(*) FILTER (WHERE own OR other) AS matched, count(*) FILTER (WHERE own) AS strict,
  min(CASE WHEN own THEN doc_id END) AS first, max(CASE WHEN own THEN doc_id END) AS latest FROM r GROUP BY ROLLUP (bucket)""")
def archive_lens(spark, d):
    """A term and its other name over all sources: rows looked at, hit, hit by the term itself, and its first and last one."""
    hit = matcher.matches(F.col("text"), "thing", aliases=("tion",))
    return evaluation.term_lens(load(spark, d, "documents"), "doc_id", "source", hit, matcher.matches(F.col("text"), "thing"))
