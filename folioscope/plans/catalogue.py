"""Registered queries and, for each, the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions import text as T
from folioscope.functions import urls as U
from folioscope.operators import index, lexical, matcher
from folioscope.sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
QUERY_WORDS = ["the", "thing", "with", "that"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


n = lambda name="n": F.count(F.lit(1)).alias(name)

# --------------------------------------------------------------------------- retrieval


def tokens_index(spark: SparkSession, d: str) -> str:
    """The index of all documents by retrieval tokens, with their source as kind; built once for a state of the files."""
    return index.served(load(spark, d, "documents"), "documents-tokens", tokens=T.tokens, kind=F.col("source"), places=False)


def bm25_hits(spark: SparkSession, d: str, k: int | None) -> DataFrame:
    """(doc_id, score) of the best documents from the stored index of words, which is built when it is first asked for."""
    path = index.served(load(spark, d, "documents"), "documents-words", tokens=T.words, norms=False)
    return index.bm25(spark, path, QUERY_WORDS, k).withColumnRenamed("key", "doc_id")


_TOKENS = "SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9''-]+')) AS term FROM documents"


@query(f"""
WITH p AS (SELECT doc_id, term, count(*) tf FROM ({_TOKENS}) GROUP BY 1, 2), d AS (SELECT term, count(*) df FROM p GROUP BY 1), t AS (SELECT count(*) n FROM documents),
w AS (SELECT doc_id, p.term, (1 + ln(tf)) * ln(1 + n / (1 + df)) AS w FROM p JOIN d USING (term), t),
s AS (SELECT doc_id, sum(CASE WHEN term IN ('the', 'thing', 'with', 'that') THEN w END) dot, sqrt(sum(w * w)) norm FROM w GROUP BY 1)
SELECT doc_id, round(dot / CASE WHEN norm > 0 THEN norm ELSE 1 END, 6) AS score FROM s WHERE dot > 0 ORDER BY score DESC, doc_id LIMIT 20""")
def lex_tfidf_topk(spark, d):
    """From the stored index of retrieval tokens, which is built when it is first asked for."""
    return index.tfidf(spark, tokens_index(spark, d), QUERY_WORDS, 20).withColumnRenamed("key", "doc_id")


_BM25 = """
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS toks FROM documents),
c AS (SELECT doc_id, len(toks) AS l, """ + ", ".join(f"len(list_filter(toks, lambda x: x = '{w}')) AS t{k}" for k, w in enumerate(QUERY_WORDS)) + """ FROM t),
s AS (SELECT count(*) n, avg(l) a, """ + ", ".join(f"sum(CASE WHEN t{k} > 0 THEN 1 ELSE 0 END) d{k}" for k in range(4)) + """ FROM c),
r AS (SELECT doc_id, round(""" + " + ".join(f"ln(1 + (n - d{k} + 0.5) / (d{k} + 0.5)) * t{k} * 2.2 / (t{k} + 1.2 * (0.25 + 0.75 * l / a))" for k in range(4)) + """, 6) AS score FROM c, s)
SELECT doc_id, score FROM r WHERE score > 0 ORDER BY score DESC, doc_id LIMIT {k}"""


@query(_BM25.replace("{k}", "20"))
def lex_bm25_topk(spark, d):
    return bm25_hits(spark, d, 20)


def _vector_zero(spark, d):
    return load(spark, d, "embeddings").filter("vec_id = 0").select("embedding").first()[0]


_COS = """
WITH q AS (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) e FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) v FROM embeddings WHERE {w}),
r AS (SELECT vec_id, round(list_dot_product(v, e) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(e, e))), 6) AS score FROM s, q)
SELECT vec_id, score FROM r WHERE score > 0 ORDER BY score DESC, vec_id LIMIT {k}"""


@query(_COS.format(w="true", k=20))
def vec_cosine_topk(spark, d):
    return lexical.cosine_topk(load(spark, d, "embeddings"), _vector_zero(spark, d), 20)


@query(_COS.format(w="label = 3", k=10))
def vec_filtered_topk(spark, d):
    return lexical.cosine_topk(load(spark, d, "embeddings"), _vector_zero(spark, d), 10, keep=F.col("label") == 3)


@query(f"""
WITH a AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY score DESC, vec_id) r, 'semantic' m FROM ({_COS.format(w="true", k=100)})),
b AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) r, 'lexical' m FROM ({_BM25.replace("{k}", "100")})),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT doc_id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score, string_agg(m, '+' ORDER BY m) AS modes FROM u GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 20""")
def hybrid_rrf(spark, d):
    """Vectors stand for documents of the same number."""
    semantic = lexical.cosine_topk(load(spark, d, "embeddings"), _vector_zero(spark, d), 100).withColumnRenamed("vec_id", "doc_id")
    return lexical.fuse({"lexical": bm25_hits(spark, d, 100), "semantic": semantic}, "doc_id", 20)


# --------------------------------------------------------------------------- matcher


def _bounded(p):
    return f"(^|[^\\p{{L}}\\p{{N}}]){p}([^\\p{{L}}\\p{{N}}]|$)"


@query(f"SELECT lang, count(*) AS n FROM documents WHERE regexp_matches(text, '(?i){_bounded('th[aàáâãäå]t')}') GROUP BY lang ORDER BY n DESC, lang")
def match_exact_count(spark, d):
    return load(spark, d, "documents").filter(matcher.matches(F.col("text"), "that")).groupBy("lang").agg(n()).orderBy(F.desc("n"), "lang")


@query(f"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i){_bounded('[oòóôõö]f[^\\p{L}\\p{N}]+th[eèéêë]')}')")
def match_phrase_list(spark, d):
    return load(spark, d, "documents").filter(matcher.matches(F.col("text"), "of the")).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE regexp_matches(text, '{_bounded('The')}')")
def match_case_sensitive(spark, d):
    return load(spark, d, "documents").filter(matcher.matches(F.col("text"), "The", case_sensitive=True)).select("doc_id")


@query(f"SELECT source, count(*) AS n FROM documents WHERE regexp_matches(text, '(?i){_bounded('cl[oòóôõö]w[nñ]')}') OR regexp_matches(text, '(?i){_bounded('m[oòóôõö]r[oòóôõö][nñ]')}') OR regexp_matches(text, '(?i){_bounded('[iìíîï]d[iìíîï][oòóôõö]t')}') GROUP BY source")
def match_alias_or(spark, d):
    return load(spark, d, "documents").filter(matcher.matches(F.col("text"), "clown/moron", aliases=("idiot",))).groupBy("source").agg(n())


def _quotes(docs):
    """The first place of a phrase in each document that holds it, with what stands around."""
    docs = docs.filter(F.contains(F.lower("text"), F.lit("of the")))
    start = F.locate("of the", F.lower("text"))
    return docs.select("doc_id", F.substring("text", start, F.lit(6)).alias("span"), F.substring("text", F.greatest(start - 60, F.lit(1)), F.lit(240)).alias("context"))


@query("SELECT doc_id, regexp_extract(text, '(?i)of the') AS span, substr(text, greatest(strpos(lower(text), 'of the') - 60, 1), 240) AS context FROM documents WHERE contains(lower(text), 'of the')")
def quote_context(spark, d):
    return _quotes(load(spark, d, "documents"))


@query("SELECT doc_id, regexp_extract(text, '(?i)of the') AS span, substr(text, greatest(strpos(lower(text), 'of the') - 60, 1), 240) AS context FROM documents WHERE contains(lower(text), 'of the')")
def quote_context_all(spark, d):
    """Quotes from documents of any language, or of none."""
    return _quotes(load(spark, d, "documents"))


@query("SELECT source, count(*) AS considered, sum(CASE WHEN contains(lower(text), 'tion') THEN 1 ELSE 0 END)::BIGINT AS matched, count(*) >= 10 AND sum(CASE WHEN contains(lower(text), 'tion') THEN 1 ELSE 0 END) > 0.5 * count(*) AS common FROM documents GROUP BY source")
def term_freq_advisory(spark, d):
    hit = F.sum(F.contains(F.lower("text"), F.lit("tion")).cast("long"))
    return load(spark, d, "documents").groupBy("source").agg(n("considered"), hit.alias("matched")).withColumn("common", (F.col("considered") >= 10) & (F.col("matched") > 0.5 * F.col("considered")))


# --------------------------------------------------------------------------- calendar and statistics


@query("SELECT year(o_orderdate)::INTEGER AS y, count(*) AS n FROM orders GROUP BY 1")
def counts_by_year(spark, d):
    return load(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(n())


@query("WITH c AS (SELECT year(o_orderdate)::INTEGER AS y, count(*) AS n FROM orders GROUP BY 1) SELECT y, n, n = (SELECT max(n) FROM c) AS most FROM c WHERE n = (SELECT max(n) FROM c) OR n = (SELECT min(n) FROM c)")
def year_extremes(spark, d):
    c = counts_by_year(spark, d)
    ends = c.agg(F.max("n").alias("hi"), F.min("n").alias("lo"))
    return c.crossJoin(F.broadcast(ends)).filter("n = hi or n = lo").select("y", "n", (F.col("n") == F.col("hi")).alias("most"))


@query("SELECT lang AS kind, count(*) AS items, count(DISTINCT source) AS sources, sum(n_chars)::BIGINT AS chars, max(n_chars) AS longest, count(*) FILTER (WHERE text IS NULL OR text = '') AS empty FROM documents GROUP BY lang")
def corpus_stats_by_kind(spark, d):
    return load(spark, d, "documents").groupBy(F.col("lang").alias("kind")).agg(n("items"), F.count_distinct("source").alias("sources"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"), F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("empty"))


def _signals(docs, text):
    """Distinctive terms of each bucket (here a source): counted once per document, weighted by how few buckets use them."""
    terms = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z][a-z]{3,})"), F.lit(1)))
    t = docs.select("source", F.explode_outer(terms).alias("term")).filter("term is not null")  # explode would split each text twice
    c = t.groupBy("source", "term").agg(n())
    y = c.groupBy("term").agg(n("k"))
    m = docs.agg(F.count_distinct("source").alias("m"))
    r = c.join(y, "term").crossJoin(F.broadcast(m)).withColumn("score", F.round(F.col("n") * F.log(1 + F.col("m") / F.col("k")), 6))
    w = Window.partitionBy("source").orderBy(F.desc("score"), F.desc("n"), "term")
    return r.withColumn("rank", F.row_number().over(w)).filter("rank <= 5").select("source", "term", "n", "score", "rank")


@query("""
WITH t AS (SELECT source, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z]{3,}'))) AS term FROM documents),
c AS (SELECT source, term, count(*) n FROM t GROUP BY 1, 2), y AS (SELECT term, count(*) k FROM c GROUP BY 1), s AS (SELECT count(DISTINCT source) m FROM documents),
r AS (SELECT source, c.term, n, round(n * ln(1 + m / k), 6) score FROM c JOIN y USING (term), s)
SELECT source, term, n, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, n DESC, term)::INTEGER AS rank FROM r) WHERE rank <= 5""")
def yearly_signals(spark, d):
    """Signals of whole texts."""
    return _signals(load(spark, d, "documents"), F.col("text"))


#: The name that the query of whole texts had beside one of prefixes.
QUERIES["yearly_signals_whole"] = yearly_signals
ORACLE_SQL["yearly_signals_whole"] = ORACLE_SQL["yearly_signals"]


@query("SELECT l_returnflag, l_linestatus, CAST(l_linenumber AS VARCHAR) AS l_linenumber, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_linenumber), ())")
def counts_multi_dim(spark, d):
    cols = ["l_returnflag", "l_linestatus", "l_linenumber"]
    return load(spark, d, "lineitem").groupingSets([[c] for c in cols] + [[]], *cols).agg(n(), F.sum("l_quantity").alias("qty")).withColumn("l_linenumber", F.col("l_linenumber").cast("string"))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC LIMIT 25")
def page_newest(spark, d):
    return load(spark, d, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc_nulls_last("o_orderdate"), F.desc("o_orderkey")).limit(25)


@query("SELECT o_orderkey, (SELECT count(*) FROM orders) AS total_count, (SELECT count(*) FROM orders) - 50 AS omitted_after FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25 OFFSET 25")
def page_offset(spark, d):
    o = load(spark, d, "orders")
    page = o.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).offset(25).limit(25).select("o_orderkey")
    return page.crossJoin(F.broadcast(o.agg(n("total_count")))).withColumn("omitted_after", F.col("total_count") - 50)


@query("SELECT y, o_orderkey, rank FROM (SELECT year(o_orderdate)::INTEGER AS y, o_orderkey, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS rank FROM orders) WHERE rank <= 3")
def per_year_top_n(spark, d):
    o = load(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    w = Window.partitionBy("y").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return o.withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("y", "o_orderkey", "rank")


@query("""
WITH d AS (SELECT o_orderkey, o_orderdate::DATE AS day, year(o_orderdate)::INTEGER AS y FROM orders),
c AS (SELECT *, least(abs(datediff('day', make_date(y, 6, 15), day)), abs(datediff('day', make_date(y + 1, 6, 15), day)), abs(datediff('day', make_date(y - 1, 6, 15), day)))::INTEGER AS away FROM d)
SELECT y, o_orderkey, away FROM c WHERE away <= 3 AND y < 1999""")
def on_this_day_window(spark, d):
    """Records within three days of June 15th in years before 1999."""
    o = load(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.year("o_orderdate").alias("y"))
    away = F.least(*[F.abs(F.datediff("day", F.make_date(F.col("y") + k, F.lit(6), F.lit(15)))) for k in (-1, 0, 1)])
    return o.withColumn("away", away).filter("away <= 3 and y < 1999").select("y", "o_orderkey", "away")


@query("SELECT o_orderpriority, count(*) FILTER (WHERE year(o_orderdate) = 1996) AS era_a, count(*) FILTER (WHERE year(o_orderdate) = 1998) AS era_b FROM orders GROUP BY 1")
def compare_eras(spark, d):
    y = F.year("o_orderdate")
    return load(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_if(y == 1996).alias("era_a"), F.count_if(y == 1998).alias("era_b"))


# --------------------------------------------------------------------------- joins


@query("""
WITH w AS (SELECT o_custkey, o_orderkey, o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders)
SELECT o_custkey, o_orderkey, datediff('day', prev::DATE, o_orderdate::DATE)::INTEGER AS gap FROM w WHERE prev IS NOT NULL AND datediff('day', prev::DATE, o_orderdate::DATE) <= 14""")
def issue_week_interval_join(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = load(spark, d, "orders").withColumn("prev", F.lag("o_orderdate").over(w))
    return o.withColumn("gap", F.datediff("o_orderdate", "prev")).filter("gap <= 14").select("o_custkey", "o_orderkey", "gap")


@query("""
SELECT p.event_id, (SELECT max(s.ts) FROM events s WHERE s.user_id = p.user_id AND s.event_type = 'signup' AND s.ts <= p.ts) AS signup_ts FROM events p WHERE p.event_type = 'purchase'""")
def asof_heading(spark, d):
    """The last sign-up at or before each purchase, by one window instead of a join."""
    e = load(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.max(F.when(F.col("event_type") == "signup", F.col("ts"))).over(w)
    return e.withColumn("signup_ts", last).filter("event_type = 'purchase'").select("event_id", "signup_ts")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_category(spark, d):
    o = load(spark, d, "orders").filter("o_orderpriority = '1-URGENT'")
    return load(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_unfiled(spark, d):
    """Customers without an urgent order."""
    return load(spark, d, "customer").join(load(spark, d, "orders").filter("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey, l_suppkey) AS same FROM lineitem")
def correlated_count_window(spark, d):
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.count(F.lit(1)).over(Window.partitionBy("l_orderkey", "l_suppkey")).alias("same"))


@query("SELECT o_orderkey, coalesce('part ' || p_name, 'supplier ' || s_name, 'none') AS target FROM orders LEFT JOIN part ON p_partkey = o_orderkey LEFT JOIN supplier ON s_suppkey = o_custkey")
def link_priority_coalesce(spark, d):
    o, p, s = (load(spark, d, t) for t in ("orders", "part", "supplier"))
    j = o.join(p, F.col("p_partkey") == F.col("o_orderkey"), "left").join(s, F.col("s_suppkey") == F.col("o_custkey"), "left")
    return j.select("o_orderkey", F.coalesce(F.concat(F.lit("part "), "p_name"), F.concat(F.lit("supplier "), "s_name"), F.lit("none")).alias("target"))


@query("""
WITH a AS (SELECT o_orderkey k, o_totalprice v FROM orders WHERE year(o_orderdate) <= 1997), b AS (SELECT o_orderkey k, CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 1 ELSE o_totalprice END v FROM orders WHERE year(o_orderdate) >= 1996)
SELECT CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.v <> b.v THEN 'changed' ELSE 'same' END AS change, count(*) AS n FROM a FULL OUTER JOIN b ON a.k = b.k GROUP BY 1""")
def snapshot_diff(spark, d):
    o = load(spark, d, "orders")
    a = o.filter(F.year("o_orderdate") <= 1997).select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    b = o.filter(F.year("o_orderdate") >= 1996).select(F.col("o_orderkey").alias("k2"), F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("v2"))
    change = F.when(F.col("k").isNull(), "added").when(F.col("k2").isNull(), "removed").when(F.col("v") != F.col("v2"), "changed").otherwise("same")
    return a.join(b, F.col("k") == F.col("k2"), "full_outer").groupBy(change.alias("change")).agg(n())


@query("SELECT 'missing' AS kind, count(*) AS n FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels) UNION ALL SELECT 'extra', count(*) FROM (SELECT doc_id FROM labels EXCEPT ALL SELECT doc_id FROM documents) UNION ALL SELECT 'twice', count(*) FROM (SELECT doc_id FROM labels GROUP BY 1 HAVING count(*) > 1)")
def coverage_oracle(spark, d):
    a, b = load(spark, d, "documents").select("doc_id"), load(spark, d, "labels").select("doc_id")
    parts = {"missing": a.exceptAll(b), "extra": b.exceptAll(a), "twice": b.groupBy("doc_id").count().filter("count > 1")}
    out = [x.agg(n()).select(F.lit(k).alias("kind"), "n") for k, x in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


#: Rows of a table whose pairs one task counts, about.
COUNTED_ROWS = 250_000


@query("""
WITH p AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), c AS (SELECT a.l_suppkey AS s, b.l_suppkey AS other, count(*) AS n FROM p a JOIN p b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey GROUP BY 1, 2)
SELECT s, other, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY n DESC, other)::INTEGER AS rank FROM c) WHERE rank <= 5""")
def cooccurrence_topk(spark, d):
    # tasks follow from the rows, so that what a task counts doesn't grow with the table; each pair is counted once, then shown both ways
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // COUNTED_ROWS))
    p = lines.repartition(tasks, "l_orderkey").distinct()
    b = p.withColumnRenamed("l_suppkey", "other")
    pairs = p.join(b, "l_orderkey").filter("l_suppkey < other").select(F.col("l_suppkey").alias("s"), "other")
    half = pairs.repartition(tasks, "s", "other").groupBy("s", "other").agg(n())
    both = F.array(F.struct("s", "other"), F.struct(F.col("other").alias("s"), F.col("s").alias("other")))
    c = half.select(F.explode(both).alias("p"), "n").select("p.s", "p.other", "n")
    w = Window.partitionBy("s").orderBy(F.desc("n"), "other")
    return c.withColumn("rank", F.row_number().over(w)).filter("rank <= 5")


@query("SELECT min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY sha256(text) HAVING count(*) > 1")
def exact_dups(spark, d):
    return load(spark, d, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("first_id"), n("copies")).filter("copies > 1").drop("h")


@query("""
WITH x AS (SELECT label, i, avg(CAST(e AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS e, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1, 2),
p AS (SELECT a.label, b.label AS other, sum(a.m * b.m) / (sqrt(sum(a.m * a.m)) * sqrt(sum(b.m * b.m))) AS s FROM x a JOIN x b ON a.i = b.i AND a.label <> b.label GROUP BY 1, 2)
SELECT label, other, round(s, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(s, 4) DESC, other)::INTEGER AS rank FROM p) WHERE rank <= 6""")
def centroid_similarity(spark, d):
    e = load(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "e"))
    x = e.groupBy("label", "i").agg(F.avg(F.col("e").cast("double")).alias("m"))
    y = x.select(F.col("label").alias("other"), "i", F.col("m").alias("m2"))
    p = x.join(y, "i").filter("label <> other").groupBy("label", "other").agg(F.round(F.sum(F.col("m") * F.col("m2")) / (F.sqrt(F.sum(F.col("m") * F.col("m"))) * F.sqrt(F.sum(F.col("m2") * F.col("m2")))), 4).alias("score"))
    w = Window.partitionBy("label").orderBy(F.desc("score"), "other")
    return p.withColumn("rank", F.row_number().over(w)).filter("rank <= 6")


# --------------------------------------------------------------------------- audit, readers, turns


@query("SELECT event_type, count(*) AS calls, count(DISTINCT user_id) AS readers, round(avg(value), 6) AS avg_value, quantile_disc(value, 0.95) AS p95, max(value) AS most FROM events GROUP BY 1")
def audit_census(spark, d):
    return load(spark, d, "events").groupBy("event_type").agg(n("calls"), F.count_distinct("user_id").alias("readers"), F.round(F.avg("value"), 6).alias("avg_value"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"), F.max("value").alias("most"))


@query("""
WITH m AS (SELECT count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-16' AND ts < TIMESTAMP '2024-01-31') AS recent, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-16') AS prior, user_id FROM events GROUP BY user_id)
SELECT user_id, recent, prior, CASE WHEN recent >= prior * 1.25 AND recent - prior >= 3 THEN 'rising' WHEN recent <= prior * 0.8 AND prior - recent >= 3 THEN 'falling' ELSE 'steady' END AS trend FROM m""")
def reader_windows_trend(spark, d):
    ts = F.col("ts")
    between = lambda a, b: F.count_if((ts >= F.lit(a).cast("timestamp")) & (ts < F.lit(b).cast("timestamp")))
    m = load(spark, d, "events").groupBy("user_id").agg(between("2024-01-16", "2024-01-31").alias("recent"), between("2024-01-01", "2024-01-16").alias("prior"))
    r, p = F.col("recent"), F.col("prior")
    return m.withColumn("trend", F.when((r >= p * 1.25) & (r - p >= 3), "rising").when((r <= p * 0.8) & (p - r >= 3), "falling").otherwise("steady"))


@query("SELECT k AS arg, event_type, count(*) AS n FROM (SELECT event_type, unnest(json_keys(props)) AS k FROM events) GROUP BY 1, 2")
def json_arg_keys(spark, d):
    return load(spark, d, "events").select("event_type", F.explode(F.json_object_keys("props")).alias("arg")).groupBy("arg", "event_type").agg(n())


@query("SELECT user_id, date_trunc('hour', ts) AS hour, count(*) AS n, count(*) <= 2 AS allowed FROM events GROUP BY 1, 2")
def hourly_rate_limit(spark, d):
    return load(spark, d, "events").groupBy("user_id", F.window("ts", "1 hour").start.alias("hour")).agg(n()).withColumn("allowed", F.col("n") <= 2)


@query("SELECT user_id, CAST(ts::DATE AS VARCHAR) AS day, sum(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END)::BIGINT AS spent FROM events GROUP BY 1, 2")
def daily_quota(spark, d):
    return load(spark, d, "events").groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.sum(F.when(F.col("event_type") == "error", -1).otherwise(1)).alias("spent"))


@query("SELECT CASE WHEN toxic = 1 AND quality = 0 THEN 'critical' WHEN toxic = 1 THEN 'high' WHEN quality = 0 THEN 'medium' ELSE 'routine' END AS priority, lang, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2")
def attention_ladder(spark, d):
    j = load(spark, d, "labels").join(load(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    ladder = F.when((F.col("toxic") == 1) & (F.col("quality") == 0), "critical").when(F.col("toxic") == 1, "high").when(F.col("quality") == 0, "medium").otherwise("routine")
    return j.groupBy(ladder.alias("priority"), "lang").agg(n())


@query("SELECT conv_id, turn, substr(text, greatest(strpos(lower(text), 'tion') - 40, 1), 100) AS snippet FROM conversations WHERE contains(lower(text), 'tion')")
def turn_search_snippet(spark, d):
    at = F.locate("tion", F.lower("text"))
    return load(spark, d, "conversations").filter(at > 0).select("conv_id", "turn", F.substring("text", F.greatest(at - 40, F.lit(1)), F.lit(100)).alias("snippet"))


@query("""
WITH f AS (SELECT conv_id, turn, role, CASE WHEN role = lag(role) OVER w THEN 0 ELSE 1 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM f)
SELECT conv_id, run::BIGINT AS run, min(role) AS role, count(*) AS n, min(turn) AS first_turn FROM g GROUP BY 1, 2""")
def turn_runs(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    f = load(spark, d, "conversations").withColumn("new", F.when(F.col("role") == F.lag("role").over(w), 0).otherwise(1))
    return f.withColumn("run", F.sum("new").over(w)).groupBy("conv_id", "run").agg(F.min("role").alias("role"), n(), F.min("turn").alias("first_turn"))


@query("WITH b AS (SELECT conv_id, turn, sum(least(length(text), 700)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM conversations) SELECT conv_id, turn, used::BIGINT AS used FROM b WHERE used <= 1500")
def turn_budget(spark, d):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return load(spark, d, "conversations").withColumn("used", F.sum(F.least(F.length("text"), F.lit(700))).over(w)).filter("used <= 1500").select("conv_id", "turn", "used")


# --------------------------------------------------------------------------- pages

_HOST = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^([a-z][a-z0-9+.-]*:)?/+', ''), '[/?#].*$', ''), '^.*@', ''), ':[0-9]+$', ''), '\.+$', ''), '^www\.', '')"""


@query(f"SELECT {_HOST} AS host, count(*) AS n, min(page_id) AS first_page, max(page_id) AS last_page FROM pages GROUP BY 1")
def top_references(spark, d):
    return load(spark, d, "pages").groupBy(U.domain(F.col("url")).alias("host")).agg(n(), F.min("page_id").alias("first_page"), F.max("page_id").alias("last_page"))


@query(f"SELECT page_id, {_HOST} AS host FROM pages WHERE {_HOST} = 'example.com' OR {_HOST} LIKE '%.example.com'")
def domain_parent_filter(spark, d):
    return load(spark, d, "pages").withColumn("host", U.domain(F.col("url"))).filter(U.in_domain(F.col("host"), "example.com")).select("page_id", "host")


@query(r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages")
def page_titles(spark, d):
    return load(spark, d, "pages").select("page_id", T.page_title(F.col("html")).alias("title"))


_DROPPED = "^(?:utm_.*|" + "|".join([*U.TRACKING, *U.AMP]) + ")$"
_FORM = lambda x: f"replace(url_encode(url_decode(replace({x}, '+', ' '))), '%20', '+')"


@query(rf"""
WITH a AS (SELECT page_id, regexp_replace(trim(url), '(?i)^(?:[a-z][a-z0-9+.-]*://)+([a-z][a-z0-9+.-]*://)', '\1') AS u FROM pages),
b AS (SELECT page_id, lower(regexp_extract(u, '(?i)^([a-z][a-z0-9+.-]*)://', 1)) AS scheme, regexp_replace(regexp_replace(u, '(?i)^[a-z][a-z0-9+.-]*://+', ''), '#.*$', '') AS r FROM a),
c AS (SELECT *, regexp_replace(regexp_extract(r, '^([^/?]*)', 1), '^.*@', '') AS site, regexp_extract(r, '^[^/?]*([^?]*)', 1) AS path, regexp_extract(r, '\?(.*)$', 1) AS q FROM b),
d AS (SELECT *, CASE WHEN lower(site) LIKE '%.cdn.ampproject.org' THEN regexp_extract(path, '(?i)^/[a-z](?:/s)?/(.+)$', 1) WHEN regexp_matches(lower(site), '^(www\.)?google\.[a-z.]+$') THEN regexp_extract(path, '(?i)^/amp/(?:s/)?(.+)$', 1) ELSE '' END AS wrapped FROM c),
e AS (SELECT page_id, scheme, q, wrapped <> '' AS inside, CASE WHEN wrapped <> '' THEN regexp_extract(wrapped, '^([^/]*)', 1) ELSE site END AS site, CASE WHEN wrapped <> '' THEN regexp_extract(wrapped, '^[^/]*(.*)$', 1) ELSE path END AS path FROM d),
f AS (SELECT *, regexp_replace(lower(regexp_replace(site, ':[0-9]*$', '')), '^(?:www[0-9]*|m|mobile|amp)\.([^.]+\.)', '\1') AS host, regexp_extract(site, ':([0-9]+)$', 1) AS port, regexp_replace(regexp_replace(regexp_replace(path, '(?i)/amp(/|$)', '\1', 'g'), '(?i)\.amp(\.html?)$', '\1'), '/+$', '') AS p FROM e),
g AS (SELECT *, list_filter(string_split(q, '&'), lambda x: x <> '' AND x <> 'outputType=amp' AND NOT regexp_matches(lower(regexp_extract(x, '^([^=]*)', 1)), '{_DROPPED}') AND NOT (lower(regexp_extract(x, '^([^=]*)', 1)) = 's' AND host IN ('twitter.com', 'x.com'))) AS kept FROM f),
h AS (SELECT page_id, host || CASE WHEN port = '' OR (port = '443' AND (inside OR scheme IN ('https', ''))) OR (port = '80' AND scheme = 'http' AND NOT inside) THEN '' ELSE ':' || port END
  || array_to_string(list_transform(string_split(p, '/'), lambda s: replace(replace(replace(replace(replace(url_encode(url_decode(s)), '%21', '!'), '%27', chr(39)), '%28', '('), '%29', ')'), '%2A', '*')), '/')
  || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(list_transform(kept, lambda x: {_FORM("regexp_extract(x, '^([^=]*)', 1)")} || '=' || {_FORM("regexp_replace(x, '^[^=]*=?', '')")}), '&') ELSE '' END AS url_key FROM g)
SELECT url_key, count(*) AS n, min(page_id) AS first_page FROM h GROUP BY 1""")
def url_canonical_key(spark, d):
    return load(spark, d, "pages").groupBy(U.url_key(F.col("url")).alias("url_key")).agg(n(), F.min("page_id").alias("first_page"))


_TEXT = "html"
for _old, _new in (("(?is)<script.*?</script>", " "), ("(?is)<style.*?</style>", " "), ("(?is)<(?:nav|header|footer|aside).*?</(?:nav|header|footer|aside)>", " "), (r"(?i)<br\s*/?\s*>|</p>|</h[1-6]>|</li>", "\n"), ("<[^>]+>", " ")):
    _TEXT = f"regexp_replace({_TEXT}, '{_old}', '{_new}', 'g')"
for _old, _new in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
    _TEXT = f"replace({_TEXT}, '{_old}', '{_new}')"
_TEXT = f"replace({_TEXT}, '&#39;', chr(39))"
for _old, _new in (("[ \t]+", " "), (r"\s*\n\s*", "\n"), (r"^\s+|\s+$", "")):
    _TEXT = f"regexp_replace({_TEXT}, '{_old}', '{_new}', 'g')"


@query(f"SELECT page_id, {_TEXT} AS text FROM pages")
def html_to_text(spark, d):
    return load(spark, d, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


@query("""
SELECT rule, count(*) AS n FROM (SELECT doc_id, unnest(list_filter([CASE WHEN length(text) < 120 THEN 'short body' END, CASE WHEN contains(text, 'Ã') THEN 'mojibake' END, CASE WHEN contains(text, '{{') THEN 'template leak' END, CASE WHEN contains(text, '&amp;amp;') THEN 'double entity' END, CASE WHEN regexp_matches(text, 'https?://') THEN 'bare url' END], lambda x: x IS NOT NULL)) AS rule FROM documents) GROUP BY rule""")
def quality_findings(spark, d):
    t = F.col("text")
    rules = {"short body": F.length(t) < 120, "mojibake": F.contains(t, F.lit("Ã")), "template leak": F.contains(t, F.lit("{{")), "double entity": F.contains(t, F.lit("&amp;amp;")), "bare url": t.rlike("https?://")}
    found = F.array_compact(F.array(*[F.when(c, k) for k, c in rules.items()]))
    return load(spark, d, "documents").select(F.explode(found).alias("rule")).groupBy("rule").agg(n())


@query("SELECT lang, sum(len(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9''\\-]*')))::BIGINT AS words, count(DISTINCT left(sha256(text), 16)) AS bodies FROM documents GROUP BY lang")
def word_counts(spark, d):
    return load(spark, d, "documents").groupBy("lang").agg(F.sum(T.word_count(F.col("text"))).cast("long").alias("words"), F.count_distinct(T.body_hash(F.col("text"))).alias("bodies"))
