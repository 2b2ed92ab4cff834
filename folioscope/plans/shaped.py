"""Registered queries for scope, attribution, twins, passages and diffs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions import text as T
from folioscope.functions import urls as U
from folioscope.operators import index, shaping
from folioscope.plans.catalogue import _BM25, _HOST, ORACLE_SQL, QUERIES, QUERY_WORDS, bm25_hits, n, query
from folioscope.sources.tables import load, scratch

__all__ = ["ORACLE_SQL", "QUERIES"]

# --------------------------------------------------------------------------- projections and scope


@query("SELECT doc_id, source, lang, length(text) > 200 AS clipped, substr(text, 1, 200) AS preview FROM documents")
def public_projection(spark, d):
    """Only what may be shown, so that the scan reads four columns."""
    return load(spark, d, "documents").select("doc_id", "source", "lang", (F.length("text") > 200).alias("clipped"), F.substring("text", 1, 200).alias("preview"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority NOT IN ('5-LOW', '4-NOT SPECIFIED') AND o_orderdate < TIMESTAMP '1998-06-01' AND year(o_orderdate) BETWEEN 1996 AND 1998 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def scope_before_topk(spark, d):
    o = shaping.scope(load(spark, d, "orders"), {"o_orderstatus": ["F", "O"]}, {"o_orderpriority": ["5-LOW", "4-NOT SPECIFIED"]}, "o_orderdate", "1998-06-01", (1996, 1998))
    return o.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


@query("SELECT 'yes' AS asked, count(*) FILTER (WHERE coalesce(toxic, 0) = 1) AS n FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'no', count(*) FILTER (WHERE coalesce(toxic, 0) <> 1) FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'any', count(*) FROM documents LEFT JOIN labels USING (doc_id)")
def tri_state_filter(spark, d):
    j = load(spark, d, "documents").select("doc_id").join(load(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    counts = j.agg(*[F.count_if(shaping.tri_state(F.col("toxic") == 1, w)).alias(k) for k, w in (("yes", True), ("no", False), ("any", None))])
    return counts.unpivot([], ["yes", "no", "any"], "asked", "n")


@query("SELECT p_partkey FROM part WHERE p_size > 40 AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)")
def linked_from_filter(spark, d):
    lines = load(spark, d, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    p = load(spark, d, "part").filter("p_size > 40").select("p_partkey")
    return p.join(lines.filter("l_returnflag = 'R'"), "p_partkey", "left_semi").join(lines.filter("l_quantity = 50"), "p_partkey", "left_anti")


# --------------------------------------------------------------------------- joins


@query("SELECT doc_id, coalesce(quality, -1)::INTEGER AS quality, toxic IS NOT NULL AS labelled FROM documents LEFT JOIN labels USING (doc_id)")
def sidecar_merge(spark, d):
    j = load(spark, d, "documents").select("doc_id").join(load(spark, d, "labels"), "doc_id", "left")
    return j.select("doc_id", F.coalesce("quality", F.lit(-1)).cast("int").alias("quality"), F.col("toxic").isNotNull().alias("labelled"))


@query("""
WITH l AS (SELECT l_orderkey, count(*) AS lines, sum(l_quantity) AS qty, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem GROUP BY 1)
SELECT o_orderkey, c_name, lines, qty, parts FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN l ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT'""")
def record_cogroup(spark, d):
    """Records with their parts in order: the many side is folded before it meets the record."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string"))
    lines = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(n("lines"), F.sum("l_quantity").alias("qty"), F.array_join(parts, ",").alias("parts"))
    o = load(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return o.join(load(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey").join(lines, "o_orderkey", "left").select("o_orderkey", "c_name", "lines", "qty", "parts")


@query("SELECT p.event_id, s.event_id AS signup_id FROM events p JOIN events s ON s.user_id = p.user_id AND p.ts >= s.ts - INTERVAL 3 DAY AND p.ts <= s.ts + INTERVAL 1 DAY WHERE p.event_type = 'purchase' AND s.event_type = 'signup'")
def window_interval_join(spark, d):
    """Purchases within three days before and one day after a sign-up of the same user."""
    e = load(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    spans = e.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("signup_id"), F.expr("ts - interval 3 day").alias("begin"), F.expr("ts + interval 1 day").alias("end"))
    return shaping.interval_join(e.filter("event_type = 'purchase'"), spans, "user_id", "ts", "begin", "end").select("event_id", "signup_id")


@query("SELECT a.o_orderkey, b.o_orderkey AS other FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND abs(datediff('day', a.o_orderdate::DATE, b.o_orderdate::DATE)) <= 1 AND a.o_orderkey < b.o_orderkey WHERE least(a.o_totalprice, b.o_totalprice) >= 0.6 * greatest(a.o_totalprice, b.o_totalprice)")
def day_band_join(spark, d):
    """Orders of one customer at most a day apart whose prices are similar."""
    o = load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.to_date("o_orderdate").alias("day"))
    near = shaping.band_join(o, o, ["o_custkey"], "day").filter("o_orderkey < other_o_orderkey")
    alike = F.least("o_totalprice", "other_o_totalprice") >= 0.6 * F.greatest("o_totalprice", "other_o_totalprice")
    return near.filter(alike).select("o_orderkey", F.col("other_o_orderkey").alias("other"))


@query("""
WITH r0 AS (SELECT c_custkey, min(s_name) AS t, count(*) AS k FROM customer JOIN supplier ON s_suppkey = c_custkey GROUP BY 1),
r1 AS (SELECT c_custkey, min(s_name) AS t, count(DISTINCT s_name) AS k FROM customer JOIN supplier ON s_nationkey = c_nationkey AND s_acctbal > 7000 GROUP BY 1)
SELECT c.c_custkey, CASE WHEN r0.k = 1 THEN r0.t WHEN r0.k IS NULL AND r1.k = 1 THEN r1.t END AS target, CASE WHEN r0.k = 1 THEN 0 WHEN r0.k IS NULL AND r1.k = 1 THEN 1 END AS rule
FROM customer c LEFT JOIN r0 ON r0.c_custkey = c.c_custkey LEFT JOIN r1 ON r1.c_custkey = c.c_custkey""")
def attribution(spark, d):
    """By key first, then by the only large supplier of the nation; several candidates attribute nothing."""
    c, s = load(spark, d, "customer").select("c_custkey", "c_nationkey"), load(spark, d, "supplier")
    by_key = s.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("target"))
    # a nation's suppliers are as many as the table has: at most two names of each are joined, which tell one from several
    large = s.filter("s_acctbal > 7000").groupBy("s_nationkey").agg(F.min("s_name").alias("low"), F.max("s_name").alias("high"))
    targets = large.select("s_nationkey", F.explode(F.array_distinct(F.array("low", "high"))).alias("target"))
    by_nation = c.join(targets, F.col("s_nationkey") == F.col("c_nationkey")).select("c_custkey", "target")
    return shaping.attributed(c.select("c_custkey"), "c_custkey", [by_key, by_nation])


@query("SELECT p_partkey, count(l_orderkey) AS incoming, count(DISTINCT l_suppkey) AS sources, min(l_orderkey) AS first_from FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
def incoming_links(spark, d):
    lines = load(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(n("incoming"), F.count_distinct("l_suppkey").alias("sources"), F.min("l_orderkey").alias("first_from"))
    return load(spark, d, "part").select("p_partkey").join(lines, "p_partkey", "left").fillna(0, ["incoming", "sources"])


@query("SELECT coalesce(event_type, 'none') AS kind, k, n_name, count(*) AS n FROM (SELECT event_type, user_id, unnest(json_keys(props)) AS k FROM events) e JOIN customer ON c_custkey = user_id JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2, 3")
def json_three_way(spark, d):
    e = load(spark, d, "events").select("event_type", F.col("user_id").alias("c_custkey"), F.explode(F.json_object_keys("props")).alias("k"))
    j = e.join(load(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey").join(load(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return j.groupBy(F.coalesce("event_type", F.lit("none")).alias("kind"), "k", "n_name").agg(n())


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE event_type = 'purchase') AS kudos, count(DISTINCT ts::DATE) AS days FROM events GROUP BY 1")
def aggregate_lookups(spark, d):
    """What would be a look-up for each row is one conditional aggregate."""
    kind = F.col("event_type")
    return load(spark, d, "events").groupBy("user_id").agg(F.count_if(kind == "view").alias("views"), F.count_if(kind == "purchase").alias("kudos"), F.count_distinct(F.to_date("ts")).alias("days"))


@query("""
WITH b AS (SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'X' ELSE c_name END AS c_name, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment FROM customer)
SELECT a.c_custkey, 'c_name' AS field, a.c_name AS before, b.c_name AS after FROM customer a JOIN b USING (c_custkey) WHERE a.c_name IS DISTINCT FROM b.c_name
UNION ALL SELECT a.c_custkey, 'c_mktsegment', a.c_mktsegment, b.c_mktsegment FROM customer a JOIN b USING (c_custkey) WHERE a.c_mktsegment IS DISTINCT FROM b.c_mktsegment""")
def field_level_diff(spark, d):
    a = load(spark, d, "customer")
    b = a.withColumn("c_name", F.when(F.col("c_nationkey") == 3, "X").otherwise(F.col("c_name"))).withColumn("c_mktsegment", F.when(F.col("c_acctbal") < 0, "DEBT").otherwise(F.col("c_mktsegment")))
    return shaping.field_changes(a, b, "c_custkey", ["c_name", "c_mktsegment"])


@query("WITH e AS (SELECT DISTINCT l_partkey % 200 AS a, l_suppkey % 200 AS b FROM lineitem WHERE l_linenumber = 1 AND l_quantity < 5) SELECT x.a, x.b FROM e x JOIN e y ON x.a = y.b AND x.b = y.a AND x.a < x.b")
def bidirectional_edges(spark, d):
    e = load(spark, d, "lineitem").filter("l_linenumber = 1 and l_quantity < 5").selectExpr("l_partkey % 200 as a", "l_suppkey % 200 as b")
    return shaping.mutual_edges(e, "a", "b")


@query("""
WITH w AS (SELECT unnest(['red', 'nothing of this name', 'BUILDING', 'MACHINERY', 'Customer#000000001', 'Customer#000000002']) AS name),
r AS (SELECT c_name AS name, c_custkey FROM customer UNION ALL SELECT c_mktsegment, c_custkey FROM customer)
SELECT w.name, CASE WHEN count(c_custkey) = 0 THEN 'missing' WHEN count(c_custkey) > 1 THEN 'ambiguous' ELSE 'found' END AS state, CASE WHEN count(c_custkey) = 1 THEN min(c_custkey) END AS c_custkey FROM w LEFT JOIN r ON r.name = w.name GROUP BY 1""")
def lookup_with_ambiguity(spark, d):
    c = load(spark, d, "customer")
    rows = c.select(F.col("c_name").alias("name"), "c_custkey").unionByName(c.select(F.col("c_mktsegment").alias("name"), "c_custkey"))
    names = spark.range(1).select(F.explode(F.array(*map(F.lit, ["red", "nothing of this name", "BUILDING", "MACHINERY", "Customer#000000001", "Customer#000000002"]))).alias("name"))
    return shaping.lookup(names, rows, "name", "c_custkey")


# --------------------------------------------------------------------------- pages, groups, terms


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha256(coalesce(text, '')) ORDER BY doc_id LIMIT 40")
def page_without_twins(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    return shaping.without_twins(docs, F.col("hash"), [F.col("doc_id")], 40).select("doc_id")


@query(f"""
WITH h AS (SELECT doc_id, score, source, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM ({_BM25.replace("{k}", "50")}) JOIN documents USING (doc_id))
SELECT source, count(*) AS hits, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY r) AS items, row_number() OVER (ORDER BY min(r))::INTEGER AS place FROM h GROUP BY source""")
def hits_by_source(spark, d):
    docs = load(spark, d, "documents")
    hits = bm25_hits(spark, d, 50)
    grouped = shaping.grouped_by_source(docs.select("doc_id", "source").join(F.broadcast(hits), "doc_id"), "source", "doc_id", "score")
    return grouped.withColumn("items", F.array_join(F.transform("items", lambda x: x.cast("string")), ","))


@query(f"""
WITH s AS (SELECT doc_id, score + CASE WHEN regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}])with that([^\\p{{L}}\\p{{N}}]|$)') THEN 1000 ELSE 0 END AS score FROM ({_BM25.replace("LIMIT {k}", "")}) JOIN documents USING (doc_id))
SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 20""")
def lex_phrase_first(spark, d):
    """Documents that hold the phrase come before those that only hold its words."""
    docs = load(spark, d, "documents")
    held = F.lower("text").rlike(r"(^|[^\p{L}\p{N}])with that([^\p{L}\p{N}]|$)")
    scored = bm25_hits(spark, d, None).join(docs.select("doc_id", F.when(held, 1000).otherwise(0).alias("lift")), "doc_id")
    return scored.select("doc_id", (F.col("score") + F.col("lift")).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


@query("SELECT term, count(*) AS df, min(doc_id) AS first, max(doc_id) AS last FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z]{5,}'))) AS term FROM documents) GROUP BY 1 HAVING count(*) BETWEEN 5 AND 40")
def inverted_index_min_support(spark, d):
    terms = F.regexp_extract_all(F.lower("text"), F.lit("([a-z][a-z]{5,})"), F.lit(1))
    return shaping.inverted_index(load(spark, d, "documents"), "doc_id", terms, 5, 40)


@query(_BM25.replace("{k}", "20"))
def lex_bm25_indexed(spark, d):
    """Keyword retrieval from a stored index, which is built first."""
    path = scratch(spark, "keyword-index")
    index.build(load(spark, d, "documents"), path, norms=False)
    return index.bm25(spark, path, QUERY_WORDS, 20).withColumnRenamed("key", "doc_id")


@query("""
WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z][a-z]{3,}')) AS w FROM documents)
SELECT term, count(*) AS n FROM (SELECT unnest(w) AS term FROM t WHERE list_contains(w, 'that')) WHERE term <> 'that' GROUP BY 1 ORDER BY n DESC, term LIMIT 25""")
def related_by_terms(spark, d):
    """Words that stand in the same documents as a term."""
    w = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z][a-z]{3,})"), F.lit(1)))
    t = load(spark, d, "documents").select(w.alias("w")).filter(F.array_contains("w", "that")).select(F.explode("w").alias("term"))
    return t.filter("term <> 'that'").groupBy("term").agg(n()).orderBy(F.desc("n"), "term").limit(25)


@query("SELECT 'moron' AS term, min(doc_id) AS first_doc FROM documents WHERE contains(lower(text), 'moron') UNION ALL SELECT 'license', min(doc_id) FROM documents WHERE contains(lower(text), 'license') UNION ALL SELECT 'the', min(doc_id) FROM documents WHERE contains(lower(text), 'the')")
def first_mentions(spark, d):
    terms = ["moron", "license", "the"]
    low = F.lower("text")
    row = load(spark, d, "documents").agg(*[F.min(F.when(F.contains(low, F.lit(t)), F.col("doc_id"))).alias(t) for t in terms])
    return row.unpivot([], terms, "term", "first_doc")


@query(f"SELECT host, page_id, row_number() OVER (PARTITION BY host ORDER BY page_id)::INTEGER AS nth, page_id - lag(page_id) OVER (PARTITION BY host ORDER BY page_id) AS gap FROM (SELECT page_id, {_HOST} AS host FROM pages)")
def domain_history(spark, d):
    w = Window.partitionBy("host").orderBy("page_id")
    p = load(spark, d, "pages").select("page_id", U.domain(F.col("url")).alias("host"))
    return p.select("host", "page_id", F.row_number().over(w).alias("nth"), (F.col("page_id") - F.lag("page_id").over(w)).alias("gap"))


# --------------------------------------------------------------------------- passages


@query("SELECT conv_id, turn, s - 1 AS section, length(body) AS chars FROM (SELECT conv_id, turn, p[s] AS body, s FROM (SELECT conv_id, turn, p, unnest(range(1, len(p) + 1)) AS s FROM (SELECT conv_id, turn, list_filter(string_split_regex(coalesce(text, ''), '[.]+'), lambda x: trim(x) <> '') AS p FROM conversations)))")
def section_split(spark, d):
    parts = shaping.sections(load(spark, d, "conversations"), "text", "[.]+")
    return parts.select("conv_id", "turn", F.col("section").cast("long").alias("section"), F.length("body").cast("long").alias("chars"))


@query("""
WITH w AS (SELECT doc_id, string_split_regex(trim(coalesce(text, '')), '[ \t\n\r]+') AS w FROM documents)
SELECT doc_id, k::BIGINT AS chunk, sha256(array_to_string(w[k * 100 + 1 : k * 100 + 120], ' ')) AS body FROM (SELECT doc_id, w, unnest(range(0, (greatest(len(w) - 21, 0) // 100) + 1)) AS k FROM w)""")
def chunk_words(spark, d):
    """Runs of 120 words that share 20 with the next."""
    words = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "^ +| +$", ""), "[ \t\n\r]+")
    parts = load(spark, d, "documents").select("doc_id", F.posexplode_outer(shaping.chunks(words, 120, 20)).alias("chunk", "text")).filter("text is not null")
    return parts.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.sha2("text", 256).alias("body"))


@query("SELECT CASE WHEN a < 1 THEN 'today' WHEN a < 7 THEN 'this week' WHEN a < 31 THEN 'this month' WHEN a < 365 THEN 'this year' ELSE 'older' END AS age, count(*) AS n FROM (SELECT datediff('day', o_orderdate::DATE, DATE '1998-08-01') AS a FROM orders) GROUP BY 1")
def age_labels(spark, d):
    return load(spark, d, "orders").groupBy(shaping.age_label(F.datediff(F.lit("1998-08-01").cast("date"), F.to_date("o_orderdate"))).alias("age")).agg(n())


# --------------------------------------------------------------------------- checks


@query("SELECT event_type, count(*) AS n FROM events WHERE ts::DATE <> (ts - INTERVAL 6 HOUR)::DATE GROUP BY 1")
def filed_day_mismatch(spark, d):
    """Events whose day in UTC is not the day six hours west of it."""
    return load(spark, d, "events").filter(F.to_date("ts") != F.to_date(F.expr("ts - interval 6 hour"))).groupBy("event_type").agg(n())


@query("SELECT lang, count(*) FILTER (WHERE length(text) > 4000) AS cut, sum(greatest(length(text) - 4000, 0))::BIGINT AS chars_lost FROM documents GROUP BY lang")
def truncation_census(spark, d):
    size = F.length("text")
    return load(spark, d, "documents").groupBy("lang").agg(F.count_if(size > 4000).alias("cut"), F.sum(F.greatest(size - 4000, F.lit(0))).alias("chars_lost"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_quantity > 49 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')")
def unreviewed_findings(spark, d):
    """Findings that no reviewed row covers."""
    reviewed = load(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return load(spark, d, "lineitem").filter("l_quantity > 49").select("l_orderkey", "l_linenumber").join(reviewed, "l_orderkey", "left_anti")


@query("SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE role = 'user') AS asked, max(length(text)) AS longest, count(*) FILTER (WHERE coalesce(text, '') = '') AS empty FROM conversations GROUP BY 1")
def review_metrics(spark, d):
    size = F.length("text")
    return load(spark, d, "conversations").groupBy("conv_id").agg(n("turns"), F.count_if(F.col("role") == "user").alias("asked"), F.max(size).alias("longest"), F.count_if(F.coalesce("text", F.lit("")) == "").alias("empty"))
