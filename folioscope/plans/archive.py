"""Further registered queries: lenses, temporal joins, sets, evaluation, extraction and checks of an archive."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions import text as T
from folioscope.plans.catalogue import ORACLE_SQL, QUERIES, n, query
from folioscope.sources.tables import load

__all__ = ["ORACLE_SQL", "QUERIES"]

# --------------------------------------------------------------------------- lenses over dated records

_LENS = "FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'"


def _lens(spark, d):
    c = load(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    return load(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi")


@query(f"SELECT o_orderpriority, min(o_orderdate) AS first_at, max(o_orderdate) AS latest_at, count(*) AS n {_LENS} GROUP BY 1")
def lens_first_latest(spark, d):
    return _lens(spark, d).groupBy("o_orderpriority").agg(F.min("o_orderdate").alias("first_at"), F.max("o_orderdate").alias("latest_at"), n())


@query(f"SELECT year(o_orderdate)::INTEGER AS y, count(*) AS n, count(DISTINCT o_custkey) AS sources, min(o_orderkey) AS sample {_LENS} GROUP BY 1")
def lens_by_year(spark, d):
    return _lens(spark, d).groupBy(F.year("o_orderdate").alias("y")).agg(n(), F.count_distinct("o_custkey").alias("sources"), F.min("o_orderkey").alias("sample"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1998-02-15' AND (o_orderdate, o_orderkey) < (TIMESTAMP '1998-02-10', 1000) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def keyset_page(spark, d):
    """A page after a cursor: newest first in a window of 45 days, the cursor being the last sort key."""
    at = F.col("o_orderdate")
    cursor = F.lit("1998-02-10").cast("timestamp")
    after = (at < cursor) | ((at == cursor) & (F.col("o_orderkey") < 1000))
    window = (at >= F.lit("1998-01-01").cast("timestamp")) & (at < F.lit("1998-02-15").cast("timestamp"))
    return load(spark, d, "orders").filter(window & after).select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(20)


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS c FROM orders)
SELECT o_custkey, o_orderkey FROM r WHERE c <= 3 OR i = 0 OR i = c - 1 OR i = floor((c - 1) / 2.0 + 0.5)""")
def even_spread_sample(spark, d):
    """Three of each customer's orders, spread over the span: the first, the middle and the last."""
    w = Window.partitionBy("o_custkey")
    r = load(spark, d, "orders").select("o_custkey", "o_orderkey", (F.row_number().over(w.orderBy("o_orderdate", "o_orderkey")) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("c"))
    return r.filter("c <= 3 or i = 0 or i = c - 1 or i = floor((c - 1) / 2.0 + 0.5)").select("o_custkey", "o_orderkey")


@query("SELECT event_id, ts FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 3 DAY")
def retention_window(spark, d):
    e = load(spark, d, "events").select("event_id", "ts")
    return e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("newest")))).filter("ts > newest - interval 3 day").select("event_id", "ts")


# --------------------------------------------------------------------------- temporal joins and sets


@query("""
WITH s AS (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'signup'), j AS (SELECT p.event_id, s.ts AS near, abs(epoch_us(s.ts) - epoch_us(p.ts)) AS away FROM events p JOIN s USING (user_id) WHERE p.event_type = 'purchase')
SELECT event_id, near FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY away, near) AS k FROM j) WHERE k = 1""")
def nearest_in_time(spark, d):
    """The sign-up nearest to each purchase, before or after it, by two windows instead of a pair per combination."""
    e = load(spark, d, "events").select("event_id", "user_id", "ts", "event_type").filter("event_type in ('signup', 'purchase')")
    w = Window.partitionBy("user_id").orderBy("ts")
    signup = F.when(F.col("event_type") == "signup", F.col("ts"))
    e = e.withColumn("before", F.max(signup).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("after", F.min(signup).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing)))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    nearer = F.when(F.col("before").isNull() | (us("after") - us("ts") < us("ts") - us("before")), F.col("after")).otherwise(F.col("before"))
    return e.filter("event_type = 'purchase'").select("event_id", nearer.alias("near")).filter("near is not null")


@query("""
WITH l AS (SELECT user_id, max(ts) FILTER (WHERE event_type = 'signup') AS last_signup, max(ts) FILTER (WHERE event_type = 'purchase') AS last_purchase FROM events GROUP BY 1)
SELECT user_id, last_signup FROM l WHERE last_signup IS NOT NULL AND (last_purchase IS NULL OR last_purchase <= last_signup)""")
def temporal_anti_join(spark, d):
    """Users whose last sign-up no purchase follows: one aggregation, no self-join."""
    at = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("ts")))
    last = load(spark, d, "events").groupBy("user_id").agg(at("signup").alias("last_signup"), at("purchase").alias("last_purchase"))
    return last.filter("last_signup is not null and (last_purchase is null or last_purchase <= last_signup)").select("user_id", "last_signup")


@query("""
WITH s AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority) FILTER (WHERE year(o_orderdate) <= 1997)) AS a, list_sort(list(DISTINCT o_orderpriority) FILTER (WHERE year(o_orderdate) > 1997)) AS b FROM orders GROUP BY 1)
SELECT o_custkey, array_to_string(coalesce(a, []), ',') AS filed, array_to_string(coalesce(b, []), ',') AS live FROM s WHERE coalesce(a, []) <> coalesce(b, [])""")
def category_drift(spark, d):
    """Customers whose set of priorities differs between two snapshots, whatever its order."""
    early = F.year("o_orderdate") <= 1997
    sets = load(spark, d, "orders").groupBy("o_custkey").agg(*[F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("o_orderpriority")))), ",").alias(k) for k, c in (("filed", early), ("live", ~early))])
    return sets.filter("filed <> live")


@query("""
WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1)
SELECT event_type, count(*) AS users, min(user_id) AS first_user FROM l GROUP BY 1 HAVING count(*) >= 3""")
def latest_state_groups(spark, d):
    """Users by the kind of their latest event, groups of three and more."""
    last = load(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))
    return last.groupBy("event_type").agg(n("users"), F.min("user_id").alias("first_user")).filter("users >= 3")


@query("SELECT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW'")
def set_intersect(spark, d):
    o = load(spark, d, "orders")
    return o.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k")).intersect(o.filter("o_orderpriority = '5-LOW'").select("o_custkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT s_suppkey FROM supplier")
def set_except_union(spark, d):
    urgent = load(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select("o_custkey")
    return load(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(urgent).union(load(spark, d, "supplier").select("s_suppkey")).distinct()


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) <> 1998 UNION ALL SELECT o_orderkey, o_totalprice + 1 FROM orders WHERE year(o_orderdate) = 1998 AND o_orderstatus = 'O'")
def replace_range(spark, d):
    """A year's rows are replaced by its re-read rows; all other years stay."""
    o, y = load(spark, d, "orders"), F.year("o_orderdate")
    again = o.filter((y == 1998) & (F.col("o_orderstatus") == "O")).withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return o.filter(y != 1998).unionByName(again).select("o_orderkey", "o_totalprice")


@query("""
WITH c AS (SELECT o_orderstatus, count(*) AS total FROM orders GROUP BY 1), b AS (SELECT o_orderstatus, year(o_orderdate) AS y, count(*) AS k FROM orders GROUP BY 1, 2), s AS (SELECT o_orderstatus, sum(k)::BIGINT AS summed FROM b GROUP BY 1)
SELECT o_orderstatus, total, summed, total = summed AS conserved FROM c JOIN s USING (o_orderstatus)""")
def count_conservation(spark, d):
    """Buckets sum to the total."""
    o = load(spark, d, "orders")
    summed = o.groupBy("o_orderstatus", F.year("o_orderdate").alias("y")).agg(n("k")).groupBy("o_orderstatus").agg(F.sum("k").alias("summed"))
    return o.groupBy("o_orderstatus").agg(n("total")).join(summed, "o_orderstatus").withColumn("conserved", F.col("total") == F.col("summed"))


@query("""
WITH a AS (SELECT o_orderpriority, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS newest FROM orders GROUP BY 1), b AS (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01')
SELECT o_orderpriority, newest FROM a WHERE newest NOT IN (SELECT o_orderkey FROM b)""")
def newest_arrivals(spark, d):
    """The newest record of each kind, if the previous snapshot did not have it."""
    o = load(spark, d, "orders")
    newest = o.groupBy("o_orderpriority").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("newest"))
    before = o.filter(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")).select("o_orderkey")
    return newest.join(before, F.col("newest") == F.col("o_orderkey"), "left_anti")


@query("SELECT conv_id, string_agg(turn::VARCHAR, '>' ORDER BY turn) AS chain, count(*) AS n FROM conversations GROUP BY 1")
def turn_chain(spark, d):
    """Each conversation's turns from its root; a turn's parent is the one before it."""
    turns = F.transform(F.array_sort(F.collect_list("turn")), lambda t: t.cast("string"))
    return load(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(turns, ">").alias("chain"), n())


# --------------------------------------------------------------------------- vectors

_CENTROIDS = """
WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label AS c, i, avg(v) AS w FROM x GROUP BY 1, 2),
s AS (SELECT vec_id, label, c, sum(v * w) / (sqrt(sum(v * v)) * sqrt(sum(w * w))) AS cos FROM x JOIN m USING (i) GROUP BY 1, 2, 3),
r AS (SELECT label, c, row_number() OVER (PARTITION BY vec_id ORDER BY cos DESC, c) AS rank FROM s)"""


@query(f"""{_CENTROIDS}
SELECT label, count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5, round(avg(1.0 / rank), 6) AS mrr
FROM r WHERE c = label GROUP BY GROUPING SETS ((label), ())""")
def eval_mrr_recall(spark, d):
    """Where each vector's own label stands among all label centroids: recall and reciprocal rank by label and over all.

    Centroids are as many as labels; vectors are compared with them by a map over rows, without a shuffle of vectors.
    """
    e = load(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    m = e.select("label", F.posexplode("v")).groupBy("label", "pos").agg(F.avg("col").alias("w"))
    m = m.groupBy(F.col("label").alias("c")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda s: s["w"]).alias("w"))
    everyone = m.agg(F.collect_list(F.struct("c", "w")).alias("centroids"))
    cos = lambda s: dot(F.col("v"), s["w"]) / (F.sqrt(dot(F.col("v"), F.col("v"))) * F.sqrt(dot(s["w"], s["w"])))
    scored = e.crossJoin(F.broadcast(everyone)).select("label", F.array_sort(F.transform("centroids", lambda s: F.struct((-cos(s)).alias("k"), s["c"].alias("c")))).alias("s"))
    ranked = scored.select("label", F.array_position(F.transform("s", lambda s: s["c"]), F.col("label")).alias("rank"))
    return ranked.groupingSets([["label"], []], "label").agg(
        n(), *[F.round(F.avg((F.col("rank") <= k).cast("double")), 6).alias(f"recall_{k}") for k in (1, 5)], F.round(F.avg(1.0 / F.col("rank")), 6).alias("mrr")
    )


@query("""
WITH x AS (SELECT vec_id, list_transform(embedding[1:16], lambda v: v::DOUBLE) AS p FROM embeddings), y AS (SELECT vec_id, p, sqrt(list_sum(list_transform(p, lambda v: v * v))) AS norm FROM x)
SELECT vec_id, array_to_string(list_transform(p, lambda v: floor(127 * v / norm)::INTEGER), ',') AS codes FROM y WHERE norm > 0""")
def vector_prefix_int8(spark, d):
    """The first 16 dimensions, normalised anew and stored as 8-bit codes."""
    p = F.slice(F.col("embedding").cast("array<double>"), 1, 16)
    e = load(spark, d, "embeddings").select("vec_id", p.alias("p")).withColumn("norm", F.sqrt(F.aggregate("p", F.lit(0.0), lambda s, v: s + v * v)))
    return e.filter("norm > 0").select("vec_id", F.array_join(F.transform("p", lambda v: F.floor(127 * v / F.col("norm")).cast("string")), ",").alias("codes"))


# --------------------------------------------------------------------------- extraction and text

_NAMES = "[A-Z][a-z]+(?: [A-Z][a-z]+)+"


@query(f"""
WITH t AS (SELECT source, unnest(regexp_extract_all(text, '{_NAMES}')) AS name FROM documents), c AS (SELECT source, name, count(*) AS n FROM t GROUP BY 1, 2)
SELECT source, name, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, name) AS k FROM c) WHERE k <= 40""")
def entity_counts(spark, d):
    """Proper-noun candidates of each source, the forty most frequent."""
    t = load(spark, d, "documents").select("source", F.explode(F.regexp_extract_all("text", F.lit(_NAMES), F.lit(0))).alias("name"))
    w = Window.partitionBy("source").orderBy(F.desc("n"), "name")
    return t.groupBy("source", "name").agg(n()).withColumn("k", F.row_number().over(w)).filter("k <= 40").drop("k")


#: Keywords of each topic.
TOPICS = {"licence": ("license", "mit", "apache"), "abuse": ("moron", "clown", "idiot"), "work": ("work", "time", "people")}
_HITS = ", ".join(f"len(list_filter(w, lambda x: list_contains({list(k)}, x)))::INTEGER AS {t}" for t, k in TOPICS.items())


def _among(words):
    return lambda x: x.isin(*words)


@query(f"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, {_HITS} FROM t),
u AS (UNPIVOT s ON {', '.join(TOPICS)} INTO NAME topic VALUE score)
SELECT doc_id, topic, score FROM u WHERE score >= 2""")
def topic_detection(spark, d):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    t = load(spark, d, "documents").filter("text is not null").select("doc_id", words.alias("w"))
    hits = [F.struct(F.lit(k).alias("topic"), F.size(F.filter("w", _among(v))).alias("score")) for k, v in TOPICS.items()]
    return t.select("doc_id", F.inline(F.array(*hits))).filter("score >= 2")


def _attributes(tag: str, attribute: str) -> str:
    return f'<{tag}[^>]*{attribute}="([^"]*)"'


@query(f"""
WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '{_attributes("a", "href")}', 1)) AS url FROM pages)
SELECT url, count(*) AS n, count(DISTINCT page_id) AS pages, min(page_id) AS first_page FROM t GROUP BY 1""")
def html_links(spark, d):
    t = load(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(_attributes("a", "href")), F.lit(1))).alias("url"))
    return t.groupBy("url").agg(n(), F.count_distinct("page_id").alias("pages"), F.min("page_id").alias("first_page"))


@query(f"""
WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '{_attributes("img", "src")}', 1)) AS src FROM pages)
SELECT src, min(page_id) AS first_page, count(DISTINCT page_id) > 1 AS shared FROM t GROUP BY 1""")
def distinct_images(spark, d):
    """Each image once, where it was first seen and whether several pages show it."""
    t = load(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(_attributes("img", "src")), F.lit(1))).alias("src"))
    return t.groupBy("src").agg(F.min("page_id").alias("first_page"), (F.count_distinct("page_id") > 1).alias("shared"))


@query("SELECT squash, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, md5(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g')) AS squash FROM documents WHERE text IS NOT NULL) GROUP BY 1 HAVING count(*) > 1")
def squash_groups(spark, d):
    """Texts that are the same but for punctuation, spaces and case."""
    key = F.md5(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", "").cast("binary"))
    return load(spark, d, "documents").filter("text is not null").groupBy(key.alias("squash")).agg(n(), F.min("doc_id").alias("first_id")).filter("n > 1")


@query("""
WITH w AS (SELECT conv_id, turn, string_split(lower(coalesce(text, '')), ' ') AS w FROM conversations),
s AS (SELECT conv_id, turn, list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) AS g FROM w),
p AS (SELECT conv_id, turn, g, lag(g) OVER (PARTITION BY conv_id ORDER BY turn) AS h FROM s), c AS (SELECT conv_id, turn, len(list_intersect(g, h)) AS shared, len(g) AS a, len(h) AS b FROM p WHERE h IS NOT NULL)
SELECT conv_id, turn, shared::INTEGER AS shared, shared >= 3 AND (2 * shared >= a OR 2 * shared >= b) AS contained FROM c""")
def shingle_containment(spark, d):
    """Whether a turn repeats the one before it: four-word shingles, three shared and half of either side's."""
    g = F.array_distinct(T.shingles(F.split(F.lower(F.coalesce("text", F.lit(""))), " "), 4))
    s = load(spark, d, "conversations").select("conv_id", "turn", g.alias("g")).withColumn("h", F.lag("g").over(Window.partitionBy("conv_id").orderBy("turn")))
    shared = F.size(F.array_intersect("g", "h"))
    return s.filter("h is not null").select("conv_id", "turn", shared.alias("shared"), ((shared >= 3) & ((2 * shared >= F.size("g")) | (2 * shared >= F.size("h")))).alias("contained"))


@query("SELECT c_custkey, sha256(lower(trim(c_name)) || '@example.com') AS address_hash FROM customer")
def address_hash(spark, d):
    return load(spark, d, "customer").select("c_custkey", F.sha2(F.concat(F.lower(F.trim("c_name")), F.lit("@example.com")), 256).alias("address_hash"))


@query("""
WITH k AS (SELECT p_partkey, -ln(((crc % 1000003) + 1) / 1000004.0) / (1 + sqrt(p_size)) AS k FROM (SELECT p_partkey, p_size, (p_partkey * 7919 + 104729) % 1000003 AS crc FROM part))
SELECT p_partkey FROM k ORDER BY k, p_partkey LIMIT 12""")
def weighted_sample(spark, d):
    """Twelve parts without replacement, weights 1 + sqrt(size): exponential keys from a fixed mixing of the id."""
    u = ((F.col("p_partkey") * 7919 + 104729) % 1000003 + 1) / 1000004.0
    return load(spark, d, "part").select("p_partkey", (-F.log(u) / (1 + F.sqrt("p_size"))).alias("k")).orderBy("k", "p_partkey").limit(12).select("p_partkey")


@query("SELECT c_custkey, c_name FROM customer ORDER BY regexp_extract(c_name, '^[^0-9]*'), regexp_extract(c_name, '[0-9]+')::BIGINT, c_name LIMIT 20")
def natural_order_page(spark, d):
    """Names in natural order: their leading text, then their number as a number."""
    return load(spark, d, "customer").select("c_custkey", "c_name").orderBy(F.regexp_extract("c_name", "^[^0-9]*", 0), F.regexp_extract("c_name", "[0-9]+", 0).try_cast("bigint"), "c_name").limit(20)
