"""Keyword retrieval: postings, TF-IDF and BM25 top-k, rank fusion.

Only postings of the query's terms leave the scan; corpus statistics (sizes, document frequencies) are aggregates over
all documents with map-side combination.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions import text as T

RRF_K = 60


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, tf)."""
    return docs.select(key, F.explode(T.tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def _counted(docs: DataFrame, terms: list[str], key: str, text: str, tokenizer) -> DataFrame:
    toks = docs.select(key, tokenizer(F.col(text)).alias("toks"))
    counts = [F.size(F.filter("toks", _is(t))).alias(f"tf{k}") for k, t in enumerate(terms)]
    return toks.select(key, F.size("toks").alias("len"), *counts)


def _is(term: str):
    return lambda x: x == term


def tfidf_topk(docs: DataFrame, query: list[str], k: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score): sum over query terms of tf-idf weights over the L2 norm of the document's weights."""
    post = postings(docs, key, text)
    n = docs.count()
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighted = post.join(df, "term").withColumn("w", (1 + F.log("tf")) * F.log(1 + F.lit(n) / (1 + F.col("df"))))
    hit = F.when(F.col("term").isin(query), F.col("w"))
    scored = weighted.groupBy(key).agg(F.sum(hit).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")).filter("dot > 0")
    return scored.select(key, F.round(F.col("dot") / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def bm25_topk(docs: DataFrame, query: list[str], k: int | None = 20, k1: float = 1.2, b: float = 0.75, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) by Okapi BM25; one pass for the statistics, one for the scores, no shuffle of postings. k None: all
    rows with a score, in no order."""
    counted = _counted(docs, query, key, text, T.words)
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"), *[F.sum((F.col(f"tf{j}") > 0).cast("long")).alias(f"df{j}") for j in range(len(query))])
    joined = counted.crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for j in range(len(query)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{j}") + 0.5) / (F.col(f"df{j}") + 0.5))
        tf = F.col(f"tf{j}")
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    scored = joined.select(key, F.round(score, 6).alias("score")).filter("score > 0")
    return scored if k is None else scored.orderBy(F.desc("score"), key).limit(k)


def fuse(lists: dict[str, DataFrame], key: str, k: int) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (key, score), each of bounded size: (key, score, modes)."""
    ranked = None
    for mode, one in lists.items():
        # a list is a top-k: one small partition
        part = one.select(key, F.row_number().over(Window.orderBy(F.desc("score"), key)).alias("rank"), F.lit(mode).alias("mode"))
        ranked = part if ranked is None else ranked.unionByName(part)
    fused = ranked.groupBy(key).agg(F.round(F.sum(1 / (RRF_K + F.col("rank"))), 9).alias("score"), F.array_join(F.array_sort(F.collect_set("mode")), "+").alias("modes"))
    return fused.orderBy(F.desc("score"), key).limit(k)


def cosine_topk(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", keep=None) -> DataFrame:
    """(key, score): exact cosine in double, filters before the top-k."""
    rows = vectors if keep is None else vectors.filter(keep)
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with("embedding", q, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    own = float(sum(x * x for x in query)) ** 0.5
    scored = rows.filter(F.size("embedding") == len(query)).select(key, F.round(F.coalesce(F.try_divide(dot, norm * F.lit(own)), F.lit(0.0)), 6).alias("score"))
    return scored.filter("score > 0").orderBy(F.desc("score"), key).limit(k)
