"""Many searches at once, and how well they find what they should."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions import text as T
from folioscope.operators import index
from folioscope.sources.tables import kept

#: Pairs of a query's term and a row that are reckoned at once.
AT_ONCE = 2_000_000
#: Hits of a page that meet one another at a time.
HEAD = 50


def _rounded(scores: np.ndarray) -> np.ndarray:
    """To six digits as F.round does it: halves of the number as it is written go up."""
    out = np.floor(scores * 1e6 + 0.5) / 1e6
    for j in np.flatnonzero(np.abs(scores * 1e6 % 1 - 0.5) < 1e-3).tolist():
        out[j] = float(Decimal(repr(float(scores[j]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out


def _best_of_blocks(batches: Iterator[pa.RecordBatch], k: int, mean: float, k1: float, b: float) -> Iterator[pa.RecordBatch]:
    """Each block's k best rows for each query: (id, key, score). met: the queries that ask for a term, and its weight."""
    for met, keys, _, lens, row, held, tf in index.blocks_of(batches):
        asks, weight = met.field("ids"), met.field("weight").to_numpy(zero_copy_only=False)
        coded = asks.flatten().dictionary_encode()
        query, n = coded.indices.to_numpy().astype(np.int64), len(keys)
        part = np.repeat(weight, held) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lens.to_numpy(zero_copy_only=False)[row] / mean))
        term = np.repeat(np.arange(len(held)), np.diff(asks.offsets.to_numpy()))
        rank = np.empty(n, np.int64)
        rank[pc.sort_indices(keys).to_numpy()] = np.arange(n)
        order = np.argsort(query, kind="stable")
        query, term = query[order], term[order]
        starts, upto = np.flatnonzero(np.diff(query, prepend=-1)), np.cumsum(held[term])
        first = np.cumsum(held) - held
        while len(starts):  # whole queries, as many as fit
            a = int(starts[0])
            ends = upto[np.append(starts[1:], len(query)) - 1]
            taken = max(1, int(np.searchsorted(ends, (upto[a - 1] if a else 0) + AT_ONCE, "right")))
            z = int(starts[taken]) if taken < len(starts) else len(query)
            at = index._expand(first[term[a:z]], held[term[a:z]])
            code, pair = np.unique(np.repeat(query[a:z], held[term[a:z]]) * n + row[at], return_inverse=True)
            score, asker, of = _rounded(np.bincount(pair, part[at], len(code))), code // n, code % n
            order = np.lexsort((rank[of], -score, asker))
            asker, of, score = asker[order], of[order], score[order]
            begins = np.flatnonzero(np.diff(asker, prepend=-1))
            few = np.arange(len(asker)) - np.repeat(begins, np.diff(np.append(begins, len(asker)))) < k
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(asker[few])), keys.take(pa.array(of[few])), pa.array(score[few], pa.float64())], ["id", "key", "score"])
            starts = starts[taken:]


def batch_bm25(spark: SparkSession, path: str, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, place, key, score): the k best rows of the index for each of many queries (id, terms array<string>; distinct ids),
    by BM25, ties to the smaller key. Postings meet the queries by folder and term, so that only the folders of their terms
    are read, and then one another by block: a block's rows are scored where they meet, so that only its best ones for
    each query move. Null terms find nothing."""
    stats = spark.read.parquet(f"{path}/stats").first()
    words = queries.select("id", F.explode(F.array_distinct("terms")).alias("term")).filter("term is not null")
    asked = words.groupBy("term").agg(F.collect_list("id").alias("ids")).join(index.terms(spark, path).select("term", "df"), "term")
    asked = asked.select("term", "ids", F.log(1 + (stats.n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("weight"), index._bucket(F.col("term"), stats.folders).alias("bucket"))
    met = index.by_block(spark, path, index.asked_rows(spark, path, asked), ["ids", "weight", "rows", "tfs"])
    kinds = f"id {queries.schema['id'].dataType.simpleString()}, key {index.key_kind(spark, path)}, score double"
    few = met.mapInArrow(lambda it, mean=stats.mean: _best_of_blocks(it, k, mean, k1, b), kinds)
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "key"))
    return few.withColumn("place", place).filter(F.col("place") <= k).select("id", "place", "key", "score")


def holders(spark: SparkSession, path: str, items: DataFrame, docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(id, key): the rows of docs whose text holds an item's text as it is. items (id, text, terms: its words in order). A row
    that holds the text holds each of its inner words, so that only the rows with its rarest one are looked at; an item of
    fewer than three words meets all rows with its rarest word, whole words only."""
    inner = F.when(F.size("terms") > 2, F.slice("terms", F.lit(2), F.size("terms") - 2)).otherwise(F.col("terms"))
    words = items.select("id", F.explode(F.array_distinct(inner)).alias("term")).join(index.terms(spark, path).select("term", "df"), "term")
    rarest = words.groupBy("id").agg(F.min(F.struct("df", "term")).alias("rarest")).select("id", "rarest.term")
    folders = spark.read.parquet(f"{path}/stats").first().folders
    asked = rarest.withColumn("bucket", index._bucket(F.col("term"), folders))
    found = index.all_postings(spark, path, asked).select("id", "key")
    whole = found.join(items.select("id", F.col("text").alias("said")), "id").join(docs.select(F.col(key).alias("key"), F.col(text).alias("body")), "key")
    return whole.filter(F.contains("body", "said")).select("id", "key")


def retrieval_metrics(found: DataFrame, truths: DataFrame, by: list[str], at: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """Of the pairs that should be found (truths: id, key and the columns ``by``) against what was (found: id, key, place): for
    each value of ``by``, for each prefix of them and for all, their number, the mean reciprocal of the place (none: 0)
    and the share found among the first 1, 5, 10, 20."""
    placed = truths.join(found.select("id", "key", "place"), ["id", "key"], "left")
    within: list[Column] = [F.round(F.avg(F.coalesce((F.col("place") <= k).cast("double"), F.lit(0.0))), 6).alias(f"recall_{k}") for k in at]
    reciprocal = F.round(F.avg(F.coalesce(1 / F.col("place"), F.lit(0.0))), 6).alias("mrr")
    return placed.rollup(*by).agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("pairs"), reciprocal, *within)


def _repeats(each: DataFrame, above: list, keys: list, share: float) -> set[tuple]:
    """Pairs (key, above) of these keys: at least the share of key's runs stands in above. each: (key, n, gram), n runs of key."""
    spark, kind = each.sparkSession, each.schema["key"].dataType.simpleString()
    table = lambda rows: F.broadcast(spark.createDataFrame([(x,) for x in rows], f"key {kind}"))
    upper = each.join(table(above), "key", "left_semi").select(F.col("key").alias("above"), "gram")
    lower = each.join(table(keys), "key", "left_semi")
    shared = lower.join(upper, "gram").filter("key <> above").groupBy("key", "above").agg(F.count(F.lit(1)).alias("both"), F.first("n").alias("n"))
    return {(r.key, r.above) for r in shared.filter(F.col("both") >= share * F.col("n")).select("key", "above").collect()}


def page_without_copied(hits: DataFrame, docs: DataFrame, k: int, tokens: Callable[[Column], Column] = T.words, run: int = 5, share: float = 0.5, pool: int = 50) -> DataFrame:
    """(place, key, score): the first k hits (key, score; ties to the smaller key) that don't repeat what stands above them: a hit
    goes if at least the share of its distinct runs of ``run`` words stands in one that was kept. docs: (key, text), keys
    distinct.

    Pools of hits are looked at, best first, each twice as large as the one before, until the page is full; only a pool's
    texts and the page's are read. Of a pool, the hits with the words of one above go, as whatever that one repeats they
    repeat too, and those that repeat the page. Then the first ``HEAD`` that are left
    meet one another, so that the page grows by one at least, and the others meet those that were taken. So a hit meets
    the page and a head, never its copies in the pool: rows and what the driver sees grow with the hits looked at."""
    spark = hits.sparkSession
    hits = kept(hits.select("key", "score"), "page-hits")
    kind = hits.schema["key"].dataType.simpleString()
    starts = F.when(F.size("words") >= run, F.sequence(F.lit(1), F.size("words") - run + 1))
    grams = F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice("words", i, F.lit(run)), " ")))
    page: list[tuple] = []
    left = hits
    while True:
        top = [tuple(r) for r in left.orderBy(F.desc("score"), "key").limit(pool).collect()]
        read = spark.createDataFrame([(r[0],) for r in page + top], f"key {kind}")
        texts = docs.join(F.broadcast(read), "key", "left_semi").select("key", tokens(F.col("text")).alias("words"))
        # explode would put a filter on the runs below the scan of the words, where each run splits its text again
        said = F.sha2(F.array_join("words", " "), 256).alias("said")
        each = texts.select("key", said, grams.alias("grams")).select("key", "said", F.size("grams").alias("n"), F.explode_outer("grams").alias("gram"))
        each = kept(each.filter("gram is not null"), "page-runs")
        says, first = dict(each.select("key", "said").distinct().collect()), {}
        for key, _ in page + top:
            first.setdefault(says.get(key, (key,)), key)  # a text without runs repeats nothing
        firsts = set(first.values())
        rest, taken = [r for r in top if r[0] in firsts], [key for key, _ in page]
        while rest and len(page) < k:
            if taken:
                gone = {key for key, _ in _repeats(each, taken, [key for key, _ in rest], share)}
                rest, taken = [r for r in rest if r[0] not in gone], []
            head, rest = rest[:HEAD], rest[HEAD:]
            heads = [key for key, _ in head]
            repeats = _repeats(each, heads, heads, share) if head else set()
            for key, score in head:
                if len(page) < k and not any((key, other) in repeats for other in taken):
                    page.append((key, score))
                    taken.append(key)
        if len(page) == k or len(top) < pool:
            return spark.createDataFrame([(j + 1, *row) for j, row in enumerate(page)], f"place int, key {kind}, score double")
        last, score = top[-1]
        below = F.col("score").isNull() | (F.col("score") < F.lit(score)) if score is not None else F.lit(False)
        later = F.col("key") > F.lit(last).cast(kind) if last is not None else F.col("key").isNotNull()
        left = hits.filter(below | (F.col("score").eqNullSafe(F.lit(score)) & later))
        pool *= 2


def term_lens(df: DataFrame, key: str, bucket: str, hit: Column, strict: Column) -> DataFrame:
    """(bucket, considered, matched, strict, first, latest): of each bucket and, with a null bucket and ``level`` 1, of all rows:
    how many rows there are, how many a term or its names hit, how many the term itself, and the smallest and largest key
    of those."""
    rows = df.select(F.col(key).alias("key"), F.col(bucket).alias("bucket"), F.coalesce(hit, F.lit(False)).alias("hit"), F.coalesce(strict, F.lit(False)).alias("own"))
    ends = [f(F.when(F.col("own"), F.col("key"))).alias(name) for f, name in ((F.min, "first"), (F.max, "latest"))]
    return rows.rollup("bucket").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("considered"), F.count_if("hit").alias("matched"), F.count_if("own").alias("strict"), *ends)
