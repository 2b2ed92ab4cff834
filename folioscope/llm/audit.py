"""Operator 13: how filters interact, by inclusion-exclusion over their joint failures.

1. Each document gets a failure flag of each filter (DataFrame functions only) and the digest of its text. Rows that agree
   in doc_id, digest and part are counted together; the copy filter asks for rows that bear the smallest doc_id of their
   text, so that its join is keyed by text and doc_id and no text's copies meet in one task.
2. Of each part, one aggregate sums the product of flags over every subset of the filters: N(T), the documents that fail
   all of T, for all documents and for those of each label.
3. Inclusion-exclusion gives v(S), the documents that a set of filters removes: the sum over T in S of -(-1)^|T| N(T). An
   order's steps are differences of v; Möbius inversion over the supersets of one filter gives the documents that fail it
   alone; the Harsanyi dividend of T is -(-1)^|T| N(T), and a filter's Shapley value the sum of d(T) / |T| over T that
   hold it, here times the number of orders, so that it is whole.

Defined results: a null text is empty; a null source is the part ""; a document without labels is of no label, one with
several label rows is of each that any of them gives; rows that repeat doc_id and text are not each other's copies, and
neither are rows of a null doc_id, which never fail the copy filter and are nobody's original; an empty table gives an
empty result; other columns are left alone.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
WORD_GAP = r"[\x20\x09-\x0D]+"


def text_flags(text: Column) -> dict[str, Column]:
    """Failure of the filters that look at one text: few words, repeated words, capitals, markup characters."""
    words = F.array_remove(F.split(text, WORD_GAP), "")
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 5 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A, B, C, D, E, n_all, n_good, n_toxic): numbers of documents of a part with these failure flags, in several
    rows. docs (doc_id, text, source), labels (doc_id, quality, toxic)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    flags = [flag.alias(name) for name, flag in text_flags(F.col("text")).items()]
    rows = rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), *flags)
    rows = rows.groupBy("doc_id", "digest", "part", *"ABCD").agg(F.count(F.lit(1)).alias("n_all"))
    originals = rows.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("original", F.lit(True))
    rows = rows.join(originals, ["doc_id", "digest"], "left")
    rows = rows.withColumn("E", F.col("original").isNull() & F.col("doc_id").isNotNull())
    of_label = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = rows.join(of_label.filter("doc_id is not null"), "doc_id", "left")
    counted = [F.when(F.col(c), F.col("n_all")).otherwise(0).cast("long").alias(f"n_{c}") for c in ("good", "toxic")]
    return rows.select("part", *(F.col(f).cast("int").alias(f) for f in FILTERS), "n_all", *counted)


def joint_failures(flags: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, n_all, n_good, n_toxic): arrays over the subsets of the filters, numbered by bits, of the documents that
    fail every filter of the subset; the empty subset holds all documents."""
    subsets = [[f for k, f in enumerate(filters) if s >> k & 1] for s in range(1 << len(filters))]

    def product(subset: list[str], n: str) -> Column:
        out = F.col(n)
        for f in subset:
            out = out * F.col(f)
        return out

    measures = ("n_all", "n_good", "n_toxic")
    sums = [F.sum(product(s, n)).alias(f"{n}_{k}") for n in measures for k, s in enumerate(subsets)]
    arrays = [F.array(*(F.col(f"{n}_{k}") for k in range(len(subsets)))).alias(n) for n in measures]
    return flags.groupBy("part").agg(*sums).select("part", *arrays)


def _removed(n: str, count: int) -> Column:
    """Array over the subsets of the filters: the documents that any filter of the subset removes."""
    return F.expr(f"""transform(sequence(0, {count - 1}), s -> aggregate(sequence(0, s), 0L,
        (sum, t) -> sum + IF(t > 0 AND (t & s) = t, IF(bit_count(t) % 2 = 1, {n}[t], -{n}[t]), 0L)))""")


def interactions(joint: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, order of the filters and step, from the arrays of joint_failures."""
    size, orders = 1 << len(filters), factorial(len(filters))
    v = joint.withColumns({f"v_{n}": _removed(f"n_{n}", size) for n in ("all", "good", "toxic")})
    # per filter: failures of it alone by inversion over its supersets; its dividends, shared equally
    alone = f"""transform(sequence(0, {len(filters) - 1}), k -> aggregate(sequence(0, {size - 1}), 0L,
        (sum, t) -> sum + IF(getbit(t, k) = 1, IF(bit_count(t) % 2 = 1, n_all[t], -n_all[t]), 0L)))"""
    shares = f"""transform(sequence(0, {len(filters) - 1}), k -> aggregate(sequence(0, {size - 1}), 0L,
        (sum, t) -> sum + IF(getbit(t, k) = 1, IF(bit_count(t) % 2 = 1, 1, -1) * n_all[t] * ({orders} div bit_count(t)), 0L)))"""
    v = v.withColumns({"alone": F.expr(alone), "shares": F.expr(shares)})
    steps = []
    for order in permutations(filters):
        before = 0
        for step, f in enumerate(order, 1):
            k = filters.index(f)
            steps.append(f"('{''.join(order)}', {step}, {k}, {before})")
            before |= 1 << k
    every = F.expr(f"inline(transform(array({', '.join(steps)}), x -> struct(x.col1 AS filter_order, x.col2 AS step, x.col3 AS k, x.col4 AS before)))")
    rows = v.select("*", every).withColumn("after", F.expr("before | shiftleft(1, k)"))
    removed = lambda n: F.expr(f"v_{n}[after] - v_{n}[before]")
    out = rows.select("*", F.expr("n_all[0] - v_all[after]").alias("kept"), removed("all").alias("removed"), removed("good").alias("good_lost"), removed("toxic").alias("toxic_lost"), F.expr("alone[k]").alias("unique_fails"), F.expr("shares[k]").alias("shapley"), F.expr("n_all[shiftleft(1, k)]").alias("fails"))
    return out.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters over docs: one row for each part, order and step."""
    return interactions(joint_failures(flagged(docs, labels)))


#: Each document against each order and step, without subsets: what the operator's sums must come to.
ORACLE = r"""
WITH label AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
flags AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(words) < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS fails
    FROM texts LEFT JOIN label USING (doc_id)),
counted AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY part, fails),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(f, bit)),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (SELECT filter_order, step, f.bit, coalesce((SELECT sum(g.bit) FROM f g WHERE strpos(substr(filter_order, 1, step - 1), g.f) > 0), 0) AS before
    FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step) s JOIN f ON f.f = substr(filter_order, step, 1)),
done AS (SELECT part, filter_order, step, bit,
    sum(CASE WHEN fails & (before::BIGINT | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN fails & bit > 0 AND fails & before::BIGINT = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails & bit > 0 AND fails & before::BIGINT > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails & bit > 0 AND fails & before::BIGINT = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN fails & bit > 0 AND fails & before::BIGINT = 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM counted, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
    unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
    (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM done
"""
