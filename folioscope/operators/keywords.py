"""Keyword search as it is served: a reader's words become phrases and terms, rows that hold a phrase come first.

Modes of a query: ``or`` takes every word; ``nostop`` drops stop words unless nothing would be left; ``phrase`` also takes a
quoted span of two words or more as a phrase; ``adjacent`` also takes the whole of an unquoted query of two words or more
as one. Terms are those of the index (lower case, without accents where it folds); with stems, a word stands for all terms
of its stem.

Scores are BM25 as a full-text table reckons it: a term's weight is ln((N - n + 0.5) / (n + 0.5)), 1e-6 if that isn't positive; a
phrase counts as one term. A row with a phrase has ``LIFT`` more. Numbers of rows are those of the whole index, whatever
kind is asked for.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import index, stems

LIFT, MODES = 1000, ("or", "nostop", "phrase", "adjacent")
_QUOTED = re.compile(r'["“”]([^"“”]+)["“”]')


class KeywordQuery(NamedTuple):
    terms: list[str]
    phrases: list[list[str]]


def _words(text: str, fold: bool) -> list[str]:
    found = regex.findall(r"[\p{L}\p{N}]+", text.lower())
    return list(map(index.folded, found)) if fold else found


def parse(text: str | None, mode: str = "adjacent", fold: bool = False) -> KeywordQuery:
    """The terms and phrases of a reader's words; nothing in them is a sign of a query language."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    text = text or ""
    terms = _words(text, fold)
    spans = [_words(m[1], fold) for m in _QUOTED.finditer(text)] if mode in ("phrase", "adjacent") else []
    phrases = [s for s in spans if len(s) > 1]
    if mode == "adjacent" and not phrases and len(terms) > 1:
        phrases = [terms]
    if mode != "or":
        terms = [t for t in terms if t not in stems.STOP_WORDS] or terms
    return KeywordQuery(list(dict.fromkeys(terms)), phrases)


def _forms(spark: SparkSession, path: str, units: list[str]) -> dict[str, list[str]]:
    """The terms of the index that each stem stands for: endings that the stemmer takes off are few, so these are few."""
    rows = index.terms(spark, path).filter(F.col("stem").isin(units)).select("stem", "term").collect()
    found: dict[str, list[str]] = {u: [] for u in units}
    for r in rows:
        found[r.stem].append(r.term)
    return found


def _weight(n: Column, df: Column) -> Column:
    weight = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(weight > 0, weight).otherwise(1e-6)


def search(spark: SparkSession, path: str, query: KeywordQuery, k: int | None = 20, kind: str | None = None, stemmed: bool = False, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of the k best rows, ties to the smaller key. Only the folders of the query's terms are read."""
    unit = stems.stem if stemmed else str
    terms, phrases = list(dict.fromkeys(map(unit, query.terms))), [list(map(unit, p)) for p in query.phrases]
    units = sorted({*terms, *(u for p in phrases for u in p)})
    forms = _forms(spark, path, units) if stemmed else {u: [u] for u in units}
    of_term = {t: u for u, held in forms.items() for t in held}
    held = index.postings(spark, path, sorted(of_term), places=bool(phrases))
    named = F.coalesce(F.create_map(*[F.lit(x) for pair in sorted(of_term.items()) for x in pair])[F.col("term")], F.col("term")) if of_term else F.col("term")
    in_phrase = sorted({u for p in phrases for u in p})
    places = [F.array_sort(F.flatten(F.collect_list(F.when(F.col("unit") == u, F.col("positions"))))).alias(f"at{j}") for j, u in enumerate(in_phrase)]
    counts = [F.sum(F.when(F.col("unit") == u, F.col("tf")).otherwise(0)).alias(f"tf{j}") for j, u in enumerate(terms)]
    rows = held.withColumn("unit", named).groupBy("key", "kind").agg(F.first("len").alias("len"), *counts, *places)
    said = [F.size(index._together(p, lambda u: F.col(f"at{in_phrase.index(u)}"))) for p in phrases]
    rows = rows.select("key", "kind", "len", *(f"tf{j}" for j in range(len(terms))), *(s.alias(f"said{j}") for j, s in enumerate(said)))
    parts = [f"tf{j}" for j in range(len(terms))] + [f"said{j}" for j in range(len(said))]
    stats = spark.read.parquet(f"{path}/stats")
    totals = rows.agg(*[F.count_if(F.col(p) > 0).alias(f"df_{p}") for p in parts]) if parts else spark.range(1)
    rows = rows.crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(totals))  # one row each

    def score(names: list[str]) -> Column:
        out = F.lit(0.0)
        for p in names:
            tf = F.col(p)
            out = out + _weight(F.col("n"), F.col(f"df_{p}")) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("mean")))
        return out

    lifted = [p for p in parts if p.startswith("said")]
    has = F.greatest(*(F.col(p) for p in [*lifted, *lifted][: max(2, len(lifted))])) > 0 if lifted else F.lit(False)
    plain = [p for p in parts if not p.startswith("said")]
    held_any = F.lit(False)
    for p in parts:
        held_any = held_any | (F.col(p) > 0)
    scored = rows.filter(held_any if kind is None else held_any & (F.col("kind") == kind))
    scored = scored.select("key", F.round(F.when(has, LIFT + score(lifted)).otherwise(score(plain)), 6).alias("score"))
    return scored if k is None else scored.orderBy(F.desc("score"), "key").limit(k)
