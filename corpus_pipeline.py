"""A training-data pipeline over documents: five operators of folioscope.llm, one after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet and read again as the
next stage's docs. All stages but the last return the columns that they got, whatever their names. An empty table passes
through all stages; null texts are rejected by the first, a null doc_id or source is not.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.llm import bpe, langid, mixing, neardup, toxicity
from folioscope.llm.common import col, free_names, is_scan, stored, table

#: A document stays if its language's pooled probability is at least so much. Of held-out documents at sf0.1, 99.95 % score above 0.51.
LEAST_LANGUAGE = 0.3
#: A document goes from this toxicity score on.
TOXIC = 0.7


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: texts without letters go."""
    return langid.keep(docs, langid.fit(docs, learn=langid.learn_fold()), LEAST_LANGUAGE)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier lets pass."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn=toxicity.learn_fold())
    return toxicity.keep(docs, model, TOXIC)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return neardup.deduplicated(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order that interleaves the sources by their target weights. The order of rows in the files
    that are written of it is this stage's decision: the next stage reads it from there."""
    return mixing.mixed_rows(docs)


def row_places(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and others) with row_place, the number of rows that stand before in its files, from 0. The files
    of a written DataFrame are named in the order of its partitions; docs that is no plain read of files is written first."""
    if not is_scan(docs) or not docs.inputFiles():
        docs = stored(docs, "places-input")
    free = free_names([*docs.columns, "row_place"])
    file, index, before = free("file"), free("index"), free("before")
    meta = F.col("_metadata")
    rows = docs.select("*", meta["file_path"].alias(file), meta["row_index"].alias(index))
    # one row for each file, so that one task can add them up
    files = rows.groupBy(file).agg((F.max(index) + 1).alias(before))
    above = F.sum(before).over(Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1))
    files = files.select(file, F.coalesce(above, F.lit(0)).alias(before))
    return rows.join(files, file).select(*(col(c) for c in docs.columns), (F.col(before) + F.col(index)).alias("row_place"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of each document, with its place in the order of the mix, which
    is where its row stands in the files of the stage before.

    Both sides are narrow: digests and places meet by doc_id and the text's digest, and rows that share both are
    interchangeable and numbered, so that documents of the same or of no doc_id keep a place each."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = bpe.digests(bpe.encode(docs, ranks), ranks)
    text = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)
    narrow = row_places(docs.select("doc_id", "text"))
    places = narrow.select(F.col("row_place").alias("mix_place"), F.col("doc_id").cast("long").alias("place_of"), text.alias("text_sha256"))
    same = lambda doc, text, order: F.row_number().over(Window.partitionBy(doc, text).orderBy(order))
    found = found.withColumn("copy", same("doc_id", "decoded_sha256", "n_tokens"))
    places = places.withColumn("nth", same("place_of", "text_sha256", "mix_place"))
    met = found.join(places, found.doc_id.eqNullSafe(places.place_of) & (found.decoded_sha256 == places.text_sha256) & (found.copy == places.nth))
    return met.select("doc_id", "mix_place", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("language", language), ("toxicity", clean), ("near duplicates", distinct), ("mixing", mixed), ("tokens", tokens)]

#: Trained models and minima of hashes have no SQL; tests compare the stages with their operators, which have brute-force tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
