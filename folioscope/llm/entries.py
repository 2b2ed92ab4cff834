"""The subpackage's queries: thin views on the operators, as __spark_entry__ registers them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import audit, bpe, chat, gif, langid, licenses, mixing, neardup, packing, runs, tokenbin, topk, toxicity
from folioscope.llm.common import table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), ranks), ranks)


def op2_vector_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn=toxicity.learn_fold())
    held_out = F.coalesce(~toxicity.learn_fold(), F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = langid.fit(docs, learn=langid.learn_fold())
    held_out = F.coalesce(~langid.learn_fold(), F.lit(False))
    return langid.identify(docs, net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.format_chats(chat.with_planted(table(spark, sf_dir, "conversations"))))


def op6_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.digests(gif.store(table(spark, sf_dir, "documents")))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.query(spark, sf_dir)


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "mix_slot", "mix_place")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    uri = tokenbin.fresh_uri(docs)
    return tokenbin.read_digests(tokenbin.write(docs, public_tokenizers.path("byte_bpe_50k.json"), uri, added=True), uri)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(table(spark, sf_dir, "documents"), runs.plant)


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        *(op1_byte_bpe, op2_vector_top5, op3_toxicity, op4_language, op5_chat_format, op6_gif_media, op7_near_duplicates),
        *(op8_license_scan, op9_source_mix, op10_token_files, op11_periodic_runs, op12_best_fit_packing, op13_filter_audit),
    )
}

#: Operators 1, 3, 4 and 6 to 12 have no SQL: tests compare them with brute force, libraries or held-out labels.
ORACLE_SQL: dict[str, str] = {"op2_vector_top5": topk.ORACLE, "op5_chat_format": chat.oracle(), "op13_filter_audit": audit.ORACLE}
