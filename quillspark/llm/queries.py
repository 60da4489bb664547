"""The queries over the corpus tables, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import chat_format, decontaminate, mixing, near_dedup, revisits, shard, syncmers, token_store, toxicity, url_filter
from quillspark.llm.common import table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", asked), (-1, 1, "assistant", asked)], "conv_id bigint, turn bigint, role string, text string")
    turns = chat_format.canonical_turns(table(spark, sf_dir, "conversations"), "conv_id").union(extra)
    return chat_format.read_back(chat_format.format_turns(turns))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def op3_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_store.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve(revisits.captures(table(spark, sf_dir, "pages")))
    return found.withColumn("headers", revisits.header_lines(F.col("headers")))


def op9_shard_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_format,
        op2_url_filter,
        op3_syncmer_fingerprints,
        op4_decontaminate,
        op5_token_store,
        op6_near_duplicates,
        op7_source_mixing,
        op8_warc_revisits,
        op9_shard_lookup,
        op10_toxicity,
    )
}

ORACLE_SQL: dict[str, str] = {"op1_chat_format": chat_format.SQL, "op2_url_filter": url_filter.SQL, "op4_decontaminate": decontaminate.oracle(), "op6_near_duplicates": near_dedup.oracle(), "op7_source_mixing": mixing.oracle(), "op8_warc_revisits": revisits.SQL, "op9_shard_lookup": shard.oracle()}
