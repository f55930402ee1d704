"""Queries of the ten operators, each over its whole table, with the parameters meant for production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, grouping, language_model, mixing, quality, sharding, substrings, surrogates, token_output, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shuffled(_table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = language_model.hashed(_table(spark, sf_dir, "documents"))
    return language_model.scored(docs, *language_model.trained(docs))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.linked(_table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.spans(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(_table(spark, sf_dir, "documents"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.written_blocks(_table(spark, sf_dir, "documents"))


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replaced(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.pages(warc.read(warc.write(_table(spark, sf_dir, "pages"))))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.ledger(docs, quality.toxic_terms(docs, _table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_mixing": op2_mixing,
    "op3_language_model": op3_language_model,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_decontaminate": op5_decontaminate,
    "op6_substrings": op6_substrings,
    "op7_token_output": op7_token_output,
    "op8_surrogates": op8_surrogates,
    "op9_warc": op9_warc,
    "op10_quality_rules": op10_quality_rules,
}
ORACLE_SQL: dict[str, str] = {
    "op2_mixing": mixing.ORACLE_SQL,
    "op4_ngram_jaccard": grouping.ORACLE_SQL,
    "op5_decontaminate": decontaminate.ORACLE_SQL,
    "op6_substrings": substrings.ORACLE_SQL,
    "op9_warc": warc.ORACLE_SQL,
    "op10_quality_rules": quality.ORACLE_SQL,
}
