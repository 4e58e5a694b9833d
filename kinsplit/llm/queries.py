"""The registered corpus queries, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession

from kinsplit.llm import bitpack, bpe, decontaminate, flac, jaccard_join, language_id, license_scan, quality, toxicity, url_filter
from kinsplit.llm.util import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.op1(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op2(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.op3(table(spark, sf_dir, "pages"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.op4(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op5(table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op6(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_media_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.op7(table(spark, sf_dir, "documents"))


def op8_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitpack.op8(table(spark, sf_dir, "documents"), tokenizers.path("word_bpe_49k.json"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.op9(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op10(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_quality": op2_quality,
    "op3_url_filter": op3_url_filter,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_toxicity": op6_toxicity,
    "op7_media_flac": op7_media_flac,
    "op8_packed_ids": op8_packed_ids,
    "op9_language_id": op9_language_id,
    "op10_decontamination": op10_decontamination,
}

#: DuckDB SQL where SQL can express the query.
ORACLE_SQL: dict[str, str] = {"op3_url_filter": url_filter.ORACLE}
