"""A training-data pipeline over ``documents``: five stages, each from a table to a table.

Every stage takes all that the one before kept, is written as Parquet to the shared
folder and read again. The first four return the columns of ``documents``; what they
reject is gone. The last returns the digests of its token ids.

Texts go to Python workers in Arrow batches of at most ``BATCH_BYTES``, so that long texts
do not add up in a worker's memory; each stage sets that for the session.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsplit.llm import bpe, decontaminate, jaccard_join, quality, toxicity
from kinsplit.llm.util import free, table
from kinsplit.plans.scratch import stored


BATCH_BYTES = "8m"


def stage(function: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``function`` in a session that sends small batches."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        return function(spark, docs, sf_dir)

    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the operator's threshold.

    Null and empty texts and texts without words count as no toxicity beyond the model's
    share of such texts, and stay. Repeated rows fare alike. Other columns pass through,
    whatever their names. An empty table stays empty.
    """
    model, column = toxicity.fit_on(docs, table(spark, sf_dir, "labels")), free(docs, "_toxicity")
    return toxicity.score(docs, model, column).filter(F.col(column) < toxicity.THRESHOLD).drop(column)


@stage
def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality reaches the operator's threshold.

    Null texts are scored as empty ones, and empty ones by their features like any other.
    Repeated rows fare alike. Other columns pass through, whatever their names. An empty
    table stays empty.
    """
    model, column = quality.fit_on(docs, table(spark, sf_dir, "labels")), free(docs, "_quality")
    return quality.score(docs, model, column).filter(F.col(column) >= quality.THRESHOLD).drop(column)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: the one of smallest doc_id.

    Rows without words (null, empty, white space) all stay. Of rows that agree in doc_id
    and text one stays. Other columns pass through.
    """
    return jaccard_join.deduplicate(docs)


@stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no item of ``benchmark`` leaks.

    Null and empty texts stay. Repeated rows fare alike. Other columns pass through.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@stage
def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, digested, and of the bytes they decode to.

    One row for each row; a null text counts as an empty one, which has no ids.
    """
    return bpe.op5(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte-level BPE", tokenize),
]

#: Trained classifiers and a tokenizer have no SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from all of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES:
        docs = stored(step(spark, docs, sf_dir))
    return docs
