"""Shared helpers: table access, label folds, samples to learn from."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """While jobs run in here, rows go to Python workers in batches of at most ``size``."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, size)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def free(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one that is no column of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id is in fold -1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(-1))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, rows: int) -> list[tuple[str, int]]:
    """At most ``rows`` labelled texts, of any length, to fit a model on.

    The rows with the smallest hash of the id are taken, so the sample is the same at
    any partitioning. Ids with contradicting labels and null texts or labels are skipped,
    as are ids of several texts: their label names no one of them.
    """
    picked = (
        labels.filter(keep & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg(F.min(label).alias("lo"), F.max(label).alias("hi"))
        .filter("lo = hi")
        .select("doc_id", F.col("lo").cast("int").alias("y"), F.xxhash64("doc_id").alias("h"))
        .orderBy("h", "doc_id")
        .limit(rows)
    )
    # ``rows`` bounds the broadcast side and, as one text stays for each id, what is collected.
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("h", "doc_id", "y").agg(F.min("text").alias("text"), F.max("text").alias("other")).filter("text = other").drop("other").collect()
    return [(r.text, r.y) for r in sorted(found, key=lambda r: (r.h, r.doc_id))]
