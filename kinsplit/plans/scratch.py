"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new path under ``spark.checkpoint.dir``.

    Only where that is unset (tests on one machine) a temporary folder takes its place
    for the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="kinsplit-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/kinsplit-{uuid.uuid4().hex}"


def stored(df: DataFrame, **options: str) -> DataFrame:
    """Write to a shared table and read it again: cuts lineage, survives lost executors.

    ``options`` are those of the Parquet writer, as ``compression``.
    """
    path = scratch(df.sparkSession)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
