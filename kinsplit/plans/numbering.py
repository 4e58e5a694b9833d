"""Positions in a global order without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinsplit.plans.scratch import stored


def numbered(frame: DataFrame, order: list[Column | str], name: str = "ord") -> DataFrame:
    """``frame`` with 1, 2, ... in the given order in column ``name``.

    Rows are dealt by ranges of the order and written once, so that positions within a
    range and the ranges' sizes come from the same rows; the sizes are one small row for
    each range.
    """
    dealt = stored(frame.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_rows"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return own.join(F.broadcast(before), "_range").withColumn(name, (F.col("_before") + F.col("_own")).cast("long")).drop("_range", "_rows", "_before", "_own")
