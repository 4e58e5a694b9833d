"""Joins and shuffles whose tasks stay small, whatever the keys and the size of the input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that a task of a join gets.
MOST_ROWS = 1_000_000


def heavy_keys(counts: DataFrame, key: str, n: str = "_n") -> DataFrame:
    """Of a table of keys and their numbers of rows, those of more than ``MOST_ROWS`` with the parts they are dealt over."""
    return counts.filter(F.col(n) > MOST_ROWS).select(key, F.ceil(F.col(n) / MOST_ROWS).cast("int").alias("_parts"))


def dealt_join(left: DataFrame, right: DataFrame, key: str, heavy: DataFrame) -> DataFrame:
    """The inner join of two tables by a key, of which heavy ones (see ``heavy_keys``) are frequent in ``left``.

    These are dealt over parts, to each of which their rows of ``right`` go. They are at most
    one in ``MOST_ROWS`` rows of ``left``, so they are broadcast.
    """
    part = F.coalesce(F.pmod(F.xxhash64(*left.columns), F.col("_parts")).cast("int"), F.lit(0))
    dealt = left.join(F.broadcast(heavy), key, "left").withColumn("_part", part).drop("_parts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    spread = right.join(F.broadcast(heavy), key, "left").withColumn("_part", copies).drop("_parts")
    return dealt.join(spread, [key, "_part"]).drop("_part")


#: Bytes of input for each part of a shuffle.
PART_BYTES = 8 << 20


def room_for(data: DataFrame) -> None:
    """Raise the session's number of shuffle partitions to what the size of ``data``'s files asks for.

    It is never lowered. With a fixed number a task's sorts and tables grow with the input.
    """
    leaves = data._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    conf, parts = data.sparkSession.conf, sum(s for s in sizes if s < 1 << 50) // PART_BYTES  # rows of no known size say more
    if parts > int(conf.get("spark.sql.shuffle.partitions")):
        conf.set("spark.sql.shuffle.partitions", str(parts))
