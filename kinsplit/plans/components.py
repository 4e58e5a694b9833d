"""Connected components of an edge table by contraction, without collecting anything.

Each round every vertex points to the least of its neighbours and itself; pointers are
followed twice, edges are renamed by them, and loops and repeats fall away. Stars vanish
in one round and a path shrinks to a quarter, so rounds grow with the logarithm of the
longest path. A round writes its pointers and its edges to shared tables; the pointers
of all rounds are followed at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsplit.plans.scratch import stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``vertex`` and ``component`` (its least vertex) for every vertex that an edge names.

    Edges with a null end are ignored; a loop makes its vertex a component of its own.
    """
    first = stored(_ordered(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null")))
    labels = first.select(F.explode(F.array("a", "b")).alias("vertex")).distinct().withColumn("component", F.col("vertex"))
    pairs = first.filter("a <> b")
    pointers = []
    while not pairs.isEmpty():
        both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.min("a")).alias("to"))
        for _ in range(2):
            onward = least.select(F.col("v").alias("to"), F.col("to").alias("next"))
            least = least.join(onward, "to", "left").select("v", F.coalesce("next", "to").alias("to"))
        pointers.append(least := stored(least))
        renamed = pairs
        for end in ("a", "b"):
            renamed = renamed.join(least.select(F.col("v").alias(end), F.col("to").alias(f"to_{end}")), end)
        pairs = stored(_ordered(renamed.select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).filter("a <> b")))
    for least in pointers:
        labels = labels.join(least.withColumnRenamed("v", "component"), "component", "left").select("vertex", F.coalesce("to", "component").alias("component"))
    return stored(labels)


def _ordered(pairs: DataFrame) -> DataFrame:
    """Each edge once, its larger end first."""
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
