"""Streams of metadata rows as streams of nodes and edges.

Only the stateless projections apply to a stream: ids and types. Numbering, conflicts,
components and orders need the whole table and stay batch operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsplit.functions.columns import as_key, pack, present
from kinsplit.functions.schema import EDGE_TYPES, node_type
from kinsplit.sources.metadata import node_id


def stream_nodes(rows: DataFrame, type: str, id_col: str) -> DataFrame:
    """Nodes of each row with a key; repeats are left to the sink."""
    kind, key = node_type(type), as_key(rows, id_col)
    return rows.filter(present(key)).select(node_id(kind.name, key).alias("node_id"), F.lit(kind.name).alias("node_type"), key.alias("node_key"), key.alias("label"), pack([c for c in kind.optional if c in rows.columns and id_col == kind.key]).alias("attrs"))


def stream_edges(rows: DataFrame, from_col: str, to_col: str, relation: str) -> DataFrame:
    """Edges of each row with both ends, named by them."""
    kind = EDGE_TYPES[relation]
    a, b = as_key(rows, from_col), as_key(rows, to_col)
    ends = rows.filter(present(a) & present(b)).select(node_id(kind.source, a).alias("from"), node_id(kind.target, b).alias("to"))
    return ends.select(F.concat(F.lit(f"{relation}:"), "from", F.lit("->"), "to").alias("edge_id"), "from", "to", F.lit(relation).alias("edge_type"), pack([]).alias("attrs"))
