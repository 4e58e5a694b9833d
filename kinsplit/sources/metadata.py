"""Metadata tables to typed node and edge tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsplit.functions.columns import as_key, first_ids, listing, pack, present
from kinsplit.functions.schema import EDGE_TYPES, NODE_TYPES, DepGraphError, check, node_type
from kinsplit.model import EdgeSet, NodeSet
from kinsplit.plans.numbering import numbered
from kinsplit.plans.skew import room_for

ID_COLUMNS = tuple(t.key for t in NODE_TYPES.values())


def ingest_metadata(data: DataFrame, col_map: Mapping[str, str] | None = None, dataset_name: str | None = None, strict: bool = True) -> DataFrame:
    """``data`` with canonical column names (``col_map``: canonical to own name) and ids as text.

    With ``strict`` a ``sample_id`` is required. All other columns are kept. Lazy.
    """
    for canonical, own in (col_map or {}).items():
        check(own in data.columns, f"Mapped column not found in metadata: {own}")
        check(canonical == own or canonical not in data.columns, f"Column {canonical} exists beside the one mapped to it")
    out = data.withColumnsRenamed({own: canonical for canonical, own in (col_map or {}).items()})
    check(not strict or "sample_id" in out.columns, "Metadata must have a `sample_id` column")
    return out.withColumns({c: as_key(out, c) for c in ID_COLUMNS if c in out.columns})


def node_id(type_name: str, key: Column, prefix: bool = True) -> Column:
    return F.concat(F.lit(node_type(type_name).prefix + ":"), key) if prefix else key


def create_nodes(data: DataFrame, type: str, id_col: str, label_col: str | None = None, attr_cols: Sequence[str] | None = None, prefix: bool = True, dedupe: bool = True, checked: bool = True) -> NodeSet:
    """Nodes of one type, one for each distinct key.

    Rows without a key fall away. If ``id_col`` is the type's own key and ``attr_cols`` is
    None, every optional attribute that is a column is taken. Keys with differing labels
    or attributes raise (one job; ``checked=False`` skips it for data known to be sound).
    """
    kind = node_type(type)
    check(id_col in data.columns, f"Column not found: {id_col}")
    if attr_cols is None:
        attr_cols = [c for c in kind.optional if c in data.columns] if id_col == kind.key else []
    for c in [*attr_cols, *([label_col] if label_col else [])]:
        check(c in data.columns, f"Column not found: {c}")
    own = data.select(as_key(data, id_col).alias("_key"), *([F.col(f"`{label_col}`").cast("string").alias("_label")] if label_col else []), *[F.col(f"`{c}`") for c in attr_cols]).filter(present(F.col("_key")))
    if dedupe:
        own = own.distinct()
        if checked and (attr_cols or label_col):
            clash, n = first_ids(own.groupBy("_key").count().filter("count > 1").select(node_id(kind.name, F.col("_key"), prefix).alias("id")), "id")
            if clash:
                raise DepGraphError(f"Conflicting node definitions found for IDs: {listing(clash, n)}")
    label = F.coalesce(F.when(present(F.col("_label")), F.col("_label")), F.col("_key")) if label_col else F.col("_key")
    out = own.select(node_id(kind.name, F.col("_key"), prefix).alias("node_id"), F.lit(kind.name).alias("node_type"), F.col("_key").alias("node_key"), label.alias("label"), pack(list(attr_cols)).alias("attrs"))
    return NodeSet(out, source={"type": kind.name, "id_col": id_col})


def create_edges(
    data: DataFrame,
    from_col: str,
    to_col: str,
    from_type: str,
    to_type: str,
    relation: str,
    attr_cols: Sequence[str] | None = None,
    allow_missing: bool = False,
    dedupe: bool = True,
    from_prefix: bool = True,
    to_prefix: bool = True,
    order_by: Sequence[str] | None = None,
    numbers: bool = True,
    checked: bool = True,
) -> EdgeSet:
    """Edges of one relation, numbered ``relation:<n>`` in the order of ``order_by``.

    The default order is by the ends' ids. A known relation must join its own types;
    other relations are accepted here and reported by validation. Rows without an end
    raise unless ``allow_missing`` drops them; pairs with differing attributes raise.
    ``numbers=False`` names edges by their ends, which needs no job; ``checked=False``
    skips the job that looks for missing ends and conflicts.
    """
    source, target, known = node_type(from_type), node_type(to_type), EDGE_TYPES.get(relation)
    check(known is None or (known.source, known.target) == (source.name, target.name), f"Relation {relation} joins {known and known.source} to {known and known.target}, not {source.name} to {target.name}")
    room_for(data)
    attr_cols = list(attr_cols or [])
    order = list(order_by or [])
    for c in [from_col, to_col, *attr_cols, *order]:
        check(c in data.columns, f"Column not found: {c}")
    own = data.select(as_key(data, from_col).alias("_f"), as_key(data, to_col).alias("_t"), *[F.col(f"`{c}`") for c in attr_cols], *[F.col(f"`{c}`").alias(f"_o{i}") for i, c in enumerate(order)])
    whole = present(F.col("_f")) & present(F.col("_t"))
    if not allow_missing and checked:
        check(own.filter(~F.coalesce(whole, F.lit(False))).isEmpty(), f"Missing `{from_col}` or `{to_col}` values for relation {relation}; use allow_missing=True to drop these rows")
    own = own.filter(whole).select(node_id(source.name, F.col("_f"), from_prefix).alias("from"), node_id(target.name, F.col("_t"), to_prefix).alias("to"), *attr_cols, *[f"_o{i}" for i in range(len(order))])
    by = [f"_o{i}" for i in range(len(order))]
    if dedupe:
        own = own.groupBy("from", "to", *attr_cols).agg(F.min(F.struct(*by)).alias("_o")).select("from", "to", *attr_cols, "_o.*") if by else own.distinct()
        if checked and attr_cols:
            clash, n = first_ids(own.groupBy("from", "to").count().filter("count > 1").select(F.concat("from", F.lit(" -> "), "to", F.lit(f" [{relation}]")).alias("id")), "id")
            if clash:
                raise DepGraphError(f"Conflicting edge definitions found for relations: {listing(clash, n)}")
    if numbers:
        own = numbered(own, [*by, "from", "to"])
        edge_id = F.concat(F.lit(f"{relation}:"), F.col("ord").cast("string"))
    else:
        own = own.withColumn("ord", F.lit(None).cast("long"))
        edge_id = F.concat(F.lit(f"{relation}:"), "from", F.lit("->"), "to")
    return EdgeSet(own.select(edge_id.alias("edge_id"), "from", "to", F.lit(relation).alias("edge_type"), pack(attr_cols).alias("attrs"), "ord"), source={"relation": relation})
