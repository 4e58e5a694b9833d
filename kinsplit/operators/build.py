"""Assembly of graphs from node and edge tables."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinsplit.functions.columns import first_ids, listing, pack, present
from kinsplit.functions.schema import EDGES, NODE_TYPES, NODES, SAMPLE_RELATION, DepGraphError, check
from kinsplit.model import DependencyGraph, EdgeSet, NodeSet, graph_metadata
from kinsplit.plans.numbering import numbered
from kinsplit.sources.metadata import create_edges, create_nodes, ingest_metadata


def graph_node_set(data: DataFrame, schema_version: str | None = None, source: Mapping[str, Any] | None = None) -> NodeSet:
    """A raw node table, checked: columns, missing values and node types (one job).

    Node types are matched in any case; a missing label is the id; extra columns go.
    """
    _columns(data, ("node_id", "node_type", "node_key"))
    name = F.lower("node_type")
    kinds = F.create_map(*[F.lit(x) for t in NODE_TYPES for x in (t.lower(), t)])
    bad = data.agg(*[F.count_if(~F.coalesce(present(F.col(c)), F.lit(False))).alias(c) for c in ("node_id", "node_type", "node_key")], F.count_if(present(F.col("node_type")) & F.try_element_at(kinds, name).isNull()).alias("unknown")).first()
    for c in ("node_id", "node_type", "node_key"):
        check(bad[c] == 0, f"Node table contains missing or empty `{c}` values")
    check(bad.unknown == 0, "Unsupported node types found in the node table")
    label = F.coalesce(F.when(present(F.col("label")), F.col("label").cast("string")), F.col("node_id")) if "label" in data.columns else F.col("node_id")
    out = data.select(F.col("node_id").cast("string").alias("node_id"), F.try_element_at(kinds, name).alias("node_type"), F.col("node_key").cast("string").alias("node_key"), label.alias("label"), _attrs(data))
    return NodeSet(out, **({"schema_version": schema_version} if schema_version else {}), source=dict(source or {}))


def graph_edge_set(data: DataFrame, schema_version: str | None = None, source: Mapping[str, Any] | None = None) -> EdgeSet:
    """A raw edge table, checked for columns and missing values (one job)."""
    needed = ("edge_id", "from", "to", "edge_type")
    _columns(data, needed)
    bad = data.agg(*[F.count_if(~F.coalesce(present(F.col(c)), F.lit(False))).alias(c) for c in needed]).first()
    for c in needed:
        check(bad[c] == 0, f"Edge table contains missing or empty `{c}` values")
    order = F.col("ord").cast("long") if "ord" in data.columns else F.lit(None).cast("long")
    out = data.select(*[F.col(c).cast("string").alias(c) for c in needed], _attrs(data), order.alias("ord"))
    return EdgeSet(out, **({"schema_version": schema_version} if schema_version else {}), source=dict(source or {}))


def _columns(data: DataFrame, needed: Sequence[str]) -> None:
    missing = [c for c in needed if c not in data.columns]
    check(not missing, f"Missing columns: {', '.join(missing)}")


def _attrs(data: DataFrame):
    if "attrs" not in data.columns:
        return pack([]).alias("attrs")
    kind = data.schema["attrs"].dataType
    if isinstance(kind, T.VariantType):
        return F.coalesce("attrs", pack([])).alias("attrs")
    check(isinstance(kind, (T.StructType, T.MapType)), "`attrs` entries must be named lists")
    return F.coalesce(F.parse_json(F.to_json("attrs")), pack([])).alias("attrs")


def dependency_graph(nodes: NodeSet | DataFrame, edges: EdgeSet | DataFrame, metadata: Mapping[str, Any] | None = None) -> DependencyGraph:
    """A graph as it is: no check, no validation."""
    return DependencyGraph(_frame(nodes), _frame(edges), graph_metadata(None, None) | dict(metadata or {}))


def _frame(part) -> DataFrame:
    return part if isinstance(part, DataFrame) else part.df


def bind(parts, schema: T.StructType) -> DataFrame:
    """Rows of one set or of a list of sets."""
    parts = [parts] if isinstance(parts, (NodeSet, EdgeSet, DataFrame)) else list(parts)
    check(bool(parts), "At least one node set and one edge set are needed")
    return reduce(DataFrame.unionByName, [_frame(p).select(*schema.names) for p in parts])


def build_dependency_graph(nodes, edges, graph_name: str | None = None, dataset_name: str | None = None, validate: bool = True, validation_overrides: Mapping[str, Any] | None = None, checked: bool = True) -> DependencyGraph:
    """A graph with at least one Sample, unique ids and no dangling edge; validated on request.

    ``checked=False`` leaves the integrity jobs to :func:`validate_graph`.
    """
    graph = DependencyGraph(bind(nodes, NODES), bind(edges, EDGES), graph_metadata(graph_name, dataset_name, validation_overrides))
    if checked:
        check(not graph.of_type("Sample").isEmpty(), "A dependency graph needs at least one Sample node")
        for frame, column in ((graph.nodes, "node_id"), (graph.edges, "edge_id")):
            twice, n = first_ids(frame.groupBy(column).count().filter("count > 1"), column)
            check(not twice, f"Duplicated `{column}` values: {listing(twice, n)}")
        for side in ("from", "to"):
            lost = graph.edges.select(F.col(side).alias("node_id")).join(graph.nodes, "node_id", "left_anti")
            ids, n = first_ids(lost, "node_id", 5)
            if ids:
                raise DepGraphError(f"Edge data contains `{side}` references that are not present in the node table: {listing(ids, n)}" + _prefix_hint(ids, graph.nodes))
    if validate:
        from kinsplit.operators.validate import validate_graph

        validate_graph(graph, error_on_fail=True)
    return graph


def _prefix_hint(missing: list[str], nodes: DataFrame) -> str:
    prefixed = any(":" in m for m in missing)
    known = not nodes.filter(F.col("node_id").contains(":")).isEmpty()
    if prefixed == known:
        return ""
    if prefixed:
        return "\nHint: the edges' ends carry a type prefix and the node ids do not: create the nodes with prefix=True or the edges with from_prefix=False, to_prefix=False."
    return "\nHint: the node ids carry a type prefix and the edges' ends do not: create the edges with from_prefix=True, to_prefix=True or the nodes with prefix=False."


def timepoint_precedence(meta: DataFrame, numbers: bool = True) -> EdgeSet:
    """Each timepoint precedes the next one by (time_index, timepoint_id).

    Their order is dealt by ranges like any other: each meets the next by position.
    """
    times = meta.filter(present(F.col("timepoint_id")) & F.expr("try_cast(time_index as double)").isNotNull()).select("timepoint_id", F.expr("try_cast(time_index as double)").alias("time_index")).groupBy("timepoint_id").agg(F.min("time_index").alias("time_index"))
    placed = numbered(times, ["time_index", "timepoint_id"], "at")
    after = placed.select(F.col("timepoint_id").alias("next"), (F.col("at") - 1).alias("at"))
    return create_edges(placed.join(after, "at"), "timepoint_id", "next", "Timepoint", "Timepoint", "timepoint_precedes", order_by=["at"], numbers=numbers, checked=False)


def graph_from_metadata(
    meta: DataFrame,
    columns: Mapping[str, str] | None = None,
    dataset_name: str | None = None,
    graph_name: str | None = None,
    outcome_scope: str = "sample",
    time_precedence: bool = True,
    validate: bool = True,
    validation_overrides: Mapping[str, Any] | None = None,
    numbers: bool = True,
    checked: bool = True,
    order_by: Sequence[str] | None = None,
) -> DependencyGraph:
    """A graph from the canonical columns that a metadata table has.

    Rows have no order of their own: ``order_by`` names the columns (as a row number) in
    whose order edges are listed and numbered; without it, the ends' ids do.
    """
    check(outcome_scope in ("sample", "subject"), "outcome_scope must be sample or subject")
    meta = ingest_metadata(meta, columns, dataset_name)
    own = dict(numbers=numbers, checked=checked, order_by=order_by)
    present_types = [t for t in NODE_TYPES.values() if t.name not in ("Sample", "Outcome") and t.key in meta.columns]
    if present_types:
        some = meta.agg(*[F.bool_or(F.coalesce(present(F.col(t.key)), F.lit(False))).alias(t.key) for t in present_types]).first()
        present_types = [t for t in present_types if some[t.key]]
    nodes = [create_nodes(meta, "Sample", "sample_id", checked=checked)]
    nodes += [create_nodes(meta, t.name, t.key, checked=checked) for t in present_types]
    edges = [create_edges(meta, "sample_id", t.key, "Sample", t.name, SAMPLE_RELATION[t.name], allow_missing=True, **own) for t in present_types]
    if time_precedence and "time_index" in meta.columns and any(t.name == "Timepoint" for t in present_types):
        edges.append(timepoint_precedence(meta, numbers))
    outcome = "outcome_id" if "outcome_id" in meta.columns else "outcome_value" if "outcome_value" in meta.columns else None
    if outcome:
        if outcome == "outcome_value" and isinstance(meta.schema[outcome].dataType, T.NumericType):
            warnings.warn("`outcome_value` is numeric: each distinct value becomes an Outcome node", stacklevel=2)
        rows = meta.filter(present(F.col(outcome)))
        if not rows.isEmpty():
            nodes.append(create_nodes(rows, "Outcome", outcome, attr_cols=[c for c in NODE_TYPES["Outcome"].optional if c in meta.columns and c != outcome] if outcome == "outcome_id" else [], checked=checked))
            if outcome_scope == "subject" and "subject_id" in meta.columns:
                edges.append(create_edges(rows, "subject_id", outcome, "Subject", "Outcome", "subject_has_outcome", **own))
            else:
                edges.append(create_edges(rows, "sample_id", outcome, "Sample", "Outcome", "sample_has_outcome", allow_missing=True, **own))
    check(bool(edges), "Metadata has no column that relates samples to anything")
    return build_dependency_graph(nodes, edges, graph_name, dataset_name, validate, validation_overrides, checked)
