"""Containers for tables and what is derived from them. Printing one never runs a job."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsplit.functions.schema import SCHEMA_VERSION
from kinsplit.plans.scratch import stored


def edge_name() -> Column:
    """The id of an edge without a number."""
    return F.concat("edge_type", F.lit(":"), "from", F.lit("->"), "to")


def _without(frame: DataFrame, column: str, value: Column) -> DataFrame:
    """``frame`` as stored without a column's values where they equal an expression over the others."""
    same = F.equal_null(F.col(column), value)
    lean = stored(frame.withColumns({"_same": same, column: F.when(~same, F.col(column))}))
    return lean.withColumn(column, F.when(F.col("_same"), value).otherwise(F.col(column))).select(*frame.columns)


def count_table(frame: DataFrame, column: str) -> DataFrame:
    """value and n, the most frequent first."""
    return frame.groupBy(F.col(f"`{column}`").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def counts(frame: DataFrame, column: str) -> dict[str, int]:
    """The count table as a dictionary, for columns of few values."""
    return {r.value: r.n for r in count_table(frame, column).collect()}


@dataclass(frozen=True)
class NodeSet:
    df: DataFrame
    schema_version: str = SCHEMA_VERSION
    source: dict[str, Any] = field(default_factory=dict)

    def summary(self) -> dict[str, Any]:
        kinds = counts(self.df, "node_type")
        return {"schema_version": self.schema_version, "n_nodes": sum(kinds.values()), "node_types": kinds}

    def __repr__(self) -> str:
        return f"<NodeSet schema {self.schema_version}>"


@dataclass(frozen=True)
class EdgeSet:
    df: DataFrame
    schema_version: str = SCHEMA_VERSION
    source: dict[str, Any] = field(default_factory=dict)

    def summary(self) -> dict[str, Any]:
        kinds = counts(self.df, "edge_type")
        return {"schema_version": self.schema_version, "n_edges": sum(kinds.values()), "edge_types": kinds}

    def __repr__(self) -> str:
        return f"<EdgeSet schema {self.schema_version}>"


@dataclass(frozen=True)
class DependencyGraph:
    nodes: DataFrame
    edges: DataFrame
    metadata: dict[str, Any] = field(default_factory=dict)

    def persist(self) -> DependencyGraph:
        return DependencyGraph(self.nodes.persist(), self.edges.persist(), self.metadata)

    @cached_property
    def stored(self) -> DependencyGraph:
        """The same graph read from shared tables: it is computed once, whatever asks for it again.

        Each relation and node type comes from files of its own, so a filter by type reads
        only these. Labels that are keys and edge ids that are made of the edge's columns
        are not written but made again.
        """
        graph = DependencyGraph(_without(self.nodes, "label", F.col("node_key")), _without(self.edges, "edge_id", edge_name()), self.metadata)
        graph.__dict__["stored"] = graph
        return graph

    def partly_stored(self, types: Sequence[str], relations: Sequence[str] = ()) -> DependencyGraph:
        """The same graph with the nodes of these types and the edges of these relations in shared tables.

        It is for readers that ask for the others, as samples and their edges, about once.
        """
        if "stored" in self.__dict__:
            return self.stored

        def parted(frame: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
            own = F.coalesce(F.col(column).isin(list(names)), F.lit(False))
            return frame.filter(~own).unionByName(stored(frame.filter(own))) if names else frame

        return DependencyGraph(parted(self.nodes, "node_type", types), parted(self.edges, "edge_type", relations), self.metadata)

    def to_edge_list(self) -> DataFrame:
        return self.edges.select("from", "to", "edge_type", "edge_id")

    def relation(self, name: str) -> DataFrame:
        """Edges of one relation."""
        return self.edges.filter(F.col("edge_type") == name)

    def of_type(self, name: str) -> DataFrame:
        """Nodes of one type."""
        return self.nodes.filter(F.col("node_type") == name)

    def summary(self) -> dict[str, Any]:
        nodes, edges = counts(self.nodes, "node_type"), counts(self.edges, "edge_type")
        keys = ("graph_name", "dataset_name", "schema_version")
        return {k: self.metadata.get(k) for k in keys} | {"n_nodes": sum(nodes.values()), "n_edges": sum(edges.values()), "node_types": nodes, "edge_types": edges}

    def __repr__(self) -> str:
        return f"<DependencyGraph {self.metadata.get('graph_name') or 'unnamed'}>"


def graph_metadata(graph_name: str | None, dataset_name: str | None, overrides: dict[str, Any] | None = None) -> dict[str, Any]:
    return {"graph_name": graph_name, "dataset_name": dataset_name, "created_at": datetime.now(timezone.utc), "schema_version": SCHEMA_VERSION, "validation_overrides": dict(overrides or {})}


@dataclass(frozen=True)
class QueryResult:
    query: str
    params: dict[str, Any]
    nodes: DataFrame
    edges: DataFrame
    df: DataFrame
    metadata: dict[str, Any] = field(default_factory=dict)

    def summary(self) -> dict[str, Any]:
        return {"query": self.query, "n_nodes": self.nodes.count(), "n_edges": self.edges.count(), "n_rows": self.df.count()}

    def __repr__(self) -> str:
        return f"<QueryResult {self.query}>"


@dataclass(frozen=True)
class SplitConstraint:
    strategy: str
    df: DataFrame  # the sample map
    recommended_downstream_args: dict[str, Any]
    metadata: dict[str, Any]

    @property
    def mode(self) -> str:
        return self.metadata["mode"]

    @property
    def warnings(self) -> list[str]:
        return self.metadata.get("warnings", [])

    def grouping_vector(self) -> DataFrame:
        return self.df.select("sample_id", "group_id")

    def summary(self) -> dict[str, Any]:
        n = self.df.agg(F.count("*").alias("s"), F.count_distinct("group_id").alias("g")).first()
        return {"strategy": self.strategy, "mode": self.mode, "n_samples": n.s, "n_groups": n.g, "n_warnings": len(self.warnings), "columns": self.df.columns}

    def __repr__(self) -> str:
        return f"<SplitConstraint {self.mode} {self.strategy}>"


@dataclass(frozen=True)
class SplitSpec:
    df: DataFrame  # the sample data
    group_var: str
    block_vars: list[str]
    time_var: str | None
    ordering_required: bool
    constraint_mode: str
    constraint_strategy: str
    recommended_resampling: str
    metadata: dict[str, Any] = field(default_factory=dict)

    def summary(self) -> dict[str, Any]:
        n = self.df.agg(F.count("*").alias("s"), F.count_distinct("group_id").alias("g")).first()
        keys = ("constraint_mode", "constraint_strategy", "block_vars", "time_var", "ordering_required", "recommended_resampling")
        return {k: getattr(self, k) for k in keys} | {"n_samples": n.s, "n_groups": n.g}

    def __repr__(self) -> str:
        return f"<SplitSpec {self.constraint_mode} {self.constraint_strategy}>"


@dataclass(frozen=True)
class Report:
    """Result of validating a graph or a split specification."""

    valid: bool
    df: DataFrame  # the issues
    metrics: dict[str, Any]
    metadata: dict[str, Any] = field(default_factory=dict)
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    advisories: list[str] = field(default_factory=list)
    heads: DataFrame | None = None  # of a graph: the issues without their gathered ids
    members: DataFrame | None = None  # of a graph: a row for each id that an issue names

    def sizes(self) -> DataFrame:
        """severity, code, message and details of the issues, with ``n_nodes`` and ``n_edges`` that each names."""
        held = self.members.join(self.heads.filter("gathers").select("_rule").distinct(), "_rule", "left_semi")
        n = held.groupBy("_rule", "_order").agg(F.count_if(F.col("part") < 2).alias("_nodes"), F.count_if(F.col("part") == 2).alias("_edges"))
        count = lambda gathered, own: F.coalesce(gathered, F.size(own).cast("long"))
        return self.heads.join(n, ["_rule", "_order"], "left").select("severity", "code", "message", "details", count("_nodes", "node_ids").alias("n_nodes"), count("_edges", "edge_ids").alias("n_edges"))

    def summary(self) -> dict[str, Any]:
        table = self.df if self.heads is None else self.heads
        by = {f"by_{c}": counts(table, c) for c in ("level", "severity", "code") if c in table.columns}
        return {"n_issues": sum(by["by_severity"].values())} | by

    def __repr__(self) -> str:
        return f"<Report {'valid' if self.valid else 'not valid'}>"


@dataclass(frozen=True)
class RiskSummary:
    overview: str
    df: DataFrame  # the diagnostics
    validation_summary: dict[str, Any]
    constraint_summary: dict[str, Any]
    split_spec_summary: dict[str, Any]
    metadata: dict[str, Any] = field(default_factory=dict)

    def summary(self) -> dict[str, Any]:
        sources = counts(self.df, "source")
        return {"overview": self.overview, "n_diagnostics": sum(sources.values()), "by_source": sources, "by_severity": counts(self.df, "severity")}

    def __repr__(self) -> str:
        return f"<RiskSummary {self.overview}>"


@dataclass(frozen=True)
class DependencyConstraint:
    constraint_id: str
    relation_types: list[str]
    df: DataFrame
    transitive: bool = False
    metadata: dict[str, Any] = field(default_factory=dict)

    def summary(self) -> dict[str, Any]:
        group = next((c for c in ("group_id", "split_unit", "block_id") if c in self.df.columns), None)
        n_groups = self.df.select(group).distinct().count() if group else None
        return {"constraint_id": self.constraint_id, "relation_types": self.relation_types, "n_samples": self.df.count(), "n_groups": n_groups, "transitive": self.transitive}


@dataclass(frozen=True)
class LeakageConstraint:
    issue_type: str
    severity: str
    df: DataFrame
    recommendation: str = ""
    metadata: dict[str, Any] = field(default_factory=dict)

    def summary(self) -> dict[str, Any]:
        return {"issue_type": self.issue_type, "severity": self.severity, "n_affected_samples": self.df.count(), "recommendation": self.recommendation}
