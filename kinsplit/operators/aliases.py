"""Former names; each warns and calls the present one."""

from __future__ import annotations

from typing import Any

from kinsplit.model import DependencyGraph, EdgeSet, NodeSet
from kinsplit.operators.build import build_dependency_graph, dependency_graph, graph_edge_set, graph_node_set
from kinsplit.operators.constraints import deprecated
from kinsplit.operators.validate import validate_depgraph


def new_depgraph_nodes(*args: Any, **options: Any) -> NodeSet:
    deprecated("new_depgraph_nodes", "graph_node_set")
    return graph_node_set(*args, **options)


def new_depgraph_edges(*args: Any, **options: Any) -> EdgeSet:
    deprecated("new_depgraph_edges", "graph_edge_set")
    return graph_edge_set(*args, **options)


def new_depgraph(*args: Any, **options: Any) -> DependencyGraph:
    deprecated("new_depgraph", "dependency_graph")
    return dependency_graph(*args, **options)


def build_depgraph(*args: Any, **options: Any) -> DependencyGraph:
    deprecated("build_depgraph", "build_dependency_graph")
    return build_dependency_graph(*args, **options)


__all__ = ["build_depgraph", "new_depgraph", "new_depgraph_edges", "new_depgraph_nodes", "validate_depgraph"]
