"""Filters, neighbours, shared dependencies and components of a graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsplit.functions.columns import first_ids, listing
from kinsplit.functions.schema import SAMPLE_RELATION, DepGraphError, check, node_type
from kinsplit.model import DependencyGraph, QueryResult
from kinsplit.plans.components import connected_components
from kinsplit.plans.numbering import numbered
from kinsplit.plans.scratch import stored
from kinsplit.plans.skew import dealt_join, heavy_keys

Ids = Sequence[str] | DataFrame | None


def id_frame(graph: DependencyGraph, ids: Sequence[str] | DataFrame, column: str = "node_id") -> DataFrame:
    """Distinct ids given as a list or as a one-column DataFrame."""
    if isinstance(ids, DataFrame):
        return ids.select(F.col(f"`{ids.columns[0]}`").cast("string").alias(column)).distinct()
    return graph.nodes.sparkSession.createDataFrame([(str(i),) for i in dict.fromkeys(ids)], f"{column} string")


def _resolved(graph: DependencyGraph, ids: Sequence[str] | DataFrame) -> DataFrame:
    """The ids, all of which must be nodes (one job)."""
    wanted = id_frame(graph, ids)
    lost, n = first_ids(wanted.join(graph.nodes, "node_id", "left_anti"), "node_id")
    if lost:
        raise DepGraphError(f"Unknown node IDs: {listing(lost, n)}")
    return wanted


def sample_nodes(graph: DependencyGraph, samples: Ids = None) -> DataFrame:
    """sample_id and sample_node_id of the samples given by node id or key; all for None."""
    own = graph.of_type("Sample").select(F.col("node_key").alias("sample_id"), F.col("node_id").alias("sample_node_id"))
    if samples is None:
        return own
    wanted = id_frame(graph, samples, "s")
    hit = own.join(wanted, F.col("sample_node_id") == F.col("s")).unionByName(own.join(wanted, F.col("sample_id") == F.col("s")))
    lost, n = first_ids(wanted.join(hit.select("s"), "s", "left_anti"), "s")
    if lost:
        raise DepGraphError(f"Unknown sample IDs: {listing(lost, n)}")
    return hit.select("sample_id", "sample_node_id").distinct()


def via_relations(via: Sequence[str], edge_types: Sequence[str] | None = None) -> list[str]:
    """Relations from Sample to these node types; explicit edge types take their place."""
    if edge_types is not None:
        return list(edge_types)
    names = [node_type(v).name for v in via]
    check("Sample" not in names, "`via` names the types that samples depend on")
    return [SAMPLE_RELATION[n] for n in names]


def _used(graph: DependencyGraph, query: str, params: dict, node_ids: DataFrame, edge_ids: DataFrame, table: DataFrame, **metadata) -> QueryResult:
    nodes = graph.nodes.join(node_ids.select("node_id").distinct(), "node_id", "left_semi")
    edges = graph.edges.join(edge_ids.select("edge_id").distinct(), "edge_id", "left_semi")
    return QueryResult(query, params, nodes, edges, table, metadata)


def query_node_type(graph: DependencyGraph, node_types: Sequence[str] | str, ids: Ids = None) -> QueryResult:
    """Nodes of these types (in any case); ids that do not exist are ignored."""
    names = [node_type(t).name for t in ([node_types] if isinstance(node_types, str) else node_types)]
    own = graph.nodes.filter(F.col("node_type").isin(names))
    if ids is not None:
        own = own.join(id_frame(graph, ids), "node_id", "left_semi")
    return QueryResult("query_node_type", {"node_types": names}, own, graph.edges.limit(0), own)


def query_edge_type(graph: DependencyGraph, edge_types: Sequence[str] | str, node_ids: Ids = None) -> QueryResult:
    """Edges of these relations, on request only those that touch the nodes given."""
    names = [edge_types] if isinstance(edge_types, str) else list(edge_types)
    own = graph.edges.filter(F.col("edge_type").isin(names))
    if node_ids is not None:
        wanted = _resolved(graph, node_ids)
        at_from = own.join(wanted.withColumnRenamed("node_id", "from"), "from", "left_semi").select(*own.columns)
        at_to = own.join(wanted.withColumnRenamed("node_id", "to"), "to", "left_semi").join(wanted.withColumnRenamed("node_id", "from"), "from", "left_anti").select(*own.columns)
        own = at_from.unionByName(at_to)
    ends = own.select(F.explode(F.array("from", "to")).alias("node_id"))
    return _used(graph, "query_edge_type", {"edge_types": names}, ends, own, own)


def query_neighbors(graph: DependencyGraph, node_ids: Sequence[str] | DataFrame, edge_types: Sequence[str] | None = None, node_types: Sequence[str] | None = None, direction: str = "out") -> QueryResult:
    """One hop from each seed: a row for each seed and edge."""
    check(direction in ("out", "in", "all"), "direction must be out, in or all")
    seeds = _resolved(graph, node_ids).withColumnRenamed("node_id", "seed_node_id")
    edges = graph.edges if edge_types is None else graph.edges.filter(F.col("edge_type").isin(list(edge_types)))
    steps = []
    if direction in ("out", "all"):
        steps.append(edges.select(F.col("from").alias("seed_node_id"), F.col("to").alias("node_id"), "edge_id", "edge_type"))
    if direction in ("in", "all"):
        back = edges.filter("from <> to") if direction == "all" else edges  # a loop is one edge
        steps.append(back.select(F.col("to").alias("seed_node_id"), F.col("from").alias("node_id"), "edge_id", "edge_type"))
    hop = steps[0] if len(steps) == 1 else steps[0].unionByName(steps[1])
    nodes = graph.nodes.select("node_id", "node_type")
    if node_types is not None:
        nodes = nodes.filter(F.col("node_type").isin([node_type(t).name for t in node_types]))
    table = hop.join(seeds, "seed_node_id").join(nodes, "node_id").select("seed_node_id", "node_id", "node_type", "edge_id", "edge_type", F.lit(direction).alias("direction"))
    ids = table.select(F.explode(F.array("seed_node_id", "node_id")).alias("node_id")).unionByName(seeds.select(F.col("seed_node_id").alias("node_id")))
    return _used(graph, "query_neighbors", {"direction": direction}, ids, table, table)


def _sample_edges(graph: DependencyGraph, relations: Sequence[str], samples: Ids = None) -> DataFrame:
    """Edges of these relations that leave a Sample (of those given)."""
    own = graph.edges.filter(F.col("edge_type").isin(list(relations)))
    return own.join(sample_nodes(graph, samples).withColumnRenamed("sample_node_id", "from"), "from")


def detect_shared_dependencies(graph: DependencyGraph, via: Sequence[str] = ("Subject", "Batch", "Study", "Timepoint"), samples: Ids = None) -> QueryResult:
    """Pairs of samples with a target in common, a row for each pair and target.

    The samples are filtered first. As many pairs as a target's samples have among
    themselves are the answer, so ask by targets that few samples share.
    """
    relations = via_relations(via)
    own = _sample_edges(graph, relations, samples).select("sample_id", F.col("from").alias("node"), F.col("to").alias("shared_node_id"), "edge_type").distinct()
    left = own.select("shared_node_id", "edge_type", F.col("sample_id").alias("sample_id_1"), F.col("node").alias("sample_node_id_1"))
    right = own.select("shared_node_id", "edge_type", F.col("sample_id").alias("sample_id_2"), F.col("node").alias("sample_node_id_2"))
    pairs = left.join(right, ["shared_node_id", "edge_type"]).filter("sample_node_id_1 < sample_node_id_2")
    types = F.create_map(*[F.lit(x) for t, r in SAMPLE_RELATION.items() for x in (r, t)])
    table = pairs.select("sample_id_1", "sample_id_2", "sample_node_id_1", "sample_node_id_2", "shared_node_id", F.try_element_at(types, F.col("edge_type")).alias("shared_node_type"), "edge_type")
    ids = table.select(F.explode(F.array("sample_node_id_1", "sample_node_id_2", "shared_node_id")).alias("node_id"))
    return _used(graph, "detect_shared_dependencies", {"via": list(via)}, ids, provenance_edges(graph, relations, samples), table)


def provenance_edges(graph: DependencyGraph, relations: Sequence[str], samples: Ids = None) -> DataFrame:
    """The edges behind shared dependencies: those to a target of two samples or more, without pairs."""
    own = _sample_edges(graph, relations, samples)
    hubs = own.groupBy("to", "edge_type").agg(F.min("from").alias("lo"), F.max("from").alias("hi")).filter("lo <> hi")
    return own.join(hubs.select("to", "edge_type"), ["to", "edge_type"], "left_semi").select("edge_id")


def project_sample_dependencies(graph: DependencyGraph, via: Sequence[str]) -> DataFrame:
    """Distinct sample pairs with ``projection_<k>`` ids, in the order of the pairs."""
    table = detect_shared_dependencies(graph, via).df.select("sample_node_id_1", "sample_node_id_2").distinct()
    return numbered(table, ["sample_node_id_1", "sample_node_id_2"], "k").select("sample_node_id_1", "sample_node_id_2", F.concat(F.lit("projection_"), F.col("k").cast("string")).alias("projection_edge_id"))


def component_parts(graph: DependencyGraph, relations: Sequence[str]) -> DataFrame:
    """sample_id, sample_node_id and ``part``, which is one name for all samples of a component.

    A sample links its least target with its others, so components of targets, which are
    fewer than samples, give those of samples; no pair of samples is made. The table is
    written once. A sample without a target is a part of its own.
    """
    edges = graph.edges.filter(F.col("edge_type").isin(list(relations))).select("from", "to")
    # Rows are dealt by sample before they are grouped, as few fall together before that.
    ends = edges.repartition("from").groupBy(F.col("from").alias("sample_node_id")).agg(F.min("to").alias("least"), F.max("to").alias("most"), F.count("to").alias("n"))
    own = stored(sample_nodes(graph).join(ends, "sample_node_id", "left"))
    links = own.filter("least < most").select(F.col("most").alias("a"), F.col("least").alias("b"))
    many = own.filter("n > 2")
    if not many.isEmpty():  # all others have no target between these two
        links = links.unionByName(edges.join(many, F.col("from") == F.col("sample_node_id")).select(F.col("to").alias("a"), F.col("least").alias("b")))
    labels = connected_components(links)
    used = own.filter("least is not null").groupBy("least").agg(F.count("*").alias("_n"))
    # Of all targets only those that are some sample's least, often few.
    named = stored(used.join(labels.withColumnRenamed("vertex", "least"), "least", "left").select("least", "_n", F.concat(F.lit("1"), F.coalesce("component", "least")).alias("part")))
    ids = own.select("sample_id", "sample_node_id", "least")
    alone = ids.filter("least is null").select("sample_id", "sample_node_id", F.concat(F.lit("0"), "sample_node_id").alias("part"))
    return stored(dealt_join(ids.filter("least is not null"), named, "least", heavy_keys(named, "least")).select("sample_id", "sample_node_id", "part").unionByName(alone))


def detect_dependency_components(graph: DependencyGraph, via: Sequence[str] = ("Subject", "Batch", "Study", "Timepoint", "Assay", "FeatureSet", "Outcome"), edge_types: Sequence[str] | None = None, min_size: int = 1) -> QueryResult:
    """Connected components of samples; every sample has one, ``min_size`` filters the rows.

    ``component_<k>`` counts components in the order of their first sample's node id.
    """
    relations = via_relations(via, edge_types)
    parts = component_parts(graph, relations)
    sizes = parts.groupBy("part").agg(F.min("sample_node_id").alias("root"), F.count("*").alias("_n"))
    names = numbered(sizes, ["root"], "k").select("part", F.col("_n").cast("int").alias("component_size"), F.concat(F.lit("component_"), F.col("k").cast("string")).alias("component_id"))
    table = dealt_join(parts, names, "part", heavy_keys(names, "part", "component_size")).filter(F.col("component_size") >= min_size).select("sample_id", "sample_node_id", "component_id", "component_size")
    edges = provenance_edges(graph, relations)
    return _used(graph, "detect_dependency_components", {"via": list(via), "min_size": min_size}, table.select(F.col("sample_node_id").alias("node_id")), edges, table)


def typed_layout(graph: DependencyGraph) -> DataFrame:
    """Layer and position of every node for drawing: x from -0.5 to 0.5 within a layer, y = -layer."""
    from kinsplit.functions.schema import LAYERS

    layers = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for item in LAYERS.items() for x in item]), F.col("node_type")), F.lit(4))
    rows = numbered(graph.nodes.select("node_id", "node_type", layers.alias("layer")), ["layer", "node_id"], "k")
    spans = rows.groupBy("layer").agg(F.count("*").alias("n"), F.min("k").alias("first"))
    x: Column = F.when(F.col("n") > 1, (F.col("k") - F.col("first")) / (F.col("n") - 1) - 0.5).otherwise(F.lit(0.0))
    return rows.join(F.broadcast(spans), "layer").select("node_id", "node_type", "layer", x.alias("x"), (-F.col("layer")).cast("double").alias("y"))
