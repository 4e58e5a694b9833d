"""Validation in three layers. The issues of all rules are found as one union; the ids they name stand apart."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsplit.functions.columns import attribute_text, first_ids, listing, present
from kinsplit.functions.schema import DERIVATION_SCOPES, EDGE_TYPES, LEVELS, NODE_TYPES, OBSERVATION_LEVELS, SEVERITIES, SINGLE_TARGET, DepGraphError, check
from kinsplit.model import DependencyGraph, Report, counts, edge_name
from kinsplit.operators.constraints import deprecated
from kinsplit.operators.time_order import consistency
from kinsplit.plans.scratch import stored

#: Relations of whose targets the leakage layer asks how many samples they have.
SHARED = ("sample_belongs_to_subject", "sample_processed_in_batch", "sample_uses_featureset")
#: Parts of an issue's ids: nodes in order, nodes listed after them, edges.
NODES, MORE, EDGES = 0, 1, 2


@dataclass(frozen=True)
class Rule:
    """A rule's issues and, apart from them, the ids they name, so that no row need hold all of them.

    ``heads`` has one row for each issue. Issues of one or two ids carry them; others have
    them in ``members``: ``_order`` of the issue, ``part`` and ``id``, each once. Nothing is
    planned before it is asked for. ``listed`` are the ids (column ``id``) that end the message.
    """

    severity: str
    code: str
    heads: Callable[[], DataFrame]
    members: Callable[[], DataFrame] | None = None
    listed: Callable[[], DataFrame] | None = None
    text: str = ""

    def ids(self) -> DataFrame:
        """``_order``, ``part`` and ``id`` of all nodes and edges that the issues name."""
        if self.members is not None:
            return self.members()
        both = F.expr(f"concat(transform(node_ids, x -> named_struct('part', {NODES}, 'id', x)), transform(edge_ids, x -> named_struct('part', {EDGES}, 'id', x)))")
        return self.heads().select("_order", F.inline(both))


def _no_ids() -> Column:
    return F.array().cast("array<string>")


def _issue(frame: DataFrame, level: str, severity: str, code: str, message: Column | str, nodes: Column | None = None, edges: Column | None = None, order: Column | None = None, details: Mapping[str, Any] | None = None) -> DataFrame:
    """One issue for each row of ``frame``."""
    return frame.select(
        (order if order is not None else F.lit("")).cast("string").alias("_order"),
        F.lit(level).alias("level"),
        F.lit(severity).alias("severity"),
        F.lit(code).alias("code"),
        (message if isinstance(message, Column) else F.lit(message)).alias("message"),
        (nodes if nodes is not None else _no_ids()).alias("node_ids"),
        (edges if edges is not None else _no_ids()).alias("edge_ids"),
        F.parse_json(F.lit(json.dumps(details or {}))).alias("details"),
    )


def _each(frame: Callable[[], DataFrame], level: str, severity: str, code: str, *args: Any, **options: Any) -> Rule:
    """A rule with one issue for each row of ``frame``, whose ids are in the row."""
    return Rule(severity, code, lambda: _issue(frame(), level, severity, code, *args, **options))


def _part(frame: DataFrame, part: int, id: str, order: Column | None = None) -> DataFrame:
    own = frame.select((order if order is not None else F.lit("")).alias("_order"), F.lit(part).alias("part"), F.col(f"`{id}`").cast("string").alias("id"))
    return own.filter("id is not null").distinct()


def _one(frame: Callable[[], DataFrame], level: str, severity: str, code: str, text: str, nodes: str | None = None, edges: str | None = None, listed: str | None = None, more: str | None = None, details: Mapping[str, Any] | None = None, some: Callable[[], DataFrame] | None = None) -> Rule:
    """A single issue for all rows of ``frame``, none if it is empty; ids of ``more`` come after ``nodes``.

    ``some`` is a frame that is cheaper to make and empty where ``frame`` is.
    """
    columns = [(c, p) for c, p in ((nodes, NODES), (more, MORE), (edges, EDGES)) if c]
    return Rule(
        severity,
        code,
        lambda: _issue((some or frame)().limit(1), level, severity, code, text, details=details),
        (lambda: reduce(DataFrame.unionByName, [_part(frame(), p, c) for c, p in columns])) if columns else None,
        (lambda: frame().select(F.col(f"`{listed}`").cast("string").alias("id")).filter("id is not null")) if listed else None,
        text,
    )


def _absent(name: str) -> Column:
    return ~F.coalesce(present(F.col(name)), F.lit(False))


class Facts:
    """What several rules ask of a graph, found once and only if asked.

    ``whole`` tells that all layers' rules read the graph, so that it lies in shared tables;
    the leakage layer alone reads most edges once, for ``targets``.
    """

    def __init__(self, graph: DependencyGraph, whole: bool = True):
        self.graph = graph
        self.whole = whole

    @cached_property
    def relations(self) -> dict[str, int]:
        if self.whole:
            return counts(self.graph.edges, "edge_type")
        return {r.edge_type: r.n for r in self.targets.groupBy("edge_type").agg(F.sum("n").alias("n")).collect()}

    @cached_property
    def targets(self) -> DataFrame:
        """edge_type and ``to`` of the targets of relations in ``SHARED``, their number ``n`` of edges, and the least and the most hash of a sample.

        Of a graph that is not read as a whole, the other relations have a row each as well, without a target.
        """
        own = F.col("edge_type").isin(list(SHARED))
        edges = self.graph.edges.filter(own) if self.whole else self.graph.edges.withColumn("to", F.when(own, F.col("to")))
        sample = F.when(F.col("from").isNotNull(), F.xxhash64("from"))  # numbers need no sort, as text would
        return stored(edges.groupBy("edge_type", "to").agg(F.count("*").alias("n"), F.min(sample).alias("lo"), F.max(sample).alias("hi")))

    def shared(self, relation: str) -> DataFrame:
        """Targets (column ``to``) of two samples or more."""
        own = self.targets.filter(F.col("edge_type") == relation)
        sure = own.filter("lo <> hi").select("to")
        if relation not in self._unsure:
            self._unsure[relation] = not own.filter("lo = hi and n > 1").isEmpty()
        if not self._unsure[relation]:
            return sure
        # Several edges of one sample, or samples of one hash.
        unsure = own.filter("lo = hi and n > 1").select(F.col("to").alias("_to"))
        edges = self.graph.relation(relation).join(unsure, F.col("to").eqNullSafe(F.col("_to")), "left_semi")
        return sure.unionByName(_shared(edges))

    @cached_property
    def _unsure(self) -> dict[str, bool]:
        return {}

    @cached_property
    def places(self) -> list[str]:
        """The known relations that have edges. All others, few or many, share one place after them."""
        return [r for r in EDGE_TYPES if r in self.relations]

    @cached_property
    def types(self) -> dict[str, int]:
        return counts(self.graph.nodes, "node_type")

    def has(self, relation: str) -> bool:
        return relation in self.relations

    @cached_property
    def odd(self) -> DataFrame:
        """Of all ids of nodes and of edges' ends those that may break a rule: one grouping by id, without a join.

        ``nodes`` rows have the id; ``have`` are their types and ``want`` those that edges ask of
        it, as bits; ``lone`` are samples without a study where others have one; ``again`` are the bits of the relations of which it begins several edges.
        Of a sound graph no row is left. Each rule looks again at what these ids belong to.
        """
        bit = {k: 1 << i for i, k in enumerate(NODE_TYPES)}
        places, known = range(len(self.places) + 1), F.coalesce(F.col("edge_type").isin(self.places), F.lit(False))
        own = [*[F.col("edge_type") == r for r in self.places], ~known]
        bits = lambda column, values: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), column), F.lit(0))
        zero, other = F.lit(0), 1 << len(bit)  # a type that is unknown
        counted = lambda begins: [(F.when(c, 1).otherwise(0) if begins else F.lit(0)).cast("long").alias(f"_{i}") for i, c in enumerate(own)]
        rows = [self.graph.nodes.select(F.col("node_id").alias("id"), F.lit(1).cast("long").alias("nodes"), F.when(F.col("node_type").isin(list(bit)), bits(F.col("node_type"), bit)).otherwise(other).alias("have"), zero.alias("want"), zero.alias("named"), *counted(False))]
        for side, end in (("from", "source"), ("to", "target")):
            wanted = bits(F.col("edge_type"), {e.name: bit[getattr(e, end)] for e in EDGE_TYPES.values()})
            rows.append(self.graph.edges.select(F.col(side).alias("id"), F.lit(0).cast("long").alias("nodes"), zero.alias("have"), wanted.alias("want"), F.lit(1).alias("named"), *counted(side == "from")))
        every = reduce(DataFrame.unionByName, rows).groupBy("id").agg(F.sum("nodes").alias("nodes"), F.bit_or("have").alias("have"), F.bit_or("want").alias("want"), F.max("named").alias("named"), *[F.sum(f"_{i}").alias(f"_{i}") for i in places])
        again = reduce(Column.bitwiseOR, [F.when(F.col(f"_{i}") > 1, 1 << i).otherwise(0) for i in places])
        lone = (F.col("have").bitwiseAND(F.lit(bit["Sample"])) != 0) & (F.col(f"_{self.places.index('sample_from_study')}") == 0) if self.has("sample_from_study") else F.lit(False)
        wrong = (F.col("named") == 1) & (F.col("id").isNull() | (F.col("nodes") == 0) | (F.col("want").bitwiseAND(F.bitwise_not(F.col("have"))) != 0) | (F.bit_count("have") > 1))
        return stored(every.select("id", "nodes", again.alias("again"), wrong.alias("wrong"), lone.alias("lone")).filter("nodes > 1 or wrong or lone or again <> 0"))

    @cached_property
    def _flags(self) -> Any:
        """Whether ``odd`` has wrong ends and lone samples, and the bits of relations of which any id begins several edges."""
        return self.odd.agg(F.coalesce(F.bool_or("wrong"), F.lit(False)).alias("wrong"), F.coalesce(F.bool_or("lone"), F.lit(False)).alias("lone"), F.coalesce(F.bit_or("again"), F.lit(0)).alias("again")).first()

    def begins_again(self, *relations: str | None) -> bool:
        """Whether any node begins several edges of one of these relations."""
        return bool(self._flags.again & self._mask(relations))

    def _mask(self, relations: Sequence[str | None]) -> int:
        return sum({1 << (self.places.index(r) if r in self.places else len(self.places)) for r in relations})

    def begun_again(self, relation: str | None = None) -> DataFrame:
        """The edges, of one or of all relations, from nodes that begin several of their relation."""
        edges = self.graph.edges if relation is None else self.graph.relation(relation)
        relations = list(self.relations) if relation is None else [relation]
        if not self.begins_again(*relations):
            return edges.limit(0)
        own = self.odd.filter(F.col("again").bitwiseAND(F.lit(self._mask(relations))) != 0).select(F.col("id").alias("from"))
        return edges.join(own, "from", "left_semi").select(*edges.columns)

    @cached_property
    def same_ids(self) -> DataFrame:
        """Edge ids (null among them) of several edges.

        Ids made of their edge's columns agree where these do. Others are compared by their
        hashes first, and then those of equal hashes as they are.
        """
        twice = lambda frame: frame.groupBy("edge_id").count().filter("count > 1").drop("count")
        plain = F.equal_null(F.col("edge_id"), edge_name()) & ~F.contains("edge_type", F.lit(":")) & ~F.contains("from", F.lit("->"))
        if self.graph.edges.filter(~F.coalesce(plain, F.lit(False)) | F.col("edge_id").isNull()).isEmpty():
            return twice(self.begun_again())
        hashed = self.graph.edges.select("edge_id", F.xxhash64("edge_id").alias("_h"))
        likely = stored(hashed.groupBy("_h").count().filter("count > 1").select("_h"))
        return twice(hashed.limit(0) if likely.isEmpty() else hashed.join(likely, "_h", "left_semi"))

    @cached_property
    def faulty(self) -> DataFrame:
        """Edges with a missing end or with ends of wrong types: s, t (wanted), fs, ft (found), no_from, no_to."""
        nodes, edges = self.graph.nodes, self.graph.edges
        if not self._flags.wrong:
            edges = edges.limit(0)
        else:
            at = lambda side: self.odd.filter("wrong").select(F.col("id").alias(side))
            begins = edges.join(at("from"), "from", "left_semi").select(*edges.columns)
            rest = edges.join(at("from"), "from", "left_anti").select(*edges.columns)
            ends = rest.join(at("to"), "to", "left_semi").select(*edges.columns)
            edges = begins.unionByName(ends).unionByName(rest.filter("`from` is null or `to` is null").join(at("to"), "to", "left_anti").select(*edges.columns))
        wanted = nodes.sparkSession.createDataFrame([(e.name, e.source, e.target) for e in EDGE_TYPES.values()], "edge_type string, s string, t string")
        kinds = nodes.groupBy("node_id").agg(F.min("node_type").alias("k"))  # an id listed twice is no second edge
        end = lambda side, kind: kinds.select(F.col("node_id").alias(side), F.struct("k").alias(kind))
        own = edges.select("edge_id", "from", "to", "edge_type").join(end("from", "_f"), "from", "left").join(end("to", "_t"), "to", "left").join(F.broadcast(wanted), "edge_type", "left")
        own = own.select("edge_id", "from", "to", "edge_type", "s", "t", F.col("_f.k").alias("fs"), F.col("_t.k").alias("ft"), F.isnull("_f").alias("no_from"), F.isnull("_t").alias("no_to"))
        return stored(own.filter("no_from or no_to or fs <> s or ft <> t"))


def structural(graph: DependencyGraph, facts: Facts | None = None) -> list[Rule]:
    nodes, edges, level, facts = graph.nodes, graph.edges, "structural", facts or Facts(graph)
    triplet = ["from", "to", "edge_type"]
    triplets = lambda: facts.begun_again().groupBy(*triplet).count().filter("count > 1").drop("count")
    twice = lambda: facts.odd.filter("nodes > 1").select(F.col("id").alias("node_id"))
    out = [
        _one(lambda: nodes.filter(_absent("node_id")), level, "error", "missing_node_id", "Node table contains missing or empty `node_id` values."),
        _one(twice, level, "error", "duplicate_node_id", "Node table contains duplicated `node_id` values: ", nodes="node_id", listed="node_id"),
        _one(lambda: edges.filter(_absent("edge_id")), level, "error", "missing_edge_id", "Edge table contains missing or empty `edge_id` values."),
        _one(lambda: facts.same_ids, level, "error", "duplicate_edge_id", "Edge table contains duplicated `edge_id` values: ", edges="edge_id", listed="edge_id"),
        _one(lambda: facts.begun_again().join(triplets(), triplet, "left_semi"), level, "error", "duplicate_edge_triplet", "Edge table contains duplicate `(from, to, edge_type)` relations.", edges="edge_id", some=lambda: triplets().filter("`from` is not null and `to` is not null and edge_type is not null")),
    ]
    for side, code, word in (("from", "missing_source_node", "source"), ("to", "missing_target_node", "target")):
        out.append(_one(lambda side=side: facts.faulty.filter(f"no_{side}"), level, "error", code, f"Edges reference missing {word} nodes: ", nodes=side, listed=side))
    out.append(_one(lambda: nodes.filter(~F.coalesce(F.col("node_type").isin(list(NODE_TYPES)), F.lit(False))), level, "error", "unsupported_node_type", "Unsupported node types found: ", listed="node_type"))
    out.append(_each(lambda: edges.filter(~F.coalesce(F.col("edge_type").isin(list(EDGE_TYPES)), F.lit(False))), level, "error", "unsupported_edge_type", F.concat(F.lit("Unknown edge type encountered: "), F.coalesce("edge_type", F.lit("NA"))), edges=F.array("edge_id"), order=F.col("edge_id")))
    text = F.concat(F.lit("Edge `"), "edge_id", F.lit("` violates schema for `"), "edge_type", F.lit("` (expected "), "s", F.lit(" -> "), "t", F.lit(", found "), F.coalesce("fs", F.lit("NA")), F.lit(" -> "), F.coalesce("ft", F.lit("NA")), F.lit(")."))
    out.append(_each(lambda: facts.faulty.filter("fs <> s or ft <> t"), level, "error", "invalid_edge_signature", text, nodes=F.array("from", "to"), edges=F.array("edge_id"), order=F.col("edge_id")))
    for relation in SINGLE_TARGET:
        out.append(_several(facts, relation, level, "single_target_violation", f"Edge type `{relation}` links a source node to multiple targets: "))
    return out


def _several(facts: Facts, relation: str, level: str, code: str, text: str, more: str | None = None) -> Rule:
    """The edges of a relation from sources with two or more distinct targets."""
    own = lambda: facts.begun_again(relation)
    sources = lambda: own().groupBy("from").agg(F.min("to").alias("a"), F.max("to").alias("b")).filter("a <> b and `from` is not null").select("from")
    return _one(lambda: own().join(sources(), "from", "left_semi"), level, "error", code, text, nodes="from", more=more, edges="edge_id", listed="from", details={"edge_type": relation}, some=sources)


def semantic(graph: DependencyGraph, overrides: Mapping[str, Any], facts: Facts | None = None) -> list[Rule]:
    level, nodes, facts = "semantic", graph.nodes, facts or Facts(graph)
    by_type = lambda names: F.try_element_at(F.create_map(*[x for t in NODE_TYPES.values() for x in (F.lit(t.name), F.array(*map(F.lit, names(t))).cast("array<string>"))]), F.col("node_type"))
    held = lambda: nodes.withColumn("keys", F.coalesce(F.json_object_keys(F.to_json("attrs")), _no_ids()))
    lacking = lambda: held().withColumn("bad", F.array_except(by_type(lambda t: t.required), "keys")).filter(F.size("bad") > 0)
    unknown = lambda: held().filter(F.size("keys") > 0).withColumn("bad", F.array_except("keys", by_type(lambda t: (t.key, *t.required, *t.optional)))).filter(F.size("bad") > 0)
    out = [
        _each(frame, level, severity, code, F.concat(F.lit("Node `"), "node_id", F.lit(f"` {text}: "), F.array_join("bad", ", ")), F.array("node_id"), order=F.col("node_id"))
        for frame, severity, code, text in ((lacking, "error", "missing_required_node_attr", "is missing required attributes"), (unknown, "warning", "non_canonical_node_attr", "contains non-canonical attributes"))
    ]
    samples, in_study = graph.of_type("Sample"), graph.relation("sample_from_study")

    def lone() -> DataFrame:
        if not facts.has("sample_from_study") and graph.of_type("Study").isEmpty():
            return samples.limit(0)
        if facts.has("sample_from_study"):
            found = facts.odd.filter("lone").select(F.col("id").alias("node_id"))
            return samples.join(found, "node_id", "left_semi") if facts._flags.lone else samples.limit(0)
        return samples.join(in_study.select(F.col("from").alias("node_id")), "node_id", "left_anti")

    out.append(_one(lone, level, "warning", "sample_missing_study_assignment", "Samples missing required relation `sample_from_study`: ", nodes="node_id", listed="node_id", details={"edge_type": "sample_from_study"}))
    for word, relation in (("subject", "sample_belongs_to_subject"), ("study", "sample_from_study"), ("batch", "sample_processed_in_batch")):
        if word == "subject" and overrides.get("allow_multi_subject_samples") is True:
            continue
        out.append(_several(facts, relation, level, f"sample_multiple_{word}_assignments", f"Samples violate relation cardinality for `{relation}`: ", more="to"))
    for kind, name, values, code in (("FeatureSet", "derivation_scope", DERIVATION_SCOPES, "invalid_featureset_derivation_scope"), ("Outcome", "observation_level", OBSERVATION_LEVELS, "invalid_outcome_observation_level")):
        own = lambda kind=kind, name=name, values=values: graph.of_type(kind).withColumn("v", attribute_text(name)).filter(F.col("v").isNotNull() & ~F.col("v").isin(list(values)))
        out.append(_each(own, level, "warning", code, F.concat(F.lit(f"{kind} node `"), "node_id", F.lit(f"` has invalid `{name}`: "), "v"), F.array("node_id"), order=F.col("node_id")))
    times = lambda: graph.of_type("Timepoint").filter(attribute_text("time_index").isNotNull() & F.expr("try_variant_get(attrs, '$.time_index', 'double') is null"))
    out.append(_each(times, level, "warning", "invalid_time_index", F.concat(F.lit("Timepoint node `"), "node_id", F.lit("` has a non-numeric `time_index`.")), F.array("node_id"), order=F.col("node_id")))
    state, spark = consistency(graph), nodes.sparkSession

    def fixed(code: str, text: str, edges: list[str], ends: list[str]) -> None:
        if edges:
            row = spark.createDataFrame([(sorted(set(ends)), edges)], "n array<string>, e array<string>")
            out.append(_each(lambda: row, level, "error", code, text, F.col("n"), F.col("e")))

    fixed("timepoint_self_loop", "`timepoint_precedes` contains self-loops.", [e for e, _ in state.self_loops], [])
    if state.cycle:
        fixed("timepoint_precedence_cycle", "`timepoint_precedes` must define an acyclic ordering.", [e for e, _, _ in state.precedes], [])
    pairs = ", ".join(f"{a} -> {b}" for _, a, b in state.conflicts)
    fixed("time_order_conflict", f"Timepoint ordering metadata conflict between `time_index` and `timepoint_precedes`: {pairs}", [e for e, _, _ in state.conflicts], [n for e in state.conflicts for n in e[1:]])
    return out


def _shared(edges: DataFrame) -> DataFrame:
    """Targets (column ``to``) of two samples or more."""
    return edges.groupBy("to").agg(F.min("from").alias("a"), F.max("from").alias("b")).filter("a <> b").select("to")


def leakage(graph: DependencyGraph, facts: Facts | None = None) -> list[Rule]:
    level, facts = "leakage", facts or Facts(graph)

    def found(targets: Callable[[], DataFrame], severity: str, code: str, kind: str, text: str, edges: Callable[[], DataFrame], parts: Sequence[int]) -> Rule:
        """An issue for each target; its samples and edges, as far as ``parts`` asks for them."""
        ids = {MORE: "from", EDGES: "edge_id"}

        def members() -> DataFrame:
            own = edges().join(targets(), "to", "left_semi")
            return reduce(DataFrame.unionByName, [_part(targets(), NODES, "to", F.col("to")), *[_part(own, p, ids[p], F.col("to")) for p in parts]])

        return Rule(severity, code, lambda: _issue(targets(), level, severity, code, F.concat(F.lit(f"{kind} `"), "to", F.lit(f"` {text}")), order=F.col("to")), members)

    subjects, studies, batches, sets = (graph.relation(r) for r in ("sample_belongs_to_subject", "sample_from_study", "sample_processed_in_batch", "sample_uses_featureset"))

    def both() -> DataFrame:
        return subjects.select("from", "to").join(studies.select("from", F.col("to").alias("study")), "from").select("from", "to", "study")

    def crossing() -> DataFrame:
        if not (facts.has("sample_belongs_to_subject") and facts.has("sample_from_study")):
            return subjects.select("to").limit(0)
        return both().groupBy("to").agg(F.min("study").alias("a"), F.max("study").alias("b")).filter("a <> b").select("to")

    def heavy() -> DataFrame:
        limit = max(3, math.ceil(facts.types.get("Sample", 0) * 0.5))
        # A node's samples are as many as its edges at most, so few nodes are left to count exactly.
        likely = facts.targets.filter((F.col("edge_type") == "sample_processed_in_batch") & (F.col("n") >= limit)).select("to")
        if not facts.has("sample_processed_in_batch") or (facts.whole and not facts.begins_again("sample_processed_in_batch")):
            return likely  # each sample has one edge
        return batches.join(likely, "to", "left_semi").select("to", "from").distinct().groupBy("to").count().filter(F.col("count") >= limit).select("to")

    def none() -> DataFrame:
        row = graph.nodes.sparkSession.range(1)
        if not facts.has("sample_collected_at_timepoint") or facts.has("timepoint_precedes"):
            return row.limit(0)
        indexed = graph.of_type("Timepoint").agg(F.count_if(attribute_text("time_index").isNotNull()).alias("indexed"))
        return indexed.filter("indexed = 0")

    per_dataset = lambda: graph.of_type("FeatureSet").filter(attribute_text("derivation_scope") == "per_dataset").select(F.col("node_id").alias("to"))
    return [
        found(lambda: facts.shared("sample_belongs_to_subject"), "advisory", "repeated_subject_samples", "Subject", "is linked to multiple samples.", lambda: subjects, (MORE, EDGES)),
        found(crossing, "warning", "subject_cross_study_overlap", "Subject", "appears across multiple studies.", both, (MORE,)),
        _each(per_dataset, level, "advisory", "per_dataset_featureset", F.concat(F.lit("FeatureSet `"), "to", F.lit("` was derived at the full-dataset scope.")), F.array("to"), order=F.col("to")),
        found(lambda: facts.shared("sample_uses_featureset"), "advisory", "shared_featureset_provenance", "FeatureSet", "is shared across multiple samples.", lambda: sets, (MORE, EDGES)),
        _each(none, level, "warning", "missing_time_ordering", "Timepoint-linked samples exist but no explicit time ordering metadata were found."),
        found(heavy, "advisory", "heavy_batch_reuse", "Batch", "is reused across many samples.", lambda: batches, (EDGES,)),
    ]


_OLD_CHECKS = {"ids": ("structural",), "references": ("structural",), "cardinality": ("structural", "semantic"), "schema": ("semantic",), "time": ("semantic",)}


#: Messages of each severity that a report lists on the driver.
MESSAGES = 1000
#: Ids that the message of one issue lists; the number of the others follows. ``Report.members`` has all.
LISTED = 1000


def validate_graph(graph: DependencyGraph, checks: Sequence[str] | None = None, error_on_fail: bool = False, levels: Sequence[str] = LEVELS, severities: Sequence[str] = SEVERITIES, validation_overrides: Mapping[str, Any] | None = None) -> Report:
    """Issues of the selected layers; ``severities`` filters what is shown, not ``valid``.

    Issues and the ids they name are apart in ``Report.heads`` and ``Report.members``;
    ``Report.df`` brings them together, one row for each issue, when it is read.
    The report's lists of messages hold the first ``MESSAGES`` of each severity and then
    the number of the others; its table and counts are whole.
    """
    if checks is not None:
        deprecated("checks", "levels")
        for c in checks:
            check(c in _OLD_CHECKS, f"Unsupported check: {c}")
        levels = [lv for lv in LEVELS if any(lv in _OLD_CHECKS[c] for c in checks)]
    for given, known in ((levels, LEVELS), (severities, SEVERITIES)):
        for x in given:
            check(x in known, f"Unsupported validation level or severity: {x}")
    whole = any(lv != "leakage" for lv in levels)  # then each of many rules reads it
    graph = graph.stored if whole else graph.partly_stored(["FeatureSet", "Timepoint"])
    overrides = graph.metadata.get("validation_overrides", {}) | dict(validation_overrides or {})
    facts = Facts(graph, whole)
    makers = {"structural": lambda: structural(graph, facts), "semantic": lambda: semantic(graph, overrides, facts), "leakage": lambda: leakage(graph, facts)}
    rules = [r for lv in LEVELS if lv in levels for r in makers[lv]()]
    spark = graph.nodes.sparkSession
    empty = _issue(spark.range(0), "", "", "", "").withColumn("_rule", F.lit(0))
    every = stored(reduce(DataFrame.unionByName, [r.heads().withColumn("_rule", F.lit(i)) for i, r in enumerate(rules)], empty))
    from kinsplit.plans.numbering import numbered

    found = {r._rule: rules[r._rule] for r in every.select("_rule").distinct().collect()}
    lists = {i: r.text + listing(*first_ids(r.listed(), "id", LISTED)) for i, r in found.items() if r.listed is not None}
    if lists:
        every = every.withColumn("message", F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in lists.items() for x in pair]), F.col("_rule")), "message"))
    shown = [i for i, r in found.items() if r.severity in severities]
    numbers = numbered(every, ["_rule", "_order", "message"], "_number") if found else every.withColumn("_number", F.lit(0).cast("long"))
    heads = numbers.filter(F.col("severity").isin(list(severities))).withColumn("gathers", F.col("_rule").isin([i for i in shown if rules[i].members is not None]))
    members = reduce(DataFrame.unionByName, [found[i].ids().select(F.lit(i).alias("_rule"), "_order", F.lit(found[i].severity).alias("severity"), F.lit(found[i].code).alias("code"), "part", "id") for i in shown], spark.createDataFrame([], "_rule int, _order string, severity string, code string, part int, id string"))
    # For issues that gather ids, in one row each; those of one or two have them in the row.
    lists_ = members.filter(F.col("_rule").isin([i for i in shown if rules[i].members is not None])).groupBy("_rule", "_order").agg(F.array_sort(F.collect_set(F.struct("part", "id"))).alias("_all"))
    whole = heads.join(lists_, ["_rule", "_order"], "left") if any(rules[i].members is not None for i in shown) else heads.withColumn("_all", F.lit(None).cast("array<struct<part: int, id: string>>"))
    pick = lambda edges, own: F.coalesce(F.transform(F.filter("_all", lambda x: (x["part"] == EDGES) == F.lit(edges)), lambda x: x["id"]), own).alias(own)
    issue_id = F.concat(F.lit("issue_"), F.col("_number").cast("string")).alias("issue_id")
    table = whole.select(issue_id, "level", "severity", "code", "message", pick(False, "node_ids"), pick(True, "edge_ids"), "details")
    n = every.groupBy("severity").agg(F.count("*").alias("rows"), F.count_distinct("message").alias("texts")).collect()
    by = {r.severity: r for r in n}
    texts = {s: [r.message for r in every.filter(F.col("severity") == s).select("message").distinct().orderBy("message").limit(MESSAGES).collect()] if s in by else [] for s in SEVERITIES}
    for s in by:
        if by[s].texts > MESSAGES:
            texts[s].append(f"... and {by[s].texts - MESSAGES} more")
    metrics = {"n_nodes": sum(facts.types.values()), "n_samples": facts.types.get("Sample", 0), "n_edges": sum(facts.relations.values()), "n_issues": sum(r.rows for r in n)} | {f"n_{'advisories' if s == 'advisory' else s + 's'}": by[s].texts if s in by else 0 for s in SEVERITIES}
    report = Report("error" not in by, table, metrics, {"levels": list(levels), "severities": list(severities), "validation_overrides": overrides}, texts["error"], texts["warning"], texts["advisory"], heads, members)
    if error_on_fail and not report.valid:
        raise DepGraphError("Dependency graph validation failed: " + "; ".join(report.errors[:20]))
    return report


def validate_depgraph(graph: DependencyGraph, **options: Any) -> Report:
    deprecated("validate_depgraph", "validate_graph")
    return validate_graph(graph, **options)


