"""Split constraints: which samples belong together, and in which order."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsplit.functions.columns import first_ids, listing
from kinsplit.functions.schema import MODE_TYPE, MODES, SAMPLE_RELATION, DepGraphError, check
from kinsplit.model import DependencyGraph, SplitConstraint, counts
from kinsplit.operators.query import Ids, detect_dependency_components, sample_nodes
from kinsplit.operators.time_order import MOST_TIMEPOINTS, TimeOrder, time_order
from kinsplit.plans.scratch import stored

#: Targets of a mode that are broadcast at most.
FEW_TARGETS = 100_000
_MAP = ("sample_id", "sample_node_id", "group_id", "constraint_type", "group_label", "explanation")


def normalize_mode(name: str) -> str:
    """A mode from its own name or its node type's, in any case."""
    low = str(name).lower()
    for mode, kind in MODE_TYPE.items():
        if low in (mode, kind.lower()):
            return mode
    raise DepGraphError(f"Unsupported constraint mode: {name}")


def _modes(names: Sequence[str]) -> list[str]:
    out = list(dict.fromkeys(normalize_mode(n) for n in names))
    check(bool(out), "At least one mode is needed")
    return out


@dataclass(frozen=True)
class Assignments:
    """sample_id, sample_node_id and, for each mode, ``<mode>_id`` and ``<mode>_key`` of its target; and warnings by mode."""

    df: DataFrame
    notes: dict[str, list[str]]

    def table(self, mode: str) -> DataFrame:
        return self.df.select("sample_id", "sample_node_id", F.col(f"{mode}_id").alias("target_id"), F.col(f"{mode}_key").alias("target_key"))


def direct_assignments(graph: DependencyGraph, modes: Sequence[str], samples: Ids = None, noted: bool = True) -> Assignments:
    """The target of every sample in each mode, in one pass over the edges.

    More than one edge of a mode's relation raises, but for subjects if the graph's
    ``allow_multi_subject_samples`` is True: then the edge of the lowest position (``ord``)
    counts, which is the first listed one if the edges were numbered in the order of the
    rows (``order_by``); without positions the least target. The table is written once, as
    the checks and what follows read it several times. ``noted=False`` lists no warnings.
    """
    kinds = {m: MODE_TYPE[m] for m in modes}
    asked = sample_nodes(graph, samples)
    edges = graph.edges.filter(F.col("edge_type").isin([SAMPLE_RELATION[k] for k in kinds.values()]))
    if samples is not None:
        edges = edges.join(asked, F.col("from") == F.col("sample_node_id"), "left_semi")
    relation = F.create_map(*[F.lit(x) for k in kinds.values() for x in (k, SAMPLE_RELATION[k])])
    targets = stored(graph.nodes.filter(F.col("node_type").isin(list(kinds.values()))).select(relation[F.col("node_type")].alias("edge_type"), F.col("node_id").alias("to"), F.col("node_key").alias("key")))
    facts = []
    for mode, kind in kinds.items():
        own = F.col("edge_type") == SAMPLE_RELATION[kind]
        facts += [F.count_if(own).alias(f"{mode}_n"), F.min(F.when(own, F.struct(F.coalesce("ord", F.lit(2**62)).alias("ord"), "to", "key"))).alias(f"{mode}_first")]
    # Few targets have many edges each, which would meet in one task, so they are broadcast.
    sizes = counts(targets, "edge_type")
    few = F.col("edge_type").isin([r for r in map(SAMPLE_RELATION.get, kinds.values()) if sizes.get(r, 0) <= FEW_TARGETS])
    keyed = edges.filter(few).join(F.broadcast(targets.filter(few)), ["edge_type", "to"], "left")
    if any(n > FEW_TARGETS for n in sizes.values()):
        keyed = keyed.unionByName(edges.filter(~few).join(targets.filter(~few), ["edge_type", "to"], "left"))
    first = keyed.select("from", "edge_type", "to", "key", "ord").repartition("from").groupBy(F.col("from").alias("sample_node_id")).agg(*facts)
    columns = [c for m in kinds for c in (F.col(f"{m}_first.to").alias(f"{m}_id"), F.col(f"{m}_first.key").alias(f"{m}_key"), f"{m}_n")]
    assigned = stored(asked.join(first, "sample_node_id", "left").select("sample_id", "sample_node_id", *columns))
    seen = assigned.agg(*[c for m in kinds for c in (F.count_if(F.col(f"{m}_n") > 1).alias(f"{m}_several"), F.count_if(F.col(f"{m}_key").isNull()).alias(f"{m}_missing"))]).first()
    notes: dict[str, list[str]] = {m: [] for m in kinds}
    for mode in kinds:
        if seen[f"{mode}_missing"] and noted:
            word = "timepoint" if mode == "time" else mode
            notes[mode].append(f"Samples missing {word} assignments were retained as singleton groups: {listing(*first_ids(assigned.filter(f'{mode}_key is null'), 'sample_id'))}")
        if seen[f"{mode}_several"]:
            several = listing(*first_ids(assigned.filter(f"{mode}_n > 1"), "sample_id"))
            if mode != "subject" or graph.metadata.get("validation_overrides", {}).get("allow_multi_subject_samples") is not True:
                raise DepGraphError(f"Multiple {mode} assignments found for sample(s): {several}")
            notes[mode].append(f"Samples linked to multiple subjects were assigned to their first listed subject (allow_multi_subject_samples override): {several}")
    return Assignments(assigned.drop(*[f"{m}_n" for m in kinds]), notes)


def sample_map(assigned: DataFrame, mode: str) -> DataFrame:
    """The six columns of a sample map from direct assignments."""
    relation, linked = SAMPLE_RELATION[MODE_TYPE[mode]], F.col("target_key").isNotNull()
    return assigned.select(
        "sample_id",
        "sample_node_id",
        F.when(linked, F.concat(F.lit(f"{mode}:"), "target_key")).otherwise(F.concat(F.lit(f"{mode}:unlinked:"), "sample_id")).alias("group_id"),
        F.lit(mode).alias("constraint_type"),
        F.when(linked, F.col("target_key")).otherwise(F.concat(F.lit("unlinked_"), "sample_id")).alias("group_label"),
        F.when(linked, F.concat(F.lit(f"Grouped by {mode} through {relation} -> "), "target_key", F.lit("."))).otherwise(f"No {mode} assignment was available; sample retained as an unlinked singleton group.").alias("explanation"),
        *[c for c in ("target_id", "target_key") if c in assigned.columns],
    )


def _with_time(graph: DependencyGraph, assigned: DataFrame) -> tuple[DataFrame, TimeOrder]:
    """Time assignments with timepoint_id, time_index and order_rank."""
    used = [r.target_id for r in assigned.filter("target_id is not null").select("target_id").distinct().limit(MOST_TIMEPOINTS + 1).collect()]
    check(len(used) <= MOST_TIMEPOINTS, f"More than {MOST_TIMEPOINTS} timepoints")
    order = time_order(graph, used)
    rows = [(n, order.index[n], order.rank.get(n)) for n in used]
    ranks = assigned.sparkSession.createDataFrame(rows, "target_id string, time_index double, order_rank int")
    # One row for each timepoint in use, whose number is checked above.
    return assigned.join(F.broadcast(ranks), "target_id", "left").withColumn("timepoint_id", F.col("target_key")), order


def _args(block: str | None = None, time: str | None = None, ordered: bool = False) -> dict[str, Any]:
    return {"group_var": "group_id", "block_var": block, "time_var": time, "ordering_required": ordered}


def _ordering(frame: DataFrame) -> tuple[bool, bool]:
    """Whether any and whether all rows have a rank."""
    n = frame.agg(F.count("*").alias("n"), F.count("order_rank").alias("k")).first()
    return n.k > 0, n.n > 0 and n.k == n.n


def _metadata(mode: str, relations: list[str], notes: list[str], **more: Any) -> dict[str, Any]:
    return {"mode": mode, "relations_used": relations, "warnings": notes} | more


def _direct(graph: DependencyGraph, mode: str, samples: Ids, found: Assignments | None = None) -> SplitConstraint:
    found = found or direct_assignments(graph, [mode], samples)
    assigned, notes = found.table(mode), found.notes[mode]
    relations = [SAMPLE_RELATION[MODE_TYPE[mode]]]
    if mode != "time":
        table = sample_map(assigned, mode).select(*_MAP)
        return SplitConstraint(mode, table, _args("group_id" if mode in ("batch", "study") else None), _metadata(mode, relations, notes))
    timed, order = _with_time(graph, assigned)
    own = timed.select("sample_id", "time_index", "timepoint_id", "order_rank")
    table = sample_map(assigned, mode).select(*_MAP).join(own, "sample_id").select(*_MAP, "time_index", "timepoint_id", "order_rank")
    if order.source == "timepoint_precedes":
        relations.append("timepoint_precedes")
    some, all_ = _ordering(own)
    return SplitConstraint(mode, table, _args(time="order_rank" if some else None, ordered=all_), _metadata(mode, relations, notes + order.warnings, time_order_source=order.source))


def _strict(graph: DependencyGraph, samples: Ids, via: Sequence[str]) -> SplitConstraint:
    """Groups are components of the whole graph; a subset of samples filters rows afterwards."""
    modes = _modes(via)
    kinds = [MODE_TYPE[m] for m in modes]
    found = detect_dependency_components(graph, kinds).df
    if samples is not None:
        found = found.join(sample_nodes(graph, samples).select("sample_node_id"), "sample_node_id", "left_semi")
    relations = [SAMPLE_RELATION[k] for k in kinds]
    table = found.select("sample_id", "sample_node_id", F.col("component_id").alias("group_id"), F.lit("composite_strict").alias("constraint_type"), F.col("component_id").alias("group_label"), F.lit(f"Strict composite grouping via transitive closure over: {', '.join(kinds)}.").alias("explanation"), "component_size")
    n = table.agg(F.count("*").alias("n"), F.count_if(F.col("component_size") == 1).alias("single")).first()
    notes = ["Most strict composite groups are singletons; dependency coverage may be sparse."] if n.n and n.single / n.n > 0.5 else []
    return SplitConstraint("strict", table.select(*_MAP), _args(), _metadata("composite", relations, notes, via=kinds))


def _rule_based(graph: DependencyGraph, samples: Ids, via: Sequence[str], priority: Sequence[str] | None) -> SplitConstraint:
    """The first mode in order of priority that links a sample decides its group."""
    modes = _modes(via)
    order = _modes(priority) if priority is not None else modes
    check(set(order) <= set(modes), "`priority` must be a subset of `via`")
    notes, timing = [], None
    found = direct_assignments(graph, order, samples, noted=False)
    table = found.df.withColumnsRenamed({f"{m}_key": f"_{m}" for m in order})
    if "time" in order:
        timed, timing = _with_time(graph, found.table("time"))
        table = table.join(timed.select("sample_node_id", "time_index", "timepoint_id", "order_rank"), "sample_node_id", "left")
    key, label = F.coalesce(*[F.col(f"_{m}") for m in order]), F.lit(None).cast("string")
    for m in reversed(order):
        label = F.when(F.col(f"_{m}").isNotNull(), F.lit(m)).otherwise(label)
    table = table.withColumns({"_key": key, "_mode": label})
    others = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"_{m}").isNotNull() & (F.col("_mode") != m), F.concat(F.lit(f"{m}="), F.col(f"_{m}"))) for m in order])), ", ")
    rule = " > ".join(order)
    text = F.concat(F.lit("Composite rule-based grouping selected "), "_mode", F.lit(f" based on priority order {rule} -> "), "_key", F.lit("."), F.when(others != "", F.concat(F.lit(" Additional available dependencies: "), others, F.lit("."))).otherwise(""))
    linked = F.col("_key").isNotNull()
    none: Column = F.lit(None)
    time_columns = {"time_index": "double", "timepoint_id": "string", "order_rank": "int"}
    table = table.select(
        "sample_id",
        "sample_node_id",
        F.when(linked, F.concat(F.lit("composite_"), "_mode", F.lit(":"), "_key")).otherwise(F.concat(F.lit("composite:unlinked:"), "sample_id")).alias("group_id"),
        F.coalesce("_mode", F.lit("unlinked")).alias("constraint_type"),
        F.coalesce("_key", F.concat(F.lit("unlinked_"), "sample_id")).alias("group_label"),
        F.when(linked, text).otherwise("No prioritized dependency assignment was available; sample retained as a singleton group.").alias("explanation"),
        *[F.col(c) if timing else none.cast(k).alias(c) for c, k in time_columns.items()],
    )
    ids, n = first_ids(table.filter("constraint_type = 'unlinked'"), "sample_id")
    if ids:
        notes.append(f"Some samples did not match any prioritized dependency and were retained as singleton groups: {listing(ids, n)}")
    relations = [SAMPLE_RELATION[MODE_TYPE[m]] for m in order]
    some, all_ = False, False
    if timing:
        some, all_ = _ordering(table)
    return SplitConstraint("rule_based", table, _args(time="order_rank" if some else None, ordered=all_), _metadata("composite", relations, notes, via=modes, priority=order))


def derive_split_constraints(graph: DependencyGraph, mode: str = "subject", samples: Ids = None, strategy: str = "strict", via: Sequence[str] = MODES, priority: Sequence[str] | None = None, include_warnings: bool = True, assigned: Assignments | None = None) -> SplitConstraint:
    """The constraint of a mode (subject, batch, study, time or composite).

    Modes that read parts of the graph in several places compute these once; with a subset
    of samples that is the whole graph (``graph.stored``). ``assigned`` are the direct
    assignments of a mode, found in a graph of the same samples, targets and edges between them: graphs
    that differ in what their timepoints tell need not find them again.
    """
    low = str(mode).lower()
    check(assigned is None or (low != "composite" and samples is None), "`assigned` is for a direct mode of all samples")
    if assigned is None and (low in ("time", "timepoint") or (low == "composite" and strategy == "rule_based")):
        # Samples and their edges are read once.
        graph = graph.partly_stored(["Timepoint"], ["timepoint_precedes"]) if samples is None else graph.stored
    if str(mode).lower() == "composite":
        check(strategy in ("strict", "rule_based"), "strategy must be strict or rule_based")
        out = _strict(graph, samples, via) if strategy == "strict" else _rule_based(graph, samples, via, priority)
    else:
        out = _direct(graph, normalize_mode(mode), samples, assigned)
    return out if include_warnings else SplitConstraint(out.strategy, out.df, out.recommended_downstream_args, out.metadata | {"warnings": []})


def grouping_vector(constraint: SplitConstraint) -> DataFrame:
    """sample_id and group_id."""
    return constraint.grouping_vector()


def deprecated(old: str, new: str) -> None:
    warnings.warn(f"`{old}` is deprecated; use `{new}`", DeprecationWarning, stacklevel=3)
