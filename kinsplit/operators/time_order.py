"""Order of timepoints. They are few: their graph is read to the driver behind a size check."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import functions as F

from kinsplit.functions.schema import check
from kinsplit.model import DependencyGraph

MOST_TIMEPOINTS = 100_000


@dataclass
class Consistency:
    self_loops: list[tuple[str, str]] = field(default_factory=list)  # edge id, node
    cycle: bool = False
    precedes: list[tuple[str, str, str]] = field(default_factory=list)  # edge id, from, to
    conflicts: list[tuple[str, str, str]] = field(default_factory=list)
    index: dict[str, float | None] = field(default_factory=dict)


def topological(nodes: list[str], pairs: list[tuple[str, str]]) -> list[str] | None:
    """Nodes in an order that all pairs agree with, ties by the list's order; None for a cycle."""
    waits = dict.fromkeys(nodes, 0)
    after: dict[str, list[str]] = {n: [] for n in nodes}
    for a, b in pairs:
        after[a].append(b)
        waits[b] += 1
    queue = [n for n in nodes if not waits[n]]
    for n in queue:  # grows while it is read
        for m in after[n]:
            waits[m] -= 1
            if not waits[m]:
                queue.append(m)
    return queue if len(queue) == len(nodes) else None


def consistency(graph: DependencyGraph) -> Consistency:
    """Self loops, cycles and precedence against ``time_index`` over the whole graph."""
    times = graph.of_type("Timepoint").select("node_id", F.expr("try_variant_get(attrs, '$.time_index', 'double')").alias("i")).orderBy("node_id").limit(MOST_TIMEPOINTS + 1).collect()
    check(len(times) <= MOST_TIMEPOINTS, f"More than {MOST_TIMEPOINTS} timepoints")
    edges = graph.relation("timepoint_precedes").orderBy(F.coalesce("ord", F.lit(2**62)), "edge_id").select("edge_id", "from", "to").limit(MOST_TIMEPOINTS * 10 + 1).collect()
    check(len(edges) <= MOST_TIMEPOINTS * 10, "Too many timepoint_precedes edges")
    out = Consistency(index={r.node_id: r.i for r in times})
    out.self_loops = [(e[0], e[1]) for e in edges if e[1] == e[2]]
    out.precedes = [tuple(e) for e in edges if e[1] != e[2]]
    ids = list(dict.fromkeys([*out.index, *(x for e in out.precedes for x in e[1:])]))
    out.cycle = topological(ids, [(e[1], e[2]) for e in out.precedes]) is None
    known = lambda n: out.index.get(n)
    out.conflicts = [e for e in out.precedes if known(e[1]) is not None and known(e[2]) is not None and known(e[1]) >= known(e[2])]
    return out


@dataclass
class TimeOrder:
    rank: dict[str, int | None]
    index: dict[str, float | None]
    source: str
    warnings: list[str]


def time_order(graph: DependencyGraph, used: list[str]) -> TimeOrder:
    """Ranks of the timepoints in use: by index, else by precedence, else as far as indices go."""
    state = consistency(graph)
    check(not state.self_loops and not state.cycle, "Time ordering metadata are inconsistent: `timepoint_precedes` must define an acyclic ordering.")
    check(not state.conflicts, "Time ordering metadata conflict between `time_index` and `timepoint_precedes`: " + ", ".join(f"{a} -> {b}" for _, a, b in state.conflicts))
    used = sorted(used)
    index = {n: state.index.get(n) for n in used}
    if not used:
        return TimeOrder({}, {}, "none", [])
    known = sorted({v for v in index.values() if v is not None})
    dense = {n: known.index(v) + 1 if v is not None else None for n, v in index.items()} if len(known) < 1000 else _dense(index, known)
    if all(v is not None for v in index.values()):
        return TimeOrder(dense, index, "time_index", [])
    among = set(used)
    pairs = [(a, b) for _, a, b in state.precedes if a in among and b in among]
    if pairs and (order := topological(used, pairs)):
        return TimeOrder({n: k + 1 for k, n in enumerate(order)}, index, "timepoint_precedes", [])
    note = "only partially available because some timepoints are missing `time_index` values." if known else "unavailable because neither `time_index` metadata nor usable `timepoint_precedes` edges were found."
    return TimeOrder(dense, index, "partial", [f"Time ordering is {note}"])


def _dense(index: dict[str, float | None], known: list[float]) -> dict[str, int | None]:
    rank = {v: k + 1 for k, v in enumerate(known)}
    return {n: rank[v] if v is not None else None for n, v in index.items()}
