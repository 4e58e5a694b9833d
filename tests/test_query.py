import math
import random

import pytest
from fixtures import F2, graph, rows

from kinsplit.functions.schema import DepGraphError
from kinsplit.operators import query
from kinsplit.operators.paths import query_paths, query_shortest_paths
from kinsplit.plans.components import connected_components


@pytest.fixture(scope="module")
def g(spark):
    return graph(spark, F2, outcomes=[("P1", "O1"), ("P2", "O2"), ("P3", "O3")]).persist()


def test_filters(g):
    assert query.query_node_type(g, "SUBJECT", ["subject:P1", "nobody"]).df.count() == 1
    assert query.query_edge_type(g, "sample_from_study").df.count() == 4
    assert query.query_edge_type(g, "sample_from_study", ["study:ST1"]).df.count() == 2
    with pytest.raises(DepGraphError, match="Unknown node IDs: nobody"):
        query.query_edge_type(g, "sample_from_study", ["nobody"])


def test_neighbors(g):
    out = query.query_neighbors(g, ["sample:S1"], ["sample_belongs_to_subject"])
    assert rows(out.df, "node_id", "node_type", "direction") == [("subject:P1", "Subject", "out")]
    assert rows(query.query_neighbors(g, ["subject:P1"], direction="in").df, "node_id") == [("sample:S1",), ("sample:S2",)]
    assert query.query_neighbors(g, ["subject:P1"], direction="all").df.count() == 3


def test_shared(g):
    pairs = lambda via: rows(query.detect_shared_dependencies(g, [via]).df, "sample_id_1", "sample_id_2", "shared_node_id")
    assert pairs("Subject") == [("S1", "S2", "subject:P1")]
    assert pairs("Batch") == [("S1", "S3", "batch:B1")]
    assert pairs("Study") == [("S1", "S2", "study:ST1"), ("S3", "S4", "study:ST2")]
    assert [p[:2] for p in pairs("Timepoint")] == [("S1", "S3"), ("S1", "S4"), ("S3", "S4")]
    assert query.detect_shared_dependencies(g, ["Study"], samples=["S1", "sample:S3"]).df.count() == 0


def test_components(g):
    out = query.detect_dependency_components(g, ["Subject", "Batch"]).df
    assert rows(out, "sample_id", "component_id", "component_size") == [("S1", "component_1", 3), ("S2", "component_1", 3), ("S3", "component_1", 3), ("S4", "component_2", 1)]
    assert query.detect_dependency_components(g, ["Subject", "Batch"], min_size=2).df.count() == 3
    assert rows(query.project_sample_dependencies(g, ["Subject", "Batch"])) == [("sample:S1", "sample:S2", "projection_1"), ("sample:S1", "sample:S3", "projection_2")]


def test_paths(g):
    want = [("path_1", 1, "sample:S1", None), ("path_1", 2, "subject:P1", "sample_belongs_to_subject"), ("path_1", 3, "outcome:O1", "subject_has_outcome")]
    types = ["sample_belongs_to_subject", "subject_has_outcome"]
    key = lambda r: (r[0], r[1])
    for ask in (query_paths, query_shortest_paths):
        found = ask(g, ["sample:S1"], ["outcome:O1"], types).df.select("path_id", "step", "node_id", "edge_type").collect()
        assert sorted(map(tuple, found), key=key) == want
    assert query_paths(g, ["sample:S1"], ["subject:P1"], max_length=0).df.count() == 0
    assert query_paths(g, ["sample:S1"], ["subject:P1"], max_length=math.inf).df.count() == 2
    assert query_paths(g, ["outcome:O1"], ["sample:S2"], mode="in").df.count() == 3
    assert query_shortest_paths(g, ["sample:S1"], ["sample:S2"], mode="all").df.count() == 3
    assert query_shortest_paths(g, ["sample:S1"], ["sample:S1"]).df.count() == 1
    assert query_paths(g, ["sample:S1"], ["outcome:O1"], node_types=["Sample", "Outcome"]).df.count() == 0
    for bad in (-2, "five", math.nan, -math.inf):
        with pytest.raises(DepGraphError):
            query_paths(g, ["sample:S1"], ["subject:P1"], max_length=bad)


def test_layout(g):
    xs = {r.node_id: (r.layer, round(r.x, 6), r.y) for r in query.typed_layout(g).collect()}
    assert xs["sample:S1"] == (0, -0.5, 0.0) and xs["sample:S4"] == (0, 0.5, 0.0) and xs["outcome:O2"] == (3, 0.0, -3.0)


def test_connected_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(f"v{rng.randrange(400):03}", f"v{rng.randrange(400):03}") for _ in range(260)] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)] + [("a", "a")]
    parent = {v: v for e in edges for v in e}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert rows(connected_components(spark.createDataFrame(edges, "a string, b string"))) == sorted((v, find(v)) for v in parent)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_link_targets_only(spark, monkeypatch):
    """Samples are no vertices; a sample of many targets links them all, one of none stands alone."""
    rng = random.Random(3)
    meta = [(f"S{i:02}", f"P{rng.randrange(12)}", rng.choice([None, f"B{rng.randrange(12)}"]), rng.choice([None, f"X{rng.randrange(9)}"]), None) for i in range(20)]
    g = graph(spark, meta, times={"T0": 0.0})
    parent = {}

    def find(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for s, *targets in meta:
        for t in targets[:3]:
            if t:
                parent[find(max(find(s), find(t)))] = min(find(s), find(t))
    seen = []
    monkeypatch.setattr(query, "connected_components", lambda edges: seen.append(edges) or connected_components(edges))
    monkeypatch.setattr("kinsplit.plans.skew.MOST_ROWS", 2)
    out = query.detect_dependency_components(g, ["Subject", "Batch", "Study"]).df.collect()
    groups = {}
    for s, *_ in meta:
        groups.setdefault(find(s), set()).add(s)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(r.sample_id for r in out if r.component_id == c) for c in {r.component_id for r in out})
    assert all(r.component_size == len(groups[find(r.sample_id)]) for r in out) and len(out) == 20
    assert not [v for r in seen[0].collect() for v in r if v.startswith("sample:")]


def test_keys_of_many_rows_are_dealt(spark, monkeypatch):
    """no task need take all rows of a frequent key."""
    from kinsplit.plans import skew

    monkeypatch.setattr(skew, "MOST_ROWS", 10)
    left = spark.range(60).selectExpr("id", "if(id < 50, 'often', 'rare') k")
    heavy = skew.heavy_keys(left.groupBy("k").count(), "k", "count")
    assert rows(heavy) == [("often", 5)]
    out = skew.dealt_join(left, spark.createDataFrame([("often", 1), ("rare", 2)], "k string, v int"), "k", heavy)
    assert rows(out, "id", "k", "v") == [(i, "often" if i < 50 else "rare", 1 if i < 50 else 2) for i in range(60)]


def test_paths_at_frequent_ends(spark, g, monkeypatch):
    """paths at ends that no arc leaves are not joined again, and frequent ends are dealt."""
    from kinsplit.operators import paths
    from kinsplit.plans import skew

    monkeypatch.setattr(skew, "MOST_ROWS", 1)
    asked = []
    monkeypatch.setattr(paths, "dealt_join", lambda left, *rest: asked.append(left) or skew.dealt_join(left, *rest))
    wide = graph(spark, [(f"S{i}", "P1" if i < 6 else "P2", "B1") for i in range(8)], outcomes=[("P1", "O1"), ("P2", "O1")])
    for ask in (query_paths, query_shortest_paths):
        asked.clear()
        found = ask(wide, [f"sample:S{i}" for i in range(8)], ["outcome:O1"]).df
        assert rows(found.filter("step = 3"), "node_id", "node_type", "edge_type") == [("outcome:O1", "Outcome", "subject_has_outcome")] * 8
        assert not [r for f in asked for r in f.collect() if "tail" in f.columns and getattr(r, "tail", "").startswith("outcome:")]
