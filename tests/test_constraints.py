import json

import pytest
from fixtures import F1, F3, graph, rows

from kinsplit.functions.schema import DepGraphError
from kinsplit.operators import folds
from kinsplit.operators.constraints import derive_split_constraints, grouping_vector
from kinsplit.operators.split_spec import as_split_spec, summarize_leakage_risks, validate_split_spec
from kinsplit.operators.validate import validate_graph
from kinsplit.sources import serialization as io

INDEX = {"T0": 0.0, "T1": 1.0, "T2": 2.0}


@pytest.fixture(scope="module")
def g(spark):
    return graph(spark, F1, times=INDEX).persist()


def groups(constraint, *more):
    return rows(constraint.df, "sample_id", "group_id", *more)


def test_direct(g):
    subject = derive_split_constraints(g, "subject")
    assert groups(subject) == [("S1", "subject:P1"), ("S2", "subject:P1"), ("S3", "subject:P2"), ("S4", "subject:P3"), ("S5", "subject:P4")]
    assert rows(grouping_vector(subject)) == groups(subject)
    batch = derive_split_constraints(g, "batch")
    assert groups(batch)[4] == ("S5", "batch:unlinked:S5")
    assert batch.warnings == ["Samples missing batch assignments were retained as singleton groups: S5"]
    assert derive_split_constraints(g, "batch", include_warnings=False).warnings == []
    assert rows(derive_split_constraints(g, "study", samples=["S1", "sample:S4"]).df, "sample_id") == [("S1",), ("S4",)]
    with pytest.raises(DepGraphError, match="Unknown sample IDs: BAD"):
        derive_split_constraints(g, "study", samples=["S1", "BAD"])


def test_time_sources(spark, g):
    key = lambda c: {r.sample_id: (r.group_id, r.time_index, r.order_rank) for r in c.df.collect()}
    c = derive_split_constraints(g, "time")
    assert key(c) == {"S1": ("time:T0", 0.0, 1), "S2": ("time:T1", 1.0, 2), "S3": ("time:T0", 0.0, 1), "S4": ("time:T2", 2.0, 3), "S5": ("time:unlinked:S5", None, None)}
    assert c.metadata["time_order_source"] == "time_index" and not c.recommended_downstream_args["ordering_required"]
    p = derive_split_constraints(graph(spark, F1, precedes=[("T0", "T1"), ("T1", "T2")]), "time")
    assert p.metadata["time_order_source"] == "timepoint_precedes" and key(p)["S4"] == ("time:T2", None, 3)
    m = derive_split_constraints(graph(spark, F1), "time")
    assert m.metadata["time_order_source"] == "partial" and m.recommended_downstream_args["time_var"] is None and len(m.warnings) == 2


def test_time_errors(spark):
    with pytest.raises(DepGraphError, match="Time ordering metadata conflict"):
        derive_split_constraints(graph(spark, F1, times={"T0": 2.0, "T1": 1.0, "T2": 3.0}, precedes=[("T0", "T1")]), "time")
    with pytest.raises(DepGraphError, match="acyclic"):
        derive_split_constraints(graph(spark, F1, precedes=[("T0", "T1"), ("T1", "T2"), ("T2", "T0")]), "time")


def test_composite(g):
    strict = derive_split_constraints(g, "composite", via=["Subject", "Batch"])
    assert [x[1] for x in groups(strict)] == ["component_1"] * 3 + ["component_2", "component_3"] and strict.warnings == []
    assert [x[1] for x in groups(derive_split_constraints(g, "composite"))] == ["component_1"] * 4 + ["component_2"]
    rule = derive_split_constraints(g, "composite", strategy="rule_based", priority=["batch", "study", "subject", "time"])
    assert [x[1] for x in groups(rule)] == ["composite_batch:B1", "composite_batch:B2", "composite_batch:B1", "composite_batch:B3", "composite_study:ST3"]
    text = rule.df.filter("sample_id = 'S1'").first().explanation
    assert text == "Composite rule-based grouping selected batch based on priority order batch > study > subject > time -> B1. Additional available dependencies: study=ST1, subject=P1, time=T0."
    with pytest.raises(DepGraphError):
        derive_split_constraints(g, "composite", strategy="rule_based", via=["batch"], priority=["study"])


def test_ambiguous(spark):
    g = graph(spark, [*F1, ("S1", "P9", "B9", "ST1", "T0")], times=INDEX)
    with pytest.raises(DepGraphError, match="Multiple batch assignments found for sample\\(s\\): S1"):
        derive_split_constraints(g, "batch")
    g.metadata["validation_overrides"] = {"allow_multi_subject_samples": True}
    c = derive_split_constraints(g, "subject")
    assert groups(c)[0] == ("S1", "subject:P1") and len(c.warnings) == 1


def test_spec_and_json(spark, g, tmp_path):
    spec = as_split_spec(derive_split_constraints(g, "batch"), g)
    assert dict(rows(spec.df, "sample_id", "batch_group"))["S5"] == "unlinked_S5"
    spec = as_split_spec(derive_split_constraints(g, "subject"), g)
    assert dict(rows(spec.df, "sample_id", "batch_group"))["S5"] is None
    assert spec.block_vars == ["batch_group", "study_group"] and spec.time_var == "order_rank" and spec.recommended_resampling == "grouped_cv"
    assert validate_split_spec(spec).valid
    path = io.write_split_spec(spec, str(tmp_path / "spec.json"))
    back = io.read_split_spec(spark, path)
    key = lambda r: r[0]
    assert sorted(map(tuple, back.df.collect()), key=key) == sorted(map(tuple, spec.df.select(*back.df.columns).collect()), key=key)
    assert back.block_vars == spec.block_vars and back.group_var == "group_id"
    with pytest.raises(DepGraphError):
        io.read_dependency_graph(spark, path)
    with pytest.raises(DepGraphError, match="Directory"):
        io.write_split_spec(spec, str(tmp_path / "none" / "spec.json"))


def test_preflight(spark, g):
    spec = as_split_spec(derive_split_constraints(g, "subject"))
    bad = spec.__class__(spec.df.unionByName(spec.df.limit(1)), "group_id", ["nothing"], None, True, "subject", "subject", "grouped_cv")
    assert [r.code for r in validate_split_spec(bad).df.orderBy("issue_id").collect()] == ["duplicate_sample_id", "invalid_time_var", "invalid_block_var"]


def test_graph_round_trips(spark, g, tmp_path):
    path = io.write_dependency_graph(g, str(tmp_path / "g.json"))
    back = io.read_dependency_graph(spark, path)
    cols = ("node_id", "node_type", "node_key", "label", "to_json(attrs)")
    assert sorted(map(tuple, g.nodes.selectExpr(*cols).collect())) == sorted(map(tuple, back.nodes.selectExpr(*cols).collect()))
    assert rows(g.edges, "edge_id", "from", "to", "edge_type", "ord") == rows(back.edges, "edge_id", "from", "to", "edge_type", "ord")
    data = json.loads(open(path).read())
    data["schema_version"] = "9.9"
    (tmp_path / "v.json").write_text(json.dumps(data))
    with pytest.warns(UserWarning, match="schema version"):
        io.read_dependency_graph(spark, str(tmp_path / "v.json"))
    for attrs, message in ((["x"], "named lists"), ("x", "named lists")):
        (tmp_path / "a.json").write_text(json.dumps({**data, "schema_version": "0.1.0", "nodes": [{**data["nodes"][0], "attrs": attrs}]}))
        with pytest.raises(DepGraphError, match=message):
            io.read_dependency_graph(spark, str(tmp_path / "a.json"))
    (tmp_path / "r.json").write_text(open(path).read().replace('"attrs": {}', '"attrs": {"x": 1, "x": 2}', 1))
    with pytest.raises(DepGraphError, match="Repeated names"):
        io.read_dependency_graph(spark, str(tmp_path / "r.json"))
    g.metadata["validation_overrides"] = {"allow_multi_subject_samples": True}
    io.write_graph_parquet(g, str(tmp_path / "g"))
    kept = io.read_graph_parquet(spark, str(tmp_path / "g"), {"dataset_name": "other"}).metadata
    assert kept["validation_overrides"] == {"allow_multi_subject_samples": True} and kept["created_at"] == g.metadata["created_at"] and kept["dataset_name"] == "other"
    assert rows(io.read_graph_parquet(spark, str(tmp_path / "g")).edges, "edge_id") == rows(g.edges, "edge_id")


def test_workflow_summary(spark):
    g = graph(spark, F3, times=INDEX, precedes=[("T0", "T1"), ("T1", "T2")], scopes={"FS_GLOBAL": "per_dataset", "FS_PROT": "external"}).persist()
    report = validate_graph(g)
    found = [(r.code, r.node_ids[0]) for r in report.df.orderBy("issue_id").collect()]
    assert found == [("repeated_subject_samples", "subject:P1"), ("repeated_subject_samples", "subject:P2"), ("subject_cross_study_overlap", "subject:P2"), ("per_dataset_featureset", "featureset:FS_GLOBAL"), ("shared_featureset_provenance", "featureset:FS_GLOBAL"), ("heavy_batch_reuse", "batch:B1")]
    strict = derive_split_constraints(g, "composite", via=["Subject", "Batch"])
    risk = summarize_leakage_risks(g, strict, as_split_spec(strict, g), report)
    assert risk.overview == "Detected 12 structural leakage diagnostics across validation, constraint, and split-spec readiness."
    found = {(r.category, r.n_affected) for r in risk.df.filter("source <> 'validation'").collect()}
    assert found == {("singleton_heavy_constraint", 2), ("split_spec_ready", 6), ("ordering_available", 5), ("blocking_available", 5), ("blocking_available", 6), ("split_spec_singleton_heavy", 2)}


def test_folds(spark, g):
    spec = as_split_spec(derive_split_constraints(g, "study"), g)
    logo = folds.leave_one_group_out(spec)
    assert logo.count() == 15 and rows(logo.filter("role = 'assess'"), "fold", "sample_id") == [("study:ST1", "S1"), ("study:ST1", "S2"), ("study:ST2", "S3"), ("study:ST2", "S4"), ("study:ST3", "S5")]
    assert rows(folds.rolling_origin(spec)) == [(1, 2, 3, 3), (2, 3, 4, 4)]
    assert rows(folds.ordered_samples(spec)) == [(1, "S1"), (2, "S3"), (3, "S2"), (4, "S4")]
    assert folds.grouped_folds(spec, 3).join(spec.df, "sample_id").groupBy("group_id").agg({"fold": "min"}).count() == 3


def test_json_rows_are_read_by_tasks(spark, g, tmp_path, monkeypatch):
    """the driver holds no rows, neither as it writes nor as it reads."""
    path = io.write_dependency_graph(g, str(tmp_path / "g.json"))
    spec = io.write_split_spec(as_split_spec(derive_split_constraints(g, "batch"), g), str(tmp_path / "spec.json"))
    nodes = json.loads(open(path).read())["nodes"]
    monkeypatch.setattr(io.json, "load", lambda *_, **__: pytest.fail("the driver parses rows"))
    back = io.read_dependency_graph(spark, path)
    assert [(r.node_id, r.label) for r in back.nodes.orderBy("node_type", "node_id").collect()] == [(n["node_id"], n["label"]) for n in nodes]
    assert back.edges.count() == g.edges.count() and io.read_split_spec(spark, spec).df.count() == g.of_type("Sample").count()


def test_many_and_few_targets(spark, g, monkeypatch):
    """few targets, which many samples share, are broadcast; more are joined, with the same rows."""
    from kinsplit.operators import constraints

    few = groups(derive_split_constraints(g, "composite", strategy="rule_based"), "explanation")
    monkeypatch.setattr(constraints, "FEW_TARGETS", 3)
    assert groups(derive_split_constraints(g, "composite", strategy="rule_based"), "explanation") == few
    plan = lambda: constraints.direct_assignments(g, ["batch"]).df.count()
    hints = []
    monkeypatch.setattr(constraints.F, "broadcast", lambda df: hints.append(df.count()) or df)
    plan()
    assert hints == [3]


def test_partitions_follow_the_input(spark, tmp_path, monkeypatch):
    """With a fixed number of partitions a task's memory grows with the input."""
    from kinsplit.plans import skew

    spark.range(1000).write.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(skew, "PART_BYTES", 500)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        skew.room_for(spark.range(3).join(spark.createDataFrame([(1,)], "id long"), "id"))
        assert spark.conf.get("spark.sql.shuffle.partitions") == before
        skew.room_for(spark.read.parquet(str(tmp_path / "t")))
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) > int(before)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_stored_graphs_make_ids_again(spark):
    """ids made of an edge's columns are not written; others, and missing ones, come back as they were."""
    from kinsplit.operators.build import dependency_graph

    edges = spark.createDataFrame([("r:a->b", "a", "b", "r"), ("r:1", "a", "b", "r"), (None, "a", "c", "r"), (None, None, "c", "r")], "edge_id string, `from` string, `to` string, edge_type string")
    nodes = spark.createDataFrame([("a", "Sample", "a", "a"), ("b", "Sample", "b", "other"), ("c", "Sample", "c", None)], "node_id string, node_type string, node_key string, label string")
    kept = dependency_graph(nodes, edges).stored
    key = lambda r: tuple(map(str, r))
    for got, want in ((kept.edges, edges), (kept.nodes, nodes)):
        assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_time_order_writes_no_samples(spark, g, monkeypatch):
    """samples and their edges are read once for an order in time, so the graph is not written; nor are they assigned again."""
    from kinsplit.model import DependencyGraph
    from kinsplit.operators.constraints import direct_assignments

    names = ("group_id", "group_label", "time_index", "timepoint_id", "order_rank")
    want = {how: groups(derive_split_constraints(g.stored, *how), *names[:1]) for how in (("time",), ("composite", None, "rule_based"))}
    ranks = rows(derive_split_constraints(g.stored, "time").df.filter("order_rank is not null"), "sample_id", *names)
    lazy = DependencyGraph(g.nodes, g.edges, g.metadata)
    monkeypatch.setattr(DependencyGraph, "stored", property(lambda _: pytest.fail("the whole graph is written")))
    assert {how: groups(derive_split_constraints(lazy, *how), *names[:1]) for how in want} == want
    found = direct_assignments(lazy, ["time"])
    monkeypatch.setattr("kinsplit.operators.constraints.direct_assignments", lambda *_, **__: pytest.fail("assigned again"))
    again = derive_split_constraints(lazy, "time", assigned=found)
    assert rows(again.df.filter("order_rank is not null"), "sample_id", *names) == ranks and again.warnings == found.notes["time"]
    with pytest.raises(DepGraphError, match="direct mode"):
        derive_split_constraints(lazy, "time", ["S1"], assigned=found)


def test_graphs_of_the_same_samples_assign_once(spark, tmp_path, monkeypatch):
    """time_order_sources asked for the timepoint of every sample four times."""
    from kinsplit import graph_queries
    from kinsplit.operators import constraints

    spark.sql("select id as o_orderkey, id % 3 as o_custkey, add_months(date'2020-01-05', cast(id as int)) as o_orderdate, 'p' as o_orderpriority, 'F' as o_orderstatus from range(8)").write.parquet(str(tmp_path / "orders.parquet"))
    spark.sql("select id as c_custkey, 1 as c_nationkey, 's' as c_mktsegment from range(3)").write.parquet(str(tmp_path / "customer.parquet"))
    own, calls = constraints.direct_assignments, []
    counted = lambda *args, **options: calls.append(args) or own(*args, **options)
    for module in (constraints, graph_queries):
        monkeypatch.setattr(module, "direct_assignments", counted, raising=False)
    got = rows(graph_queries.time_order_sources(spark, str(tmp_path)))
    assert got == [("index", "time_index", "order_rank", True, 0), ("none", "partial", None, False, 1), ("partial", "partial", "order_rank", False, 1), ("precedence", "timepoint_precedes", "order_rank", True, 0)]
    assert len(calls) == 1
