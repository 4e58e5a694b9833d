import pytest
from fixtures import graph, rows, table
from pyspark.sql import functions as F

from dataclasses import replace

from kinsplit.functions.schema import NODE_TYPES, DepGraphError
from kinsplit.operators.build import dependency_graph, graph_edge_set, graph_node_set
from kinsplit.operators.validate import validate_graph
from kinsplit.streaming.ingest import stream_edges, stream_nodes


def raw(spark, nodes, edges):
    n = spark.createDataFrame([(i, t, i.split(":")[-1], i, a) for i, t, a in nodes], "node_id string, node_type string, node_key string, label string, attrs map<string,string>")
    e = table(spark, edges, ["edge_id", "from", "to", "edge_type"])
    return dependency_graph(graph_node_set(n), graph_edge_set(e))


def codes(report):
    return [r.code for r in report.df.orderBy("issue_id").collect()]


S, P, B = ("sample:S1", "Sample", {}), ("subject:P1", "Subject", {}), ("batch:B1", "Batch", {})


@pytest.mark.parametrize(
    ("nodes", "edges", "want"),
    [
        ([S, P], [("e1", "sample:S1", "subject:P1", "mystery_relation")], ["unsupported_edge_type"]),
        ([S, P, P], [("e1", "sample:S1", "subject:P1", "sample_belongs_to_subject")], ["duplicate_node_id"]),
        ([S, P], [("e1", "sample:S1", "subject:P1", "sample_belongs_to_subject")] * 2, ["duplicate_edge_id", "duplicate_edge_triplet"]),
        ([S], [("e1", "sample:S1", "subject:P1", "sample_belongs_to_subject")], ["missing_target_node"]),
        ([P], [("e1", "sample:S1", "subject:P1", "sample_belongs_to_subject")], ["missing_source_node"]),
        ([S, B], [("e1", "sample:S1", "batch:B1", "sample_belongs_to_subject")], ["invalid_edge_signature"]),
        ([S, ("assay:A1", "Assay", {}), ("assay:A2", "Assay", {})], [("e1", "sample:S1", "assay:A1", "sample_measured_by_assay"), ("e2", "sample:S1", "assay:A2", "sample_measured_by_assay")], ["single_target_violation"]),
        ([("sample:S1", "Sample", {"custom_field": "1"})], [], ["non_canonical_node_attr"]),
        ([S, ("featureset:F", "FeatureSet", {"derivation_scope": "bad"})], [], ["invalid_featureset_derivation_scope"]),
        ([S, ("outcome:O", "Outcome", {"observation_level": "bad"})], [], ["invalid_outcome_observation_level"]),
        ([S, ("timepoint:T", "Timepoint", {"time_index": "soon"})], [], ["invalid_time_index"]),
        ([S, ("timepoint:T", "Timepoint", {})], [("e", "timepoint:T", "timepoint:T", "timepoint_precedes")], ["timepoint_self_loop"]),
    ],
)
def test_one_code_each(spark, nodes, edges, want):
    assert codes(validate_graph(raw(spark, nodes, edges), levels=["structural", "semantic"])) == want


def test_cycle_and_conflict(spark):
    t = [(f"timepoint:T{i}", "Timepoint", {"time_index": str(3 - i)}) for i in (1, 2, 3)]
    cycle = [(f"e{i}", f"timepoint:T{i}", f"timepoint:T{i % 3 + 1}", "timepoint_precedes") for i in (1, 2, 3)]
    report = validate_graph(raw(spark, [S, *[(n, k, {}) for n, k, _ in t]], cycle))
    assert codes(report) == ["timepoint_precedence_cycle"] and sorted(report.df.first().edge_ids) == ["e1", "e2", "e3"]
    assert codes(validate_graph(raw(spark, [S, *t[:2]], cycle[:1]))) == ["time_order_conflict"]


def test_severities_do_not_change_validity(spark):
    g = raw(spark, [S, ("sample:S2", "Sample", {}), ("study:X", "Study", {}), ("assay:A1", "Assay", {}), ("assay:A2", "Assay", {})], [("e1", "sample:S1", "assay:A1", "sample_measured_by_assay"), ("e2", "sample:S1", "assay:A2", "sample_measured_by_assay"), ("e3", "sample:S1", "study:X", "sample_from_study")])
    report = validate_graph(g, severities=["warning"])
    assert codes(report) == ["sample_missing_study_assignment"] and not report.valid and report.metrics["n_errors"] == 1
    with pytest.raises(DepGraphError, match="validation failed"):
        validate_graph(g, severities=["warning"], error_on_fail=True)
    assert validate_graph(g, levels=["leakage"]).valid
    with pytest.warns(DeprecationWarning):
        assert not validate_graph(g, checks=["cardinality"]).valid


def test_override_for_one_call(spark):
    g = raw(spark, [S, P, ("subject:P2", "Subject", {})], [("e1", "sample:S1", "subject:P1", "sample_belongs_to_subject"), ("e2", "sample:S1", "subject:P2", "sample_belongs_to_subject")])
    assert codes(validate_graph(g)) == ["sample_multiple_subject_assignments"]
    assert validate_graph(g, validation_overrides={"allow_multi_subject_samples": True}).valid
    assert not validate_graph(g, validation_overrides={"allow_multi_subject_samples": "yes"}).valid


def test_missing_time_ordering(spark):
    report = validate_graph(graph(spark, [("S1", "P1", "B1", "X", "T0"), ("S2", "P2", "B2", "X", "T1")]))
    assert codes(report) == ["missing_time_ordering"] and report.summary()["by_severity"] == {"warning": 1}


def test_streaming(spark, tmp_path):
    meta = table(spark, [("S1", "P1"), ("S2", None)], ["sample_id", "subject_id"])
    meta.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(meta.schema).parquet(str(tmp_path / "in"))
    for name, frame in (("nodes", stream_nodes(stream, "Sample", "sample_id")), ("edges", stream_edges(stream, "sample_id", "subject_id", "sample_belongs_to_subject"))):
        q = frame.drop("attrs").writeStream.format("memory").queryName(f"s_{name}").outputMode("append").start()
        q.processAllAvailable()
        q.stop()
    assert rows(spark.table("s_nodes"), "node_id") == [("sample:S1",), ("sample:S2",)]
    assert rows(spark.table("s_edges"), "edge_id") == [("sample_belongs_to_subject:sample:S1->subject:P1",)]


def test_messages_left_out_are_counted(spark, monkeypatch):
    monkeypatch.setattr("kinsplit.operators.validate.MESSAGES", 1, raising=False)
    edges = [("e1", "sample:S1", "subject:P1", "sample_belongs_to_subject"), ("e2", "sample:S1", "batch:B1", "sample_processed_in_batch")] * 2
    report = validate_graph(raw(spark, [S, P, B], edges))
    assert len(report.errors) == 2 and report.errors[1] == f"... and {report.metrics['n_errors'] - 1} more"


def test_required_attributes(spark, monkeypatch):
    monkeypatch.setitem(NODE_TYPES, "Assay", replace(NODE_TYPES["Assay"], required=("modality", "platform")))
    report = validate_graph(raw(spark, [S, ("assay:A1", "Assay", {"modality": "x"}), ("assay:A2", "Assay", {"modality": "x", "platform": "y"})], []), levels=["semantic"])
    assert [(r.code, r.severity, r.message) for r in report.df.collect()] == [("missing_required_node_attr", "error", "Node `assay:A1` is missing required attributes: platform")]


def test_what_issues_name(spark):
    studies = [("study:A", "Study", {}), ("study:B", "Study", {}), ("sample:S2", "Sample", {})]
    edges = [("e1", "sample:S1", "study:A", "sample_from_study"), ("e2", "sample:S1", "study:B", "sample_from_study"), ("e3", "sample:S2", "study:A", "sample_from_study"), ("e4", "sample:S1", "subject:P1", "sample_belongs_to_subject")]
    g = raw(spark, [S, P, *studies], edges)
    found = validate_graph(g).df.selectExpr("code", "node_ids", "edge_ids", "to_json(details) details").collect()
    assert {r.code: (r.node_ids, r.edge_ids, r.details) for r in found} == {
        "sample_multiple_study_assignments": (["sample:S1", "study:A", "study:B"], ["e1", "e2"], '{"edge_type":"sample_from_study"}'),
        "subject_cross_study_overlap": (["subject:P1", "sample:S1"], [], "{}"),
    }


def test_ids_stand_apart_from_issues(spark, monkeypatch):
    """no row need hold all ids of an issue; the issue table still brings them together."""
    from kinsplit.operators import validate

    monkeypatch.setattr(validate, "LISTED", 2)
    samples = [f"sample:S{i}" for i in range(5)]
    edges = [(f"{x}{s}", s, f"subject:{x}", "sample_belongs_to_subject") for s in samples for x in "ab"]
    report = validate_graph(raw(spark, [*[(s, "Sample", {}) for s in samples], ("subject:a", "Subject", {}), ("subject:b", "Subject", {})], edges), levels=["semantic"])
    assert rows(report.sizes(), "code", "n_nodes", "n_edges") == [("sample_multiple_subject_assignments", 7, 10)]
    assert rows(report.members.filter("part < 2"), "part", "id") == [*[(0, s) for s in samples], (1, "subject:a"), (1, "subject:b")]
    issue = report.df.first()
    assert issue.node_ids == [*samples, "subject:a", "subject:b"] and issue.edge_ids == sorted(e for e, *_ in edges)
    assert issue.message.endswith("sample:S0, sample:S1 ... (+3 more)")


def test_found_is_linear_in_the_ids(spark):
    """ids are exploded from rows of their own, not from a list that each row carries."""
    from kinsplit.graph_queries import _found

    report = validate_graph(raw(spark, [S, S, P], [("e1", "sample:S1", "subject:P1", "sample_belongs_to_subject")]), levels=["structural"])
    assert [tuple(r) for r in _found(report).collect()] == [("duplicate_node_id", "error", "sample:S1", None)]
    assert not {"node_ids", "edge_ids"} & set(report.members.columns)


def test_sound_graphs_are_looked_at_once(spark):
    """one grouping by id leaves nothing of a sound graph, so no rule joins edges."""
    from kinsplit.operators.validate import Facts

    g = graph(spark, [("S1", "P1", "B1", "X"), ("S2", "P1", "B1", "X")])
    assert Facts(g).odd.count() == 0 and Facts(g).same_ids.count() == 0
    nothing = ("subject:P1", "Subject", {})
    edges = [("e1", "sample:S1", "subject:P1", "sample_belongs_to_subject"), ("e2", "sample:S1", "study:Q", "sample_from_study"), ("e1", "sample:S1", "subject:P1", "mystery"), ("e3", "sample:S1", "subject:P1", "riddle")]
    facts = Facts(raw(spark, [S, nothing, nothing, ("sample:S2", "Sample", {})], edges))
    assert rows(facts.odd, "id", "nodes", "wrong", "lone", "again") == [("sample:S1", 1, False, False, 4), ("sample:S2", 1, False, True, 0), ("study:Q", 0, True, False, 0), ("subject:P1", 2, False, False, 0)]
    assert rows(facts.same_ids) == [("e1",)] and rows(facts.faulty, "edge_id", "no_to") == [("e2", True)]
    assert facts.begun_again("sample_from_study").count() == 0 and rows(facts.begun_again(), "edge_id") == [("e1",), ("e1",), ("e2",), ("e3",)]


def test_leakage_alone_writes_no_graph(spark, monkeypatch):
    """the leakage layer reads samples and most edges once, so the graph is not written; shared targets are those of the texts."""
    from fixtures import F3

    from kinsplit.model import DependencyGraph

    g = graph(spark, F3, scopes={"FS_GLOBAL": "per_dataset", "FS_PROT": "external"})
    twice = g.relation("sample_uses_featureset").filter("`to` = 'featureset:FS_PROT'").withColumn("edge_id", F.lit("again"))
    own = lambda: DependencyGraph(g.nodes, g.edges.unionByName(twice), g.metadata)
    names = ("code", "message", "node_ids", "edge_ids")
    key = lambda report: sorted((r.code, r.message, tuple(r.node_ids), tuple(r.edge_ids)) for r in report.df.select(*names).collect())
    monkeypatch.setattr(DependencyGraph, "stored", property(lambda _: pytest.fail("the whole graph is written")))
    report = validate_graph(own(), levels=["leakage"])
    want = [("heavy_batch_reuse", "batch:B1"), ("missing_time_ordering", None), ("per_dataset_featureset", "featureset:FS_GLOBAL"), ("repeated_subject_samples", "subject:P1"), ("repeated_subject_samples", "subject:P2"), ("shared_featureset_provenance", "featureset:FS_GLOBAL"), ("subject_cross_study_overlap", "subject:P2")]
    assert [(c, n[0] if n else None) for c, _, n, _ in key(report)] == want
    assert report.metrics["n_nodes"] == g.nodes.count() and report.metrics["n_edges"] == g.edges.count() + 1 and report.metrics["n_samples"] == 6
    monkeypatch.setattr(F, "xxhash64", lambda _: F.lit(0).cast("long"))  # samples of one hash
    assert key(validate_graph(own(), levels=["leakage"])) == key(report)
