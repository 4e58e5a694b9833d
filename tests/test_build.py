import pytest
from fixtures import F1, graph, rows, table

from kinsplit.functions.schema import EDGE_TYPES, NODE_TYPES, SCHEMA_VERSION, DepGraphError
from kinsplit.operators import aliases
from kinsplit.operators.build import build_dependency_graph, graph_edge_set, graph_from_metadata, graph_node_set
from kinsplit.operators.constraints import derive_split_constraints
from kinsplit.sources.metadata import create_edges, create_nodes, ingest_metadata

QUICK = [("S1", "P1", "B1", "T0", 0.0, "ctrl"), ("S2", "P1", "B2", "T1", 1.0, "case"), ("S3", "P2", "B1", "T0", 0.0, "ctrl"), ("S4", "P2", "B2", "T1", 1.0, "case"), ("S5", "P3", "B1", "T0", 0.0, "case"), ("S6", "P3", "B2", "T1", 1.0, "ctrl")]


def quick(spark):
    return spark.createDataFrame(QUICK, "sample_id string, subject_id string, batch_id string, timepoint_id string, time_index double, outcome_value string")


def test_vocabulary():
    assert len(NODE_TYPES) == 8 and len(EDGE_TYPES) == 11 and SCHEMA_VERSION == "0.1.0"


def test_ingest_renames_and_casts(spark):
    data = spark.createDataFrame([(1.0, 100000.0, 2.5)], "id double, who double, x double")
    out = ingest_metadata(data, {"sample_id": "id", "subject_id": "who"})
    assert out.first().asDict() == {"sample_id": "1", "subject_id": "100000", "x": 2.5}
    with pytest.raises(DepGraphError):
        ingest_metadata(data)
    values = {12345678.5: "12345678.5", 1e16: "10000000000000000", 0.0001: "0.0001", -2.50: "-2.5", 1e20: "100000000000000000000", 1.5e-7: "0.00000015", 0.0: "0", 100.0: "100", 1e300: "1.0E300", 1e-50: "1.0E-50"}
    keys = ingest_metadata(spark.createDataFrame([(v, v) for v in [*values, None]], "x double, sample_id double"))
    assert {r.x: r.sample_id for r in keys.collect()} == values | {None: None}


def test_quick_start_counts(spark):
    g = graph_from_metadata(quick(spark), graph_name="demo")
    s = g.summary()
    assert s["node_types"] == {"Sample": 6, "Subject": 3, "Batch": 2, "Timepoint": 2, "Outcome": 2}
    assert s["n_edges"] == 25 and s["edge_types"]["timepoint_precedes"] == 1


def test_subject_outcomes(spark):
    meta = table(spark, [("S1", "P1", "a"), ("S2", "P1", "a"), ("S3", "P2", "b")], ["sample_id", "subject_id", "outcome_id"])
    kinds = graph_from_metadata(meta, outcome_scope="subject", validate=False).summary()["edge_types"]
    assert kinds == {"sample_belongs_to_subject": 3, "subject_has_outcome": 2}


def test_numeric_outcome_warns(spark):
    meta = spark.createDataFrame([("S1", 0), ("S2", 1), ("S3", 0)], "sample_id string, outcome_value int")
    with pytest.warns(UserWarning, match="numeric"):
        g = graph_from_metadata(meta, validate=False)
    assert rows(g.of_type("Outcome"), "node_key") == [("0",), ("1",)]


def test_only_samples_fail(spark):
    with pytest.raises(DepGraphError):
        graph_from_metadata(table(spark, [("S1",)], ["sample_id"]))


def test_node_conflicts_and_labels(spark):
    data = table(spark, [("P1", "case"), ("P1", "control"), (None, "x"), ("", "y")], ["subject_id", "sex"])
    with pytest.raises(DepGraphError, match="Conflicting node definitions found for IDs: subject:P1"):
        create_nodes(data, "Subject", "subject_id")
    assert rows(create_nodes(data, "subject", "subject_id", attr_cols=[]).df, "node_id", "label") == [("subject:P1", "P1")]


def test_edge_rules(spark):
    data = table(spark, [("S1", "P1", "first"), ("S1", "P1", "second"), ("S2", None, "x")], ["s", "p", "note"])
    args = ("s", "p", "Sample", "Subject", "sample_belongs_to_subject")
    with pytest.raises(DepGraphError, match="Missing"):
        create_edges(data, *args)
    with pytest.raises(DepGraphError, match="Conflicting edge definitions found for relations: sample:S1 -> subject:P1"):
        create_edges(data, *args, attr_cols=["note"], allow_missing=True)
    assert rows(create_edges(data, *args, allow_missing=True).df, "edge_id", "from", "to") == [("sample_belongs_to_subject:1", "sample:S1", "subject:P1")]
    with pytest.raises(DepGraphError, match="joins"):
        create_edges(data, "s", "p", "Sample", "Batch", "sample_belongs_to_subject", allow_missing=True)


def test_dangling_edges_and_prefix_hint(spark):
    meta = table(spark, [("S1", "P1")], ["sample_id", "subject_id"])
    plain = [create_nodes(meta, "Sample", "sample_id", prefix=False, attr_cols=[]), create_nodes(meta, "Subject", "subject_id", prefix=False)]
    edges = create_edges(meta, "sample_id", "subject_id", "Sample", "Subject", "sample_belongs_to_subject")
    with pytest.raises(DepGraphError, match="Hint"):
        build_dependency_graph(plain, edges)
    with pytest.raises(DepGraphError, match="not present in the node table"):
        build_dependency_graph(create_nodes(meta, "Sample", "sample_id"), edges)
    with pytest.raises(DepGraphError, match="at least one Sample"):
        build_dependency_graph(plain[1], edges)


def test_raw_sets(spark):
    raw = table(spark, [("a", "SAMPLE", "a", None)], ["node_id", "node_type", "node_key", "label"])
    assert rows(graph_node_set(raw).df, "node_type", "label") == [("Sample", "a")]
    with pytest.raises(DepGraphError, match="node_id"):
        graph_node_set(table(spark, [("", "Sample", "a")], ["node_id", "node_type", "node_key"]))
    with pytest.raises(DepGraphError, match="Unsupported"):
        graph_node_set(table(spark, [("a", "Thing", "a")], ["node_id", "node_type", "node_key"]))
    with pytest.raises(DepGraphError, match="named lists"):
        graph_edge_set(table(spark, [("e", "a", "b", "r", "x")], ["edge_id", "from", "to", "edge_type", "attrs"]))


def test_rows_in_a_given_order(spark):
    meta = spark.createDataFrame([("S1", "P9", 1), ("S1", "P1", 2), ("S0", "P1", 3)], "sample_id string, subject_id string, line int")
    nodes = [create_nodes(meta, "Sample", "sample_id", attr_cols=[]), create_nodes(meta, "Subject", "subject_id")]
    edges = create_edges(meta, "sample_id", "subject_id", "Sample", "Subject", "sample_belongs_to_subject", order_by=["line"])
    assert rows(edges.df, "edge_id", "from", "to")[:2] == [("sample_belongs_to_subject:1", "sample:S1", "subject:P9"), ("sample_belongs_to_subject:2", "sample:S1", "subject:P1")]
    g = build_dependency_graph(nodes, edges, validate=False, validation_overrides={"allow_multi_subject_samples": True})
    c = derive_split_constraints(g, "subject")
    assert rows(c.df, "sample_id", "group_id") == [("S0", "subject:P1"), ("S1", "subject:P9")]
    assert c.warnings == ["Samples linked to multiple subjects were assigned to their first listed subject (allow_multi_subject_samples override): S1"]


def test_aliases_warn(spark):
    raw = table(spark, [("a", "Sample", "a")], ["node_id", "node_type", "node_key"])
    with pytest.warns(DeprecationWarning):
        aliases.new_depgraph_nodes(raw)


def test_numbering_does_not_depend_on_partitions(spark):
    g1 = graph(spark, F1)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    g2 = graph(spark, F1)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    assert rows(g1.edges, "edge_id", "from", "to") == rows(g2.edges, "edge_id", "from", "to")


def test_a_graph_is_stored_once(spark):
    g = graph_from_metadata(quick(spark), validate=False, checked=False)
    kept = g.stored
    assert kept is g.stored is kept.stored and kept.nodes.inputFiles() and kept.metadata is g.metadata
    assert rows(kept.edges, "edge_id", "from", "to", "edge_type", "ord") == rows(g.edges, "edge_id", "from", "to", "edge_type", "ord")


def test_keys_have_the_shortest_digits(spark):
    """Java 17 prints 5.903299999999999E20 for the first of these."""
    values = {59033 * 1e16: "590330000000000000000", 59039 * 1e16: "590390000000000000000", 0.1 + 0.2: "0.30000000000000004", 1234567.1234567891: repr(1234567.1234567891), 59033 * 1e296: repr(59033 * 1e296).upper().replace("+", ""), -59033 * 1e16: "-590330000000000000000", 123.45678901234567: repr(123.45678901234567)}
    out = ingest_metadata(spark.createDataFrame([(v, w) for v, w in values.items()], "sample_id double, want string"))
    assert [tuple(r) for r in out.select("sample_id", "want").filter("sample_id is distinct from want").collect()] == []
