"""Small graphs used by several tests."""

from kinsplit.operators.build import build_dependency_graph
from kinsplit.sources.metadata import create_edges, create_nodes

COLUMNS = {"subject_id": ("Subject", "sample_belongs_to_subject"), "batch_id": ("Batch", "sample_processed_in_batch"), "study_id": ("Study", "sample_from_study"), "timepoint_id": ("Timepoint", "sample_collected_at_timepoint"), "featureset_id": ("FeatureSet", "sample_uses_featureset")}
F1 = [("S1", "P1", "B1", "ST1", "T0"), ("S2", "P1", "B2", "ST1", "T1"), ("S3", "P2", "B1", "ST2", "T0"), ("S4", "P3", "B3", "ST2", "T2"), ("S5", "P4", None, "ST3", None)]
F2 = [("S1", "P1", "B1", "ST1", "T0"), ("S2", "P1", "B2", "ST1", "T1"), ("S3", "P2", "B1", "ST2", "T0"), ("S4", "P3", "B3", "ST2", "T0")]
F3 = [("S1", "P1", "B1", "ST1", "T0", "FS_GLOBAL"), ("S2", "P1", "B2", "ST1", "T1", "FS_GLOBAL"), ("S3", "P2", "B1", "ST1", "T0", "FS_GLOBAL"), ("S4", "P3", "B3", "ST2", "T2", "FS_GLOBAL"), ("S5", "P4", None, "ST3", None, "FS_PROT"), ("S6", "P2", "B1", "ST2", "T1", "FS_GLOBAL")]


def table(spark, rows, names):
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))


def graph(spark, rows, times=None, precedes=None, scopes=None, outcomes=None, **options):
    """A graph of rows (sample, subject, batch, study, timepoint, feature set)."""
    names = ["sample_id", *COLUMNS][: len(rows[0])]
    meta = table(spark, rows, names)
    nodes = [create_nodes(meta.select("sample_id"), "Sample", "sample_id")]
    edges = []
    for c in names[1:]:
        kind, relation = COLUMNS[c]
        source = meta.select(c)
        if c == "timepoint_id" and times:
            source = spark.createDataFrame(list(times.items()), "timepoint_id string, time_index double")
        if c == "featureset_id" and scopes:
            source = spark.createDataFrame(list(scopes.items()), "featureset_id string, derivation_scope string")
        nodes.append(create_nodes(source, kind, c))
        edges.append(create_edges(meta, "sample_id", c, "Sample", kind, relation, allow_missing=True, order_by=["sample_id"]))
    if precedes:
        edges.append(create_edges(table(spark, precedes, ["a", "b"]), "a", "b", "Timepoint", "Timepoint", "timepoint_precedes"))
    if outcomes:
        rows = table(spark, outcomes, ["subject_id", "outcome_id"])
        nodes.append(create_nodes(rows.select("outcome_id"), "Outcome", "outcome_id"))
        edges.append(create_edges(rows, "subject_id", "outcome_id", "Subject", "Outcome", "subject_has_outcome"))
    return build_dependency_graph(nodes, edges, validate=options.pop("validate", False), **options)


def rows(frame, *columns):
    return sorted(tuple(r) for r in (frame.select(*columns) if columns else frame).collect())
