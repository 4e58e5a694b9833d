"""The fixed vocabulary: node types, relations, enumerations and Spark schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

SCHEMA_VERSION = "0.1.0"
DEFAULT_PATH_CAP = 8


class DepGraphError(ValueError):
    """Input or graph breaks a rule of the data model."""


@dataclass(frozen=True)
class NodeType:
    name: str
    prefix: str
    key: str
    optional: tuple[str, ...]
    required: tuple[str, ...] = ()


@dataclass(frozen=True)
class EdgeType:
    name: str
    source: str
    target: str


def _types(**optional: tuple[str, ...]) -> dict[str, NodeType]:
    return {name: NodeType(name, name.lower(), f"{name.lower()}_id", own) for name, own in optional.items()}


#: Node types with their optional attributes (none is required), and relations with their ends.
NODE_TYPES = _types(
    Sample=("subject_id", "batch_id", "study_id", "timepoint_id", "assay_id", "featureset_id", "outcome_id", "sample_role", "collection_date", "source_file"),
    Subject=("subject_type", "species", "sex", "site", "enrollment_study"),
    Batch=("batch_type", "platform", "processing_center", "run_date", "operator"),
    Study=("study_name", "study_type", "institution", "country", "study_phase"),
    Timepoint=("time_index", "time_value", "time_unit", "collection_datetime", "visit_label"),
    Assay=("modality", "platform", "vendor", "protocol_version"),
    FeatureSet=("featureset_name", "modality", "feature_count", "derivation_scope", "derivation_version", "generated_from"),
    Outcome=("outcome_name", "outcome_type", "outcome_value", "outcome_scale", "observation_level"),
)
EDGE_TYPES = {
    name: EdgeType(name, source, target)
    for name, source, target in (
        ("sample_belongs_to_subject", "Sample", "Subject"),
        ("sample_processed_in_batch", "Sample", "Batch"),
        ("sample_from_study", "Sample", "Study"),
        ("sample_collected_at_timepoint", "Sample", "Timepoint"),
        ("sample_measured_by_assay", "Sample", "Assay"),
        ("sample_uses_featureset", "Sample", "FeatureSet"),
        ("sample_has_outcome", "Sample", "Outcome"),
        ("subject_has_outcome", "Subject", "Outcome"),
        ("timepoint_precedes", "Timepoint", "Timepoint"),
        ("featureset_generated_from_study", "FeatureSet", "Study"),
        ("featureset_generated_from_batch", "FeatureSet", "Batch"),
    )
}
DERIVATION_SCOPES = ("external", "per_training_split", "per_dataset")
OBSERVATION_LEVELS = ("sample", "subject")
LEVELS = ("structural", "semantic", "leakage")
SEVERITIES = ("error", "warning", "advisory")
SINGLE_TARGET = ("sample_collected_at_timepoint", "sample_measured_by_assay")
MODES = ("subject", "batch", "study", "time")
MODE_TYPE = {"subject": "Subject", "batch": "Batch", "study": "Study", "time": "Timepoint"}

#: Relation from a Sample to each other node type.
SAMPLE_RELATION = {e.target: e.name for e in EDGE_TYPES.values() if e.source == "Sample"}
LAYERS = {"Sample": 0, "Subject": 1, "Batch": 1, "Study": 1, "Timepoint": 1, "Assay": 2, "FeatureSet": 2, "Outcome": 3}

NODES = T.StructType([*(T.StructField(n, T.StringType()) for n in ("node_id", "node_type", "node_key", "label")), T.StructField("attrs", T.VariantType())])
EDGES = T.StructType([*(T.StructField(n, T.StringType()) for n in ("edge_id", "from", "to", "edge_type")), T.StructField("attrs", T.VariantType()), T.StructField("ord", T.LongType())])


def node_type(name: str) -> NodeType:
    """The node type of this name, in any case."""
    for kind in NODE_TYPES.values():
        if kind.name.lower() == str(name).lower():
            return kind
    raise DepGraphError(f"Unsupported node type: {name}")


def check(condition: bool, message: str) -> None:
    if not condition:
        raise DepGraphError(message)
