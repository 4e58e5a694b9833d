"""Split specifications: the portable form of a constraint, its preflight and risk summary."""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsplit.functions.columns import first_ids, listing, present
from kinsplit.model import DependencyGraph, Report, RiskSummary, SplitConstraint, SplitSpec
from kinsplit.operators.constraints import _with_time, direct_assignments
from kinsplit.operators.validate import validate_graph

COLUMNS = {"sample_id": "string", "sample_node_id": "string", "group_id": "string", "primary_group": "string", "batch_group": "string", "study_group": "string", "timepoint_id": "string", "time_index": "double", "order_rank": "int"}
_HINTS = {"subject": "grouped_cv", "batch": "blocked_cv", "study": "leave_one_group_out", "time": "ordered_split"}


def resampling_hint(mode: str, strategy: str) -> str:
    if mode == "composite":
        return "custom_grouped_cv" if strategy == "strict" else "grouped_cv"
    return _HINTS.get(mode, "grouped_cv")


def as_split_spec(constraint: SplitConstraint, graph: DependencyGraph | None = None) -> SplitSpec:
    """The nine columns of a specification; a graph fills in batch, study and time."""
    own, mode = constraint.df, constraint.mode
    given: dict[str, Column] = {"primary_group": F.col("group_id")}
    if mode in ("batch", "study"):
        given[f"{mode}_group"] = F.col("group_label")
    table = own.select(*[(given.get(c, F.col(c) if c in own.columns else F.lit(None))).cast(k).alias(c) for c, k in COLUMNS.items()])
    if graph is not None:
        table = _enriched(table, graph)
    some = table.agg(F.count("batch_group").alias("batch_group"), F.count("study_group").alias("study_group"), F.count("order_rank").alias("order_rank")).first()
    blocks = [c for c in ("batch_group", "study_group") if some[c]]
    ordered = bool(constraint.recommended_downstream_args.get("ordering_required"))
    return SplitSpec(table, "group_id", blocks, "order_rank" if some.order_rank else None, ordered, mode, constraint.strategy, resampling_hint(mode, constraint.strategy), dict(constraint.metadata))


def _enriched(table: DataFrame, graph: DependencyGraph) -> DataFrame:
    """Missing batch, study and time values, from the graph's direct assignments."""
    graph = graph.stored
    found = direct_assignments(graph, ("batch", "study", "time"), noted=False).df
    timed, _ = _with_time(graph, found.withColumnsRenamed({"time_id": "target_id", "time_key": "target_key"}))
    own = {"batch_group": "batch_key", "study_group": "study_key", "timepoint_id": "timepoint_id", "time_index": "time_index", "order_rank": "order_rank"}
    table = table.join(timed.select("sample_node_id", *[F.col(c).alias(f"_{name}") for name, c in own.items()]), "sample_node_id", "left")
    return table.withColumns({c: _filled(c, f"_{c}") for c in own}).select(*COLUMNS)


def _filled(column: str, other: str) -> Column:
    return F.when(present(F.col(column)), F.col(column)).otherwise(F.col(other))


def _singletons(frame: DataFrame, column: str) -> tuple[int, int]:
    """Groups and groups of one row, nulls apart."""
    sizes = frame.filter(F.col(column).isNotNull()).groupBy(column).count()
    n = sizes.agg(F.count("*").alias("n"), F.count_if(F.col("count") == 1).alias("s")).first()
    return n.n, n.s


def validate_split_spec(spec: SplitSpec) -> Report:
    """Preflight: is the specification usable as it stands?"""
    data, issues = spec.df, []

    def issue(severity: str, code: str, message: str, n: int = 0, **details: Any) -> None:
        issues.append((f"split_spec_issue_{len(issues) + 1}", severity, code, message, n, json.dumps(details)))

    lost = [c for c in dict.fromkeys(("sample_id", "sample_node_id", spec.group_var)) if c not in data.columns]
    if lost:
        issue("error", "missing_required_columns", f"Split spec is missing required columns: {', '.join(lost)}", len(lost), columns=lost)
    has = lambda c: c is not None and c in data.columns
    counted = {c: F.count_if(~F.coalesce(present(F.col(c)), F.lit(False))).alias(c) for c in {"sample_id", spec.group_var, spec.time_var, *spec.block_vars} if has(c)}
    facts = data.agg(F.count("*").alias("_n"), *counted.values()).first()
    if has("sample_id"):
        if facts.sample_id:
            issue("error", "missing_sample_id", "Split spec contains missing `sample_id` values.", facts.sample_id)
        ids, n = first_ids(data.groupBy("sample_id").count().filter("count > 1"), "sample_id")
        if ids:
            issue("error", "duplicate_sample_id", f"Split spec contains duplicated sample IDs: {listing(ids, n)}", n, sample_ids=ids)
    if not has(spec.group_var):
        issue("error", "invalid_group_var", f"Declared `group_var` is not present in `sample_data`: {spec.group_var}")
    elif facts[spec.group_var]:
        issue("error", "missing_group_id", f"Split spec contains missing values in `{spec.group_var}`.", facts[spec.group_var])
    else:
        groups, single = _singletons(data, spec.group_var)
        if groups and groups == single:
            issue("advisory", "singleton_groups_only", "All split groups are singletons; grouping may provide little protection against structural leakage.", groups)
    if spec.ordering_required:
        if not has(spec.time_var):
            issue("error", "invalid_time_var", "Ordering is required but the declared `time_var` is missing from `sample_data`.")
        elif facts[spec.time_var]:
            issue("error", "missing_required_ordering", "Ordering is required but some samples are missing ordering values.", facts[spec.time_var])
    for block in spec.block_vars:
        if not has(block):
            issue("error", "invalid_block_var", f"Declared block variable is not present in `sample_data`: {block}")
        elif facts[block] == facts._n:
            issue("warning", "empty_block_var", f"Block variable `{block}` is present but empty for all samples.")
    rows = data.sparkSession.createDataFrame(issues, "issue_id string, severity string, code string, message string, n_affected int, details string")
    table = rows.withColumn("details", F.parse_json("details"))
    groups = data.select(spec.group_var).distinct().count() if has(spec.group_var) else None
    texts = {s: [i[3] for i in issues if i[1] == s] for s in ("error", "warning", "advisory")}
    metrics = {"n_samples": facts._n, "n_groups": groups, "n_issues": len(issues)}
    return Report(not texts["error"], table, metrics, dict(spec.metadata), texts["error"], texts["warning"], texts["advisory"])


def summarize_leakage_risks(graph: DependencyGraph, constraint: SplitConstraint | None = None, split_spec: SplitSpec | None = None, validation: Report | None = None) -> RiskSummary:
    """Diagnostics of a graph's validation, a constraint and a specification in one table."""
    validation = validation or validate_graph(graph)
    rows: list[tuple[str, str, str, str, int]] = []
    if constraint is not None:
        n = constraint.df.count()
        rows += [("warning", "constraint_warning", w, "constraint", n) for w in constraint.warnings]
        groups, single = _singletons(constraint.df, "group_id")
        if groups and single / groups > 0.5:
            rows.append(("advisory", "singleton_heavy_constraint", "The derived split constraint is dominated by singleton groups.", "constraint", single))
    if split_spec is not None:
        rows += _spec_rows(split_spec)
    schema = "severity string, category string, message string, source string, n_affected int"
    extra = graph.nodes.sparkSession.createDataFrame(rows, schema)
    own = validation.sizes().select("severity", F.col("code").alias("category"), "message", F.lit("validation").alias("source"), F.col("n_nodes").cast("int").alias("n_affected"))
    table = reduce(DataFrame.unionByName, [own, extra])
    n = validation.heads.count() + len(rows)
    what = "validation" + (", constraint" if constraint else "") + (", and split-spec readiness" if split_spec else "")
    overview = f"Detected {n} structural leakage diagnostics across {what}." if n else "No structural leakage risks were detected."
    keys = {k: graph.metadata.get(k) for k in ("graph_name", "dataset_name")}
    return RiskSummary(overview, table, validation.metrics, constraint.summary() if constraint else {}, split_spec.summary() if split_spec else {}, keys)


def _spec_rows(spec: SplitSpec) -> list[tuple[str, str, str, str, int]]:
    report, source = validate_split_spec(spec), "split_spec"
    n = report.metrics["n_samples"]
    issues = [(r.severity, r.code, r.message, source, r.n_affected) for r in report.df.collect()]
    rows = issues or [("advisory", "split_spec_ready", "Split spec passed preflight validation.", source, n)]
    columns = [c for c in ([spec.time_var] if spec.time_var else []) + list(spec.block_vars) if c in spec.df.columns]
    filled: dict[str, Any] = spec.df.agg(*[F.count_if(present(F.col(c))).alias(c) for c in columns]).first().asDict() if columns else {}
    if spec.time_var in filled:
        k = filled[spec.time_var]
        rows.append(("advisory", "ordering_available", f"Split spec provides ordering through `{spec.time_var}` for {k} of {n} samples.", source, k))
    rows += [("advisory", "blocking_available", f"Split spec provides blocking variable `{b}` for {filled[b]} of {n} samples.", source, filled[b]) for b in spec.block_vars if b in filled]
    if spec.group_var in spec.df.columns:
        groups, single = _singletons(spec.df, spec.group_var)
        if groups and single / groups > 0.5:
            rows.append(("advisory", "split_spec_singleton_heavy", "Split spec grouping is dominated by singleton groups.", source, single))
    return rows
