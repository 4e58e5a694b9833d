"""Graphs and specifications as JSON documents, and graphs as Parquet.

A JSON document is one file of the driver for interchange. Tasks make its rows and read them,
by way of the shared folder; the driver copies bytes, and parses only documents whose tables
do not have an object on each line. Large graphs are better kept in Parquet, partitioned by node and edge type so that a relation is a
pruned scan.
"""

from __future__ import annotations

import json
import os
import warnings
from collections.abc import Sequence
from datetime import datetime, timezone
from functools import reduce
from typing import Any
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsplit.functions.schema import EDGES, NODES, SCHEMA_VERSION, DepGraphError, check
from kinsplit.model import DependencyGraph, SplitSpec
from kinsplit.operators.split_spec import COLUMNS
from kinsplit.plans.scratch import scratch, stored

#: The key of the object tag; any key that ends like this is read.
TAG_SUFFIX, TAG = "_object", "kinsplit_object"
#: Bytes that the driver copies at once, and the most that a document may have outside its tables to be read by tasks.
COPIED, MOST_HEAD = 1 << 24, 1 << 26
_TIME = "%Y-%m-%dT%H:%M:%S.%f%z"


def _time_text(value: Any) -> Any:
    return value.strftime(_TIME) if isinstance(value, datetime) else value


def _time(value: Any) -> datetime:
    """A time from its text; what cannot be read is now."""
    try:
        return datetime.strptime(value, _TIME)
    except (TypeError, ValueError):
        return datetime.now(timezone.utc)


def _open(path: str):
    folder = os.path.dirname(os.path.abspath(path))
    check(os.path.isdir(folder), f"Directory does not exist: {folder}")
    return open(path, "wb")


def _local(path: str) -> str | None:
    """The path as this machine's files have it; None for another store's."""
    if path.startswith("file:"):
        return unquote(urlparse(path).path)
    return path if "://" not in path and os.path.isdir(os.path.dirname(path)) else None


def _rows(f, frame: DataFrame, fields: list[str], variant: bool) -> None:
    """The objects of a JSON array, a line each: tasks write them as text, the driver copies the bytes."""
    quoted = [F.to_json(F.array(F.col(f"`{c}`"))) for c in fields]
    texts = [(c, F.substr(q, F.lit(2), F.length(q) - 2)) for c, q in zip(fields, quoted)]
    texts += [("attrs", F.coalesce(F.to_json("attrs"), F.lit("{}")))] if variant else []
    pieces = [x for i, (c, text) in enumerate(texts) for x in (F.lit((", " if i else "    {") + json.dumps(c) + ": "), text)]
    spark, path = frame.sparkSession, scratch(frame.sparkSession)
    frame.select(F.concat(*pieces, F.lit("}")).alias("value")).write.option("compression", "none").text(path)
    some = False
    for part in sorted(spark.read.text(path).inputFiles()):
        own = _local(part)
        if own is not None:
            with open(own, "rb") as lines:
                while piece := lines.read(COPIED):
                    f.write((b"" if some else b"\n") + piece.replace(b"\n", b",\n"))
                    some = True
        else:
            for row in spark.read.text(part).toLocalIterator():
                f.write((b"" if some else b"\n") + row.value.encode() + b",\n")
                some = True
    if some:
        f.seek(-2, os.SEEK_END)
        f.truncate()


def _document(path: str, kind: str, version: str, parts: dict[str, Any], tables: dict[str, tuple[DataFrame, list[str], bool]], pretty: bool) -> None:
    with _open(path) as f:
        head = {TAG: kind, "schema_version": version} | parts
        text = json.dumps(head, ensure_ascii=False, indent=2 if pretty else None, default=str)
        f.write(text[:-1].rstrip().encode())
        for name, (frame, fields, variant) in tables.items():
            f.write(f',\n  "{name}": ['.encode())
            _rows(f, frame, fields, variant)
            f.write(b"\n  ]")
        f.write(b"\n}\n")


def _named(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    names = [k for k, _ in pairs]
    check(len(names) == len(set(names)), f"Repeated names in an object: {', '.join(sorted({n for n in names if names.count(n) > 1}))}")
    return dict(pairs)


def _attributes(row: dict[str, Any]) -> str:
    """The attributes of a node or edge as JSON; an empty list counts as none."""
    attrs = row.get("attrs") or {}
    check(isinstance(attrs, dict), "`attrs` entries must be named lists")
    return json.dumps(attrs)


def _keep(spark: SparkSession, path: str, k: int, lines: list[bytes]) -> None:
    """Lines as a text file that all tasks can read."""
    own = _local(path)
    if own is None:
        spark.createDataFrame([(x.decode().rstrip("\n"),) for x in lines], "value string").write.mode("append").text(path)
        return
    os.makedirs(own, exist_ok=True)
    with open(f"{own}/part-{k:06d}.txt", "wb") as f:
        f.writelines(lines)


def _apart(spark: SparkSession, path: str, tables: Sequence[str]) -> tuple[bytes, dict[str, str]] | None:
    """The document without the rows of its tables, and where these lie as lines of text.

    None if the tables do not have an object on each line, as :func:`_document` writes them.
    """
    rest, found = [], {}
    opening = {f'  "{t}": [\n'.encode(): t for t in tables}
    with open(path, "rb") as f:
        while line := f.readline(COPIED):
            rest.append(line)
            if line not in opening or opening[line] in found:
                if sum(map(len, rest)) > MOST_HEAD:
                    return None
                continue
            kept, last, k = scratch(spark), b"", 0
            while True:
                lines = f.readlines(COPIED)
                if not lines:
                    return None  # no end of the table
                end = next((i for i, x in enumerate(lines) if x.startswith(b"  ]")), None)
                if end is not None:
                    f.seek(-sum(map(len, lines[end:])), os.SEEK_CUR)
                    lines = lines[:end]
                if lines:
                    if (k and not last.endswith(b"},\n")) or not all(x.endswith(b"},\n") for x in lines[:-1]):
                        return None
                    last = lines[-1]
                    _keep(spark, kept, k, lines)
                    k += 1
                if end is not None:
                    break
            if k:
                if not last.endswith(b"}\n"):
                    return None
                found[opening[line]] = kept
    return b"".join(rest), found


def _table(spark: SparkSession, path: str, columns: dict[str, str], variant: bool) -> DataFrame | None:
    """Rows from lines of JSON, read by the tasks; None if a line is not plainly such a row."""
    rows = spark.read.text(path).select(F.expr("try_parse_json(regexp_replace(value, ',\\\\s*$', ''))").alias("v"))
    kinds = {"string": "STRING", "long": "BIGINT", "int": "BIGINT", "double": "BIGINT|DOUBLE|DECIMAL.*"}
    type_of = lambda c: F.expr(f"schema_of_variant(try_variant_get(v, '$.{c}', 'variant'))")
    plain = [F.coalesce(type_of(c).rlike(f"^({kinds[k]}|VOID)$"), F.lit(True)) for c, k in columns.items()]
    values = [F.expr(f"try_variant_get(v, '$.{c}', '{k}')").alias(c) for c, k in columns.items()]
    if variant:
        plain.append(F.coalesce(type_of("attrs").rlike("^(OBJECT<.*|VOID|ARRAY<VOID>)$"), F.lit(True)))
        values.append(F.when(type_of("attrs").startswith("OBJECT"), F.expr("try_variant_get(v, '$.attrs', 'variant')")).otherwise(F.parse_json(F.lit("{}"))).alias("attrs"))
    whole = F.expr("schema_of_variant(v) like 'OBJECT%'")
    out = stored(rows.select(*values, F.coalesce(reduce(lambda x, y: x & y, plain, whole), F.lit(False)).alias("_plain")))
    return out.drop("_plain") if out.filter("not _plain").isEmpty() else None


def _load(spark: SparkSession, path: str, kind: str, tables: dict[str, dict[str, str]], variant: bool) -> dict[str, Any]:
    """A document, its tables as DataFrames where the tasks can read them, else as lists."""
    check(os.path.exists(path), f"File does not exist: {path}")
    data, apart = None, _apart(spark, path, list(tables))
    try:
        if apart is not None:
            data = json.loads(apart[0], object_pairs_hook=_named)
            frames = {t: _table(spark, lines, tables[t], variant) for t, lines in apart[1].items()}
            data = data | frames if all(x is not None for x in frames.values()) else None
        if data is None:
            with open(path, encoding="utf-8") as f:
                data = json.load(f, object_pairs_hook=_named)
    except DepGraphError:
        raise
    except ValueError as error:
        raise DepGraphError(f"Not a JSON document: {path}") from error
    tags = [v for k, v in data.items() if k.endswith(TAG_SUFFIX)] if isinstance(data, dict) else []
    check(tags == [kind], f"The document is not a {kind}")
    if data.get("schema_version") != SCHEMA_VERSION:
        warnings.warn(f"Document has schema version {data.get('schema_version')}, this library {SCHEMA_VERSION}", stacklevel=3)
    return data


def write_dependency_graph(graph: DependencyGraph, path: str, pretty: bool = True) -> str:
    metadata = {k: _time_text(v) for k, v in graph.metadata.items()}
    edges = graph.edges.orderBy("edge_type", F.coalesce("ord", F.lit(2**62)), "edge_id")
    _document(path, "dependency_graph", graph.metadata.get("schema_version", SCHEMA_VERSION), {"metadata": metadata}, {"nodes": (graph.nodes.orderBy("node_type", "node_id"), NODES.names[:-1], True), "edges": (edges, [*EDGES.names[:4], "ord"], True)}, pretty)
    return path


def read_dependency_graph(spark: SparkSession, path: str) -> DependencyGraph:
    columns = {"nodes": dict.fromkeys(NODES.names[:4], "string"), "edges": dict.fromkeys(EDGES.names[:4], "string") | {"ord": "long"}}
    data = _load(spark, path, "dependency_graph", columns, True)

    def table(name: str) -> DataFrame:
        rows, names = data.get(name), columns[name]
        if isinstance(rows, DataFrame):
            return rows
        frame = spark.createDataFrame([tuple(r.get(n) for n in names) + (_attributes(r),) for r in rows or []], ", ".join(f"`{c}` {k}" for c, k in names.items()) + ", attrs_json string")
        return frame.withColumn("attrs", F.parse_json("attrs_json")).drop("attrs_json")

    nodes, edges = table("nodes"), table("edges")
    metadata = dict(data.get("metadata") or {})
    metadata["created_at"] = _time(metadata.get("created_at"))
    metadata["schema_version"] = data.get("schema_version")
    return DependencyGraph(nodes, edges.select(*EDGES.names), metadata)


def write_split_spec(spec: SplitSpec, path: str, pretty: bool = True) -> str:
    """Only the nine canonical columns are written."""
    keys = ("group_var", "block_vars", "time_var", "ordering_required", "constraint_mode", "constraint_strategy", "recommended_resampling")
    parts = {k: getattr(spec, k) for k in keys} | {"metadata": spec.metadata}
    _document(path, "split_spec", SCHEMA_VERSION, parts, {"sample_data": (spec.df.orderBy("sample_id"), list(COLUMNS), False)}, pretty)
    return path


def read_split_spec(spark: SparkSession, path: str) -> SplitSpec:
    data = _load(spark, path, "split_spec", {"sample_data": COLUMNS}, False)
    frame = data.get("sample_data")
    if not isinstance(frame, DataFrame):
        convert = {"double": float, "int": int, "string": str}
        rows = [tuple(convert[k](r[c]) if r.get(c) is not None else None for c, k in COLUMNS.items()) for r in frame or []]
        frame = spark.createDataFrame(rows, ", ".join(f"{c} {k}" for c, k in COLUMNS.items()))
    as_list = lambda v: [] if v is None else v if isinstance(v, list) else [v]
    metadata = dict(data.get("metadata") or {})
    for k in ("warnings", "relations_used"):
        metadata[k] = as_list(metadata.get(k))
    return SplitSpec(frame, data["group_var"], as_list(data.get("block_vars")), data.get("time_var"), bool(data.get("ordering_required")), data["constraint_mode"], data["constraint_strategy"], data["recommended_resampling"], metadata)


def write_graph_parquet(graph: DependencyGraph, path: str) -> None:
    """Nodes, edges and metadata as Parquet under ``path``."""
    graph.nodes.write.partitionBy("node_type").parquet(f"{path}/nodes")
    graph.edges.write.partitionBy("edge_type").parquet(f"{path}/edges")
    text = json.dumps({k: _time_text(v) for k, v in graph.metadata.items()}, default=str)
    graph.nodes.sparkSession.createDataFrame([(text,)], "metadata string").write.parquet(f"{path}/metadata")


def read_graph_parquet(spark: SparkSession, path: str, metadata: dict[str, Any] | None = None) -> DependencyGraph:
    """The graph of :func:`write_graph_parquet`; ``metadata`` goes over what was written."""
    nodes, edges = (spark.read.parquet(f"{path}/{t}").withColumn(c, F.col(c).cast("string")) for t, c in (("nodes", "node_type"), ("edges", "edge_type")))
    kept = json.loads(spark.read.parquet(f"{path}/metadata").first().metadata)
    if "created_at" in kept:
        kept["created_at"] = _time(kept["created_at"])
    return DependencyGraph(nodes.select(*NODES.names), edges.select(*EDGES.names), kept | dict(metadata or {}))
