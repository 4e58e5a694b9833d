"""Registered queries over the driver's tables, each with the same question in SQL.

Each view of the tables is a metadata table for the graph builders (columns as in
``kinsplit.sources.metadata``) and a common table expression ``m`` for the SQL side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsplit.functions.schema import SAMPLE_RELATION
from kinsplit.model import DependencyGraph, count_table
from kinsplit.operators import folds, query
from kinsplit.operators.build import build_dependency_graph, dependency_graph, graph_from_metadata
from kinsplit.operators.constraints import derive_split_constraints
from kinsplit.operators.paths import query_paths, query_shortest_paths
from kinsplit.operators.split_spec import as_split_spec, summarize_leakage_risks
from kinsplit.operators.validate import EDGES, Rule, leakage, semantic, structural, validate_graph
from kinsplit.sources.metadata import create_edges, create_nodes, ingest_metadata

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registered(sql: str | None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


# ---- views -----------------------------------------------------------------------------

ORDERS = """WITH m AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS s, CAST(o_custkey AS VARCHAR) AS p, o_orderpriority AS b, CAST(c_nationkey AS VARCHAR) AS st,
         strftime(o_orderdate, '%Y-%m') AS t, CAST(12 * year(o_orderdate) + month(o_orderdate) AS DOUBLE) AS ti, o_orderstatus AS oc, c_mktsegment AS seg
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey)
"""
DOCUMENTS = """WITH m AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS s, md5(text) AS p, source AS st, CAST(quality AS VARCHAR) AS b
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""
EVENTS = "WITH m AS (SELECT CAST(event_id AS VARCHAR) AS s, CAST(user_id AS VARCHAR) AS p, event_type AS st FROM events)\n"


def orders(spark: SparkSession, d: str) -> DataFrame:
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment")
    return table(spark, d, "orders").join(customer, "o_custkey", "left").select(
        F.col("o_orderkey").alias("sample_id"),
        F.col("o_custkey").alias("subject_id"),
        F.col("o_orderpriority").alias("batch_id"),
        F.col("c_nationkey").alias("study_id"),
        F.date_format("o_orderdate", "yyyy-MM").alias("timepoint_id"),
        (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("double").alias("time_index"),
        F.col("o_orderstatus").alias("outcome_value"),
        F.col("c_mktsegment").alias("segment"),
        "o_orderdate",
    )


def documents(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").alias("batch_id"))
    return table(spark, d, "documents").join(labels, "doc_id", "left").select(F.col("doc_id").alias("sample_id"), F.md5(F.col("text").cast("binary")).alias("subject_id"), F.col("source").alias("study_id"), "batch_id")


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("sample_id"), F.col("user_id").alias("subject_id"), F.col("event_type").alias("study_id"), F.col("event_type").alias("featureset_id"))


def graph(meta: DataFrame, *columns: str, numbers: bool = False, **options) -> DependencyGraph:
    """A graph of some columns of a view; these tables are sound, so no integrity jobs."""
    return graph_from_metadata(meta.select("sample_id", *columns), validate=False, numbers=numbers, checked=False, **options)


def named(rules: list[Rule], code: str, edges: bool = False) -> DataFrame:
    """The nodes or the edges (column ``id``) that the issues of a code name, each once for an issue."""
    (rule,) = [r for r in rules if r.code == code]
    return rule.ids().filter(F.col("part") == EDGES if edges else F.col("part") < EDGES).select("_order", "id").distinct().select("id")


# ---- sources, nodes, edges ---------------------------------------------------------------


@registered("SELECT CAST(o_orderkey AS VARCHAR) AS sample_id, CAST(o_custkey AS VARCHAR) AS subject_id, o_totalprice AS price FROM orders")
def ingested_orders(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("price"))
    return ingest_metadata(rows, {"sample_id": "o_orderkey", "subject_id": "o_custkey"})


@registered(ORDERS + "SELECT DISTINCT 'subject:' || p AS node_id, 'Subject' AS node_type, p AS node_key, p AS label FROM m UNION SELECT DISTINCT 'batch:' || b, 'Batch', b, b FROM m")
def nodes_by_type(spark, d):
    return query.query_node_type(graph(orders(spark, d), "subject_id", "batch_id"), ["subject", "BATCH"]).df.select("node_id", "node_type", "node_key", "label")


@registered(ORDERS + "SELECT 'sample_processed_in_batch:' || row_number() OVER (ORDER BY 'sample:' || s, 'batch:' || b) AS edge_id, 'sample:' || s AS \"from\", 'batch:' || b AS \"to\", 'sample_processed_in_batch' AS edge_type FROM m")
def edges_by_type(spark, d):
    g = graph(orders(spark, d), "batch_id", numbers=True)
    return query.query_edge_type(g, "sample_processed_in_batch").df.select("edge_id", "from", "to", "edge_type")


@registered(ORDERS + "SELECT 'Sample' AS value, count(DISTINCT s) AS n FROM m UNION ALL SELECT 'Subject', count(DISTINCT p) FROM m UNION ALL SELECT 'Batch', count(DISTINCT b) FROM m UNION ALL SELECT 'Study', count(DISTINCT st) FROM m UNION ALL SELECT 'Timepoint', count(DISTINCT t) FROM m UNION ALL SELECT 'Outcome', count(DISTINCT oc) FROM m")
def node_type_counts(spark, d):
    return count_table(graph(orders(spark, d), "subject_id", "batch_id", "study_id", "timepoint_id", "time_index", "outcome_value").nodes, "node_type")


@registered(ORDERS + "SELECT 'sample_belongs_to_subject' AS value, count(p) AS n FROM m UNION ALL SELECT 'sample_collected_at_timepoint', count(t) FROM m UNION ALL SELECT 'sample_has_outcome', count(oc) FROM m UNION ALL SELECT 'timepoint_precedes', count(DISTINCT t) - 1 FROM m")
def edge_type_counts(spark, d):
    return count_table(graph(orders(spark, d), "subject_id", "timepoint_id", "time_index", "outcome_value").edges, "edge_type")


@registered(ORDERS + "SELECT DISTINCT 'timepoint:' || t AS node_id, ti AS time_index FROM m")
def attributes_as_json(spark, d):
    nodes = graph(orders(spark, d), "timepoint_id", "time_index").of_type("Timepoint")
    return nodes.select("node_id", F.get_json_object(F.to_json("attrs"), "$.time_index").cast("double").alias("time_index"))


@registered(ORDERS + ", t AS (SELECT DISTINCT t, ti FROM m) SELECT 'timepoint_precedes:' || row_number() OVER (ORDER BY ti, t) AS edge_id, 'timepoint:' || t AS \"from\", 'timepoint:' || nxt AS \"to\" FROM (SELECT t, ti, lead(t) OVER (ORDER BY ti, t) AS nxt FROM t) WHERE nxt IS NOT NULL")
def timepoint_precedes(spark, d):
    return graph(orders(spark, d), "timepoint_id", "time_index", numbers=True).relation("timepoint_precedes").select("edge_id", "from", "to")


@registered(ORDERS + ", n AS (SELECT DISTINCT 'batch:' || b AS node_id, 1 AS layer FROM m UNION SELECT DISTINCT 'outcome:' || oc, 3 FROM m UNION SELECT 'sample:' || s, 0 FROM m), k AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY node_id) AS k, count(*) OVER (PARTITION BY layer) AS c FROM n) SELECT node_id, layer, CASE WHEN c > 1 THEN round((k - 1) / (c - 1) - 0.5, 6) ELSE 0.0 END AS x FROM k")
def typed_layout(spark, d):
    return query.typed_layout(graph(orders(spark, d), "batch_id", "outcome_value")).select("node_id", "layer", F.round("x", 6).alias("x"))


# ---- queries ------------------------------------------------------------------------------


@registered(ORDERS + "SELECT 'sample:' || s AS seed_node_id, 'subject:' || p AS node_id, 'Subject' AS node_type, 'sample_belongs_to_subject' AS edge_type, 'out' AS direction FROM m")
def neighbors_out(spark, d):
    g = graph(orders(spark, d), "subject_id", "batch_id")
    return query.query_neighbors(g, g.of_type("Sample").select("node_id"), ["sample_belongs_to_subject"]).df.drop("edge_id")


@registered(ORDERS + "SELECT 'subject:' || p AS seed_node_id, 'sample:' || s AS node_id, 'Sample' AS node_type, 'sample_belongs_to_subject' AS edge_type, 'in' AS direction FROM m")
def neighbors_in(spark, d):
    g = graph(orders(spark, d), "subject_id", "batch_id")
    return query.query_neighbors(g, g.of_type("Subject").select("node_id"), direction="in").df.drop("edge_id")


@registered(ORDERS + ", t AS (SELECT DISTINCT t, ti FROM m), e AS (SELECT t, lead(t) OVER (ORDER BY ti, t) AS nxt FROM t) SELECT 'timepoint:' || t AS seed_node_id, 'timepoint:' || nxt AS node_id, 'all' AS direction FROM e WHERE nxt IS NOT NULL UNION ALL SELECT 'timepoint:' || nxt, 'timepoint:' || t, 'all' FROM e WHERE nxt IS NOT NULL")
def neighbors_all(spark, d):
    g = graph(orders(spark, d), "timepoint_id", "time_index")
    return query.query_neighbors(g, g.of_type("Timepoint").select("node_id"), ["timepoint_precedes"], direction="all").df.select("seed_node_id", "node_id", "direction")


_PAIRS = "SELECT a.s AS sample_id_1, b.s AS sample_id_2, 'subject:' || a.p AS shared_node_id, 'Subject' AS shared_node_type FROM m a JOIN m b ON a.p = b.p AND 'sample:' || a.s < 'sample:' || b.s"


@registered(ORDERS + _PAIRS)
def shared_subject_pairs(spark, d):
    return query.detect_shared_dependencies(graph(orders(spark, d), "subject_id"), ["Subject"]).df.select("sample_id_1", "sample_id_2", "shared_node_id", "shared_node_type")


@registered(DOCUMENTS + _PAIRS)
def shared_text_pairs(spark, d):
    return query.detect_shared_dependencies(graph(documents(spark, d), "subject_id"), ["Subject"]).df.select("sample_id_1", "sample_id_2", "shared_node_id", "shared_node_type")


@registered(DOCUMENTS + "SELECT 'sample:' || a.s AS sample_node_id_1, 'sample:' || b.s AS sample_node_id_2, 'projection_' || row_number() OVER (ORDER BY 'sample:' || a.s, 'sample:' || b.s) AS projection_edge_id FROM m a JOIN m b ON a.p = b.p AND 'sample:' || a.s < 'sample:' || b.s")
def projection_edges(spark, d):
    return query.project_sample_dependencies(graph(documents(spark, d), "subject_id"), ["Subject"])


@registered(DOCUMENTS + "SELECT 'sample_belongs_to_subject:sample:' || s || '->subject:' || p AS edge_id FROM m WHERE p IN (SELECT p FROM m GROUP BY p HAVING count(*) > 1)")
def provenance_edges(spark, d):
    return query.provenance_edges(graph(documents(spark, d), "subject_id"), [SAMPLE_RELATION["Subject"]])


_BY_NATION = ", c AS (SELECT *, min('sample:' || s) OVER (PARTITION BY st) AS root, count(*) OVER (PARTITION BY st) AS size FROM m)"


@registered(ORDERS + _BY_NATION + "SELECT s AS sample_id, 'sample:' || s AS sample_node_id, 'component_' || dense_rank() OVER (ORDER BY root) AS component_id, CAST(size AS INT) AS component_size FROM c")
def dependency_components(spark, d):
    """Customers belong to one nation, so components over both are the nations."""
    return query.detect_dependency_components(graph(orders(spark, d), "subject_id", "study_id"), ["Subject", "Study"]).df


@registered(DOCUMENTS + ", c AS (SELECT *, min('sample:' || s) OVER (PARTITION BY p) AS root, count(*) OVER (PARTITION BY p) AS size FROM m), k AS (SELECT *, dense_rank() OVER (ORDER BY root) AS k FROM c) SELECT s AS sample_id, 'component_' || k AS component_id, CAST(size AS INT) AS component_size FROM k WHERE size >= 2")
def dependency_components_min2(spark, d):
    return query.detect_dependency_components(graph(documents(spark, d), "subject_id"), ["Subject"], min_size=2).df.drop("sample_node_id")


_CLOSURE = """, e AS (
  SELECT 's' || s AS a, 'p' || p AS b FROM m UNION SELECT 'p' || p, 's' || s FROM m
  UNION SELECT 's' || s, 'd' || dt FROM m UNION SELECT 'd' || dt, 's' || s FROM m),
cc AS (
  SELECT DISTINCT a AS id, a AS least FROM e
  UNION
  SELECT e.b AS id, min(cc.least) AS least FROM cc JOIN e ON e.a = cc.id JOIN recurring.cc AS known ON known.id = e.b WHERE cc.least < known.least GROUP BY e.b),
"""


@registered(
    "WITH RECURSIVE m AS (SELECT CAST(o_orderkey AS VARCHAR) AS s, CAST(o_custkey AS VARCHAR) AS p, strftime(o_orderdate, '%Y-%m-%d') AS dt FROM orders)"
    + _CLOSURE.replace("cc AS (", "cc(id, least) USING KEY (id) AS (")
    + "g AS (SELECT m.s, cc.least, min('sample:' || m.s) OVER (PARTITION BY cc.least) AS root, count(*) OVER (PARTITION BY cc.least) AS size FROM m JOIN cc ON cc.id = 's' || m.s) SELECT s AS sample_id, 'sample:' || s AS sample_node_id, 'component_' || dense_rank() OVER (ORDER BY root) AS component_id, CAST(size AS INT) AS component_size FROM g"
)
def dependency_components_dates(spark, d):
    """Customer and order date over all orders: links of two kinds, closed over."""
    meta = orders(spark, d).withColumn("batch_id", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return query.detect_dependency_components(graph(meta, "subject_id", "batch_id"), ["Subject", "Batch"]).df


def _segments(spark: SparkSession, d: str) -> DependencyGraph:
    meta = orders(spark, d).select("sample_id", "subject_id", F.col("segment").alias("outcome_id"))
    return graph_from_metadata(meta, outcome_scope="subject", validate=False, numbers=False, checked=False).stored


_PATHS = ORDERS + ", k AS (SELECT *, row_number() OVER (ORDER BY 'sample:' || s, 'outcome:' || seg) AS k FROM m) SELECT 'path_' || k AS path_id, CAST(1 AS INT) AS step, 'sample:' || s AS node_id, 'Sample' AS node_type, CAST(NULL AS VARCHAR) AS edge_type FROM k UNION ALL SELECT 'path_' || k, 2, 'subject:' || p, 'Subject', 'sample_belongs_to_subject' FROM k UNION ALL SELECT 'path_' || k, 3, 'outcome:' || seg, 'Outcome', 'subject_has_outcome' FROM k"


@registered(_PATHS)
def paths_sample_to_outcome(spark, d):
    g = _segments(spark, d)
    return query_paths(g, g.of_type("Sample").select("node_id"), g.of_type("Outcome").select("node_id")).df.drop("edge_id")


@registered(_PATHS)
def shortest_paths(spark, d):
    g = _segments(spark, d)
    return query_shortest_paths(g, g.of_type("Sample").select("node_id"), g.of_type("Outcome").select("node_id")).df.drop("edge_id")


# ---- constraints and specifications -----------------------------------------------------------


def _direct_sql(view: str, mode: str, column: str) -> str:
    relation = SAMPLE_RELATION[{"subject": "Subject", "batch": "Batch", "study": "Study", "time": "Timepoint"}[mode]]
    return view + (
        f"SELECT s AS sample_id, 'sample:' || s AS sample_node_id, CASE WHEN {column} IS NULL THEN '{mode}:unlinked:' || s ELSE '{mode}:' || {column} END AS group_id, '{mode}' AS constraint_type, coalesce({column}, 'unlinked_' || s) AS group_label, "
        f"CASE WHEN {column} IS NULL THEN 'No {mode} assignment was available; sample retained as an unlinked singleton group.' ELSE 'Grouped by {mode} through {relation} -> ' || {column} || '.' END AS explanation"
    )


@registered(_direct_sql(ORDERS, "subject", "p") + " FROM m")
def subject_constraint(spark, d):
    return derive_split_constraints(graph(orders(spark, d), "subject_id"), "subject").df


@registered(_direct_sql(ORDERS, "batch", "b") + " FROM m")
def batch_constraint(spark, d):
    return derive_split_constraints(graph(orders(spark, d), "batch_id"), "batch").df


@registered(_direct_sql(ORDERS, "study", "st") + " FROM m")
def study_constraint(spark, d):
    return derive_split_constraints(graph(orders(spark, d), "study_id"), "Study").df


@registered(_direct_sql(ORDERS, "time", "t") + ", ti AS time_index, t AS timepoint_id, CAST(dense_rank() OVER (ORDER BY ti) AS INT) AS order_rank FROM m")
def time_constraint(spark, d):
    return derive_split_constraints(graph(orders(spark, d), "timepoint_id", "time_index"), "timepoint").df


@registered(_direct_sql(DOCUMENTS, "batch", "b") + " FROM m")
def unlinked_outcome_batch(spark, d):
    return derive_split_constraints(graph(documents(spark, d), "batch_id"), "batch").df


@registered(ORDERS + _BY_NATION + "SELECT s AS sample_id, 'component_' || dense_rank() OVER (ORDER BY root) AS group_id, 'composite_strict' AS constraint_type, 'Strict composite grouping via transitive closure over: Subject, Study.' AS explanation FROM c")
def composite_strict(spark, d):
    return derive_split_constraints(graph(orders(spark, d), "subject_id", "study_id"), "composite", via=["subject", "Study"]).df.select("sample_id", "group_id", "constraint_type", "explanation")


_RULE = """SELECT s AS sample_id, CASE WHEN b IS NOT NULL THEN 'composite_batch:' || b ELSE 'composite_subject:' || p END AS group_id, CASE WHEN b IS NOT NULL THEN 'batch' ELSE 'subject' END AS constraint_type,
 CASE WHEN b IS NOT NULL THEN 'Composite rule-based grouping selected batch based on priority order batch > subject > study -> ' || b || '. Additional available dependencies: subject=' || p || ', study=' || st || '.'
 ELSE 'Composite rule-based grouping selected subject based on priority order batch > subject > study -> ' || p || '. Additional available dependencies: study=' || st || '.' END AS explanation FROM m"""


def _ruled(meta: DataFrame) -> DataFrame:
    g = graph(meta, "batch_id", "subject_id", "study_id")
    return derive_split_constraints(g, "composite", strategy="rule_based", via=["batch", "subject", "study"]).df.select("sample_id", "group_id", "constraint_type", "explanation")


@registered(DOCUMENTS + _RULE)
def rule_based_documents(spark, d):
    return _ruled(documents(spark, d))


@registered(ORDERS + _RULE)
def rule_based_orders(spark, d):
    return _ruled(orders(spark, d))


def _spec(spark: SparkSession, d: str, mode: str):
    g = graph(orders(spark, d), "subject_id", "batch_id", "study_id", "timepoint_id", "time_index")
    return as_split_spec(derive_split_constraints(g, mode), g)


_SPEC = "SELECT s AS sample_id, 'sample:' || s AS sample_node_id, '{0}:' || {1} AS group_id, '{0}:' || {1} AS primary_group, b AS batch_group, st AS study_group, t AS timepoint_id, ti AS time_index, CAST(dense_rank() OVER (ORDER BY ti) AS INT) AS order_rank FROM m"


@registered(ORDERS + _SPEC.format("subject", "p"))
def split_spec_subject(spark, d):
    return _spec(spark, d, "subject").df


@registered(ORDERS + _SPEC.format("batch", "b"))
def split_spec_batch(spark, d):
    return _spec(spark, d, "batch").df


@registered(ORDERS + "SELECT 'subject:' || p AS group_id, count(*) AS n FROM m GROUP BY p")
def group_sizes(spark, d):
    return derive_split_constraints(graph(orders(spark, d), "subject_id"), "subject").grouping_vector().groupBy("group_id").agg(F.count("*").alias("n"))


@registered(DOCUMENTS + ", g AS (SELECT p, count(*) AS n FROM m GROUP BY p) SELECT count(*) AS n_groups, count(*) FILTER (n = 1) AS n_singletons FROM g")
def singleton_summary(spark, d):
    sizes = derive_split_constraints(graph(documents(spark, d), "subject_id"), "subject").df.groupBy("group_id").count()
    return sizes.agg(F.count("*").alias("n_groups"), F.count_if(F.col("count") == 1).alias("n_singletons"))


@registered(ORDERS + "SELECT f.st AS fold, m.s AS sample_id, CASE WHEN f.st = m.st THEN 'assess' ELSE 'train' END AS role FROM m, (SELECT DISTINCT st FROM m) f")
def logo_folds(spark, d):
    spec = as_split_spec(derive_split_constraints(graph(orders(spark, d), "study_id"), "study"))
    return folds.leave_one_group_out(spec).withColumn("fold", F.expr("substring(fold, 7)"))


@registered(ORDERS + "SELECT s AS sample_id, CAST(CAST('0x' || substr(md5('subject:' || p), 1, 8) AS BIGINT) % 5 AS INT) AS fold FROM m")
def grouped_folds(spark, d):
    return folds.grouped_folds(as_split_spec(derive_split_constraints(graph(orders(spark, d), "subject_id"), "subject")), 5)


def _timed_spec(spark, d):
    return as_split_spec(derive_split_constraints(graph(orders(spark, d), "timepoint_id", "time_index"), "time"))


@registered(ORDERS + ", n AS (SELECT count(*) AS n, greatest(1, CAST(floor(0.6 * count(*)) AS BIGINT)) AS i FROM m) SELECT CAST(k + 1 AS INT) AS slice, k + i AS train_until, k + i + 1 AS assess_from, k + i + 1 AS assess_until FROM (SELECT unnest(range(0, n - i)) AS k, i FROM n)")
def rolling_origin_folds(spark, d):
    return folds.rolling_origin(_timed_spec(spark, d))


@registered(ORDERS + "SELECT row_number() OVER (ORDER BY ti, s) AS position, s AS sample_id FROM m")
def ordered_samples(spark, d):
    return folds.ordered_samples(_timed_spec(spark, d))


# ---- validation -----------------------------------------------------------------------------------


@registered(ORDERS + ", t AS (SELECT DISTINCT t, ti FROM m), e AS (SELECT t, lead(t) OVER (ORDER BY ti, t) AS nxt FROM t) SELECT 'timepoint_precedes:timepoint:' || t || '->timepoint:' || nxt AS edge_id FROM e WHERE nxt IS NOT NULL")
def time_order_conflicts(spark, d):
    """Months in their order, but with indices that run backwards."""
    meta = orders(spark, d).select("timepoint_id", "time_index", F.col("sample_id"))
    g = graph(meta, "timepoint_id", "time_index")
    backwards = create_nodes(meta.select("timepoint_id", (-F.col("time_index")).alias("time_index")), "Timepoint", "timepoint_id", checked=False)
    wrong = dependency_graph(g.of_type("Sample").unionByName(backwards.df), g.edges)
    return named(semantic(wrong, {}), "time_order_conflict", edges=True).select(F.col("id").alias("edge_id"))


def _suppliers(spark: SparkSession, d: str, dedupe: bool = True) -> DependencyGraph:
    """Orders and their suppliers as batches and as studies: many for an order, none for some."""
    pairs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("s"))
    samples = create_nodes(table(spark, d, "orders"), "Sample", "o_orderkey", checked=False)
    suppliers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("s"))
    nodes = [samples, create_nodes(suppliers, "Batch", "s", checked=False), create_nodes(suppliers, "Study", "s", checked=False)]
    edges = [create_edges(pairs, "o", "s", "Sample", t, r, numbers=False, checked=False, dedupe=dedupe) for t, r in (("Batch", "sample_processed_in_batch"), ("Study", "sample_from_study"))]
    return build_dependency_graph(nodes, edges, validate=False, checked=False)


@registered("WITH x AS (SELECT l_orderkey AS o FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) > 1) SELECT 'sample:' || o AS node_id FROM x UNION SELECT 'batch:' || l_suppkey FROM lineitem JOIN x ON l_orderkey = o")
def multi_assignment_violations(spark, d):
    return named(semantic(_suppliers(spark, d), {}), "sample_multiple_batch_assignments").select(F.col("id").alias("node_id"))


@registered("SELECT 'sample:' || o_orderkey AS node_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def missing_assignment(spark, d):
    return named(semantic(_suppliers(spark, d), {}), "sample_missing_study_assignment").select(F.col("id").alias("node_id"))


@registered("SELECT DISTINCT 'sample_processed_in_batch:sample:' || l_orderkey || '->batch:' || l_suppkey AS edge_id FROM (SELECT l_orderkey, l_suppkey FROM lineitem GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT DISTINCT 'sample_from_study:sample:' || l_orderkey || '->study:' || l_suppkey FROM (SELECT l_orderkey, l_suppkey FROM lineitem GROUP BY ALL HAVING count(*) > 1)")
def duplicate_triplets(spark, d):
    return named(structural(_suppliers(spark, d, dedupe=False)), "duplicate_edge_triplet", edges=True).select(F.col("id").alias("edge_id"))


@registered(ORDERS + "SELECT DISTINCT 'subject:' || p AS node_id FROM m WHERE st IS NULL OR CAST(st AS INT) >= 10")
def dangling_edges(spark, d):
    """Orders of all customers, but only the customers of some nations as nodes."""
    meta = orders(spark, d)
    g = graph(meta, "subject_id")
    some = create_nodes(meta.filter("study_id < 10").select("subject_id"), "Subject", "subject_id", checked=False)
    return named(structural(dependency_graph(g.of_type("Sample").unionByName(some.df), g.edges)), "missing_target_node").select(F.col("id").alias("node_id"))


@registered(ORDERS + "SELECT 'invalid_edge_signature' AS code, 'sample_from_study:sample:' || s || '->batch:' || b AS edge_id FROM m UNION ALL SELECT 'unsupported_edge_type', 'mystery:sample:' || s || '->batch:' || b FROM m")
def edge_signature_violations(spark, d):
    """Batches under a study's relation and under one that does not exist."""
    g = graph(orders(spark, d), "batch_id")
    renamed = [g.edges.withColumns({"edge_type": F.lit(r), "edge_id": F.concat(F.lit(f"{r}:"), "from", F.lit("->"), "to")}) for r in ("sample_from_study", "mystery")]
    rules = structural(dependency_graph(g.nodes, renamed[0].unionByName(renamed[1])))
    both = [named(rules, c, edges=True).select(F.lit(c).alias("code"), F.col("id").alias("edge_id")) for c in ("invalid_edge_signature", "unsupported_edge_type")]
    return both[0].unionByName(both[1])


def _reuse(g: DependencyGraph, code: str) -> DataFrame:
    """The issue's node, the number of samples behind it, listed as nodes or else by their edges."""
    (rule,) = [r for r in leakage(g) if r.code == code]
    found = rule.ids().groupBy(F.col("_order").alias("node_id")).agg(F.count_if(F.col("part") < EDGES).alias("nodes"), F.count_if(F.col("part") == EDGES).alias("edges"))
    return found.select("node_id", F.when(F.col("nodes") > 1, F.col("nodes") - 1).otherwise(F.col("edges")).alias("n"), F.lit(rule.severity).alias("severity"))


@registered(ORDERS + "SELECT 'subject:' || p AS node_id, count(*) AS n, 'advisory' AS severity FROM m GROUP BY p HAVING count(*) > 1")
def repeated_subject_samples(spark, d):
    return _reuse(graph(orders(spark, d), "subject_id"), "repeated_subject_samples")


@registered(EVENTS + "SELECT 'subject:' || p AS node_id, count(DISTINCT s) AS n, 'warning' AS severity FROM m GROUP BY p HAVING count(DISTINCT st) > 1")
def subject_cross_study_overlap(spark, d):
    return _reuse(graph(events(spark, d), "subject_id", "study_id"), "subject_cross_study_overlap")


@registered(EVENTS + "SELECT 'featureset:' || st AS node_id, count(*) AS n, 'advisory' AS severity FROM m GROUP BY st HAVING count(*) > 1")
def shared_featureset(spark, d):
    return _reuse(graph(events(spark, d), "featureset_id"), "shared_featureset_provenance")


@registered("WITH m AS (SELECT CASE WHEN o_orderpriority < '4' THEN 'early' ELSE 'late' END AS b FROM orders) SELECT 'batch:' || b AS node_id, count(*) AS n, 'advisory' AS severity FROM m GROUP BY b HAVING count(*) >= greatest(3, ceil(0.5 * (SELECT count(*) FROM m)))")
def heavy_batch_reuse(spark, d):
    meta = orders(spark, d).withColumn("batch_id", F.when(F.col("batch_id") < "4", "early").otherwise("late"))
    return _reuse(graph(meta, "batch_id"), "heavy_batch_reuse")


@registered(ORDERS + ", i AS (SELECT 'advisory' AS severity, 'repeated_subject_samples' AS code FROM m GROUP BY p HAVING count(*) > 1) SELECT severity, code, count(*) AS n FROM i GROUP BY ALL UNION ALL SELECT 'advisory', 'heavy_batch_reuse', count(*) FROM (SELECT b FROM m GROUP BY b HAVING count(*) >= greatest(3, ceil(0.5 * (SELECT count(*) FROM m)))) HAVING count(*) > 0")
def validation_counts_by_severity(spark, d):
    g = graph(orders(spark, d), "subject_id", "batch_id", "study_id", "timepoint_id", "time_index")
    return validate_graph(g).heads.groupBy("severity", "code").agg(F.count("*").alias("n"))


@registered(ORDERS + ", g AS (SELECT p, count(*) AS n FROM m GROUP BY p), a AS (SELECT count(*) AS n FROM m) SELECT 'advisory' AS severity, 'repeated_subject_samples' AS category, 'validation' AS source, CAST(n + 1 AS INT) AS n_affected, 'Subject `subject:' || p || '` is linked to multiple samples.' AS message FROM g WHERE n > 1 UNION ALL SELECT 'advisory', 'split_spec_ready', 'split_spec', CAST(n AS INT), 'Split spec passed preflight validation.' FROM a UNION ALL SELECT 'advisory', 'ordering_available', 'split_spec', CAST(n AS INT), 'Split spec provides ordering through `order_rank` for ' || n || ' of ' || n || ' samples.' FROM a")
def leakage_diagnostics(spark, d):
    g = graph(orders(spark, d), "subject_id", "timepoint_id", "time_index")
    c = derive_split_constraints(g, "subject")
    return summarize_leakage_risks(g, c, as_split_spec(c, g)).df.select("severity", "category", "source", F.col("n_affected").cast("int").alias("n_affected"), "message")

