"""A property graph over the star-schema tables: the data that the registered queries run on.

The two statements are plain SQL that any engine with these tables can run.  Regions are repositories,
nations files, customers classes, orders methods, parts functions, suppliers persons, brands domains;
documents, part sizes (rules), nations (decisions) and part types (concepts) give the knowledge side.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..shared import fresh_path
from .graph import Graph

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents")

_KINDS = {"region": 1, "nation": 2, "customer": 3, "orders": 4, "part": 5, "supplier": 6, "brand": 7, "documents": 8, "rule": 9, "decision": 10, "concept": 11}


def _id(kind: str, key: str) -> str:
    return f"(CAST({_KINDS[kind]} AS BIGINT) * 1000000000000 + CAST({key} AS BIGINT))"


#: Brands, part types and sizes by rank, which gives them keys from 0.
_BRANDS = "(SELECT p_brand AS brand, row_number() OVER (ORDER BY p_brand) - 1 AS k FROM part GROUP BY p_brand)"
_TYPES = "(SELECT p_type AS ptype, row_number() OVER (ORDER BY p_type) - 1 AS k FROM part GROUP BY p_type)"
_SIZES = "(SELECT p_size AS psize FROM part GROUP BY p_size)"
_PARTS = "(SELECT count(*) FROM part)"

_NODE_FIELDS = ["id", "label", "name", "path", "file_path", "repo", "line_start", "line_end", "docstring", "description", "content", "domain", "status", "severity", "rationale", "constraint_json", "date", "memory_type", "email", "role", "team", "semantic_type", "signature"]
_INTS = {"line_start", "line_end"}


def _node(source: str, **fields: str) -> str:
    cols = []
    for f in _NODE_FIELDS:
        kind = "BIGINT" if f == "id" else "INT" if f in _INTS else "VARCHAR(65535)"
        value = fields.get(f, "NULL")
        cols.append(f"CAST({value} AS {kind if kind != 'VARCHAR(65535)' else 'STRING'}) AS {f}")
    return f"SELECT {', '.join(cols)} FROM {source}"


NODES_SQL = " UNION ALL ".join(
    [
        _node("region", id=_id("region", "r_regionkey"), label="'Repository'", name="r_name", path="'/' || r_name", repo="r_name", description="'Region ' || r_name"),
        _node("nation JOIN region ON n_regionkey = r_regionkey", id=_id("nation", "n_nationkey"), label="'File'", name="n_name", path="r_name || '/' || n_name", repo="r_name"),
        _node("customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", id=_id("customer", "c_custkey"), label="'Class'", name="c_name", file_path="r_name || '/' || n_name", repo="r_name", line_start="c_custkey % 500 + 1", line_end="c_custkey % 500 + 20", docstring="'Segment ' || c_mktsegment", description="c_mktsegment", semantic_type="CASE WHEN c_custkey % 3 = 0 THEN 'OrderController' WHEN c_custkey % 3 = 1 THEN 'CustomerModel' ELSE NULL END"),
        _node("orders", id=_id("orders", "o_orderkey"), label="'Method'", name="'order_' || CAST(o_orderkey AS STRING)", file_path="'orders/' || o_orderpriority", line_start="o_orderkey % 1000", line_end="o_orderkey % 1000 + 9", docstring="CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END", status="o_orderstatus"),
        _node("part", id=_id("part", "p_partkey"), label="'Function'", name="p_name", file_path="'part/' || CAST(p_partkey AS STRING)", line_start="p_size", line_end="p_size + CAST(p_partkey % 30 AS INT)", docstring="CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_type END", description="p_brand", domain="p_brand", signature="p_name || '(' || p_type || ')'"),
        _node("supplier", id=_id("supplier", "s_suppkey"), label="'Person'", name="s_name", email="lower(s_name) || '@example.com'", role="CASE WHEN s_suppkey % 2 = 0 THEN 'maintainer' ELSE 'reviewer' END", team="'team' || CAST(s_nationkey AS STRING)"),
        _node(f"{_BRANDS} b", id=_id("brand", "k"), label="'Domain'", name="brand", description="'Brand domain ' || brand"),
        _node("documents", id=_id("documents", "doc_id"), label="'Document'", name="'doc_' || CAST(doc_id AS STRING)", path="'docs/' || source || '/' || CAST(doc_id AS STRING) || '.md'", content="text", description="lang"),
        _node(f"{_SIZES} s", id=_id("rule", "psize"), label="'Rule'", name="'rule_' || CAST(psize AS STRING)", description="'Sizes of ' || CAST(psize AS STRING)", severity="CASE psize % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'info' END", rationale="CASE WHEN psize % 2 = 0 THEN 'Every owner must agree' ELSE NULL END", memory_type="CASE WHEN psize % 5 = 0 THEN 'feedback' ELSE NULL END", domain="CASE WHEN psize % 5 = 0 THEN 'Brand#' || CAST(CAST(psize / 5 AS INT) AS STRING) ELSE NULL END", repo="CASE WHEN psize % 5 = 0 THEN 'ASIA' ELSE NULL END"),
        _node("nation", id=_id("decision", "n_nationkey"), label="'Decision'", name="'decision_' || n_name", description="'Decided in ' || n_name", status="CASE n_nationkey % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'proposed' ELSE 'deprecated' END", rationale="'Because of ' || n_name", date="CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE '2024-01-' || lpad(CAST(n_nationkey + 1 AS STRING), 2, '0') END", memory_type="CASE WHEN n_nationkey % 2 = 0 THEN 'project' ELSE NULL END", repo="CASE WHEN n_nationkey % 2 = 0 THEN 'EUROPE' ELSE NULL END"),
        _node(f"{_TYPES} t", id=_id("concept", "k"), label="'Concept'", name="ptype", description="'Parts of type ' || ptype", status="'stable'"),
    ]
)


def _edge(kind: str, src: str, dst: str, source: str, distinct: bool = False) -> str:
    return f"SELECT {'DISTINCT ' if distinct else ''}{src} AS src, {dst} AS dst, '{kind}' AS type FROM {source}"


_CALLS = _edge("CALLS", _id("part", "src"), _id("part", "dst"), f"(SELECT p_partkey AS src, (31 * p_partkey) % {_PARTS} AS dst FROM part UNION SELECT p_partkey AS src, p_partkey - p_partkey % 3 + (p_partkey % 3 + 1) % 3 AS dst FROM part WHERE ((p_partkey - p_partkey % 3) / 3) % 4 = 0 AND p_partkey - p_partkey % 3 + 3 <= {_PARTS}) x")

EDGES_SQL = " UNION ALL ".join(
    [
        _edge("CONTAINS", _id("region", "n_regionkey"), _id("nation", "n_nationkey"), "nation"),
        _edge("CONTAINS", _id("nation", "c_nationkey"), _id("customer", "c_custkey"), "customer"),
        _edge("CONTAINS", _id("customer", "o_custkey"), _id("orders", "o_orderkey"), "orders"),
        _edge("CALLS", _id("orders", "l_orderkey"), _id("part", "l_partkey"), "lineitem WHERE l_quantity >= 48", True),
        _CALLS,
        _edge("INHERITS", _id("customer", "c_custkey"), _id("customer", "(c_custkey - c_custkey % 2) / 2"), "customer WHERE c_custkey > 0"),
        _edge("BELONGS_TO", _id("part", "p_partkey"), _id("brand", "k"), f"part JOIN {_BRANDS} b ON p_brand = brand"),
        _edge("BELONGS_TO", _id("decision", "n_nationkey"), _id("brand", "k"), f"nation JOIN {_BRANDS} b ON n_nationkey = k"),
        _edge("ASSIGNED_TO", _id("part", "l_partkey"), _id("supplier", "l_suppkey"), "lineitem WHERE l_quantity >= 48 AND l_returnflag = 'R'", True),
        _edge("DOCUMENTS", _id("documents", "doc_id"), _id("part", f"doc_id % {_PARTS}"), "documents WHERE doc_id % 3 = 0"),
        _edge("DOCUMENTS", _id("decision", "n_nationkey"), _id("part", "n_nationkey * 3"), "nation"),
        _edge("GOVERNS", _id("rule", "p_size"), _id("part", "p_partkey"), "part WHERE p_partkey % 7 = 0"),
        _edge("GOVERNS", _id("rule", "p_size"), _id("concept", "k"), f"part JOIN {_TYPES} t ON p_type = ptype WHERE p_partkey % 11 = 0", True),
        _edge("ANNOTATES", _id("concept", "k"), _id("part", "p_partkey"), f"part JOIN {_TYPES} t ON p_type = ptype WHERE p_partkey % 13 = 0"),
        _edge("ANNOTATES", _id("rule", "p_size"), _id("customer", "p_partkey"), f"part JOIN customer ON c_custkey = p_partkey WHERE p_partkey % 3 = 0", False),
        _edge("IMPLEMENTS", _id("part", "p_partkey"), _id("concept", "k"), f"part JOIN {_TYPES} t ON p_type = ptype WHERE p_partkey % 5 = 0"),
        _edge("RELATED_TO", _id("concept", "a.k"), _id("concept", "b.k"), f"{_TYPES} a JOIN {_TYPES} b ON b.k = a.k * 2 + 1"),
        _edge("DECIDED_BY", _id("decision", "n_nationkey"), _id("supplier", "s_suppkey"), "nation JOIN supplier ON s_nationkey = n_nationkey"),
        _edge("REFERENCES", _id("orders", "o_orderkey"), _id("customer", "(o_custkey * 7 + 3) % (SELECT count(*) FROM customer)"), "orders WHERE o_orderkey % 10 = 0", True),
        _edge("IMPORTS", _id("nation", "a.n_nationkey"), _id("nation", "b.n_nationkey"), "nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey * 3 + 1) % 25 WHERE a.n_nationkey % 2 = 0"),
    ]
)

#: For an oracle: the graph as common table expressions, to be followed by a query over nodes and edges.
WITH_SQL = f"WITH RECURSIVE nodes AS ({NODES_SQL}), edges AS ({EDGES_SQL})".replace("/ 3) % 4", "// 3) % 4").replace("% 2) / 2", "% 2) // 2")


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph of the tables in a folder.  Tables are referred to by subquery, so that nothing is
    registered under a global name."""
    return Graph(*(over(spark, sf_dir, q) for q in (NODES_SQL, EDGES_SQL)))


_STORED: dict[tuple[str, str], str] = {}


def stored_star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The same graph from storage: written once for a session and folder, nodes by label and edges by
    type, so that a query's scan prunes to the labels and types it names."""
    from ..operators.store import load, save

    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        path = fresh_path(spark, "star")
        save(star_graph(spark, sf_dir), path, apart=True)  # each statement of the union has one label or type
        _STORED[key] = path
    return load(spark, _STORED[key])


def over(spark: SparkSession, sf_dir: str, sql: str):
    """A statement over the tables of a folder, which are bound by argument, not by global views."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    used = {t: f for t, f in frames.items() if f" {t} " in f" {sql} " or f" {t})" in sql}
    marked = sql
    for t in used:
        marked = _bind(marked, t)
    return spark.sql(marked.replace("//", "div"), **used)


def _bind(sql: str, name: str) -> str:
    import re

    return re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", sql)
