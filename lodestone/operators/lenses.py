"""Lenses: fixed views of the graph as pairs or lists, and a registry for more."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.graph import Graph, any_of, reach, top

# Name parts of request entry points, and suffixes of framework components.
ENTRY_PARTS = ("controller", "handler", "router", "view")
ENTRY_LABELS = ("Controller", "Handler", "Router", "View")
COMPONENT_SUFFIXES = (
    "Controller", "Service", "Repository", "Model", "Middleware", "Serializer", "View", "Handler", "Router", "Provider", "Resolver", "Gateway", "Component", "Module", "Guard", "Interceptor",
)

_PAIR = ("a_type", "a_name", "a_file", "b_type", "b_name", "b_file")


def _pairs(g: Graph, pairs: DataFrame) -> DataFrame:
    """(a, b) id pairs with label, name and file of both."""
    n = g.nodes.select("id", "label", "name", F.coalesce("file_path", "path", F.lit("")).alias("file"))
    a = n.select(F.col("id").alias("a"), F.col("label").alias("a_type"), F.col("name").alias("a_name"), F.col("file").alias("a_file"))
    b = n.select(F.col("id").alias("b"), F.col("label").alias("b_type"), F.col("name").alias("b_name"), F.col("file").alias("b_file"))
    return pairs.join(a, "a").join(b, "b").select(*_PAIR)


def _first(df: DataFrame, n: int) -> DataFrame:
    return top(df.distinct(), n, *_PAIR)


def request_path(g: Graph, symbol: str = "", limit: int = 100, use_semantic_type: bool = False) -> DataFrame:
    """Entry points and what they call within five calls."""
    label = F.coalesce("semantic_type", "label") if use_semantic_type else F.col("label")
    roots = g.nodes.where(any_of(F.lower("name"), ENTRY_PARTS) | label.isin(*ENTRY_LABELS))
    if symbol:
        roots = roots.where(F.col("name") == symbol)
    found = reach(g, roots.select("id"), ["CALLS"], 5, per_root=True)
    return _first(_pairs(g, found.select(F.col("root").alias("a"), F.col("id").alias("b"))), limit)


def ownership_map(g: Graph, domain: str = "", limit: int = 200) -> DataFrame:
    e = g.links("ASSIGNED_TO").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    if domain:
        inside = g.links("BELONGS_TO").join(g.root(domain, labels=["Domain"]).withColumnRenamed("id", "dst"), "dst", "left_semi")
        e = e.join(inside.select(F.col("src").alias("a")), "a", "left_semi")
    return _first(_pairs(g, e), limit)


def domain_boundaries(g: Graph, limit: int = 100) -> DataFrame:
    """Calls whose two ends belong to different domains."""
    inside = g.links("BELONGS_TO").select("src", "dst")
    a = inside.select(F.col("src").alias("a"), F.col("dst").alias("da"))
    b = inside.select(F.col("src").alias("b"), F.col("dst").alias("db"))
    e = g.links("CALLS").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return _first(_pairs(g, e.join(a, "a").join(b, "b").where("da <> db").select("a", "b")), limit)


def dependency_layers(g: Graph, file: str = "", limit: int = 200) -> DataFrame:
    rows = _pairs(g, g.links("IMPORTS", "DEPENDS_ON").select(F.col("src").alias("a"), F.col("dst").alias("b")))
    if file:
        rows = rows.where((F.col("a_file") == file) | (F.col("b_file") == file))
    return _first(rows, limit)


def framework_components(g: Graph, limit: int = 200, use_semantic_type: bool = False) -> DataFrame:
    label = F.coalesce("semantic_type", "label") if use_semantic_type else F.col("label")
    hit = g.nodes.where(label.rlike(f"({'|'.join(COMPONENT_SUFFIXES)})$"))
    return top(hit.select(label.alias("type"), "name", F.coalesce("file_path", "path", F.lit("")).alias("file")).distinct(), limit, "type", "name", "file")


Lens = Callable[..., DataFrame]
_LENSES: dict[str, Lens] = {"request_path": request_path, "ownership_map": ownership_map, "domain_boundaries": domain_boundaries, "dependency_layers": dependency_layers, "framework_components": framework_components}


def register(name: str, lens: Lens | str) -> None:
    """Add a lens: a function of a graph, or SQL over the views nodes and edges."""
    if isinstance(lens, str):
        text = lens
        lens = lambda g, **named: g.spark.sql(text.replace("nodes", "{nodes}").replace("edges", "{edges}"), args=named or None, nodes=g.nodes, edges=g.edges)
    _LENSES[name] = lens


def apply(g: Graph, name: str, **parameters) -> DataFrame:
    if name not in _LENSES:
        raise KeyError(f"no lens {name!r}; there are {', '.join(sorted(_LENSES))}")
    return _LENSES[name](g, **parameters)


def names() -> list[str]:
    return sorted(_LENSES)
