"""Context and search: what surrounds a node, and which nodes match a text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.graph import SYMBOLS, Graph, hops, reach, settle, top

_PLACE = ("label", "name", "file_path", "line_start")


def _ends(g: Graph, ids: DataFrame, *columns: str) -> DataFrame:
    return g.attach(ids.select("id").distinct(), *columns)


def file_contents(g: Graph, path: str) -> DataFrame:
    """(type, name, line, docstring, signature) of what a file contains or imports, by line."""
    file = g.of("File").where(F.col("path") == path).select(F.col("id").alias("src"))
    hit = g.links("CONTAINS", "IMPORTS").join(file, "src").select(F.col("dst").alias("id"), F.col("type").alias("rel"))
    rows = g.attach(hit, "label", "name", "line_start", "docstring", "signature")
    rows = rows.where((F.col("rel") == "CONTAINS") | (F.col("label") == "Import"))
    own = F.col("rel") == "CONTAINS"
    out = rows.select(F.col("label").alias("type"), "name", F.col("line_start").alias("line"), F.when(own, F.col("docstring")).alias("docstring"), F.when(own, F.col("signature")).alias("signature"))
    return out.distinct().orderBy("line", "type", "name")


def direct_imports(g: Graph, name: str, file_path: str) -> DataFrame:
    hit = g.links("IMPORTS").join(g.root(name, file_path).withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"))
    return g.attach(hit, "label", "name", "file_path").select(F.col("label").alias("type"), "name", "file_path")


def call_neighbours(g: Graph, roots: DataFrame, depth: int = 2, direction: str = "in") -> DataFrame:
    """Distinct callers ('in') or callees ('out') within ``depth`` calls."""
    found = reach(g, roots, ["CALLS"], depth, direction)
    return _ends(g, found, *_PLACE).select(F.col("label").alias("type"), "name", "file_path", F.col("line_start").alias("line")).distinct()


def function_context(g: Graph, roots: DataFrame, depth: int = 2) -> DataFrame:
    """Callees, callers and decorators of functions, told apart by ``role``."""
    parts = [call_neighbours(g, roots, depth, d).withColumn("role", F.lit(r)) for r, d in (("callee", "out"), ("caller", "in"))]
    return parts[0].unionByName(parts[1]).unionByName(decorators_for(g, roots).withColumn("role", F.lit("decorator")))


def _into(g: Graph, roots: DataFrame, kind: str) -> DataFrame:
    return g.links(kind).join(roots.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id"))


def decorators_for(g: Graph, roots: DataFrame) -> DataFrame:
    return g.attach(_into(g, roots, "DECORATES"), *_PLACE).where("label = 'Decorator'").select(F.col("label").alias("type"), "name", "file_path", F.col("line_start").alias("line"))


def decorated_by(g: Graph, decorator: str) -> DataFrame:
    """What a decorator marks.  Ids are settled first: where they are few, nodes are not shuffled to meet them."""
    marks = g.root(decorator, labels=["Decorator"]).withColumnRenamed("id", "src")
    marked = settle(g.links("DECORATES").join(marks, "src").select(F.col("dst").alias("id")), "marked")
    return g.attach(marked, *_PLACE).select(F.col("label").alias("type"), "name", "file_path", F.col("line_start").alias("line"))


def references_to(g: Graph, roots: DataFrame) -> DataFrame:
    return g.attach(_into(g, roots, "REFERENCES"), *_PLACE).select(F.col("label").alias("type"), "name", "file_path", F.col("line_start").alias("line")).distinct()


def ancestors(g: Graph, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """Each class above the roots, however far, or up to ``depth``, with its distance.  Inheritance has no cycles, and in a hierarchy with
    one base for each class distinct nodes are the paths; ``trails`` counts paths otherwise."""
    return g.attach(reach(g, roots, ["INHERITS"], depth), "name", "file_path").select("name", "file_path", "level")


def subclasses(g: Graph, roots: DataFrame, depth: int | None = None) -> DataFrame:
    found = reach(g, roots, ["INHERITS"], depth, "in")
    return g.attach(found, "label", "name", "file_path").where("label = 'Class'").select("name", "file_path", "level")


def neighbours(g: Graph, roots: DataFrame, depth: int = 1) -> DataFrame:
    """Nodes within ``depth`` steps of any type and direction; a root with none keeps one row of nulls.

    A root is its own neighbour only by a closed path that uses no edge twice: for depth 1 a loop, for
    depth 2 two parallel edges as well; longer ones are looked for by ``trails`` from the roots.
    """
    base = g.attach(roots.select("id").distinct(), "label", "name").select(F.col("id").alias("root"), F.col("label").alias("root_type"), F.col("name").alias("root_name"))
    found = reach(g, roots, [], depth, "both", per_root=True).where("root <> id").select("root", "id")
    links = g.links().where("src = dst").select(F.col("src").alias("root"), F.col("src").alias("id"))
    closed = links
    if depth >= 2:
        ends = g.links().where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
        twins = ends.groupBy("a", "b").count().where("count > 1")
        closed = closed.unionByName(twins.select(F.col("a").alias("root"), F.col("a").alias("id"))).unionByName(twins.select(F.col("b").alias("root"), F.col("b").alias("id")))
    closed = closed.join(roots.select(F.col("id").alias("root")), "root", "left_semi").distinct()
    if depth >= 3:
        closed = closed.unionByName(_closed_trails(g, roots, depth)).distinct()
    ends = g.attach(found.unionByName(closed), "label", "name", "file_path").select("root", F.col("label").alias("neighbor_type"), F.col("name").alias("neighbor_name"), F.col("file_path").alias("neighbor_file_path"))
    return base.join(ends, "root", "left").drop("root").distinct()


def _closed_trails(g: Graph, roots: DataFrame, depth: int) -> DataFrame:
    edges = g.links().select("src", "dst", F.concat_ws("-", "src", "dst", "type").alias("edge"))
    step = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "edge").unionByName(edges.where("src <> dst").select(F.col("dst").alias("a"), F.col("src").alias("b"), "edge"))
    front = roots.select(F.col("id").alias("root"), "id", F.array().cast("array<string>").alias("used"))
    home = None
    for _ in range(depth):
        front = settle(front.join(step, F.col("id") == F.col("a")).where(~F.array_contains("used", F.col("edge"))).select("root", F.col("b").alias("id"), F.concat("used", F.array("edge")).alias("used")))
        back = front.where("root = id").select("root", "id").distinct()
        home = back if home is None else home.unionByName(back)
    return home


def explain(g: Graph, roots: DataFrame) -> DataFrame:
    """Every edge out of and into the roots, with the node at its other end."""
    out = g.links().join(roots.select(F.col("id").alias("src")), "src").select(F.lit("out").alias("direction"), F.col("type").alias("rel"), F.col("dst").alias("id"))
    back = g.links().join(roots.select(F.col("id").alias("dst")), "dst").select(F.lit("in").alias("direction"), F.col("type").alias("rel"), F.col("src").alias("id"))
    return g.attach(out.unionByName(back), "label", "name", "file_path").select("direction", "rel", F.col("label").alias("type"), "name", "file_path")


def node_detail(g: Graph, node: int, each: int = 100) -> DataFrame:
    """Up to ``each`` neighbours out of and into one node, each (name, file, relation) once."""
    one = g.nodes.where(F.col("id") == node).select("id")
    rows = explain(g, one).select("direction", "rel", "type", "name", "file_path").distinct()
    parts = [top(rows.where(F.col("direction") == d), each, "rel", "name", "file_path", "type") for d in ("out", "in")]
    return parts[0].unionByName(parts[1])


def _scoped(df: DataFrame, repo: str) -> DataFrame:
    return df.where(F.col("repo") == repo) if repo else df


def symbol_search(g: Graph, query: str, limit: int = 20, repo: str = "") -> DataFrame:
    """Functions, classes and methods whose name contains the query, case kept."""
    hit = _scoped(g.of(*SYMBOLS), repo).where(F.col("name").contains(query))
    return top(hit, limit, "name", "file_path", "id").select(F.col("label").alias("type"), "name", "file_path", F.col("line_start").alias("line"), "docstring")


def docstring_search(g: Graph, query: str, limit: int = 20, repo: str = "") -> DataFrame:
    hit = _scoped(g.of(*SYMBOLS), repo).where(F.lower("docstring").contains(query.lower()))
    return top(hit, limit, "name", "file_path", "id").select(F.col("label").alias("type"), "name", "file_path", F.col("line_start").alias("line"), "docstring")


def knowledge_search(g: Graph, query: str, limit: int = 20, repo: str = "") -> DataFrame:
    """Knowledge nodes whose name, description or content has the query, case ignored.  ``repo`` is a
    node's own or one of its comma-separated list."""
    q = query.lower()
    hit = g.of("Concept", "Rule", "Decision", "WikiPage", "Document")
    test = F.lit(False)
    for c in ("name", "description", "content"):
        test = test | F.coalesce(F.lower(c).contains(q), F.lit(False))
    if repo:
        hit = hit.where((F.col("repo") == repo) | F.array_contains(F.split("repo", ","), repo))
    return top(hit.where(test), limit, "label", "name", "id").select(F.col("label").alias("type"), "name", "description", "domain", "status")


def global_search(g: Graph, query: str, limit: int = 20) -> DataFrame:
    q = query.lower()
    hit = g.of("Function", "Class", "Method", "Concept", "Rule", "Decision", "WikiPage", "Document")
    test = F.lit(False)
    for c in ("name", "docstring", "description", "content"):
        test = test | F.coalesce(F.lower(c).contains(q), F.lit(False))
    return top(hit.where(test), limit, "label", "name", "id").select(F.col("label").alias("type"), "name", F.coalesce("file_path", "path", F.lit("")).alias("file_path"), F.coalesce("docstring", "description", "content", F.lit("")).alias("summary"), "line_start")


def domain_contents(g: Graph, domain: str) -> DataFrame:
    ids = _into(g, g.root(domain, labels=["Domain"]), "BELONGS_TO")
    return g.attach(ids, "label", "name", "file_path", "docstring", "description").select(F.col("label").alias("type"), "name", "file_path", F.coalesce("docstring", "description").alias("summary")).orderBy("type", "name", "file_path")


def _names(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.array_sort(F.collect_set("name")).alias(name))


def _side(g: Graph, roots: DataFrame, kind: str, label: str | None, direction: str, name: str) -> DataFrame:
    """One branch of a context, aggregated by root before it meets the others."""
    step = hops(g.links(kind), direction)
    rows = step.join(roots.select(F.col("id").alias("a")), "a").select("a", F.col("b").alias("id"))
    ends = g.attach(rows, "label", "name")
    return _names(ends.where(F.col("label") == label) if label else ends, "a", name).withColumnRenamed("a", "root")


def concept_context(g: Graph, name: str) -> DataFrame:
    """A concept with sorted name lists of related concepts, rules, wiki pages, implementors, domains.
    Each branch is aggregated by itself and then joined, so branches don't multiply."""
    roots = g.root(name, labels=["Concept"])
    out = g.attach(roots, "name", "description", "status", "domain").withColumnRenamed("id", "root")
    branches = (("RELATED_TO", "Concept", "both", "related"), ("GOVERNS", "Rule", "in", "rules"), ("DOCUMENTS", "WikiPage", "in", "wiki"), ("IMPLEMENTS", None, "in", "implementations"), ("BELONGS_TO", "Domain", "out", "domains"))
    for kind, label, way, column in branches:
        out = out.join(_side(g, roots, kind, label, way, column), "root", "left").withColumn(column, F.coalesce(column, F.array().cast("array<string>")))
    return out.drop("root")


def decision_context(g: Graph, name: str) -> DataFrame:
    roots = g.root(name, labels=["Decision"])
    out = g.attach(roots, "name", "description", "rationale", "status", "date").withColumnRenamed("id", "root")
    for kind, label, way, column in (("DOCUMENTS", None, "out", "documents"), ("DECIDED_BY", "Person", "out", "decided_by"), ("BELONGS_TO", "Domain", "out", "domains")):
        out = out.join(_side(g, roots, kind, label, way, column), "root", "left").withColumn(column, F.coalesce(column, F.array().cast("array<string>")))
    return out.drop("root")


def owners(g: Graph, roots: DataFrame) -> DataFrame:
    rows = g.links("ASSIGNED_TO").join(roots.select(F.col("id").alias("src")), "src").select("src", F.col("dst").alias("id"))
    who = g.attach(rows, "label", "name", "email", "role", "team").where("label = 'Person'").select(F.col("src").alias("id"), F.col("name").alias("owner"), "email", "role", "team")
    return g.attach(who, "label", "name").select(F.col("label").alias("node_type"), F.col("name").alias("node"), "owner", "email", "role", "team")


def memory_list(g: Graph, memory_type: str = "", repo: str = "", scope: str = "repo", limit: int = 50) -> DataFrame:
    rows = g.nodes.where(F.col("memory_type").isNotNull())
    if memory_type:
        rows = rows.where(F.col("memory_type") == memory_type)
    if scope != "workspace":
        rows = _scoped(rows, repo)
    return top(rows, limit, "memory_type", "name", "id").select("memory_type", "name", F.col("label").alias("type"), "repo", "description")


def memory_get(g: Graph, name: str, repo: str = "") -> DataFrame:
    """The memory nodes of a name; ``ambiguous`` where they lie in several repositories."""
    rows = _scoped(g.nodes.where(F.col("memory_type").isNotNull() & (F.col("name") == name)), repo)
    n = rows.agg(F.countDistinct("repo").alias("n_repos"))
    n = n.select("n_repos", F.lit(1).alias("one"))
    rows = rows.select("memory_type", "name", F.col("label").alias("type"), "repo", "rationale", F.lit(1).alias("one"))
    return rows.join(n, "one").withColumn("ambiguous", F.col("n_repos") > 1).drop("n_repos", "one")


def memory_for_file(g: Graph, path: str) -> DataFrame:
    file = g.of("File").where(F.col("path") == path).select(F.col("id").alias("src"))
    inside = g.links("CONTAINS").join(file, "src").select(F.col("dst").alias("symbol"))
    known = g.links("GOVERNS", "ANNOTATES", "DOCUMENTS").join(inside, F.col("dst") == F.col("symbol")).select(F.col("src").alias("id"), "symbol")
    rows = g.attach(known, "memory_type", "name", "label", "rationale").where(F.col("memory_type").isNotNull())
    return g.attach(rows.select("memory_type", "name", "label", "rationale", F.col("symbol").alias("id")), F.col("name").alias("target")).select("memory_type", "name", F.col("label").alias("type"), "rationale", "target").distinct()


def type_counts(g: Graph) -> DataFrame:
    """Nodes by label and edges by type, most first."""
    n = g.nodes.groupBy(F.col("label").alias("kind")).agg(F.count("*").alias("n")).withColumn("what", F.lit("node"))
    e = g.edges.groupBy(F.col("type").alias("kind")).agg(F.count("*").alias("n")).withColumn("what", F.lit("edge"))
    return n.unionByName(e).select("what", "kind", "n").orderBy("what", F.desc("n"), "kind")


def repo_counts(g: Graph, repo: str) -> DataFrame:
    """Nodes of a repository and edges with both ends in it."""
    ids = _scoped(g.nodes, repo).select("id")
    inside = g.links().join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    return ids.agg(F.count("*").alias("n")).withColumn("what", F.lit("node")).unionByName(inside.agg(F.count("*").alias("n")).withColumn("what", F.lit("edge"))).select("what", "n")


def list_repos(g: Graph, anchors: list[str] | None = None) -> DataFrame:
    """Anchored repositories if named, else all."""
    rows = g.of("Repository")
    return (rows.where(F.col("name").isin(anchors)) if anchors else rows).select("name", "path").orderBy("name")


def cross_repo_search(g: Graph, query: str, limit: int = 20) -> DataFrame:
    """Nodes of any label whose name has the query, case ignored; of one (label, name) the one of the
    first repository."""
    hit = g.nodes.where(F.lower("name").contains(query.lower()))
    best = hit.groupBy("label", "name").agg(F.min(F.struct(F.coalesce("repo", F.lit("")).alias("repo"), F.col("id"))).alias("m"))
    return top(best.select("label", "name", F.col("m.repo").alias("repo")), limit, "label", "name", "repo")


def bundle_to_json(target: dict, rows: list[dict], edges: list[dict]) -> str:
    """A context as JSON, on the driver."""
    return json.dumps({"target": target, "nodes": rows, "edges": edges}, indent=2, default=str)


def bundle_to_markdown(target: dict, rows: list[dict]) -> str:
    lines = [f"# {target.get('type', 'Node')}: {target.get('name', '')}", ""]
    if target.get("file_path"):
        lines.append(f"`{target['file_path']}`\n")
    by_role: dict[str, list[dict]] = {}
    for r in rows:
        by_role.setdefault(r.get("role") or r.get("rel") or "related", []).append(r)
    for role, some in by_role.items():
        lines.append(f"## {role}")
        lines += [f"- **{r.get('type', '')}** {r.get('name', '')}" + (f" — `{r['file_path']}`" if r.get("file_path") else "") for r in some]
    return "\n".join(lines) + "\n"


