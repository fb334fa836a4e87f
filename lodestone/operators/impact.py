"""What a node reaches: blast radius, knowledge behind it, other repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.graph import Graph, reach

BLAST = ("CALLS", "REFERENCES", "INHERITS", "IMPLEMENTS", "ANNOTATES")
KNOWLEDGE_LINKS = ("ANNOTATES", "IMPLEMENTS", "GOVERNS")
KNOWLEDGE = ("Concept", "Rule", "Decision", "WikiPage")


def blast_radius(g: Graph, roots: DataFrame, depth: int = 3, direction: str = "out") -> DataFrame:
    """Distinct (type, name, file_path, line, level) within ``depth`` steps along code edges."""
    found = g.attach(reach(g, roots, BLAST, depth, direction), "label", "name", "file_path", "line_start")
    return found.groupBy(F.col("label").alias("type"), "name", "file_path", F.col("line_start").alias("line")).agg(F.min("level").alias("level"))


def blast_summary(g: Graph, roots: DataFrame, depth: int = 3) -> DataFrame:
    """One row: nodes and files affected, the requested depth if any node is, and the deepest level."""
    rows = blast_radius(g, roots, depth)
    files = F.array_sort(F.collect_set(F.when(F.col("file_path") != "", F.col("file_path"))))
    return rows.agg(F.count("*").alias("affected"), files.alias("affected_files"), F.when(F.count("*") > 0, F.lit(depth)).otherwise(F.lit(0)).alias("depth_reached"), F.max("level").alias("max_level"))


def affected_knowledge(g: Graph, roots: DataFrame, depth: int = 2) -> DataFrame:
    found = g.attach(reach(g, roots, KNOWLEDGE_LINKS, depth), "label", "name")
    return found.where(F.col("label").isin(*KNOWLEDGE)).select(F.col("label").alias("type"), "name").distinct()


def cross_repo_blast(g: Graph, roots: DataFrame, depth: int = 3) -> DataFrame:
    """Blast radius with the repositories that contain each node within three steps (null without)."""
    found = reach(g, roots, BLAST, depth).select("id").distinct()
    up = reach(g, found, ["CONTAINS"], 3, "in", per_root=True).select("root", F.col("id").alias("repo_id"))
    repos = g.attach(up.withColumnRenamed("repo_id", "id"), "label", "name").where("label = 'Repository'").select(F.col("root").alias("id"), F.col("name").alias("repo_name"))
    nodes = g.attach(found, "label", "name", "file_path")
    return nodes.join(repos, "id", "left").select(F.col("label").alias("type"), "name", "file_path", "repo_name").distinct()


def federated_blast(graphs: dict[str, Graph], name: str, file_path: str = "", depth: int = 3) -> DataFrame:
    """Blast radius from the same name in each of several graphs, tagged with the graph's name."""
    parts = [blast_radius(g, g.root(name, file_path), depth).withColumn("graph", F.lit(k)) for k, g in graphs.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def repo_dependencies(g: Graph) -> DataFrame:
    repos = g.of("Repository").select("id", "name")
    e = g.links("DEPENDS_ON")
    return e.join(repos.select(F.col("id").alias("src"), F.col("name").alias("repo")), "src").join(repos.select(F.col("id").alias("dst"), F.col("name").alias("depends_on")), "dst").select("repo", "depends_on").distinct()
