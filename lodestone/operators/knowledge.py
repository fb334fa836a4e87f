"""Writing knowledge: concepts, rules, decisions, people, pages, and what they are linked to."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.graph import Graph
from .intelligence import Provider
from .store import NODE_COLUMNS, conform, node_id, resolve_edges, upsert_nodes


class Knowledge:
    """Collects nodes and edges and merges them into a graph in one go."""

    def __init__(self, graph: Graph):
        self.graph = graph
        self.nodes: list[dict] = []
        self.edges: list[dict] = []

    def add(self, label: str, name: str, **properties) -> Knowledge:
        """A node; one with a domain also gets the domain and a link to it."""
        self.nodes.append({"label": label, "name": name} | properties)
        if properties.get("domain") and label != "Domain":
            self.nodes.append({"label": "Domain", "name": properties["domain"]})
            self.link((label, name), "BELONGS_TO", ("Domain", properties["domain"]))
        return self

    def add_domain(self, name: str, description: str = "") -> Knowledge:
        return self.add("Domain", name, description=description)

    def add_concept(self, name: str, description: str = "", domain: str = "", status: str = "") -> Knowledge:
        return self.add("Concept", name, description=description, domain=domain, status=status)

    def add_rule(self, name: str, description: str = "", domain: str = "", severity: str = "info", rationale: str = "", constraint: dict | None = None) -> Knowledge:
        return self.add("Rule", name, description=description, domain=domain, severity=severity, rationale=rationale, constraint_json=json.dumps(constraint) if constraint else None)

    def add_decision(self, name: str, description: str = "", domain: str = "", status: str = "accepted", rationale: str = "", date: str = "") -> Knowledge:
        return self.add("Decision", name, description=description, domain=domain, status=status, rationale=rationale, date=date)

    def add_person(self, name: str, email: str = "", role: str = "", team: str = "") -> Knowledge:
        return self.add("Person", name, email=email, role=role, team=team)

    def add_wiki_page(self, name: str, content: str = "", url: str = "") -> Knowledge:
        return self.add("WikiPage", name, content=content[:4000], description=url)

    def link(self, a: tuple[str, str], kind: str, b: tuple[str, str], a_file: str = "", b_file: str = "") -> Knowledge:
        self.edges.append({"from_label": a[0], "from_name": a[1], "from_file": a_file, "type": kind, "to_label": b[0], "to_name": b[1], "to_file": b_file})
        return self

    def relate_concepts(self, a: str, b: str) -> Knowledge:
        return self.link(("Concept", a), "RELATED_TO", ("Concept", b))

    def rule_governs(self, rule: str, label: str, name: str) -> Knowledge:
        return self.link(("Rule", rule), "GOVERNS", (label, name))

    def assign(self, label: str, name: str, person: str) -> Knowledge:
        return self.link((label, name), "ASSIGNED_TO", ("Person", person))

    def wiki_documents(self, page: str, label: str, name: str) -> Knowledge:
        return self.link(("WikiPage", page), "DOCUMENTS", (label, name))

    def code_implements(self, label: str, name: str, concept: str, file_path: str = "") -> Knowledge:
        return self.link((label, name), "IMPLEMENTS", ("Concept", concept), a_file=file_path)

    def annotate(self, label: str, name: str, concept: str = "", rule: str = "", file_path: str = "") -> Knowledge:
        for kind, by in (("Concept", concept), ("Rule", rule)):
            if by:
                self.link((kind, by), "ANNOTATES", (label, name), b_file=file_path)
        return self

    def govern(self, memory: str, label: str, name: str, file_path: str = "", repo: str = "") -> Knowledge:
        """A memory governs a symbol.  A memory name that several repositories have is refused."""
        rows = self.graph.nodes.where(F.col("memory_type").isNotNull() & (F.col("name") == memory))
        rows = rows.where(F.col("repo") == repo) if repo else rows
        found = rows.select("label", "repo").distinct().limit(2).collect()
        if len(found) != 1:
            raise ValueError(f"memory {memory!r} is {'ambiguous' if found else 'unknown'}; name its repository")
        return self.link((found[0].label, memory), "GOVERNS", (label, name), b_file=file_path)

    def merged(self) -> tuple[Graph, DataFrame]:
        """(graph with everything merged in, edges that found no ends).  Nodes merge by identity; nodes
        that were there keep their ids."""
        spark = self.graph.spark
        columns = [c for c in NODE_COLUMNS if c != "id"]
        schema = ", ".join(f"{c} {NODE_COLUMNS[c]}" for c in columns) + ", seq bigint"
        new = spark.createDataFrame([(*(n.get(c) for c in columns), i) for i, n in enumerate(self.nodes)], schema)
        old = self.graph.nodes.withColumn("key", node_id())
        ids = old.select("key", F.col("id").alias("own")).dropDuplicates(["key"])
        nodes = upsert_nodes(self.graph.nodes, new).join(ids, F.col("id") == F.col("key"), "left")
        nodes = conform(nodes.withColumn("id", F.coalesce("own", "id")).drop("own", "key"), NODE_COLUMNS)
        wanted = spark.createDataFrame([tuple(e.values()) for e in self.edges], "from_label string, from_name string, from_file string, type string, to_label string, to_name string, to_file string")
        edges, lost = resolve_edges(nodes, wanted)
        return Graph(nodes, self.graph.edges.select("src", "dst", "type").unionByName(edges).distinct()), lost


def extract_decisions(tickets: DataFrame, provider: Provider) -> DataFrame:
    """(ticket, name, rationale, status) of decisions that a provider finds in tickets (name, text).  It has
    to answer with a JSON list of objects; other answers count as none."""
    import pandas as pd

    def run(parts):
        for part in parts:
            rows = []
            for name, text in zip(part.name_, part.text, strict=True):
                try:
                    found = json.loads(provider.complete(f"List the decisions in this ticket as JSON with name, rationale, status.\n{text}"))
                except ValueError:
                    found = []
                rows += [(name, d["name"], d.get("rationale", ""), d.get("status", "proposed")) for d in found if isinstance(d, dict) and d.get("name")]
            yield pd.DataFrame(rows, columns=["ticket", "name", "rationale", "status"])

    return tickets.select(F.col("name").alias("name_"), "text").mapInPandas(run, "ticket string, name string, rationale string, status string")
