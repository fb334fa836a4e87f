"""Drift: where the code and what is known or decided about it have come apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.graph import Graph, settle
from .structure import ranked

COLUMNS = ("check", "severity", "message", "offending_node", "offending_file", "knowledge_node", "knowledge_type")


def _in_domain(g: Graph, *labels: str) -> DataFrame:
    """(id, label, name, file_path, domain_name) of the members of each domain."""
    domains = g.of("Domain").select(F.col("id").alias("dst"), F.col("name").alias("domain_name"))
    member = g.links("BELONGS_TO").join(domains, "dst").select(F.col("src").alias("id"), "domain_name").distinct()
    return member.join(g.of(*labels).select("id", "label", "name", "file_path"), "id")


def _report(df: DataFrame, check: str, severity, message, node="name", file="file_path", knowledge="domain_name", kind="Domain") -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select(
        F.lit(check).alias("check"), lit(severity).alias("severity"), message.alias("message"),
        F.coalesce(F.col(node), F.lit("")).alias("offending_node"), F.coalesce(F.col(file), F.lit("")).alias("offending_file"),
        F.coalesce(F.col(knowledge), F.lit("")).alias("knowledge_node"), lit(kind).alias("knowledge_type"),
    )


def stale_memory(g: Graph) -> DataFrame:
    """Memory that governs or annotates something without a name that is no repository, file, document."""
    known = g.nodes.where(F.col("memory_type").isNotNull()).select(F.col("id").alias("src"), F.col("name").alias("domain_name"), "memory_type")
    hit = g.links("GOVERNS", "ANNOTATES").join(known, "src").select(F.col("dst").alias("id"), "domain_name", "memory_type")
    gone = g.nodes.where(F.col("name").isNull() & ~F.col("label").isin("Repository", "File", "Document")).select("id", "name", "file_path")
    return _report(hit.join(gone, "id"), "STALE_MEMORY_REF", "warning", F.lit("Memory node governs a symbol that no longer exists"), kind=F.col("memory_type"))


def undocumented(g: Graph, limit: int | None = 50) -> DataFrame:
    """Symbols of a domain that nothing documents, annotates or governs."""
    known = g.links("DOCUMENTS", "ANNOTATES", "GOVERNS").select(F.col("dst").alias("id"))
    rows = _in_domain(g, "Function", "Class", "Method").join(known, "id", "left_anti")
    rows = rows.orderBy("domain_name", "name", "id").limit(limit) if limit else rows
    return _report(rows, "UNDOCUMENTED_DOMAIN_SYMBOL", "warning", F.concat(F.lit("Symbol in domain '"), "domain_name", F.lit("' has no linked docs or rules")))


def missing_owners(g: Graph, rules: int = 20, each: int = 20) -> DataFrame:
    """Where feedback asks for owners in a domain: its functions and classes that have none."""
    asks = g.of("Rule").where((F.col("memory_type") == "feedback") & (F.lower("name").contains("owner") | F.lower("rationale").contains("owner")) & (F.col("domain") != ""))
    asks = asks.orderBy("name", "id").limit(rules).select(F.col("name").alias("rule"), F.col("domain").alias("domain_name"))
    people = g.of("Person").select(F.col("id").alias("dst"))
    owned = g.links("ASSIGNED_TO").join(people, "dst", "left_semi").select(F.col("src").alias("id"))
    rows = _in_domain(g, "Function", "Class").join(asks, "domain_name").join(owned, "id", "left_anti")
    rows = ranked(rows, ["rule", "domain_name"], each, "name", "id")
    return _report(rows, "MISSING_OWNER", "warning", F.concat(F.lit("Symbol in domain '"), "domain_name", F.lit("' has no owner")), knowledge="rule", kind="Rule")


CONSTRAINT = "type string, `from` string, `to` string, `order` array<string>, label string, domain string, max bigint"


def constraints(g: Graph) -> DataFrame:
    """(rule, severity, knowledge_type, c) of the constraints that rules and live decisions carry as JSON."""
    rules = g.of("Rule").select("name", F.coalesce("severity", F.lit("warning")).alias("severity"), F.lit("Rule").alias("knowledge_type"), "constraint_json")
    decided = g.of("Decision").where(F.col("status") != "deprecated").select("name", F.lit("warning").alias("severity"), F.lit("Decision").alias("knowledge_type"), "constraint_json")
    both = rules.unionByName(decided).where(F.col("constraint_json").isNotNull())
    return both.select(F.col("name").alias("rule"), "severity", "knowledge_type", F.from_json("constraint_json", CONSTRAINT).alias("c")).where("c.type IS NOT NULL")


def _few(rules: DataFrame) -> DataFrame:
    """Rules settled: as a table of known size they meet nodes without a shuffle while they are few."""
    return settle(rules, "rules")


def forbidden_dependencies(g: Graph, rules: DataFrame, each: int = 20) -> DataFrame:
    """Calls, imports, inheritance from one domain to another that a rule forbids."""
    rules = _few(rules.where("c.type = 'FORBIDDEN_DEP' AND c.from <> '' AND c.to <> ''").select("rule", "severity", "knowledge_type", F.col("c.from").alias("da"), F.col("c.to").alias("db")))
    member = _in_domain(g)
    a = member.select(F.col("id").alias("src"), F.col("name").alias("name"), "file_path", F.col("domain_name").alias("da"))
    b = member.select(F.col("id").alias("dst"), F.col("name").alias("to_name"), F.col("domain_name").alias("db"))
    edges = g.links("CALLS", "IMPORTS", "INHERITS").select("src", "dst").distinct()
    rows = a.join(rules, "da").join(edges, "src").join(b, ["dst", "db"])
    rows = ranked(rows, ["rule", "da", "db"], each, "name", "to_name", "src", "dst")
    text = F.concat(F.lit("'"), "name", F.lit("' in domain '"), "da", F.lit("' depends on '"), "to_name", F.lit("' in domain '"), "db", F.lit("'"))
    return _report(rows, "FORBIDDEN_DEP", F.col("severity"), text, knowledge="rule", kind=F.col("knowledge_type"))


def layer_breaches(g: Graph, rules: DataFrame, each: int = 30, use_semantic_type: bool = False) -> DataFrame:
    """Calls between layers of a declared order that go back or skip one."""
    rules = _few(rules.where("c.type = 'REQUIRED_LAYER' AND size(c.order) >= 2").select("rule", "severity", "knowledge_type", F.col("c.order").alias("layers")))
    label = F.coalesce("semantic_type", "label") if use_semantic_type else F.col("label")
    n = g.nodes.select("id", label.alias("label"), "name", "file_path")
    place = rules.select("rule", "severity", "knowledge_type", "layers", F.posexplode("layers").alias("at", "layer"))
    a = n.join(place, F.col("label") == F.col("layer")).select(F.col("id").alias("src"), "name", "file_path", "rule", "severity", "knowledge_type", "layers", F.col("at").alias("ia"), F.col("layer").alias("la"))
    b = n.join(place.select("rule", "at", "layer"), F.col("label") == F.col("layer")).select(F.col("id").alias("dst"), F.col("name").alias("to_name"), "rule", F.col("at").alias("ib"), F.col("layer").alias("lb"))
    rows = g.links("CALLS").select("src", "dst").join(a, "src").join(b, ["dst", "rule"]).where("ia <> ib AND ia + 1 <> ib")
    rows = ranked(rows, ["rule"], each, "name", "to_name", "src", "dst")
    way = F.when(F.col("ib") < F.col("ia"), "backward").otherwise("skips layers")
    text = F.concat(F.lit("'"), "name", F.lit("' ("), "la", F.lit(") calls '"), "to_name", F.lit("' ("), "lb", F.lit("): "), way, F.lit(" in layer order "), F.array_join("layers", " -> "))
    return _report(rows, "REQUIRED_LAYER", F.col("severity"), text, knowledge="rule", kind=F.col("knowledge_type"))


def call_excess(g: Graph, rules: DataFrame, each: int = 20) -> DataFrame:
    """Nodes of a label (of a domain, if the rule names one) with more outgoing calls than allowed."""
    rules = _few(rules.where("c.type = 'MAX_OUTGOING_CALLS' AND c.label <> '' AND c.max IS NOT NULL").select("rule", "severity", "knowledge_type", F.col("c.label").alias("label"), F.coalesce("c.domain", F.lit("")).alias("wanted"), F.col("c.max").alias("most")))
    least = F.broadcast(rules.agg(F.min("most").alias("least")))
    counts = g.links("CALLS").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("cnt")).join(least).where("cnt > least").drop("least")
    rows = counts.join(g.nodes.select("id", "label", "name", "file_path").join(rules, "label"), "id").where("cnt > most")
    scoped = rows.where("wanted <> ''").join(_in_domain(g).select("id", F.col("domain_name").alias("wanted")), ["id", "wanted"], "left_semi")
    rows = ranked(rows.where("wanted = ''").unionByName(scoped), ["rule"], each, F.desc("cnt"), "name", "id")
    text = F.concat(F.lit("'"), "name", F.lit("' has "), F.col("cnt").cast("string"), F.lit(" outgoing calls (max "), F.col("most").cast("string"), F.lit(")"))
    return _report(rows, "MAX_OUTGOING_CALLS", F.col("severity"), text, knowledge="rule", kind=F.col("knowledge_type"))


Check = Callable[[Graph], DataFrame]


def check(g: Graph, custom: dict[str, Check] | None = None) -> DataFrame:
    """All findings of all checks; ``custom`` adds functions of a graph that give the same columns.
    ``level`` is violation for errors and critical rules, else warning."""
    rules = constraints(g)
    parts = [stale_memory(g), undocumented(g), missing_owners(g), forbidden_dependencies(g, rules), layer_breaches(g, rules), call_excess(g, rules)]
    parts += [f(g).select(*COLUMNS) for f in (custom or {}).values()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("level", F.when(F.col("severity") == "error", "violation").otherwise("warning"))


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("check", "level").agg(F.count("*").alias("n")).orderBy("check", "level")
