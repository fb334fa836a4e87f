"""Secrets in text, and a guard for queries from outside."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.graph import Graph

# What secrets look like, by name, in the order in which they are looked for.
SECRETS = {
    "aws_access_key": r"(?<![A-Z0-9])(AKIA|ASIA|AROA)[A-Z0-9]{16}(?![A-Z0-9])",
    "aws_secret_key": r"(?i)aws[_\-\s]*secret[_\-\s]*(?:access[_\-\s]*)?key\s*[=:]\s*[\"']?([A-Za-z0-9/+]{40})[\"']?",
    "github_token": r"(ghp_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{80,})",
    "api_key_sk": r"\bsk-[A-Za-z0-9\-_]{20,}",
    "api_key_assignment": r"(?i)(?:api[_\-]?key|api[_\-]?token|access[_\-]?token|auth[_\-]?token)\s*[=:]\s*[\"']([A-Za-z0-9\-_\.]{16,})[\"']",
    "password_assignment": r"(?i)(?:password|passwd|secret)\s*[=:]\s*[\"']([^\"']{4,})[\"']",
    "private_key_pem": r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----",
    "connection_string": r"(?i)(postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp)://[^:@\s\"']+:[^@\s\"'@]+@[^\s\"']{4,}",
    "jwt_token": r"eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+",
}
# How bad they are; the others are "high".
SEVERITIES = {"jwt_token": "medium"}
#: What a text (in lower case) must hold for a pattern to occur at all.
ANCHORS = {
    "aws_access_key": ("akia", "asia", "aroa"), "aws_secret_key": ("aws",), "github_token": ("ghp_", "github_pat_"), "api_key_sk": ("sk-",), "api_key_assignment": ("key", "token"),
    "password_assignment": ("password", "passwd", "secret"), "private_key_pem": ("private key-----",), "connection_string": ("://",), "jwt_token": ("eyj",),
}
REDACTED = "[REDACTED]"


def _may_have(name: str, low: Column) -> Column:
    """Whether a pattern's regular expression is worth running: a substring test, many times cheaper."""
    test = F.lit(False)
    for part in ANCHORS[name]:
        test = test | low.contains(part)
    return test


def scan_content(text: str) -> list[tuple[int, str]]:
    """(line from 1, pattern) of every hit, in that order."""
    return sorted((text.count("\n", 0, m.start()) + 1, name) for name, p in SECRETS.items() for m in re.finditer(p, text))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, pattern, severity, n): how often each pattern occurs in each text that has it, JVM-side."""
    text, low = F.col(text_col), F.lower(text_col)
    n = {k: F.when(_may_have(k, low), F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0)))).otherwise(0).cast("long") for k, p in SECRETS.items()}
    hits = F.array(*[F.struct(F.lit(k).alias("pattern"), F.lit(SEVERITIES.get(k, "high")).alias("severity"), c.alias("n")) for k, c in n.items()])
    rows = docs.where(text.isNotNull()).select(id_col, F.explode(hits).alias("h"))
    return rows.select(id_col, "h.pattern", "h.severity", "h.n").where("n > 0")


def redact_column(text: Column) -> Column:
    """One pattern after the other; a text without any anchor is passed through untouched."""
    some = F.lit(False)
    low, out = F.lower(text), text
    for k, p in SECRETS.items():
        some = some | _may_have(k, low)
        out = F.regexp_replace(out, p, REDACTED)
    return F.when(some, out).otherwise(text)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Texts with every pattern's hits replaced, one pattern after the other; a text is searched for a pattern only
    if it has one of the pattern's anchors.  Each step is a projection of its own, so no text is worked out twice."""
    rows = docs.withColumn("__low", F.lower(text_col))
    for k, p in SECRETS.items():
        rows = rows.withColumn(text_col, F.when(_may_have(k, F.col("__low")), F.regexp_replace(text_col, p, REDACTED)).otherwise(F.col(text_col)))
    return rows.drop("__low")


#: Groups of built-in functions that a query from outside may call.  Those that reach out of the query
#: (reflection, files, the session) are in none of them; functions registered by users are in no group.
FUNCTION_GROUPS = frozenset(f"{g}_funcs" for g in "agg array bitwise collection conditional conversion datetime generator hash json lambda map math predicate string struct window".split())
RELATIONS = ("nodes", "edges")


class _Survey:
    """What a parsed statement reads and calls, found by walking its plan, subqueries too."""

    def __init__(self) -> None:
        self.relations: list[str] = []
        self.functions: list[str] = []
        self.given: set[str] = set()
        self.joins = 0
        self.others: list[str] = []

    @staticmethod
    def _all(seq) -> list:
        return [seq.apply(k) for k in range(seq.size())]

    def plan(self, node) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedRelation":
            self.relations.append(".".join(self._all(node.multipartIdentifier())))
        elif kind == "UnresolvedTableValuedFunction":
            self.functions.append("table function " + ".".join(self._all(node.name())))
        elif kind == "UnresolvedWith":
            for named in self._all(node.cteRelations()):
                self.given.add(named._1().lower())
                self.plan(named._2())
        elif kind == "Join":
            self.joins += 1
        package = node.getClass().getName()
        if not package.startswith("org.apache.spark.sql.catalyst.") or re.search("Command|^(?:Insert|Create|Drop|Delete|Update|Merge|Alter|Replace|Truncate|Cache|Set|Script)", kind):
            self.others.append(kind)
        for child in self._all(node.children()):
            self.plan(child)
        for e in self._all(node.expressions()):
            self.expression(e)

    def expression(self, e) -> None:
        kind = e.getClass().getSimpleName()
        if kind == "UnresolvedFunction":
            self.functions.append(".".join(self._all(e.nameParts())))
        elif kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
            self.plan(e.plan())
        for child in self._all(e.children()):
            self.expression(child)


def _group(spark, name: str) -> str:
    """The group of a built-in function; empty for others."""
    try:
        catalog = spark._jsparkSession.sessionState().catalog()
        info = catalog.lookupFunctionInfo(spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name))
        return info.getGroup() if info.getSource() == "built-in" else ""
    except Exception:  # no such function
        return ""


def guarded_sql(g: Graph, text: str, max_rows: int = 10_000, max_joins: int = 5, parameters: dict | None = None) -> DataFrame:
    """Run one read-only statement over the tables nodes and edges; at most ``max_rows`` rows come back.

    The statement is checked as parsed.  It may read nodes, edges and its own common table expressions,
    and no other table, view or file; call built-in functions of ``FUNCTION_GROUPS``, and no table
    function; and join ``max_joins`` times.  Anything else is a ValueError before it is analysed.
    """
    body = re.sub(r"^(?:\s+|/\*.*?\*/|--[^\n]*(?:\n|$))+", "", text, flags=re.S).rstrip().rstrip(";")
    first = re.match(r"[A-Za-z]+", body)
    if not first or first[0].upper() not in ("SELECT", "WITH", "FROM", "VALUES") or re.match(r"WITH\s+RECURSIVE\b", body, re.I):
        raise ValueError("only queries that read are allowed")
    found = _Survey()
    found.plan(g.spark._jsparkSession.sessionState().sqlParser().parsePlan(body))
    if found.others:
        raise ValueError("only queries that read are allowed")
    strange = [r for r in found.relations if r.lower() not in RELATIONS and r.lower() not in found.given]
    if strange or found.given & set(RELATIONS):
        raise ValueError(f"only {' and '.join(RELATIONS)} may be read, not {', '.join(strange) or 'others under their names'}")
    calls = [f for f in dict.fromkeys(found.functions) if _group(g.spark, f.lower()) not in FUNCTION_GROUPS]
    if calls:
        raise ValueError(f"functions that are not allowed: {', '.join(calls)}")
    if found.joins > max_joins:
        raise ValueError(f"more than {max_joins} joins")
    body = body.replace("{", "{{").replace("}", "}}")
    given = "WITH nodes AS (SELECT * FROM {nodes}), edges AS (SELECT * FROM {edges})"
    body = f"{given}, {body[4:]}" if first[0].upper() == "WITH" else f"{given} {body}"
    return g.spark.sql(body, args=parameters, nodes=g.nodes, edges=g.edges).limit(max_rows)
