"""A reading subset of Cypher as one SQL statement over nodes and edges.

Understood: MATCH and OPTIONAL MATCH with comma-separated paths, labels, property maps, typed and
alternative edges, directions, lengths with or without bounds; WHERE with Boolean expressions, string operators, label
tests and (negated) path patterns; RETURN with DISTINCT, aliases, count and collect; ORDER BY, SKIP,
LIMIT; parameters as $name.  Everything becomes joins that the optimiser arranges.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import NODE_COLUMNS, Graph, reach

_NODE = r"\(\s*(?P<var>\w*)\s*(?P<labels>(?::\s*\w+)*)\s*(?P<map>\{[^}]*\})?\s*\)"
_EDGE = r"(?P<left><)?-(?:\[\s*(?P<var>\w*)\s*(?::\s*(?P<types>\w+(?:\s*\|\s*:?\s*\w+)*))?\s*(?P<star>\*\s*(?P<low>\d+)?\s*(?P<dots>\.\.)?\s*(?P<high>\d+)?)?\s*\])?-(?P<right>>)?"
_CLAUSE = re.compile(r"\b(OPTIONAL\s+MATCH|MATCH|WHERE|RETURN|ORDER\s+BY|SKIP|LIMIT)\b(?=(?:[^'\"]|'[^']*'|\"[^\"]*\")*$)", re.I)


class _Compiler:
    def __init__(self, g: Graph):
        self.g = g
        self.vars: dict[str, str] = {}  # variable -> node or edge
        self.frames: dict[str, DataFrame] = {"nodes": g.nodes, "edges": g.edges}
        self.fresh = 0

    def name(self) -> str:
        self.fresh += 1
        return f"_{self.fresh}"

    # -- paths

    def path(self, text: str) -> tuple[list[tuple[str, str]], list[str]]:
        """(sources as (SQL, alias), conditions) of one path."""
        sources, tests, at, left = [], [], 0, None
        text = text.strip()
        while at < len(text):
            node = re.compile(_NODE).match(text, at)
            if not node:
                raise ValueError(f"not a node: {text[at:]!r}")
            at = node.end()
            var = node["var"] or self.name()
            if var not in self.vars:
                self.vars[var] = "node"
                sources.append(("{nodes}", var))
            labels = re.findall(r"\w+", node["labels"] or "")
            tests += [f"{var}.label = '{x}'" for x in labels]
            for k, v in re.findall(r"(\w+)\s*:\s*('[^']*'|\"[^\"]*\"|\$\w+|[\w.]+)", node["map"] or ""):
                tests.append(f"{var}.{k} = {self.expression(v)}")
            if left is not None:
                a, edge = left
                tests += self.step(sources, a, edge, var)
            edge = re.compile(_EDGE).match(text, at)
            if not edge:
                if text[at:].strip():
                    raise ValueError(f"not an edge: {text[at:]!r}")
                break
            at = edge.end()
            left = (var, edge)
        return sources, tests

    def step(self, sources: list, a: str, edge: re.Match, b: str) -> list[str]:
        types = re.findall(r"\w+", edge["types"] or "")
        way = "in" if edge["left"] and not edge["right"] else "out" if edge["right"] and not edge["left"] else "both"
        e = edge["var"] or self.name()
        self.vars[e] = "edge"
        if edge["star"] is not None and not (edge["low"] == edge["high"] == "1"):
            low = int(edge["low"] or 1)
            high = int(edge["high"]) if edge["high"] else low if edge["low"] and not edge["dots"] else None  # None: however far
            found = reach(self.g, self.g.nodes.select("id"), types, high, way, per_root=True).where(F.col("level") >= low)
            self.frames[f"reach{e}"] = found
            sources.append((f"{{reach{e}}}", e))
            return [f"{e}.root = {a}.id", f"{e}.id = {b}.id"]
        sources.append(("{edges}", e))
        tests = [f"{e}.type IN ({', '.join(repr(t) for t in types)})"] if types else []
        out, back = f"{e}.src = {a}.id AND {e}.dst = {b}.id", f"{e}.dst = {a}.id AND {e}.src = {b}.id"
        return [*tests, out if way == "out" else back if way == "in" else f"(({out}) OR ({back}))"]

    # -- expressions

    def expression(self, text: str) -> str:
        kept: list[str] = []

        def keep(m: re.Match) -> str:
            kept.append("'" + m[0][1:-1].replace("'", "''") + "'")
            return f"\x00{len(kept) - 1}\x00"

        t = re.sub(r"'[^']*'|\"[^\"]*\"", keep, text)
        t = re.sub(rf"\bNOT\s+(?=\(\w*\)\s*<?-)", "NOT ", t, flags=re.I)
        t = re.sub(r"\(\s*\w*\s*(?::\s*\w+)?\s*(?:\{[^}]*\})?\s*\)\s*<?-\s*(?:\[[^\]]*\])?\s*->?\s*\(\s*\w*\s*(?::\s*\w+)?\s*(?:\{[^}]*\})?\s*\)", lambda m: self.exists(re.sub(r"\x00(\d+)\x00", lambda k: kept[int(k[1])], m[0])), t)
        t = re.sub(r"\blabels\(\s*(\w+)\s*\)\s*\[\s*0\s*\]", r"\1.label", t)
        t = re.sub(r"\btype\(\s*(\w+)\s*\)", r"\1.type", t)
        t = re.sub(r"\bid\(\s*(\w+)\s*\)", r"\1.id", t)
        t = re.sub(r"\btoLower\(", "lower(", t, flags=re.I)
        t = re.sub(r"\btoUpper\(", "upper(", t, flags=re.I)
        t = re.sub(r"\bcollect\(\s*DISTINCT\s+", "collect_set(", t, flags=re.I)
        t = re.sub(r"\bcollect\(", "collect_list(", t, flags=re.I)
        t = re.sub(r"\b(\w+):(\w+)\b", lambda m: f"{m[1]}.label = '{m[2]}'" if m[1] in self.vars else m[0], t)
        t = re.sub(r"\bcount\(\s*(DISTINCT\s+)?(\w+)\s*\)", lambda m: f"count({m[1] or ''}{m[2]}.{'id' if self.vars[m[2]] == 'node' else 'src'})" if m[2] in self.vars else m[0], t, flags=re.I)
        operand = r"((?:\w+\([^()]*\)|[\w.$]+|\x00\d+\x00))"
        for word, f in (("STARTS\\s+WITH", "startswith"), ("ENDS\\s+WITH", "endswith"), ("CONTAINS", "contains")):
            t = re.sub(rf"{operand}\s+{word}\s+{operand}", rf"{f}(\1, \2)", t, flags=re.I)
        t = re.sub(r"\bIN\s*\[([^\]]*)\]", r"IN (\1)", t, flags=re.I)
        t = re.sub(r"\bIN\s+\$(\w+)", r"IN (SELECT explode(:\1))", t, flags=re.I)
        t = re.sub(r"\$(\w+)", r":\1", t)
        return re.sub(r"\x00(\d+)\x00", lambda m: kept[int(m[1])], t)

    def exists(self, pattern: str) -> str:
        inner = _Compiler(self.g)
        inner.vars, inner.frames, inner.fresh = dict(self.vars), self.frames, self.fresh + 100
        sources, tests = inner.path(pattern)
        self.fresh = inner.fresh
        names = ", ".join(f"{s} {a}" for s, a in sources)
        return f"EXISTS (SELECT 1 FROM {names} WHERE {' AND '.join(tests) or 'TRUE'})"


def _split(text: str, sep: str = ",") -> list[str]:
    """Parts at separators that stand in no bracket and no string."""
    parts, depth, quote, now = [], 0, "", ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == sep and not depth:
            parts.append(now)
            now = ""
            continue
        now += c
    return [*parts, now]


def run(g: Graph, text: str, parameters: dict | None = None) -> DataFrame:
    """The rows of a query.  Words that write are refused."""
    if re.search(r"\b(CREATE|MERGE|SET|DELETE|REMOVE|DROP|CALL|LOAD|FOREACH)\b", re.sub(r"'[^']*'|\"[^\"]*\"", "", text), re.I):
        raise ValueError("only queries that read are allowed")
    pieces = _CLAUSE.split(text.strip().rstrip(";"))
    clauses = [(re.sub(r"\s+", " ", k).upper(), v.strip()) for k, v in zip(pieces[1::2], pieces[2::2], strict=True)]
    c = _Compiler(g)
    sources, where, optional = [], [], []
    tail: dict[str, str] = {}
    last = None
    for kind, body in clauses:
        if kind == "MATCH":
            for p in _split(body):
                s, t = c.path(p)
                sources += s
                where += t
        elif kind == "OPTIONAL MATCH":
            s, t = c.path(body)
            optional.append((s, t))
        elif kind == "WHERE":
            (optional[-1][1] if last == "OPTIONAL MATCH" else where).append(f"({c.expression(body)})")
        else:
            tail[kind] = body
        last = kind
    if "RETURN" not in tail:
        raise ValueError("a query has to return something")
    returned = re.sub(r"^DISTINCT\s+", "", tail["RETURN"], flags=re.I)
    distinct = "DISTINCT " if returned != tail["RETURN"] else ""
    columns, groups, names = [], [], {}
    for i, part in enumerate(_split(returned)):
        m = re.match(r"(.*?)\s+AS\s+(\w+)\s*$", part.strip(), re.I | re.S)
        raw, alias = (m[1], m[2]) if m else (part.strip(), re.sub(r"\W+", "_", part.strip()).strip("_") or f"c{i}")
        if c.vars.get(raw.strip()) == "node":
            raw = f"named_struct({', '.join(f"'{k}', {raw.strip()}.{k}" for k in NODE_COLUMNS)})"
        sql = c.expression(raw)
        names[re.sub(r"\s+", "", part.strip())] = alias
        columns.append(f"{sql} AS {alias}")
        if not re.search(r"\b(count|collect_set|collect_list|sum|avg|min|max)\(", sql):
            groups.append(sql)
    sql = "SELECT " + distinct + ", ".join(columns) + " FROM " + " JOIN ".join(f"{s} {a}" for s, a in sources)
    if where:
        sql += " ON " + " AND ".join(where) if len(sources) > 1 and not optional else ""
    if optional:
        sql += " ON " + " AND ".join(where) if len(sources) > 1 and where else ""
        for s, t in optional:
            inner = " JOIN ".join(f"{x} {a}" for x, a in s)
            sql += f" LEFT JOIN ({inner}) ON {' AND '.join(t) or 'TRUE'}"
    if where and len(sources) == 1:
        sql += " WHERE " + " AND ".join(where)
    if len(groups) < len(columns):
        sql += (" GROUP BY " + ", ".join(groups)) if groups else ""
    if "ORDER BY" in tail:
        keys = []
        for k in _split(tail["ORDER BY"]):
            m = re.match(r"(.*?)(\s+(?:DESC|ASC)(?:ENDING)?)?$", k.strip(), re.I | re.S)
            key = names.get(re.sub(r"\s+", "", m[1])) or (m[1] if m[1] in names.values() else c.expression(m[1]))
            keys.append(key + (" DESC" if (m[2] or "").strip().upper().startswith("DESC") else ""))
        sql += " ORDER BY " + ", ".join(keys)
    out = _sql(g, sql, c.frames, parameters)
    if "SKIP" in tail:
        out = out.offset(int((parameters or {}).get(tail["SKIP"].lstrip("$"), 0) if tail["SKIP"].startswith("$") else tail["SKIP"]))
    if "LIMIT" in tail:
        out = out.limit(int((parameters or {})[tail["LIMIT"].lstrip("$")] if tail["LIMIT"].startswith("$") else tail["LIMIT"]))
    return out


def _sql(g: Graph, sql: str, frames: dict[str, DataFrame], parameters: dict | None) -> DataFrame:
    bound = {k: f for k, f in frames.items() if f"{{{k}}}" in sql}
    args = {k: v for k, v in (parameters or {}).items() if f":{k}" in sql}
    views = {k: f"v_{k}_{id(f):x}" for k, f in bound.items()}
    for k, f in bound.items():
        f.createOrReplaceTempView(views[k])
    try:
        for k, v in views.items():
            sql = sql.replace(f"{{{k}}}", v)
        return g.spark.sql(sql, args=args or None)
    finally:
        for v in views.values():
            g.spark.catalog.dropTempView(v)
