"""Markdown, decision records, memory notes, owners files, manifests, API schemas: text into rows."""

from __future__ import annotations

import json
import posixpath
import re
import tomllib

import yaml

from .code import Parsed

#: Characters of a document that its node keeps.
CONTENT = 4000


def _front(text: str) -> tuple[dict, str]:
    m = re.match(r"---[ \t]*\n(.*?)\n---[ \t]*(?:\n|$)", text, re.S)
    if not m:
        return {}, text
    try:
        head = yaml.safe_load(m[1])
    except yaml.YAMLError:
        head = None
    return head if isinstance(head, dict) else {}, text[m.end() :]


def _title(text: str, path: str) -> str:
    m = re.search(r"^#[ \t]+(.+?)[ \t]*$", text, re.M)
    return m[1] if m else posixpath.splitext(posixpath.basename(path))[0]


def parse_markdown(path: str, text: str) -> Parsed | None:
    """A Document with its title, content and REFERENCES to the markdown files it links to.  Paths with a
    component named memory belong to the memory source."""
    if "memory" in path.split("/"):
        return None
    p = Parsed(path)
    name = posixpath.basename(path)
    p.nodes.append({"label": "Document", "name": name, "path": path, "description": _title(text, path), "content": text[:CONTENT]})
    for target in dict.fromkeys(re.findall(r"\[[^\]]*\]\(([^)\s]+?\.md)(?:#[^)]*)?\)", text)):
        if re.match(r"[a-z]+://", target):
            continue
        to = posixpath.normpath(posixpath.join(posixpath.dirname(path), target))
        p.edge(("Document", name), "REFERENCES", ("Document", posixpath.basename(to)), b_file=to)
    return p


def parse_adr(path: str, text: str) -> dict:
    """A Decision row of a decision record."""

    def section(*names: str) -> str:
        for n in names:
            m = re.search(rf"^##[ \t]+{n}[ \t]*\n(.*?)(?=^##[ \t]|\Z)", text, re.S | re.M | re.I)
            if m and m[1].strip():
                return m[1].strip()
        return ""

    status = section("Status").lower()
    known = next((s for s in ("accepted", "proposed", "deprecated", "superseded", "rejected") if s in status), "proposed")
    date = re.search(r"\d{4}-\d{2}-\d{2}", section("Date")) or re.search(r"^Date:[ \t]*(\d{4}-\d{2}-\d{2})", text, re.M)
    title = re.sub(r"^\s*(?:ADR[- ]?)?\d+[.:)\-]?\s*", "", _title(text, path))
    return {"label": "Decision", "name": posixpath.splitext(posixpath.basename(path))[0], "description": title, "status": known, "rationale": section("Rationale", "Decision"), "date": date[0].removeprefix("Date:").strip() if date else ""}


# Kinds of memory notes, by front matter or file prefix, and the labels they become.
MEMORY = {"feedback": "Rule", "project": "Decision", "reference": "WikiPage", "user": "Person"}


def parse_memory(path: str, text: str, repo: str = "") -> dict | None:
    """A memory node of a note, by its front matter's type or its file name's prefix."""
    head, body = _front(text)
    stem = posixpath.splitext(posixpath.basename(path))[0]
    kind = str(head.get("type") or stem.split("_", 1)[0]).lower()
    if kind not in MEMORY or stem.upper() == "MEMORY":
        return None
    row = {"label": MEMORY[kind], "name": str(head.get("name") or stem), "description": str(head.get("description") or ""), "memory_type": kind, "repo": repo}
    return row | ({"content": body.strip()[:CONTENT]} if kind == "reference" else {"rationale": body.strip()})


def parse_codeowners(text: str) -> tuple[list[dict], list[dict]]:
    """(nodes, edges) of an owners file: a File for each pattern, a Person for each owner."""
    nodes, edges = [], []
    for line in text.splitlines():
        parts = line.split("#")[0].split()
        if len(parts) < 2:
            continue
        nodes.append({"label": "File", "name": parts[0], "path": parts[0]})
        for who in parts[1:]:
            mail = "@" in who and not who.startswith("@")
            name = who.lstrip("@")
            nodes.append({"label": "Person", "name": name, "email": who if mail else ""})
            edges.append({"from_label": "File", "from_name": parts[0], "from_file": parts[0], "type": "ASSIGNED_TO", "to_label": "Person", "to_name": name, "to_file": ""})
    return nodes, edges


def parse_manifest(path: str, text: str) -> list[tuple[str, str]]:
    """(package, version) pairs of package.json, requirements.txt, pyproject.toml, Cargo.toml or go.mod."""
    name, out = posixpath.basename(path), []
    if name == "package.json":
        data = json.loads(text)
        for part in ("dependencies", "devDependencies", "peerDependencies"):
            out += list((data.get(part) or {}).items())
    elif name in ("pyproject.toml", "Cargo.toml"):
        data = tomllib.loads(text)
        for spec in (data.get("project") or {}).get("dependencies") or []:
            out.append(_requirement(spec))
        tool = ((data.get("tool") or {}).get("poetry") or {}).get("dependencies") or {}
        for part in (tool, data.get("dependencies") or {}, data.get("dev-dependencies") or {}, data.get("build-dependencies") or {}):
            out += [(k, v if isinstance(v, str) else str(v.get("version", "*"))) for k, v in part.items() if k != "python"]
    elif name == "go.mod":
        out = re.findall(r"^\s*(?:require\s+)?([\w./\-]+\.[\w./\-]+)\s+(v\S+)", text, re.M)
    else:
        out = [_requirement(x) for line in text.splitlines() if (x := line.split("#")[0].strip()) and not x.startswith("-")]
    return [(k, v) for k, v in out if k]


def _requirement(spec: str) -> tuple[str, str]:
    m = re.match(r"([A-Za-z0-9_.\-]+)(?:\[[^\]]*\])?\s*([^;]*)", spec.strip())
    return (m[1], m[2].strip() or "*") if m else ("", "")


def dependency_rows(path: str, text: str) -> tuple[list[dict], list[dict]]:
    """A Concept package@version for each dependency, and DEPENDS_ON edges of the manifest's File."""
    file = posixpath.basename(path)
    nodes, edges = [{"label": "File", "name": file, "path": path}], []
    for package, version in parse_manifest(path, text):
        name = f"{package}@{version}"
        nodes.append({"label": "Concept", "name": name, "description": f"package {package}"})
        edges.append({"from_label": "File", "from_name": file, "from_file": path, "type": "DEPENDS_ON", "to_label": "Concept", "to_name": name, "to_file": ""})
    return nodes, edges


def parse_openapi(path: str, text: str) -> list[dict]:
    """A Function for each path and method, a Class for each schema."""
    data = yaml.safe_load(text) or {}
    rows = []
    for route, methods in (data.get("paths") or {}).items():
        for verb, op in (methods or {}).items():
            if verb.lower() in ("get", "post", "put", "patch", "delete", "head", "options"):
                op = op or {}
                rows.append({"label": "Function", "name": op.get("operationId") or f"{verb.upper()} {route}", "file_path": path, "signature": f"{verb.upper()} {route}", "docstring": op.get("summary") or op.get("description") or "", "semantic_type": "api_endpoint"})
    schemas = (data.get("components") or {}).get("schemas") or data.get("definitions") or {}
    rows += [{"label": "Class", "name": k, "file_path": path, "docstring": (v or {}).get("description") or "", "semantic_type": "api_schema"} for k, v in schemas.items()]
    return rows


def parse_graphql(path: str, text: str) -> list[dict]:
    """A Class for each type, a Function for each field of the root types."""
    rows = []
    for kind, name, body in re.findall(r"\b(type|input|interface|enum|union|scalar)\s+(\w+)[^{\n]*(?:\{([^}]*)\})?", text):
        if kind == "type" and name in ("Query", "Mutation", "Subscription"):
            for field, given in re.findall(r"^\s*(\w+)\s*(?:\([^)]*\))?\s*:\s*([\w\[\]!]+)", body, re.M):
                rows.append({"label": "Function", "name": field, "file_path": path, "signature": f"{name}.{field}: {given}", "semantic_type": f"graphql_{name.lower()}"})
        else:
            rows.append({"label": "Class", "name": name, "file_path": path, "docstring": kind, "semantic_type": "graphql_type"})
    return rows


def parse_wiki(name: str, text: str, url: str = "", source: str = "local") -> tuple[dict, list[str]]:
    """A WikiPage and the terms in it that may name nodes (headings, bold, code)."""
    terms = re.findall(r"^#{1,6}[ \t]+(.+?)[ \t]*$|\*\*([^*\n]+)\*\*|`([^`\n]+)`", text, re.M)
    return {"label": "WikiPage", "name": name, "content": text[:CONTENT], "description": url, "role": source}, list(dict.fromkeys(next(x for x in t if x).strip() for t in terms))


# Labels that mark how bad an issue is, the worst first; others are "info".
SEVERITIES = {"critical": ("critical", "blocker", "urgent", "p0"), "warning": ("bug", "high", "p1", "important")}


def parse_issues(text: str) -> list[dict]:
    """Rule rows of a page of issues as JSON; pull requests are left out."""
    rows = []
    for i in json.loads(text):
        if "pull_request" in i:
            continue
        tags = [(x.get("name") if isinstance(x, dict) else str(x)).lower() for x in i.get("labels") or []]
        severity = next((level for level, marks in SEVERITIES.items() if any(t in marks for t in tags)), "info")
        talk = "\n\n".join(c.get("body") or "" for c in i.get("comment_list") or [])
        rows.append({"label": "Rule", "name": f"#{i['number']}: {i['title']}", "description": (i.get("body") or "")[:CONTENT], "severity": severity, "status": i.get("state", ""), "rationale": talk, "domain": ",".join(tags), "role": ",".join(a.get("login", "") for a in i.get("assignees") or [])})
    return rows


# Kinds of entities and relations of a meeting graph, and what they become.
MEETING_NODES = {"concept": "Concept", "technology": "Concept", "organization": "Concept", "diagram": "WikiPage", "time": "Concept", "person": "Person"}
MEETING_PLANS = {"decision": "Decision", "requirement": "Rule", "constraint": "Rule", "risk": "Rule", "goal": "Concept", "assumption": "Concept", "feature": "Concept", "milestone": "Concept", "task": "Concept", "dependency": "Concept"}
MEETING_EDGES = {
    "related_to": "RELATED_TO", "uses": "DEPENDS_ON", "depends_on": "DEPENDS_ON", "built_on": "DEPENDS_ON", "implements": "IMPLEMENTS", "requires": "DEPENDS_ON", "blocked_by": "DEPENDS_ON",
    "has_risk": "RELATED_TO", "addresses": "RELATED_TO", "has_tradeoff": "RELATED_TO", "delivers": "IMPLEMENTS", "parent_of": "CONTAINS", "assigned_to": "ASSIGNED_TO", "owned_by": "ASSIGNED_TO",
    "owns": "ASSIGNED_TO", "employed_by": "ASSIGNED_TO", "works_with": "RELATED_TO", "governs": "GOVERNS", "documents": "DOCUMENTS",
}


def parse_meeting_graph(text: str) -> tuple[list[dict], list[dict]]:
    """(nodes, edges) of a meeting's knowledge graph: nodes, relationships and sources as JSON."""
    data = json.loads(text)
    nodes, edges, by_id = [], [], {}
    for n in data.get("nodes") or data.get("entities") or []:
        kind, plan = (str(n.get(k) or "").lower() for k in ("type", "planning_type"))
        label = MEETING_PLANS.get(plan) or MEETING_NODES.get(kind) or MEETING_PLANS.get(kind, "Concept")
        nodes.append({"label": label, "name": n["name"], "description": n.get("description") or "", "email": n.get("email") or "", "status": n.get("status") or "", "rationale": n.get("rationale") or ""})
        by_id[n.get("id", n["name"])] = (label, n["name"])
    for r in data.get("relationships") or []:
        a, b = by_id.get(r["source"]), by_id.get(r["target"])
        if a and b:
            edges.append({"from_label": a[0], "from_name": a[1], "from_file": "", "type": MEETING_EDGES.get(str(r.get("type", "")).lower(), "RELATED_TO"), "to_label": b[0], "to_name": b[1], "to_file": ""})
    nodes += [{"label": "WikiPage", "name": s["title"], "description": s.get("url") or "", "role": s.get("source_type") or ""} for s in data.get("sources") or []]
    return nodes, edges


def parse_manifest_of_meeting(text: str) -> dict[str, list[dict]]:
    """Key points, action items and diagrams of a recording's manifest."""
    data = json.loads(text)
    points = [{"label": "Concept", "name": k["point"], "description": k.get("details") or "", "domain": k.get("topic") or ""} for k in data.get("key_points") or []]
    actions = [{"action": a["action"], "assignee": a.get("assignee") or "", "context": a.get("context") or ""} for a in data.get("action_items") or []]
    diagrams = [{"label": "WikiPage", "name": f"{d.get('diagram_type', 'diagram')} at {d.get('timestamp', '')}", "content": (d.get("mermaid") or d.get("description") or "")[:CONTENT]} for d in data.get("diagrams") or []]
    return {"concepts": points, "actions": actions, "pages": diagrams}
