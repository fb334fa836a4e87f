"""Source code into node and edge rows.

Python is read with its own syntax tree; other languages by tokens and scopes.  ``ingest`` runs the parsers on executors: files are a ``binaryFile`` scan, every file
becomes rows by itself, and edges are resolved by joins once all nodes exist.
"""

from __future__ import annotations

import ast
import fnmatch
import hashlib
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import yaml
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import NODE_COLUMNS, conform, node_id, resolve_edges
from ..plans.graph import Graph
from ..shared import settle
from .lexed import GRAMMARS, declarations

# Languages by file extension.
LANGUAGES = {
    ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".go": "go", ".rs": "rust", ".java": "java",
    ".kt": "kotlin", ".kts": "kotlin", ".cs": "csharp", ".php": "php", ".rb": "ruby", ".swift": "swift", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp",
    ".cc": "cpp", ".cxx": "cpp", ".tf": "hcl", ".hcl": "hcl", ".tfvars": "hcl", ".pp": "puppet", ".sh": "bash", ".bash": "bash", ".zsh": "bash", ".md": "markdown", ".markdown": "markdown",
}
# Directories that a walk never enters.
SKIPPED = {".git", ".venv", "venv", "node_modules", "__pycache__", "dist", "build", ".next", "target", "vendor", ".gradle"}
#: A file in a tree's root whose lines are patterns of what to leave out.
IGNORE_FILE = ".navignore"


@dataclass
class Parsed:
    """Rows of one file.  Edges name their ends by label, name and file."""

    path: str
    nodes: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)

    def node(self, label: str, name: str, line: int | None = None, end: int | None = None, doc: str = "", **more) -> None:
        self.nodes.append({"label": label, "name": name, "file_path": self.path, "line_start": line, "line_end": end, "docstring": doc} | more)

    def edge(self, a: tuple[str, str], kind: str, b: tuple[str, str], a_file: str | None = None, b_file: str | None = None) -> None:
        own = self.path
        self.edges.append({"from_label": a[0], "from_name": a[1], "from_file": own if a_file is None else a_file, "type": kind, "to_label": b[0], "to_name": b[1], "to_file": own if b_file is None else b_file})

    @property
    def file(self) -> tuple[str, str]:
        return ("File", self.path.rsplit("/", 1)[-1])


def _start(path: str, text: str, language: str) -> Parsed:
    p = Parsed(path)
    p.nodes.append({"label": "File", "name": p.file[1], "path": path, "line_start": None, "line_end": text.count("\n") + 1, "docstring": "", "description": language})
    return p


def parse_python(path: str, text: str) -> Parsed:
    """Classes with bases, functions, methods (decorated ones too), decorators, imports, calls."""
    p = _start(path, text, "python")
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return p

    def last(e: ast.expr) -> str:
        return e.attr if isinstance(e, ast.Attribute) else e.id if isinstance(e, ast.Name) else last(e.func) if isinstance(e, ast.Call) else ""

    def visit(body: list[ast.stmt], owner: tuple[str, str] | None) -> None:
        for s in body:
            if isinstance(s, ast.ClassDef):
                p.node("Class", s.name, s.lineno, s.end_lineno, ast.get_docstring(s) or "")
                p.edge(owner or p.file, "CONTAINS", ("Class", s.name))
                for b in s.bases:
                    if last(b):
                        p.edge(("Class", s.name), "INHERITS", ("Class", last(b)), b_file="")
                visit(s.body, ("Class", s.name))
            elif isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
                kind = "Method" if owner and owner[0] == "Class" else "Function"
                args = ast.unparse(s.args)
                p.node(kind, s.name, s.lineno, s.end_lineno, ast.get_docstring(s) or "", signature=f"def {s.name}({args})")
                p.edge(owner or p.file, "CONTAINS", (kind, s.name))
                for d in s.decorator_list:
                    if last(d):
                        p.node("Decorator", last(d), d.lineno)
                        p.edge(("Decorator", last(d)), "DECORATES", (kind, s.name))
                for c in ast.walk(s):
                    if isinstance(c, ast.Call) and last(c.func):
                        for to in ("Function", "Method"):
                            p.edge((kind, s.name), "CALLS", (to, last(c.func)), b_file="")
            elif isinstance(s, (ast.Import, ast.ImportFrom)):
                module = getattr(s, "module", None) or ""
                for a in s.names:
                    name = f"{module}.{a.name}" if module else a.name
                    p.node("Import", name, s.lineno, module=module or a.name)
                    p.edge(p.file, "IMPORTS", ("Import", name))
            elif isinstance(s, (ast.If, ast.Try, ast.With)):
                visit(s.body, owner)

    visit(tree.body, None)
    return p


def parse_by_rules(path: str, text: str, language: str) -> Parsed:
    """Classes, functions, methods, variables, imports and calls by the language's tokens and scopes."""
    p = _start(path, text, language)
    for d in declarations(text, language):
        owner = ("Class", d.owner) if d.owner else p.file
        if d.label == "Import":
            p.node("Import", d.name, d.line, module=d.name, signature=d.signature)
            p.edge(p.file, "IMPORTS", ("Import", d.name))
        elif d.label == "Variable":
            p.node("Variable", d.name, d.line, description=d.signature)
            p.edge(owner, "CONTAINS", ("Variable", d.name))
        else:
            p.node(d.label, d.name, d.line, d.end, d.doc, signature=d.signature)
            p.edge(owner, "CONTAINS", (d.label, d.name))
        for base in d.bases:
            p.edge(("Class", d.name), "INHERITS", ("Class", base), b_file="")
        for name in d.calls:
            for to in ("Function", "Method"):
                p.edge((d.label, d.name), "CALLS", (to, name))
    return p


_HCL = re.compile(r'^\s*(?P<kind>resource|data|provider|variable|output|module|locals)\b\s*(?:"(?P<a>[^"]+)")?\s*(?:"(?P<b>[^"]+)")?\s*\{')


def parse_hcl(path: str, text: str) -> Parsed:
    """Blocks as classes, variables and modules; ``var.``, ``local.``, ``module.`` uses as REFERENCES,
    other blocks' addresses as DEPENDS_ON."""
    p, now, depth = _start(path, text, "hcl"), None, 0
    known: list[tuple[tuple[str, str], str]] = []
    for number, line in enumerate(text.splitlines(), 1):
        if depth == 0 and (m := _HCL.match(line)):
            kind, a, b = m["kind"], m["a"] or "", m["b"] or ""
            name = f"data.{a}.{b}" if kind == "data" else f"{a}.{b}" if kind == "resource" else a or kind
            label = {"resource": "Class", "data": "Class", "provider": "Class", "module": "Module"}.get(kind, "Variable")
            p.node(label, name, number, number, semantic_type=f"terraform_{kind}")
            p.edge(p.file, "CONTAINS", (label, name))
            now = (label, name)
        elif now:
            if now[0] == "Module" and (m := re.match(r'\s*source\s*=\s*"([^"]+)"', line)):
                p.nodes[-1]["description"] = m[1]
            for m in re.finditer(r"\b(var|local|module)\.(\w+)", line):
                p.edge(now, "REFERENCES", ("Module" if m[1] == "module" else "Variable", m[2]), b_file="")
            for m in re.finditer(r"\b(data\.\w+\.\w+|(?!var\.|local\.|module\.|each\.|count\.|path\.)[a-z]+_\w+\.\w+)", line):
                known.append((now, m[1]))
        depth += line.count("{") - line.count("}")
        if depth == 0:
            now = None
    for who, what in known:
        if who[1] != what:
            p.edge(who, "DEPENDS_ON", ("Class", what), b_file="")
    return p


def parse_ansible(path: str, text: str) -> Parsed:
    """A playbook as Module, plays as classes, tasks and handlers as functions, roles as imports, notify
    as calls.  Blocks are entered; a task without a name takes its module's."""
    p = _start(path, text, "ansible")
    try:
        data = yaml.safe_load(text)
    except yaml.YAMLError:
        return p
    if not isinstance(data, list):
        return p
    skip = {"name", "when", "tags", "notify", "register", "become", "with_items", "loop", "vars", "block", "rescue", "always", "args"}

    def tasks(items, owner: tuple[str, str]) -> None:
        for t in items or []:
            if not isinstance(t, dict):
                continue
            parts = [k for k in ("block", "rescue", "always") if k in t]
            for k in parts:
                tasks(t[k], owner)
            name = t.get("name") or next((k for k in t if k not in skip), "")
            if parts or not name:
                continue
            p.node("Function", name, None)
            p.edge(owner, "CONTAINS", ("Function", name))
            for h in [t["notify"]] if isinstance(t.get("notify"), str) else t.get("notify") or []:
                p.edge(("Function", name), "CALLS", ("Function", h), b_file="")

    plays = [x for x in data if isinstance(x, dict) and "hosts" in x]
    if plays:
        p.node("Module", p.file[1], 1)
        p.edge(p.file, "CONTAINS", ("Module", p.file[1]))
    for play in plays:
        name = play.get("name") or str(play["hosts"])
        p.node("Class", name, None)
        p.edge(("Module", p.file[1]), "CONTAINS", ("Class", name))
        for section in ("pre_tasks", "tasks", "post_tasks", "handlers"):
            tasks(play.get(section), ("Class", name))
        for r in play.get("roles") or []:
            role = r if isinstance(r, str) else r.get("role", "")
            p.node("Import", role, None)
            p.edge(("Class", name), "IMPORTS", ("Import", role))
        for v in play.get("vars") or {}:
            p.node("Variable", v, None)
            p.edge(("Class", name), "CONTAINS", ("Variable", v))
    if not plays:
        tasks(data, p.file)
    return p


def language_of(path: str, text: str = "") -> str | None:
    ext = "." + path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if ext in (".yml", ".yaml") and (re.search(r"(?:^|/)(?:playbooks|tasks|handlers|roles)/", path) or re.search(r"^\s*-?\s*hosts:", text, re.M)):
        return "ansible"
    return LANGUAGES.get(ext)


Parser = Callable[[str, str], Parsed]
_PARSERS: dict[str, Parser] = {"python": parse_python, "hcl": parse_hcl, "ansible": parse_ansible}


def register_parser(language: str, parser: Parser, *extensions: str) -> None:
    _PARSERS[language] = parser
    LANGUAGES.update(dict.fromkeys(extensions, language))


def parse(path: str, text: str) -> Parsed | None:
    """The rows of a file, or None where its language isn't known."""
    from .documents import parse_markdown

    language = language_of(path, text)
    if language == "markdown":
        return parse_markdown(path, text)
    if language in _PARSERS:
        return _PARSERS[language](path, text)
    return parse_by_rules(path, text, language) if language in GRAMMARS else None


ROWS = "source string, kind string, label string, name string, path string, file_path string, line_start int, line_end int, docstring string, description string, content string, signature string, semantic_type string, content_hash string, from_label string, from_name string, from_file string, type string, to_label string, to_name string, to_file string"
_FIELDS = [c.split()[0] for c in ROWS.split(", ")]


def excluded(path: str, patterns: list[str]) -> bool:
    """Whether a path relative to the root matches a pattern, whole or in one of its parts; an end slash of a
    pattern counts nothing."""
    parts = [path, *path.split("/")]
    return any(fnmatch.fnmatchcase(x, p) for p in (p.rstrip("/") for p in patterns) if p for x in parts)


def listing(root: str, exclude: tuple[str, ...] = (), nested: bool = False, also: tuple[str, ...] = ()) -> list[str]:
    """Paths, relative to ``root``, of the files that may be parsed, and of those named in ``also``, in order.

    Folders that are skipped, excluded (``exclude`` and the root's ignore file), or hold a ``.git`` of their
    own, which is another repository unless ``nested``, are never entered, so nothing below them is listed
    or read.  ``root`` is a path or a URI of a file system that the driver and the executors share.
    """
    files, top = _file_system(root)
    patterns = list(exclude)
    ignore = f"{top}/{IGNORE_FILE}"
    if files.get_file_info(ignore).is_file:
        with files.open_input_stream(ignore) as f:
            patterns += [x.strip() for x in f.read().decode("utf-8", "replace").splitlines() if x.strip() and not x.strip().startswith("#")]
    out, folders, wanted = [], [""], {*LANGUAGES, ".yml", ".yaml"}
    while folders:
        folder = folders.pop()
        entries = files.get_file_info(pafs.FileSelector(f"{top}/{folder}".rstrip("/")))
        if folder and not nested and any(e.base_name == ".git" for e in entries):
            continue
        for e in entries:
            path = f"{folder}/{e.base_name}".lstrip("/")
            if excluded(path, patterns):
                continue
            if e.type == pafs.FileType.Directory:
                if e.base_name not in SKIPPED:
                    folders.append(path)
            elif e.is_file and (("." + path.rsplit(".", 1)[-1].lower()) in wanted or e.base_name in also):
                out.append(path)
    return sorted(out)


def _file_system(root: str) -> tuple[pafs.FileSystem, str]:
    files, top = pafs.FileSystem.from_uri(root) if ":" in root.split("/", 1)[0] else (pafs.LocalFileSystem(), os.path.abspath(root))
    return files, top.rstrip("/")


def walk(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), nested: bool = False, also: tuple[str, ...] = ()) -> DataFrame:
    """(path, content) of the files of ``listing``; the driver holds their names, executors read them."""
    paths = listing(root, exclude, nested, also)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = _file_system(root)
        for batch in batches:
            for path in batch.column(0).to_pylist():  # one file a batch, so that no more than one is held
                with files.open_input_stream(f"{top}/{path}") as f:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([f.read()], pa.binary())], ["path", "content"])

    names = spark.createDataFrame([(p,) for p in paths], "path string")
    tasks = max(1, min(len(paths) // 64, 4 * spark.sparkContext.defaultParallelism))
    return names.repartition(tasks).mapInArrow(read, "path string, content binary")


def parse_files(files: DataFrame, redact: bool = False) -> DataFrame:
    """Node and edge rows (``kind``) of files (path, content), file by file on executors."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, content in zip(part.path, part.content, strict=True):
                text = bytes(content).decode("utf-8", "replace")
                if redact:
                    from ..operators.security import REDACTED, SECRETS

                    for p in SECRETS.values():
                        text = re.sub(p, REDACTED, text)
                parsed = parse(path, text)
                if parsed is None:
                    continue
                sha = hashlib.sha256(bytes(content)).hexdigest()
                rows += [{"source": path, "kind": "node", **n} | ({"content_hash": sha} if n["label"] in ("File", "Document") else {}) for n in parsed.nodes]
                rows += [{"source": path, "kind": "edge", **e} for e in parsed.edges]
            out = pd.DataFrame(rows).reindex(columns=_FIELDS) if rows else pd.DataFrame({c: [] for c in _FIELDS})
            for c in ("line_start", "line_end"):
                out[c] = out[c].astype("Int32")
            yield out.astype({c: object for c in _FIELDS if not c.startswith("line_")}).where(out.notna(), None)

    return files.mapInPandas(run, ROWS)


def assemble(rows: DataFrame, repo: str = "") -> tuple[Graph, DataFrame]:
    """(graph, (path, content_hash)) of parsed rows.  Edges whose ends don't exist are dropped; a node that is
    given twice is one."""
    raw = conform(rows.where("kind = 'node'").withColumn("repo", F.lit(repo or None)), NODE_COLUMNS)
    place = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.coalesce("file_path", "path", F.lit("")), F.coalesce("line_start", F.lit(0)), F.col(c).cast("string")))
    first = [F.min_by(c, place(c)).alias(c) for c in NODE_COLUMNS if c != "id"]  # the first that is given, by file and line
    nodes = raw.withColumn("id", node_id()).groupBy("id").agg(*first)
    edges, _ = resolve_edges(nodes, rows.where("kind = 'edge'").select("from_label", "from_name", "from_file", "type", "to_label", "to_name", "to_file").distinct())
    hashes = rows.where("kind = 'node' AND content_hash IS NOT NULL").select("path", "content_hash").distinct()
    return Graph(nodes, edges), hashes


def ingest(spark: SparkSession, root: str, repo: str = "", known: DataFrame | None = None, exclude: tuple[str, ...] = (), redact: bool = False, nested: bool = False) -> tuple[Graph, DataFrame]:
    """(graph, stored hashes) of a source tree; see ``assemble``.  ``known`` (path, content_hash) skips files
    that haven't changed.  Files are read and parsed once."""
    files = walk(spark, root, exclude, nested)
    if known is not None:
        files = files.withColumn("content_hash", F.sha2("content", 256)).join(known.select("path", "content_hash"), ["path", "content_hash"], "left_anti").drop("content_hash")
    return assemble(settle(parse_files(files, redact), "parsed"), repo)
