"""Workspaces: packages of one tree, nested repositories, registries of many."""

from __future__ import annotations

import json
import posixpath
import tomllib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import NODE_COLUMNS, conform, node_id
from ..plans.graph import SYMBOLS, Graph
from ..shared import settle
from .code import _file_system, assemble, ingest, listing, parse_files, walk
from .documents import parse_manifest

# Files that tell a workspace's kind, first match wins.
KINDS = (("turbo", "turbo.json"), ("nx", "nx.json"), ("pnpm", "pnpm-workspace.yaml"))
MANIFESTS = ("package.json", "pyproject.toml", "Cargo.toml", "go.mod")


def _named(path: str, text: str) -> str:
    """The name that a manifest gives its package; '' where it gives none or can't be read."""
    try:
        if path.endswith("package.json"):
            return str(json.loads(text).get("name") or "")
        if path.endswith("go.mod"):
            return next((x.split()[1] for x in text.splitlines() if x.startswith("module ")), "")
        data = tomllib.loads(text)
        return str((data.get("project") or data.get("package") or {}).get("name") or "")
    except (ValueError, AttributeError, IndexError):
        return ""


def manifests(files: DataFrame) -> DataFrame:
    """(dir, manifest, name, wants) of the manifests among files (path, content): one a directory, the first of
    ``MANIFESTS``; ``wants`` are the packages that it requires.  Tasks read them, and one that can't be read
    requires nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, content in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                text = content.decode("utf-8", "replace")
                try:
                    wants = sorted({k for k, _ in parse_manifest(path, text)})
                except (ValueError, AttributeError, TypeError):
                    wants = []
                out.append((posixpath.dirname(path), posixpath.basename(path), _named(path, text), wants))
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.list_(pa.string())), strict=True)], ["dir", "manifest", "name", "wants"])

    base = F.element_at(F.split("path", "/"), -1)
    rows = files.where(base.isin(*MANIFESTS)).select("path", "content").mapInArrow(run, "dir string, manifest string, name string, wants array<string>")
    first = F.min_by(F.struct("manifest", "name", "wants"), F.array_position(F.array(*[F.lit(m) for m in MANIFESTS]), F.col("manifest")))
    return rows.groupBy("dir").agg(first.alias("m")).select("dir", "m.manifest", "m.name", "m.wants")


def detect(root: str) -> str | None:
    """The kind of workspace below a root, by its files; a tree with two packages or more is 'bare'."""
    files, top = _file_system(root)

    def text(name: str) -> str | None:
        if not files.get_file_info(f"{top}/{name}").is_file:
            return None
        with files.open_input_stream(f"{top}/{name}") as f:
            return f.read().decode("utf-8", "replace")

    for kind, name in KINDS:
        if text(name) is not None:
            return kind
    if (found := text("package.json")) is not None and json.loads(found).get("workspaces"):
        return "yarn"
    if (found := text("Cargo.toml")) is not None and "workspace" in tomllib.loads(found):
        return "cargo"
    if text("go.work") is not None:
        return "go"
    inside = {posixpath.dirname(p) for p in listing(root, also=MANIFESTS) if posixpath.basename(p) in MANIFESTS}
    return "bare" if len(inside - {""}) >= 2 else None


def _requirements(packages: DataFrame) -> DataFrame:
    """(package, depends_on) by directory: a requirement means a package by its directory's path or last part, by the
    last part of its own name, or by its manifest's name, in that order.  Each way is an equality join."""
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    wants = packages.select(F.col("dir").alias("package"), F.explode("wants").alias("dep")).distinct()
    ways = [("dep", "dir"), ("dep", "base"), ("bare", "base"), ("dep", "name"), ("bare", "bare_name")]
    known = packages.select("dir", "name", last("dir").alias("base"), last("name").alias("bare_name")).where("dir <> ''")
    asked = wants.withColumn("bare", last("dep"))
    hits = [asked.join(known.where(F.col(b) != "").select(F.col(b).alias(a), "dir"), a).select("package", "dep", F.lit(k).alias("way"), "dir") for k, (a, b) in enumerate(ways)]
    rows = hits[0]
    for h in hits[1:]:
        rows = rows.unionByName(h)
    best = rows.where("package <> dir").groupBy("package", "dep").agg(F.min(F.struct("way", "dir")).alias("m"))
    return best.select("package", F.col("m.dir").alias("depends_on")).distinct()


def package_dependencies(spark: SparkSession, root: str) -> DataFrame:
    """(package, depends_on) between packages of a tree, by directory."""
    return _requirements(manifests(walk(spark, root, also=MANIFESTS)).where("dir <> ''"))


def ingest_packages(spark: SparkSession, root: str, name: str = "", exclude: tuple[str, ...] = ()) -> tuple[Graph, DataFrame]:
    """(graph, (package, files, symbols)) of a tree of packages, every file read and parsed once.

    A Repository stands for the tree, named ``name`` or like its folder, and one for each package, with its
    directory for a path; the tree CONTAINS packages, packages DEPENDS_ON each other as their manifests require.
    A file, and what it holds, belongs (``repo``, BELONGS_TO) to the package of the longest directory above it,
    else to the tree: a join on the directories above each file.
    """
    whole = name or posixpath.basename(root.rstrip("/"))
    files = walk(spark, root, exclude, also=MANIFESTS)
    packages = settle(manifests(files).where("dir <> ''"), "packages")
    rows = settle(parse_files(files), "parsed")
    graph, _ = assemble(rows)
    nodes = graph.nodes.withColumn("place", F.coalesce("file_path", "path"))
    parts = F.split("place", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    places = nodes.select("place").where("place IS NOT NULL AND place <> ''").distinct()
    owner = places.select("place", F.explode(above).alias("dir")).join(packages.select("dir"), "dir").groupBy("place").agg(F.max_by("dir", F.length("dir")).alias("package"))
    owned = nodes.join(owner, "place", "left").withColumn("repo", F.coalesce("package", F.lit(whole))).drop("place", "package")
    heads = packages.select(F.element_at(F.split("dir", "/"), -1).alias("name"), F.col("dir").alias("path")).unionByName(spark.createDataFrame([(whole, whole)], "name string, path string"))
    heads = conform(heads.select(F.lit("Repository").alias("label"), "name", "path", F.col("path").alias("repo")), NODE_COLUMNS).withColumn("id", node_id())
    by_path = heads.select(F.col("path").alias("repo"), F.col("id").alias("head"))
    inside = packages.select(F.col("dir").alias("repo")).join(by_path, "repo").crossJoin(F.broadcast(by_path.where(F.col("repo") == whole).select(F.col("head").alias("top"))))
    contains = inside.select(F.col("top").alias("src"), F.col("head").alias("dst"), F.lit("CONTAINS").alias("type"))
    needs = _requirements(packages)
    for side, column in (("src", "package"), ("dst", "depends_on")):
        needs = needs.join(by_path.select(F.col("repo").alias(column), F.col("head").alias(side)), column)
    belongs = owned.where("label = 'File'").select("id", "repo").join(by_path, "repo").select(F.col("id").alias("src"), F.col("head").alias("dst"), F.lit("BELONGS_TO").alias("type"))
    edges = graph.edges.select("src", "dst", "type").unionByName(contains).unionByName(needs.select("src", "dst", F.lit("DEPENDS_ON").alias("type"))).unionByName(belongs)
    counts = owned.groupBy(F.col("repo").alias("package")).agg(F.count_if(F.col("label") == "File").alias("files"), F.count_if(F.col("label").isin(*SYMBOLS)).alias("symbols"))
    return Graph(owned.select(*heads.columns).unionByName(heads), edges.distinct()), counts


def nested_repositories(root: str) -> list[tuple[str, str]]:
    """(name, path) of repositories below a folder; what lies in one isn't searched."""
    files, top = _file_system(root)
    out, folders = [], [""]
    while folders:
        folder = folders.pop()
        entries = files.get_file_info(pafs.FileSelector(f"{top}/{folder}".rstrip("/")))
        if folder and any(e.base_name == ".git" for e in entries):
            out.append((folder.replace("/", "-"), f"{top}/{folder}"))
            continue
        folders += [f"{folder}/{e.base_name}".lstrip("/") for e in entries if e.type == pafs.FileType.Directory and e.base_name not in (".git", "node_modules")]
    return sorted(out)


class Registry:
    """Named repositories in a JSON file."""

    def __init__(self, path: str):
        self.path = Path(path)

    def all(self) -> dict[str, str]:
        return json.loads(self.path.read_text()) if self.path.exists() else {}

    def register(self, name: str, folder: str) -> None:
        self.path.write_text(json.dumps(self.all() | {name: folder}, indent=2, sort_keys=True))

    def ingest_all(self, spark: SparkSession) -> dict[str, Graph]:
        """The graph of every repository by name, each with its name for ``repo``."""
        return {name: ingest(spark, folder, name)[0] for name, folder in self.all().items()}

    def remove(self, name: str) -> None:
        self.path.write_text(json.dumps({k: v for k, v in self.all().items() if k != name}, indent=2, sort_keys=True))
