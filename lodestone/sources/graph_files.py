"""Graphs as files: JSON lines, the interchange form as JSON or SQLite, versioned checkpoints."""

from __future__ import annotations

import json
import shutil
import sqlite3
import time
import uuid
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass
from pathlib import Path
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..operators.store import NODE_COLUMNS, conform, interchange_ids, load, node_id, resolve_edges, save
from ..plans.graph import Graph
from ..shared import settle

#: Name of the interchange form; a file with another name before ``-kg/v1`` is read as well.
FORMAT = "property-kg/v1"
_PROPS = [c for c in NODE_COLUMNS if c not in ("id", "label")]


def _lines(g: Graph) -> DataFrame:
    props = F.to_json(F.struct(*_PROPS))
    nodes = g.nodes.select(F.lit(0).alias("o"), F.col("label").alias("k1"), props.alias("k2"), F.lit("").alias("k3"), F.to_json(F.struct(F.lit("node").alias("kind"), "label", F.struct(*_PROPS).alias("props"))).alias("value"))
    n = g.nodes.select("id", F.struct("label", "name", F.coalesce("path", "file_path", F.lit("")).alias("path")).alias("end"))
    e = g.edges.join(n.select(F.col("id").alias("src"), F.col("end").alias("from")), "src").join(n.select(F.col("id").alias("dst"), F.col("end").alias("to")), "dst")
    edges = e.select(F.lit(1).alias("o"), F.col("type").alias("k1"), F.to_json("from").alias("k2"), F.to_json("to").alias("k3"), F.to_json(F.struct(F.lit("edge").alias("kind"), "type", "from", "to")).alias("value"))
    return nodes.unionByName(edges).orderBy("o", "k1", "k2", "k3").select("value")


def export_jsonl(g: Graph, path: str) -> None:
    """A folder of text files that in file order hold all nodes, then all edges, each sorted."""
    _lines(g).write.mode("overwrite").text(path)


_LINE = f"kind string, label string, props struct<{', '.join(f'{c}: {t}' for c, t in NODE_COLUMNS.items() if c in _PROPS)}>, type string, `from` struct<label: string, name: string, path: string>, `to` struct<label: string, name: string, path: string>"


def import_jsonl(spark: SparkSession, path: str) -> Graph:
    """The graph of such lines.  An edge's end is found by label, name and either of its paths."""
    rows = spark.read.schema(_LINE).json(path)
    raw = conform(rows.where("kind = 'node'").select("label", "props.*"), NODE_COLUMNS)
    nodes = raw.withColumn("id", node_id()).dropDuplicates(["id"])
    ends = rows.where("kind = 'edge'").select(F.col("from.label").alias("from_label"), F.col("from.name").alias("from_name"), F.col("from.path").alias("from_file"), "type", F.col("to.label").alias("to_label"), F.col("to.name").alias("to_name"), F.col("to.path").alias("to_file"))
    return Graph(nodes, resolve_edges(nodes, ends)[0])


def interchange(g: Graph) -> tuple[DataFrame, DataFrame]:
    """(nodes id, name, type, props) and (edges source, target, type) under readable ids."""
    ids = interchange_ids(g.nodes)
    nodes = g.nodes.join(ids, "id").select(F.col("kg_id").alias("id"), "name", F.col("label").alias("type"), F.to_json(F.struct(*_PROPS)).alias("props"))
    e = g.edges.join(ids.select(F.col("id").alias("src"), F.col("kg_id").alias("source")), "src").join(ids.select(F.col("id").alias("dst"), F.col("kg_id").alias("target")), "dst")
    return nodes, e.select("source", "target", "type")


def export_kg(g: Graph, path: str) -> dict[str, int]:
    """Write the interchange form to one file on a shared path, SQLite by its extension, else JSON; (nodes, edges)
    counts.  Tasks write parts beside the file, and the driver puts the parts together as they are: no row
    goes through it."""
    nodes, edges = (settle(x, "interchange") for x in interchange(g))
    counts = {"nodes": nodes.count(), "edges": edges.count()}
    edges = edges.withColumn("props", F.lit("{}"))
    if path.endswith((".db", ".sqlite", ".sqlite3")):
        Path(path).unlink(missing_ok=True)
        g.spark.dataSource.register(SqliteSource)
        keys = {"nodes": "id TEXT PRIMARY KEY, name TEXT, type TEXT, props JSON", "edges": "source TEXT, target TEXT, type TEXT, props JSON"}
        for table, rows, order in (("nodes", nodes, ["id"]), ("edges", edges, ["source", "target", "type"])):
            columns = [c.split()[0] for c in keys[table].split(", ")]
            rows.select(*columns).orderBy(*order).write.format("sqlite_table").mode("append").option("path", path).option("table", table).option("create", keys[table]).option("columns", ",".join(columns)).save()
        with closing(sqlite3.connect(path)) as db:
            db.executescript("CREATE INDEX edges_source ON edges(source); CREATE INDEX edges_target ON edges(target);")
        return counts
    one = nodes.orderBy("id").select(F.to_json(F.struct("id", "name", "type", F.parse_json("props").alias("props"))))
    two = edges.orderBy("source", "target", "type").select(F.to_json(F.struct("source", "target", "type", F.parse_json("props").alias("props"))))
    with open(path, "wb") as out:
        out.write(f'{{"format": {json.dumps(FORMAT)}, "nodes": ['.encode())
        _append(one, f"{path}.nodes", out)
        out.write(b'], "edges": [')
        _append(two, f"{path}.edges", out)
        out.write(b"]}")
    return counts


def _append(lines: DataFrame, folder: str, out: BinaryIO) -> None:
    """Write rows of JSON as parts of a folder, in order, then their bytes one after the other."""
    lines.write.mode("overwrite").option("lineSep", ",\n").text(Path(folder).absolute().as_uri())
    size = 0
    for part in sorted(Path(folder).glob("part-*")):
        with open(part, "rb") as f:
            shutil.copyfileobj(f, out, 1 << 20)
        size += part.stat().st_size
    if size:  # the last separator
        out.seek(-2, 2)
        out.truncate()
    shutil.rmtree(folder)


def import_kg(spark: SparkSession, path: str) -> Graph:
    """Read the interchange form; SQLite is told by its first bytes."""
    with open(path, "rb") as f:
        magic = f.read(16)
    if magic.startswith(b"SQLite format 3"):
        spark.dataSource.register(SqliteSource)
        nodes = spark.read.format("sqlite_table").option("path", path).option("table", "nodes").option("columns", "id,name,type,props").load()
        edges = spark.read.format("sqlite_table").option("path", path).option("table", "edges").option("columns", "source,target,type").load()
    else:
        doc = spark.read.option("multiLine", "true").schema("format string, nodes array<struct<id: string, name: string, type: string, props: string>>, edges array<struct<source: string, target: string, type: string>>").json(path)
        if not (doc.first()["format"] or "").endswith("-kg/v1"):
            raise ValueError(f"{path} is no interchange file")
        nodes, edges = doc.select(F.inline("nodes")), doc.select(F.inline("edges"))
    props = F.from_json("props", ", ".join(f"{c} {NODE_COLUMNS[c]}" for c in _PROPS if c != "name"))
    rows = nodes.select(F.col("id").alias("kg_id"), "name", F.col("type").alias("label"), props.alias("p")).select("kg_id", "name", "label", "p.*")
    ids = rows.select("kg_id", F.xxhash64("kg_id").alias("i"))
    full = conform(rows.withColumn("id", F.xxhash64("kg_id")), NODE_COLUMNS)
    e = edges.join(ids.select(F.col("kg_id").alias("source"), F.col("i").alias("src")), "source").join(ids.select(F.col("kg_id").alias("target"), F.col("i").alias("dst")), "target")
    return Graph(full, e.select("src", "dst", "type").distinct())


class _Rows(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _SqliteReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table = options["path"], options["table"]
        self.columns = options["columns"].split(",")
        self.each = int(options.get("rows", "100000"))

    def partitions(self) -> list[InputPartition]:
        with closing(sqlite3.connect(self.path)) as db:
            low, high = db.execute(f"SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM {self.table}").fetchone()
        return [_Rows(a, min(a + self.each - 1, high)) for a in range(low, high + 1, self.each)] or [_Rows(0, -1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with closing(sqlite3.connect(self.path)) as db:
            yield from db.execute(f"SELECT {', '.join(self.columns)} FROM {self.table} WHERE rowid BETWEEN ? AND ?", (partition.low, partition.high))


class SqliteSource(DataSource):
    """A table of a SQLite file on a shared path, read in ranges of row ids; columns come as text."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        return ", ".join(f"{c} string" for c in self.options["columns"].split(","))

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _SqliteWriter(dict(self.options), overwrite)


@dataclass
class _Part(WriterCommitMessage):
    path: str
    first: int


class _SqliteWriter(DataSourceWriter):
    """Every task fills a file of its own; the commit copies the files' tables into one, in the tasks' order."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.table = options["path"], options["table"]
        self.columns, self.overwrite = options["columns"].split(","), overwrite
        self.create = options.get("create") or ", ".join(f"{c} TEXT" for c in self.columns)

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        part = f"{self.path}.{self.table}-{number:06d}-{uuid.uuid4().hex}.part"
        with closing(sqlite3.connect(part)) as db:
            db.execute("PRAGMA journal_mode = OFF")
            db.execute(f"CREATE TABLE part({', '.join(f'{c} TEXT' for c in self.columns)})")
            db.executemany(f"INSERT INTO part VALUES ({', '.join('?' * len(self.columns))})", (tuple(None if x is None else str(x) for x in r) for r in iterator))
            db.commit()
        return _Part(part, number)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        parts = sorted((m for m in messages if m), key=lambda m: m.first)
        with closing(sqlite3.connect(self.path)) as db:
            if self.overwrite:
                db.execute(f"DROP TABLE IF EXISTS {self.table}")
            db.execute(f"CREATE TABLE IF NOT EXISTS {self.table}({self.create})")
            for m in parts:
                db.execute("ATTACH ? AS one", (m.path,))
                db.execute(f"INSERT INTO {self.table} ({', '.join(self.columns)}) SELECT * FROM one.part ORDER BY rowid")
                db.commit()
                db.execute("DETACH one")
        for m in parts:
            Path(m.path).unlink(missing_ok=True)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for m in messages:
            if m:
                Path(m.path).unlink(missing_ok=True)


def sqlite_table(spark: SparkSession, path: str, table: str, columns: list[str]) -> DataFrame:
    """Columns of a table of a SQLite file as text, read in ranges of row ids; columns that it lacks are null."""
    with closing(sqlite3.connect(f"{Path(path).absolute().as_uri()}?mode=ro", uri=True)) as db:
        there = {r[1] for r in db.execute(f"PRAGMA table_info({table})")}
    if not there:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))
    spark.dataSource.register(SqliteSource)
    have = [c for c in columns if c in there]
    rows = spark.read.format("sqlite_table").option("path", path).option("table", table).option("columns", ",".join(have)).load()
    return rows.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns])


class Checkpoints:
    """Named versions of a graph below one folder, with an index."""

    def __init__(self, folder: str):
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)

    def list(self) -> list[dict]:
        index = self.folder / "index.json"
        return json.loads(index.read_text()) if index.exists() else []

    def create(self, g: Graph, label: str = "") -> str:
        name = f"v{len(self.list()) + 1:06d}"
        save(g, str(self.folder / name))
        entry = {"name": name, "label": label, "created_at": time.time(), "nodes": g.nodes.count(), "edges": g.edges.count()}
        (self.folder / "index.json").write_text(json.dumps([*self.list(), entry], indent=2))
        return name

    def restore(self, spark: SparkSession, name: str) -> Graph:
        if name not in [x["name"] for x in self.list()]:
            raise KeyError(name)
        return load(spark, str(self.folder / name))
