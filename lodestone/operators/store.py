"""Storage primitives: identity, upserts, deletes, counts, exports, versions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.graph import EDGE_COLUMNS, NODE_COLUMNS, Graph

#: Labels that are identified by their path.
BY_PATH = ("File", "Document", "Repository")


def merge_key() -> Column:
    """What makes a node itself within its label: path; memory by name and repository; name and file;
    name alone.  Blank values count as absent."""
    full = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    sep = "\x1f"
    return (
        F.when(F.col("label").isin(*BY_PATH), F.concat_ws(sep, F.lit("path"), F.coalesce("path", F.lit(""))))
        .when(full("memory_type") & full("repo"), F.concat_ws(sep, F.lit("memory"), "name", "repo"))
        .when(full("file_path"), F.concat_ws(sep, F.lit("file"), "name", "file_path"))
        .otherwise(F.concat_ws(sep, F.lit("name"), "name"))
    )


def node_id() -> Column:
    return F.xxhash64("label", merge_key())


def conform(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The given columns in order, absent ones as null."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])


def upsert_nodes(current: DataFrame, incoming: DataFrame, order: str = "seq") -> DataFrame:
    """Nodes after merging rows by identity: per property the last value that isn't null wins, so a row
    overlays only what it supplies.  ``incoming`` has a sequence column; ``current`` comes before it."""
    old = conform(current, NODE_COLUMNS).withColumn("__s", F.lit(None).cast("bigint"))
    new = conform(incoming, NODE_COLUMNS | {order: "bigint"}).withColumnRenamed(order, "__s")
    both = old.unionByName(new).withColumn("id", node_id())
    at = F.coalesce("__s", F.lit(-1 << 62))
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in NODE_COLUMNS if c != "id"]
    return both.groupBy("id").agg(*last).select(*NODE_COLUMNS)


def resolve_edges(nodes: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, unmatched) for rows (from_label, from_name, from_file, type, to_label, to_name, to_file).

    An empty file matches any, so a partial key reaches every node that fits.  Edges come distinct;
    rows that miss an end come back as they are.  All nodes exist before, so nothing has to be replayed.
    """
    wanted = wanted.withColumn("__w", F.monotonically_increasing_id()) if "__w" not in wanted.columns else wanted
    n = nodes.select("id", "label", "name", F.coalesce("file_path", "path", F.lit("")).alias("f"))
    a = n.select(F.col("id").alias("src"), F.col("label").alias("from_label"), F.col("name").alias("from_name"), F.col("f").alias("fa"))
    b = n.select(F.col("id").alias("dst"), F.col("label").alias("to_label"), F.col("name").alias("to_name"), F.col("f").alias("fb"))
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    keyed = wanted.withColumn("__w", F.xxhash64(*[c for c in wanted.columns if c != "__w"]))
    hit = keyed.join(a, ["from_label", "from_name"]).where(empty("from_file") | (F.col("from_file") == F.col("fa")))
    hit = hit.join(b, ["to_label", "to_name"]).where(empty("to_file") | (F.col("to_file") == F.col("fb")))
    edges = hit.select("src", "dst", "type").distinct()
    return edges, keyed.join(hit.select("__w").distinct(), "__w", "left_anti").drop("__w")


def delete_file(g: Graph, path: str, transitive: bool = False) -> Graph:
    """The graph without what a file contains and its imports, and without edges at them.  ``transitive``
    also takes whatever lies in the file by its own file path."""
    file = g.of("File").where(F.col("path") == path).select(F.col("id").alias("src"))
    gone = g.links("CONTAINS").join(file, "src").select(F.col("dst").alias("id"))
    mine = g.nodes.where(F.col("file_path") == path)
    gone = gone.unionByName((mine if transitive else mine.where("label = 'Import'")).select("id")).distinct()
    return without(g, gone)


def without(g: Graph, ids: DataFrame) -> Graph:
    nodes = g.nodes.join(ids.select("id"), "id", "left_anti")
    edges = g.edges.join(ids.select(F.col("id").alias("src")), "src", "left_anti").join(ids.select(F.col("id").alias("dst")), "dst", "left_anti")
    return Graph(nodes, edges.select("src", "dst", "type"))


def clear_document_references(g: Graph, path: str) -> Graph:
    doc = g.of("Document").where(F.col("path") == path).select(F.col("id").alias("src"), F.lit("REFERENCES").alias("type"))
    return Graph(g.nodes, g.edges.join(doc, ["src", "type"], "left_anti").select("src", "dst", "type"))


def clear(g: Graph) -> Graph:
    return Graph(g.nodes.limit(0), g.edges.limit(0))


def counts(g: Graph) -> DataFrame:
    n = g.nodes.agg(F.count("*").alias("n")).select(F.lit("nodes").alias("what"), "n")
    return n.unionByName(g.edges.agg(F.count("*").alias("n")).select(F.lit("edges").alias("what"), "n"))


def page(df: DataFrame, order: list[str], number: int, size: int = 5000) -> DataFrame:
    return df.orderBy(*order).offset(number * size).limit(size)


def unchanged(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Files (path, content) whose hash isn't stored yet: what an incremental ingest has to parse."""
    return files.withColumn("content_hash", F.sha2("content", 256)).join(stored.select("path", "content_hash"), ["path", "content_hash"], "left_anti")


def interchange_ids(nodes: DataFrame) -> DataFrame:
    """(id, kg_id): label:path:name, and #1, #2 ... for later nodes of the same, by id."""
    base = F.concat_ws(":", "label", F.coalesce("path", "file_path", F.lit("")), F.coalesce("name", F.lit("")))
    n = F.row_number().over(Window.partitionBy("base").orderBy("id")) - 1
    rows = nodes.select("id", base.alias("base")).withColumn("n", n)
    return rows.select("id", F.when(F.col("n") == 0, F.col("base")).otherwise(F.concat("base", F.lit("#"), F.col("n").cast("string"))).alias("kg_id"))


#: Files that a task has open at once before it sorts by label after all.
WRITERS = 32


def save(g: Graph, path: str, apart: bool = False) -> None:
    """Nodes stored by label and edges by type, so that scans prune.  Rebalancing keeps each label's
    files few and splits large labels over several tasks.  Where labels and types lie ``apart``, so that a task
    has few of them, it writes them as they come: nothing is shuffled, and no task sorts what it writes."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    conf = g.spark.conf
    before = conf.get(key)
    if apart:
        conf.set(key, str(WRITERS))
    try:
        for df, part, by in ((conform(g.nodes, NODE_COLUMNS), "nodes", "label"), (conform(g.edges, EDGE_COLUMNS), "edges", "type")):
            (df if apart else df.hint("rebalance", by)).write.mode("overwrite").partitionBy(by).parquet(f"{path}/{part}")
    finally:
        conf.set(key, before)


def load(spark: SparkSession, path: str) -> Graph:

    def read(part: str, columns: dict[str, str]) -> DataFrame:
        schema = ", ".join(f"{c} {t}" for c, t in columns.items())
        return conform(spark.read.schema(schema).parquet(f"{path}/{part}"), columns)

    return Graph(read("nodes", NODE_COLUMNS), read("edges", EDGE_COLUMNS))


Migration = Callable[[Graph], Graph]
_MIGRATIONS: dict[int, Migration] = {}
VERSION = 2


def migration(to: int) -> Callable[[Migration], Migration]:
    """Register a function that brings a graph from the version before to ``to``."""

    def add(f: Migration) -> Migration:
        _MIGRATIONS[to] = f
        return f

    return add


@migration(2)
def _hashes(g: Graph) -> Graph:
    if "content_hash" not in g.nodes.columns:
        return Graph(g.nodes.withColumn("content_hash", F.lit("")), g.edges)
    return Graph(g.nodes.withColumn("content_hash", F.coalesce("content_hash", F.lit(""))), g.edges)


def migrate(g: Graph, version: int) -> tuple[Graph, int]:
    """The graph at the newest version, by the registered steps in order."""
    while version < VERSION:
        version += 1
        g = _MIGRATIONS[version](g) if version in _MIGRATIONS else g
    return g, version
