"""A typed property graph as two DataFrames, and the traversals that other operators are made of."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import fresh_path, settle  # noqa: F401  settle is used by the operators

#: Columns of a node table.  ``id`` is unique; absent properties are null, empty ones ''.
NODE_COLUMNS = {
    "id": "bigint", "label": "string", "name": "string", "path": "string", "file_path": "string", "repo": "string",
    "line_start": "int", "line_end": "int", "docstring": "string", "description": "string", "content": "string",
    "domain": "string", "status": "string", "severity": "string", "rationale": "string", "constraint_json": "string",
    "date": "string", "memory_type": "string", "email": "string", "role": "string", "team": "string",
    "semantic_type": "string", "signature": "string",
}
#: Columns of an edge table, unique on (src, dst, type).
EDGE_COLUMNS = {"src": "bigint", "dst": "bigint", "type": "string"}

SYMBOLS = ("Function", "Class", "Method")


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def of(self, *labels: str) -> DataFrame:
        return self.nodes.where(F.col("label").isin(*labels)) if labels else self.nodes

    def links(self, *types: str) -> DataFrame:
        """Edges of the given types; the filter prunes partitions of a table stored by type."""
        chosen = self.edges.where(F.col("type").isin(*types)) if types else self.edges
        return chosen.select("src", "dst", "type")

    def root(self, name: str, file_path: str = "", repo: str = "", labels: Iterable[str] = ()) -> DataFrame:
        """Ids of nodes of a name; empty parameters put no condition into the plan."""
        found = self.of(*labels).where(F.col("name") == name)
        if file_path:
            found = found.where(F.col("file_path") == file_path)
        if repo:
            found = found.where(F.col("repo") == repo)
        return found.select("id")

    def attach(self, ids: DataFrame, *columns: str, key: str = "id") -> DataFrame:
        """Node columns for ids; nodes are pruned to what is asked for."""
        return ids.join(self.nodes.select(F.col("id").alias(key), *columns), key)


def hops(edges: DataFrame, direction: str = "out") -> DataFrame:
    """(a, b) steps along ('out'), against ('in') or both ways of edges; a loop is one step."""
    out = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    back = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    if direction == "out":
        return out
    if direction == "in":
        return back
    return out.unionByName(back.where("a <> b"))


#: Rounds of a loop that go into one plan; then they are settled, and the loop ends if nothing was new.
ROUNDS = 4


def _both(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class Parts:
    """Tables of one schema, settled one after the other and read as one scan."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.paths, self.schema = spark, label, [], None

    def add(self, df: DataFrame) -> DataFrame:
        path = fresh_path(self.spark, self.label)
        df.write.parquet(path)
        self.paths.append(path)
        self.schema = df.schema
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths)


def reach(g: Graph, roots: DataFrame, types: Iterable[str], depth: int | None, direction: str = "out", per_root: bool = False) -> DataFrame:
    """(id, level) of nodes at the end of a path of 1..depth steps from ``roots``, with the least level;
    without a ``depth``, of all nodes that can be reached.

    With ``per_root`` (root, id, level).  A root is in the result only if it lies on a cycle of at most
    ``depth`` steps.  Each round joins the frontier with the edges and leaves out what has been reached,
    so a round's shuffle is that of its frontier's edges.  Beyond ``ROUNDS`` steps that many go into a plan, and
    what they find is settled once and not written again.
    """
    step = hops(g.links(*types), direction)
    keys = ["root", "id"] if per_root else ["id"]
    front = roots.select("id").distinct()
    front = front.select(F.col("id").alias("root"), "id") if per_root else front
    ahead = lambda f: f.join(step, F.col("id") == F.col("a")).select(*keys[:-1], F.col("b").alias("id")).distinct()
    if depth is not None and depth <= ROUNDS:
        found: list[DataFrame] = []
        for level in range(1, depth + 1):
            front = ahead(front)
            if found:
                front = front.join(_both([f.select(*keys) for f in found]), keys, "left_anti")
            found.append(front.withColumn("level", F.lit(level)))
        return _both(found) if found else front.withColumn("level", F.lit(0)).limit(0)
    parts = Parts(g.spark, "reach")
    level = 0
    while depth is None or level < depth:
        rounds: list[DataFrame] = []
        for level in range(level + 1, level + 1 + (ROUNDS if depth is None else min(ROUNDS, depth - level))):
            front = ahead(front)
            rounds.append(front.withColumn("level", F.lit(level)))
        new = _both(rounds).groupBy(*keys).agg(F.min("level").alias("level"))
        if parts.paths:
            new = new.join(parts.read().select(*keys), keys, "left_anti")
        front = parts.add(new).where(F.col("level") == level).select(*keys)
        if front.isEmpty():
            break
    return parts.read()


def trails(g: Graph, roots: DataFrame, types: Iterable[str], direction: str = "out", most: int | None = None) -> DataFrame:
    """(root, id, length): one row for each path that uses no edge twice.  Paths end by themselves; if one is
    longer than ``most`` steps, where that is given, it is an error.

    ``ROUNDS`` steps are one chain of outer joins, settled as a row for each path that ends within them or
    goes on after them; the paths that it begins with are told apart by their edges.
    """
    chosen = g.links(*types).select("src", "dst", F.concat_ws("-", "src", "dst", "type").alias("edge"))
    ways = {"out": [("src", "dst")], "in": [("dst", "src")], "both": [("src", "dst"), ("dst", "src")]}[direction]
    step = _both([(chosen if k == 0 else chosen.where("src <> dst")).select(F.col(a).alias("a"), F.col(b).alias("b"), "edge") for k, (a, b) in enumerate(ways)])
    front = roots.select(F.col("id").alias("root"), F.col("id").alias("at0"), F.array().cast("array<string>").alias("used"))
    parts = Parts(g.spark, "trails")
    length = 0
    while True:
        rounds = ROUNDS if most is None else min(ROUNDS, most + 1 - length)
        walk = front
        for k in range(1, rounds + 1):
            ahead = step.select(F.col("a").alias(f"at{k - 1}"), F.col("b").alias(f"at{k}"), F.col("edge").alias("edge_"))
            joined = walk.alias("w").join(ahead.alias("s"), (F.col(f"w.at{k - 1}") == F.col(f"s.at{k - 1}")) & ~F.array_contains("w.used", F.col("s.edge_")), "left")
            used = F.when(F.col("edge_").isNull(), F.col("used")).otherwise(F.array_append("used", F.col("edge_")))
            walk = joined.select("root", *[F.col(f"w.at{i}").alias(f"at{i}") for i in range(k)], F.col(f"s.at{k}").alias(f"at{k}"), used.alias("used"))
        steps = F.array(*[F.struct(F.lit(length + k).alias("length"), F.col(f"at{k}").alias("id")) for k in range(1, rounds + 1)])
        walk = parts.add(walk.where("at1 IS NOT NULL").select("root", steps.alias("steps"), "used"))
        length += rounds
        last = F.element_at("steps", rounds)["id"]
        front = walk.where(last.isNotNull()).select("root", last.alias("at0"), "used")
        if front.isEmpty():
            rows = parts.read().select("root", F.explode("steps").alias("s"), "used").where("s.id IS NOT NULL")
            return rows.select("root", "s.id", "s.length", F.slice("used", F.lit(1), F.col("s.length")).alias("path")).distinct().drop("path")
        if most is not None and length > most:
            raise ValueError(f"there are paths of more than {most} steps")


def any_of(column: str | Column, words: Iterable[str]) -> Column:
    col = F.col(column) if isinstance(column, str) else column
    test = F.lit(False)
    for w in words:
        test = test | col.contains(w)
    return test


def top(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """A limit that is the same on every run: ordered by a key that ends in something unique."""
    return df.orderBy(*order).limit(n)
