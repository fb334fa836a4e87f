"""Many graphs as one: namespacing, shared knowledge, partitions, residency."""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.graph import Graph, settle

#: Labels that are one node in all repositories, by name.
SHARED = ("Concept", "Person", "Domain", "Rule")


def repo_name_from_path(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1] or "repo"


def scoped_path(path: Column, repo: Column) -> Column:
    """A path under its repository's name, unless it already is."""
    prefix = F.concat(repo, F.lit("/"))
    return F.when(path.isNull() | (path == ""), path).when(path.startswith(prefix), path).otherwise(F.concat(prefix, path))


def aggregate_nodes(sources: DataFrame) -> DataFrame:
    """(label, name, path, file_path, repos, n) over nodes of several repositories (column repo).

    Paths get the repository's name in front; nodes without any path get it before their name, but
    those of ``SHARED`` labels, which are one node of a name with the sorted list of repositories.
    """
    shared = F.col("label").isin(*SHARED)
    bare = F.coalesce("path", F.lit("")).eqNullSafe("") & F.coalesce("file_path", F.lit("")).eqNullSafe("")
    name = F.when(shared | ~bare, F.col("name")).otherwise(F.concat("repo", F.lit(":"), "name"))
    rows = sources.select("label", name.alias("name"), F.when(~shared, scoped_path(F.col("path"), F.col("repo"))).alias("path"), F.when(~shared, scoped_path(F.col("file_path"), F.col("repo"))).alias("file_path"), "repo")
    return rows.groupBy("label", "name", "path", "file_path").agg(F.array_sort(F.collect_set("repo")).alias("repos"), F.count("*").alias("n"))


def aggregate(graphs: dict[str, Graph]) -> Graph:
    """One graph of several, with a Repository node for each that contains its files.  Ids are hashes of
    the merged identity, so edges move with a join on the old id."""
    parts, links = [], []
    for repo, g in graphs.items():
        shared = F.col("label").isin(*SHARED)
        n = g.nodes.withColumn("repo", F.lit(repo)).withColumn("old", F.col("id"))
        n = n.withColumn("path", F.when(shared, F.col("path")).otherwise(scoped_path(F.col("path"), F.lit(repo)))).withColumn("file_path", F.when(shared, F.col("file_path")).otherwise(scoped_path(F.col("file_path"), F.lit(repo))))
        key = F.when(shared, F.concat_ws("\x1f", "label", "name")).otherwise(F.concat_ws("\x1f", F.lit(repo), "label", "name", F.coalesce("path", "file_path", F.lit("")), F.coalesce("line_start", F.lit(0))))
        n = n.withColumn("id", F.xxhash64(key))
        anchor = F.xxhash64(F.lit(f"anchor\x1f{repo}"))
        parts.append(n)
        ids = n.select(F.col("old"), F.col("id").alias("new"))
        e = g.links().join(ids.select(F.col("old").alias("src"), F.col("new").alias("s")), "src").join(ids.select(F.col("old").alias("dst"), F.col("new").alias("d")), "dst")
        links.append(e.select(F.col("s").alias("src"), F.col("d").alias("dst"), "type"))
        links.append(n.where("label = 'File'").select(anchor.alias("src"), F.col("id").alias("dst"), F.lit("CONTAINS").alias("type")))
        row = g.nodes.limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in g.nodes.dtypes])
        parts.append(row.withColumn("id", anchor).withColumn("label", F.lit("Repository")).withColumn("name", F.lit(repo)).withColumn("path", F.lit(repo)).withColumn("repo", F.lit(repo)).withColumn("old", F.lit(None).cast("bigint")))
    nodes = parts[0]
    for p in parts[1:]:
        nodes = nodes.unionByName(p)
    edges = links[0]
    for e in links[1:]:
        edges = edges.unionByName(e)
    place = lambda c: F.when(F.col(c).isNotNull(), F.struct("repo", F.col(c).cast("string")))
    first = [F.min_by(c, place(c)).alias(c) for c in nodes.columns if c not in ("id", "old", "repo")]  # that of the first repository by name
    merged = nodes.groupBy("id").agg(*first, F.array_join(F.array_sort(F.collect_set("repo")), ",").alias("repo"))
    return Graph(merged, edges.distinct())


def partition_files(g: Graph, agents: int) -> DataFrame:
    """(file_path, part): distinct files in order, in contiguous runs of ceil(n / agents).

    Ranks come from counts of range partitions, not from one global window: files are sorted across
    tasks, each task numbers its own, and the tasks' offsets are added.  The numbers are settled first, as
    the bounds of ranges come from a sample that differs from one run to the next.
    """
    files = g.nodes.where("file_path IS NOT NULL AND file_path <> ''").select("file_path").distinct()
    dealt = files.repartitionByRange("file_path").sortWithinPartitions("file_path")
    numbered = dealt.select("file_path", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m"))
    numbered = settle(numbered.select("file_path", "p", F.col("m").bitwiseAND(F.lit((1 << 33) - 1)).alias("k")))
    sizes = sorted(numbered.groupBy("p").agg(F.count("*").alias("n")).collect())  # one row for each task
    each = math.ceil(sum(s.n for s in sizes) / max(1, agents)) or 1
    start, starts = 0, []
    for s in sizes:
        starts.append((s.p, start))
        start += s.n
    offsets = files.sparkSession.createDataFrame(starts or [(-1, 0)], "p int, start long")
    return numbered.join(F.broadcast(offsets), "p").select("file_path", F.floor((F.col("k") + F.col("start")) / each).cast("int").alias("part"))


class Residency:
    """At most ``most`` graphs kept in memory; the least recently used goes."""

    def __init__(self, load: Callable[[str], Graph], most: int = 4):
        self.load, self.most = load, most
        self.held: OrderedDict[str, Graph] = OrderedDict()

    def get(self, name: str) -> Graph:
        if name in self.held:
            self.held.move_to_end(name)
            return self.held[name]
        while len(self.held) >= self.most:
            _, old = self.held.popitem(last=False)
            old.nodes.unpersist()
            old.edges.unpersist()
        g = self.load(name)
        self.held[name] = Graph(g.nodes.persist(), g.edges.persist())
        return self.held[name]

    def drop(self, names: Iterable[str] | None = None) -> None:
        for n in list(names or self.held):
            g = self.held.pop(n, None)
            if g:
                g.nodes.unpersist()
                g.edges.unpersist()
