"""Snapshots as intervals: a symbol's stay from one snapshot to another is one row, however many lie between.

Snapshots are numbered from 1 in order of time.  ``since`` is the first snapshot of a stay and ``until`` the first
after it, null while it lasts, so a symbol that doesn't change costs a new snapshot nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.graph import SYMBOLS, Graph
from ..streaming.versions import Versions
from . import history, review
from .impact import affected_knowledge, blast_radius

_SYMBOL = ["label", "name", "file_path"]
STAYS = "label string, name string, file_path string, since int, until int"
SNAPSHOTS = "at int, ref string, commit_sha string, committed_at string"


def encode(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stays, snapshots) of full copies (ref, committed_at, label, name, file_path)."""
    order = members.select("ref", "committed_at").distinct()
    order = order.withColumn("at", F.row_number().over(Window.orderBy("committed_at", "ref")))  # a row a snapshot
    here = members.join(order, ["ref", "committed_at"]).select(*_SYMBOL, "at").distinct()
    run = F.col("at") - F.row_number().over(Window.partitionBy(*_SYMBOL).orderBy("at"))
    stays = here.withColumn("run", run).groupBy(*_SYMBOL, "run").agg(F.min("at").alias("since"), (F.max("at") + 1).alias("until"))
    newest = order.agg(F.max("at").alias("newest"))
    stays = stays.join(F.broadcast(newest)).select(*_SYMBOL, F.col("since").cast("int").alias("since"), F.when(F.col("until") <= F.col("newest"), F.col("until")).cast("int").alias("until"))
    return stays, order.select(F.col("at").cast("int").alias("at"), "ref", F.lit(None).cast("string").alias("commit_sha"), "committed_at")


def members_at(stays: DataFrame, snapshots: DataFrame, *refs: str) -> DataFrame:
    """Full copies (ref, committed_at, label, name, file_path) of the snapshots of some refs, or of all: a stay
    is spread over the numbers it covers and meets them by equality."""
    chosen = snapshots.where(F.col("ref").isin(*refs)) if refs else snapshots
    last = chosen.agg(F.min("at").alias("low"), F.max("at").alias("high"))
    inside = stays.join(F.broadcast(last)).where("since <= high AND (until IS NULL OR until > low)")
    spread = inside.select(*_SYMBOL, F.explode(F.sequence(F.greatest("since", "low"), F.least(F.coalesce(F.col("until") - 1, F.col("high")), F.col("high")))).alias("at"))
    return spread.join(chosen.select("at", "ref", "committed_at"), "at").select("ref", "committed_at", *_SYMBOL)


class Snapshots:
    """Snapshots of a graph below a folder: versions of the stays that have ended, of those that last, and of the
    snapshots' own rows."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.versions = Versions(spark, f"{self.folder}/lasting")

    def snapshots(self) -> DataFrame:
        last = self.versions.latest() or 0
        return self.spark.read.schema(SNAPSHOTS).parquet(*[f"{self.folder}/heads/{k}" for k in range(1, last + 1)]) if last else self.spark.createDataFrame([], SNAPSHOTS)

    def _lasting(self) -> DataFrame:
        last = self.versions.latest()
        return self.spark.createDataFrame([], STAYS) if last is None else self.spark.read.schema(STAYS).parquet(self.versions.at(last))

    def stays(self) -> DataFrame:
        last = self.versions.latest() or 0
        ended = [f"{self.folder}/ended/{k}" for k in range(1, last + 1)]
        return self._lasting().unionByName(self.spark.read.schema(STAYS).parquet(*ended)) if ended else self._lasting()

    def take(self, g: Graph, ref: str, commit: str = "", committed_at: str = "") -> int:
        """Add a snapshot of a graph's symbols; its number.  What has gone is written once to the ended stays;
        ended stays of before are not touched.  Of two takers at once one gets ``Taken``."""
        at = (self.versions.latest() or 0) + 1
        now = g.of(*SYMBOLS).select(*_SYMBOL).distinct()
        open_ = self._lasting()
        key = [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in _SYMBOL]
        gone = open_.alias("o").join(now.alias("n"), key, "left_anti").withColumn("until", F.lit(at))
        gone.write.mode("overwrite").parquet(f"{self.folder}/ended/{at}")
        kept = open_.alias("o").join(now.alias("n"), key, "left_semi")
        fresh = now.alias("n").join(open_.alias("o"), key, "left_anti").select(*_SYMBOL, F.lit(at).alias("since"), F.lit(None).cast("int").alias("until"))
        self.spark.createDataFrame([(at, ref, commit, committed_at)], SNAPSHOTS).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/heads/{at}")
        self.versions.write(kept.unionByName(fresh), at)
        return at

    def members(self, *refs: str) -> DataFrame:
        return members_at(self.stays(), self.snapshots(), *refs)


def snapshot_report(g: Graph, stays: DataFrame, snapshots: DataFrame, base: str, head: str, ranges: DataFrame | None = None, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """(changes, summary) between two snapshots.

    Changes are ``history.diff_snapshots``' rows.  The summary is one row: how many symbols were added, removed and
    moved, the files that this touches, and what lies within ``depth`` steps of the added ones: nodes, their
    files, and knowledge.  If a snapshot is missing, the report is that of the changed line ``ranges``
    (file_path, first, last; see ``review.diff_report``), whose status is 'changed', or an error without them.
    """
    known = {r.ref for r in snapshots.where(F.col("ref").isin(base, head)).select("ref").collect()}
    if {base, head} <= known:
        changes = history.diff_snapshots(members_at(stays, snapshots, base, head), base, head)
    elif ranges is not None:
        symbols = g.of(*SYMBOLS).select("label", "name", "file_path", "line_start", "line_end")
        touched = review.changed_symbols(symbols, ranges)
        changes = touched.select(F.lit("changed").alias("status"), "name", "file_path", F.lit(None).cast("string").alias("old_file")).distinct()
    else:
        raise ValueError(f"no snapshot {', '.join(sorted({base, head} - known))}, and no changed ranges to go by")
    new = changes.where("status IN ('added', 'changed')").select("name", "file_path")
    roots = g.of(*SYMBOLS).join(new, ["name", "file_path"], "left_semi").select("id")
    near, know = blast_radius(g, roots, depth), affected_knowledge(g, roots, depth)
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    files = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.filter(F.array("file_path", "old_file"), lambda f: f.isNotNull() & (f != ""))))))
    one = changes.agg(count("added"), count("removed"), count("moved"), count("changed"), files.alias("files"))
    reached = near.agg(F.count("*").alias("affected"), F.countDistinct(F.when(F.col("file_path") != "", F.col("file_path"))).alias("affected_files"))
    return changes, one.crossJoin(reached).crossJoin(know.agg(F.count("*").alias("affected_knowledge")))
