"""A graph that is kept up with a source tree: changed files are parsed again and replace what they gave before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.graph import Graph
from ..sources.code import ROWS, assemble, parse_files, walk
from .versions import Versions

_FILES = "source string, hash string, version long"


class Watched:
    """The graph of a tree below ``root``, kept in ``store``, a folder that the driver and executors share.

    Each round parses the files that are new or changed and writes their rows once, under the round's number;
    a manifest names for every file there is the round whose rows are its own.  So a file that is gone, or has
    changed, takes its rows with it, and nothing that didn't change is written again.  A round that is there
    already changes nothing: a stream may replay its batches.
    """

    def __init__(self, spark: SparkSession, root: str, store: str, repo: str = "", exclude: tuple[str, ...] = ()):
        self.spark, self.root, self.store, self.repo, self.exclude = spark, root, store.rstrip("/"), repo, exclude
        self.manifest = Versions(spark, f"{self.store}/manifest")

    def _rows_at(self, version: int) -> str:
        return f"{self.store}/rows/version={version}"

    def _known(self, before: int | None = None) -> DataFrame:
        last = self.manifest.latest(before)
        return self.spark.createDataFrame([], _FILES) if last is None else self.manifest.read(last)

    def round(self, number: int) -> dict[str, int]:
        """Bring the graph up to the tree as it is; (changed, removed) counts, none where the round is there."""
        if self.manifest.has(number):
            return {"changed": 0, "removed": 0}
        known = self._known(number)
        files = walk(self.spark, self.root, self.exclude).withColumn("hash", F.sha2("content", 256))
        now = files.select(F.col("path").alias("source"), "hash")
        changed = files.join(known.select(F.col("source").alias("path"), "hash"), ["path", "hash"], "left_anti")
        rows = parse_files(changed.select("path", "content"))
        # the hash is taken of the content that is parsed, in the same task: a file that changes meanwhile is met next round
        rows.write.mode("overwrite").parquet(self._rows_at(number))
        fresh = self.spark.read.schema(ROWS).parquet(self._rows_at(number)).where("content_hash IS NOT NULL").select("source", F.col("content_hash").alias("hash"), F.lit(number).cast("long").alias("version")).distinct()
        kept = known.join(now, ["source", "hash"], "left_semi").join(fresh.select("source"), "source", "left_anti")
        unparsed = now.join(known.select("source", "hash"), ["source", "hash"], "left_anti").join(fresh.select("source"), "source", "left_anti").withColumn("version", F.lit(number).cast("long"))
        self.manifest.write(kept.unionByName(fresh).unionByName(unparsed), number)
        after = self.manifest.read(number)
        removed = known.join(after.select("source"), "source", "left_anti").count()
        return {"changed": after.where(F.col("version") == number).count(), "removed": removed}

    def rows(self) -> DataFrame:
        """The rows of all files as they were at the last round: only the rounds that some file still needs are read."""
        files = self._known().select("source", "version")
        used = [r.version for r in files.select("version").distinct().collect()]  # one number a round
        if not used:
            return self.spark.createDataFrame([], f"{ROWS}, version long")
        held = self.spark.read.schema(f"{ROWS}, version long").option("basePath", f"{self.store}/rows").parquet(*[self._rows_at(v) for v in used])
        return held.join(files, ["source", "version"], "left_semi")

    def graph(self) -> Graph:
        return assemble(self.rows(), self.repo)[0]

    def follow(self, checkpoint: str, every: str = "2 seconds") -> StreamingQuery:
        """Rounds by a clock, numbered by its batches, until the query is stopped."""
        clock = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        writer = clock.writeStream.foreachBatch(lambda _, number: self.round(number))
        return writer.option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
