"""Versioned tables in shared storage: a version is there once its marker is, and a marker is made only once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Taken(Exception):
    """Someone else has made the version already."""


class Versions:
    """Versions 0, 1, ... of a table below a folder, each with a marker file beside it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = lambda p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        self._files = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, version: int) -> str:
        return f"{self.folder}/v{version:012d}"

    def latest(self, before: int | None = None) -> int | None:
        """The last version that is there, or the last before another."""
        top = self._path(self.folder)
        if not self._files.exists(top):
            return None
        names = [s.getPath().getName() for s in self._files.listStatus(top)]
        found = [int(n[1:-5]) for n in names if n.endswith(".done")]
        return max((n for n in found if before is None or n < before), default=None)

    def has(self, version: int) -> bool:
        return self._files.exists(self._path(f"{self.at(version)}.done"))

    def read(self, version: int) -> DataFrame:
        return self.spark.read.parquet(self.at(version))

    def write(self, df: DataFrame, version: int) -> None:
        """Make a version; what an attempt without a marker left is written over.  Of two that make it at once
        one makes the marker, and the other gets ``Taken``."""
        if self.has(version):
            raise Taken(self.at(version))
        own = f"{self.at(version)}"
        df.write.mode("overwrite").parquet(own)
        self.mark(version)

    def mark(self, version: int) -> None:
        if not self._files.createNewFile(self._path(f"{self.at(version)}.done")):
            raise Taken(self.at(version))
