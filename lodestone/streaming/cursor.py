"""Two-sided sync with a cursor: what was last seen on both sides, in versions that only one can make."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .feeds import sync_plan
from .versions import Versions

_CURSOR = "page string, a_hash string, b_hash string"


class Cursor:
    """The hashes of the pages of two sides at their last sync, as versions below a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.versions = spark, Versions(spark, folder)

    def read(self) -> tuple[int, DataFrame]:
        """(version, rows); -1 and none before the first sync."""
        last = self.versions.latest()
        return (-1, self.spark.createDataFrame([], _CURSOR)) if last is None else (last, self.versions.read(last))

    def plan(self, a: DataFrame, b: DataFrame) -> tuple[int, DataFrame]:
        """(version read, (page, action)) of two sides (page, hash)."""
        version, rows = self.read()
        return version, sync_plan(a, b, rows)

    def advance(self, version: int, a: DataFrame, b: DataFrame, plan: DataFrame) -> int:
        """Note that a plan has been carried out; the new version.

        Pages copied or equal on both sides get the hash they now share, conflicts keep what the cursor had
        of them, and pages gone from both sides leave it.  If another sync has moved the cursor on since
        ``version`` was read, nothing is written and ``Taken`` is raised.
        """
        _, old = self.read() if version < 0 else (version, self.versions.read(version))
        if version < 0:
            old = old.limit(0)
        sides = plan.join(a.select("page", F.col("hash").alias("ha")), "page", "left").join(b.select("page", F.col("hash").alias("hb")), "page", "left").join(old, "page", "left")
        shared = F.when(F.col("action") == "b_to_a", F.col("hb")).otherwise(F.col("ha"))
        stay = F.col("action").isin("conflict", "first_sync_conflict")
        new = sides.where("action <> 'gone'").select("page", F.when(stay, F.col("a_hash")).otherwise(shared).alias("a_hash"), F.when(stay, F.col("b_hash")).otherwise(shared).alias("b_hash"))
        self.versions.write(new.where("a_hash IS NOT NULL OR b_hash IS NOT NULL"), version + 1)
        return version + 1
