"""A stored index of vectors by cells of sign bits, probed best cell first.

The planes are orthonormal, so how far a query lies from a plane says how near a vector beyond it can be: a cell
across some planes holds no vector whose cosine is above a bound, and cells whose bound is below the k-th best
cosine so far need not be read.  Read to that end the result is that of a scan; read up to a number of cells
it is near it.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vector import cosine

#: Vectors of a cell, on average, and bits of a cell's number at most: so many cells have a folder each.
CELL_ROWS, MOST_BITS = 20_000, 12
#: Share of the cells that an approximate search reads, best first.
SHARE = 0.25


def planes(bits: int, dim: int) -> np.ndarray:
    """Orthonormal planes, fixed for their number and dimension."""
    rows = np.random.default_rng([bits, dim]).standard_normal((dim, bits))
    return np.linalg.qr(rows)[0].T.copy() if bits else np.zeros((0, dim))


@dataclass(frozen=True)
class VectorIndex:
    """Vectors (id, embedding) by cell, below a path."""

    spark: SparkSession
    path: str
    bits: int
    dim: int

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/cells")

    def cells(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell numbers, most cosine that a vector of each can have with the query), best first."""
        n = float(np.sqrt((query**2).sum()))
        across = planes(self.bits, self.dim) @ (query / n if n else query)
        number = np.arange(1 << self.bits)
        own = int((1 << np.arange(self.bits)) @ (across > 0)) if self.bits else 0
        apart = ((number ^ own)[:, None] >> np.arange(self.bits)) & 1
        bound = 1 - (apart * across**2).sum(axis=1) / 2  # unit vectors across these planes lie at least so far apart
        order = np.lexsort((number, -bound))
        return number[order], bound[order]

    def _best(self, cells: list[int], query: np.ndarray, k: int) -> list[tuple[float, int]]:
        score = cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query]))
        found = self.rows.where(F.col("cell").isin(cells)).select("id", score.alias("score"))
        return [(r.score, r.id) for r in found.orderBy(F.desc("score"), "id").limit(k).collect()]

    def search(self, query: list[float], k: int = 10, exact: bool = False, share: float = SHARE) -> DataFrame:
        """(id, score) of the k vectors nearest by cosine; of equal ones the least ids.

        ``exact`` reads cells until none left can hold a better vector, which is a scan of all of them where the
        data have no shape; otherwise the best ``share`` of the cells is read, and more only while fewer than k
        vectors have been found.  Folders of other cells are not opened.
        """
        q = np.array(query, float)
        if len(q) != self.dim:
            raise ValueError(f"the index holds vectors of {self.dim} components")
        number, bound = self.cells(q)
        take = max(1, math.ceil(share * len(number)))
        best: list[tuple[float, int]] = []
        at = 0
        while at < len(number):
            some = number[at : at + take].tolist()
            best = sorted(best + self._best(some, q, k), key=lambda r: (-r[0], r[1]))[:k]
            at += take
            if len(best) == k and (not exact or at >= len(number) or bound[at] < best[-1][0] - 1e-9):
                break
            take = max(1, int((bound[at:] >= best[-1][0] - 1e-9).sum())) if len(best) == k else 2 * take
        return self.spark.createDataFrame([(i, s) for s, i in best], "id long, score double")

    def search_many(self, queries: DataFrame, k: int = 10, share: float = SHARE, query_col: str = "query") -> DataFrame:
        """(query, id, score): the k nearest of the best ``share`` of cells for each row (query, embedding) of a
        table.  Queries meet vectors by an equality join on the cell."""
        take = max(1, math.ceil(share * (1 << self.bits)))
        bits, dim = self.bits, self.dim

        @F.pandas_udf("array<int>")
        def probed(vectors: pd.Series) -> pd.Series:
            return pd.Series([index_cells(bits, dim, np.asarray(v, float))[:take].tolist() for v in vectors])

        rows = queries.select(F.col(query_col).alias("query"), F.col("embedding").alias("__q"))
        asked = rows.withColumn("cell", F.explode(probed("__q")))
        met = asked.join(self.rows, "cell").select("query", "id", cosine(F.col("embedding"), F.col("__q")).alias("score"))
        nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
        return met.withColumn("n", nth).where(F.col("n") <= k).drop("n")


def index_cells(bits: int, dim: int, query: np.ndarray) -> np.ndarray:
    """The cells of an index for a query, best first."""
    return VectorIndex(None, "", bits, dim).cells(query)[0]


def build(vectors: DataFrame, path: str, id_col: str = "id", vector_col: str = "embedding", cell_rows: int = CELL_ROWS) -> VectorIndex:
    """Write an index of ``vectors`` below ``path``, in cells of about ``cell_rows``, and open it.

    Vectors that are null, of no length, or of another dimension than the first have no place in it.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("embedding")).where("embedding IS NOT NULL AND size(embedding) > 0")
    n, dim = rows.agg(F.count("*"), F.min_by(F.size("embedding"), "id")).first()
    dim = dim or 0
    bits = min(MOST_BITS, dim, max(0, math.ceil(math.log2(max(n, 1) / cell_rows)))) if n > cell_rows else 0

    @F.pandas_udf("int")
    def cell(some: pd.Series) -> pd.Series:
        x = np.stack([np.asarray(e, float) for e in some])
        return pd.Series((x @ planes(bits, dim).T > 0) @ (1 << np.arange(bits)) if bits else np.zeros(len(x), int)).astype("int32")

    placed = rows.where((F.size("embedding") == dim) & ~F.exists("embedding", lambda e: e.isNull() | F.isnan(e))).withColumn("cell", cell("embedding"))
    # a cell's rows go to as few files as its size asks for; the salt keeps a crowded cell from being one task's work
    placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
    spark.createDataFrame([(json.dumps({"bits": bits, "dim": dim}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/shape")
    return VectorIndex(spark, path, bits, dim)


def load(spark: SparkSession, path: str) -> VectorIndex:
    shape = json.loads(spark.read.text(f"{path}/shape").first()[0])
    return VectorIndex(spark, path, shape["bits"], shape["dim"])
