"""Distributed connected components by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joinable, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node reachable.

    Each round every vertex moves to the neighbour (or itself) with the least salted hash, the
    graph contracts along those moves, and loops and parallel edges vanish; a constant share of the
    vertices goes per round whatever the shape (chains, stars), so rounds grow with the logarithm of
    the size.  Hubs are safe: the minimum is pre-aggregated map-side and the joins are plain
    equi-joins of stored tables that adaptive execution can split.  Moves are broadcast in the last rounds
    alone, when few are left.  Rows with a null end are ignored; an empty input
    gives an empty result.
    """
    ends = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    ends = ends.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    live = materialize(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    moves: list[tuple[DataFrame, int]] = []
    seed = 0
    while most := 2 * live.count():  # ends that edges have at most, and so moves
        seed += 1
        rank = lambda c, s=seed: F.struct(F.xxhash64(F.col(c), F.lit(s)).alias("h"), F.col(c).alias("v"))
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        move = materialize(best.select(F.col("a").alias("v"), F.least(rank("a"), F.col("m"))["v"].alias("r")), "moves")
        moves.append((move, most))
        left = live.join(joinable(move.select(F.col("v").alias("a"), F.col("r").alias("ra")), most), "a")
        full = left.join(joinable(move.select(F.col("v").alias("b"), F.col("r").alias("rb")), most), "b").where("ra <> rb")
        live = materialize(full.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    if not moves:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    first, most = moves[0]
    label = first.select(F.col("v").alias("node"), "r")
    for move, n in moves[1:]:
        hop = move.select(F.col("v").alias("r"), F.col("r").alias("r2"))
        label = label.join(joinable(hop, n), "r", "left").select("node", F.coalesce("r2", "r").alias("r"))
    label = materialize(label, "labels")
    least = materialize(label.groupBy("r").agg(F.min("node").alias("component")), "least")
    return label.join(joinable(least, most), "r").select("node", "component")
