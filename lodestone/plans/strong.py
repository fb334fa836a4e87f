"""Strongly connected components by contraction, trimming, colours and backward reach; all steps are joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import settle


def _relabel(edges: DataFrame, moved: DataFrame) -> DataFrame:
    """Edges between what their ends (v) have moved to (rep)."""
    for side in "ab":
        to = moved.select(F.col("v").alias(side), F.col("rep").alias(f"to_{side}"))
        edges = edges.join(to, side, "left").withColumn(side, F.coalesce(f"to_{side}", side)).drop(f"to_{side}")
    return edges.select("a", "b")


def _chains(edges: DataFrame) -> DataFrame:
    """(v, rep, inner, ring) of nodes on chains: edges that are the only one out of their beginning and into their end lie on
    the same cycles, so a chain moves to its first node, a ring to its least.  All but a chain's
    first are ``inner``: their one way in is the chain's.  Jumps double, so a chain of n edges takes log n joins."""
    out = edges.groupBy("a").agg(F.min("b").alias("b"), F.count("*").alias("n")).where("n = 1").select("a", "b")
    into = edges.groupBy("b").agg(F.count("*").alias("n")).where("n = 1").select("b")
    link = settle(out.join(into, "b", "left_semi").select(F.col("b").alias("v"), F.col("a").alias("p")))
    heads = link.select(F.col("p").alias("v")).distinct().join(link.select("v"), "v", "left_anti")
    left = link.count()
    at = link.select("v", "p", F.least("v", "p").alias("least")).unionByName(heads.select("v", F.col("v").alias("p"), F.col("v").alias("least")))
    at = settle(at)
    span = 1
    while span <= left:
        hop = at.select(F.col("v").alias("p"), F.col("p").alias("p2"), F.col("least").alias("least2"))
        at = settle(at.join(hop, "p").select("v", F.col("p2").alias("p"), F.least("least", "least2").alias("least")))
        span *= 2
    ends = heads.select(F.col("v").alias("p"), F.lit(True).alias("head"))
    ring = F.col("head").isNull()
    return at.join(ends, "p", "left").select("v", F.when(ring, F.col("least")).otherwise(F.col("p")).alias("rep"), (ring | (F.col("v") != F.col("p"))).alias("inner"), ring.alias("ring"))


def _trim(edges: DataFrame, n: int) -> tuple[DataFrame, int]:
    """The edges left once nodes without a way in or out are gone, and their number."""
    while n:
        kept = edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        edges = settle(kept.select("a", "b"))
        m = edges.count()
        if m == n:
            break
        n = m
    return edges, n


def _colours(edges: DataFrame) -> DataFrame:
    """(v, colour): the least node that reaches each node."""
    colour = settle(edges.select(F.col("a").alias("v")).union(edges.select("b")).distinct().select("v", F.col("v").alias("colour"), F.lit(True).alias("new")))
    while True:
        sent = colour.where("new").join(edges, F.col("v") == F.col("a")).groupBy("b").agg(F.min("colour").alias("sent")).withColumnRenamed("b", "v")
        better = F.coalesce(F.col("sent") < F.col("colour"), F.lit(False))
        colour = settle(colour.join(sent, "v", "left").select("v", F.when(better, F.col("sent")).otherwise(F.col("colour")).alias("colour"), better.alias("new")))
        if colour.where("new").isEmpty():
            return colour.select("v", "colour")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of (a, b) that lies on a cycle of two nodes or more; component is the least
    node of those that reach each other.

    Chains and rings are contracted, what hangs off cycles is trimmed, then every node takes the least node
    that reaches it as its colour, and what reaches a colour's first node within the colour is its
    component; the rest goes round again with the edges inside colours.  Nothing is collected; the rounds go
    with the width of what is left after contraction, not with the length of chains.
    """
    live = settle(edges.where("a <> b AND a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct())
    whole, n = live, live.count()
    moves: list[DataFrame] = []
    found: list[DataFrame] = []
    while n:
        moved = settle(_chains(live))
        moves.append(moved.select("v", "rep"))
        between = live.join(moved.where("inner").select(F.col("v").alias("b")), "b", "left_anti")
        raw = settle(_relabel(between, moved).distinct())
        closed = raw.where("a = b").select(F.col("a").alias("node")).unionByName(moved.where("ring").select(F.col("rep").alias("node")))
        found.append(closed.distinct().select("node", F.col("node").alias("component")))  # chains that close on themselves
        live = settle(raw.where("a <> b"))
        live, n = _trim(live, live.count())
        if not n:
            break
        colour = _colours(live)
        inside = live.join(colour.select(F.col("v").alias("a"), F.col("colour").alias("ca")), "a").join(colour.select(F.col("v").alias("b"), F.col("colour").alias("cb")), "b").where("ca = cb")
        inside = settle(inside.select("a", "b", F.col("ca").alias("colour")))
        got = front = colour.where("v = colour")
        parts = [settle(got)]
        while not front.isEmpty():
            front = inside.join(front.select(F.col("v").alias("b")), "b").select(F.col("a").alias("v"), "colour").distinct()
            for p in parts:
                front = front.join(p.select("v"), "v", "left_anti")
            front = settle(front)
            parts.append(front)
        got = parts[0]
        for p in parts[1:]:
            got = got.unionByName(p)
        several = got.groupBy("colour").count().where("count > 1").select("colour")
        found.append(settle(got.join(several, "colour", "left_semi").select(F.col("v").alias("node"), F.col("colour").alias("component"))))
        rest = inside.select("a", "b")
        for side in "ab":
            rest = rest.join(got.select(F.col("v").alias(side)), side, "left_anti")
        live = settle(rest.select("a", "b"))
        n = live.count()
    nodes = whole.select(F.col("a").alias("node")).union(whole.select("b")).distinct()
    if not found:
        return nodes.select("node", F.col("node").alias("component")).limit(0)
    # a node is in the component of what it had moved to when that was found
    at, member = nodes.select("node", F.col("node").alias("rep")), None
    round_ = 0
    for k, part in enumerate(found):
        if k % 2 == 0:  # a contraction, then what closes on itself; colours come after it
            at = at.join(moves[round_].withColumnRenamed("rep", "to").withColumnRenamed("v", "rep"), "rep", "left").select("node", F.coalesce("to", "rep").alias("rep"))
            round_ += 1
        here = at.join(part.withColumnRenamed("node", "rep"), "rep").select("node", F.lit(k).alias("k"), "component")
        member = here if member is None else member.unionByName(here)
    last = member.groupBy("node").agg(F.max_by("component", "k").alias("label"), F.max("k").alias("k"))
    last = settle(last)  # a later find holds the earlier ones it was made of
    least = last.groupBy("k", "label").agg(F.min("node").alias("component"), F.count("*").alias("n")).where("n > 1")
    return last.join(least, ["k", "label"]).select("node", "component")
