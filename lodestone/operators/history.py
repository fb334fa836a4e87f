"""History: snapshots of symbols, what became of a symbol, churn and coupling of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bigram_similarity_column
from ..plans.graph import SYMBOLS, Graph, settle
from .intelligence import like_pairs


def snapshot(g: Graph, ref: str, commit: str, committed_at: str) -> tuple[DataFrame, DataFrame]:
    """(snapshot row, member rows) of a graph's symbols; members are copied, so they outlive the nodes."""
    members = g.of(*SYMBOLS).select(F.lit(ref).alias("ref"), F.lit(committed_at).alias("committed_at"), "label", "name", "file_path")
    head = members.agg(F.count("*").alias("symbol_count")).select(F.lit(ref).alias("ref"), F.lit(commit).alias("commit_sha"), F.lit(committed_at).alias("committed_at"), "symbol_count")
    return head, members


def list_snapshots(members: DataFrame) -> DataFrame:
    return members.groupBy("ref", "committed_at").agg(F.count("*").alias("symbol_count")).orderBy("committed_at", "ref")


def symbols_at(members: DataFrame, ref: str) -> DataFrame:
    return members.where(F.col("ref") == ref).select("label", "name", "file_path").orderBy("file_path", "name")


def symbol_history(members: DataFrame, name: str | None = None, file_path: str = "") -> DataFrame:
    """(name, ref, committed_at, file_path, event): first_seen, moved, seen, and removed if the newest
    snapshot lacks the name.  Of several files in one snapshot the first counts."""
    refs = members.select("ref", "committed_at").distinct()
    rows = members.where(F.col("name") == name) if name is not None else members
    if file_path:
        rows = rows.where(F.col("file_path") == file_path)
    rows = rows.groupBy("name", "ref", "committed_at").agg(F.min("file_path").alias("file_path"))
    w = Window.partitionBy("name").orderBy("committed_at", "ref")
    before = F.lag("file_path").over(w)
    event = F.when(F.row_number().over(w) == 1, "first_seen").when(~before.eqNullSafe(F.col("file_path")), "moved").otherwise("seen")
    seen = rows.withColumn("event", event)
    newest = refs.agg(F.max(F.struct("committed_at", "ref")).alias("m")).select(F.col("m.ref").alias("last_ref"), F.col("m.committed_at").alias("last_at"))
    final = rows.groupBy("name").agg(F.max(F.struct("committed_at", "ref", "file_path")).alias("l"))
    gone = final.withColumn("k", F.lit(1)).join(F.broadcast(newest.withColumn("k", F.lit(1))), "k").where("l.ref <> last_ref")
    gone = gone.select("name", F.col("last_ref").alias("ref"), F.col("last_at").alias("committed_at"), "l.file_path", F.lit("removed").alias("event"))
    return seen.select("name", "ref", "committed_at", "file_path", "event").unionByName(gone)


def _may_be_alike(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(name, other): pairs of names that may have a likeness of ``least``, met by their rare bigrams."""
    a, b = (x.where("name IS NOT NULL").distinct() for x in (left, right))
    equal = a.select("name", F.lower("name").alias("k")).join(b.select(F.col("name").alias("other"), F.lower("name").alias("k")), "k").select("name", "other")
    return like_pairs(a, b, least).select(F.col("a").alias("name"), F.col("b").alias("other")).unionByName(equal).distinct()


def succession(members: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(at, name, file_path, to_name, to_file, event, score): what became of each symbol of snapshot ``at``, counted
    from 1 by time, in the next.  The same name and file (seen), else the same name in its first file (moved),
    else the most alike name of its file (renamed, likeness of ``threshold`` or more, the first of equals by
    name), else removed.  Only names that the next snapshot lacks are compared with others."""
    order = members.select("committed_at", "ref").distinct()
    order = order.withColumn("at", F.row_number().over(Window.orderBy("committed_at", "ref")))  # a row a snapshot
    here = settle(members.join(order, ["committed_at", "ref"]).select("at", "ref", "name", "file_path").distinct())
    newest = here.agg(F.max("at").alias("newest"))
    after = here.select((F.col("at") - 1).alias("at"), "name", "file_path")
    key = ["at", "name", "file_path"]
    old = here.join(F.broadcast(newest), F.col("at") < F.col("newest")).select(key)
    first = after.groupBy("at", "name").agg(F.min("file_path").alias("first_file"))
    known = old.join(first, ["at", "name"], "left").join(after.withColumn("still", F.lit(True)), key, "left")
    stays = F.col("still").isNotNull()
    same = known.where("first_file IS NOT NULL").select(
        *key, F.col("name").alias("to_name"), F.when(stays, F.col("file_path")).otherwise(F.col("first_file")).alias("to_file"),
        F.when(stays, "seen").otherwise("moved").alias("event"), F.lit(1.0).alias("score"),
    )
    gone = known.where("first_file IS NULL").select(key)
    pairs = settle(_may_be_alike(gone.select("name"), after.select("name"), threshold))
    others = after.withColumnRenamed("name", "other")
    alike = gone.join(pairs, "name").join(others, ["at", "file_path", "other"]).withColumn("score", bigram_similarity_column(F.col("name"), F.col("other"))).where(F.col("score") >= threshold)
    best = alike.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("less"), "other")).alias("b"))
    left = gone.join(best, key, "left").select(
        *key, F.coalesce("b.other", "name").alias("to_name"), F.col("file_path").alias("to_file"),
        F.when(F.col("b").isNull(), "removed").otherwise("renamed").alias("event"), F.coalesce(-F.col("b.less"), F.lit(0.0)).alias("score"),
    )
    return same.unionByName(left)


def lineage(members: DataFrame, starts: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(start_name, start_file, step, ref, name, file_path, event, score) of the given symbols.

    A symbol begins in the first snapshot that has its name and file, and is followed through ``succession``
    until it is removed.  Every symbol of a snapshot has one successor, so the walks are lengthened by joins
    that double what a jump spans: their number grows with the logarithm of the snapshots.
    """
    order = members.select("committed_at", "ref").distinct().withColumn("at", F.row_number().over(Window.orderBy("committed_at", "ref")))
    steps = settle(succession(members, threshold))
    placed = members.join(order, ["committed_at", "ref"]).groupBy("name", "file_path").agg(F.min("at").alias("begin"))
    start = starts.select("name", "file_path").distinct().join(placed, ["name", "file_path"])
    walk = settle(start.select(F.col("name").alias("start_name"), F.col("file_path").alias("start_file"), "begin", F.col("begin").alias("at"), "name", "file_path"))
    jump = steps.where("event <> 'removed'").select("at", "name", "file_path", (F.col("at") + 1).alias("to_at"), "to_name", "to_file")
    key, own = ["at", "name", "file_path"], ["start_name", "start_file", "begin"]
    target = [F.col("to_at").alias("at"), F.col("to_name").alias("name"), F.col("to_file").alias("file_path")]
    snapshots, span = order.count(), 1
    while span < snapshots:
        walk = settle(walk.unionByName(walk.join(jump, key).select(*own, *target)))
        span *= 2
        if span < snapshots:
            onward = jump.select(*target, F.col("at").alias("a"), F.col("name").alias("n"), F.col("file_path").alias("f"))
            jump = settle(onward.join(jump, key).select(F.col("a").alias("at"), F.col("n").alias("name"), F.col("f").alias("file_path"), "to_at", "to_name", "to_file"))
    first = walk.where("at = begin").select(*own, "at", "name", "file_path", F.lit("first_seen").alias("event"), F.lit(1.0).alias("score"))
    later = walk.join(steps, key).select(*own, (F.col("at") + 1).alias("at"), F.col("to_name").alias("name"), F.col("to_file").alias("file_path"), "event", "score")
    return first.unionByName(later).join(order, "at").select("start_name", "start_file", (F.col("at") - F.col("begin")).alias("step"), "ref", "name", "file_path", "event", "score")


def diff_snapshots(members: DataFrame, base: str, head: str) -> DataFrame:
    """(status, name, file_path, old_file): added and removed by (name, file); moved where a name has
    another file, which also counts as added and removed.  A name in several files counts by its last."""
    b = members.where(F.col("ref") == base).select("name", "file_path").distinct()
    h = members.where(F.col("ref") == head).select("name", "file_path").distinct()
    none = F.lit(None).cast("string").alias("old_file")
    added = h.join(b, ["name", "file_path"], "left_anti").select(F.lit("added").alias("status"), "name", "file_path", none)
    removed = b.join(h, ["name", "file_path"], "left_anti").select(F.lit("removed").alias("status"), "name", "file_path", none)
    old = b.groupBy("name").agg(F.max("file_path").alias("old_file"))
    new = h.groupBy("name").agg(F.max("file_path").alias("file_path"))
    moved = new.join(old, "name").where("file_path <> old_file").select(F.lit("moved").alias("status"), "name", "file_path", "old_file")
    return added.unionByName(removed).unionByName(moved)


def diff_file(old: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes of a file by (label, name, line_start): added, removed, modified or unchanged."""
    key = ["label", "name", "line_start"]
    o = old.select(*key, F.col("line_end").alias("old_end"), F.lit(True).alias("was"))
    n = new.select(*key, F.col("line_end").alias("new_end"), F.lit(True).alias("is"))
    both = o.join(n, key, "full_outer")
    status = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("old_end").eqNullSafe(F.col("new_end")), "unchanged").otherwise("modified")
    return both.select(*key, status.alias("status"))


def file_churn(commits: DataFrame, numstat: DataFrame | None = None) -> DataFrame:
    """Commits (repeats within one commit count) and changed lines of each file; binary files have none.
    ``commits`` has commit and file, ``numstat`` file, added, deleted."""
    n = commits.groupBy("file").agg(F.count("*").alias("commits"))
    if numstat is None:
        return n.withColumn("lines_changed", F.lit(0).cast("bigint")).orderBy(F.desc("commits"), "file")
    lines = numstat.groupBy("file").agg(F.sum(F.coalesce("added", F.lit(0)) + F.coalesce("deleted", F.lit(0))).alias("lines"))
    return n.join(lines, "file", "left").select("file", "commits", F.coalesce("lines", F.lit(0)).alias("lines_changed")).orderBy(F.desc("commits"), "file")


#: Files of a commit that meet those of another group in one key.
COMMIT_FILES = 256
#: Pairs of files that one task adds up.
TASK_PAIRS = 1 << 21


def coupling_pairs(commits: DataFrame, min_changes: int = 3, min_confidence: float = 0.5) -> DataFrame:
    """Files that change together: (file_a, file_b, co_changes, confidence) over distinct files of commits.

    Files with fewer than ``min_changes`` commits can't reach the bound and are left out first, so the
    self-join on the commit sees only what may count; confidence is co-changes over the larger count.  The
    files of a commit are dealt into groups of about ``COMMIT_FILES``, and groups meet pair by pair, so no
    bulk commit is one key of the join.  Most pairs occur once, so they are not added up where they are made but
    after a shuffle, over as many tasks as ``TASK_PAIRS`` asks for.
    """
    c = settle(commits.select("commit", "file").distinct(), "commits")
    n = c.groupBy("file").agg(F.count("*").alias("n"))
    c = c.join(n.where(F.col("n") >= min_changes), "file")
    made = c.groupBy("commit").agg(F.count("*").alias("m")).agg(F.sum(F.expr("m * (m - 1) div 2"))).first()[0]
    groups = c.groupBy("commit").agg(F.ceil(F.count("*") / COMMIT_FILES).alias("groups"))
    c = c.join(groups, "commit").withColumn("mine", F.pmod(F.xxhash64("file"), F.col("groups"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
    a = c.select("commit", F.col("mine").alias("x"), F.col("other").alias("y"), F.col("file").alias("file_a"), F.col("n").alias("na"))
    b = c.select("commit", F.col("other").alias("x"), F.col("mine").alias("y"), F.col("file").alias("file_b"), F.col("n").alias("nb"))
    met = a.join(b, ["commit", "x", "y"]).where("file_a < file_b").select("file_a", "file_b", "na", "nb")
    co = met.repartition((made or 0) // TASK_PAIRS + 1, "file_a", "file_b").groupBy("file_a", "file_b", "na", "nb").agg(F.count("*").alias("co_changes"))
    confidence = F.col("co_changes") / F.greatest("na", "nb")
    return co.where((F.col("co_changes") >= min_changes) & (confidence >= min_confidence)).select("file_a", "file_b", "co_changes", F.round(confidence, 4).alias("confidence"))


def store_churn(g: Graph, churn: DataFrame, pairs: DataFrame) -> Graph:
    """The graph with churn columns on files (matched by path) and COUPLED_WITH edges."""
    c = churn.select(F.col("file").alias("path"), F.col("commits").alias("churn_score"), "lines_changed")
    nodes = g.nodes.join(c, "path", "left")
    f = g.of("File").select("id", "path")
    e = pairs.join(f.select(F.col("id").alias("src"), F.col("path").alias("file_a")), "file_a").join(f.select(F.col("id").alias("dst"), F.col("path").alias("file_b")), "file_b")
    return Graph(nodes, g.edges.select("src", "dst", "type").unionByName(e.select("src", "dst", F.lit("COUPLED_WITH").alias("type"))).distinct())


