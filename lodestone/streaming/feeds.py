"""Event feeds, task states, messages, heartbeats, three-way sync.

Functions that take a DataFrame work on a stream as on a table unless they say otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# The kinds of change events.
EVENT_TYPES = ("node_created", "node_updated", "node_deleted", "edge_created", "edge_updated", "edge_deleted", "graph_cleared", "snapshot_pushed")


def subscribe(events: DataFrame, *kinds: str) -> DataFrame:
    return events.where(F.col("event_type").isin(*kinds))


def deliver(events: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Hand batches of a stream to a function; ``once`` stops when the source is read through."""
    writer = events.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()


def watch(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """A stream of the files that come into a folder: (path, modificationTime, length, content)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").schema(schema).load(folder)


def latest_status(changes: DataFrame) -> DataFrame:
    """(id, status, updated_at): each task's newest status; of equal times the greatest status."""
    last = changes.groupBy("id").agg(F.max(F.struct("updated_at", "status")).alias("m"))
    return last.select("id", "m.status", "m.updated_at")


def status_counts(changes: DataFrame) -> DataFrame:
    return latest_status(changes).groupBy("status").agg(F.count("*").alias("n"))


def next_tasks(changes: DataFrame, n: int) -> DataFrame:
    """The first pending tasks in order of arrival."""
    first = changes.groupBy("id").agg(F.min("updated_at").alias("created_at"))
    pending = latest_status(changes).where("status = 'pending'").select("id")
    return first.join(pending, "id").orderBy("created_at", "id").limit(n)


def unacknowledged(messages: DataFrame, acks: DataFrame, agent: str | None = None, limit: int | None = None, limit_first: bool = False) -> DataFrame:
    """Messages (id, to_agent, timestamp, ...) without an acknowledgement (id, agent).

    ``limit_first`` takes the first ``limit`` messages of an agent and then drops acknowledged ones, as a
    log with a fixed window does; otherwise the limit counts what is left.
    """
    rows = messages.where(F.col("to_agent") == agent) if agent else messages
    done = acks.select("id", F.col("agent").alias("to_agent")).distinct()
    if limit and limit_first:
        first = F.row_number().over(Window.partitionBy("to_agent").orderBy("timestamp", "id"))
        return rows.withColumn("__n", first).where(F.col("__n") <= limit).drop("__n").join(done, ["id", "to_agent"], "left_anti")
    left = rows.join(done, ["id", "to_agent"], "left_anti")
    if not limit:
        return left
    n = F.row_number().over(Window.partitionBy("to_agent").orderBy("timestamp", "id"))
    return left.withColumn("__n", n).where(F.col("__n") <= limit).drop("__n")


def broadcast_messages(messages: DataFrame, agents: DataFrame) -> DataFrame:
    """One copy for each agent but the sender."""
    return messages.crossJoin(agents.select(F.col("agent").alias("to_agent")).distinct()).where("from_agent <> to_agent")


def alive(beats: DataFrame, now: str, seconds: int = 90) -> DataFrame:
    """(agent, last_seen, is_alive) at a moment: whether the newest beat is younger than its time to live."""
    last = beats.groupBy("agent").agg(F.max("ts").alias("last_seen"))
    return last.withColumn("is_alive", F.col("last_seen") > F.to_timestamp(F.lit(now)) - F.expr(f"INTERVAL {seconds} SECONDS"))


def session_graph(repo: str, branch: str) -> str:
    """The graph's name of a working session: the first 12 digits of a SHA-1."""
    import hashlib

    return "session_" + hashlib.sha1(f"{repo}:{branch}".encode()).hexdigest()[:12]


def sync_plan(a: DataFrame, b: DataFrame, cursor: DataFrame) -> DataFrame:
    """(page, action) from the hashes of two sides (page, hash) and those of the last sync (page, a_hash,
    b_hash): copy towards the side that didn't change, conflict where both did, first_sync where
    neither side was seen before and they differ."""
    both = a.select("page", F.col("hash").alias("ha")).join(b.select("page", F.col("hash").alias("hb")), "page", "full_outer").join(cursor.select("page", "a_hash", "b_hash"), "page", "full_outer")
    new = F.col("a_hash").isNull() & F.col("b_hash").isNull()
    ca, cb = ~F.col("ha").eqNullSafe(F.col("a_hash")), ~F.col("hb").eqNullSafe(F.col("b_hash"))
    action = (
        F.when(F.col("ha").isNull() & F.col("hb").isNull(), "gone")
        .when(F.col("ha").eqNullSafe(F.col("hb")), "in_sync")
        .when(new & F.col("hb").isNull(), "a_to_b")
        .when(new & F.col("ha").isNull(), "b_to_a")
        .when(new, "first_sync_conflict")
        .when(ca & cb, "conflict")
        .when(ca, "a_to_b")
        .when(cb, "b_to_a")
        .otherwise("in_sync")
    )
    return both.select("page", action.alias("action"))


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events by type in tumbling or sliding windows; on a stream, later ones than ``late`` are dropped."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")
