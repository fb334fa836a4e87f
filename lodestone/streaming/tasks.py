"""A task queue as a stateful operator: first in, first out, with transition rules and leases.

A queue's actions come in order and change its state, which lives in Spark's state store; on a table
the same processor runs over all rows at once.  Queues are independent, so they are the key that work is dealt by.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

# The states of a task.
PENDING, IN_PROGRESS, DONE, FAILED = "pending", "in_progress", "done", "failed"
#: Actions: (queue, seq, action, task, agent, detail, at in milliseconds); a claim names no task.
ACTIONS = "queue string, seq long, action string, task string, agent string, detail string, at long"
#: What becomes of them; ``reason`` says why an action was refused.
CHANGES = "queue string, seq long, action string, task string, agent string, detail string, was string, status string, accepted boolean, reason string, at long, pending long"
_OUT = [c.split()[0] for c in CHANGES.split(", ")]


class Queue(StatefulProcessor):
    """Applies actions to a queue.

    ``enqueue`` puts a new task behind the others, ``claim`` gives the first pending one to an agent, ``complete``
    and ``fail`` end one that is in progress.  A task enqueued twice, a claim of an empty queue, an unknown
    task and a move that isn't one of these are refused and change nothing; so does an action whose ``seq``
    isn't beyond the last one seen, as a replay brings.  A claim that isn't ended within ``lease``
    milliseconds, by the actions' own times, puts its task behind the others again.
    """

    def __init__(self, lease: int | None):
        self.lease = lease

    def init(self, handle) -> None:
        self.ends = handle.getValueState("ends", "head long, tail long, waiting long, seen long")
        self.line = handle.getMapState("line", "place long", "task string")
        self.tasks = handle.getMapState("tasks", "task string", "status string, agent string, until long")
        self.leases = handle.getMapState("leases", "task string", "until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows)).sort_values("seq", kind="stable")  # a batch's actions of one queue
        head, tail, waiting, seen = self.ends.get() if self.ends.exists() else (0, 0, 0, -1)
        held = {k[0]: v[0] for k, v in self.leases.iterator()} if self.lease else {}
        out = []

        def push(task: str, at: int) -> None:
            nonlocal tail, waiting
            self.line.updateValue((tail,), (task,))
            self.tasks.updateValue((task,), (PENDING, None, None))
            tail, waiting = tail + 1, waiting + 1

        def tell(seq, action, task, agent, detail, was, status, ok, reason, at) -> None:
            out.append((key[0], seq, action, task, agent, detail, was, status, ok, reason, at, waiting))

        for r in table.itertuples(index=False):
            seq, at = int(r.seq), int(r.at)
            if seq <= seen:
                continue
            seen = seq
            for task in sorted((t for t, until in held.items() if until <= at), key=lambda t: (held[t], t)):
                agent = self.tasks.getValue((task,))[1]
                del held[task]
                self.leases.removeKey((task,))
                push(task, at)
                tell(seq, "expire", task, agent, None, IN_PROGRESS, PENDING, True, None, at)
            task = r.task if isinstance(r.task, str) else None
            agent = r.agent if isinstance(r.agent, str) else None
            detail = r.detail if isinstance(r.detail, str) else None
            now = self.tasks.getValue((task,))[0] if task is not None and self.tasks.containsKey((task,)) else None
            if r.action == "enqueue" and task is not None and now is None:
                push(task, at)
                tell(seq, r.action, task, agent, detail, None, PENDING, True, None, at)
            elif r.action == "claim" and waiting:
                task = self.line.getValue((head,))[0]
                self.line.removeKey((head,))
                head, waiting = head + 1, waiting - 1
                until = at + self.lease if self.lease else None
                self.tasks.updateValue((task,), (IN_PROGRESS, agent, until))
                if self.lease:
                    held[task] = until
                    self.leases.updateValue((task,), (until,))
                tell(seq, r.action, task, agent, detail, PENDING, IN_PROGRESS, True, None, at)
            elif r.action in ("complete", "fail") and now == IN_PROGRESS:
                status = DONE if r.action == "complete" else FAILED
                owner = self.tasks.getValue((task,))[1]
                self.tasks.updateValue((task,), (status, owner, None))
                if held.pop(task, None) is not None:
                    self.leases.removeKey((task,))
                tell(seq, r.action, task, owner, detail, IN_PROGRESS, status, True, None, at)
            else:
                reason = "known task" if r.action == "enqueue" and now else "empty queue" if r.action == "claim" else "unknown task" if r.action in ("complete", "fail") and now is None else "not in progress" if r.action in ("complete", "fail") else "unknown action"
                tell(seq, r.action, task, agent, detail, now, now, False, reason, at)
        self.ends.update((head, tail, waiting, seen))
        if out:
            frame = pd.DataFrame(out, columns=_OUT)
            yield frame.astype({c: object for c in ("task", "agent", "detail", "was", "status", "reason")}).where(frame.notna(), None)

    def close(self) -> None:
        pass


def task_changes(actions: DataFrame, lease: int | None = None) -> DataFrame:
    """(CHANGES) of the ACTIONS of a stream or a table: what each did, the leases that ran out before it
    (action ``expire``), and how many tasks were pending after it.

    Of a stream the state lasts from batch to batch, and a batch that is replayed finds its state as it was.
    Rows with a null queue or seq are left out.  The session's state store has to be RocksDB
    (``spark.sql.streaming.stateStore.providerClass``), as for every stateful processor.
    """
    if not actions.isStreaming:
        _ = actions.sparkSession.streams.active  # starts what state stores are registered with
    columns = [F.col(c.split()[0]).cast(c.split()[1]) for c in ACTIONS.split(", ")]
    known = actions.select(*columns).where("queue IS NOT NULL AND seq IS NOT NULL").withColumn("at", F.coalesce("at", F.lit(0)))
    return known.groupBy("queue").transformWithStateInPandas(Queue(lease), CHANGES, "Append", "none")


def queue_metrics(changes: DataFrame) -> DataFrame:
    """(queue, pending, claimed, done, failed, expired, refused) from the changes of a table."""
    count = lambda test: F.count_if(F.expr(test))
    return changes.groupBy("queue").agg(
        F.max_by("pending", F.struct("seq", (F.col("action") != "expire").alias("own"))).alias("pending"),
        count("accepted AND action = 'claim'").alias("claimed"),
        count("accepted AND action = 'complete'").alias("done"),
        count("accepted AND action = 'fail'").alias("failed"),
        count("action = 'expire'").alias("expired"),
        count("NOT accepted").alias("refused"),
    )
