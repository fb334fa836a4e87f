"""The task queue against a plain one, on a table and on a stream."""

import random

import pytest

from lodestone.streaming import tasks

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(autouse=True)
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield
    spark.conf.set(key, before)


def plain(actions, lease):
    out, queues = [], {}
    for queue, seq, action, task, agent, detail, at in sorted(actions, key=lambda a: (a[0], a[1])):
        line, state, until = queues.setdefault(queue, ([], {}, {}))
        for t in sorted((t for t, u in until.items() if u <= at), key=lambda t: (until[t], t)):
            del until[t]
            line.append(t)
            out.append((queue, seq, "expire", t, state[t][1], "in_progress", "pending", True, len(line)))
            state[t] = ("pending", None)
        now = state.get(task, (None, None))[0]
        if action == "enqueue" and now is None:
            line.append(task)
            state[task] = ("pending", None)
            out.append((queue, seq, action, task, agent, None, "pending", True, len(line)))
        elif action == "claim" and line:
            t = line.pop(0)
            state[t] = ("in_progress", agent)
            if lease:
                until[t] = at + lease
            out.append((queue, seq, action, t, agent, "pending", "in_progress", True, len(line)))
        elif action in ("complete", "fail") and now == "in_progress":
            end = "done" if action == "complete" else "failed"
            until.pop(task, None)
            out.append((queue, seq, action, task, state[task][1], now, end, True, len(line)))
            state[task] = (end, state[task][1])
        else:
            out.append((queue, seq, action, task, agent, now, now, False, len(line)))
    return sorted(out, key=repr)


def some_actions(seed, n=160):
    rnd = random.Random(seed)
    out = []
    for seq in range(n):
        action = rnd.choice(["enqueue", "enqueue", "claim", "claim", "complete", "fail", "nonsense"] if rnd.random() < 0.9 else ["complete"])
        task = None if action == "claim" else f"t{rnd.randrange(30)}"
        out.append((rnd.choice("ab"), seq, action, task, rnd.choice(["x", "y", None]), None, seq * 10))
    return out


def rows(df):
    return sorted(((r.queue, r.seq, r.action, r.task, r.agent, r.was, r.status, r.accepted, r.pending) for r in df.collect()), key=repr)


@pytest.mark.parametrize("lease", [None, 120])
def test_table_equals_a_plain_queue(spark, lease):
    actions = some_actions(3)
    df = spark.createDataFrame(actions, tasks.ACTIONS).repartition(5)
    changes = tasks.task_changes(df, lease)
    want = plain(actions, lease)
    assert rows(changes) == want
    refused = {r.reason for r in changes.where("NOT accepted").collect()}
    assert refused == {"known task", "empty queue", "unknown task", "not in progress", "unknown action"}
    metrics = {r.queue: r for r in tasks.queue_metrics(changes).collect()}
    for q, m in metrics.items():
        mine = [w for w in want if w[0] == q]
        assert m.done == sum(w[2] == "complete" and w[7] for w in mine) and m.expired == sum(w[2] == "expire" for w in mine)
        assert m.pending == next(w[8] for w in sorted(mine, key=lambda w: (w[1], w[2] != "expire")) [::-1])


def test_stream_goes_on_from_batch_to_batch(spark, tmp_path):
    actions = some_actions(5, 90)
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for k in range(3):
        part = actions[30 * k : 30 * k + 30] + actions[:5]  # earlier actions come once more
        spark.createDataFrame(part, tasks.ACTIONS).coalesce(1).write.mode("append").parquet(source)
        stream = tasks.task_changes(spark.readStream.schema(tasks.ACTIONS).parquet(source), 200)
        stream.writeStream.format("parquet").option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
    assert rows(spark.read.schema(tasks.CHANGES).parquet(out)) == plain(actions, 200)
    assert tasks.task_changes(spark.createDataFrame([], tasks.ACTIONS)).count() == 0
