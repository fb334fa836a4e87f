import random

import pytest

from lodestone.operators import history, intervals
from lodestone.streaming.versions import Taken


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_intervals_give_back_full_copies(spark):
    rnd = random.Random(2)
    copies = [(f"r{k}", f"2024-0{k}", "Function", f"f{i}", rnd.choice(["a.py", "b.py"]) if i % 5 else None) for k in range(1, 7) for i in range(25) if rnd.random() < 0.7]
    copies = list(dict.fromkeys(copies))
    members = spark.createDataFrame(copies, "ref string, committed_at string, label string, name string, file_path string")
    stays, snapshots = intervals.encode(members)
    assert rows(intervals.members_at(stays, snapshots)) == sorted(copies, key=repr)
    assert rows(intervals.members_at(stays, snapshots, "r2", "r5")) == sorted((c for c in copies if c[0] in ("r2", "r5")), key=repr)
    assert intervals.members_at(stays, snapshots, "none").count() == 0
    empty = intervals.encode(members.limit(0))
    assert intervals.members_at(*empty).count() == 0


def test_snapshots_taken_one_by_one(spark, make, tmp_path):
    store = intervals.Snapshots(spark, str(tmp_path / "snaps"))
    def graph(*names):
        return make([("Function", n, {"file_path": f}) for n, f in names] + [("Concept", "money")], [(0, 1, "CALLS"), (0, len(names), "IMPLEMENTS")])

    versions = [("v1", [("a", "x.py"), ("b", "x.py")]), ("v2", [("a", "x.py"), ("b", "y.py"), ("c", "x.py")]), ("v3", [("a", "x.py"), ("b", "x.py")])]
    copies = None
    for k, (ref, names) in enumerate(versions, 1):
        g = graph(*names)
        assert store.take(g, ref, committed_at=f"2024-{k}") == k
        more = history.snapshot(g, ref, "", f"2024-{k}")[1]
        copies = more if copies is None else copies.unionByName(more)
    assert rows(store.members()) == rows(copies.select("ref", "committed_at", "label", "name", "file_path"))
    assert spark.read.parquet(store.versions.at(3)).where("name = 'a' AND since = 1").count() == 1  # unchanged, still its first row
    assert rows(history.diff_snapshots(store.members("v1", "v2"), "v1", "v2")) == rows(history.diff_snapshots(copies, "v1", "v2"))
    with pytest.raises(Taken):
        store.versions.mark(3)


def test_report_between_snapshots(spark, make):
    g = make([("Function", "a", {"file_path": "x.py", "line_start": 1, "line_end": 3}), ("Function", "b", {"file_path": "y.py", "line_start": 5, "line_end": 9}), ("Concept", "money")], [(0, 1, "CALLS"), (0, 2, "IMPLEMENTS")])
    copies = [("v1", "1", "Function", "b", "y.py"), ("v1", "1", "Function", "z", "z.py"), ("v1", "1", "Function", "m", "old.py"), ("v2", "2", "Function", "a", "x.py"), ("v2", "2", "Function", "b", "y.py"), ("v2", "2", "Function", "m", "new.py")]
    stays, snapshots = intervals.encode(spark.createDataFrame(copies, "ref string, committed_at string, label string, name string, file_path string"))
    changes, summary = intervals.snapshot_report(g, stays, snapshots, "v1", "v2")
    assert {(r.status, r["name"]) for r in changes.collect()} == {("added", "a"), ("added", "m"), ("removed", "z"), ("removed", "m"), ("moved", "m")}
    s = summary.first()
    assert (s.added, s.removed, s.moved, s.changed) == (2, 2, 1, 0) and s.files == ["new.py", "old.py", "x.py", "z.py"]
    assert (s.affected, s.affected_files, s.affected_knowledge) == (2, 1, 1)  # b in its file, and the concept
    ranges = spark.createDataFrame([("x.py", 2, 2)], "file_path string, first int, last int")
    changes, summary = intervals.snapshot_report(g, stays, snapshots, "v1", "nowhere", ranges)
    assert [(r.status, r["name"]) for r in changes.collect()] == [("changed", "a")] and summary.first().changed == 1
    with pytest.raises(ValueError, match="nowhere"):
        intervals.snapshot_report(g, stays, snapshots, "v1", "nowhere")
