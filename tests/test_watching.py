import time

import pytest

from lodestone.sources import code
from lodestone.streaming.cursor import Cursor
from lodestone.streaming.versions import Taken
from lodestone.streaming.watching import Watched


def content(g):
    ids = {r.id: (r.label, r["name"], r.file_path or r.path) for r in g.nodes.collect()}
    return sorted(map(repr, ids.values())), sorted((repr(ids[r.src]), r.type, repr(ids[r.dst])) for r in g.edges.collect())


def test_graph_follows_its_tree(spark, tmp_path):
    root, store = tmp_path / "src", str(tmp_path / "store")
    root.mkdir()
    (root / "a.py").write_text("def one():\n    two()\n\ndef two():\n    pass\n")
    (root / "b.go").write_text("package b\nfunc Run() { help() }\nfunc help() {}\n")
    w = Watched(spark, str(root), store, "r")
    fresh = lambda: content(code.ingest(spark, str(root), "r")[0])
    assert w.round(0) == {"changed": 2, "removed": 0} and content(w.graph()) == fresh()
    assert w.round(0) == {"changed": 0, "removed": 0}  # a replay
    assert w.round(1) == {"changed": 0, "removed": 0}  # nothing new
    (root / "a.py").write_text("def one():\n    three()\n\ndef three():\n    pass\n")
    (root / "c.rs").write_text("fn go() { x(); }\nfn x() {}\n")
    assert w.round(2) == {"changed": 2, "removed": 0} and content(w.graph()) == fresh()
    (root / "b.go").unlink()
    assert w.round(5) == {"changed": 0, "removed": 1} and content(w.graph()) == fresh()
    assert not any("two" in n or "Run" in n for n in content(w.graph())[0])
    again = Watched(spark, str(root), store, "r")  # another driver goes on where the first one was
    assert again.round(5) == {"changed": 0, "removed": 0} and content(again.graph()) == fresh()


def test_rounds_by_a_stream(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    (root / "a.py").write_text("def one():\n    pass\n")
    w = Watched(spark, str(root), str(tmp_path / "store"))
    q = w.follow(str(tmp_path / "check"), "1 second")
    try:
        end = time.time() + 60
        while w.manifest.latest() is None and time.time() < end:
            time.sleep(0.5)
        (root / "b.py").write_text("def two():\n    pass\n")
        while w.graph().nodes.where("name = 'two'").isEmpty() and time.time() < end:
            time.sleep(0.5)
    finally:
        q.stop()
    assert content(w.graph()) == content(code.ingest(spark, str(root))[0])


def pages(spark, **kw):
    return spark.createDataFrame(list(kw.items()) or [("", "")], "page string, hash string").where("page <> ''")


def test_syncs_in_a_row(spark, tmp_path):
    cursor = Cursor(spark, str(tmp_path / "cursor"))
    a, b = pages(spark, x="1", y="2", both="9", p="5"), pages(spark, z="3", both="9", p="6")
    version, plan = cursor.plan(a, b)
    acts = lambda p: {r.page: r.action for r in p.collect()}
    assert version == -1 and acts(plan) == {"x": "a_to_b", "y": "a_to_b", "z": "b_to_a", "both": "in_sync", "p": "first_sync_conflict"}
    assert cursor.advance(version, a, b, plan) == 0
    same = pages(spark, x="1", y="2", z="3", both="9", p="5"), pages(spark, x="1", y="2", z="3", both="9", p="6")
    version, plan = cursor.plan(*same)
    assert {k: v for k, v in acts(plan).items() if v != "in_sync"} == {"p": "first_sync_conflict"}
    moved = pages(spark, x="7", z="3", both="9"), pages(spark, x="1", y="2", z="4", both="8")
    version, plan = cursor.plan(*moved)
    assert acts(plan) == {"x": "a_to_b", "y": "a_to_b", "z": "b_to_a", "both": "b_to_a"}
    late = cursor.plan(*moved)
    assert cursor.advance(version, *moved, plan) == 1
    with pytest.raises(Taken):
        cursor.advance(late[0], *moved, late[1])
    assert {r.page: r.a_hash for r in cursor.read()[1].collect()} == {"x": "7", "z": "4", "both": "8"}  # y is gone from both once the plan is carried out
