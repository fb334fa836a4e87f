"""Interchange files written by parts, and SQLite tables read in ranges."""

import json
import sqlite3
from contextlib import closing

import pytest

from lodestone.sources import graph_files, vcs


@pytest.mark.parametrize("name", ["g.json", "g.db"])
def test_export_by_parts(spark, make, tmp_path, name):
    g = make([("Function", f"f{i:03}", {"file_path": "a.py", "docstring": 'says "hi"\n, [x]'}) for i in range(120)], [(i, i + 1, "CALLS") for i in range(119)])
    path = tmp_path / name
    for _ in range(2):  # a second export takes the first one's place
        assert graph_files.export_kg(g, str(path)) == {"nodes": 120, "edges": 119}
    assert [p.name for p in tmp_path.iterdir()] == [name]  # no part is left
    if name.endswith(".json"):
        doc = json.loads(path.read_text())
        ids = [n["id"] for n in doc["nodes"]]
        assert doc["format"] == graph_files.FORMAT and len(doc["edges"]) == 119 and doc["nodes"][0]["props"]["docstring"] == 'says "hi"\n, [x]'
    else:
        with closing(sqlite3.connect(path)) as db:
            ids = [r[0] for r in db.execute("SELECT id FROM nodes ORDER BY rowid")]
            assert db.execute("SELECT count(*), min(props), max(props) FROM edges").fetchone() == (119, "{}", "{}")
            assert {r[1] for r in db.execute("SELECT * FROM sqlite_master WHERE type = 'index' AND name LIKE 'edges%'")} == {"edges_source", "edges_target"}
    assert ids == sorted(ids) and len(set(ids)) == 120
    back = graph_files.import_kg(spark, str(path))
    assert back.nodes.count() == 120 and back.edges.count() == 119
    empty = make([("Function", "x")], [])
    assert graph_files.export_kg(empty, str(path)) == {"nodes": 1, "edges": 0}
    assert graph_files.import_kg(spark, str(path)).edges.count() == 0


def test_tables_in_ranges(spark, tmp_path):
    path = str(tmp_path / "t.db")
    with closing(sqlite3.connect(path)) as db:
        db.execute("CREATE TABLE t(a TEXT, b INT)")
        db.executemany("INSERT INTO t VALUES (?, ?)", [(f"a{i}", i) for i in range(1000)])
        db.execute("DELETE FROM t WHERE b % 3 = 0")
        db.commit()
    spark.dataSource.register(graph_files.SqliteSource)
    df = spark.read.format("sqlite_table").option("path", path).option("table", "t").option("columns", "a,b").option("rows", "100").load()
    assert df.rdd.getNumPartitions() == 10 and df.count() == 666
    assert {r.b for r in df.collect()} == {str(i) for i in range(1000) if i % 3}
    assert graph_files.sqlite_table(spark, path, "t", ["a", "zz"]).where("zz IS NULL").count() == 666
    assert graph_files.sqlite_table(spark, path, "none", ["a"]).count() == 0


def test_fossil_tables(spark, tmp_path):
    path = str(tmp_path / "repo.fossil")
    with closing(sqlite3.connect(path)) as db:
        db.execute("CREATE TABLE event(type TEXT, mtime REAL, objid INT, user TEXT, euser TEXT, comment TEXT, ecomment TEXT)")
        db.execute("INSERT INTO event VALUES ('ci', 2460310.5, 1, 'ada', NULL, 'first', 'first, mended'), ('w', 2460311.25, 2, 'bob', 'eve', 'page', NULL)")
        db.execute("CREATE TABLE ticket(tkt_uuid TEXT, title TEXT, status TEXT, comment TEXT, tkt_mtime REAL)")
        db.execute("INSERT INTO ticket VALUES ('abc', 'It breaks', 'open', 'why', 1.5), ('def', '', 'closed', NULL, NULL), ('', '', '', NULL, NULL)")
        db.commit()
    got = sorted((r.kind, str(r["at"]), r.user, r.comment) for r in vcs.fossil_timeline(spark, path).collect())
    assert got == [("ci", "2024-01-01 00:00:00", "ada", "first, mended"), ("w", "2024-01-01 18:00:00", "eve", "page")]
    tickets = {r["name"]: (r.ticket_id, r.status, r.content, r.priority, r.updated_at) for r in vcs.fossil_tickets(spark, path).collect()}
    assert tickets == {"It breaks": ("abc", "open", "why", "", "1.5"), "def": ("def", "closed", "", "", "")}
