import json

import pytest

from lodestone.__main__ import main
from lodestone.operators import store
from lodestone.sources import workspaces
from lodestone.workspace import Workspace, operations


def test_operations_are_the_operators_own(spark, make, tmp_path, capsys):
    assert {"blast_radius", "explain", "task_pack", "dead_functions", "import_cycles", "symbol_search", "cypher", "sql", "check"} <= set(operations())
    g = make([("Function", n, {"file_path": "f.py"}) for n in "abc"], [(0, 1, "CALLS"), (1, 2, "CALLS")])
    w = Workspace(spark, g)
    assert sorted(r["name"] for r in w.run("blast_radius", "a", depth=2, file="f.py").collect()) == ["b", "c"]
    assert w.run("cypher", "MATCH (n:Function) RETURN count(*) AS n").first().n == 3
    with pytest.raises(ValueError, match="no operation"):
        w.run("nothing")
    store.save(g, str(tmp_path / "g"))
    assert main([str(tmp_path / "g"), "blast_radius", "a", "--depth", "1"]) == 0
    shown = capsys.readouterr().out
    assert "|b " in shown and "|c " not in shown
    assert main([str(tmp_path / "g"), "operations"]) == 0 and "blast_radius" in capsys.readouterr().out
    assert main([]) == 2


def test_packages_of_one_tree(spark, tmp_path):
    def put(path, text):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)

    put("package.json", json.dumps({"name": "whole", "workspaces": ["packages/*"]}))
    put("packages/app/package.json", json.dumps({"name": "@org/app", "dependencies": {"@org/core": "1", "left-pad": "2"}}))
    put("packages/app/src/a.ts", "export function run() { help() }\nfunction help() {}\n")
    put("packages/core/package.json", json.dumps({"name": "@org/core", "dependencies": {"special-name": "*"}}))
    put("packages/core/c.py", "def core():\n    pass\n")
    put("packages/core/inner/package.json", json.dumps({"name": "special-name", "peerDependencies": {"app": "*"}}))
    put("packages/core/inner/d.go", "package d\nfunc Deep() {}\n")
    put("packages/broken/package.json", "{")
    put("top.py", "def top():\n    pass\n")
    assert workspaces.detect(str(tmp_path)) == "yarn"
    g, counts = workspaces.ingest_packages(spark, str(tmp_path), "mono")
    nodes = {r.id: r for r in g.nodes.collect()}
    edges = {(nodes[r.src]["name"], r.type, nodes[r.dst]["name"]) for r in g.edges.collect()}
    repos = {r.path for r in nodes.values() if r.label == "Repository"}
    assert repos == {"mono", "packages/app", "packages/core", "packages/core/inner", "packages/broken"}
    assert {b for a, t, b in edges if a == "mono" and t == "CONTAINS"} == {"app", "core", "inner", "broken"}
    assert {(a, b) for a, t, b in edges if t == "DEPENDS_ON"} == {("app", "core"), ("core", "inner"), ("inner", "app")}
    assert {(a, b) for a, t, b in edges if t == "BELONGS_TO"} == {("a.ts", "app"), ("c.py", "core"), ("d.go", "inner"), ("top.py", "mono")}
    assert {r["name"]: r.repo for r in nodes.values() if r.label == "Function"} == {"run": "packages/app", "help": "packages/app", "core": "packages/core", "Deep": "packages/core/inner", "top": "mono"}
    assert ("run", "CALLS", "help") in edges
    assert {r.package: (r.files, r.symbols) for r in counts.collect()} == {"packages/app": (1, 2), "packages/core": (1, 1), "packages/core/inner": (1, 1), "mono": (1, 1)}
