import json
import subprocess

from lodestone.operators import store
from lodestone.sources import code, documents, graph_files, vcs, workspaces

PY = '''"""Doc."""
import os
from a.b import c

class Base:
    pass

class Shop(Base):
    """A shop."""
    @property
    def total(self):
        return helper(1)

def helper(x):
    """Helps."""
    return os.path.join(x)
'''


def kinds(p):
    return sorted((n["label"], n["name"]) for n in p.nodes)


def test_python():
    p = code.parse_python("shop.py", PY)
    assert ("Method", "total") in kinds(p) and ("Function", "helper") in kinds(p) and ("Decorator", "property") in kinds(p)
    assert ("Import", "a.b.c") in kinds(p)
    edges = {(e["type"], e["from_name"], e["to_name"]) for e in p.edges}
    assert {("INHERITS", "Shop", "Base"), ("CALLS", "total", "helper"), ("CONTAINS", "Shop", "total"), ("DECORATES", "property", "total")} <= edges
    assert code.parse_python("bad.py", "def (").nodes[0]["label"] == "File"


def test_other_languages():
    ts = code.parse_by_rules("a.ts", "import x from './x'\nexport class A extends B {\n  run(): void {\n    go(1)\n  }\n}\nconst f = (a) => {\n  g()\n}\nfunction h() { }\n", "typescript")
    assert {("Class", "A"), ("Method", "run"), ("Function", "f"), ("Function", "h"), ("Import", "./x")} <= set(kinds(ts))
    assert ("CALLS", "run", "go") in {(e["type"], e["from_name"], e["to_name"]) for e in ts.edges}
    go = code.parse_by_rules("a.go", 'package m\nimport "fmt/x"\ntype T struct {\n}\nfunc (t *T) Run() {\n\thelp()\n}\nfunc help() {\n}\n', "go")
    assert {("Class", "T"), ("Method", "Run"), ("Function", "help"), ("Import", "fmt/x")} <= set(kinds(go))
    rs = code.parse_by_rules("a.rs", "use std::io;\nstruct S {\n}\nimpl S {\n    pub fn run(&self) {\n        help();\n    }\n}\nfn help() {\n}\n", "rust")
    assert {("Class", "S"), ("Method", "run"), ("Function", "help"), ("Import", "std::io")} <= set(kinds(rs))
    ja = code.parse_by_rules("A.java", "import a.B;\npublic class A extends B {\n    public void run() {\n        go();\n    }\n}\n", "java")
    assert {("Class", "A"), ("Method", "run"), ("Import", "a.B")} <= set(kinds(ja))
    rb = code.parse_by_rules("a.rb", "require 'x'\nclass A < B\n  def run\n    go()\n  end\nend\ndef top\nend\n", "ruby")
    assert {("Class", "A"), ("Method", "run"), ("Function", "top"), ("Import", "x")} <= set(kinds(rb))
    c = code.parse_by_rules("a.c", "#include <x.h>\nstruct S {\n  int a;\n};\nint run(int a) {\n  go(a);\n}\n", "c")
    assert {("Class", "S"), ("Function", "run"), ("Import", "x.h")} <= set(kinds(c))
    sh = code.parse_by_rules("a.sh", "source x.sh\nNAME=1\nrun() {\n  go\n}\n", "bash")
    assert {("Function", "run"), ("Variable", "NAME"), ("Import", "x.sh")} <= set(kinds(sh))


def test_infrastructure():
    tf = code.parse_hcl("m.tf", 'variable "size" {}\nresource "aws_vm" "web" {\n  n = var.size\n  s = aws_net.main.id\n}\nresource "aws_net" "main" {\n}\n')
    assert {("Variable", "size"), ("Class", "aws_vm.web")} <= set(kinds(tf))
    assert {("REFERENCES", "aws_vm.web", "size"), ("DEPENDS_ON", "aws_vm.web", "aws_net.main")} <= {(e["type"], e["from_name"], e["to_name"]) for e in tf.edges}
    an = code.parse_ansible("playbooks/p.yml", "- hosts: all\n  name: Web\n  roles: [base]\n  tasks:\n    - name: copy\n      copy: {}\n      notify: restart\n    - block:\n        - shell: ls\n  handlers:\n    - name: restart\n      service: {}\n")
    assert {("Class", "Web"), ("Function", "copy"), ("Function", "shell"), ("Function", "restart"), ("Import", "base")} <= set(kinds(an))


def test_ingest_tree(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.py").write_text("def hidden(): pass\n")
    (tmp_path / "pkg" / "shop.py").write_text(PY)
    (tmp_path / "README.md").write_text("# Read me\nSee [more](docs/more.md)\n")
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "more.md").write_text("no title")
    g, hashes = code.ingest(spark, str(tmp_path), "repo")
    names = {(r.label, r.name) for r in g.nodes.collect()}
    assert ("Function", "helper") in names and ("Document", "more.md") in names and ("Function", "hidden") not in names
    kinds_ = {r["type"] for r in g.edges.collect()}
    assert {"CONTAINS", "CALLS", "INHERITS", "REFERENCES", "IMPORTS", "DECORATES"} <= kinds_
    assert hashes.count() == 3
    again, _ = code.ingest(spark, str(tmp_path), "repo", known=hashes)
    assert again.nodes.count() == 0
    twice, _ = code.ingest(spark, str(tmp_path), "repo")
    assert sorted(r.id for r in twice.nodes.collect()) == sorted(r.id for r in g.nodes.collect())
    graph_files.export_jsonl(g, str(tmp_path / "out"))
    back = graph_files.import_jsonl(spark, str(tmp_path / "out"))
    assert (back.nodes.count(), back.edges.count()) == (g.nodes.count(), g.edges.count())
    for name in ("kg.json", "kg.db"):
        n = graph_files.export_kg(g, str(tmp_path / name))
        got = graph_files.import_kg(spark, str(tmp_path / name))
        assert (got.nodes.count(), got.edges.count()) == (n["nodes"], n["edges"]) == (g.nodes.count(), g.edges.count())
    points = graph_files.Checkpoints(str(tmp_path / "points"))
    v = points.create(g, "first")
    assert points.restore(spark, v).edges.count() == g.edges.count() and points.list()[0]["label"] == "first"
    assert store.migrate(g, 1)[1] == store.VERSION


def test_documents():
    adr = documents.parse_adr("adr/0001-use.md", "# 1. Use it\n\n## Status\nAccepted\n\n## Decision\nWe do.\n\nDate: 2024-02-03\n")
    assert (adr["name"], adr["description"], adr["status"], adr["rationale"].split("\n")[0], adr["date"]) == ("0001-use", "Use it", "accepted", "We do.", "2024-02-03")
    assert documents.parse_memory("m/feedback_x.md", "body", "r")["label"] == "Rule"
    assert documents.parse_memory("m/x.md", "---\nname: N\ntype: user\n---\nbody")["name"] == "N"
    assert documents.parse_memory("m/other.md", "body") is None
    nodes, edges = documents.parse_codeowners("# c\n*.py @team a@b.c\n\nsolo\n")
    assert [e["to_name"] for e in edges] == ["team", "a@b.c"] and nodes[2]["email"] == "a@b.c"
    assert documents.parse_manifest("package.json", json.dumps({"dependencies": {"a": "^1"}, "devDependencies": {"b": "2"}})) == [("a", "^1"), ("b", "2")]
    assert documents.parse_manifest("requirements.txt", "x==1 # c\n-r y\nz[e]>=2\n") == [("x", "==1"), ("z", ">=2")]
    assert documents.parse_manifest("Cargo.toml", '[dependencies]\na = "1"\nb = {version = "2"}\n') == [("a", "1"), ("b", "2")]
    assert documents.parse_manifest("go.mod", "module m\nrequire x.y/z v1.2\n") == [("x.y/z", "v1.2")]
    api = documents.parse_openapi("a.yaml", "paths:\n  /x:\n    get: {operationId: getX}\n    post: {summary: s}\ncomponents:\n  schemas:\n    T: {description: d}\n")
    assert [r["name"] for r in api] == ["getX", "POST /x", "T"]
    gql = documents.parse_graphql("s.graphql", "type Query {\n  user(id: ID): User!\n}\ntype User {\n  id: ID\n}\n")
    assert [(r["label"], r["name"]) for r in gql] == [("Function", "user"), ("Class", "User")]
    issues = documents.parse_issues(json.dumps([{"number": 1, "title": "t", "labels": [{"name": "bug"}]}, {"number": 2, "title": "p", "pull_request": {}}]))
    assert [(r["name"], r["severity"]) for r in issues] == [("#1: t", "warning")]
    n, e = documents.parse_meeting_graph(json.dumps({"nodes": [{"id": "a", "type": "person", "name": "Ada"}, {"id": "b", "type": "decision", "name": "Go"}], "relationships": [{"source": "b", "target": "a", "type": "governs"}]}))
    assert [x["label"] for x in n] == ["Person", "Decision"] and e[0]["type"] == "GOVERNS"


def test_walk_prunes(spark, tmp_path):
    for path in ("a/__init__.py", "a/_own.py", "a/b.go", "a/notes.txt", "node_modules/x/y.js", "a/.next/z.js", "sub/.git/config", "sub/s.py", "link/w.py", "gen/c.gen.py", "docs/old/d.py", "docs/e.py", "play/tasks/m.yml"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x = 1\n")
    (tmp_path / "link/.git").write_text("gitdir: elsewhere")
    (tmp_path / ".navignore").write_text("# generated\n*.gen.py\ndocs/old/\n\n")
    (tmp_path / "broken.py").symlink_to(tmp_path / "nowhere.py")
    want = ["a/__init__.py", "a/_own.py", "a/b.go", "docs/e.py", "play/tasks/m.yml"]
    assert code.listing(str(tmp_path)) == want
    assert sorted(r.path for r in code.walk(spark, str(tmp_path)).collect()) == want
    assert code.listing(str(tmp_path), exclude=("a", "play/*")) == ["docs/e.py"]
    assert code.listing("file://" + str(tmp_path), nested=True) == sorted([*want, "sub/s.py", "link/w.py"])
    assert code.walk(spark, str(tmp_path), exclude=("*",)).count() == 0
    g, hashes = code.ingest(spark, str(tmp_path), "r")
    assert {r.path for r in hashes.collect()} == {"a/__init__.py", "a/_own.py", "a/b.go", "docs/e.py"} or hashes.count() == 5


def test_version_control_text(spark):
    h = "a" * 40
    assert vcs.parse_log(f"{h}\n\nx.py\ny.py\n") == [(h, "x.py"), (h, "y.py")]
    assert vcs.parse_numstat("1\t2\tx.py\n-\t-\tb.png\n") == [("x.py", 1, 2)]
    lines = spark.createDataFrame([("l", i, t) for i, t in enumerate([h, "", "x.py", "b" * 40, "y.py"])], "log string, number int, line string")
    assert sorted((r.commit[0], r.file) for r in vcs.parse_log_frame(lines).collect()) == [("a", "x.py"), ("b", "y.py")]
    assert vcs.parse_blame(f"{h} 1 1 1\nauthor Ada\n\tcode\n{h} 2 2\n\tmore\n") == [(1, h, "Ada"), (2, h, "Ada")]
    assert vcs.parse_submodules('[submodule "s"]\n\tpath = p\n\turl = u\n') == [("s", "p", "u")]


def test_workspaces(spark, tmp_path):
    for name, deps in (("a", {"@x/b": "1"}), ("b", {})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "package.json").write_text(json.dumps({"name": f"@x/{name}", "dependencies": deps}))
    assert workspaces.detect(str(tmp_path)) == "bare"
    assert [tuple(r) for r in workspaces.package_dependencies(spark, str(tmp_path)).collect()] == [("a", "b")]
    subprocess.run(["mkdir", "-p", str(tmp_path / "n" / "m" / ".git")], check=True)
    assert [n for n, _ in workspaces.nested_repositories(str(tmp_path))] == ["n-m"]
    r = workspaces.Registry(str(tmp_path / "r.json"))
    r.register("a", "/a")
    assert r.all() == {"a": "/a"}
