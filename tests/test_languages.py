import pytest

from lodestone.operators.knowledge import Knowledge, extract_decisions
from lodestone.plans import cypher


def small(make):
    return make(
        [("Function", "a", {"file_path": "f.py", "line_start": 3}), ("Function", "b", {"file_path": "f.py", "line_start": 1}), ("Function", "c", {"file_path": "g.py"}), ("Domain", "D"), ("Rule", "r", {"severity": "critical"})],
        [(0, 1, "CALLS"), (1, 2, "CALLS"), (0, 3, "BELONGS_TO"), (4, 0, "GOVERNS")],
    )


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_matches(make):
    g = small(make)
    assert rows(cypher.run(g, "MATCH (a:Function)-[:CALLS]->(b) RETURN a.name, b.name AS to ORDER BY to")) == [("a", "b"), ("b", "c")]
    assert rows(cypher.run(g, "MATCH (x)<-[r]-(y) WHERE x.name = $n RETURN type(r) AS t, labels(y)[0] AS l, y.name", {"n": "a"})) == [("GOVERNS", "Rule", "r")]
    assert rows(cypher.run(g, "MATCH (a)-[:CALLS*1..2]->(b) WHERE a.name = 'a' RETURN DISTINCT b.name AS n ORDER BY n DESC")) == [("c",), ("b",)]
    assert rows(cypher.run(g, "MATCH (n) WHERE (n:Function OR n:Rule) AND toLower(n.name) CONTAINS 'R' OR n.name STARTS WITH 'D' RETURN n.name")) == [("D",)]
    assert rows(cypher.run(g, "MATCH (n:Function) WHERE NOT (n)<-[:CALLS]-() RETURN n.name")) == [("a",)]
    assert rows(cypher.run(g, "MATCH (n:Function) WHERE n.file_path IN ['f.py'] RETURN n.name ORDER BY n.line_start SKIP 1 LIMIT 1")) == [("a",)]
    assert rows(cypher.run(g, "MATCH (n:Function {name: 'a'}) OPTIONAL MATCH (n)-[:ASSIGNED_TO]->(p:Person) RETURN n.name, p.name AS who")) == [("a", None)]
    assert rows(cypher.run(g, "MATCH (n) RETURN labels(n)[0] AS label, count(*) AS k ORDER BY k DESC, label")) == [("Function", 3), ("Domain", 1), ("Rule", 1)]
    assert rows(cypher.run(g, "MATCH (a)-[:CALLS]-(b) WHERE a.name = 'b' RETURN b.name ORDER BY b.name")) == [("a",), ("c",)]
    with pytest.raises(ValueError):
        cypher.run(g, "MATCH (n) DELETE n")


def test_knowledge_merges_and_links(make):
    g = small(make)
    k = Knowledge(g).add_concept("Payments", "money", domain="D").add_person("Ada", "ada@x").assign("Function", "a", "Ada").annotate("Function", "b", concept="Payments").code_implements("Function", "c", "Payments").link(("Rule", "none"), "GOVERNS", ("Function", "a"))
    merged, lost = k.merged()
    labels = {r["label"]: r["count"] for r in merged.nodes.groupBy("label").count().collect()}
    assert labels == {"Function": 3, "Domain": 1, "Rule": 1, "Concept": 1, "Person": 1}
    kinds = {r["type"]: r["count"] for r in merged.edges.groupBy("type").count().collect()}
    assert kinds == {"CALLS": 2, "BELONGS_TO": 2, "GOVERNS": 1, "ASSIGNED_TO": 1, "ANNOTATES": 1, "IMPLEMENTS": 1}
    assert lost.count() == 1
    with pytest.raises(ValueError):
        Knowledge(g).govern("unknown", "Function", "a")


def test_decisions_from_tickets(spark):
    class Fixed:
        def complete(self, prompt):
            return '[{"name": "use x", "rationale": "fast"}]' if "ticket one" in prompt else "no json"

    df = spark.createDataFrame([("t1", "ticket one"), ("t2", "ticket two")], "name string, text string")
    assert rows(extract_decisions(df, Fixed())) == [("t1", "use x", "fast", "proposed")]
