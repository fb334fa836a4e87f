import random

import pytest

from lodestone.operators import context, impact, structure
from lodestone.plans import cypher
from lodestone.plans.graph import reach, trails


def chain(make):
    nodes = [("Repository", "repo", {"path": "/repo"}), ("File", "app.py", {"path": "app.py"})] + [("Function", n, {"file_path": "app.py", "line_start": k}) for n, k in (("a", 1), ("b", 5), ("c", 9))]
    return make(nodes, [(0, 1, "CONTAINS"), (1, 2, "CONTAINS"), (1, 3, "CONTAINS"), (1, 4, "CONTAINS"), (2, 3, "CALLS"), (3, 4, "CALLS")])


def names(df):
    return sorted(r["name"] for r in df.collect())


def test_blast_radius_by_depth(make):
    g = chain(make)
    assert names(impact.blast_radius(g, g.root("a"), 3)) == ["b", "c"]
    assert names(impact.blast_radius(g, g.root("a"), 1)) == ["b"]
    assert names(impact.blast_radius(g, g.root("c"), 3, "in")) == ["a", "b"]
    one = impact.blast_summary(g, g.root("a"), 3).first()
    assert (one.affected, one.affected_files, one.depth_reached, one.max_level) == (2, ["app.py"], 3, 2)
    assert impact.blast_summary(g, g.root("nobody"), 3).first().depth_reached == 0


def test_root_is_reached_only_by_a_cycle(make):
    g = make([("Function", n) for n in "abc"], [(0, 1, "CALLS"), (1, 0, "CALLS"), (1, 2, "CALLS")])
    assert {(r.id, r.level) for r in reach(g, g.root("a"), ["CALLS"], 3).collect()} == {(1, 1), (0, 2), (2, 2)}
    assert {r.id for r in reach(g, g.root("c"), ["CALLS"], 3).collect()} == set()


def brute(edges, roots, depth, both):
    """Ends of trails of 1..depth edges."""
    ends = set()

    def go(at, used):
        if len(used) == depth:
            return
        for k, (a, b) in enumerate(edges):
            if k not in used:
                for x, y in ((a, b), (b, a)) if both and a != b else ((a, b),):
                    if x == at:
                        ends.add(y)
                        go(y, used | {k})

    for r in roots:
        go(r, frozenset())
    return ends


def test_reach_against_trails(make):
    rnd = random.Random(5)
    for _ in range(4):
        edges = [(rnd.randrange(6), rnd.randrange(6), "CALLS") for _ in range(8)]
        edges = list(dict.fromkeys(edges))
        g = make([("Function", f"f{i}") for i in range(6)], edges)
        pairs = [(a, b) for a, b, _ in edges]
        got = {r.id for r in reach(g, g.root("f0"), ["CALLS"], 3).collect()}
        assert got == brute(pairs, [0], 3, False)
        near = {r.neighbor_name for r in context.neighbours(g, g.root("f0"), 3).collect()} - {None}
        assert near == {f"f{i}" for i in brute(pairs, [0], 3, True)}


def test_paths_are_counted(make):
    g = make([("Class", n) for n in "abcd"], [(0, 1, "INHERITS"), (0, 2, "INHERITS"), (1, 3, "INHERITS"), (2, 3, "INHERITS")])
    assert sorted((r.id, r.length) for r in trails(g, g.root("a"), ["INHERITS"]).collect()) == [(1, 1), (2, 1), (3, 2), (3, 2)]


def test_neighbours_keep_lonely_roots(make):
    g = make([("Function", "a"), ("Function", "b")], [])
    rows = context.neighbours(g, g.root("a"), 2).collect()
    assert [(r.root_name, r.neighbor_name) for r in rows] == [("a", None)]


def test_trace_stops_where_it_should(make):
    g = make([("Function", n, {"file_path": "f"}) for n in "abc"], [(0, 1, "CALLS"), (1, 0, "CALLS"), (1, 2, "CALLS")])
    chains = sorted([s.caller for s in r.chain] + [r.chain[-1].callee] for r in structure.trace(g, "a", max_depth=5).collect())
    assert chains == [["a", "b", "a"], ["a", "b", "c"]]
    assert structure.trace(g, "zz").count() == 0
    assert [r.length for r in structure.trace(g, "a", max_depth=1).collect()] == [1]


def test_dead_code_and_cycles(make):
    g = make([("Function", n, {"file_path": "f"}) for n in "abcd"], [(0, 1, "CALLS"), (1, 2, "CALLS"), (2, 0, "CALLS"), (3, 3, "CALLS")])
    assert names(structure.dead_functions(g)) == []
    assert [r.cycle for r in structure.call_cycles(g).collect()] == [["a", "b", "c"]]
    e = g.links("CALLS").selectExpr("src AS a", "dst AS b")
    assert [tuple(r) for r in structure.short_cycles(e, 3).collect()] == [(0, 1, 2)]
    assert structure.short_cycles(e, 2).count() == 0


def test_tests_map_to_callee_first(make):
    g = make([("Function", "test_load_file", {"file_path": "t"}), ("Function", "load", {"file_path": "p"}), ("Function", "other", {"file_path": "p"}), ("Function", "test_none", {"file_path": "t"}), ("Function", "test_load_x", {"file_path": "t"})], [(0, 2, "CALLS")])
    got = {r.test_name: (r.prod_name, r.source) for r in structure.test_map(g).collect()}
    assert got == {"test_load_file": ("other", "calls"), "test_none": (None, None), "test_load_x": ("load", "heuristic")}


def test_long_chains_are_followed_to_their_end(make):
    n = 101
    g = make([("Class", f"c{i}") for i in range(n)], [(i, i + 1, "INHERITS") for i in range(n - 1)])
    want = {(f"c{i}", i) for i in range(1, n)}
    assert {(r["name"], r.level) for r in context.ancestors(g, g.root("c0")).collect()} == want
    assert sorted((r.id, r.length) for r in trails(g, g.root("c0"), ["INHERITS"]).collect()) == [(i, i) for i in range(1, n)]
    assert cypher.run(g, "MATCH (a:Class {name: 'c85'})-[:INHERITS*]->(b) RETURN b.name AS name").count() == 15
    assert {r.level for r in reach(g, g.root("c0"), ["INHERITS"], 7).collect()} == set(range(1, 8))


def test_bounds_of_trails_raise(make):
    g = make([("Class", n) for n in "abcdefg"], [(i, i + 1, "INHERITS") for i in range(6)])
    assert trails(g, g.root("a"), ["INHERITS"], most=6).count() == 6
    for most in (5, 3, 1):
        with pytest.raises(ValueError, match="more than"):
            trails(g, g.root("a"), ["INHERITS"], most=most)
    assert trails(g, g.root("g"), ["INHERITS"]).count() == 0


def test_trails_against_a_walk(make):
    rnd = random.Random(8)
    for direction in ("out", "in", "both"):
        edges = list(dict.fromkeys((rnd.randrange(5), rnd.randrange(5), rnd.choice(["CALLS", "IMPORTS"])) for _ in range(7)))
        g = make([("Function", f"f{i}") for i in range(5)], edges)
        want = []

        def go(at, used, edges=edges, direction=direction, want=want):
            for k, (a, b, _) in enumerate(edges):
                ways = {"out": [(a, b)], "in": [(b, a)], "both": [(a, b)] + [(b, a)] * (a != b)}[direction]
                for x, y in ways:
                    if x == at and k not in used:
                        want.append((y, len(used) + 1))
                        go(y, used | {k})

        go(0, frozenset())
        got = trails(g, g.root("f0"), ["CALLS", "IMPORTS"], direction)
        assert sorted((r.id, r.length) for r in got.collect()) == sorted(want)
