import random

from lodestone.operators import structure
from lodestone.plans.strong import strong_components


def plain(edges):
    """Components of two nodes or more, by what reaches what."""
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
        after.setdefault(b, set())

    def reached(x):
        seen, work = set(), [x]
        while work:
            for y in after[work.pop()]:
                if y not in seen:
                    seen.add(y)
                    work.append(y)
        return seen

    far = {x: reached(x) for x in after}
    out = {}
    for x in after:
        mine = {y for y in far[x] if x in far[y]} | {x}
        if len(mine) > 1:
            out[x] = min(mine)
    return out


def frame(spark, edges):
    return spark.createDataFrame([(f"n{a:03}", f"n{b:03}") for a, b in edges], "a string, b string")


def test_strong_components(spark):
    rnd = random.Random(6)
    ring = [(i, (i + 1) % 70) for i in range(70)]  # one ring
    lasso = [(100, 101), (101, 102), (102, 103), (103, 101), (103, 104), (104, 105), (105, 106), (106, 105)]
    mixed = [(rnd.randrange(200, 230), rnd.randrange(200, 230)) for _ in range(45)]
    tails = [(i, i + 1) for i in range(300, 340)] + [(340, 200)]
    eight = [(400, 401), (401, 402), (402, 400), (402, 403), (403, 404), (404, 402), (500, 500)]
    edges = ring + lasso + mixed + tails + eight + ring[:3]
    named = [(f"n{a:03}", f"n{b:03}") for a, b in edges if a != b]
    got = {r.node: r.component for r in strong_components(frame(spark, edges)).collect()}
    assert got == plain(named)
    assert strong_components(frame(spark, edges).limit(0)).count() == 0


def test_cycles_of_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 3), (5, 1), (4, 9), (9, 8), (8, 9), (7, 7)]
    got = {tuple(r.cycle): r.length for r in structure.find_cycles(frame(spark, edges)).collect()}
    assert got == {("n001", "n002", "n003"): 3, ("n003", "n004"): 2, ("n008", "n009"): 2}
    assert structure.find_cycles(frame(spark, [(1, 2), (2, 3)])).count() == 0
