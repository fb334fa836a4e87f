"""Structure checks: call-flow traces, dead code, cycles, test mapping."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.graph import Graph, settle
from ..plans.strong import strong_components

_STEP = "array<struct<caller:string,callee:string,file_path:string>>"


def trace_pairs(calls: DataFrame, entry: str, file_path: str = "", max_depth: int = 10) -> DataFrame:
    """(chain, length) of the call flows from a name, over distinct (caller, callee, file_path).

    A chain ends at a leaf, at a name it already has (that step included) or at ``max_depth``.  The file
    applies to the first step alone.  Each round extends the open chains by one join.
    """
    calls = calls.select("caller", "callee", "file_path").distinct()
    first = calls.where(F.col("caller") == entry)
    if file_path:
        first = first.where(F.col("file_path") == file_path)
    step = F.struct("caller", "callee", "file_path")
    open_ = first.select(F.array(step).alias("chain"), F.array("caller").alias("seen"), F.col("callee").alias("at"))
    done: DataFrame | None = None
    names = calls.select(F.col("caller").alias("at")).distinct()
    for depth in range(1, max_depth + 1):
        again = F.array_contains("seen", F.col("at"))
        leaf = open_.where(~again).join(names, "at", "left_anti")
        ends = open_.where(again).select("chain").unionByName(leaf.select("chain"))
        if depth == max_depth:
            ends = open_.select("chain")
        done = ends if done is None else done.unionByName(ends)
        if depth == max_depth:
            break
        more = open_.where(~again).join(calls, F.col("at") == F.col("caller"))
        open_ = more.select(F.concat("chain", F.array(step)).alias("chain"), F.concat("seen", F.array("at")).alias("seen"), F.col("callee").alias("at"))
        if depth % 4 == 0:
            open_ = settle(open_)
    return done.select("chain", F.size("chain").alias("length"))


def call_pairs(g: Graph) -> DataFrame:
    n = g.nodes.select("id", "name", "file_path")
    return g.links("CALLS").join(n.select(F.col("id").alias("src"), F.col("name").alias("caller")), "src").join(n.select(F.col("id").alias("dst"), F.col("name").alias("callee"), "file_path"), "dst").select("caller", "callee", "file_path")


def trace(g: Graph, entry: str, file_path: str = "", max_depth: int = 10) -> DataFrame:
    return trace_pairs(call_pairs(g), entry, file_path, max_depth)


def unreferenced(g: Graph, labels: tuple[str, ...], types: tuple[str, ...], edges: DataFrame | None = None) -> DataFrame:
    """Nodes of some labels that no edge of the given types leads to: one anti-join."""
    into = (g.links(*types) if edges is None else edges).select(F.col("dst").alias("id"))
    rows = g.of(*labels).select("id", "label", "name", "file_path", "path", "line_start")
    return rows.join(into, "id", "left_anti").select(F.col("label").alias("type"), "name", F.coalesce("file_path", "path").alias("file_path"), F.col("line_start").alias("line"))


def dead_functions(g: Graph) -> DataFrame:
    return unreferenced(g, ("Function", "Method"), ("CALLS", "REFERENCES")).orderBy("file_path", "name")


def dead_classes(g: Graph) -> DataFrame:
    return unreferenced(g, ("Class",), ("REFERENCES", "INHERITS", "IMPLEMENTS", "CALLS")).orderBy("file_path", "name")


def orphan_files(g: Graph, resolved: bool = False) -> DataFrame:
    """Files that nothing imports.  ``resolved`` follows imports to the file a module name belongs to."""
    if not resolved:
        return unreferenced(g, ("File",), ("IMPORTS",)).orderBy("file_path")
    modules = g.of("File").select(F.col("id").alias("dst"), F.regexp_replace(F.regexp_replace("path", r"\.\w+$", ""), "/", ".").alias("module"))
    names = g.of("Import").select(F.col("name").alias("module"))
    return unreferenced(g, ("File",), (), modules.join(names, "module").select("dst")).orderBy("file_path")


def short_cycles(edges: DataFrame, length: int) -> DataFrame:
    """Cycles of two or three edges over (a, b), each once, from its least node on."""
    e = edges.where("a <> b").distinct()
    one, two = e.alias("x"), e.alias("y")
    if length == 2:
        return one.join(two, F.expr("x.b = y.a AND y.b = x.a AND x.a < x.b")).select(F.col("x.a").alias("n1"), F.col("x.b").alias("n2"))
    three = e.alias("z")
    pair = one.join(two, F.expr("x.b = y.a AND x.a < x.b AND x.a < y.b"))
    return pair.join(three, F.expr("y.b = z.a AND z.b = x.a")).select(F.col("x.a").alias("n1"), F.col("x.b").alias("n2"), F.col("y.b").alias("n3"))


def find_cycles(edges: DataFrame) -> DataFrame:
    """(cycle, length): one cycle (array of names, least first) for each back edge of a depth-first walk in name
    order through each strongly connected component from its least name.

    Components are found by joins; a component's walk depends on its order and is one task's work, which
    gets the edges within the component and nothing else.
    """
    live = edges.where("a <> b").select("a", "b").distinct()
    part = settle(strong_components(live))
    inside = live.join(part.select(F.col("node").alias("a"), F.col("component").alias("c")), "a").join(part.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b").where("c = cb")
    return inside.select("c", "a", "b").groupBy("c").applyInArrow(_walk, "cycle array<string>, length int").distinct()


def _walk(edges: pa.Table) -> pa.Table:
    after: dict[str, list[str]] = {}
    for a, b in sorted(zip(edges.column("a").to_pylist(), edges.column("b").to_pylist(), strict=True)):
        after.setdefault(a, []).append(b)
    start = min(after)
    found, done = set(), set()
    path, place, work = [start], {start: 0}, [(start, iter(after[start]))]
    while work:
        node, rest = work[-1]
        for nxt in rest:
            if nxt in place:
                loop = path[place[nxt] :]
                k = loop.index(min(loop))
                found.add(tuple(loop[k:] + loop[:k]))
            elif nxt not in done:
                place[nxt] = len(path)
                path.append(nxt)
                work.append((nxt, iter(after[nxt])))
                break
        else:
            work.pop()
            done.add(node)
            path.pop()
            del place[node]
    cycles = [list(c) for c in sorted(found)]
    return pa.table({"cycle": pa.array(cycles, pa.list_(pa.string())), "length": pa.array([len(c) for c in cycles], pa.int32())})


def named_edges(g: Graph, kind: str, labels: tuple[str, ...], key: str = "name") -> DataFrame:
    """(a, b) by name, or by path with the name where there is none, between nodes of some labels."""
    n = g.of(*labels).select("id", (F.coalesce(F.when(F.col("path") != "", F.col("path")), F.col("name")) if key == "path" else F.col("name")).alias("k"))
    return g.links(kind).join(n.select(F.col("id").alias("src"), F.col("k").alias("a")), "src").join(n.select(F.col("id").alias("dst"), F.col("k").alias("b")), "dst").select("a", "b")


def import_cycles(g: Graph) -> DataFrame:
    return find_cycles(named_edges(g, "IMPORTS", ("File",), "path"))


def call_cycles(g: Graph) -> DataFrame:
    return find_cycles(named_edges(g, "CALLS", ("Function", "Method")))


def map_tests(tests: DataFrame, production: DataFrame, calls: DataFrame | None = None, prefix: str = "test_") -> DataFrame:
    """(test_name, test_file, prod_type, prod_name, prod_file, source), nulls where nothing fits.

    ``tests`` has name and file_path; ``production`` type, name, file_path; ``calls`` test_name,
    test_file, type, name, file_path.  A call to a symbol that is no test comes first; else the longest
    prefix, by underscores, of the name after ``test_`` that a symbol has.
    """
    key = ["test_name", "test_file"]
    base = tests.select(F.col("name").alias("test_name"), F.col("file_path").alias("test_file")).distinct()
    words = F.split(F.substring("test_name", len(prefix) + 1, 1 << 20), "_")
    tries = base.where(F.col("test_name").startswith(prefix)).select(*key, F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.struct((-n).alias("rank"), F.array_join(F.slice(words, 1, n), "_").alias("name")))).alias("c"))
    prod = production.select("type", "name", "file_path").distinct()
    heur = tries.select(*key, F.col("c.rank").alias("rank"), F.col("c.name").alias("name")).join(prod, "name")
    cols = [*key, "rank", "type", "name", "file_path"]
    options = heur.select(*cols).withColumn("source", F.lit("heuristic"))
    if calls is not None:
        direct = calls.where(~F.col("name").startswith(prefix)).join(base, key, "left_semi").withColumn("rank", F.lit(-1_000_000))
        options = options.unionByName(direct.select(*cols).withColumn("source", F.lit("calls")))
    best = options.groupBy(*key).agg(F.min(F.struct("rank", "name", "file_path", "type", "source")).alias("m"))
    out = best.select(*key, F.col("m.type").alias("prod_type"), F.col("m.name").alias("prod_name"), F.col("m.file_path").alias("prod_file"), F.col("m.source").alias("source"))
    return base.join(out, key, "left")


def test_map(g: Graph) -> DataFrame:
    symbols = g.of("Function", "Method", "Class").select("id", F.col("label").alias("type"), "name", "file_path")
    tests = symbols.where(F.col("name").startswith("test_") & F.col("type").isin("Function", "Method"))
    calls = g.links("CALLS").select("src", "dst").join(tests.select(F.col("id").alias("src"), F.col("name").alias("test_name"), F.col("file_path").alias("test_file")), "src")
    calls = calls.join(symbols.withColumnRenamed("id", "dst"), "dst").select("test_name", "test_file", "type", "name", "file_path")
    return map_tests(tests, symbols.where(~F.col("name").startswith("test_")), calls)


def ranked(df: DataFrame, keys: list[str], n: int, *order) -> DataFrame:
    """The first ``n`` rows of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= n).drop("__n")
