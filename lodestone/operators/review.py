"""Changes: symbols under changed lines, what is known about them, reviews, release checks, task packs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.graph import SYMBOLS, Graph, hops, reach
from .impact import blast_radius
from .structure import ranked

# Fixed value: the header of a hunk of a unified diff.
_HUNK = re.compile(r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@")


def parse_diff(text: str) -> list[tuple[str, int, int]]:
    """(file, first, last new line) of every hunk of a unified diff; deletions touch one line."""
    found, file = [], None
    for line in text.splitlines():
        if line.startswith("+++ "):
            name = line[4:].split("\t")[0].strip()
            file = None if name == "/dev/null" else name.removeprefix("b/")
        elif file and (m := _HUNK.match(line)):
            start, count = int(m[1]), int(m[2] or 1)
            found.append((file, start, start + max(count, 1) - 1))
    return found


def changed_symbols(symbols: DataFrame, ranges: DataFrame) -> DataFrame:
    """Distinct symbols (name, file_path, label, line_start, line_end) whose lines overlap a changed range
    (file_path, first, last).  An equi-join on the file with the overlap as residual; a symbol without a
    last line spans its first."""
    s = symbols.where(F.col("line_start").isNotNull()).withColumn("stop", F.coalesce(F.when(F.col("line_end") > 0, F.col("line_end")), F.col("line_start")))
    r = ranges.select(F.col("file_path").alias("f"), "first", "last")
    hit = s.join(r, F.expr("file_path = f AND first <= stop AND last >= line_start"), "left_semi")
    return hit.groupBy("name", "file_path").agg(F.min(F.struct("line_start", "label", "line_end")).alias("m")).select("name", "file_path", "m.label", "m.line_start", "m.line_end")


def _ids(g: Graph, changed: DataFrame) -> DataFrame:
    """Nodes of the changed names; an empty file path matches any."""
    c = changed.select(F.col("name").alias("n"), F.coalesce("file_path", F.lit("")).alias("f")).distinct()
    return g.nodes.select("id", "name", "file_path").join(c, F.expr("name = n AND (f = '' OR f = file_path)")).select("id", F.col("n").alias("symbol"), F.col("f").alias("symbol_file"))


def affected_knowledge(g: Graph, changed: DataFrame) -> DataFrame:
    """Knowledge that the symbols annotate or implement, or that governs or annotates them; by name once."""
    ids = _ids(g, changed).select("id").distinct()
    out = g.links("ANNOTATES", "IMPLEMENTS").join(ids.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"))
    back = g.links("GOVERNS", "ANNOTATES").join(ids.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"))
    rows = g.attach(out.unionByName(back).distinct(), "label", "name", "description")
    return rows.groupBy("name").agg(F.min(F.struct("label", "description")).alias("m")).select(F.col("m.label").alias("type"), "name", "m.description")


def diff_report(g: Graph, ranges: DataFrame, new_files: DataFrame | None = None, depth: int = 2) -> DataFrame:
    """Changed symbols with status new or changed (by whether the file is new) and the number of nodes in
    each one's blast radius; one traversal keyed by root serves them all."""
    symbols = g.of(*SYMBOLS).select("id", "label", "name", "file_path", "line_start", "line_end")
    hit = changed_symbols(symbols, ranges)
    ids = symbols.select("id", "name", "file_path").join(hit.select("name", "file_path"), ["name", "file_path"])
    blast = reach(g, ids.select("id"), ("CALLS", "REFERENCES", "INHERITS", "IMPLEMENTS", "ANNOTATES"), depth, per_root=True)
    n = blast.groupBy(F.col("root").alias("id")).agg(F.countDistinct("id").alias("n"))
    per = ids.join(n, "id", "left").groupBy("name", "file_path").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("blast"))
    status = F.lit("changed")
    out = hit.join(per, ["name", "file_path"])
    if new_files is not None:
        out = out.join(new_files.select("file_path", F.lit(True).alias("is_new")).distinct(), "file_path", "left")
        status = F.when(F.col("is_new"), "new").otherwise("changed")
    return out.select("name", "file_path", "label", "line_start", status.alias("status"), "blast")


SEVERITY: dict[str, str] = {"critical": "error", "warning": "warning"}


def _severity(col: str) -> Column:
    raw = F.lower(F.trim(col))
    out = F.lit("suggestion")
    for k, v in SEVERITY.items():
        out = F.when(raw == k, v).otherwise(out)
    return out


def review(g: Graph, changed: DataFrame, files: DataFrame | None = None, symbols: int = 100, comments: int = 5) -> DataFrame:
    """(symbol, file_path, severity, title, body, knowledge_ref, knowledge_type, confidence).

    For each changed symbol, at most ``comments`` of: rules that govern it (1.0), accepted decisions of its
    domain (0.7), a note if nothing is known about it (0.5); for each changed file, up to ten nodes that
    govern or annotate its symbols (0.6).  Of one (symbol, reference) the most confident stays.
    """
    ids = _ids(g, changed.orderBy("name", "file_path").limit(symbols))
    text = F.coalesce("rationale", "description", F.lit("")).alias("body")
    rule = g.of("Rule").select(F.col("id").alias("src"), F.col("name").alias("ref"), _severity("severity").alias("severity"), text)
    rules = g.links("GOVERNS").join(rule, "src").join(ids.withColumnRenamed("id", "dst"), "dst").select("symbol", "symbol_file", "severity", F.concat(F.lit("Rule '"), "ref", F.lit("' governs this symbol")).alias("title"), "body", "ref", F.lit("Rule").alias("kind"), F.lit(1.0).alias("confidence"), F.lit(1).alias("pass"))
    rules = ranked(rules.distinct(), ["symbol", "symbol_file"], 10, "ref")
    inside = g.links("BELONGS_TO").select("src", F.col("dst").alias("domain_id"))
    decision = g.of("Decision").where("status = 'accepted'").select(F.col("id").alias("src"), F.col("name").alias("ref"), text)
    decided = inside.join(decision, "src").drop("src")
    mine = inside.join(ids.withColumnRenamed("id", "src"), "src").select("symbol", "symbol_file", "domain_id")
    adrs = mine.join(decided, "domain_id").select("symbol", "symbol_file", F.lit("suggestion").alias("severity"), F.concat(F.lit("ADR '"), "ref", F.lit("' applies to this domain")).alias("title"), "body", "ref", F.lit("Decision").alias("kind"), F.lit(0.7).alias("confidence"), F.lit(2).alias("pass"))
    adrs = ranked(adrs.distinct(), ["symbol", "symbol_file"], 5, "ref")
    known = g.links("GOVERNS", "ANNOTATES", "DOCUMENTS").select(F.col("dst").alias("id"))
    bare = ids.join(known, "id", "left_anti").select("symbol", "symbol_file").distinct()
    bare = bare.select("symbol", "symbol_file", F.lit("suggestion").alias("severity"), F.lit("No knowledge links found for this symbol").alias("title"), F.lit("Consider a rule, a decision or a page that covers this symbol.").alias("body"), F.lit("").alias("ref"), F.lit("").alias("kind"), F.lit(0.5).alias("confidence"), F.lit(3).alias("pass"))
    rows = ranked(rules.unionByName(adrs).unionByName(bare), ["symbol", "symbol_file"], comments, "pass", "ref")
    if files is not None:
        f = g.of("File").join(files.select("path").distinct(), "path").select(F.col("id").alias("src"), "path")
        held = g.links("CONTAINS").join(f, "src").select(F.col("dst").alias("node"), "path")
        by = g.links("GOVERNS", "ANNOTATES").join(held, F.col("dst") == F.col("node")).select(F.col("src").alias("id"), "path").distinct()
        notes = g.attach(by, "label", "name", "rationale", "description").select(F.lit("").alias("symbol"), F.col("path").alias("symbol_file"), F.lit("suggestion").alias("severity"), F.concat(F.lit("File touches symbol governed by '"), "name", F.lit("'")).alias("title"), text, F.col("name").alias("ref"), F.col("label").alias("kind"), F.lit(0.6).alias("confidence"), F.lit(4).alias("pass"))
        rows = rows.unionByName(ranked(notes.distinct(), ["symbol_file"], 10, "ref"))
    best = ranked(rows.where("ref <> ''"), ["symbol", "ref"], 1, F.desc("confidence"), "pass", "symbol_file")
    out = best.unionByName(rows.where("ref = ''"))
    return out.select("symbol", F.col("symbol_file").alias("file_path"), "severity", "title", "body", F.col("ref").alias("knowledge_ref"), F.col("kind").alias("knowledge_type"), "confidence")


def tested(g: Graph, ids: DataFrame, depth: int = 2) -> DataFrame:
    """Ids that a test reaches within ``depth`` calls: named test_*, or in a file with test in its path."""
    up = reach(g, ids, ["CALLS"], depth, "in", per_root=True)
    tests = g.nodes.where(F.col("name").startswith("test_") | F.coalesce(F.col("file_path").contains("test"), F.lit(False))).select("id")
    return up.join(tests, "id", "left_semi").select(F.col("root").alias("id")).distinct()


def release_check(g: Graph, changed: DataFrame, most: int = 50) -> DataFrame:
    """(check, severity, symbol, file_path, detail): an info line for each changed symbol, a warning where
    no test reaches it, a warning for each knowledge link that may be stale, and the owners to ask."""
    ids = _ids(g, changed.orderBy("name", "file_path").limit(most))
    lab = lambda df, check, severity, detail: df.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), "symbol", F.col("symbol_file").alias("file_path"), detail.alias("detail"))
    info = lab(ids.select("symbol", "symbol_file").distinct(), "changed_symbol", "info", F.lit(""))
    bare = lab(ids.join(tested(g, ids.select("id")), "id", "left_anti").select("symbol", "symbol_file").distinct(), "missing_test", "warning", F.lit("no test reaches it"))
    back = g.links("GOVERNS", "ANNOTATES", "DOCUMENTS").join(ids.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), "symbol", "symbol_file")
    stale = lab(g.attach(back, "name").select("symbol", "symbol_file", "name").distinct(), "stale_doc", "warning", F.col("name"))
    own = g.links("ASSIGNED_TO").join(ids.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), "symbol", "symbol_file")
    asked = lab(g.attach(own, "name").select("symbol", "symbol_file", "name").distinct(), "owner", "info", F.col("name"))
    return info.unionByName(bare).unionByName(stale).unionByName(asked)


def rename_preview(g: Graph, old: str) -> DataFrame:
    """One row: nodes of the name, their distinct files, and edges at them (a loop once)."""
    ids = g.root(old)
    files = g.attach(ids, "file_path").agg(F.count("*").alias("nodes"), F.array_sort(F.collect_set("file_path")).alias("files"))
    touching = hops(g.links(), "both").join(ids.withColumnRenamed("id", "a"), "a").agg(F.count("*").alias("edges"))
    return files.withColumn("one", F.lit(1)).join(touching.withColumn("one", F.lit(1)), "one").drop("one")


def apply_rename(g: Graph, old: str, new: str) -> Graph:
    name = F.when(F.col("name") == old, F.lit(new)).otherwise(F.col("name"))
    return Graph(g.nodes.withColumn("name", name), g.edges)


def task_pack(g: Graph, roots: DataFrame, depth: int = 2) -> DataFrame:
    """(section, type, name, file_path): target, callers, callees, knowledge (20), owners (10), tests (15)."""
    roots = roots.select("id").distinct()
    show = lambda df, s: df.select(F.lit(s).alias("section"), F.col("label").alias("type"), "name", F.coalesce("file_path", F.lit("")).alias("file_path")).distinct()
    cols = ("label", "name", "file_path")
    target = show(g.attach(roots, *cols), "target").orderBy("name", "file_path").limit(1)
    callers = reach(g, roots, ["CALLS"], depth, "in").select("id")
    parts = [target, show(g.attach(callers, *cols), "callers"), show(g.attach(reach(g, roots, ["CALLS"], depth).select("id"), *cols), "callees")]
    known = g.links("GOVERNS", "ANNOTATES", "DOCUMENTS").join(roots.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"))
    known = known.unionByName(g.links("IMPLEMENTS", "ANNOTATES").join(roots.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"))).distinct()
    parts.append(show(g.attach(known, *cols), "knowledge").orderBy("type", "name", "file_path").limit(20))
    own = g.links("ASSIGNED_TO").join(roots.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"))
    parts.append(show(g.attach(own, *cols), "owners").orderBy("name").limit(10))
    name, file = F.col("name"), F.coalesce("file_path", F.lit(""))
    tests = g.attach(reach(g, roots, ["CALLS"], 2, "in").select("id"), *cols).where(name.startswith("test_") | name.endswith("Test") | file.contains("test"))
    parts.append(show(tests, "tests").orderBy("name", "file_path").limit(15))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pack_for_file(g: Graph, path: str) -> DataFrame:
    """A task pack of a file: its symbols, their knowledge and tests, and the file's own owners."""
    file = g.of("File").where(F.col("path") == path).select("id")
    inside = g.links("CONTAINS").join(file.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"))
    pack = task_pack(g, inside).where("section <> 'target' AND section <> 'owners'")
    target = g.attach(file, "label", "name", "path").select(F.lit("target").alias("section"), F.col("label").alias("type"), "name", F.col("path").alias("file_path"))
    own = g.links("ASSIGNED_TO").join(file.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"))
    who = g.attach(own, "label", "name").select(F.lit("owners").alias("section"), F.col("label").alias("type"), "name", F.lit("").alias("file_path"))
    return target.unionByName(pack).unionByName(who)


def snapshot_blast(g: Graph, added: DataFrame, depth: int = 2) -> DataFrame:
    """Blast radius of symbols that a newer snapshot adds."""
    return blast_radius(g, _ids(g, added).select("id").distinct(), depth)
