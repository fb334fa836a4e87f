"""Command line: ``python -m lodestone GRAPH OPERATION [ARGUMENT ...] [--option value ...]``.

``operations`` in place of an operation lists them; ``ingest ROOT`` makes the graph, ``export FILE`` writes it in
the interchange form.
"""

from __future__ import annotations

import inspect
import sys

from pyspark.sql import SparkSession

from .sources import graph_files
from .workspace import Workspace, operations


def _value(text: str) -> object:
    return int(text) if text.lstrip("-").isdigit() else {"true": True, "false": False}.get(text.lower(), text)


def _split(words: list[str]) -> tuple[list[object], dict[str, object]]:
    """Arguments, and options with what follows each."""
    plain: list[object] = []
    options: dict[str, object] = {}
    rest = iter(words)
    for w in rest:
        if w.startswith("--"):
            options[w[2:].replace("-", "_")] = _value(next(rest, ""))
        else:
            plain.append(_value(w))
    return plain, options


def main(argv: list[str] | None = None) -> int:
    words = sys.argv[1:] if argv is None else argv
    if len(words) < 2:
        print(__doc__)
        return 2
    path, operation, *more = words
    if operation == "operations":
        for name, f in sorted(operations().items()):
            print(f"{name}{inspect.signature(f)}: {(f.__doc__ or '').strip().splitlines()[0] if f.__doc__ else ''}")
        return 0
    arguments, options = _split(more)
    spark = SparkSession.builder.appName("lodestone").getOrCreate()
    if operation == "ingest":
        Workspace.ingest(spark, str(arguments[0]), **options).save(path)
        return 0
    w = Workspace.open(spark, path)
    if operation == "export":
        print(graph_files.export_kg(w.graph, str(arguments[0])))
        return 0
    w.run(operation, *arguments, **options).show(200, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
