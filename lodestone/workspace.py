"""Every operator on a graph by its name: a registry read off the operators themselves, and a graph to run them on."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from .operators import context, drift, impact, intelligence, lenses, review, security, store, structure
from .plans import cypher
from .plans.graph import Graph
from .sources import code

_HOMES = (context, impact, structure, drift, review, lenses, intelligence)


@lru_cache(maxsize=1)
def operations() -> dict[str, Callable[..., DataFrame]]:
    """Operators by name: the public functions that take a graph, and perhaps roots in it, and give rows.  An operator whose
    name an earlier module has goes by its module's name as well, as ``drift.check``."""
    found: dict[str, Callable[..., DataFrame]] = {"cypher": cypher.run, "sql": security.guarded_sql}
    for home in _HOMES:
        own = home.__name__.rsplit(".", 1)[-1]
        for name, f in vars(home).items():
            if name.startswith("_") or not inspect.isfunction(f) or f.__module__ != home.__name__:
                continue
            parameters = list(inspect.signature(f).parameters.values())
            plain = all(p.annotation != "DataFrame" or p.name == "roots" or p.default is not p.empty for p in parameters[1:])
            if parameters and parameters[0].annotation == "Graph" and plain and inspect.signature(f).return_annotation == "DataFrame":
                found[f"{own}.{name}" if name in found else name] = f
    return found


class Workspace:
    """A graph and the operations on it."""

    def __init__(self, spark: SparkSession, graph: Graph):
        self.spark, self.graph = spark, graph

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Workspace:
        return cls(spark, store.load(spark, path))

    @classmethod
    def ingest(cls, spark: SparkSession, root: str, **options) -> Workspace:
        return cls(spark, code.ingest(spark, root, **options)[0])

    def save(self, path: str) -> None:
        store.save(self.graph, path)

    def run(self, operation: str, *arguments, file: str = "", **options) -> DataFrame:
        """The rows of an operation.  Where it wants roots, a name, and perhaps its ``file``, stands for the nodes
        that have it."""
        f = operations().get(operation)
        if f is None:
            raise ValueError(f"no operation {operation!r}; there are {', '.join(sorted(operations()))}")
        wants = list(inspect.signature(f).parameters)[1:]
        given = list(arguments)
        if wants[:1] == ["roots"] and given and isinstance(given[0], str):
            given[0] = self.graph.root(given[0], file)
        elif file:
            options["file_path" if "file_path" in wants else "file"] = file
        return f(self.graph, *given, **options)
