import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(folder / "warehouse"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from lodestone import to_workers

    to_workers(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """A graph of (label, name, {property: value}) nodes, numbered from 0, and (src, dst, type) edges."""
    from lodestone.operators.store import conform
    from lodestone.plans.graph import NODE_COLUMNS, Graph

    def build(nodes, edges):
        schema = ", ".join(f"{c} {t}" for c, t in NODE_COLUMNS.items())
        rows = [tuple({"id": i, "label": n[0], "name": n[1], **(n[2] if len(n) > 2 else {})}.get(c) for c in NODE_COLUMNS) for i, n in enumerate(nodes)]
        return Graph(conform(spark.createDataFrame(rows, schema), NODE_COLUMNS), spark.createDataFrame(edges or [(-1, -1, "")], "src bigint, dst bigint, type string").where("src >= 0"))

    return build
