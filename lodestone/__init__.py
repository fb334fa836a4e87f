"""A property-graph analytics engine on PySpark."""

from __future__ import annotations

from pathlib import Path


def to_workers(spark) -> None:
    """Let Python workers find this package where it lies for the driver, as on a shared or local disk;
    elsewhere it has to be installed or shipped with the job."""
    here = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    if here not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (here, env.get("PYTHONPATH", "")) if x)
