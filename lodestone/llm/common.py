"""Plumbing shared by the training-data operators: tables, shared storage, Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import settle

#: Rows and bytes of one Arrow batch that goes to a Python worker; texts may be long, so few.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20
#: Bytes of text that a vectorised kernel works on at a time; longer texts go in parts where their operator
#: knows places to cut at.
SLICE_BYTES = 1 << 20
#: Rows of which a table that grows with the input may be broadcast; a larger one is joined by sort and merge.
BROADCAST_ROWS = 20_000
_ODD = 0x9E3779B97F4A7C15
_power_tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small for columns of texts.  Session settings, read when a plan runs; a smaller
    value that is set already stays."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = re.fullmatch(r"(\d+)b?", spark.conf.get(key))
        if not (now and 0 < int(now[1]) <= most):
            spark.conf.set(key, str(most))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd number and of its inverse, modulo 2 to the 64: a sum of values
    times powers, times the inverse at its first place, is a hash that doesn't depend on the place."""
    if len(_power_tables[0]) < n:
        size = max(n, 2 * len(_power_tables[0]), 1 << 16)
        for k, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            run = np.full(size, base, np.uint64)
            run[0] = 1
            _power_tables[k] = np.multiply.accumulate(run)
    return _power_tables[0][:n], _power_tables[1][:n]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """``settle`` under the name that the operators here have for it."""
    return settle(df, label)


def joinable(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which has at most ``rows`` rows, as the side of a join: Spark's threshold of broadcasts is one of
    bytes as stored, which the driver holds several times as large, and for each join of a plan at once."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


def slices(sizes: Iterable[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes sum to ``limit`` at most, or hold one item."""
    start = total = 0
    end = 0
    for end, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, end
            start, total = end, 0
        total += n
    if start <= end and total >= 0:
        yield start, end + 1


def parts_of(texts: list, gap: re.Pattern, limit: int = SLICE_BYTES) -> tuple[list, list[int]]:
    """(texts in parts of about ``limit``, cut before the next match of ``gap``; number of each part's text)."""
    out, owner = [], []
    for i, t in enumerate(texts):
        at = 0
        while len(t) - at > limit:
            m = gap.search(t, at + limit)
            if not m:
                break
            out.append(t[at : m.start()]), owner.append(i)
            at = m.start()
        out.append(t[at:] if at else t), owner.append(i)
    return out, owner


def byte_column(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """A string column's values as UTF-8 bytes, without decoding them."""
    col = batch.column(batch.schema.get_field_index(name))
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return col.cast(kind).to_pylist()


@lru_cache(maxsize=8)
def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; the files are never copied."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
