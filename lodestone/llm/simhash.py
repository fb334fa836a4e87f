"""SimHash near-dedup with deletion-variant signatures."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_column, joinable, materialize, parts_of, small_batches
from .components import connected_components

#: Segments of the 64 bits as (lowest bit, width).  Four differing bits over three segments leave
#: one segment with at most one.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
MAX_BITS = 4
_SEED = 42
_BLANK = re.compile(rb"[\x09-\x0d ]")


def _count(shingles: list[bytes], ones: np.ndarray) -> int:
    """Add the set bits of the shingles' hashes to ``ones``; how many shingles there are."""
    hashes = [xxhash.xxh64_intdigest(x, _SEED) for x in shingles]
    for k in range(0, len(hashes), 1 << 16):
        block = np.array(hashes[k : k + (1 << 16)], np.uint64)
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return len(hashes)


def fingerprint(data: bytes | None, width: int = 4) -> int:
    """Signed 64-bit SimHash of the word shingles of a UTF-8 text.  No words: 0."""
    words: list[bytes] = []
    ones, total = np.zeros(64, np.int64), 0
    for part in parts_of([data or b""], _BLANK)[0]:
        words += part.lower().split()  # bytes: lowers A-Z, splits at x20, x09-x0D
        if len(words) < width:
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        line = b" ".join(words)
        total += _count([line[i:j] for i, j in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)], ones)
        words = words[len(words) - width + 1 :]  # those that the next part's first shingles begin with
    if not total and words:
        total = _count([b" ".join(words)], ones)
    if not total:
        return 0
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp) of every row, whole texts; null text counts as no words."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x, width) for x in byte_column(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def _variants() -> F.Column:
    """One key for each (segment, wildcard position): its number above the masked segment's bits."""
    keys = []
    for low, width in SEGMENTS:
        for bit in range(low, low + width):
            mask = ((1 << width) - 1) << low & ~(1 << bit)
            cut = F.shiftrightunsigned(F.col("fp").bitwiseAND(F.lit(_signed(mask))), low)
            keys.append(cut.bitwiseOR(F.lit(bit << 32)))
    return F.array(*keys)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _first_shared(x: str) -> str:
    """SQL for the number of the first variant that two fingerprints with difference ``x`` share."""
    cases = []
    for low, width in SEGMENTS:
        part = f"({x} & {_signed(((1 << width) - 1) << low)}L)"
        cases.append(f"WHEN {part} = 0 THEN {low} WHEN bit_count({part}) = 1 THEN cast(round(log2(abs(cast({part} AS double)))) AS int)")
    return f"CASE {' '.join(cases)} END"


def links(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of class representatives whose fingerprints differ in at most four bits.

    ``classes`` holds distinct ``fp`` with ``rep``.  Every fingerprint is indexed under 64
    one-wildcard variants of its three segments; fingerprints that meet under a key are compared
    inside the join, and a pair is emitted under its first shared variant alone, so once.  Spark takes
    an exploded table for as small as it was before, so the join is told to sort and merge: a broadcast
    would hold all 64 rows of each fingerprint in the driver.
    """
    index = classes.select("fp", "rep", F.explode(_variants()).alias("key"))
    left, right = index.alias("l"), index.alias("r")
    near = F.expr(f"l.key = r.key AND l.fp < r.fp AND bit_count(l.fp ^ r.fp) <= {MAX_BITS} AND shiftright(l.key, 32) = {_first_shared('(l.fp ^ r.fp)')}")
    return left.join(right.hint("merge"), near).select(F.col("l.rep").alias("a"), F.col("r.rep").alias("b"))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint, component_id) for every row of ``docs``.

    Links hold between fingerprints that differ in at most four bits, equal ones included; a
    component is named by the smallest id reachable.  Null or empty texts (no words) have
    fingerprint zero and link like any other.  Rows that share an id are one node.  A row whose id
    is null keeps its fingerprint and gets a null component, and links nothing.  Other columns are
    not looked at, so clashing names do no harm.  An empty table gives an empty result.
    """
    rows = materialize(fingerprints(docs, id_col, text_col), "simhash")
    classes = rows.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("rep"))
    # rows that share an id but not a text join their classes too
    shared = rows.where("id IS NOT NULL").groupBy("id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y")
    shared, classes = materialize(shared.select("id"), "shared"), materialize(classes, "classes")
    few, n = shared.count(), classes.count()
    edges = links(classes)
    if few:
        twin = rows.join(joinable(shared, few), "id").join(joinable(classes, n), "fp")
        edges = edges.unionByName(twin.select(F.col("id").alias("a"), F.col("rep").alias("b")))
    comp = joinable(connected_components(edges), n + few)
    label = classes.join(comp, classes["rep"] == comp["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(joinable(label, n), "fp", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"),
    )
