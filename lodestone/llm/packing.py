"""Sequence packing by minimum bin slack.

Documents become runs of token ids; full windows are cut off first, and what remains of each document
is packed: every window takes the longest remaining piece and the multiset of lengths that comes
closest to the room left, found by a subset-sum program over bitsets.  Where some slack is left, one
more piece is cut to fit it, so windows have none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches
from .wordbpe import encoder

WINDOW = 4096
END_ID = 2
#: Pieces that are packed together: the memory bound of one packing task.
GROUP_PIECES = 40_000
_SPAN = 1 << 40  # sequence numbers of one group
_PIECE = ["id", "mark", "row", "start", "length", "crc", "doc_tokens", "sequence_id", "offset"]


def best_fill(counts: np.ndarray, room: int, lengths: list[int]) -> dict[int, int]:
    """How many pieces of each length fill ``room`` best (fullest), never over it.

    ``lengths`` lists lengths in falling order, ``counts[l]`` says how many there are.  The set of
    reachable sums is one integer's bits; a length of c pieces enters as 1, 2, 4, ... of them, and the
    bits before each step are kept to trace the best sum back.
    """
    mask = (1 << (room + 1)) - 1
    bits, steps = 1, []
    for length in lengths:
        if length > room:
            continue
        left, many = min(int(counts[length]), room // length), 1
        while left > 0:
            many = min(many, left)
            steps.append((length, many, bits))
            bits |= (bits << (length * many)) & mask
            left -= many
            many *= 2
        if bits >> room & 1:
            break
    total, use = bits.bit_length() - 1, {}
    for length, many, before in reversed(steps):
        if not before >> total & 1:
            total -= length * many
            use[length] = use.get(length, 0) + many
    return use


def pack(lengths: np.ndarray, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (piece, start in the piece, length), filled from pieces of these lengths.

    All windows hold exactly ``window`` tokens but the last pieces', which make sequences of powers of
    two.  No piece is longer than ``window``.
    """
    out: list[list[tuple[int, int, int]]] = []
    stacks: dict[int, list[tuple[int, int]]] = {}
    for i, n in enumerate(lengths.tolist()):
        stacks.setdefault(n, []).append((i, 0))
    stacks.pop(0, None)
    out += [[(i, 0, window)] for i, _ in stacks.pop(window, [])]
    counts = np.zeros(window + 1, np.int64)
    for n, s in stacks.items():
        counts[n] = len(s)
    live = sorted(stacks, reverse=True)

    def take(n: int) -> tuple[int, int, int]:
        i, start = stacks[n].pop()
        counts[n] -= 1
        return i, start, n

    while live:
        first = live[0]
        counts[first] -= 1
        use = best_fill(counts, window - first, live)
        counts[first] += 1
        use[first] = use.get(first, 0) + 1
        slack = window - sum(n * k for n, k in use.items())
        times = 1 if slack else min(counts[n] // k for n, k in use.items())
        for _ in range(int(times)):
            row = [take(n) for n, k in sorted(use.items(), reverse=True) for _ in range(k)]
            if slack:
                rest = next((n for n in live if counts[n]), 0)  # longer than the slack, else it would be in
                if rest:
                    i, start, _n = take(rest)
                    row.append((i, start, slack))
                    tail = rest - slack
                    if tail not in stacks or not counts[tail]:
                        live = sorted({*live, tail}, reverse=True)
                    stacks.setdefault(tail, []).append((i, start + slack))
                    counts[tail] += 1
                else:
                    out += powers_of_two(row)
                    row = []
            if row:
                out.append(row)
        live = [n for n in live if counts[n]]
    return out


def powers_of_two(row: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The same tokens as sequences whose lengths are the powers of two that add up to theirs."""
    out, rest = [], sum(n for _, _, n in row)
    pieces = list(reversed(row))
    while rest:
        room = 1 << (rest.bit_length() - 1)
        rest -= room
        part = []
        while room:
            i, start, n = pieces.pop()
            k = min(n, room)
            part.append((i, start, k))
            room -= k
            if k < n:
                pieces.append((i, start + k, n - k))
        out.append(part)
    return out


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def token_runs(texts: list[str | None], vocabulary: str) -> list[np.ndarray]:
    """The ids of each text with the end id after them; null is as empty."""
    return [np.append(x, np.uint32(END_ID)) for x in encoder(vocabulary).encode([t or "" for t in texts])]


def pieces(docs: DataFrame, id_col: str, text_col: str, window: int, vocabulary: str) -> DataFrame:
    """Every document's full windows and the rest of it, as (id, mark, row, start, length, crc, doc_tokens).
    ``mark`` is a hash of the text, which tells texts of one id apart, and ``row`` numbers the rows."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, start, length, crc, size = [], [], [], [], []
            for i, ids in enumerate(token_runs(batch.column(3).to_pylist(), vocabulary)):
                for a in range(0, len(ids), window):
                    part = ids[a : a + window]
                    rows.append(i), start.append(a), length.append(len(part)), crc.append(_crc(part)), size.append(len(ids))
            of = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(of) for k in range(3)), *(pa.array(x, pa.int64()) for x in (start, length, crc, size))], _PIECE[:7])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("mark"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in _PIECE[:7]))


def _pack_group(window: int):
    """Packs one group, as Arrow throughout: a column of ids with a null in it stays exact."""

    def run(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by([(c, "ascending") for c in ("id", "mark", "row", "start")])
        rows, at, size, seq, offset = [], [], [], [], []
        for number, row in enumerate(pack(part["length"].to_numpy(), window)):
            place = 0
            for i, start, n in row:
                rows.append(i), at.append(start), size.append(n), seq.append(number), offset.append(place)
                place += n
        out = part.take(pa.array(rows, pa.int64()))
        size, seq = np.array(size, np.int64), np.array(seq, np.int64)
        cut = out["length"].to_numpy() != size
        crc = pa.array(out["crc"].to_numpy(), pa.int64(), mask=cut)
        start = out["start"].to_numpy() + np.array(at, np.int64)
        new = {"start": start, "length": size, "crc": crc, "sequence_id": key[0].as_py() * _SPAN + seq, "offset": np.array(offset, np.int64)}
        return pa.table([pa.array(new[c]) if c in new else out[c] for c in _PIECE], names=_PIECE)

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """One row for each piece: (id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Pieces are packed in groups of about ``GROUP_PIECES`` dealt by a hash of row number and place, so
    repeated rows are spread too and no task holds more; every group leaves one window at most unfilled,
    which is cut into powers of two.  Pieces that were
    cut (few for each group, unless lengths don't fit) are encoded once more for their checksum.
    Null text is as empty: one end id.  A row with a null id is packed under that null.  Repeated rows
    are packed each.  An empty table gives an empty result; further columns aren't looked at.
    """
    base = materialize(pieces(docs, id_col, text_col, window, vocabulary), "pieces")
    groups = max(1, -(-base.count() // GROUP_PIECES))
    keyed = base.withColumn("g", F.pmod(F.xxhash64("row", "start", F.lit(5)), F.lit(groups)))
    packed = materialize(keyed.groupBy("g").applyInArrow(_pack_group(window), ", ".join(f"{c} long" for c in _PIECE)), "packed")
    cut = packed.where("crc IS NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts, crcs = batch.column(3).to_pylist(), []
            for ids, own in zip(token_runs(batch.column(2).to_pylist(), vocabulary), cuts, strict=True):
                crcs.append([{**c, "crc": _crc(ids[c["start"] : c["start"] + c["length"]])} for c in own])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crcs, kind)], ["id", "mark", "cuts"])

    wanted = materialize(cut.groupBy("id", "mark").agg(F.collect_set(F.struct("start", "length")).alias("cuts")), "cuts")  # a table of known size
    text = docs.select(F.col(id_col).cast("long").alias("d"), F.xxhash64(text_col).alias("m"), F.col(text_col).alias("text"))
    again = text.join(wanted, F.col("d").eqNullSafe(F.col("id")) & (F.col("m") == F.col("mark"))).select("id", "mark", "text", "cuts")
    again = again.mapInArrow(run, "id long, mark long, cuts array<struct<start long, length long, crc long>>")
    again = again.select("id", "mark", F.explode("cuts").alias("c")).select(F.col("id").alias("i"), F.col("mark").alias("m"), F.col("c.start").alias("s"), F.col("c.length").alias("n"), F.col("c.crc").alias("new")).distinct()
    fits = F.col("id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m")) & (F.col("start") == F.col("s")) & (F.col("length") == F.col("n"))
    mended = cut.join(again, fits).withColumn("crc", F.col("new")).select(*packed.columns)
    out = packed.where("crc IS NOT NULL").unionByName(mended)
    return out.select(F.col("id").alias(id_col), "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
