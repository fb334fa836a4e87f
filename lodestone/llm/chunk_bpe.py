"""Byte-level BPE by content-defined chunks: what documents share is encoded once by a worker, joins are repaired.

A rolling hash over the last code points cuts a text where the hash says so, so equal passages give equal
chunks wherever they stand.  A worker keeps the ids of the chunks it has met.  Chunks are encoded by
themselves, so around a join ids may be wrong: a window over the join is encoded anew, and ids are taken from
it up to a place where both the window and the chunk after the join begin a pre-token; from there on the
chunk's own ids hold.  Where a window reaches no such place, the two chunks become one and are encoded again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import powers, slices, small_batches
from .wordbpe import SLICE_CHARS, ByteEncoder, byte_encoder

#: Code points the rolling hash sees, and least, usual and most code points of a chunk.
WINDOW, LEAST, USUAL, MOST = 32, 64, 512, 4096
#: Code points of the chunk after a join that its window takes in.
AHEAD = 48
#: A pre-token is settled if the code point after it is known, and this many from its beginning on: the
#: longest contraction.
SIGHT = 3
#: Code points of chunks that a worker keeps: those met since the last turn-over and those met before it.
KEPT_CHARS = 16 << 20


def cut_points(text: str, window: int = WINDOW, least: int = LEAST, usual: int = USUAL, most: int = MOST, stretch: int = 1 << 18) -> list[int]:
    """Where chunks of ``text`` end, the last at its end.  A place is a candidate if the hash of the ``window``
    code points before it has its upper bits zero; chunks shorter than ``least`` are not cut, longer than
    ``most`` always."""
    bits = usual.bit_length() - 1
    found: list[np.ndarray] = []
    for at in range(0, len(text), stretch):
        first = max(0, at - window)
        code = np.frombuffer(text[first : at + stretch].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        code += np.uint64(1)
        code *= np.uint64(0xD6E8FEB86659FD93)
        code ^= code >> np.uint64(32)
        code *= np.uint64(0xD6E8FEB86659FD93)
        power, inverse = powers(len(code))
        total = np.cumsum(code * power, dtype=np.uint64)
        hashed = total.copy()
        if len(code) > window:
            hashed[window:] -= total[:-window]
            hashed[window:] *= inverse[1 : len(code) - window + 1]
        hashed ^= hashed >> np.uint64(29)
        hashed *= np.uint64(0xBF58476D1CE4E5B9)
        place = np.nonzero(hashed >> np.uint64(64 - bits) == 0)[0] + first + 1
        found.append(place[place > at])
    ends, last = [], 0
    for p in [*np.concatenate(found).tolist(), len(text)] if found else []:
        while p - last > most:
            last += most
            ends.append(last)
        if p - last >= least and p < len(text):
            ends.append(p)
            last = p
    return [*ends, len(text)] if last < len(text) else ends


@dataclass(slots=True)
class Chunk:
    """A chunk encoded by itself.  ``begins`` are the pre-tokens' places, and the chunk's length; ``at`` how many
    ids lie before each."""

    text: str
    ids: np.ndarray
    begins: np.ndarray
    at: np.ndarray

    def open(self) -> int:
        """The first pre-token that text after the chunk might change."""
        n = len(self.text)
        k = len(self.begins) - 2  # the last one always may
        while k and self.begins[k - 1] + SIGHT > n:
            k -= 1
        return k


@dataclass(slots=True)
class _Run:
    """A text between special tokens: its chunks, and for each join the ids of its window and the pre-token of
    the chunk after it that they reach (None: not found yet)."""

    chunks: list[Chunk]
    joins: list[tuple[np.ndarray, int] | None] = field(default_factory=list)

    def ids(self) -> list[np.ndarray]:
        out, start = [], 0
        for chunk, join in zip(self.chunks, self.joins, strict=False):
            out += [chunk.ids[chunk.at[start] : chunk.at[chunk.open()]], join[0]]
            start = join[1]
        return [*out, self.chunks[-1].ids[self.chunks[-1].at[start] :]] if self.chunks else out


class ChunkCoder:
    """Encodes lists of texts by chunks and decodes ids; one for each worker and vocabulary."""

    def __init__(self, encoder: ByteEncoder, kept_chars: int = KEPT_CHARS):
        self.encoder, self.kept_chars = encoder, kept_chars
        self.young: dict[str, Chunk] = {}
        self.old: dict[str, Chunk] = {}
        self.chars = self.met = self.encoded = 0
        added = encoder.whole.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
            raise ValueError("added tokens have to stand for their plain strings")
        self.special = {t.content: i for i, t in added.items()}
        self.between = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if added else None
        self._byte_table()

    def _byte_table(self) -> None:
        """The bytes of every id, one after the other."""
        byte = {c: b for b, c in enumerate(self.encoder.letters)}
        whole = self.encoder.whole
        pieces = []
        for i in range(max(whole.get_vocab(with_added_tokens=True).values()) + 1):
            token = whole.id_to_token(i) or ""
            pieces.append(bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode())
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.length = np.array([len(x) for x in pieces], np.int64)
        self.begin = np.cumsum(self.length) - self.length

    # -- chunks

    def _fresh(self, texts: list[str]) -> list[Chunk]:
        """Each text as a chunk, encoded now."""
        out: list[Chunk] = []
        for a, b in slices([len(x) for x in texts], SLICE_CHARS):
            begins, slot, edges, ends = self.encoder.lookup(texts[a:b])
            ids = self.encoder.texts(begins, slot, edges)
            cuts = np.searchsorted(begins, edges)
            counts = self.encoder.count[slot] if len(slot) else slot
            for i, text in enumerate(texts[a:b]):
                mine = slice(cuts[i], cuts[i + 1])
                place = np.append(begins[mine] - edges[i], len(text)).astype(np.int32)
                out.append(Chunk(text, ids[i], place, np.concatenate(([0], np.cumsum(counts[mine]))).astype(np.int32)))
        self.encoded += sum(map(len, texts))
        return out

    def _chunks(self, texts: list[str]) -> list[Chunk]:
        """Each text as a chunk, encoded if it isn't known."""
        found: dict[str, Chunk] = {}
        new: list[str] = []
        for t in texts:
            if t in found:
                continue
            known = self.young.get(t)
            if known is None and (known := self.old.pop(t, None)) is not None:
                self._keep(known)
            found[t] = known
            if known is None:
                new.append(t)
        for chunk in self._fresh(new):
            found[chunk.text] = chunk
            self._keep(chunk)
        return [found[t] for t in texts]

    def _keep(self, chunk: Chunk) -> None:
        if self.chars > self.kept_chars // 2:
            self.old, self.young, self.chars = self.young, {}, 0
        self.young[chunk.text] = chunk
        self.chars += len(chunk.text)

    # -- joins

    def _try(self, joins: list[tuple[_Run, int]]) -> list[bool]:
        """Encode a window over each join; True where it agrees with the chunk after it."""
        heads, windows = [], []
        for run, k in joins:
            a, b = run.chunks[k], run.chunks[k + 1]
            head = a.text[a.begins[a.open()] :]
            heads.append(len(head))
            windows.append(head + b.text[:AHEAD])
        ok = []
        for (run, k), head, w in zip(joins, heads, self._fresh(windows), strict=True):
            b = run.chunks[k + 1]
            whole = len(b.text) <= AHEAD and k + 2 == len(run.chunks)  # nothing follows the window
            settled = w.begins if whole else w.begins[: w.open() + 1]
            place = np.searchsorted(b.begins, settled - head)
            agree = np.nonzero((settled >= head) & (b.begins[np.minimum(place, len(b.begins) - 1)] == settled - head))[0]
            found = None
            if len(agree):
                j = int(agree[0])
                if k + 2 == len(run.chunks) or place[j] <= b.open():
                    found = (w.ids[: w.at[j]], int(place[j]))
            run.joins[k] = found
            ok.append(found is not None)
        return ok

    def _repair(self, runs: list[_Run]) -> None:
        """Settle all joins; chunks that don't agree are put together and encoded again."""
        work = [(run, k) for run in runs for k in range(len(run.joins))]
        while work:
            failed: dict[int, list[int]] = {}
            by_id = {}
            for (run, k), ok in zip(work, self._try(work), strict=True):
                if not ok:
                    failed.setdefault(id(run), []).append(k)
                    by_id[id(run)] = run
            work, todo = [], []
            for key, ks in failed.items():
                run, chunks, joins, bad, k = by_id[key], [], [], set(ks), 0
                while k < len(run.chunks):
                    if k in bad:
                        todo.append((chunks, len(chunks), run.chunks[k].text + run.chunks[k + 1].text))
                        chunks.append(None)
                        k += 1
                    else:
                        chunks.append(run.chunks[k])
                    joins.append(run.joins[k] if k < len(run.joins) else None)
                    k += 1
                run.chunks, run.joins = chunks, joins[: len(chunks) - 1]
            for (chunks, at, _), chunk in zip(todo, self._fresh([t for _, _, t in todo]), strict=True):
                chunks[at] = chunk
            merged = {id(chunks[at]) for chunks, at, _ in todo}
            for run in by_id.values():
                near = [k for k in range(len(run.joins)) if run.joins[k] is None or id(run.chunks[k]) in merged or id(run.chunks[k + 1]) in merged]
                work += [(run, k) for k in near]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; the strings of special tokens give their ids, as the library has it."""
        plan: list[list[_Run | int]] = []
        runs: list[_Run] = []
        pieces: list[str] = []
        spans: list[tuple[int, int]] = []
        for text in texts:
            line: list[_Run | int] = []
            for part in self.between.split(text) if self.between and any(s in text for s in self.special) else [text]:
                if part in self.special:
                    line.append(self.special[part])
                elif part:
                    ends = cut_points(part)
                    spans.append((len(pieces), len(pieces) + len(ends)))
                    pieces += [part[a:b] for a, b in zip([0, *ends], ends, strict=False)]
                    line.append(_Run([]))
                    runs.append(line[-1])
            plan.append(line)
        self.met += sum(map(len, pieces))
        chunks = self._chunks(pieces)
        for run, (a, b) in zip(runs, spans, strict=True):
            run.chunks, run.joins = chunks[a:b], [None] * (b - a - 1)
        self._repair(runs)
        out = []
        for line in plan:
            ids = [x for item in line for x in ([np.array([item], np.uint32)] if isinstance(item, int) else item.ids())]
            out.append(np.concatenate(ids).astype(np.uint32) if ids else np.zeros(0, np.uint32))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens' strings included; bytes that are no UTF-8 give U+FFFD."""
        n = self.length[ids]
        after = np.cumsum(n)
        flat = np.arange(int(after[-1]) if len(after) else 0)
        flat += np.repeat(self.begin[ids] - (after - n), n)
        return self.bytes[flat].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def chunk_coder(vocabulary: str = "byte_bpe_50k.json") -> ChunkCoder:
    return ChunkCoder(byte_encoder(vocabulary))


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", keep_ids: bool = True) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) of every row, and ``ids`` if asked for; digests in
    lowercase hex, of the ids as little-endian unsigned 32-bit integers and of what they decode to in UTF-8.

    The ids are those of the vocabulary's library, special tokens' strings included, and whole texts are
    encoded, however long.  A null or empty text has no ids.  Repeated rows give a row each, a null id stays
    null, further columns aren't looked at, and an empty table gives an empty result.  One pass over the rows
    without a shuffle: a worker's chunks depend on no other's, so a lost executor costs its own tasks only.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = chunk_coder(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices([len(t) for t in texts]):
                found = coder.encode(texts[a:b])
                cols = [
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in found], pa.string()),
                    pa.array([hashlib.sha256(coder.decode(x).encode()).hexdigest() for x in found], pa.string()),
                ]
                if keep_ids:
                    cols.append(pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *cols], ["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 1 + len(cols)])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kept = ", ids array<int>" if keep_ids else ""
    out = rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, n_tokens long, ids_sha256 string, decoded_sha256 string{kept}")
    return out.withColumnRenamed("id", id_col)


def decode_ids(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """(id_col, text) of every row of ids; null ids give a null text, none an empty one.  An id that the
    vocabulary doesn't have is an error."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = chunk_coder(vocabulary)
        for batch in batches:
            texts = [None if x is None else coder.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    few = rows.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return few.mapInArrow(run, f"id {dict(few.dtypes)['id']}, text string").withColumnRenamed("id", id_col)
