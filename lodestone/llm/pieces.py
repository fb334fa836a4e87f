"""SentencePiece encoding and decoding with prefixes shared between words.

Text becomes marked words (blanks as U+2581, one before the text).  A worker sorts the distinct words
that it hasn't met into a trie and walks it depth-first: each place of the path has a forward score, the best
total of pieces that spell the prefix, and the piece it ends in, which all words below share.

For a unigram vocabulary a path's total is the sum of its pieces' scores.  The public vocabulary here is a
BPE, for which that sum's maximum gives other ids than the library; so a step costs infinitely much where
the merges would not leave its two pieces side by side.  Every run of leading pieces of a BPE encoding is
the encoding of what it spells, so exactly one path to each place has a finite total: the library's ids.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts_of, slices, small_batches, tokenizer_path
from .wordbpe import WordStore

MARK = "▁"
#: Characters that are worked on at a time, and words kept by a worker before it starts anew.
SLICE_CHARS, MOST_WORDS = 1 << 17, 1_000_000
_WORD = re.compile(f"(?<=[^{MARK}])(?={MARK})")
_LOW = 0x250  # pairs of characters below this are looked up in a table


class Vocabulary:
    """Pieces, scores and kinds of a SentencePiece model."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], unknown: int, unigram: bool = False):
        self.pieces, self.scores, self.byte_ids, self.unknown, self.unigram = pieces, scores, byte_ids, unknown, unigram
        skip = {*byte_ids, unknown}
        self.ids = {p: i for i, p in enumerate(pieces) if i not in skip and p}
        self.longest = max(map(len, self.ids))
        self.mark_begins = not any(MARK in p.lstrip(MARK) for p in self.ids)  # then texts may be cut before a mark
        self.chars = {c for p in self.ids for c in p}
        self.apart: dict[int, bool] = {}
        self.words = WordStore()
        near, far = np.zeros((_LOW, _LOW), bool), set()
        for p in self.ids:
            for a, b in zip(p, p[1:], strict=False):
                if max(ord(a), ord(b)) < _LOW:
                    near[ord(a), ord(b)] = True
                else:
                    far.add((ord(a) << 21) | ord(b))
        self.near, self.far = near, np.array(sorted(far), np.int64)
        outs = []
        for i, p in enumerate(pieces):
            outs.append(bytes([byte_ids.index(i)]) if i in set(byte_ids) else p.replace(MARK, " ").encode())
        self.bytes_of = outs

    @classmethod
    def load(cls, name: str) -> Vocabulary:
        import sentencepiece

        s = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))
        every = range(s.vocab_size())
        pieces = ["" if s.is_control(i) or s.is_unused(i) else s.id_to_piece(i) for i in every]
        return cls(pieces, [s.get_score(i) for i in every], [i for i in every if s.is_byte(i)], s.unk_id())

    # -- BPE

    def merge(self, symbols: str) -> list[str]:
        """The BPE encoding of a string by merging: the best pair first, the leftmost of equals."""
        parts, after, before = list(symbols), [*range(1, len(symbols)), -1], [*range(-1, len(symbols) - 1)]
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0:
                both = parts[i] + parts[after[i]]
                k = self.ids.get(both)
                if k is not None:
                    heapq.heappush(heap, (-self.scores[k], i, both))

        for i in range(len(symbols) - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            if not parts[i] or after[i] < 0 or parts[i] + parts[after[i]] != both:
                continue
            j = after[i]
            parts[i], parts[j] = both, ""
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            offer(before[i]), offer(i)
        return [p for p in parts if p]

    def _stays_apart(self, left: int, right: int) -> bool:
        key = left * len(self.pieces) + right
        known = self.apart.get(key)
        if known is None:
            a, b = self.pieces[left], self.pieces[right]
            known = self.apart[key] = self.merge(a + b) == [a, b]
        return known

    def encode_sorted(self, words: list[str]) -> Iterator[tuple[str, tuple[int, ...]]]:
        """(word, ids) of distinct words in sorted order: a walk through their trie, depth-first, with a
        forward score and a last piece for each place of the path."""
        path = ""
        last: list[int] = [-1]  # by prefix length
        forward = [0.0]
        ids, pieces, scores, longest = self.ids, self.pieces, self.scores, self.longest
        for word in words:
            n = 0
            for a, b in zip(path, word, strict=False):
                if a != b:
                    break
                n += 1
            del last[n + 1 :], forward[n + 1 :]
            for end in range(n + 1, len(word) + 1):
                best, piece = -math.inf, self.unknown
                for start in range(max(0, end - longest), end):
                    k = ids.get(word[start:end])
                    if k is not None and forward[start] + scores[k] > best and (self.unigram or self._side_by_side(last[start], k)):
                        best, piece = forward[start] + scores[k], k
                        if not self.unigram:
                            break  # no other step to this place has a finite score
                last.append(piece), forward.append(best)
            if forward[-1] == -math.inf:  # cannot be: characters of no piece aren't walked
                raise ValueError(f"no pieces spell {word!r}")
            path = word
            out, end = [], len(word)
            while end:
                out.append(last[end])
                end -= len(pieces[last[end]])
            yield word, tuple(reversed(out))

    def _side_by_side(self, left: int, right: int) -> bool:
        """Whether the merges leave two pieces next to each other; at a word's beginning (-1), whether they
        make the piece at all."""
        return self._whole(right) if left < 0 else self._stays_apart(left, right)

    def _whole(self, k: int) -> bool:
        """Whether a piece is the encoding of its own string, as a first piece must be."""
        key = -1 - k
        known = self.apart.get(key)
        if known is None:
            known = self.apart[key] = self.merge(self.pieces[k]) == [self.pieces[k]]
        return known

    # -- texts

    def _bounds(self, code: np.ndarray) -> np.ndarray:
        """Where words begin: no piece joins what stands on the two sides.  Characters that no piece has
        are words by themselves."""
        a, b = code[:-1], code[1:]
        low = (a < _LOW) & (b < _LOW)
        if low.all():
            joined = self.near[a, b]
        else:
            joined = np.zeros(len(a), bool)
            joined[low] = self.near[a[low], b[low]]
            rest = np.nonzero(~low)[0]
            if len(self.far):
                key = (a[rest].astype(np.int64) << 21) | b[rest]
                at = np.minimum(np.searchsorted(self.far, key), len(self.far) - 1)
                joined[rest] = self.far[at] == key
        return np.concatenate(([0], np.nonzero(~joined)[0] + 1))

    def _fallback(self, word: str) -> tuple[int, ...]:
        """Bytes of a character that no piece has; the unknown id in a vocabulary without bytes."""
        if not self.byte_ids:
            return (self.unknown,)
        return tuple(self.byte_ids[b] for b in word.encode("utf-8", "replace"))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as the library gives them without special ids."""
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        parts, owner = parts_of(marked, _WORD, SLICE_CHARS) if self.mark_begins else (marked, list(range(len(texts))))
        got: list[list[np.ndarray]] = [[] for _ in texts]
        for i, j in slices([len(t) for t in parts], SLICE_CHARS):
            for k, ids in zip(owner[i:j], self._encode(parts[i:j]), strict=True):
                got[k].append(ids)
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in got]

    def _encode(self, marked: list[str]) -> list[np.ndarray]:
        if self.words.size > MOST_WORDS:
            self.words.forget()
        if len(self.apart) > 2 * MOST_WORDS:
            self.apart.clear()
        code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
        edges = np.cumsum([0] + [len(t) for t in marked])
        if not len(code):
            return [np.zeros(0, np.uint32) for _ in marked]
        bounds = np.union1d(self._bounds(code), edges[:-1][np.diff(edges) > 0])
        ends = np.append(bounds[1:], len(code))
        key = self.words.hashes(code, bounds, np.arange(len(bounds)))
        slot = self.words.find(key)
        fresh = self.words.unknown(code, key, slot, bounds, ends)
        plain = []
        for k, w in fresh:
            if w[0] not in self.chars:
                self.words.add(k, self._fallback(w))
            elif MARK * 2 in w and not self.unigram:  # runs of marks share one score: their merges are played through
                self.words.add(k, [self.ids[p] for p in self.merge(w)])
            else:
                plain.append((w, k))
        keys = dict(plain)
        for w, ids in self.encode_sorted(sorted(keys)):
            self.words.add(keys[w], ids)
        return self.words.texts(bounds, self.words.find(key) if fresh else slot, edges)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: bytes joined, marks as blanks, without the first mark."""
        data = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        return data.removeprefix(b" ").decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(name: str = "piece_bpe_32k.model") -> Vocabulary:
    return Vocabulary.load(name)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model", keep_ids: bool = True) -> DataFrame:
    """(id_col, ids, n_tokens, ids_crc32, decoded_chars, round_trip) of every row.

    ``ids`` (left out unless ``keep_ids``) are the library's ids without special ones, ``ids_crc32`` the
    checksum of them as unsigned little-endian 32-bit numbers, ``round_trip`` whether decoding gives the
    text back (it doesn't where the text itself holds U+2581).  Null text is as empty and has no ids.
    Whole texts are encoded; rows are neither dropped nor merged; further columns aren't looked at.
    """
    small_batches(docs.sparkSession)
    names = ["id", *(["ids"] if keep_ids else []), "n_tokens", "ids_crc32", "decoded_chars", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = vocab.encode(texts)
            back = [vocab.decode(x) for x in ids]
            crc = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())
            lists = [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))] if keep_ids else []
            same = pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists, pa.array(map(len, ids), pa.int64()), crc, pa.array(map(len, back), pa.int64()), same], names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {dict(rows.dtypes)['id']}, {'ids array<int>, ' if keep_ids else ''}n_tokens long, ids_crc32 long, decoded_chars long, round_trip boolean"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
