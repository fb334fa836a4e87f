"""Batch encoding for BPE vocabularies: one of lower-case words, one of bytes.

The vocabulary's own library encodes every distinct pre-token once; texts are cut into pre-tokens with
array operations, and repeats are looked up.  The result equals the library's, id by id.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np

from .common import parts_of, powers, slices, tokenizer_path

#: Strings that the library takes out of the raw text before all else; such texts go to it whole.
_SPECIAL = ("<|startoftext|>", "<|endoftext|>")
_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3
#: Pre-tokens kept at once by a worker; the store starts anew beyond that.
_MOST_KNOWN = 1_200_000
#: Places of an empty store, as a power of two; it doubles when half are taken.
_TABLE_BITS = 16
_SKIP = 16
#: Below this character, lower case is one character for one.
_PLAIN = "\u0130"
#: Characters that are worked on at a time.  A longer text is cut where white space begins, which no
#: pre-token of either vocabulary crosses.
SLICE_CHARS = 1 << 17
GAP = re.compile(r"(?<=[^\s\x1c-\x1f])(?=[ \t\n])")


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """The kind of every code point: white space, letter, number or other."""
    spaces = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    kinds = np.full(0x110000, _OTHER, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            kinds[c] = _LETTER
        elif k == "N":
            kinds[c] = _NUMBER
    kinds[spaces] = _SPACE
    return kinds


@lru_cache(maxsize=1)
def _lower() -> np.ndarray:
    return np.array([ord(chr(c).lower()) for c in range(ord(_PLAIN))], np.uint32)


@lru_cache(maxsize=1)
def _byte_letters() -> list[str]:
    """The printable character by which byte-level BPE writes each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    table = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class WordStore:
    """Words met so far and their ids, found by 64-bit hashes of code points: arrays, not objects, so that
    a million words take tens of megabytes."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.size = 0
        self._places(_TABLE_BITS)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.begin = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _places(self, bits: int) -> None:
        """An empty table; open addressing, 0 is an empty place."""
        self.bits = bits
        self.keys = np.zeros(1 << bits, np.uint64)
        self.slots = np.zeros(1 << bits, np.int32)

    def _first(self, key: np.ndarray) -> np.ndarray:
        """Where the search for a key begins: its middle bits, as keys come in ascending order."""
        return ((key >> np.uint64(_SKIP)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def _widen(self) -> None:
        """Twice the places, all keys dealt anew."""
        there = np.nonzero(self.keys)[0]
        key, slot = self.keys[there], self.slots[there]
        self._places(self.bits + 1)
        at = self._first(key)
        left = np.arange(len(key))
        while len(left):
            free = left[self.keys[at[left]] == 0]
            won = free[np.unique(at[free], return_index=True)[1]]  # one key for each free place
            self.keys[at[won]], self.slots[at[won]] = key[won], slot[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def hashes(self, code: np.ndarray, bounds: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """Keys of the ``chosen`` of the words that begin at ``bounds`` and fill the text."""
        power, inverse = powers(len(code))
        value = code.astype(np.uint64)
        value += np.uint64(1)
        value *= power
        key = np.add.reduceat(value, bounds)[chosen] * inverse[bounds[chosen]]
        key ^= key >> np.uint64(29)
        key *= np.uint64(0xBF58476D1CE4E5B9)
        key |= np.uint64(1)
        return key

    def find(self, key: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where unknown."""
        at = self._first(key)
        there = self.keys[at]
        slot = np.where(there == key, self.slots[at], -1)
        open_ = np.nonzero((there != key) & (there != 0))[0]
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            there = self.keys[at[open_]]
            hit = there == key[open_]
            slot[open_[hit]] = self.slots[at[open_[hit]]]
            open_ = open_[~hit & (there != 0)]
        return slot

    def add(self, key: int, ids: list[int]) -> None:
        at = self.size
        if 2 * at >= len(self.keys):
            self._widen()
        if at == len(self.begin):
            self.begin, self.count = (np.concatenate((x, np.zeros_like(x))) for x in (self.begin, self.count))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[self.used : self.used + len(ids)] = ids
        self.begin[at], self.count[at] = self.used, len(ids)
        self.used += len(ids)
        self.size += 1
        place = (key >> _SKIP) & ((1 << self.bits) - 1)
        while self.keys[place]:
            place = (place + 1) & ((1 << self.bits) - 1)
        self.keys[place], self.slots[place] = key, at

    def unknown(self, code: np.ndarray, key: np.ndarray, slot: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> list[tuple[int, str]]:
        """(key, word) of the distinct words without a slot."""
        new = np.nonzero(slot < 0)[0]
        if not len(new):
            return []
        fresh, first = np.unique(key[new], return_index=True)
        return [(k, code[begins[j] : ends[j]].tobytes().decode("utf-32-le", "surrogatepass")) for k, j in zip(fresh.tolist(), new[first].tolist(), strict=True)]

    def texts(self, begins: np.ndarray, slot: np.ndarray, edges: np.ndarray) -> list[np.ndarray]:
        """The ids of each text; texts begin at ``edges``, which has one end more."""
        if not len(begins):
            return [np.zeros(0, np.uint32) for _ in edges[1:]]
        n, source = self.count[slot], self.begin[slot]
        after = np.cumsum(n)
        flat = np.arange(int(after[-1]))
        flat += np.repeat(source - (after - n), n)
        ids = self.pool[flat]
        cuts = np.concatenate(([0], after))[np.searchsorted(begins, edges)]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


class Encoder(WordStore):
    """Encodes lists of texts; one for each worker and vocabulary."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = _byte_letters()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, without special tokens, as unsigned 32-bit arrays."""
        out: list[np.ndarray | None] = [None] * len(texts)
        mine, rest = [], []
        for i, t in enumerate(texts):
            if any(s in t for s in _SPECIAL):
                out[i] = np.array(self.whole.encode(t, add_special_tokens=False).ids, np.uint32)
                continue
            if not (t.isascii() or unicodedata.is_normalized("NFC", t)):
                t = unicodedata.normalize("NFC", t)
            mine.append(i)
            rest.append(t)
        for i, ids in zip(mine, self._in_parts(rest), strict=True):
            out[i] = ids
        return out

    def _in_parts(self, texts: list[str]) -> list[np.ndarray]:
        parts, owner = parts_of(texts, GAP, SLICE_CHARS)
        got: list[list[np.ndarray]] = [[] for _ in texts]
        for k, j in slices([len(x) for x in parts], SLICE_CHARS):
            for i, ids in zip(owner[k:j], self._encode(parts[k:j]), strict=True):
                got[i].append(ids)
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in got]

    def _codes(self, texts: list[str]) -> np.ndarray:
        """Code points of the texts in lower case, a newline before, between and after them."""
        text = "\n" + "\n".join(texts) + "\n"
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if code.max() < ord(_PLAIN):
            return _lower()[code]
        low = [t.replace("\u03a3", "\u03c3").lower() for t in texts]  # no final sigma in the vocabulary's lower case
        text = "\n" + "\n".join(low) + "\n"
        texts[:] = low
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)

    def _cut(self, code: np.ndarray, kind: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where runs begin, numbers of those runs that are pre-tokens)."""
        starts = np.empty(len(code), bool)
        starts[0] = True
        np.not_equal(kind[1:], kind[:-1], out=starts[1:])
        starts |= kind == _NUMBER
        self._contractions(code, kind, starts)
        bounds = np.nonzero(starts)[0]
        return bounds, np.nonzero(kind[bounds] != _SPACE)[0]

    def lookup(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first code point, slot) of every pre-token, where each text begins, and run ends."""
        if self.size > _MOST_KNOWN:
            self.forget()
        texts = list(texts)
        code = self._codes(texts)
        kind = _kinds()[code]
        edges = np.cumsum([1] + [len(x) + 1 for x in texts])
        bounds, solid = self._cut(code, kind, edges)
        begins = bounds[solid]
        if not len(begins):
            return begins, begins, edges, begins
        ends = np.append(bounds, len(code))[solid + 1]
        key = self.hashes(code, bounds, solid)
        slot = self.find(key)
        fresh = self.unknown(code, key, slot, begins, ends)
        for k, word in fresh:
            self.add(k, [t.id for t in self.model.tokenize("".join([self.letters[b] for b in word.encode("utf-8", "replace")]))])
        return begins, self.find(key) if fresh else slot, edges, ends

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        begins, slot, edges, _ = self.lookup(texts)
        return self.texts(begins, slot, edges)

    def _contractions(self, code: np.ndarray, kind: np.ndarray, starts: np.ndarray) -> None:
        """An apostrophe that stands alone takes s, t, re, ve, m, ll or d after it into its token."""
        mark = np.nonzero(code[:-1] == 39)[0]
        mark = mark[starts[mark] & (kind[mark + 1] == _LETTER)]
        for p in mark.tolist():
            two = chr(code[p + 1]) + chr(code[p + 2])
            n = 1 if two[0] in "stmd" else 2 if two in ("re", "ve", "ll") else 0
            if n:
                starts[p + 1] = False
                if kind[p + 1 + n] == _LETTER:
                    starts[p + 1 + n] = True


class ByteEncoder(Encoder):
    """For the byte-level vocabulary: nothing is folded or dropped, and a blank belongs to the word after
    it.  Strings of special tokens are ordinary text.  White space is cut as the vocabulary's pattern
    has it: a run gives its last character up to what follows, which a blank joins and others don't.
    """

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self._in_parts(texts)

    def _codes(self, texts: list[str]) -> np.ndarray:
        text = "\n" + "\n".join(texts) + "\n"
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)

    def _cut(self, code: np.ndarray, kind: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wall = edges - 1  # the newlines between texts, which no run may cross
        starts = np.empty(len(code), bool)
        starts[0] = True
        np.not_equal(kind[1:], kind[:-1], out=starts[1:])
        starts[wall] = True
        starts[wall[:-1] + 1] = True
        joins = np.nonzero(starts[1:] & (kind[:-1] == _SPACE) & (kind[1:] != _SPACE))[0]  # last of a run of white space
        joins = joins[~np.isin(joins, wall)]
        blank = joins[code[joins] == 32]
        self._contractions(code, kind, starts, np.setdiff1d(joins, blank), blank)
        starts[joins] = True
        starts[blank + 1] = False
        bounds = np.nonzero(starts)[0]
        return bounds, np.nonzero(~np.isin(bounds, wall))[0]

    def _contractions(self, code: np.ndarray, kind: np.ndarray, starts: np.ndarray, joins: np.ndarray = None, blank: np.ndarray = None) -> None:
        """As above, but an apostrophe that a blank belongs to takes nothing."""
        held = starts[blank + 1].copy()
        mine = code[blank + 1] == 39
        starts[blank[mine] + 1] = False
        super()._contractions(code, kind, starts)
        starts[blank + 1] = held


@lru_cache(maxsize=2)
def encoder(name: str = "word_bpe_49k.json") -> Encoder:
    return Encoder(tokenizer_path(name))


@lru_cache(maxsize=2)
def byte_encoder(name: str = "byte_bpe_50k.json") -> ByteEncoder:
    return ByteEncoder(tokenizer_path(name))
