"""Token counts that are kept up under edits.

A document's pre-tokens stand in a balanced tree of sums (code points, tokens).  An edit finds the pre-tokens
it touches by descending the tree, cuts and encodes only those and the boundary context around them anew,
and updates the sums on the way up.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts_of, slices, small_batches
from .wordbpe import GAP, SLICE_CHARS, ByteEncoder, byte_encoder

#: Pre-tokens of one leaf of the tree, at most.
LEAF = 64
#: Code points before an edit that may change how what precedes it is cut.
CONTEXT = 3


@lru_cache(maxsize=1)
def _pattern() -> regex.Pattern:
    from public_tokenizers import PATTERN

    return regex.compile(PATTERN)


# A tree is None or a tuple: (0, code points, tokens, lengths, counts) for a leaf of pre-tokens, (height, code
# points, tokens, left, right) above.  Heights of siblings differ by one at most, and trees are never changed, so
# what an edit doesn't touch is kept as it is.


def _leaf(lengths: list[int], counts: list[int]) -> tuple:
    return 0, sum(lengths), sum(counts), lengths, counts


def _node(left: tuple, right: tuple) -> tuple:
    return 1 + max(left[0], right[0]), left[1] + right[1], left[2] + right[2], left, right


def _join(left: tuple | None, right: tuple | None) -> tuple | None:
    """One tree of two, in time that goes with the difference of their heights."""
    if left is None or right is None:
        return left or right
    if abs(left[0] - right[0]) <= 1:
        return _node(left, right)
    if left[0] > right[0]:
        a, b = left[3], _join(left[4], right)
        if b[0] <= a[0] + 1:
            return _node(a, b)
        if b[4][0] > b[3][0] or b[3][0] == 0:
            return _node(_node(a, b[3]), b[4])
        return _node(_node(a, b[3][3]), _node(b[3][4], b[4]))
    a, b = _join(left, right[3]), right[4]
    if a[0] <= b[0] + 1:
        return _node(a, b)
    if a[3][0] > a[4][0] or a[4][0] == 0:
        return _node(a[3], _node(a[4], b))
    return _node(_node(a[3], a[4][3]), _node(a[4][4], b))


def _split(tree: tuple | None, at: int) -> tuple[tuple | None, tuple | None]:
    """(leaves before the one that holds code point ``at``, that one and those after it); past the end, the
    last leaf counts as holding it."""
    if tree is None or not tree[0]:
        return None, tree
    if at < tree[3][1]:
        left, right = _split(tree[3], at)
        return left, _join(right, tree[4])
    left, right = _split(tree[4], at - tree[3][1])
    return _join(tree[3], left), right


def _build(lengths: list[int], counts: list[int]) -> tuple | None:
    """A tree over pre-tokens, in leaves of up to ``LEAF``."""
    if not lengths:
        return None
    if len(lengths) <= LEAF:
        return _leaf(lengths, counts)
    half = len(lengths) // 2
    return _node(_build(lengths[:half], counts[:half]), _build(lengths[half:], counts[half:]))


class CountTree:
    """The token count of one text, kept up under ``replace``: a balanced tree of sums over pre-tokens.  An edit
    splits off the leaves that it touches and joins new ones in, which takes time that goes with the
    logarithm of their number, besides that of what is encoded anew and of copying the text."""

    def __init__(self, text: str, lengths: np.ndarray, counts: np.ndarray, encoder: ByteEncoder):
        self.text, self.encoder, self.encoded = text, encoder, 0
        self.root = _build(lengths.tolist(), counts.tolist())

    @property
    def total(self) -> int:
        return self.root[2] if self.root else 0

    def replace(self, start: int, end: int, new: str) -> int:
        """Put ``new`` in place of the code points from ``start`` to ``end``; the new token count."""
        size, self.text = len(self.text), self.text[:start] + new + self.text[end:]
        shift, least = len(new) - (end - start), max(0, start - CONTEXT)
        before, rest = _split(self.root, least)
        held: list[tuple[int, int]] = []  # pre-tokens of the leaf at hand, last one first

        def following() -> tuple[int, int]:
            nonlocal rest
            if not held:
                tree = rest
                while tree[0]:
                    tree = tree[3]
                rest = _without_first(rest)
                held.extend(zip(reversed(tree[3]), reversed(tree[4]), strict=True))
            return held.pop()

        kept: list[tuple[int, int]] = []
        at = before[1] if before else 0
        while held or rest:  # those of the leaf that end before the context, but the last of all
            piece = following()
            if at + piece[0] > least or not (held or rest):
                held.append(piece)
                break
            kept.append(piece)
            at += piece[0]
        words, position, stop = [], at, at
        for m in _pattern().finditer(self.text, at):  # up to a cut that the old text has too, at or after the edit's end
            while stop < size and (stop < end or stop + shift < position):
                stop += following()[0]
            if position == stop + shift and stop >= end and position >= start + len(new):
                break
            words.append(m[0])
            position = m.end()
        else:
            held.clear()
            rest = None
        self.encoded += sum(map(len, words))
        fresh = kept + list(zip(map(len, words), word_counts(words, self.encoder), strict=True))
        while held or (rest and len(fresh) < LEAF // 2):  # the rest of the leaf, and more where little is left
            fresh.append(following())
        self.root = _join(_join(before, _build([n for n, _ in fresh], [c for _, c in fresh])), rest)
        return self.total


def _without_first(tree: tuple) -> tuple | None:
    """The tree without its first leaf."""
    return _join(_without_first(tree[3]), tree[4]) if tree[0] else None


def word_counts(words: list[str], encoder: ByteEncoder) -> list[int]:
    """Tokens of each pre-token, which is encoded by itself."""
    letters, model = encoder.letters, encoder.model
    return [len(model.tokenize("".join([letters[b] for b in w.encode("utf-8", "replace")]))) for w in words]


def pretokens(texts: list[str], encoder: ByteEncoder) -> list[tuple[np.ndarray, np.ndarray]]:
    """(lengths, token counts) of the pre-tokens of each text."""
    parts, owner = parts_of(texts, GAP, SLICE_CHARS)
    out: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in texts]
    for k, j in slices([len(x) for x in parts], SLICE_CHARS):
        begins, slot, edges, ends = encoder.lookup(parts[k:j])
        cuts = np.searchsorted(begins, edges)
        lengths, counts = ends - begins, encoder.count[slot]
        for i, a, b in zip(owner[k:j], cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            out[i].append((lengths[a:b], counts[a:b]))
    return [x[0] if len(x) == 1 else tuple(map(np.concatenate, zip(*x, strict=True))) for x in out]


def revision(text: str) -> list[tuple[int, int, str]]:
    """A fixed revision, edit by edit, as (start, end, new text): five code points go at a third of the
    text, a remark comes in the middle, and the first word is repeated at the end."""
    n = len(text)
    third = n // 3
    cut = min(5, n - third)
    return [(third, third + cut, ""), ((n - cut) // 2, (n - cut) // 2, " (revised 2024)"), (n - cut + 15, n - cut + 15, "\n" + text[: text.find(" ") + 1 or 0])]


def count_revisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """(id_col, n_tokens, revised_chars, revised_tokens, reencoded_chars) of every row: the text's token
    count, then length and count after ``revision``, and how many code points its edits encoded anew.

    Null text is as empty.  Whole texts are counted; rows are neither dropped nor merged; further columns
    aren't looked at.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = []
            for text, (lengths, counts) in zip(texts, pretokens(texts, encoder), strict=True):
                tree = CountTree(text, lengths, counts, encoder)
                before = tree.total
                for edit in revision(text):
                    tree.replace(*edit)
                rows.append((before, len(tree.text), tree.total, tree.encoded))
            cols = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["id", "n_tokens", "revised_chars", "revised_tokens", "reencoded_chars"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, n_tokens long, revised_chars long, revised_tokens long, reencoded_chars long")
    return out.withColumnRenamed("id", id_col)
