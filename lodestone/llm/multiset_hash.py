"""Document fingerprints: a homomorphic multiset hash over paragraphs.

Each paragraph is hashed to a wide vector, and a document's fingerprint is the sum of its paragraphs'
vectors, lane by lane modulo powers of two: eight lanes of 64 bits that tell multisets apart, and 1,024
lanes of 16 bits that count the paragraph's three-word shingles with signs, so that two sums also say
how alike two documents are.  Sums don't depend on order, and a paragraph is inserted or deleted by
adding or subtracting its vector.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts_of, powers, slices, small_batches

WIDE = 8
COUNTS = 1024
#: Rows of one stretch of neighbouring ids, about; stretches are the unit that tasks are dealt.
STRETCH_ROWS = 2000
#: Stretches at most, so that their bounds always fit the driver.
MOST_STRETCHES = 20_000
#: Text that a task works on at a time.
_CHUNK = 1 << 20

_SPACE = np.array([b <= 32 for b in range(256)])
_BLANK = re.compile(rb"[\x00-\x20]")


def _words(parts: list[bytes], goes_on: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, number of the line, number of the part) of every word; a part that goes on starts no line."""
    data = np.frombuffer(b"\n" + b"\n".join(parts) + b"\n", np.uint8)
    solid = ~_SPACE[data]
    begins = np.nonzero(solid[1:] & ~solid[:-1])[0] + 1
    ends = np.nonzero(~solid[1:] & solid[:-1])[0] + 1
    power, inverse = powers(len(data))
    total = np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power)))
    h = (total[ends] - total[begins]) * inverse[begins]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    edges = np.cumsum([1] + [len(x) + 1 for x in parts])
    owner = np.searchsorted(edges, begins, side="right") - 1
    return h, np.searchsorted(np.nonzero(data == 10)[0], begins) - np.cumsum(goes_on)[owner], owner


def counts(texts: list[bytes]) -> np.ndarray:
    """Signed counts of the shingles of each text's paragraphs, modulo 2 to the 16.

    A shingle is three neighbouring words of one paragraph (line); a shorter paragraph is one shingle.
    Words are runs of bytes above the blank, case kept.  Texts are hashed in parts of about a megabyte,
    cut where a blank is, and only hashes of words are held for the whole of a longer text.
    """
    out = np.zeros(len(texts) * COUNTS, np.int64)
    parts, of = parts_of(texts, _BLANK)
    found, lines = [], 0
    for i, j in slices(map(len, parts)):
        goes_on = [k > 0 and of[k] == of[k - 1] for k in range(i, j)]
        h, line, owner = _words(parts[i:j], goes_on)
        # the line of a word is told by the newlines before it, those of earlier slices too
        found.append((h, line + lines, np.array(of[i:j], np.int64)[owner]))
        lines += sum(x.count(b"\n") + 1 for x in parts[i:j]) - sum(goes_on)
    if not found:
        return out.astype(np.int16).reshape(len(texts), COUNTS)
    h, line, owner = map(np.concatenate, zip(*found, strict=True))
    a, b, c = np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA24BAED4963EE407)
    first = np.ones(len(h), bool)
    first[1:] = line[1:] != line[:-1]
    three = np.zeros(len(h), bool)
    shingle = h * a
    if len(h) > 1:
        two = line[1:] == line[:-1]
        shingle[:-1] += np.where(two, h[1:] * b, np.uint64(0))
        if len(h) > 2:
            three[:-2] = line[2:] == line[:-2]
            shingle[:-2] += np.where(three[:-2], h[2:] * c, np.uint64(0))
    use = three | first
    s = shingle[use]
    s ^= s >> np.uint64(29)
    s *= np.uint64(0x9FB21C651E98DF25)
    lane = (s >> np.uint64(54)).astype(np.int64)
    sign = ((s >> np.uint64(53)) & np.uint64(1)).astype(np.float64) * 2 - 1
    out += np.bincount(owner[use] * COUNTS + lane, sign, minlength=len(out)).astype(np.int64)
    return out.astype(np.int16).reshape(len(texts), COUNTS)


def wides(texts: list[bytes]) -> np.ndarray:
    """The sum of a 512-bit hash of each paragraph, in eight lanes modulo 2 to the 64, of each text."""
    out = np.zeros((len(texts), WIDE), np.uint64)
    hashes, owner = bytearray(), []
    for i, t in enumerate(texts):
        for p in filter(None, t.split(b"\n")):  # empty lines are no paragraphs
            hashes += hashlib.blake2b(p).digest()
            owner.append(i)
    if owner:
        np.add.at(out, np.array(owner), np.frombuffer(bytes(hashes), "<u8").reshape(-1, WIDE))
    return out


def vectors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(wide lanes, counts) of each text."""
    return wides(texts), counts(texts)


def digest(wide: np.ndarray, count: np.ndarray) -> str:
    """A short name of a fingerprint: equal vectors, equal names."""
    return hashlib.blake2b(wide.astype("<u8").tobytes() + count.astype("<i2").tobytes(), digest_size=20).hexdigest()


def likeness(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """From 0 to 1: twice the estimated common shingles over all shingles; 1 for equal fingerprints."""
    if (x[0] == y[0]).all() and (x[1] == y[1]).all():
        return 1.0
    p, q = x[1].astype(np.float64), y[1].astype(np.float64)
    size = p @ p + q @ q
    return float(min(1.0, max(0.0, 2 * (p @ q) / size))) if size else 0.0


class Fingerprint:
    """One document's fingerprint, kept up as paragraphs come and go."""

    def __init__(self, text: str = ""):
        (self.wide,), (self.count,) = vectors([text.encode()])

    @classmethod
    def of(cls, lanes: list[int], counts: bytes) -> Fingerprint:
        """From the columns ``lanes`` and ``counts``."""
        new = cls()
        new.wide, new.count = np.array(lanes, np.int64).view(np.uint64), np.frombuffer(counts, "<i2").astype(np.int16)
        return new

    def insert(self, paragraphs: str) -> Fingerprint:
        (w,), (c,) = vectors([paragraphs.encode()])
        self.wide, self.count = self.wide + w, self.count + c
        return self

    def delete(self, paragraphs: str) -> Fingerprint:
        (w,), (c,) = vectors([paragraphs.encode()])
        self.wide, self.count = self.wide - w, self.count - c
        return self

    def likeness(self, other: Fingerprint) -> float:
        return likeness((self.wide, self.count), (other.wide, other.count))

    def digest(self) -> str:
        return digest(self.wide, self.count)


def edit(text: str, following: str) -> tuple[str, str, str, str]:
    """(kept, removed, inserted paragraphs, edited text) where the last half of ``text`` (rounded down)
    gives way to as many first code points of ``following``, or all of them if it has fewer.

    The kept paragraphs end before the one that the cut lies in.
    """
    half = len(text) // 2
    head = text[: len(text) - half]
    at = head.rfind("\n") + 1
    edited = head + following[:half]
    return text[:at], text[at:], edited[at:], edited


def _work(rows: list[tuple]) -> list[tuple]:
    """Result rows for all but the last of ``rows`` (id, text); the last is only looked at.  An edited
    text's fingerprint is the text's less the removed paragraphs, plus the inserted ones."""
    parts, edits = [], []
    for (_, text), (_, following) in zip(rows[:-1], rows[1:], strict=True):
        kept, removed, inserted, edited = edit(text, following)
        edits.append(edited)
        parts += [kept.encode(), removed.encode(), inserted.encode()]
    parts.append(rows[-1][1].encode())
    wide, count = vectors(parts)
    own = [(wide[i] + wide[i + 1], count[i] + count[i + 1]) for i in range(0, len(parts) - 1, 3)] + [(wide[-1], count[-1])]
    out = []
    for k, edited in enumerate(edits):
        (w, c), i = own[k], 3 * k
        new = (w - wide[i + 1] + wide[i + 2], c - count[i + 1] + count[i + 2])
        sha = hashlib.sha256(edited.encode()).hexdigest()
        lanes = (w.view(np.int64).tolist(), c.astype("<i2").tobytes())
        out.append((rows[k][0], len(rows[k][1]), sha, digest(w, c), digest(*new), likeness(own[k], new), likeness(own[k], own[k + 1]), *lanes))
    return out


_COLUMNS = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "lanes", "counts"]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.binary()]


def _walk(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.RecordBatch]:
    """The first ``columns`` of the result.  Rows (stretch, ahead, id, text) in order; ``ahead`` rows follow their stretch's own rows and only
    the first of them is looked at."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        got = list(zip(*_work(rows), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(got[k], _KINDS[k]) for k in range(columns)], _COLUMNS[:columns])

    held: list[tuple] = []
    size, now, over = 0, None, False
    for batch in batches:
        for stretch, ahead, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if stretch != now:
                held, size, now, over = [], 0, stretch, False
            if over:
                continue
            over = ahead
            held.append((doc, text))
            size += len(text)
            if len(held) > 1 and (ahead or size > _CHUNK):
                yield flush(held)
                held, size = held[-1:], len(text)


def neighbour_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_counts: bool = True) -> DataFrame:
    """(id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, lanes, counts)
    of every row; see ``edit`` for the edited text.  The next document is that of the next id, after the
    last the first.  ``lanes`` (eight numbers modulo 2 to the 64) and ``counts`` (2 KB, left out unless
    ``keep_counts``) are the fingerprint itself, from which ``Fingerprint.of`` goes on; two multisets of
    paragraphs are equal where the lanes are.

    Ids alone are read to cut them into stretches of about ``STRETCH_ROWS`` rows; texts are shuffled
    once, dealt by stretch and sorted, and a stretch's last row finds the first of the next stretch
    sent along.  Null text is as empty.  Rows with a null id come first.  Rows that share an id follow
    each other, ordered by a hash of their texts.  A table of one row has itself for a neighbour, an
    empty one gives an empty result; further columns aren't looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    first = F.lit(-(1 << 63))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("o", F.coalesce("id", first))
    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), first).alias("o"))
    stretches = max(1, min(MOST_STRETCHES, -(-ids.count() // STRETCH_ROWS)))
    marks = [k / stretches for k in range(1, stretches)]
    found = ids.agg(F.percentile_approx("o", marks, max(10_000, 10 * stretches))).first()[0] if marks else []
    bounds = sorted({float(b) for b in found or []})

    def placed(df: DataFrame) -> DataFrame:
        """With the number of bounds that lie at or below an id (as doubles, which keep the order)."""
        if not bounds:
            return df.withColumn("stretch", F.lit(0))
        cut = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="__o", outputCol="stretch")
        return cut.transform(df.withColumn("__o", F.col("o").cast("double"))).drop("__o").withColumn("stretch", F.col("stretch").cast("int"))

    heads = sorted(placed(ids).groupBy("stretch").agg(F.min("o").alias("o")).collect())  # one row a stretch
    onward = [(o, heads[k - 1][0]) for k, (_, o) in enumerate(heads)]
    ahead = spark.createDataFrame(onward, "o long, before int")
    both = placed(rows).join(F.broadcast(ahead), "o", "left")
    own = F.struct(F.col("stretch").alias("stretch"), F.lit(False).alias("ahead"))
    sent = F.struct(F.col("before").alias("stretch"), F.lit(True).alias("ahead"))
    dealt = both.select("o", "id", "text", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, sent))).alias("to"))
    dealt = dealt.select("to.stretch", "to.ahead", "o", "id", "text", F.xxhash64("text").alias("mark")).repartition("stretch")
    out = dealt.sortWithinPartitions("stretch", "ahead", "o", "mark").select("stretch", "ahead", "id", "text")
    kinds = ["long", "long", "string", "string", "string", "double", "double", "array<long>", "binary"][: 9 if keep_counts else 8]
    names = _COLUMNS[: len(kinds)]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _walk(batches, len(names))

    done = out.mapInArrow(walk, ", ".join(f"{c} {k}" for c, k in zip(names, kinds, strict=True)))
    return done.withColumnRenamed("id", id_col)
