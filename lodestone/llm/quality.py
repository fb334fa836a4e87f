"""Quality filtering by importance resampling.

Two hashed n-gram models, of target text (rows labelled good) and of raw text (all rows), give each
document the log ratio of its likelihoods, summed over its n-grams; Gumbel noise and a top-k cut turn the
ratios into a sample of k documents without replacement.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import byte_column, materialize, parts_of, powers, slices, small_batches

_BINS, _FEW = 1024, 4096

BUCKETS = 1 << 14
#: Labelled rows that are looked at, at most: their good ones fit the target model.
MOST_LABELLED_ROWS = 20_000
SEED = 13
_CLASS = np.array([0 if b <= 32 or b == 127 else 1 if b >= 128 or chr(b).isalnum() or b == 95 else 2 for b in range(256)], np.uint8)
_GAP = re.compile(rb"[\x00-\x20\x7f]")


def _tokens(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, part number) of every token."""
    data = np.frombuffer(b" " + b" ".join(parts).lower() + b" ", np.uint8)
    kind = _CLASS[data]
    begins = np.nonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0))[0] + 1
    if not len(begins):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    power, inverse = powers(len(data))
    h = np.add.reduceat(np.where(kind > 0, (data.astype(np.uint64) + np.uint64(1)) * power, np.uint64(0)), begins)
    h *= inverse[begins]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    edges = np.cumsum([0] + [len(x) + 1 for x in parts]) + 1  # where each part begins
    return h, np.searchsorted(edges, begins, side="right") - 1


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text number) of every token and of every pair of neighbouring tokens of each text.

    Tokens are runs of letters, digits and bytes above 127, or of symbols; ASCII capitals count as
    small letters.  Texts are hashed in parts of about a megabyte, cut where a blank is; of a longer one
    only the tokens' hashes are held.
    """
    parts, of = parts_of(texts, _GAP)
    found = []
    for i, j in slices(map(len, parts)):
        h, owner = _tokens(parts[i:j])
        found.append((h, np.array(of[i:j], np.int64)[owner]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, owner = map(np.concatenate, zip(*found, strict=True))
    pair = (h[:-1] * np.uint64(0xA24BAED4963EE407)) ^ (h[1:] >> np.uint64(7))
    pair *= np.uint64(0x9FB21C651E98DF25)
    same = owner[1:] == owner[:-1]
    both = np.concatenate((h, pair[same])) >> np.uint64(50)
    return both.astype(np.int64), np.concatenate((owner, owner[1:][same]))


def labelled_ids(labels: DataFrame, id_col: str, label_col: str, good: int, most: int) -> DataFrame:
    """(id, good) of labelled ids: all, or the ``most`` of least salted hash.  An id with several labels is
    good if one of them is."""
    ids = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id"))
    return ids.agg(F.max(F.col(label_col) == good).alias("good")).orderBy(F.xxhash64("id", F.lit(11)), "id").limit(most)


def fit(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, int, int]:
    """(log of the bucket probabilities' ratio, target over raw, add-one smoothed; rows labelled good; all
    labelled rows).

    Raw counts cover every row; target counts cover the rows whose ids are good in ``labelled`` (bounded by
    its maker, so it is broadcast).  Each task adds up its own rows and hands on one count for each
    bucket; the driver gets ``BUCKETS`` sums.
    """
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS + 1), np.int64)  # the last place counts rows
        for batch in batches:
            texts = [x or b"" for x in byte_column(batch)]
            known, good = (np.asarray(batch.column(k).to_numpy(zero_copy_only=False), bool) for k in (1, 2))
            total[:, BUCKETS] += good.sum(), known.sum()
            for i, j in slices(map(len, texts)):
                bucket, owner = grams(texts[i:j])
                total[1, :BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
                total[0, :BUCKETS] += np.bincount(bucket[good[i:j][owner]], minlength=BUCKETS)
        some = np.nonzero(total[1])[0]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[0][some]), pa.array(total[1][some])], ["bucket", "good", "raw"])

    marks = labelled.select(F.col("id").alias("__id"), F.lit(True).alias("__known"), F.col("good").alias("__good"))
    rows = docs.select(F.col(id_col).cast("long").alias("__doc"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(marks), F.col("__doc") == F.col("__id"), "left").select("text", F.coalesce("__known", F.lit(False)).alias("known"), F.coalesce("__good", F.lit(False)).alias("good"))
    sums = rows.mapInArrow(count, "bucket int, good long, raw long").groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("raw").alias("raw")).toArrow()
    total = np.zeros((2, BUCKETS + 1))
    total[:, sums.column("bucket").to_numpy()] = sums.column("good").to_numpy(), sums.column("raw").to_numpy()
    good, known = total[:, BUCKETS].astype(int).tolist()
    total = total[:, :BUCKETS]
    p = (total + 1) / (total.sum(1, keepdims=True) + BUCKETS)
    return np.log(p[0]) - np.log(p[1]), good, known


def sample_size(rows: int, good: int, known: int) -> int:
    """k where none is given: the share of labelled rows that are good and its standard error more, of all
    rows; without labelled rows, all."""
    share = (good + 1) / (known + 2)  # never 0 or 1, whose standard error would be none
    return rows if not known else min(rows, math.ceil(rows * (share + math.sqrt(share * (1 - share) / known))))


def log_ratios(docs: DataFrame, ratio: np.ndarray, text_col: str = "text", out: tuple[str, str] = ("log_ratio", "n_grams"), keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``) with the sum of its n-grams' log ratios (null without any), which is
    the log ratio of its likelihoods, and their number."""
    small_batches(docs.sparkSession)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in out]
    schema = StructType([*docs.select(*[F.col(f"`{c}`") for c in kept]).schema, StructField(out[0], DoubleType()), StructField(out[1], LongType())])
    at = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()]
            total, number = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            for i, j in slices(map(len, texts)):
                bucket, owner = grams(texts[i:j])
                total[i:j] = np.bincount(owner, ratio[bucket], minlength=j - i)
                number[i:j] = np.bincount(owner, minlength=j - i)
            ratios = pa.array(np.round(total, 9), mask=number == 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], ratios, pa.array(number)], [*kept, *out])

    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text_col).alias("__text")).mapInArrow(run, schema)


def gumbel_key(log_ratio: str, id_col: str, seed: int = SEED, temperature: float = 1.0) -> F.Column:
    """Log weight plus ``temperature`` times Gumbel noise, which a hash of the id gives; null where the ratio is
    null.  The rows of the k largest keys are a sample without replacement, each draw with odds in proportion
    to exp(log ratio / temperature): ratios of long texts are large, and a larger temperature lets the noise
    count for them too."""
    u = (F.xxhash64(F.col(id_col), F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return F.col(log_ratio) - F.lit(temperature) * F.log(-F.log(u))


def cut_off(rows: DataFrame, key: str, k: int) -> float:
    """The k-th largest key, exactly; minus infinity if there are no more than k.

    Each round counts the keys in ``_BINS`` bins of the range that still holds the cut, so the driver
    gets that many counts; the last bin's keys, ``_FEW`` at most, are fetched.
    """
    rows = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("k"))
    low, high, n = rows.agg(F.min("k"), F.max("k"), F.count("k")).first()
    if k >= n:
        return float("-inf")
    if k <= 0:
        return float("inf")
    while n > _FEW and low < high:
        width = (high - low) / _BINS
        inside = rows.where(F.col("k").between(low, high))
        b = F.least(F.floor((F.lit(high) - F.col("k")) / F.lit(width)), F.lit(_BINS - 1)).alias("b")
        bins = sorted(inside.groupBy(b).agg(F.count("k").alias("n"), F.min("k").alias("low"), F.max("k").alias("high")).collect())
        for _, n, low, high in bins:
            if k <= n:
                break
            k -= n
    if low == high:
        return low
    return rows.where(F.col("k").between(low, high)).orderBy(F.desc("k")).limit(k).agg(F.min("k")).first()[0]


def resample(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    good: int = 1,
    k: int | None = None,
    most_labelled_rows: int = MOST_LABELLED_ROWS,
    seed: int = SEED,
    temperature: float = 1.0,
) -> tuple[DataFrame, np.ndarray, float]:
    """(id_col, log_ratio, n_grams, gumbel_key, selected) of every row, the fitted ratios, the cut.

    The ``k`` rows of largest Gumbel key are selected, rows that tie with the last of them too; see
    ``sample_size`` for k where none is given.  Null texts and texts without a token have null ratio and
    key, don't count among the rows that k is a share of and are never selected.  Rows that share an id
    get the same noise.  Without labelled rows the target model is that of add-one smoothing.  An empty
    table gives an empty result.
    """
    ratio, good_rows, known = fit(docs, labelled_ids(labels, id_col, label_col, good, most_labelled_rows), id_col, text_col)
    rows = log_ratios(docs, ratio, text_col, keep=[id_col])
    rows = materialize(rows.withColumn("gumbel_key", gumbel_key("log_ratio", id_col, seed, temperature)), "ratios")
    k = sample_size(rows.where("log_ratio IS NOT NULL").count(), good_rows, known) if k is None else k
    cut = cut_off(rows, "gumbel_key", k)
    return rows.withColumn("selected", F.coalesce(F.col("gumbel_key") >= F.lit(cut), F.lit(False))), ratio, cut


def select_rows(docs: DataFrame, ratio: np.ndarray, cut: float, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, temperature: float = 1.0) -> DataFrame:
    """The rows of ``docs`` that ``resample`` selects, with their own columns alone.  The ratios are
    worked out again rather than joined, so no text is shuffled."""
    names = ("__ratio", "__grams")
    rows = log_ratios(docs, ratio, text_col, names).where(gumbel_key("__ratio", id_col, seed, temperature) >= F.lit(cut))
    return rows.drop(*names)
