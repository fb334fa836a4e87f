"""Language identification with string kernels.

Texts are compared by a blended-spectrum presence kernel: the share of byte n-grams (n = 1..4) that
two texts hold in common, whatever their counts.  A bounded set of training texts serves as Nystroem
landmarks; one-versus-rest kernel ridge regression is solved in the landmark space on the driver;
scoring is two matrix products for each block of texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import byte_column, small_batches

UNDETERMINED = "und"
_BITS = 20
_ORDERS = (1, 2, 3, 4)
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F))
#: ASCII other than letters reads as a blank, so that symbols, digits and markup carry no language.
_FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_LETTER = re.compile(r"[^\W\d_]")
_BLOCK = 128
#: Bytes of a text that are hashed at a time.
_STRETCH = 1 << 20


@dataclass
class Model:
    labels: list[str]
    vocabulary: np.ndarray  # the landmarks' hashed n-grams
    landmarks: np.ndarray  # landmark x n-gram, rows of length one
    weights: np.ndarray  # landmark x label
    bias: np.ndarray


def _hashed(data: bytes) -> Iterator[np.ndarray]:
    """Hashed n-grams of a text with a blank at both ends, one array for each order and stretch of the
    text; stretches overlap, so that an n-gram that runs over their border counts and none is added."""
    whole = b" " + data + b" "
    for k in range(0, len(whole) - 1, _STRETCH):
        b = np.frombuffer(whole[k : k + _STRETCH + _ORDERS[-1] - 1], np.uint8).astype(np.uint32)
        gram = b
        for n, mix in zip(_ORDERS, _MIX, strict=True):
            if n > 1:
                if len(gram) < 2:
                    break
                gram = (gram[:-1] << np.uint32(8)) | b[n - 1 :]
            yield ((gram * mix) ^ (gram >> np.uint32(13))) * mix >> np.uint32(32 - _BITS)


def fold(data: bytes) -> bytes:
    """Lower case, ASCII symbols and digits as blanks, runs of blanks as one."""
    return b" ".join(data.decode("utf-8", "replace").lower().encode().translate(_FOLD).split())


def has_letters(data: bytes | None) -> bool:
    return bool(data) and _LETTER.search(data.decode("utf-8", "replace")) is not None


def presence(data: bytes) -> np.ndarray:
    """The distinct hashed n-grams of a folded text, ascending."""
    seen = np.zeros(1 << _BITS, bool)
    for h in _hashed(data):
        seen[h] = True
    return np.nonzero(seen)[0].astype(np.int32)


def sample_rows(docs: DataFrame, text_col: str, label_col: str, id_col: str, per_label: int) -> DataFrame:
    """(label, n, text) of up to ``per_label`` ids of each label, those of least salted hash, n being their
    rank; of an id's rows of that label, the text of least hash stands for it.

    Ids and labels alone are read to choose them.  An estimate of each label's ids sets a hash below which
    there are about four times as many as are wanted, so however many rows an id has, no task gets more
    than that of a label.  The chosen ids, bounded by the parameter, are broadcast to fetch the texts.
    """
    light = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    light = light.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"))
    # one row a label, as the model holds on the driver too
    known = [(k, min((1 << 64) - 1, (4 * per_label << 64) // max(n, 1)) - (1 << 63)) for k, n in light.groupBy("label").agg(F.approx_count_distinct("id", 0.02)).collect()]
    below = docs.sparkSession.createDataFrame(known, "label string, below long")
    few = light.join(F.broadcast(below), "label").withColumn("h", F.xxhash64("id", F.lit(7))).where("h <= below").select("label", "id", "h").distinct()
    order = Window.partitionBy("label").orderBy("h", "id")
    chosen = few.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_label).select(F.col("id").alias("i"), F.col("label").alias("l"), "n")
    full = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"))
    met = full.join(F.broadcast(chosen), (F.col("id") == F.col("i")) & (F.col("label") == F.col("l")))
    return met.groupBy("label", "n").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))


def train(
    docs: DataFrame,
    text_col: str = "text",
    label_col: str = "lang",
    id_col: str = "doc_id",
    per_label: int = 200,
    landmarks_per_label: int = 32,
    ridge: float = 1e-3,
) -> Model:
    """Fit on one text of at most ``per_label`` ids of each label.  Executors reduce those texts to sets of
    hashed n-grams; the driver gets these sets only.  The kernel is over all n-grams, told apart by 20 bits
    of hash: those of no landmark are shared with none, so they count in a text's length alone.  No labelled
    row gives a model without labels; rows with a null id, label or text are no lesson."""
    small_batches(docs.sparkSession)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [presence(fold(x)).tolist() for x in byte_column(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.list_(pa.int32()))], ["label", "n", "grams"])

    rows = sample_rows(docs, text_col, label_col, id_col, per_label)
    got = rows.mapInArrow(grams, "label string, n int, grams array<int>").orderBy("label", "n").toArrow()
    names = got.column("label").to_pylist()
    sets = [np.asarray(x, np.int64) for x in got.column("grams").to_pylist()]
    labels = sorted(set(names))
    if not labels:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros((0, 0)), np.zeros(0))
    order = got.column("n").to_numpy()
    found = np.zeros(1 << _BITS, bool)
    for i in np.nonzero(order <= landmarks_per_label)[0]:
        found[sets[i]] = True
    vocabulary = np.nonzero(found)[0]
    column = np.full(1 << _BITS, -1, np.int64)
    column[vocabulary] = np.arange(len(vocabulary))

    def rows_of(some: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(some), len(vocabulary)), np.float32)
        for row, s in zip(x, some, strict=True):
            c = column[s]
            row[c[c >= 0]] = 1 / np.sqrt(len(s))
        return x

    marks = rows_of([s for s, n in zip(sets, order, strict=True) if n <= landmarks_per_label])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = values > 1e-6 * max(values.max(), 1e-12)
    root = vectors[:, keep] / np.sqrt(values[keep])
    alike = np.concatenate([rows_of(sets[at : at + _BLOCK]) @ marks.T for at in range(0, len(sets), _BLOCK)])
    phi = alike.astype(np.float64) @ root
    y = np.where(np.array(names)[:, None] == np.array(labels)[None, :], 1.0, -1.0)
    share = np.array([names.count(k) for k in labels]) / len(names)
    w = np.array([1 / (len(labels) * share[labels.index(k)]) for k in names])[:, None]  # each label weighs alike
    mean, goal = (w * phi).sum(0) / w.sum(), (w * y).sum(0) / w.sum()
    p, q = phi - mean, y - goal
    coef = np.linalg.solve(p.T @ (w * p) + ridge * w.sum() * np.eye(p.shape[1]), p.T @ (w * q))
    return Model(labels, vocabulary, marks, root @ coef, goal - mean @ coef)


def scores(model: Model, texts: list[bytes]) -> np.ndarray:
    """Text x label decision values; whole texts."""
    seen = np.zeros(1 << _BITS, bool)
    out = np.zeros((len(texts), len(model.labels)))
    for at in range(0, len(texts), _BLOCK):
        part = texts[at : at + _BLOCK]
        has = np.zeros((len(part), len(model.vocabulary)), np.float32)
        size = np.ones((len(part), 1))
        for i, data in enumerate(part):
            seen[:] = False
            for h in _hashed(data):
                seen[h] = True
            has[i] = seen[model.vocabulary]
            size[i] = np.sqrt(max(np.count_nonzero(seen), 1))
        out[at : at + _BLOCK] = ((has @ model.landmarks.T) / size) @ model.weights + model.bias
    return out


def predict(docs: DataFrame, model: Model, text_col: str = "text", out: tuple[str, str] = ("lang_pred", "score"), keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, all by default) with the predicted label and a score from 0 to 1 (softmax of four times the decision
    values).  Null texts and texts without a letter get ``und`` and 0.  Of columns that ``docs`` has
    under the output names, the new ones take the place.  Rows are never dropped or merged."""
    small_batches(docs.sparkSession)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in out]
    schema = StructType([*docs.select(*[F.col(f"`{c}`") for c in kept]).schema, StructField(out[0], StringType()), StructField(out[1], DoubleType())])
    at = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(at).cast(pa.binary()).to_pylist()
            names, best = [UNDETERMINED] * len(raw), np.zeros(len(raw))
            where = [i for i, x in enumerate(raw) if model.labels and has_letters(x)]
            if where:
                s = 4 * scores(model, [fold(raw[i]) for i in where])
                e = np.exp(s - s.max(1, keepdims=True))
                e /= e.sum(1, keepdims=True)
                for i, k, v in zip(where, e.argmax(1), e.max(1), strict=True):
                    names[i], best[i] = model.labels[k], v
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(names, pa.string()), pa.array(best, pa.float64())], [*kept, *out])

    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text_col).alias("__text")).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> F.Column:
    """Rows that training must not see: crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", **parameters) -> DataFrame:
    """(id_col, held_out, lang_pred, score) of every row, learnt from rows that aren't held out.

    A null id counts as not held out for the flag but is never trained on.  An empty table gives an
    empty result; a table without labels gives ``und`` throughout.
    """
    lesson = docs.where(~F.coalesce(held_out(id_col), F.lit(True)))
    model = train(lesson, text_col, label_col, id_col, **parameters)
    flags = docs.select(F.col(id_col), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), F.col(text_col).alias("__whole"))
    return predict(flags, model, "__whole", keep=[id_col, "held_out"])
